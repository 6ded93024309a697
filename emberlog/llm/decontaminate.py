"""Passages shared with benchmark items, found by winnowing.

Every window of ``SPAN`` words keeps the smallest hash of the ``K``-word grams in it (the rightmost of equal
ones).  Two equal spans of ``SPAN`` words keep the same gram, so a join on these fingerprints cannot miss one.
A hit is extended over the ``SPAN`` words of its window and compared word by word; windows that agree
overlap into passages of any length.

All of it is DataFrame work.  Documents are not shuffled: their windows are rows of a generator that probe the
fingerprints of the benchmark, and only hits and one row per document are grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import ascii_lower, checkpoint

SPAN = 10
K = 5
# Fingerprints of the benchmark are sent to every task while they take no more than this; beyond it they are joined
# by a shuffle of the distinct fingerprints of each document.
BROADCAST_BYTES = 64 << 20
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; none in a null text."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(f"({_WORD})"), F.lit(1))


def _gram(at: int, length: int) -> str:
    """SQL: hash of the ``length`` word hashes from ``pos + at`` on."""
    return "xxhash64(" + ", ".join(f"get(h, pos + {at + i})" for i in range(length)) + ")"


def _digest(hashes: str, at: str, length: str) -> str:
    """SQL: 128 bits of the ``length`` word hashes from place ``at`` on, which stand for the words."""
    part = f"slice({hashes}, {at} + 1, {length})"
    return f"struct(xxhash64({part}) AS a, xxhash64(1, {part}) AS b)"


def _windows(texts: DataFrame, carried: list[str], span: int, k: int, marker: bool) -> DataFrame:
    """``(…carried, w, h, pos, least, off)``: every window with its smallest gram and where that starts in it.

    ``w`` are the text's words and ``h`` their hashes.  With ``marker`` each text has one more row, with position -1.
    """
    last = f"size(w) - {span}"
    places = f"sequence(-1, greatest({last}, -1))" if marker else f"IF({last} >= 0, sequence(0, {last}), array())"
    rows = texts.withColumn("h", F.expr("transform(w, x -> xxhash64(x))")).select(*carried, "w", "h", F.explode(F.expr(places)).alias("pos"))
    grams = [_gram(i, k) for i in range(span - k + 1)]
    rows = rows.selectExpr("*", *[f"IF(pos >= 0, {g}, NULL) AS g{i}" for i, g in enumerate(grams)])
    names = [f"g{i}" for i in range(len(grams))]
    rows = rows.withColumn("least", F.least(*names) if len(names) > 1 else F.col(names[0]))
    off = F.coalesce(*[F.when(F.col(g) == F.col("least"), F.lit(i)) for i, g in reversed(list(enumerate(names)))])
    return rows.select(*carried, "w", "h", "pos", "least", off.alias("off"))


def benchmark_fingerprints(items: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """``(print, item, context, lead)``: each kept gram of an item once, with the words a window around it can hold."""
    kept = _windows(items, ["item"], span, k, marker=False).filter("least IS NOT NULL")
    at = F.col("pos") + F.col("off")
    first = F.greatest(at - (span - k), F.lit(0))
    context = F.slice("w", first + 1, at - first + span)
    return kept.select(
        F.col("least").alias("print"), "item", context.alias("context"), (at - first).alias("lead")).distinct()


def passages(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """``(doc_id, text_key, n_words, n_hit, items, spans)`` per row of ``docs (doc_id, text)`` against ``benchmark (item_id, text)``.

    A window is ``span`` consecutive words of an item, or all words of an item with fewer; a document word inside
    any occurrence of a window is hit.  ``spans`` are the hit passages as word ranges, end exclusive; ``items`` the
    ids of the items found, as strings in order.  A null text has no words; an item without words hits nothing; items
    with one id are one item, and those without an id together are the item with an empty name.  Repeated rows stay
    repeated; rows are told apart by ``doc_id`` and text.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w"))
    # A few rows per benchmark item; the documents' plan probes them again and again.
    items = checkpoint(items.filter("size(w) > 0").distinct())
    prints = checkpoint(benchmark_fingerprints(items, span, k))
    size = prints.select(F.sum(F.lit(64) + F.octet_length("item") + F.octet_length(F.array_join("context", "  ")))).first()[0] or 0
    short = [r[0] for r in items.filter(F.size("w") < span).select(F.size("w")).distinct().collect()]  # below span

    known = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("w"))
    own = ["doc_id", "text_key"]
    rows = _windows(known, own, span, k, marker=True)
    start = "greatest(lead - off, 0)"
    if size > BROADCAST_BYTES:
        # The same probe by a shuffle, of windows without the words around them: a digest tells whether words agree.
        window = F.expr(f"IF(pos >= 0, {_digest('h', 'pos', str(span))}, NULL)")
        rows = rows.select(*own, F.size("w").alias("n"), "pos", "least", "off", window.alias("window"))
        prints = prints.withColumn("ch", F.expr("transform(context, x -> xxhash64(x))")).drop("context")
        agree = f"window = {_digest('ch', start, str(span))}"
    else:
        rows = rows.select("*", F.size("w").alias("n"))
        prints = F.broadcast(prints)
        agree = f"slice(w, greatest(pos, 0) + 1, {span}) = slice(context, {start} + 1, {span})"
    probed = rows.join(prints, F.col("least") == F.col("print"), "left")
    found = probed.filter(F.expr(f"pos = -1 OR lead >= off AND {agree}")).select(
        *own, F.when(F.col("pos") == -1, F.col("n")).alias("n"), F.when(F.col("pos") >= 0, F.col("pos")).alias("pos"),
        F.lit(span).alias("length"), F.when(F.col("pos") >= 0, F.col("item")).alias("item"))
    if short:
        found = found.unionByName(_short_hits(known, items.filter(F.size("w") < span), own, short))

    grouped = found.groupBy(*own).agg(
        F.count("n").alias("copies"), F.max("n").alias("n_words"),
        F.array_sort(F.collect_set(F.when(F.col("pos").isNotNull(), F.struct("pos", "length")))).alias("hits"),
        F.array_sort(F.collect_set("item")).alias("items"))
    # Every word hit once, in order; a span begins and ends where the next word is not its neighbour.
    covered = F.expr("array_sort(array_distinct(flatten(transform(hits, x -> sequence(x.pos, x.pos + x.length - 1)))))")
    out = grouped.withColumn("covered", covered).withColumns({
        "starts": F.expr("filter(covered, (p, i) -> i = 0 OR get(covered, i - 1) <> p - 1)"),
        "ends": F.expr("filter(covered, (p, i) -> i = size(covered) - 1 OR get(covered, i + 1) <> p + 1)"),
        "n_hit": F.expr("cast(size(covered) AS bigint)")})
    out = out.withColumn("spans", F.expr("transform(starts, (p, i) -> named_struct('first', p, 'end', ends[i] + 1))"))
    rows = out.select("doc_id", "text_key", F.col("n_words").cast("bigint").alias("n_words"), "n_hit", "items", "spans", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.drop("col")


def _short_hits(known: DataFrame, items: DataFrame, own: list[str], lengths: list[int]) -> DataFrame:
    """Occurrences of items shorter than a window: runs of each of their lengths, all in one pass."""
    n, sizes = len(lengths), F.array(*[F.lit(m) for m in sorted(lengths)])
    # One generator for places and lengths: between two of them whole texts would be copied for every place.
    runs = known.withColumn("h", F.expr("transform(w, x -> xxhash64(x))")).select(
        *own, "h", F.explode(F.expr(f"IF(size(h) > 0, sequence(0, size(h) * {n} - 1), array())")).alias("at"))
    runs = runs.withColumns({"pos": F.expr(f"at div {n}").cast("int"), "length": F.element_at(sizes, F.col("at") % n + 1)})
    runs = runs.filter(F.col("pos") + F.col("length") <= F.size("h"))
    runs = runs.select(*own, "pos", "length", F.expr(_digest("h", "pos", "length")).alias("run"))
    whole = items.withColumn("h", F.expr("transform(w, x -> xxhash64(x))")).select(
        "item", F.size("h").alias("_m"), F.expr(_digest("h", "0", "size(h)")).alias("_run"))
    hits = runs.join(whole, (F.col("run") == F.col("_run")) & (F.col("length") == F.col("_m")))
    return hits.select(*own, F.lit(None).cast("int").alias("n"), "pos", "length", "item")


def clean_documents(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs."""
    hit = passages(docs, benchmark, span, k).filter("n_hit > 0").select(
        F.col("doc_id").alias("_d"), F.col("text_key").alias("_k")).distinct()
    packed = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("bigint").alias("_id"), F.xxhash64("text").alias("_key"))
    same = (F.col("_key") == F.col("_k")) & F.col("_id").eqNullSafe(F.col("_d"))
    return packed.join(hit, same, "left_anti").select("_row.*")
