"""Quoted passages linked to the messages they come from; conversations in reply order without quotes.

A line's quote level is the number of ``>`` it starts with.  Lines of one level in a row are a passage.  Passages
and their lines are normalised and hashed; a quote is linked to the first message of its conversation that
holds a passage or line with the same hash as its own text.  A message replies to the latest message it
quotes directly (level 1); messages that hang together by replies are a thread.

All of it is DataFrame work.  Originals are reduced to one row per conversation and hash before the join, and no
conversation is ever gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import ascii_lower, checkpoint

_PREFIX = r"^((?:[ \t]*>)*)"


def _parsed_lines(text: Column) -> Column:
    """``array<struct<level, raw, body>>``: a null text is one empty line."""
    def line(raw: Column) -> Column:
        prefix = F.regexp_extract(raw, _PREFIX, 1)
        return F.struct(
            F.regexp_count(prefix, F.lit(">")).alias("level"), raw.alias("raw"),
            F.substring(raw, F.char_length(prefix) + 1, F.char_length(raw)).alias("body"))

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), line)


def _normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(ascii_lower(text), r"[\x20\x09-\x0D]+", " "))


# SQL over ``lines``: where a line has another level than the one before, and the runs of lines from there on,
# ``array<struct<level, bodies>>``.
_STARTS = "filter(sequence(0, size(lines) - 1), i -> i = 0 OR lines[i].level <> get(lines, i - 1).level)"
_PASSAGES = """transform(starts, (s, j) -> named_struct('level', lines[s].level,
    'bodies', transform(slice(lines, s + 1, coalesce(get(starts, j + 1), size(lines)) - s), x -> x.body)))"""


def _units(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Hashes of a passage and of each of its lines, where anything is left of them."""
    texts = F.array_union(F.array(F.array_join("passage.bodies", " ")), F.col("passage.bodies"))
    units = rows.select(*keep, F.explode(texts).alias("unit")).withColumn("unit", _normalised(F.col("unit")))
    return units.filter("unit <> ''").select(*keep, F.unhex(F.md5("unit")).alias("unit"))


def reply_order(messages: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, parent, thread, depth, n_quotes, n_linked, body)`` per row of ``messages``.

    ``parent`` is the turn replied to, ``thread`` the turn at the start of the replies (a message's own where it
    replies to none), ``depth`` the number of replies up to there; ordered by ``conv_id, thread, turn`` each
    conversation reads in reply order.  ``n_quotes`` counts the quoted passages, ``n_linked`` those whose source is
    found; ``body`` is the text without quoted lines.

    A null text is empty.  Rows with one ``conv_id`` and ``turn`` are one message (null equals null); repeated rows
    stay repeated.  A message without a turn can be quoted by none and replies to none.  Columns besides
    ``conv_id, turn, role, text`` are not looked at.
    """
    rows = messages.select(
        F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("bigint").alias("turn"),
        F.col("conv_id").alias("conv_id"), F.col("role").alias("role"), _parsed_lines(F.col("text")).alias("lines"))
    rows = rows.withColumn("conv", F.coalesce(F.concat(F.lit("="), "conv"), F.lit("")))
    rows = rows.withColumn("starts", F.expr(_STARTS))
    parts = rows.filter("turn IS NOT NULL").select("conv", "turn", F.posexplode(F.expr(_PASSAGES)).alias("place", "passage"))
    quotes = parts.filter("passage.level > 0")
    originals = _units(parts.filter("passage.level = 0"), ["conv", "turn"])
    first = originals.groupBy("conv", "unit").agg(F.min("turn").alias("origin"))
    asked = _units(quotes.withColumn("level", F.col("passage.level")), ["conv", "turn", "place", "level"]).distinct()
    linked = asked.join(first, ["conv", "unit"]).filter("origin < turn")
    links = checkpoint(linked.groupBy("conv", "turn").agg(
        F.max(F.when(F.col("level") == 1, F.col("origin"))).alias("parent"), F.count_distinct("place").alias("n_linked")))

    up = links.filter("parent IS NOT NULL").select("conv", "turn", F.col("parent").alias("thread"), F.lit(1).cast("bigint").alias("depth"))
    moved = 1
    while moved:  # pointers double their reach, so rounds grow with the logarithm of the depth
        above = up.select("conv", F.col("turn").alias("thread"), F.col("thread").alias("_t"), F.col("depth").alias("_d"))
        up = checkpoint(up.join(above, ["conv", "thread"], "left").select(
            "conv", "turn", F.coalesce("_t", "thread").alias("thread"),
            (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"), F.col("_t").isNotNull().alias("moved")))
        moved = up.filter("moved").count()
        up = up.drop("moved")

    known = links.join(up, ["conv", "turn"], "left").select(
        F.col("conv").alias("_c"), F.col("turn").alias("_t"), "parent", "thread", "depth", "n_linked")
    out = rows.join(known, (F.col("conv") == F.col("_c")) & (F.col("turn") == F.col("_t")), "left")
    n_quotes = F.expr("cast(size(filter(starts, s -> lines[s].level > 0)) AS bigint)")
    body = F.array_join(F.transform(F.filter("lines", lambda x: x.level == 0), lambda x: x.raw), "\n")
    return out.select(
        "conv_id", "turn", "role", "parent", F.coalesce("thread", "turn").alias("thread"),
        F.coalesce("depth", F.lit(0)).alias("depth"), n_quotes.alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"), body.alias("body"))
