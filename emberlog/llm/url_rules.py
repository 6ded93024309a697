"""Allow and block rules for urls, found by a sorted sweep over reversed hosts.

A host's canonical key has its labels in reverse, each followed by a dot (``net.example.www.``), so a rule for a host and
its subdomains covers an interval of keys: those that start with its own.  Such intervals nest or are apart.
Urls and the starts of intervals are put in one order of keys, and the sweep carries a stack with one place per
nesting depth: the last interval of that depth that started.  It is active if the url's key starts with its key.
The rules of the active intervals are then tried on the path.

Order is needed within a task only, so urls are dealt out by a hash of the row, whatever their host, and each
share gets all starts of intervals.  The stack is made by window functions; no Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.llm.common import ascii_lower

ALLOW, BLOCK = "allow", "block"
_RULES = "host string, path string, verdict string"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to a slash, question mark, hash or the end; empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return ascii_lower(rest)


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark, hash or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def reversed_host(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, _RULES)


def judge(urls: DataFrame, rules: DataFrame, depth: int, default: str = ALLOW, shares: int | None = None) -> DataFrame:
    """``(page_id, url, host, path, rule, verdict)`` per row of ``urls (page_id, url)``.

    ``rules`` is ``(host, path, verdict)``; a rule fits its host and all subdomains if the url's path starts with
    the rule's path.  The longest host and path win; of equal ones ``allow``.  Without a rule the verdict is
    ``default`` and the rule null.  ``depth`` is the number of labels that a rule's host has at most; a longer one
    stops the query.  A null url, or one without ``://``, has an empty host and path, which no rule fits.  Repeated
    rows are judged one by one.

    ``shares`` is the number of tasks, the session's shuffle partitions by default.  Every share reads
    the start of each rule host, with all rules of that host in one row.
    """
    shares = shares or int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    host = ascii_lower(F.col("host"))
    one = rules.filter("host <> ''").select(
        reversed_host(host).alias("key"), host.alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    labels = F.size(F.split("key", r"\.")) - 1
    one = one.withColumn("depth", F.when(labels <= depth, labels).otherwise(
        F.raise_error(F.lit(f"a rule's host has more than {depth} labels")).cast("int")))
    starts = one.groupBy("key", "depth").agg(F.collect_set(F.struct(
        (F.char_length("host") + F.char_length("path")).alias("length"), (F.col("verdict") == ALLOW).alias("allows"),
        "host", "path", "verdict")).alias("rules"))
    starts = starts.select(
        F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), "key", F.lit(0).alias("kind"), "depth", "rules")

    parsed = urls.select(F.col("page_id"), F.col("url").cast("string").alias("url")).withColumns(
        {"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    keyed = parsed.select(
        F.pmod(F.xxhash64(F.col("page_id").cast("string"), "url"), F.lit(shares)).cast("int").alias("share"),
        reversed_host(F.col("host")).alias("key"), F.lit(1).alias("kind"), F.struct("page_id", "url", "host", "path").alias("page"))
    swept = keyed.unionByName(starts, allowMissingColumns=True)
    upto = Window.partitionBy("share").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stack = [
        F.last(F.when(F.col("depth") == d, F.struct("key", "rules")), ignorenulls=True).over(upto) for d in range(1, depth + 1)
    ]
    swept = swept.withColumns({f"_at{d}": place for d, place in enumerate(stack, 1)}).filter("kind = 1")
    active = [f"IF(startswith(key, _at{d}.key), _at{d}.rules, array())" for d in range(1, depth + 1)]
    fitting = f"filter(concat({', '.join(active)}), r -> startswith(page.path, r.path))" if active else "array()"
    best = swept.select("page", F.expr(f"array_max({fitting})").alias("best")) if active else None
    if best is None:
        return parsed.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    return best.select(
        "page.*", F.concat("best.host", "best.path").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
