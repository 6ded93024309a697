"""Live and periodic watching of log files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from emberlog.operators import aggregate
from emberlog.operators.filters import LogFilter
from emberlog.operators.fold import MAX_LINES
from emberlog.operators.parse import parse_events
from emberlog.streaming.fold import fold_stream


def watch_events(
    lines: DataFrame, where: LogFilter = LogFilter(), fold: bool = False, idle_ms: int | None = 5000, **options
) -> DataFrame:
    """Stream of matching events."""
    if fold:
        lines = fold_stream(lines, MAX_LINES, idle_ms)
    return where.apply(parse_events(lines, **options))


def _leading(rows: DataFrame, k: int, mode: str) -> DataFrame:
    """The total and the k best signatures of a report; all of them with ``k=0``."""
    groups = rows.filter("NOT whole AND signature IS NOT NULL")
    if k < 0:
        groups = groups.limit(0)
    elif k > 0:
        order = ["first.source_ord", "first.line"] if mode == aggregate.FIRST_K else [F.desc("n"), "signature"]
        groups = groups.orderBy(*order).limit(k)
    return rows.filter("whole").unionByName(groups)


def _with_rest(leading: DataFrame) -> DataFrame:
    """The best groups and, as one group without signature, all other events."""
    sums = [c for c in leading.columns if c not in ("whole", "signature", "first_ts", "last_ts", "first", "tick")]
    rest = leading.groupBy().agg(
        *[F.sum(F.when(F.col("whole"), F.col(c)).otherwise(-F.col(c))).alias(c) for c in sums],
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
    return leading.filter("NOT whole").drop("whole", "tick").unionByName(rest, allowMissingColumns=True)


def watch_report(
    events: DataFrame, on_report: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None,
    k: int = aggregate.TOP, mode: str = aggregate.EXACT, sources: list[str] | None = None,
    on_change: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Report over all events since the start, handed to ``on_report`` with a running number at every tick.

    The query's state is one row per signature.  A tick hands out only the signatures with new events, as they stand
    now (rows of ``report_groups`` with ``whole``, true for the one row over all events): ``on_change`` gets these.  Counts
    only grow, so the best groups of a tick are among those of the tick before and the changed ones; they are
    kept beside the checkpoint, K rows and the total.  While there are no events the report handed over has no row.

    Without ``every`` the query reports once over what is there and ends, as a last report after a stop.  With ``k=0`` every
    group is kept and reported, so every tick costs all of them; take ``on_change`` where there may be many.
    """
    label = sources[0] if sources else "stdin"
    groups = aggregate.report_groups(events, with_total=True)

    def tick(changed: DataFrame, number: int) -> None:
        spark = changed.sparkSession
        changed = changed.persist()
        stamped = T.StructType([*changed.schema.fields, T.StructField("tick", T.LongType())])
        try:
            if on_change:
                on_change(changed, number)
            rows = changed
            if number:
                held = spark.read.schema(stamped).parquet(f"{checkpoint}/report/{(number - 1) % 2}")
                held = held.filter(F.col("tick") == number - 1).drop("tick")
                same = held["whole"].eqNullSafe(changed["whole"]) & held["signature"].eqNullSafe(changed["signature"])
                rows = changed.unionByName(held.join(changed, same, "left_anti"))
            # Two folders in turn, so that a tick done again finds what it began with.
            place = f"{checkpoint}/report/{number % 2}"
            _leading(rows, k, mode).withColumn("tick", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(place)
        finally:
            changed.unpersist()
        best = _with_rest(spark.read.schema(stamped).parquet(place))
        # A report over nothing is dropped where it is used: looking first would run it twice.
        on_report(aggregate.report_of_groups(best, k, mode, None, label, sources or [label]).filter("total_lines > 0"), number)

    writer = groups.writeStream.outputMode("update").foreachBatch(tick).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
