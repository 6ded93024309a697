"""Log lines derived from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BODY = """concat(
    CASE WHEN event_type = 'error' AND event_id % 11 = 0 THEN 'CRITICAL '
         WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'FATAL '
         WHEN event_type = 'error' THEN 'ERROR '
         WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 'WARNING: '
         WHEN event_type = 'purchase' THEN 'warn '
         WHEN event_type = 'signup' THEN 'INFO '
         WHEN event_type = 'view' THEN '[DEBUG] ' ELSE '' END,
    CASE cast(event_id % 6 AS int)
      WHEN 0 THEN concat('db timeout after ', cast(user_id AS string), ' ms on host 10.0.', cast(user_id % 4 AS string), '.5:5432')
      WHEN 1 THEN concat('request failed: POST /api/users/', cast(user_id AS string), ' code ', cast(event_id % 3 AS string))
      WHEN 2 THEN concat('req_', lpad(cast(event_id AS string), 10, 'a'), ' rejected at 0xdead', cast(user_id % 10 AS string))
      WHEN 3 THEN concat('user 550e8400-e29b-41d4-a716-', lpad(cast(user_id AS string), 12, '0'), ' locked')
      WHEN 4 THEN concat('commit ', lpad(cast(user_id AS string), 40, 'abcdef0123'), ' refused for 30s')
      ELSE 'plain failure without ids' END)"""

_TEXT = """CASE cast(event_id % 7 AS int)
    WHEN 0 THEN concat({iso}, 'Z ', body)
    WHEN 1 THEN concat({dsp}, ' ', body)
    WHEN 2 THEN concat({mon}, ' ', lpad(cast(day(ts) AS string), 2, ' '), ' ', {hms}, ' host svc[', cast(user_id AS string), ']: ', body)
    WHEN 3 THEN concat('10.0.0.', cast(user_id % 9 AS string), ' - - [', {clf}, ' +0000] "', body, '"')
    WHEN 4 THEN concat({epo}, ' ', body)
    WHEN 5 THEN body
    ELSE concat('  at com.example.Svc.run(Svc.java:', cast(user_id AS string), ')')
  END"""

_SPARK_SLOTS = {
    "iso": "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")",
    "dsp": "date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSS')",
    "mon": "date_format(ts, 'MMM')",
    "hms": "date_format(ts, 'HH:mm:ss')",
    "clf": "date_format(ts, 'dd/MMM/yyyy:HH:mm:ss')",
    "epo": "cast(unix_timestamp(ts) AS string)",
}

_DUCKDB_SLOTS = {
    "iso": "strftime(ts, '%Y-%m-%dT%H:%M:%S')",
    "dsp": "strftime(ts, '%Y-%m-%d %H:%M:%S.%g')",
    "mon": "strftime(ts, '%b')",
    "hms": "strftime(ts, '%H:%M:%S')",
    "clf": "strftime(ts, '%d/%b/%Y:%H:%M:%S')",
    "epo": "cast(cast(floor(epoch(ts)) AS bigint) AS string)",
}

SOURCES = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table; zone-less timestamps are read as UTC."""
    return _utc(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _utc(df: DataFrame) -> DataFrame:
    naive = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive})


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log text of the ``events`` table: eight sources, each with its lines numbered from 1 without gaps."""
    return _as_log(table(spark, sf_dir, "events"))


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # A stream's plain path must be a folder; a pattern may name a single file as well.
    return _utc(spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque?"))


def log_lines_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines as a stream of the table's files."""
    return _as_log(table_stream(spark, sf_dir, "events"))


def _as_log(events: DataFrame) -> DataFrame:
    events = events.select("event_id", "ts", "user_id", F.expr(_BODY).alias("body"))
    source_ord = F.col("event_id") % SOURCES
    return events.select(
        "event_id",
        source_ord.cast("int").alias("source_ord"),
        F.concat(F.lit("app-"), source_ord.cast("string"), F.lit(".log")).alias("source"),
        ((F.col("event_id") - source_ord) / SOURCES + 1).cast("bigint").alias("line"),
        F.expr(_TEXT.format(**_SPARK_SLOTS)).alias("text"),
    )


def log_lines_sql() -> str:
    """The same lines as a DuckDB query."""
    return f"""SELECT event_id, cast(event_id % {SOURCES} AS int) AS source_ord,
  concat('app-', cast(event_id % {SOURCES} AS string), '.log') AS source,
  cast((event_id - event_id % {SOURCES}) / {SOURCES} + 1 AS bigint) AS line,
  {_TEXT.format(**_DUCKDB_SLOTS)} AS text
FROM (SELECT event_id, ts, user_id, {_BODY} AS body FROM events) e"""
