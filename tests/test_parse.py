from datetime import datetime

from pyspark.sql import functions as F

from emberlog.functions import levels as lv
from emberlog.functions.normalize import with_signature
from emberlog.operators.parse import parse_events

NOW = datetime(2026, 12, 31)

# raw -> (timestamp, level, message)
# Lines and what they parse to.
PARSED = {
    "2026-07-08T10:12:33Z ERROR database timeout": ("2026-07-08 10:12:33", "ERROR", "database timeout"),
    "2026-07-08 10:12:33 WARN disk 85%": ("2026-07-08 10:12:33", "WARN", "disk 85%"),
    "Jul  8 10:12:33 hostname sshd[1234]: Failed password":
        ("2026-07-08 10:12:33", "INFO", "hostname sshd[1234]: Failed password"),
    '192.168.1.1 - - [08/Jul/2026:10:12:33 +0000] "GET /api HTTP/1.1" 200 1234':
        ("2026-07-08 10:12:33", "INFO", '"GET /api HTTP/1.1" 200 1234'),
    "1720421553 ERROR something broke": ("2024-07-08 06:52:33", "ERROR", "something broke"),
    "ERROR this has no timestamp": (None, "ERROR", "this has no timestamp"),
    "just some random log line here": (None, "INFO", "just some random log line here"),
    "2026-07-08T10:12:33Z wArN mixed case": ("2026-07-08 10:12:33", "WARN", "mixed case"),
    "2026-07-08 10:12:33 WARNING: disk full": ("2026-07-08 10:12:33", "WARN", "ING: disk full"),
    "CRITICAL disk gone": (None, "FATAL", "CAL disk gone"),
    "[ERROR] 2026-07-08T10:12:33Z late": ("2026-07-08 10:12:33", "INFO", "late"),
    "INFO no error found": (None, "ERROR", "found"),
    "WARNINGS then WARN x": (None, "INFO", "WARNINGS then WARN x"),
    "2026-07-08T10:12:33Z ERROR": ("2026-07-08 10:12:33", "ERROR", "ERROR"),
    "2026-07-08T10:12:33+0530 ERROR x": (None, "ERROR", "x"),
    "08/Jul/2026:10:12:33 -0700 x": (None, "INFO", "08/Jul/2026:10:12:33 -0700 x"),
    "1720421553123 ERROR x": ("2024-07-08 06:52:33", "ERROR", "x"),
    "": (None, "INFO", ""),
    "2026-07-08T10:12:33.123456789+02:00 x": ("2026-07-08 08:12:33.123456", "INFO", "x"),
    "2026-02-30T10:12:33Z 2026-07-08 10:12:33 x": ("2026-07-08 10:12:33", "INFO", "x"),
    "Feb 29 10:00:00 x": (None, "INFO", "Feb 29 10:00:00 x"),
    "0001-01-01T00:00:00Z ERROR zero": (None, "ERROR", "zero"),
    "straße ERROR ß x": (None, "ERROR", "ß x"),
    "　  -[x] ": (None, "INFO", "x]"),
    "éERROR_ y": (None, "ERROR", "_ y"),
}


def test_parse_cases(spark):
    df = spark.createDataFrame([(r,) for r in PARSED], "text string")
    rows = parse_events(df, now=NOW).select("raw", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), "level_name", "message")
    got = {r[0]: (r[1], r[2], r[3]) for r in rows.collect()}
    for raw, (ts, level, message) in PARSED.items():
        full = None if ts is None else ts + ("" if "." in ts else ".000000")
        assert got[raw] == (full, level, message), raw


def test_message_keeps_no_part_of_the_keyword_when_not_compatible(spark):
    df = spark.createDataFrame([("WARNING: disk full",), ("CRITICAL x",)], "text string")
    assert {r.message for r in parse_events(df, compat=False).collect()} == {"disk full", "x"}


def test_year_of_syslog_lines(spark):
    df = spark.createDataFrame([("Feb 29 10:00:00 x",), ("Jan  2 00:00:00 x",), ("Jan  1 23:00:00 x",)], "text string")

    def years(now):
        return {r.raw[:6]: str(r.ts) for r in parse_events(df, now=now).collect()}

    assert years(datetime(2024, 1, 1)) == {
        "Feb 29": "2023-03-01 10:00:00", "Jan  2": "2024-01-02 00:00:00", "Jan  1": "2024-01-01 23:00:00"}
    assert years(datetime(2024, 12, 31))["Feb 29"] == "2024-02-29 10:00:00"
    assert years(datetime(2025, 12, 31))["Feb 29"] == "None"


def test_level_lookup(spark):
    cases = {
        "ERROR": 2, "error": 2, "Error": 2, "WARN": 1, "WARNING": 1, "INFO": 0, "DEBUG": -1, "TRACE": -1, "FATAL": 3,
        "CRITICAL": 3, "PANIC": 3, "UNKNOWN": None, "": None,
    }
    df = spark.createDataFrame([(c,) for c in cases], "name string").select("name", lv.parse_level("name").alias("d"))
    for row in df.collect():
        want = cases[row.name]
        assert (row.d.level, row.d.found) == (want or 0, want is not None), row.name


def test_level_detection_on_whole_lines(spark):
    cases = {
        "[ERROR] connection failed": (2, True), "ERROR: timeout": (2, True),
        "2026-07-08T10:12:33Z ERROR database timeout": (2, True), "WARNING: disk full": (1, True),
        "nothing here": (0, False), "FATAL: kernel panic": (3, True),
    }
    df = spark.createDataFrame([(c,) for c in cases], "raw string").select("raw", lv.detect_level("raw").alias("d"))
    assert {r.raw: (r.d.level, r.d.found) for r in df.collect()} == cases


# Messages and their signatures.
NORMALIZED = {
    "550e8400-e29b-41d4-a716-446655440000": "<uuid>",
    "connection from 192.168.1.1": "connection from <ip>",
    "timeout after 30 seconds": "timeout after <n> seconds",
    "failed to open /var/log/app.log": "failed to open <path>",
    "request 550e8400-e29b-41d4-a716-446655440000 from 10.0.0.1 failed after 5 retries":
        "request <uuid> from <ip> failed after <n> retries",
    "timeout after <n> seconds on host <ip>": "timeout after <n> seconds on host <ip>",
    "error code 0xdeadbeef occurred": "error code <hex> occurred",
    "req-abc12345: timeout": "<req>: timeout",
    "commit " + "0123456789abcdef" * 4: "commit <hash>",
    "replica lag of 30s on node 10.0.0.1": "replica lag of 30s on node <ip>",
    "req_abc123 f": "req_abc123 f",
    "from ::1 x": "from ::<n> x",
    "2001:db8::1": "<n>:db8<ip>",
    "timeout connecting to db-01 (10.0.0.5:5432)": "timeout connecting to db-<n> (<ip>:<n>)",
    "and/or HTTP/1.1 http://a.b/c:80 at 30s 1.5": "and<path> HTTP<path> http:<path> at 30s <n>.<n>",
    "é1 x": "é<n> x",
    "peer 1:2:3:4:5:6:7:8 gone": "peer <ip> gone",
}


def test_normalizer_cases(spark):
    df = with_signature(spark.createDataFrame([(m,) for m in NORMALIZED], "message string"))
    assert {r.message: r.signature for r in df.collect()} == NORMALIZED


def test_filters_do_not_repeat_the_parse(spark):
    df = spark.createDataFrame([("x",)], "text string")
    plan = parse_events(df, now=NOW).filter("level >= 2 and ts is not null")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("T\\d{2}:") == 1
