import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberlog.functions.clients import client_key
from emberlog.operators import admission as adm


def model(rows, limit, window):
    out, held = {}, {}
    for key, at, event in sorted(rows, key=lambda r: (r[1], r[2])):
        recent = [t for t in held.get(key, []) if t > at - window]
        out[event] = len(recent) < limit
        held[key] = recent + [at] if out[event] else recent
    return out


def frame(spark, rows):
    df = spark.createDataFrame(rows, "key string, at bigint, event bigint")
    return df.select("key", F.timestamp_micros("at").alias("ts"), "event")


def decisions(df):
    return {r.event: r.admitted for r in df.collect()}


@pytest.mark.parametrize("limit,window,rows,want", [
    (3, 60, [("a", 0)] * 4, "TTTF"),
    (2, 60, [("a", 0), ("b", 0), ("a", 1), ("b", 1), ("a", 2), ("b", 2)], "TTTTFF"),
    (1, 10, [("a", 0), ("a", 6), ("a", 12)], "TFT"),
    (1, 10, [("a", 0), ("a", 10)], "TT"),
])
def test_cases(spark, limit, window, rows, want):
    df = frame(spark, [(k, at * 1_000_000, i) for i, (k, at) in enumerate(rows)])
    out = decisions(adm.admission(df, "key", "ts", limit, timedelta(seconds=window), ["event"]))
    assert "".join("T" if out[i] else "F" for i in range(len(rows))) == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_hot_and_cold_keys_against_the_sequential_model(spark, seed, monkeypatch):
    monkeypatch.setattr(adm, "_WINDOWS_PER_BLOCK", 4)
    rng = random.Random(seed)
    rows = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(20)}", rng.randrange(0, 3000), i) for i in range(3000)]
    out = decisions(adm.admission(frame(spark, rows), "key", "ts", 3, timedelta(microseconds=17), ["event"]))
    assert out == model(rows, 3, 17)


def test_null_keys_and_times(spark):
    df = frame(spark, [(None, 0, 1), (None, 1, 2), ("a", 0, 3), ("a", None, 4)])
    out = decisions(adm.admission(df, "key", "ts", 1, timedelta(seconds=1), ["event"]))
    assert out == {1: True, 2: False, 3: True, 4: False}


def test_keys_and_expiry(spark):
    df = frame(spark, [("a", 0, 1), ("a", 50_000_000, 2), ("b", 10_000_000, 3), ("c", 20_000_000, 4)])
    admitted = adm.admission(df, "key", "ts", 5, timedelta(seconds=60), ["event"])
    at = datetime(1970, 1, 1, 0, 1, 10)
    assert [r.key for r in adm.active_keys(admitted, "key", "ts", at, timedelta(seconds=60)).orderBy("key").collect()] == ["a", "c"]
    alive = {r.key: r.alive for r in adm.idle_expiry(df, "key", "ts", at, timedelta(seconds=60)).collect()}
    assert alive == {"a": True, "b": True, "c": True}


def test_client_keys(spark):
    cases = {
        ("1.1.1.1, 2.2.2.2", "x:1"): "1.1.1.1", (" 1.1.1.1 ", "x:1"): "1.1.1.1", (",2.2.2.2", "x:1"): ",2.2.2.2",
        ("", "10.0.0.1:80"): "10.0.0.1", (None, "[::1]:80"): "[::1]", ("", "host"): "host", ("", ":80"): ":80",
    }
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, f string, a string")
    got = [r.k for r in df.select("i", client_key(F.col("f"), F.col("a")).alias("k")).orderBy("i").collect()]
    assert got == list(cases.values())


def test_keys_that_are_null_or_not_a_number(spark):
    """Nulls turn no key into a rounded one, and NaN is a key like any other."""
    big = 2**53
    rows = [(None, 0, 0), (big + 1, 0, 1), (big + 3, 0, 2), (big + 1, 1, 3), (None, 1, 4), (big + 2, 1, 5)]
    df = spark.createDataFrame(rows, "key bigint, at bigint, event bigint").select("key", F.timestamp_micros("at").alias("ts"), "event")
    assert decisions(adm.admission(df, "key", "ts", 1, timedelta(seconds=1), ["event"])) == {0: True, 1: True, 2: True, 3: False, 4: False, 5: True}
    nan = spark.createDataFrame([(float("nan"), 0, 0), (float("nan"), 1, 1), (0.5, 1, 2)], "key double, at bigint, event bigint")
    out = decisions(adm.admission(nan.select("key", F.timestamp_micros("at").alias("ts"), "event"), "key", "ts", 1, timedelta(seconds=2), ["event"]))
    assert out == {0: True, 1: False, 2: True}
