import re

import duckdb
import pytest
from pyspark.sql import functions as F

from emberlog.functions.clock import parse_duration, parse_rfc3339, percent
from emberlog.functions.patterns import backtracks, found_in, required_strings, to_java
from emberlog.operators.filters import LogFilter, raw_matches

TEXTS = [
    "", "abc", "ABC def", "é1", "a1 b2", "line\n", "line\nnext", "x\x0by", "tab\tx", "a]b[c", "x&&y", "50%", "été", "a_b-c",
    "2026-07-08T10:12:33Z ERROR x", "{,3}", "aa{2}", "\r", "a\r\nb", "Straße", "ﬁ", "9", "x\\y", "#c", "ab\nab",
]
PATTERNS = [
    r"\bé?1\b", r"\d+\b", r"\Bb", r"\s", r"x\Sy", r"[\s]x", r"[^\S]x", "^next", "(?m)^next", "e$", "(?m)e$", r"e\z", "a.b",
    "(?s)e.n", "(?P<name>b)c", "(?i)abc$", "(?i:ABC) d", "[]a]b", "[^]]b", "a]b[[]", "x&&y", "[x&&y]{3}", "[[:alpha:]]+1",
    "[[:^alpha:]]", r"\pL\d", r"\p{Greek}", r"\PN$", r"\Q%\E$", r"\x41", r"\x{e9}t", r"\0101", r"\v", "{,3}", "a{2}", r"\w-\w",
    r"[\w-]+c", r"[\d-z]+", "[a-c-]b", "[+--]", "a{2,}", r"[\t-\r]", r"\p{Han}|x", "a|^$", "(a|b)+$", "a*?b", "(?U)a+", r"[\D]9|^9", r"\\", "#", r"\a", "(?m)^$", "(?-s)e.n", "(?im)^AB$",
]
BAD = [
    "a{2,1}", "a{1001}", "a{1001,}", "[z-a]", r"[\x{62}-a]", r"[a-\d]", r"\p{Foo}", r"[\p{Latn}]", "(?P<n>a)(?P<n>b)", r"\pQ",
    "(?=a)", "(?!a)", "(?<=a)b", r"(a)\1", "a++", "a**", "(?>a)", "(", ")", "[a", "*a", r"\Z", r"\h", "a{1}{2}", "\\", r"\k<n>"]


def test_patterns_match_like_re2(spark):
    con = duckdb.connect()
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").coalesce(1)
    flags = texts.select("i", *[F.col("t").rlike(to_java(p)).alias(f"p{n}") for n, p in enumerate(PATTERNS)]).collect()
    for row in flags:
        for n, pattern in enumerate(PATTERNS):
            want = con.execute("SELECT regexp_matches(?, ?)", [TEXTS[row.i], pattern]).fetchone()[0]
            assert row[f"p{n}"] == want, (TEXTS[row.i], pattern, to_java(pattern))


HARD = [
    "(a+)+b", "(a|a)*b", "(a*)*$", "(?:x+x+)+y", "(a{1,5}){2,}b", "((ab)+c?)+d", ".*a.*b.*c", "(?i)(t|T)*x", "(é|.)+z", r"(\w+\s?)+$", "(a|b)+$",
]
EASY = {
    "timeout": [["timeout"]], "a+b": [], "timeout|refused": [["timeout"], ["refused"]], "(?i)timeout": [], "time(out)?": [["time"]],
    r"err: \d+ of [ab]c": [["err: ", " of "]], r"\[pid\] x*yz": [["[pid] ", "yz"]], "abc|.": [], r"\Qa.b\E+c": [["a.b"]], "ab{0,2}cd": [["cd"]],
    "abc?d": [["ab"]], "(?P<n>xy)zz": [["zz"]], "héé+": [["héé"]],
}


def test_what_patterns_need_and_which_backtrack():
    assert all(backtracks(p) for p in HARD)
    assert not any(backtracks(p) for p in EASY)
    assert {p: required_strings(p) for p in EASY} == EASY


def test_found_in_agrees_with_re2_whatever_the_way(spark):
    con = duckdb.connect()
    texts = TEXTS + ["timeout refused", "err: 5 of bc", "a.bbb c a.bc", "[pid] yz", "aaaaab", "xxxy", "T" * 40 + "x", "acd abbcd", None]
    patterns = PATTERNS + HARD + list(EASY)
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    for row in frame.select("i", *[found_in(F.col("t"), p).alias(f"p{n}") for n, p in enumerate(patterns)]).collect():
        for n, pattern in enumerate(patterns):
            want = con.execute("SELECT regexp_matches(?, ?)", [texts[row.i], pattern]).fetchone()[0]
            assert row[f"p{n}"] == want, (texts[row.i], pattern)


def test_a_pattern_that_backtracks_ends(spark):
    frame = spark.createDataFrame([("a" * 500_000,), ("a" * 500_000 + "b",)], "raw string")
    for pattern in ("(a+)+b", "(a|a)*b$", "(a*)*b"):
        assert frame.filter(raw_matches(pattern)).count() == 1


@pytest.mark.parametrize("pattern", BAD)
def test_patterns_re2_does_not_have(pattern):
    with pytest.raises(ValueError):
        LogFilter(pattern=pattern)


def test_durations():
    cases = {"1h": 3600, "1h30m": 5400, "-1.5s": -1.5, "300ms": 0.3, "0": 0, "+2m": 120, ".5s": 0.5, "1us": 1e-6, "10µs": 1e-5}
    assert {t: parse_duration(t).total_seconds() for t in cases} == cases
    assert [parse_duration(t) for t in ("", "5", "1d", "h", "1h ", "--1s", "9999999h99999999999h")] == [None] * 7


def test_moments():
    assert str(parse_rfc3339("2026-07-08T10:12:33.5+02:00")) == "2026-07-08 08:12:33.500000+00:00"
    assert str(parse_rfc3339("2026-07-08T10:12:33Z")) == "2026-07-08 10:12:33+00:00"
    assert [parse_rfc3339(t) for t in ("2026-07-08", "2026-02-30T00:00:00Z", "2026-07-08 10:12:33Z", "x")] == [None] * 4


def test_unreadable_options_are_left_out():
    f = LogFilter.from_options(level="loud", since="soon", until="later")
    assert (f.level, f.since, f.until) == (-1, None, None)
    with pytest.raises(ValueError):
        LogFilter.from_options(regex="(")


def test_percent_rounds_like_printf(spark):
    pairs = [(a, b) for b in (1, 3, 7, 8, 16, 80, 160, 200, 640, 800, 1600, 2000, 3200, 8000, 16000) for a in range(0, b + 1, max(1, b // 97))]
    df = spark.createDataFrame(pairs, "a bigint, b bigint").coalesce(1)
    for r in df.select("a", "b", percent(F.col("a"), F.col("b"), 2).alias("two"), percent(F.col("a"), F.col("b"), 1).alias("one")).collect():
        value = r.a / r.b * 100
        assert (r.two, r.one) == (f"{value:.2f}", f"{value:.1f}"), (r.a, r.b)


def test_translation_is_plain_for_plain_patterns():
    assert re.search(to_java("timeout")[4:], "a timeout")
