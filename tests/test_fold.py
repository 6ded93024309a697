import random

import pytest

from emberlog.operators.fold import fold

CASES = [
    (["Error: something broke", "  at main.foo(test.go:42)", "  at main.bar(test.go:100)", "normal line"], 50,
     [(1, "Error: something broke|  at main.foo(test.go:42)|  at main.bar(test.go:100)"), (4, "normal line")]),
    (["  indented first line"], 50, [(1, "  indented first line")]),
    (["error start", "  frame1", "  frame2", "  frame3", "  frame4"], 2,
     [(1, "error start|  frame1|  frame2"), (4, "  frame3|  frame4")]),
    (["lock order broken", "\theld by worker 1"], 50, [(1, "lock order broken|\theld by worker 1")]),
    (["  lead", " c", "head", " 1", " 2", " 3", " 4", "", "\tx"], 2,
     [(1, "  lead| c"), (3, "head| 1| 2"), (6, " 3| 4"), (8, "|\tx")]),
]


def model(rows, max_lines, cross):
    """One line after the other: ``rows`` are ``(source_ord, source, line, text)`` in arrival order."""
    out, count, last = [], 0, None
    for ord_, source, line, text in rows:
        if out and text[:1] in ("\t", " ") and text and count < max_lines and (cross or source == last):
            out[-1][3] += "\n" + text
            count += 1
        else:
            out.append([ord_, source, line, text])
            count = 0
        last = source
    return sorted(map(tuple, out))


def result(df):
    return sorted((r.source_ord, r.source, r.line, r.text) for r in df.collect())


@pytest.mark.parametrize("texts,max_lines,want", CASES)
def test_fold_cases(lines, texts, max_lines, want):
    df = lines([(0, "a", i, t) for i, t in enumerate(texts, 1)])
    assert result(fold(df, max_lines)) == [(0, "a", n, t.replace("|", "\n")) for n, t in want]


def test_continuation_of_the_source_before(lines):
    df = lines([(0, "app.log", 42, "error"), (1, "ignored.log", 99, "  continuation")])
    assert result(fold(df, cross_source=True)) == [(0, "app.log", 42, "error\n  continuation")]
    assert len(result(fold(df))) == 2


@pytest.mark.parametrize("seed,max_lines,share", [(1, 0, 0.5), (2, 1, 0.9), (3, 2, 0.99), (4, 50, 1.0), (5, 5, 0.95)])
@pytest.mark.parametrize("cross", [False, True])
def test_fold_over_many_blocks(lines, seed, max_lines, share, cross):
    rng = random.Random(seed)
    rows = []
    for ord_ in range(4):
        for line in range(1, rng.choice([1, 40, 150]) + 1):
            rows.append((ord_, f"s{ord_}", line, rng.choice([" ", "\t"]) + str(line) if rng.random() < share else rng.choice(["h", ""])))
    shuffled = rng.sample(rows, len(rows))
    want = model(rows, max_lines, cross)
    for parts in (1, 7):
        df = lines(shuffled).repartition(parts)
        assert result(fold(df, max_lines, cross_source=cross, block_bits=2)) == want


def test_gaps_in_line_numbers(lines):
    df = lines([(0, "a", 1, "head"), (0, "a", 2, " cont"), (0, "a", 4, " cont"), (0, "a", 900_000, " over"), (0, "a", 900_001, "next")])
    assert result(fold(df, 2)) == [(0, "a", 1, "head\n cont\n cont"), (0, "a", 900_000, " over"), (0, "a", 900_001, "next")]
