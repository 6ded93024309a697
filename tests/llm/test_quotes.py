import re
import time

import duckdb
import pytest

from compare import rows_of
from emberlog.llm.queries import ORACLES
from emberlog.llm.quotes import reply_order

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
TALK = [
    (1, 0, "a", "The build fails.\nIt says no such file."),
    (1, 1, "b", "> the BUILD   fails.\nSince when?"),
    (1, 2, "a", "> > The build fails.\n> Since when?\nSince noon.\n> it says no such file.\nIndeed."),
    (1, 3, "c", ">nobody said this\nA new thought"),
    (1, 4, "b", "> A new thought\n> Since noon.\nTwo at once"),
    (1, 5, "a", "  >> Since when?\nQuoted too deep to reply to"),
    (1, 6, "c", "> Two at once\nDown the thread\n\n>\n> \n"),
    (2, 0, "a", "> The build fails.\nAnother conversation"),
    (2, 1, "b", None), (2, 2, "b", ""), (2, 3, "a", "Same line\nSame line"), (2, 4, "b", "> Same line\n> Same line"), (2, 5, "b", "> Same line\n\n> Same line"),
    (3, 0, "a", "> quotes itself\nquotes itself"),
]


@pytest.fixture
def talk(spark):
    return lambda rows: spark.createDataFrame(rows, SCHEMA)


def test_against_sql(talk):
    got = reply_order(talk(TALK))
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", TALK)
    want = con.execute(ORACLES["op6_quotes"])
    names = [d[0] for d in want.description]
    assert rows_of(got.columns, got.collect()) == rows_of(names, want.fetchall())


def test_threads(talk):
    got = {(r.conv_id, r.turn): r for r in reply_order(talk(TALK)).collect()}
    place = {k: (r.parent, r.thread, r.depth, r.n_quotes, r.n_linked) for k, r in got.items()}
    assert place[1, 1] == (0, 0, 1, 1, 1) and place[1, 2] == (1, 0, 2, 3, 3) and place[1, 3] == (None, 3, 0, 1, 0)
    assert place[1, 4] == (3, 3, 1, 1, 1) and place[1, 5] == (None, 5, 0, 1, 1) and place[1, 6] == (4, 3, 2, 2, 1)
    assert place[2, 0] == (None, 0, 0, 1, 0) and place[3, 0] == (None, 0, 0, 1, 0)
    assert got[1, 2].body == "Since noon.\nIndeed." and got[2, 1].body == ""


def test_long_thread(talk):
    rows = [(1, i, "a", f"> message {i - 1} of the thread\nmessage {i} of the thread") for i in range(70)]
    got = {r.turn: r for r in reply_order(talk(rows)).collect()}
    assert all(got[i].thread == 0 and got[i].depth == i for i in range(70))


def test_odd_inputs(spark, talk):
    from pyspark.sql import functions as F
    rows = [(None, 0, None, "first line here"), (None, 1, "a", "> first line here"), (1, None, "a", "> x"), (1, None, None, None), (1, 2, "a", "same"), (1, 2, "a", "same"), (1, 3, "b", "> same")]
    df = talk(rows).withColumns({c: F.lit("clash") for c in ("conv", "lines", "parent", "thread", "depth", "unit", "place", "origin")})
    out = reply_order(df).collect()
    assert len(out) == len(rows)
    by = {(r.conv_id, r.turn): r for r in out}
    assert by[None, 1].parent == 0 and by[1, 3].parent == 2 and sum(r.turn == 2 for r in out) == 2
    assert reply_order(talk([])).count() == 0


def test_a_very_long_message(talk):
    """100,000 lines in runs of every length, most of them quoted."""
    lines = [f"{'>' * (i // (1 + i % 7) % 3)} line {i}" for i in range(100_000)]
    start = time.time()
    got = {r.turn: r for r in reply_order(talk([(1, 0, "a", "line 5\nline 77777"), (1, 1, "b", "\n".join(lines))])).collect()}
    assert time.time() - start < 60
    levels = [len(re.match(">*", x)[0]) for x in lines]
    runs = [n for i, n in enumerate(levels) if i == 0 or levels[i - 1] != n]
    assert got[1].n_quotes == sum(n > 0 for n in runs)
    assert got[1].body == "\n".join(x for x, n in zip(lines, levels) if n == 0)
    assert got[1].n_linked == sum(levels[i] > 0 for i in (5, 77777))
