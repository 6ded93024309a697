import itertools
import re

import pytest
from pyspark.sql import functions as F

from emberlog.llm import url_rules as U
from emberlog.llm.queries import URL_RULES

RULES = URL_RULES + [
    ("a.b.example.net", "/", "allow"), ("b.example.net", "/x/", "block"), ("b.example.net", "/x/y", "allow"), ("com", "/", "block"),
    ("b.example.net", "/x/y", "block"), ("com-x", "/", "block"), ("é.org", "", "block"),
]
HOSTS = ["net", "example.net", "b.example.net", "a.b.example.net", "xa.b.example.net", "notexample.net", "example.com", "com", "com-x", "co", "m.com-x",
         "EXAMPLE.Net", "é.org", "x.É.org", "example.net.", ".net", "", "user@example.net:80", "org", "a.org"]
PATHS = ["", "/", "/en/", "/en", "/EN/", "/de/x", "/fr/", "/x/y/z", "/x/", "?q=/en/", "#/en/", "/en/?a#b", "/x\n/y"]


def judge(url, rules):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    fit = [(len(h) + len(p), v == "allow", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


@pytest.mark.parametrize("rules", [URL_RULES, RULES, []])
@pytest.mark.parametrize("shares", [1, 5])
def test_against_brute_force(spark, rules, shares):
    urls = ["https://" + h + p for h, p in itertools.product(HOSTS, PATHS)] + [None, "", "no scheme", "a://b://example.net/en/", "://net/", "x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(pages, U.rule_table(spark, rules), 4, shares=shares).collect()}
    assert [got[i] for i in range(len(urls))] == [judge(u, rules) for u in urls]


def test_too_deep_a_rule_stops(spark):
    pages = spark.createDataFrame([(1, "http://a.b.c/")], "page_id bigint, url string")
    with pytest.raises(Exception, match="more than 2 labels"):
        U.judge(pages, U.rule_table(spark, [("a.b.c", "/", "block")]), 2).collect()


def test_odd_inputs(spark):
    pages = spark.createDataFrame([(None, None), (1, "http://x.net/"), (1, "http://x.net/")], "page_id bigint, url string")
    pages = pages.withColumns({c: F.lit("clash") for c in ("host", "path", "rule", "verdict", "key", "share", "kind", "depth", "rules", "page")})
    out = U.judge(pages, U.rule_table(spark, URL_RULES), 2)
    assert sorted((str(r.page_id), r.verdict) for r in out.collect()) == [("1", "block"), ("1", "block"), ("None", "allow")]
    assert U.judge(pages.limit(0), U.rule_table(spark, URL_RULES), 2).count() == 0
