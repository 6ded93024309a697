"""Registered queries over whole tables, and their SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

import hashlib
from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import load
from emberlog.llm.decontaminate import passages
from emberlog.llm.infill import framed, infilled, with_digests
from emberlog.llm.language import fit, held_out, identify
from emberlog.llm.line_dedup import kept_text, line_bitmaps, with_bitmaps
from emberlog.llm.minhash import compare_with_next
from emberlog.llm.mixing import mix
from emberlog.llm.prefix_trie import conversation_trie
from emberlog.llm.quotes import reply_order
from emberlog.llm.secrets import find_secrets
from emberlog.llm.simhash import EXACT, near_duplicates
from emberlog.llm.token_count import count_tokens
from emberlog.llm.toxicity import fit as fit_toxicity
from emberlog.llm.toxicity import held_out as label_held_out
from emberlog.llm.toxicity import with_scores
from emberlog.llm.url_rules import judge, rule_table

# The rules of the url query.
URL_RULES = [
    ("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"),
]

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(load(spark, sf_dir, "documents"), EXACT)
    return found.select("doc_id", F.lower(F.hex("sig")).alias("fingerprint"), "component_id")


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix of all sources takes each document; long documents more often, by the root of their size."""
    mixed = mix(load(spark, sf_dir, "documents"), F.sqrt("size"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the labelled documents that are not held out."""
    docs = load(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    doc_id = F.col("_row.doc_id")
    return found.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "lang_pred", "score", "rejected")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in passages of the benchmark."""
    found = passages(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT item, w, least(len(w), 10) AS m FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS t FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM sized)),
lengths AS (SELECT DISTINCT m FROM windows),
runs AS (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS t
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, lengths WHERE len(w) >= m)),
hits AS (SELECT DISTINCT r.doc_id, r.i, r.m, x.item FROM runs r JOIN windows x ON r.t = x.t AND r.m = x.m),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(f.n, 0) AS n_items,
  sha256(coalesce(f.items, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN found f ON d.doc_id = f.doc_id
"""


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts and places of the base shapes, and places of all."""
    found = find_secrets(load(spark, sf_dir, "documents"))

    def joined(keep: str) -> str:
        return f"array_join(transform(filter(spans, s -> {keep}), s -> concat_ws(':', s.kind, s.start, s.end)), ',')"

    def count(kind: str):
        return F.expr(f"cast(size(filter(spans, s -> s.kind = '{kind}')) AS bigint)").alias(f"n_{kind}")

    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(F.expr(joined("s.kind <> 'dense'")), 256).alias("base_sha256"), F.expr(joined("true")).alias("spans"))


def op6_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of the conversations in its thread, without quotes."""
    return reply_order(load(spark, sf_dir, "conversations"))


_OP6_SQL = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS r, conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS lines FROM conversations),
l AS (SELECT r, conv_id, turn, unnest(lines) AS raw, generate_subscripts(lines, 1) AS pos FROM m),
leveled AS (SELECT *, regexp_extract(raw, '^((?:[ 	]*>)*)', 1) AS prefix FROM l),
bodied AS (SELECT r, conv_id, turn, pos, raw, length(prefix) - length(replace(prefix, '>', '')) AS level, substr(raw, length(prefix) + 1) AS body FROM leveled),
cut AS (SELECT *, CASE WHEN lag(level) OVER (PARTITION BY r ORDER BY pos) = level THEN 0 ELSE 1 END AS fresh FROM bodied),
placed AS (SELECT *, sum(fresh) OVER (PARTITION BY r ORDER BY pos) AS place FROM cut),
texts AS (SELECT r, conv_id, turn, place, level, body AS unit FROM placed
  UNION ALL SELECT r, conv_id, turn, place, level, string_agg(body, ' ' ORDER BY pos) FROM placed GROUP BY ALL),
units AS (SELECT DISTINCT r, conv_id, turn, place, level, trim(regexp_replace(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+', ' ', 'g')) AS unit FROM texts),
first AS (SELECT conv_id, unit, min(turn) AS origin FROM units WHERE level = 0 AND unit <> '' GROUP BY ALL),
linked AS (SELECT q.conv_id, q.turn, q.place, q.level, origin FROM units q JOIN first f ON q.conv_id = f.conv_id AND q.unit = f.unit
  WHERE q.level > 0 AND origin < q.turn),
links AS (SELECT conv_id, turn, max(origin) FILTER (WHERE level = 1) AS parent, count(DISTINCT place) AS n_linked FROM linked GROUP BY ALL),
up AS (SELECT conv_id, turn, parent AS thread, 1 AS depth FROM links WHERE parent IS NOT NULL
  UNION ALL SELECT u.conv_id, u.turn, k.parent, u.depth + 1 FROM up u JOIN links k ON u.conv_id = k.conv_id AND u.thread = k.turn WHERE k.parent IS NOT NULL),
roots AS (SELECT conv_id, turn, max(depth) AS depth, min(thread) AS thread FROM up GROUP BY ALL),
own AS (SELECT r, count(DISTINCT place) FILTER (WHERE level > 0) AS n_quotes, coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE level = 0), '') AS body FROM placed GROUP BY r)
SELECT m.conv_id, CAST(m.turn AS BIGINT) AS turn, role, CAST(parent AS BIGINT) AS parent, CAST(coalesce(thread, m.turn) AS BIGINT) AS thread,
  CAST(coalesce(depth, 0) AS BIGINT) AS depth, n_quotes, coalesce(n_linked, 0) AS n_linked, body
FROM m JOIN own USING (r) LEFT JOIN links k ON m.conv_id = k.conv_id AND m.turn = k.turn
LEFT JOIN roots t ON m.conv_id = t.conv_id AND m.turn = t.turn
"""


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines each document has and loses, and the digest of what stays."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, shas = [], []
            for text, bitmap in zip(batch.column("text"), batch.column("bitmap")):
                text = text.as_py() or ""
                lines.append(text.count("\n") + 1)
                shas.append(hashlib.sha256(kept_text(text, bitmap.as_py()).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lines, pa.int64()), batch.column("n_dropped"), pa.array(shas)],
                ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    found = line_bitmaps(docs)
    rows = with_bitmaps(docs, found).select("_row.doc_id", "_row.text", "bitmap", F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"))
    return rows.mapInArrow(digest, "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string")


_OP7_SQL = """
WITH texts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM texts),
keyed AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
often AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE o.first <> k.doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE o.first IS NULL OR o.first = k.doc_id), '')) AS kept_sha256
FROM keyed k LEFT JOIN often o ON k.key = o.key GROUP BY k.doc_id
"""


def op8_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return count_tokens(load(spark, sf_dir, "documents"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and how alike they are."""
    return compare_with_next(load(spark, sf_dir, "documents"))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    judged = judge(load(spark, sf_dir, "pages"), rule_table(spark, URL_RULES), depth=2)
    return judged.select("page_id", "host", "path", "rule", "verdict")


_OP10_SQL = r"""
WITH parsed AS (SELECT page_id,
  translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fit AS (SELECT page_id, host, path, h, p, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST) AS n
  FROM parsed LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, h || p AS rule, coalesce(v, 'allow') AS verdict FROM fit WHERE n = 1
"""


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels that are not held out and from unlabelled text."""
    docs = load(spark, sf_dir, "documents")
    found = with_scores(docs.select("doc_id", "text"), fit_toxicity(docs, load(spark, sf_dir, "labels")))
    doc_id = F.col("_row.doc_id")
    return found.select(doc_id.alias("doc_id"), label_held_out(doc_id).alias("held_out"), "score", "predicted")


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct beginning of the rebuilt conversations, with its members and what sharing it saves."""
    return conversation_trie(load(spark, sf_dir, "conversations"))


_OP12_SQL = """
WITH crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i,
  list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
  FROM (SELECT unnest(range(256)) AS i))),
turns AS (SELECT conv_id, k, x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS n FROM (
  SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, length(coalesce(text, '')) AS x
  FROM conversations WHERE conv_id IS NOT NULL)),
sizes AS (SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id),
hashed AS (SELECT s.conv_id, n, conv_id - conv_id % 100 AS giver, xor(4294967295, list_reduce(
  list_prepend(4294967295, list_transform(string_split(CAST(s.conv_id AS VARCHAR), ''), lambda b: CAST(ascii(b) AS BIGINT))),
  lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 6 AS h FROM sizes s, crc),
convs AS (SELECT c.conv_id, c.giver, c.h, least(c.h, coalesce(g.n, 0)) AS m, least(c.h, coalesce(g.n, 0)) + greatest(c.n - c.h, 0) AS total
  FROM hashed c LEFT JOIN sizes g ON g.conv_id = c.giver),
rebuilt AS (SELECT c.conv_id, total, t.n AS d, k, x FROM convs c JOIN turns t ON t.conv_id = c.giver AND t.n <= m
  UNION ALL SELECT c.conv_id, total, t.n - h + m, k, x FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.n > h),
path AS (SELECT conv_id, total, d, x, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY d) AS p,
  coalesce(string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS pp FROM rebuilt
  UNION ALL SELECT conv_id, total, 0, 0, '', NULL FROM convs),
nodes AS (SELECT d, p, min(pp) AS pp, min(conv_id) AS conv_id, count(*) AS n, max(x) AS x,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE total = d), '')) AS ends_sha256 FROM path GROUP BY d, p),
kids AS (SELECT pp AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY pp),
below AS (SELECT a.p, count(*) FILTER (WHERE k.n IS NULL) AS n_leaves, sum((u.n - 1) * u.x) AS saved
  FROM nodes u JOIN path a ON a.conv_id = u.conv_id AND a.d <= u.d LEFT JOIN kids k ON k.p = u.p GROUP BY a.p)
SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, v.n AS n_convs, coalesce(k.n, 0) AS n_children, b.n_leaves,
  CAST(b.saved AS BIGINT) AS saved_tokens, v.ends_sha256
FROM nodes v JOIN below b ON b.p = v.p LEFT JOIN kids k ON k.p = v.p LEFT JOIN nodes up ON up.p = v.pp
"""


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document rearranged for filling in its middle: cuts, and digests of the output and of the text rebuilt from it."""
    found = with_digests(infilled(framed(load(spark, sf_dir, "documents").select("doc_id", "text"))))
    return found.select("_row.doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


_OP13_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w,
  sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT doc_id, text, w, CAST(len(w) AS BIGINT) AS n, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2,
  CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM t),
cut AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
    WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
parts AS (SELECT *, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m, array_to_string(w[b + 1:], '') AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""


QUERIES: dict[str, Query] = {
    "op1_simhash": op1_simhash,
    "op2_mix": op2_mix,
    "op3_language": op3_language,
    "op4_decontaminate": op4_decontaminate,
    "op5_secrets": op5_secrets,
    "op6_quotes": op6_quotes,
    "op7_line_dedup": op7_line_dedup,
    "op8_token_count": op8_token_count,
    "op9_minhash": op9_minhash,
    "op10_url_rules": op10_url_rules,
    "op11_toxicity": op11_toxicity,
    "op12_trie": op12_trie,
    "op13_infill": op13_infill,
}

ORACLES: dict[str, str] = {
    "op4_decontaminate": _OP4_SQL,
    "op6_quotes": _OP6_SQL,
    "op7_line_dedup": _OP7_SQL,
    "op10_url_rules": _OP10_SQL,
    "op12_trie": _OP12_SQL,
    "op13_infill": _OP13_SQL,
}
