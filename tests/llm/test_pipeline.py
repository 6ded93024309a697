import re

import corpus_pipeline
from emberlog.llm.common import shingles_of, words_of
from emberlog.llm.language import fit
from test_decontaminate import brute as passages
from test_line_dedup import brute as lines
from test_mixing import targets

DIR = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark, tmp_path):
    """Every stage on what the one before it wrote, compared with a plain version of its decision."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns = docs.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DIR).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        before, after = docs.collect(), out.collect()
        texts = {r.doc_id: r.text for r in before}
        if n < 4:
            assert out.columns == columns
        if name == "language_id":
            kept = [r for r, bad in zip(before, fit(docs).predict([r.text for r in before])[2]) if not bad]
            assert sorted(after) == sorted(kept) and len(kept) > 0.95 * len(before)
        elif name == "line_dedup":
            want = {doc: text for doc, text, _ in lines(list(texts.items()))}
            assert {r.doc_id: r.text for r in after} == want and all(r.n_chars == len(r.text) for r in after)
        elif name == "simhash_near_dedup":
            sets = {d: set(shingles_of(words_of(t), 5)) for d, t in texts.items()}
            root = {d: d for d in texts}
            for a in sorted(texts):
                for b in sorted(texts):
                    if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                        x, y = root[a], root[b]
                        root = {d: min(x, y) if r in (x, y) else r for d, r in root.items()}
            assert sorted(r.doc_id for r in after) == sorted(set(root.values()))
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
            assert sorted(r.doc_id for r in after) == sorted(d for d, _, hit, _ in passages(list(texts.items()), items) if not hit)
        else:
            sizes = {}
            count = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in before}
            for r in before:
                sizes[r.source] = sizes.get(r.source, 0) + count[r.doc_id]
            want = targets(sizes)
            for source, target in want.items():
                mine = [r for r in after if r.source == source]
                longest = max(count[r.doc_id] for r in before if r.source == source)
                assert abs(sum(r.taken for r in mine) - target) <= longest
            assert all(0 < r.copies <= 2 and r.taken == r.copies * count[r.doc_id] for r in after)
        docs = out


def test_run_repeats(spark):
    a, b = (sorted(map(tuple, corpus_pipeline.run(spark, DIR).collect())) for _ in range(2))
    assert a == b and a


def test_stages_take_odd_and_empty_rows(spark, odd, none):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, DIR).count() == 0, name
        stage(spark, odd, DIR).count()
