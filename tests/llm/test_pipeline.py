"""The corpus pipeline: each stage's decisions against brute force on the smallest tables."""

import corpus_pipeline
from tests.llm.test_operators import D, components_plain, hits_plain, repeats_plain


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, D)
        assert out.columns == columns
        after = {r.doc_id: r.text for r in out.collect()}
        rows = sorted(before.items())
        if name == "n-gram Jaccard join":
            assert set(after) == {c for _, _, c in components_plain(rows, 5, 80, 100)}
        elif name == "substring dedup":
            want = {i: n - g for i, n, g, _ in repeats_plain(rows)}
            assert {i: len(t.encode().split()) for i, t in after.items()} == {i: n for i, n in want.items() if n}
        elif name == "benchmark decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{D}/benchmark.parquet").select("item_id", "text").collect()]
            assert set(after) == {i for i, *_, bad in hits_plain(rows, items, 10) if not bad}
        else:
            assert set(after) < set(before)
        docs, before = out.cache(), after


def test_run(spark):
    out = corpus_pipeline.run(spark, D)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)
