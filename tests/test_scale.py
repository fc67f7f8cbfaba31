"""Queries over many words: what is dealt out by document moves once, as whole texts; names that many share make no pairs."""

import random

import pytest
from pyspark.sql import functions as F

from spanforge.operators import contract, people, thresholds
from spanforge.operators import spans as S
from spanforge.plans.queries import QUERIES
from spanforge.session import beside
from spanforge.sources import documents


def test_sources_of_one_name_make_no_pairs(spark):
    sources = spark.range(2000).selectExpr("concat('d', id, '/same.pdf') AS source_path").union(spark.createDataFrame([("d/one.pdf",)], "source_path string"))
    cited = spark.createDataFrame([("same.pdf", "a"), ("same.pdf", "a"), ("one.pdf", "b"), ("one.pdf", "b"), ("d/one.pdf", "c"), ("lost", "d")], "source_filename string, title string")
    found = sorted((r.title, r.source_path or "", r.code or "") for r in people.unique_match(cited, sources).collect())
    one = "d/one.pdf"
    assert found == [("a", "", "ambiguous_source")] * 2 + [("b", one, "")] * 2 + [("c", one, ""), ("d", "", "no_source")]  # a repeated citation is none of its own rivals


def test_confidence_and_words_from_one_pass(spark):
    lines = spark.createDataFrame([(1, "5\t1\t1\t1\t1\t0\t0\t0\t1\t1\t80\ta\tb"), (1, "5\t1\t1\t1\t1\t1\t0\t0\t1\t1\t90\tc"), (1, "5\t1\t1\t1\t1\t2\t0\t0\t1\t1\t-1\td"), (2, "4\t1\t1\t1\t1\t0\t0\t0\t1\t1\t50\te")], "page_id int, value string")
    words = documents.ocr_words(lines)
    assert [r.text for r in words.orderBy("word").collect()] == ["a\tb", "c"] and "_f" not in words.columns
    assert [tuple(r) for r in documents.mean_confidence(words, "page_id").select("page_id", "confidence", "words").collect()] == [(1, 85.0, 2)]


@pytest.mark.parametrize("name", ["run_dominance", "recognised_records", "recognised_tags", "entity_islands", "bio_projection", "paragraphs", "block_words", "words_in_sentences", "guarded_edits"])
def test_words_stay_with_their_document(spark, name):
    """The texts are dealt out by document; what is exploded from them is not shuffled again."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line or "Exchange rangepartitioning" in line]
    assert dealt and all("hashpartitioning(doc_id" in line and "REPARTITION_BY_NUM" in line for line in dealt)


def test_session_beside_keeps_settings(spark):
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        other = beside(spark)
        assert other.conf.get("spark.sql.shuffle.partitions") == "7" and other.conf.get("spark.sql.session.timeZone") == "UTC"
        assert other.conf.get(name) == "false" and spark.conf.get(name) == "true" and beside(other) is other
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_overlaps_of_long_sequences_fold_in_short_groups(spark):
    """Pairs that share no span with their neighbours are groups of their own; a chain is one."""
    gold = ["B-age", "I-age", "O", "B-age", "I-age", "I-age", "O"] * 50
    pred = ["B-age", "B-age", "O", "O", "B-age", "B-age", "O"] * 50
    rows = spark.createDataFrame([(gold, pred)], "gold array<string>, pred array<string>")
    coded = rows.select(S.span_numbers(S.coded(F.col("gold"))).alias("g"), S.span_numbers(S.coded(F.col("pred"))).alias("p"))
    sizes = coded.select(F.transform(S.overlapping(F.col("g"), F.col("p")), lambda x: F.size(x)).alias("n")).first().n
    assert sizes == [2] * 100
    score = S.overlap_scores(rows).filter("value = 'age'").first()
    assert (score.tp, score.fp, score.fn) == (100, 100, 0)


def test_scores_and_reports_read_their_rows_once(spark):
    d = "/root/testdata/sf0.001"
    for name in ("t2_all_scores", "record_quality_report"):
        assert QUERIES[name](spark, d)._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1


def test_report_counts_records_without_tokens(spark):
    row = "'c' AS collection, 'One good sentence here.' AS sentence, CAST(NULL AS string) AS curated_sentence, {} AS tokens, array() AS entities, array() AS values, array() AS ner_tags, 1 AS sentence_id, 1 AS page, '1.0' AS schema_version, CAST(NULL AS struct<method:string,status:string,config_id:string>) AS mapping_provenance"
    kinds = {"entities": "array<struct<start:int,end:int,text:string,label:string,color:string>>", "values": "array<string>", "ner_tags": "array<string>"}
    rows = spark.sql("SELECT " + row.format("CAST(NULL AS array<string>)")).union(spark.sql("SELECT " + row.format("array('One')")))
    found = contract.quality_report(rows.withColumns({k: F.col(k).cast(v) for k, v in kinds.items()}), "collection").collect()
    assert {(r.code, r.n, r.records, r.flagged) for r in found} >= {("single_word_sentence", 1, 2, 1)}


@pytest.mark.parametrize("name", ["document_words", "document_texts"])
def test_placed_words_stay_with_their_document(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert dealt and all("hashpartitioning(doc_id" in line and "REPARTITION_BY_NUM" in line for line in dealt)
    assert "Union" not in plan  # parts of a union may cease to lie by the key while the query runs


def test_span_thresholds_multiply_no_row_by_the_grid(spark):
    plan = QUERIES["tune_span_thresholds"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate ") == 1  # one number for each word and gold span


def test_span_thresholds_by_counting_at_every_grid_point(spark):
    draw = random.Random(5)
    tags = ["O", "B-age", "I-age", "I-age", "B-social", "I-social", "I-other", None]
    rows = [([draw.choice(tags) for _ in range(n)], [(draw.choice(tags), draw.choice([None, 0.0, 0.05, 0.3, 0.55, 0.6, 0.95, 1.0])) for _ in range(n)]) for n in [0, 1, 2, *[30] * 40]]
    rows += [([t for t, _ in best], best) for _, best in rows] + [(["B-age"], None), (None, [("B-age", 0.5)])]

    def spans(words):
        found = []
        for i, tag in enumerate(words):
            if tag and tag != "O":
                if tag[0] == "I" and found and found[-1][1:] == (i, tag[2:]):
                    found[-1] = (found[-1][0], i + 1, tag[2:])
                else:
                    found.append((i, i + 1, tag[2:]))
        return set(found)

    expected = {}
    for value in ("age", "social"):
        at = []
        for t in thresholds.GRID:
            tp = n_pred = n_gold = 0
            for gold, best in rows:
                g = {s for s in spans(gold or []) if s[2] == value}
                p = spans([tag if tag and tag[2:] == value and prob is not None and prob >= t else "O" for tag, prob in best or []])
                tp, n_pred, n_gold = tp + len(g & p), n_pred + len(p), n_gold + len(g)
            at.append((-2 * tp / (n_pred + n_gold), abs(t - 0.5), t))
        best_f1, _, t = min(at)
        expected[value] = (t, round(-best_f1, 9))
    got = thresholds.tune_spans(spark.createDataFrame(rows, "gold array<string>, best array<struct<tag:string,p:double>>"))
    assert {r.value: (r.threshold, r.f1) for r in got.collect() if r.value in expected} == expected
