import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanforge.operators import assembly, layout, pages
from spanforge.plans.queries import QUERIES, page_drawings, page_words  # before its modules
from spanforge.plans import texts as X  # isort: skip

WORDS = ["l'été", "Ann:", "co-op", "x\u000by", "№5", "-", "a’b’", "😀ok", "End.", "(so)", "é", "Dr.", "_1-", "What?!", "日本-語", "plain"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Texts of odd words and sizes; no text, an empty one, white space alone, and no id."""
    d = str(tmp_path_factory.mktemp("odd"))
    many = [(i, " \n".join(WORDS[(i * 7 + k * (i % 5 + 1)) % len(WORDS)] + ("" if k % 3 else ".") for k in range(n))) for i, n in enumerate([1, 2, 9, 10, 11, 39, 41, 100, 205, 650], 3)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (None, "lost words. " * 20), *many]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    return d


def rows_of(df):
    return sorted(repr(r.asDict(recursive=True)) for r in df.collect())


@pytest.mark.parametrize("name", ["recognised_records", "recognised_tags", "highlight_records"])
def test_documents_are_dealt_out_once_and_neither_joined_nor_ordered(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") == plan.count("Exchange") == 1
    assert "Window" not in plan and "Join" not in plan and "Aggregate" not in plan


def test_recognised_columns_as_by_joins_and_windows(spark, odd):
    from spanforge.plans.assembly import recognised

    words = page_words(spark, odd)
    word = F.col("word")
    colored = words.join(layout.recognised_colors(words, page_drawings(words), 0.35, "doc_id"), ["doc_id", "word"], "left")
    placed = colored.withColumns({"block": F.floor(word / 40), "paragraph": F.floor(word / 20), "line": F.floor(word / 10), "cell": F.when(word % 100 < 5, F.floor(word / 100))})
    want = layout.recognised_records(placed, "doc_id").filter("doc_id is not null")
    got = recognised(spark, odd)
    assert rows_of(got.select(*want.columns)) == rows_of(want) and got.count() > 50


def test_highlighted_columns_as_by_joins_and_windows(spark, odd):
    at = X.placed(spark, odd)
    sentences = assembly.sentences_of(assembly.document_texts(at, "doc_id"), "doc_id")
    want = assembly.highlight_records(assembly.coloured_entities(at, sentences, "doc_id"), sentences, "doc_id").filter("doc_id is not null")
    got = assembly.sentence_records(X.coloured_sentences(spark, odd), F.array(*[F.lit(c) for c in X.PALETTE]))
    assert rows_of(got.select(*want.columns)) == rows_of(want) and got.count() > 50


def test_runs_of_rows_keep_documents_whole():
    ids, texts = [1, 1, 2, None, 3, 3, 3, 4, 5], ["ab", "cd", None, "x", "efg", "h", "", "i", "jk"]
    batches = [pa.RecordBatch.from_arrays([pa.array(ids[a:b], pa.int64()), pa.array(texts[a:b])], names=["doc_id", "text"]) for a, b in ((0, 1), (1, 3), (3, 6), (6, 6), (6, 9))]
    runs = [t["doc_id"].to_pylist() for t in pages.whole(iter(batches), "doc_id", "text", 4)]
    assert [i for r in runs for i in r] == [1, 1, 3, 3, 3, 4, 5] and len(runs) > 1
    assert sum(len(set(r)) for r in runs) == 4  # no id is in two runs


def test_an_id_with_several_texts_is_one_document():
    rows = pa.table({"doc_id": [7, 7, 8], "text": ["a b", "c", "d"]})
    ids, doc, word, text = pages.tokens(rows)
    assert ids.to_pylist() == [7, 8] and doc.tolist() == [0, 0, 0, 1] and word.tolist() == [0, 0, 1, 0] and text.to_pylist() == ["a", "c", "b", "d"]


def test_token_sizes_are_cut_once(spark):
    """The text is not split again for each of its tokens."""
    plan = spark.createDataFrame([("a b",)], "t string").select(layout.token_spans(F.col("t")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and plan.count("regexp_extract_all(") == 1
