"""Corpus load, validator, releases, collections and recognised pages, end to end."""

import hashlib
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from spanforge.functions import text as T
from spanforge.operators import corpus, layout, registry, review_queue
from spanforge.sources import documents, packages, sinks

SOURCE = "example_id string, text string, values array<string>, document string, collection string, path string, ord long, problem string, unknown array<string>"


def source(spark, *rows):
    return spark.createDataFrame([(*r[:2], r[2], "d", "c", r[3], r[4], r[5], r[6]) for r in rows], SOURCE)


def test_the_first_source_stays(spark):
    a = source(spark, ("a1", "One  two", ["age"], "z", 2, None, []), ("a2", "x", ["age"], "z", 1, "short_row", ["lost"]))
    b = source(spark, ("b1", "One two", ["social"], "a", 1, None, ["K", "K"]), ("b2", " One two", ["age", "social"], "a", 2, None, None), ("b3", "three", [], "a", 3, None, []))
    rows = corpus.union_in_order(a, b)
    examples = corpus.merged_examples(rows)
    assert {(r.example_id, tuple(r["values"]), r.merged, r.conflicting) for r in examples.collect()} == {("a1", ("age", "social"), 2, 1), ("b3", (), 0, 0)}
    report = {(r.counter, r.name): r.n for r in corpus.load_report(rows, examples).collect()}
    assert report == {("files", "a"): 1, ("files", "z"): 1, ("skipped", "short_row"): 1, ("unknown_value_codes", "K"): 2, ("merged_duplicates", None): 2, ("conflicting_duplicates", None): 1, ("examples", None): 2}
    none = rows.limit(0)
    assert {r.n for r in corpus.load_report(none, corpus.merged_examples(none)).collect()} == {0}


def test_validator(spark, tmp_path):
    good = {"sentence_id": 1, "page": 1, "sentence": "a b", "tokens": ["a", "b"], "values": [], "entities": [], "ner_tags": ["O", "O"]}
    bad = {k: v for k, v in good.items() if k != "tokens"}
    for name, content in {"good": [good, good], "bad": [good, bad], "empty": []}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(content))
    (tmp_path / "broken.json").write_text('[{"sentence_id": ')

    def report(*names):
        return packages.validated(packages.read_records(spark, [str(tmp_path / f"{n}.json") for n in names]))

    got = {r.path.rsplit("/", 1)[-1]: (r.state, r.records, r.issues > 0) for r in report("good", "bad", "empty", "broken").collect()}
    assert got == {"good.json": ("valid", 2, False), "bad.json": ("invalid", 2, True), "empty.json": ("valid", 0, False), "broken.json": ("parse_error", 0, False)}
    assert [packages.exit_code(report(*n)) for n in (("good", "empty"), ("good", "bad"), ("bad", "broken"))] == [0, 1, 2]
    assert packages.exit_code(report("good").limit(0)) == 1


def test_discovery_and_properties(spark, tmp_path):
    core = '<cp:coreProperties xmlns:cp="c" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title> My title </dc:title><dc:creator>Ann</dc:creator></cp:coreProperties>'
    (tmp_path / "sub").mkdir()
    for name, parts in {"a.docx": {"docProps/core.xml": core}, "b.docx": {}, "sub/c.docx": {"docProps/core.xml": "<broken"}}.items():
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for part, content in parts.items():
                z.writestr(part, content)
    (tmp_path / "d.docx").write_bytes(b"no archive")
    (tmp_path / "~$a.docx").write_bytes(b"")
    got = {r.path.rsplit("/", 1)[-1]: (r.title, r.creators) for r in documents.read_properties(spark, str(tmp_path)).collect()}
    assert got["a.docx"] == ("My title", ["Ann"]) and got["b.docx"] == got["c.docx"] == got["d.docx"] == (None, [])
    names = lambda deep: sorted(r.source_path for r in packages.source_files(spark, str(tmp_path), deep).collect())
    assert names(True) == ["a.docx", "b.docx", "d.docx", "sub/c.docx"] and names(False) == ["a.docx", "b.docx", "d.docx"]


RECORD = "document_id string, sentence_id int, page int, sentence string, curated_sentence string, values array<string>, tokens array<string>, entities array<struct<start:int,end:int,text:string,label:string>>, ner_tags array<string>, schema_version string"


def release(spark):
    docs = spark.createDataFrame([("a", "s/a.pdf", "1"), ("b", "s/b.pdf", "2"), ("c", "s/c.pdf", "3")], "document_id string, source_path string, checksum string")
    rows = [(d, i, p, f"{d}{i}", None, ["age"], ["x"], [], ["O"], "1.0") for d, i, p in (("a", 2, 1), ("a", 1, 2), ("b", 1, 1))]
    return docs, spark.createDataFrame(rows, RECORD)


def test_release(spark, tmp_path):
    docs, records = release(spark)
    issues = spark.createDataFrame([("b", "stale_sentence_review")], "document_id string, code string")
    folder = str(tmp_path / "out")
    for ids, says in (([], "at least one"), (["a", "a"], "twice"), (["a", "zz"], "unknown"), (None, "stale_sentence_review"), (["b"], "not ready")):
        with pytest.raises(ValueError, match=says):
            sinks.write_release(records, docs, issues, folder, ids)
    with pytest.raises(ValueError, match="no documents"):
        sinks.write_release(records, docs.limit(0), issues, folder)
    assert not (tmp_path / "out").exists()
    files = sinks.write_release(records, docs, issues, folder, ["a", "c"]).collect()
    assert {r.path.split("/")[0] for r in files} == {"annotations", "table", "build-log"}
    for r in files:
        raw = (tmp_path / "out" / r.path).read_bytes()
        assert (r.bytes, r.hash) == (len(raw), "sha256:" + hashlib.sha256(raw).hexdigest())
    log = {r.document_id: r for r in spark.read.json(f"{folder}/build-log").collect()}
    assert {k: r.released for k, r in log.items()} == {"a": True, "b": False, "c": True}
    package = {r.document_id: r.package for r in spark.read.schema("document_id string, package string").json(f"{folder}/annotations").collect()}
    assert [x["sentence"] for x in json.loads(package["a"])["records"]] == ["a2", "a1"] and package["c"] is None
    assert log["a"].annotations_checksum == hashlib.sha256(package["a"].encode()).hexdigest()


def test_collection_is_all_or_nothing(spark):
    docs, records = release(spark)
    docs = docs.withColumn("status", F.when(F.col("document_id") == "b", "open").otherwise("done"))
    issue = lambda d: spark.createDataFrame([(d, "unknown_label")], "document_id string, code string")
    got = {r.document_id: [x.sentence_id for x in r.records] for r in registry.collection(docs, records, issue("b")).collect()}
    assert got == {"a": [2, 1], "c": []}
    with pytest.raises(ValueError, match="unknown_label"):
        registry.collection(docs, records, issue("a"))


def test_missing_evidence_closes_gates(spark):
    empty = "active_curator boolean, original_annotators array<string>, human_confirmed boolean, title string, creators array<string>, citation_text string, reference string, not_findable_reason string, colors_confirmed boolean, color_statuses array<string>, resource_count int, n_records int, n_reviewed int, n_decided int, review_available boolean, pending int, approved int, needs_correction int, excluded int, flagged int"
    full = (True, ["a"], True, "t", ["c"], "x", None, "lost", True, ["approved"], 3, 3, 3, 3, True, 0, 2, 0, 1, 1)
    half = (True, ["a"], False, "t", ["c"], "x", None, "lost", True, ["ignored"], 8, 8, 8, 1, True, 7, 1, 0, 0, 0)
    rows = spark.createDataFrame([full, half, (None,) * 20], empty)
    a, b, c = review_queue.queue(review_queue.gates(rows)).collect()
    assert a.annotation_complete and a.citation and not a.reasons and (a.completion_percent, a.total, a.flagged) == (100, 3, 1)
    assert not b.annotation_complete and not b.citation and b.completion_percent == 12 and b.reasons == [review_queue.REASONS["sentence_review"]]
    assert c.reasons == [r for r in review_queue.REASONS.values() if r] and (c.completion_percent, c.total, c.pending) == (0, 0, 0)
    assert not c.annotation_complete


def test_recognised_records(spark):
    """Two paragraphs and a cell: the cell is first by place, a paragraph without colour is left out."""
    at = lambda w, line, text, x, y, color, cell=None, par=0: (0, w, 0, par, line, text, float(x), float(y), color, cell)
    rows = [at(1, 1, "red", 0, 10, "R"), at(2, 1, "words", 20, 10, "R"), at(3, 2, "plain", 0, 20, None), at(4, 2, "blue", 20, 20, "B"), at(5, 3, "none", 0, 40, None, None, 1), at(6, 0, "cell", 5, 5, "B", 7, 1)]
    words = spark.createDataFrame(rows, "page int, word int, block int, paragraph int, line int, text string, x0 double, y0 double, color string, cell int")
    got = [(r.sentence_id, r.sentence, [tuple(e) for e in r.entities]) for r in layout.recognised_records(words, "page").orderBy("sentence_id").collect()]
    assert got == [(1, "cell", [(0, 4, "cell", "B", "B")]), (2, "red words\nplain blue", [(0, 9, "red words", "R", "R"), (16, 20, "blue", "B", "B")])]
    tagged = layout.recognised_records(words.withColumn("text", F.when(F.col("word") == 1, "re-d,").otherwise(F.col("text"))), "page").orderBy("sentence_id").collect()
    assert [(r.tokens, r["values"], r.ner_tags) for r in tagged] == [(["cell"], ["B"], ["B-B"]), (["re-d", ",", "words", "plain", "blue"], ["B", "R"], ["B-R", "I-R", "I-R", "O", "B-B"])]


def test_paths(spark):
    rows = {"a/../b": (False, True), "a..b": (True, True), "/a": (False, False), "a/../../b/c": (False, False), "": (True, True)}
    for path, want in rows.items():
        assert tuple(spark.range(1).select(T.stays_inside(F.lit(path)), T.stays_below(F.lit(path))).first()) == want
