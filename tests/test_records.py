"""Contract, registry, colours, layout, sources and sinks on small fixtures."""

import csv
import json
import zipfile

import random

import pytest
from pyspark.sql import functions as F

from spanforge.functions import text as T
from spanforge.operators import colors, contract, evaluation, layout, people, registry
from spanforge.sources import packages, quotations, sinks
from spanforge.streaming import audit

GOOD = {
    "sentence_id": 1,
    "page": 1,
    "sentence": "Old church.",
    "curated_sentence": None,
    "tokens": ["Old", "church", "."],
    "values": ["age"],
    "entities": [{"start": 0, "end": 3, "text": "Old", "label": "age", "color": None}],
    "ner_tags": ["B-age", "O", "O"],
    "schema_version": "1.0",
    "mapping_provenance": None,
}


def codes(spark, **change):
    df = spark.createDataFrame([{**GOOD, **change}], contract.RECORD)
    found = [i.code for i in df.select(contract.record_issues().alias("issues")).first().issues]
    assert [[i.code for i in r.issues] for r in contract.with_issues(df).collect()] == ([found] if found else [])
    return found


@pytest.mark.parametrize(
    "change, expected",
    [
        ({}, []),
        ({"values": ["beauty"]}, ["unknown_label", "value_entity_mismatch", "bio_value_mismatch"]),
        ({"entities": [{"start": 0, "end": 99, "text": "Old", "label": "age", "color": None}]}, ["invalid_entity_offset"]),
        ({"entities": [{"start": 0, "end": 3, "text": "old", "label": "age", "color": "red"}]}, ["invalid_color", "entity_text_mismatch"]),
        ({"ner_tags": ["I-age", "O", "O"]}, ["invalid_bio_transition"]),
        ({"ner_tags": ["B-age", "Z", "O"]}, ["invalid_bio_tag"]),
        ({"ner_tags": ["B-age", "O"]}, ["token_tag_length_mismatch"]),
        ({"curated_sentence": " "}, ["invalid_curated_sentence", "invalid_entity_offset"]),
        ({"page": 0, "schema_version": "9"}, ["invalid_type", "unsupported_schema_version"]),
        ({"mapping_provenance": {"method": "", "status": "x", "config_id": None}}, ["invalid_type", "invalid_mapping_status"]),
    ],
)
def test_contract(spark, change, expected):
    assert codes(spark, **change) == expected


def test_structure(spark):
    good = {k: v for k, v in GOOD.items() if v is not None}
    cases = [good, {**good, "page": "1"}, {k: v for k, v in good.items() if k != "tokens"}, {**good, "extra": 1}, [], None]
    df = spark.createDataFrame([(json.dumps(c) if c is not None else "{broken",) for c in cases], "j string")
    got = [[(i.code, i.path) for i in r[0]] for r in df.select(contract.structural(F.col("j"))).collect()]
    assert got[0] == [] and got[1] == [("invalid_type", "$.page")] and got[2] == [("invalid_type", "$.tokens")]
    assert got[3] == [("invalid_type", "$.extra")] and got[4] == [("invalid_type", "$")] and got[5] == [("invalid_json", "$")]


def test_quality_flags(spark):
    df = spark.createDataFrame([{**GOOD, "sentence": "  "}, {**GOOD, "sentence": "Old\u0001", "tokens": ["Old"]}], contract.RECORD)
    got = [[f.code for f in r[0]] for r in df.select(contract.quality_flags()).collect()]
    assert got[0][0] == "empty_sentence" and "unusually_short_sentence" not in got[0]
    assert got[1][:4] == ["unusually_short_sentence", "suspicious_character", "likely_sentence_boundary_error", "single_word_sentence"]


def test_registry(spark):
    a = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "source_path string, checksum string")
    b = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "source_path string, checksum string")
    got = {r.source_path: r.source_state for r in registry.synchronise(a, b).collect()}
    assert got == {"a": "current", "b": "changed", "c": "missing", "d": "new"}
    summary = registry.registry_summary(registry.synchronise(a, b)).first()
    assert (summary.total, summary.registered, summary.up_to_date) == (4, 3, False)
    assert registry.registry_summary(registry.synchronise(a.limit(0), b.limit(0))).first().up_to_date
    ids = [r.document_id for r in registry.document_ids(a).collect()]
    assert len(set(ids)) == 3 and all(len(i) == 16 for i in ids)


def test_reviews(spark):
    records = spark.createDataFrame([(1, 1, 1, "x"), (1, 2, 1, "y"), (1, 3, 1, "z")], "doc_id long, sentence_id long, page long, sentence string")
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    reviews = spark.createDataFrame([(1, 1, "approved", sha("x"), 5), (1, 2, "approved", sha("old"), 6), (1, 9, "pending", sha("?"), 7)], "doc_id long, sentence_id long, status string, record_sha256 string, decided_at long")
    assert {(r.sentence_id, r.code) for r in registry.stale_reviews(records, reviews).collect()} == {(2, "stale_sentence_review"), (9, "review_annotation_mismatch")}
    got = {r.sentence_id: (r.status, r.event) for r in registry.refreshed_reviews(records, reviews).collect()}
    assert got == {1: ("approved", "kept"), 2: ("pending", "reset"), 3: ("pending", "created")}
    assert [r.sentence_id for r in registry.release_rows(records, reviews).collect()] == [1]
    counts = registry.review_counts(spark.createDataFrame([("approved", 1)] + [("pending", 2)] * 7, "status string, decided_at long")).first()
    assert counts.percent == 12 and not counts.complete and counts.reviewed_at == 1


def test_colors(spark):
    palette = spark.createDataFrame([("d", "#00FF00", "age", "approved")], "doc string, hex string, label string, status string")
    records = spark.createDataFrame([("d", "s", [(0, 3, "Old", None, "#00ff00")], ["B-#00FF00", "O"]), ("d", "t", [(0, 1, "x", None, "#111111")], ["B-#111111"])], f"doc string, sentence string, entities array<{contract.ENTITY.split('<', 1)[0]}<{contract.ENTITY.split('<', 1)[1]}>, ner_tags array<string>" if False else f"doc string, sentence string, entities array<{contract.ENTITY}>, ner_tags array<string>")
    assert [r.hex for r in colors.unmapped(colors.observed(records, "doc"), palette, "doc").collect()] == ["#111111"]
    got = {r.hex: (r.status, r.confirmed) for r in colors.with_new_colors(palette, colors.observed(records, "doc"), "doc").collect()}
    assert got == {"#00FF00": ("approved", False), "#111111": ("pending", False)}
    compiled = colors.compile_draft(records, F.create_map(F.lit("#00FF00"), F.lit("age")), F.array(F.lit("#111111"))).collect()
    assert len(compiled) == 1 and compiled[0].ner_tags == ["B-age", "O"] and compiled[0].entities[0].label == "age" and list(compiled[0]["values"]) == ["age"]
    decisions = spark.createDataFrame([("#00ff00", "age", None), ("#222222", "age", "why")], "hex string, label string, reason string")
    assert {(r.hex, r.code) for r in colors.decision_issues(colors.observed(records), decisions).collect()} == {("#111111", "missing_decision"), ("#222222", "unknown_color"), ("#222222", "label_xor_reason")}


def test_layout(spark):
    words = spark.createDataFrame([(1, 0, 0, 10, 10), (2, 100, 0, 110, 10)], "word int, x0 int, y0 int, x1 int, y1 int")
    drawings = spark.createDataFrame([(1, "red", 0, 0, 5, 200), (2, "blue", 5, 0, 10, 200), (3, "green", 109, 0, 200, 1)], "drawing int, color string, x0 int, y0 int, x1 int, y1 int")
    assert {r.word: r.color for r in layout.highlight_words(words, drawings).collect()} == {1: "red"}
    tokens = spark.createDataFrame([(1, 1, 8), (2, 10, 15)], "token int, ts int, te int")
    runs = spark.createDataFrame([("a", 0, 3), ("b", 3, 10), (None, 10, 15)], "color string, rs int, re int")
    assert {r.token: r.color for r in layout.dominant_color(tokens, runs).collect()} == {1: "b", 2: None}
    points = spark.createDataFrame([(1, 5, 5)], "point int, x int, y int")
    rects = spark.createDataFrame([(2, "red", 0, 0, 10, 10), (1, None, 0, 0, 10, 10)], "rect int, color string, x0 int, y0 int, x1 int, y1 int")
    assert layout.first_containing(points, rects).first().color is None
    colored = spark.createDataFrame([(1, "a", "red"), (2, "b.", "red"), (3, "c", None), (4, "d", "red")], "word int, text string, color string")
    assert {(r.first, r.last, r.text) for r in layout.islands(colored).collect()} == {(1, 2, "a b"), (4, 4, "d")}


def order_plain(blocks, width, height):
    """(band, column) of blocks by definition: bands between edges of wide blocks, first column that fits."""
    wide = [b for b in blocks if b[1] < 0.45 * width and b[3] > 0.55 * width and b[3] - b[1] > 0.6 * width]
    edges = sorted({0, height} | {y for b in wide for y in (b[2], b[4])})
    inside = lambda b: [i for i in range(len(edges) - 1) if edges[i] <= (b[2] + b[4]) / 2 <= edges[i + 1]]
    column = {}
    for i in range(len(edges) - 1):
        columns = []
        for b in sorted((b for b in blocks if b not in wide and i in inside(b)), key=lambda b: b[1]):
            at = None
            for k, (lo, hi) in enumerate(columns):
                common = min(b[3], hi) - max(b[1], lo)
                if common > 0.3 * min(b[3] - b[1], hi - lo) or common > 0 and b[1] >= lo - 5 and b[3] <= hi + 5:
                    at = k
                    break
            if at is None:
                columns.append((b[1], b[3]))
            else:
                columns[at] = (min(columns[at][0], b[1]), max(columns[at][1], b[3]))
            column.setdefault((i, b[0]), len(columns) - 1 if at is None else at)
    meta = {b[0]: ((inside(b) or [0])[0], 0 if b in wide else column.get(((inside(b) or [0])[0], b[0]), 0)) for b in blocks}
    return [b[0] for b in sorted(blocks, key=lambda b: (*meta[b[0]], round(b[2] / 3) * 3, b[1], b[0]))]


def test_reading_order(spark):
    rng = random.Random(9)
    pages = {}
    for page in range(12):
        pages[page] = []
        for block in range(rng.randrange(1, 14)):
            x0, y0 = rng.randrange(0, 80), rng.randrange(0, 180)
            pages[page].append((block, x0, y0, x0 + rng.choice([8, 20, 40, 90]), y0 + rng.choice([4, 10, 20])))
    schema = "page int, block int, x0 int, y0 int, x1 int, y1 int, width int, height int, rotation int"
    df = spark.createDataFrame([(p, *b, 100, 200, 0) for p, found in pages.items() for b in found], schema)
    got = {}
    for r in layout.reading_order(df, "page").orderBy("page", "position").collect():
        got.setdefault(r.page, []).append(r.block)
    assert got == {p: order_plain(found, 100, 200) for p, found in pages.items()}
    turned = spark.createDataFrame([(1, b, x, y, x + 5, y + 5, 100, 200, a) for a in (90, 180, 270) for b, x, y in ((a, 10, 50), (a + 1, 30, 20))], schema)
    by = lambda a: [r.block for r in layout.reading_order(turned.filter(F.col("rotation") == a), "page").orderBy("position").collect()]
    assert by(90) == [90, 91] and by(180) == [180, 181] and by(270) == [271, 270]


def test_null_groups_and_large_rows(spark):
    from spanforge.operators import spans, statistics

    df = spark.createDataFrame([(None, ["B-age", "O"], ["B-age", "O"]), ("c", ["B-age"], ["O"])], "collection string, gold array<string>, pred array<string>")
    for way in (spans.exact_scores, spans.overlap_scores, spans.token_scores):
        got = {(r.collection, r.value): (r.tp, r.support) for r in way(df, "collection").collect()}
        assert len(got) == 16 and got[None, "age"] == (1, 1) and got["c", "age"] == (0, 1) and got[None, "social"] == (0, 0)
    assert spark.range(1).select(statistics.digest_weight(F.lit(10**12), F.lit(1000))).first()[0] >= 0
    records = spark.createDataFrame([{**GOOD, "sentence": "x"}], contract.RECORD).withColumn("collection", F.lit(None).cast("string"))
    assert contract.quality_report(records, "collection").filter("code = 'unusually_short_sentence'").count() == 1


def test_text(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.normalise_space(F.lit(" a \u001c b　\n"))) == "a b"
    assert one(T.expand_ligatures(F.lit("ﬁn"))) == "fin"
    assert one(T.page_numbers(F.lit("1-3, 7,2"))) == [1, 2, 3, 7] and one(T.page_numbers(F.lit("3-1"))) is None and one(T.page_numbers(F.lit("x"))) is None
    assert one(T.hex_color(F.lit(1), F.lit(255), F.lit(0))) == "#01FF00" and one(T.is_colourful(F.lit("#808080"))) is False
    assert one(T.nearest_color(F.lit("#FE0101"), {"red": "#FF0000", "blue": "#0000FF"})) == "red"
    assert tuple(one(T.strip_speaker(F.lit("Jan de Vries: ja")))) == ("ja", 14)
    assert one(T.language(F.lit("Het is de kerk"))) == "nl" and one(T.language(F.lit("is"))) == "en"
    assert one(T.color_name(F.lit("#FF0000"))) == "Red" and one(T.color_name(F.lit("#FE0102"))) == "Near red" and one(T.contrast(F.lit("#FFFF00"))) == "#000000"
    assert one(T.is_margin_code(F.lit(" SO3/EN1 "))) and not one(T.is_margin_code(F.lit("SO3 EN1")))
    n = lambda v: F.lit(float(v))
    assert one(layout.is_page_number(F.lit(" - 12 -"), n(0), n(0), n(9), n(9), n(600), n(800), F.lit(0)))
    assert not one(layout.is_margin(n(0), n(300), n(9), n(309), n(600), n(800), F.lit(0))) and one(layout.is_margin(n(0), n(300), n(9), n(309), n(600), n(800), F.lit(90)))


def test_evaluation(spark):
    schema = "case_id string, sentence_id int, page int, s int, e int, text string, label string, ord int"
    gold = spark.createDataFrame([("c", 1, 1, 0, 1, "a", "age", 1), ("c", 1, 1, 2, 3, "b", "age", 2)], schema)
    seen = spark.createDataFrame([("c", 1, 1, 0, 1, "a", "age", 1), ("c", 1, 1, 0, 1, "a", "social", 2)], schema)
    r = evaluation.span_ratios(gold, seen).first()
    assert (r.gold, r.observed, r.matched, r.label_matches, r.precision, r.recall, r.label_accuracy) == (2, 1, 1, 0, 1.0, 0.5, 0.0)
    rates = evaluation.rates(spark.createDataFrame([("a", True), ("a", False), ("a", False), ("a", False), (None, False)], "label string, corrected boolean")).first()
    assert (rates.correction_rate, rates.abstention_rate) == (0.25, 0.2)
    assert evaluation.rates(spark.createDataFrame([], "label string, corrected boolean")).first().correction_rate is None


def test_people(spark):
    who = spark.createDataFrame([("PERSON-1", "A", ["curator"], "", "", True, "x")], "person_id string, name string, roles array<string>, email string, orcid string, active_curator boolean, affiliation string")
    assert who.select(contract.person_issues()).first()[0] == []
    docs = spark.createDataFrame([("d1", "PERSON-1"), ("d2", "PERSON-9")], "document_id string, person_id string")
    assert {r.document_id: r.code for r in people.assign(docs, who, "curator").collect()} == {"d1": None, "d2": "unknown_person"}


def test_quotations(spark, tmp_path):
    (tmp_path / "one.csv").write_bytes("ID;Quotation Name;Document;Document Groups;Quotation Content;Comment;Codes;Reference\n1;n;Doc;g;caf\xe9  bar;c;Value: Historic - After\nValue: Beauty;r\n2;n;Doc\n3;n;D;g; ;c;Value: Age;r\n".replace("After\nValue", "After, Value").encode("cp1252"))
    (tmp_path / "two.csv").write_text("ID;????;??;???;??;??;??;??\n1;n;Doc;g;text;c;Value: Aesthetics;r\n", encoding="utf-8-sig")
    got = quotations.read_quotations(spark, str(tmp_path)).orderBy("collection", "row").collect()
    assert [(r.text, list(r["values"] or []), r.problem) for r in got] == [("café bar", ["historic"], None), (None, [], "short_row"), ("", ["age"], "empty_quotation"), ("text", ["aesthetical"], None)]
    assert got[0].unknown == ["Beauty"] and got[0].example_id.startswith("quotation:")


def test_sheets(spark, tmp_path):
    header = ["Folder_ID", "Sentence", *map(str, range(1, 9)), "Datasource"]
    with open(tmp_path / "s.csv", "w", newline="") as f:
        csv.writer(f).writerows([header, ["", "a  b", "2", "", "x", *[""] * 5, "D"], [""] * 11, ["C", "", *["1"] * 8, ""]])
    cells = lambda row, n: "".join(f'<c r="{chr(65 + i)}{n}" t="inlineStr"><is><t>{v}</t></is></c>' if not isinstance(v, float) else f'<c r="{chr(65 + i)}{n}"><v>{v}</v></c>' for i, v in enumerate(row))
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>' + "".join(f"<row>{cells(r, n)}</row>" for n, r in enumerate([header, ["F", "z", 0.0, 1.0, *[0.0] * 6, "E"]], 1)) + "</sheetData></worksheet>"
    with zipfile.ZipFile(tmp_path / "t.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData/></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", sheet)
    got = {(r.collection, r.row): (r.text, list(r["values"]), r.problem, r.bad_cells) for r in quotations.read_sheets(spark, str(tmp_path)).collect()}
    assert got[("s", 1)] == ("a b", ["social"], None, 1) and got[("C", 3)][2] == "empty_sentence" and got[("F", 1)] == ("z", ["economic"], None, 0) and len(got) == 3


def test_packages(spark, tmp_path):
    (tmp_path / "p1").mkdir()
    (tmp_path / "p2").mkdir()
    record = {k: v for k, v in GOOD.items() if v is not None}
    (tmp_path / "p1" / "my-annotations.json").write_text(json.dumps({"documents": [{"document_id": "d1", "records": [record, record, {**record, "sentence_id": 2, "values": ["beauty"]}]}, {"records": [record]}]}))
    (tmp_path / "p1" / "my-annotations.csv").write_text("ignored\n")
    with open(tmp_path / "p2" / "my-annotations.csv", "w", newline="", encoding="utf-8-sig") as f:
        w = csv.writer(f)
        w.writerow(["document_id", "sentence_id", "page", "sentence", "curated_sentence", "values", "tokens", "entities", "ner_tags", "schema_version"])
        w.writerow(["d3", 1, 1, "Old “x”.", "", "", '["Old","x"]', "[]", '["B-Age","O"]', "1.0"])
    examples = packages.load_examples(packages.read_packages(spark, str(tmp_path))).collect()
    got = sorted((r.example_id, r.problem or "", tuple(r["values"] or [])) for r in examples)
    assert got == [("package:d1:1", "", ("age",)), ("package:d1:1", "duplicate_record_id", ("age",)), ("package:d1:2", "unknown_value", ("age",)), ("package:d3:1", "", ("age",)), ("package:p1:1", "", ("age",))] or [g[:2] for g in got] == [("package:d1:1", ""), ("package:d1:1", "duplicate_record_id"), ("package:d1:2", "unknown_value"), ("package:d3:1", ""), ("package:p1:1", "")]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", "train"), ("b", "test")], "id string, part string")
    with pytest.raises(ValueError):
        sinks.write_split(rows, str(tmp_path / "no"), published=rows.filter("id = 'a'"))
    assert not (tmp_path / "no").exists()
    sinks.write_split(rows, str(tmp_path / "yes"), published=rows)
    assert spark.read.json(str(tmp_path / "yes")).count() == 2
    record = spark.createDataFrame([{**GOOD, "sentence_id": n} for n in (2, 1)], contract.RECORD).withColumn("document_id", F.lit("d"))
    package = json.loads(sinks.nested(record).first().package)
    assert [r["sentence_id"] for r in package["records"]] == [1, 2] and package["record_count"] == 2
    assert json.loads(sinks.flat(record).first()["values"]) == ["age"]
    files = {"b": b"2", "a": b"1"}
    assert [r["path"] for r in sinks.manifest(files)["resources"]] == ["a", "b"]


def test_stream(spark, tmp_path):
    import datetime

    rows = [(i, datetime.datetime(2024, 1, 1 + i % 2), i % 3, "click", 1.0, "") for i in range(6)]
    spark.createDataFrame(rows, audit.EVENTS).write.parquet(str(tmp_path / "in"))
    batch = audit.window_counts(spark.read.parquet(str(tmp_path / "in")), "1 day").collect()
    stream = audit.start(audit.window_counts(audit.read_events(spark, str(tmp_path / "in")), "1 day"), "counts", str(tmp_path / "cp"))
    stream.awaitTermination(60)
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, batch))
    assert {r.user_id: r.ts.day for r in audit.latest(spark.read.parquet(str(tmp_path / "in"))).collect()} == {0: 2, 1: 2, 2: 2}


def test_package_issues(spark):
    codes = {
        "good": set(),
        "absent": {"missing_package_file"},
        "locked": {"unreadable_package_file"},
        "broken": {"invalid_json"},
        "schema": {"invalid_package_metadata"},
        "foreign": {"metadata_document_mismatch"},
        "object": {"invalid_annotations_document", "annotation_count_mismatch", "review_annotation_mismatch"},
        "path": {"annotation_resource_mismatch"},
        "review": {"review_document_mismatch"},
        "state": {"invalid_review_state"},
        "gone": {"source_missing"},
        "changed": {"source_not_current"},
        "count": {"annotation_count_mismatch"},
        "twice": {"duplicate_sentence_id"},
        "stale": {"stale_sentence_review"},
        "open": {"sentence_review_incomplete"},
        "unmatched": {"review_annotation_mismatch"},
    }
    source = {"gone": "missing", "changed": "changed"}
    size = {"count": 5, "twice": 2}
    metadata = spark.createDataFrame([(d, size.get(d, 1), source.get(d, "current")) for d in codes], "document_id string, record_count long, source_state string")
    records = spark.createDataFrame([(d, 1, "h") for d in [*codes, "twice"] if d != "object"], "document_id string, sentence_id long, record_sha256 string")
    status = {"open": "pending"}
    reviews = [(d, 1, "old" if d == "stale" else "h", status.get(d, "approved")) for d in codes if d not in ("state", "unmatched")]
    reviews = spark.createDataFrame(reviews, "document_id string, sentence_id long, record_sha256 string, status string")
    states = {("locked", "annotations"): "unreadable", ("broken", "package_metadata"): "invalid_json", ("schema", "package_metadata"): "invalid", ("object", "annotations"): "invalid", ("state", "review_state"): "invalid"}
    named = {("foreign", "package_metadata"): "x", ("review", "review_state"): "x"}
    files = [(d, f, states.get((d, f), "ok"), None if f == "annotations" else named.get((d, f), d), "other.json" if d == "path" else "annotations.json") for d in codes for f in registry.PACKAGE_FILES if (d, f) != ("absent", "package_metadata")]
    files = spark.createDataFrame(files, "document_id string, file string, state string, named_document string, resource_path string")
    got = {d: set() for d in codes}
    for r in registry.package_issues(metadata, records, reviews, files).collect():
        got[r.document_id].add(r.code)
    assert got == codes
