"""Records in JSON: faults against a decoder, shapes by path, states of files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from spanforge.operators import contract
from spanforge.operators.structure import is_json, json_fault
from spanforge.sources import packages, sinks

GOOD = {"sentence_id": 1, "page": 1, "sentence": "Old town", "tokens": ["Old", "town"], "values": ["age"], "entities": [{"start": 0, "end": 3, "text": "Old", "label": "age"}], "ner_tags": ["B-age", "O"]}


def record_files(spark, folder):
    import spanforge.plans.queries  # noqa: F401, PLC0415
    from spanforge.plans.structures import record_files

    return record_files(spark, folder)


def decoder_fault(text):
    try:
        json.loads(text)
    except json.JSONDecodeError as e:
        return e.pos, e.lineno, e.colno
    return None


def test_faults_equal_a_decoders(spark):
    rng = random.Random(4)
    base = ['[{"sentence_id": 1, "page": 2.5e3, "tokens": ["a", "b\\n\\u00e9"], "x": null,\n "y": {"z": [true, false, -0.1]}}]', '{"a":[[],{}],"b":"\\"q\\\\"}', " [1 , 2\n,3 ] ", '"é👍\\ud83d\\ude00"', "NaN", "-Infinity"]
    docs = ["", "  ", "[1,]", '[{"sentence_id": 1,}]', '{"a":1,', "[", "{", '{"a"', '{"a":', '"ab\\', '"ab\\u12', '"a\\u1234', '"\\q"', "[1] x", "1],[2", '"a\tb"', '{"a" 1}', "{,}", "[,]", "01", "-", "tru", "truex", "﻿[1]", '{"a":1}}', "[1}", "[" * 300 + "]" * 299, '"' + "\\n" * 5000]
    while len(docs) < 3000:
        s = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            i, kind = rng.randrange(len(s) + 1), rng.randrange(4)
            s[i : i + (kind == 1)] = [] if kind == 1 else [rng.choice('[]{}:,"\\u0 \n\t1-e.tnx\x01é')] if kind < 3 else s[i:i]
            s = s[:i] if kind == 3 else s
        docs.append("".join(s))
    df = spark.createDataFrame(list(enumerate(docs)), "i int, j string").repartition(4)
    got = {r.i: (tuple(r.f) if r.f else None, r.ok) for r in df.select("i", json_fault(F.col("j")).alias("f"), is_json(F.col("j")).alias("ok")).collect()}
    for i, text in enumerate(docs):
        assert got[i][0] == decoder_fault(text), text
        assert got[i][1] == (got[i][0] is None) or "NaN" in text or "Infinity" in text, text


def test_faults_of_a_table(spark):
    rows = record_files(spark, "/root/testdata/sf0.001")
    got = {r.doc_id: tuple(r.f) if r.f else None for r in rows.select("doc_id", json_fault(F.col("value")).alias("f")).collect()}
    assert got == {r.doc_id: decoder_fault(r.value) for r in rows.collect()} and sum(f is not None for f in got.values()) > 30


@pytest.mark.parametrize(
    ("change", "paths"),
    [
        ({}, []),
        ({"entities": [{}]}, ["$.entities[0].start", "$.entities[0].end", "$.entities[0].text", "$.entities[0].label"]),
        ({"entities": [{**GOOD["entities"][0], "more": 1, "color": 3}, None, 7]}, ["$.entities[0].color", "$.entities[0].more", "$.entities[1]", "$.entities[2]"]),
        ({"tokens": ["a", None]}, ["$.tokens[1]"]),
        ({"tokens": [1]}, ["$.tokens[0]"]),
        ({"values": [None], "ner_tags": {}}, ["$.values[0]", "$.ner_tags"]),
        ({"mapping_provenance": {"zzz": 1}}, ["$.mapping_provenance.method", "$.mapping_provenance.status", "$.mapping_provenance.zzz"]),
        ({"mapping_provenance": None, "curated_sentence": None}, []),
        ({"schema_version": None, "page": 1.0, "sentence_id": True}, ["$.sentence_id", "$.page", "$.schema_version"]),
        ({"sentence_id": 10**25}, []),
        ({"odd key": 1, "a.b": 2}, ["$.a.b", "$.odd key"]),
    ],
)
def test_shape_at_any_depth(spark, change, paths):
    df = spark.createDataFrame([(json.dumps({**GOOD, **change}),)], "j string")
    got = df.select(contract.structural(F.col("j"))).first()[0]
    assert [i.path for i in got] == paths and {i.code for i in got} <= {"invalid_type"}


def states(spark, folder, files):
    for name, content in files.items():
        (folder / name).write_bytes(content if isinstance(content, bytes) else content.encode())
    report = packages.validated(packages.read_records(spark, [str(folder / n) for n in files]))
    return {r.path.rsplit("/", 1)[-1]: (r.state, r.records, r.issues, r.line, r.column) for r in report.collect()}


def test_states_of_files(spark, tmp_path):
    nonsense = {**GOOD, "entities": [{**GOOD["entities"][0], "label": "nonsense"}]}
    files = {
        "good.json": json.dumps([GOOD, GOOD]),
        "empty.json": "[]",
        "label.json": json.dumps([GOOD, nonsense]),
        "object.json": json.dumps(GOOD),
        "text.json": '["{}", null]',
        "cut.json": '[\n {"sentence_id": 1,}]',
        "extra.json": "[]\n]",
        "blank.json": "",
        "latin.json": "[\"é\"]".encode("latin-1"),
        "twice.json": '[{"sentence_id": 1, "sentence_id": 2}]',
    }
    assert states(spark, tmp_path, files) == {
        "good.json": ("valid", 2, 0, None, None),
        "empty.json": ("valid", 0, 0, None, None),
        "label.json": ("invalid", 2, 2, None, None),
        "object.json": ("invalid", 0, 1, None, None),
        "text.json": ("invalid", 2, 2, None, None),
        "cut.json": ("parse_error", 0, 0, 2, 19),
        "extra.json": ("parse_error", 0, 0, 2, 1),
        "blank.json": ("parse_error", 0, 0, 1, 1),
        "latin.json": ("parse_error", 0, 0, 0, 0),
        "twice.json": ("invalid", 1, 1, None, None),
    }


def test_validate(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([GOOD]))
    (tmp_path / "b.json").write_text(json.dumps([{**GOOD, "values": ["invented"]}] * 3))
    (tmp_path / "c.json").write_text('[{"sentence_id": 1,}]')

    def run(*names, most=2):
        lines, code = packages.validate(spark, [str(tmp_path / n) for n in names], most)
        return [r.text.replace(str(tmp_path), "").replace("file:/", "/") for r in lines.collect()], code

    lines, code = run("a.json")
    assert code == 0 and len(lines) == 1 and lines[0].startswith("VALID: ") and lines[0].endswith("1 records, 0 issues")
    lines, code = run("[ab].json")
    assert code == 1 and len(lines) == 4 and lines[1].startswith("INVALID: ") and lines[2].startswith("- unknown_label $.values[0]: ")
    lines, code = run("*.json")
    assert code == 2 and "line 1, column 19" in lines[-1] and lines[-1].startswith("PARSE ERROR: ")
    lines, code = run("none.json")
    assert code == 2 and lines[0].startswith("INPUT ERROR: ")
    lines, code = run("a.json", "none.json")
    assert code == 2 and len(lines) == 2


def test_report_text(spark):
    issues = spark.createDataFrame([("d", "unknown_label", "$.values[1]"), ("d", "invalid_color", "$.entities[0].color"), ("e", "no_such_code", None)], "document_id string, code string, path string")
    got = {r.document_id: r.report.split("\n") for r in sinks.validation_text(issues).collect()}
    assert got["d"][0] == "d" and [x.split(":")[0] for x in got["d"][1:]] == ["- invalid_color $.entities[0].color", "- unknown_label $.values[1]"]
    assert got["e"] == ["e", "- no_such_code $:"]


def test_command_line(spark, tmp_path, capsys):
    from spanforge.__main__ import main

    folder = tmp_path / "p"
    folder.mkdir()
    (tmp_path / "bad.json").write_text(json.dumps([{**GOOD, "values": []}]))
    assert main(["validate", str(tmp_path / "bad.json"), "--max-issues", "1"], spark) == 1
    out = capsys.readouterr().out.splitlines()
    assert len(out) == 2 and out[0].startswith("INVALID: ") and out[1].startswith("- value_entity_mismatch $.values: ")
    assert main(["validate", str(tmp_path / "none*.json")], spark) == 2
    records = [{**GOOD, "sentence_id": i, "sentence": f"Old town {i % 12}"} for i in range(15)] + [{**GOOD, "sentence_id": 99, "values": ["beauty"]}]
    (folder / "annotations.json").write_text(json.dumps({"documents": [{"document_id": "d", "records": records}]}))
    capsys.readouterr()
    assert main(["inspect", str(tmp_path)], spark) == 0
    found = {(x["section"], x.get("part"), x["name"]): x["n"] for x in map(json.loads, capsys.readouterr().out.splitlines())}
    assert found["load", None, "examples"] == 12 and found["load", None, "merged_duplicates"] == 3 and found["load", None, "skipped: unknown_value"] == 1
    assert sum(found["split", p, "examples"] for p in ("train", "validation", "test")) == 12 and found["split", "train", "value: age"] > 0
