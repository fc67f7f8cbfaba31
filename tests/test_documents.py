"""Word-processor files, OCR tables and edited CSV files."""

import csv
import zipfile

import pytest

from spanforge.sources import documents


def test_docx(spark, tmp_path):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    run = lambda text, props="": f'<w:r><w:rPr>{props}</w:rPr><w:t xml:space="preserve">{text}</w:t></w:r>'
    yellow, red = '<w:highlight w:val="yellow"/>', '<w:color w:val="ff0000"/>'
    body = f"<w:p>{run('The ')}{run('old chur', yellow)}{run('ch, ')}{run('fine', red)}</w:p><w:p><w:r><w:br w:type=\"page\"/></w:r>{run('Next.')}</w:p><w:p/>"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
    (tmp_path / "b.docx").write_bytes(b"no zip")
    runs = documents.read_runs(spark, str(tmp_path))
    assert [r.problem for r in runs.filter("problem is not null").collect()] == ["BadZipFile"]
    got = documents.draft_records(runs).orderBy("paragraph").collect()
    assert [(r.sentence, r.page, r.tokens, r.ner_tags) for r in got] == [
        ("The old church, fine", 1, ["The", "old", "church", ",", "fine"], ["O", "B-#FFFF00", "I-#FFFF00", "O", "B-#FF0000"]),
        ("Next.", 2, ["Next", "."], ["O", "O"]),
    ]
    assert [(e.start, e.end, e.text, e.color) for e in got[0].entities] == [(4, 14, "old church", "#FFFF00"), (16, 20, "fine", "#FF0000")]


def test_ocr(spark):
    lines = spark.createDataFrame([("level\tpage",), ("5\t1\t1\t1\t1\t1\t10\t20\t30\t10\t90\tWord",), ("5\t1\t1\t1\t1\t2\t50\t20\t30\t10\t-1\tx",), ("4\t1\t1\t1\t1\t0\t0\t0\t0\t0\t-1\t",)], "value string")
    got = documents.ocr_words(lines, 2.0).collect()
    assert [(r.text, r.x0, r.y0, r.x1, r.y1) for r in got] == [("Word", 5.0, 10.0, 20.0, 15.0)]
    assert documents.mean_confidence(documents.ocr_words(lines)).first().confidence == 90.0


def test_edited(spark, tmp_path):
    head = documents.REQUIRED
    with open(tmp_path / "e.csv", "w", newline="") as f:
        csv.writer(f).writerows([head, ["d", 1, 1, "s", '["age"]', '["a"]', "[]", '["O"]'], ["d", 1, "x", "s", "{broken", "[]", "", "[]"]])
    rows = documents.read_edited(spark, str(tmp_path / "e.csv"))
    got = [set(r.problems) for r in rows.collect()]
    assert {"duplicate_sentence"} in got and {"duplicate_sentence", "bad_json:values", "bad_number:page"} in got
    with pytest.raises(ValueError):
        documents.compile_edited(rows, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()
