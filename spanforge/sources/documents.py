"""Word-processor files, OCR tables and edited CSV files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions.text import DOCX_HIGHLIGHTS
from spanforge.operators import layout
from spanforge.sources.packages import LISTS

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def run_color(run) -> str | None:
    """A run's highlight, else its shading, else its text colour; plain black and white count as none."""
    p = run.find(f"{W}rPr")
    if p is None:
        return None
    value = lambda tag, key: None if p.find(W + tag) is None else p.find(W + tag).get(W + key)
    named = DOCX_HIGHLIGHTS.get(value("highlight", "val") or "")
    for hex_ in (named, value("shd", "fill"), value("color", "val")):
        hex_ = (hex_ or "").lstrip("#").upper()
        if len(hex_) == 6 and hex_ not in ("000000", "FFFFFF"):
            return "#" + hex_
    return None


def paragraphs(raw: bytes) -> Iterator[tuple[int, int, list[tuple[str, str | None]]]]:
    """(number, page, runs) of the paragraphs of a .docx file that have text; pages follow the breaks in it."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    page, number = 1, 0
    for p in body.iter(f"{W}p"):
        runs, start = [], page
        for r in p.iter(f"{W}r"):
            for child in r:
                if child.tag == f"{W}lastRenderedPageBreak" or child.tag == f"{W}br" and child.get(f"{W}type") == "page":
                    page += 1
                    start = page if not any(t.strip() for t, _ in runs) else start
                elif child.tag == f"{W}t" and child.text:
                    runs.append((child.text, run_color(r)))
                elif child.tag in (f"{W}tab", f"{W}br"):
                    runs.append((" ", None))
        if any(t.strip() for t, _ in runs):
            number += 1
            yield number, start, runs


def properties(raw: bytes) -> tuple[str | None, list[str]]:
    """Title and creators that a .docx file states itself; nothing if it can't be read."""
    dc = "{http://purl.org/dc/elements/1.1/}"
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            core = ElementTree.fromstring(z.read("docProps/core.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None, []
    title, creator = ((core.findtext(dc + name) or "").strip() for name in ("title", "creator"))
    return title or None, [creator] if creator else []


def read_properties(spark: SparkSession, folder: str) -> DataFrame:
    """(path, title, creators) of all .docx files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.docx").load(folder).select("path", "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [properties(bytes(raw)) for raw in batch["content"]]
            yield pd.DataFrame({"path": batch["path"], "title": [t for t, _ in found], "creators": [c for _, c in found]})

    return files.mapInPandas(parse, "path string, title string, creators array<string>")


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """(path, paragraph, page, run, text, color, rs, re, problem): coloured runs of all .docx files below a folder.

    A file that cannot be read is one row with a problem; others go on.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.docx").load(folder)
    found = found.filter(~F.element_at(F.split("path", "/"), -1).startswith("~$")).select("path", "content")
    schema = "path string, paragraph long, page long, run long, text string, color string, rs long, re long, problem string"

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, raw in zip(batch["path"], batch["content"], strict=True):
                out = []
                try:
                    for number, page, runs in paragraphs(bytes(raw)):
                        at = 0
                        for i, (text, color) in enumerate(runs):
                            out.append((path, number, page, i, text, color, at, at + len(text), None))
                            at += len(text)
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as error:
                    out = [(path, None, None, None, None, None, None, None, type(error).__name__)]
                yield pd.DataFrame(out, columns=[f.split()[0] for f in schema.split(", ")])

    return found.mapInPandas(parse, schema)


TOKEN = r"(?U)\w+|[^\w\s]"


def tokens_with_places(text: Column) -> Column:
    """Array of (token, ts, te): words and single signs with their characters."""

    def step(state: Column, t: Column) -> Column:
        at = F.call_function("locate", t, text, state.getField("next")) - 1
        one = F.struct(t.alias("token"), at.alias("ts"), (at + F.length(t)).alias("te"))
        return F.struct(F.concat(state.getField("all"), F.array(one)).alias("all"), (at + F.length(t) + 1).alias("next"))

    start = F.struct(F.array().cast("array<struct<token:string,ts:int,te:int>>").alias("all"), F.lit(1).alias("next"))
    return F.aggregate(F.regexp_extract_all(text, F.lit(TOKEN), 0), start, step, lambda s: s.getField("all"))


def draft_records(runs: DataFrame) -> DataFrame:
    """(path, paragraph, page, sentence, tokens, entities, ner_tags): one draft for each paragraph.

    A token has the colour that covers most of it; neighbouring tokens of one
    colour are an entity; tags carry the colour as their label.
    """
    key = ["path", "paragraph"]
    read = runs.filter("problem is null")
    texts = read.groupBy(*key).agg(F.min("page").alias("page"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "text"))), lambda r: r.getField("text")), "").alias("sentence"))
    each = texts.select(*key, "sentence", F.posexplode(tokens_with_places(F.col("sentence"))).alias("token", "t")).select(*key, "token", F.col("t.token").alias("text"), F.col("t.ts").alias("ts"), F.col("t.te").alias("te"))
    colored = each.join(layout.dominant_color(each, read, *key), [*key, "token"], "left").withColumnRenamed("token", "word")
    isles = layout.islands(colored, *key).select(*key, F.col("first").alias("entity"), "first", "last", "color")
    inside = colored.join(isles.drop("color"), key, "left").filter("word between first and last")
    spans = inside.groupBy(*key, "entity").agg(F.min("ts").alias("start"), F.max("te").alias("end"), F.first("color").alias("color"))
    entities = spans.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "color"))).alias("e"))
    order = F.array_sort(F.collect_list(F.struct("word", "text", "tag")))
    first = isles.select(*key, F.col("first").alias("word"), F.lit(True).alias("begins"))
    tagged = colored.join(first, [*key, "word"], "left").withColumn("tag", F.when(F.col("color").isNull(), "O").otherwise(F.concat(F.when(F.col("begins"), "B-").otherwise("I-"), "color")))
    rows = tagged.groupBy(*key).agg(order.alias("w"))
    out = texts.join(rows, key).join(entities, key, "left")
    made = F.transform(F.coalesce("e", F.array().cast("array<struct<start:int,end:int,color:string>>")), lambda e: F.struct(e.getField("start").alias("start"), e.getField("end").alias("end"), F.substr(F.col("sentence"), e.getField("start") + 1, e.getField("end") - e.getField("start")).alias("text"), F.lit(None).cast("string").alias("label"), e.getField("color").alias("color")))
    return out.select(*key, "page", "sentence", F.transform("w", lambda x: x.getField("text")).alias("tokens"), made.alias("entities"), F.transform("w", lambda x: x.getField("tag")).alias("ner_tags"))


def ocr_words(lines: DataFrame, scale: float = 1.0) -> DataFrame:
    """Words of OCR tables with tab-separated lines (twelve columns): level 5, with a confidence and text; places in page units."""
    f = F.col("_f")
    n = lambda i: F.get(f, F.lit(i)).try_cast("double")
    # a line is cut once: conditions on the parts are not moved below an explode, where each would cut it again
    cut = lines.select("*", F.explode(F.array(F.split("value", "\t", 12))).alias("_f"))
    words = cut.select(*[c for c in lines.columns if c != "value"], n(0).alias("level"), *[n(i).cast("int").alias(c) for i, c in ((1, "page"), (2, "block"), (3, "par"), (4, "line"), (5, "word"))], *[(n(i) / scale).alias(c) for i, c in ((6, "x0"), (7, "y0"))], ((n(6) + n(8)) / scale).alias("x1"), ((n(7) + n(9)) / scale).alias("y1"), n(10).alias("confidence"), F.trim(F.get(f, F.lit(11))).alias("text"))
    return words.filter((F.col("level") == 5) & (F.col("confidence") >= 0) & (F.col("text") != "")).drop("level")


def mean_confidence(words: DataFrame, *keys: str) -> DataFrame:
    """(keys, confidence, words): the mean, and how many words it is of."""
    return words.groupBy(*keys).agg(F.avg("confidence").alias("confidence"), F.count(F.lit(1)).alias("words"))


REQUIRED = ["document_id", "sentence_id", "page", "sentence", "values", "tokens", "entities", "ner_tags"]


def read_edited(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an edited flat CSV with problems: bad_json and bad_number by column, duplicate_sentence.

    A missing column is an error at once; whoever compiles should go on only if
    no row has a problem.
    """
    raw = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    missing = [c for c in REQUIRED if c not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    parsed = {f"_{c}": F.from_json(c, kind) for c, kind in LISTS.items()}
    numbers = {f"_{c}": F.col(c).try_cast("int") for c in ("sentence_id", "page")}
    from pyspark.sql import Window

    same = F.count(F.lit(1)).over(Window.partitionBy("document_id", "sentence_id"))
    rows = raw.withColumns({**parsed, **numbers, "_same": same})
    wrong = [F.when((F.trim(c) != "") & F.col(f"_{c}").isNull(), F.lit(f"bad_json:{c}")) for c in LISTS] + [F.when(F.col(f"_{c}").isNull(), F.lit(f"bad_number:{c}")) for c in ("sentence_id", "page")]
    problems = F.array_compact(F.array(*wrong, F.when(F.col("_same") > 1, F.lit("duplicate_sentence"))))
    lists = [F.coalesce(F.col(f"_{c}"), F.array().cast(kind)).alias(c) for c, kind in LISTS.items()]
    return rows.select("document_id", F.col("_sentence_id").alias("sentence_id"), F.col("_page").alias("page"), "sentence", *lists, problems.alias("problems"))


def compile_edited(rows: DataFrame, folder: str) -> None:
    """Writes edited rows as JSON lines, all or nothing."""
    bad = rows.filter(F.size("problems") > 0)
    if not bad.isEmpty():
        raise ValueError(str(bad.select("document_id", "sentence_id", "problems").limit(5).collect()))
    rows.drop("problems").write.json(folder)
