"""Annotation packages (JSON or flat CSV), release files, people and citation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.functions.text import effective_text
from spanforge.functions.vocabulary import canonical_tags, normalise_value, tag_value
from spanforge.operators.contract import ENTITY, ISSUE, checked, issue, message
from spanforge.operators.structure import is_json, json_fault
from spanforge.sources.ordinals import numbered

PACKAGE = f"documents array<struct<document_id:string,records:array<struct<sentence_id:int,page:int,sentence:string,curated_sentence:string,tokens:array<string>,values:array<string>,entities:array<{ENTITY}>,ner_tags:array<string>,schema_version:string>>>>"
LISTS = {"values": "array<string>", "tokens": "array<string>", "entities": f"array<{ENTITY}>", "ner_tags": "array<string>"}
FIELDS = ["document_id", "sentence_id", "page", "sentence", "curated_sentence", "tokens", "values", "entities", "ner_tags", "schema_version", "path", "ord"]


def package_files(spark: SparkSession, folder: str, name: str = "annotations") -> DataFrame:
    """(directory, path): one file for each directory below a folder, JSON before CSV."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{name}.{{json,csv}}").load(folder).select("path")
    directory = F.regexp_replace("path", "/[^/]*$", "")
    return found.groupBy(directory.alias("directory")).agg(F.min_by("path", F.struct(F.col("path").endswith(".csv").alias("csv"), F.col("path"))).alias("path"))


def read_package_json(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Records of nested packages; a document without an id takes the name of its folder."""
    raw = spark.read.option("wholetext", "true").text(paths).withColumn("path", F.input_file_name())
    documents = raw.select("path", F.from_json("value", PACKAGE).alias("p")).select("path", F.posexplode("p.documents").alias("di", "d"))
    each = documents.select("path", "di", "d.document_id", F.posexplode("d.records").alias("ri", "r"))
    folder = F.element_at(F.split("path", "/"), -2)
    return each.select(F.coalesce("document_id", folder).alias("document_id"), "r.*", "path", (F.col("di") * F.lit(1 << 31) + F.col("ri")).alias("ord")).select(*FIELDS)


def read_package_csv(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Records of flat packages: list columns hold JSON, blank ones are empty lists."""
    raw = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').option("encoding", "UTF-8").csv(paths)
    raw = numbered(raw)
    first = raw.columns[0]
    raw = raw.withColumnRenamed(first, first.lstrip("﻿"))
    lists = {c: F.coalesce(F.from_json(F.when(F.trim(c) != "", F.col(c)), kind), F.array().cast(kind)) for c, kind in LISTS.items()}
    numbers = {c: F.col(c).try_cast("int") for c in ("sentence_id", "page")}
    out = raw.withColumns({**lists, **numbers})
    for c in ("curated_sentence", "schema_version"):
        out = out if c in out.columns else out.withColumn(c, F.lit(None).cast("string"))
    return out.select(*FIELDS)


def read_packages(spark: SparkSession, folder: str, name: str = "annotations") -> DataFrame:
    paths = [r["path"] for r in package_files(spark, folder, name).collect()]  # one for each directory
    parts = [reader(spark, some) for reader, some in ((read_package_json, [p for p in paths if p.endswith(".json")]), (read_package_csv, [p for p in paths if p.endswith(".csv")])) if some]
    if not parts:
        raise FileNotFoundError(folder)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def load_examples(records: DataFrame) -> DataFrame:
    """Records as examples: example_id, text, tokens, tags, values, document, problem.

    Of records with one id the first counts (by path, document, place), even if it
    is then found wrong.  problem is duplicate_record_id, unknown_bio_tag,
    tokens_tags_length_mismatch, unknown_value, or null; values are the labels
    and those of the tags.  Examples with an empty text only serve as sequences.
    """
    example = F.concat_ws(":", F.lit("package"), "document_id", "sentence_id")
    first = Window.partitionBy("example_id").orderBy("path", "document_id", "ord")
    rows = records.withColumn("example_id", example).withColumn("_n", F.row_number().over(first))
    tags = canonical_tags(F.coalesce("ner_tags", F.array()))
    rows = rows.withColumn("tags", tags)
    names = F.transform(F.coalesce("values", F.array().cast("array<string>")), normalise_value)
    tagged = F.filter(F.transform("tags", tag_value), lambda v: v.isNotNull())
    problem = (
        F.when(F.col("_n") > 1, "duplicate_record_id")
        .when(F.col("tags").isNull(), "unknown_bio_tag")
        .when((F.coalesce(F.size("tokens"), F.lit(0)) <= 0) | (F.size("tokens") != F.size("tags")), "tokens_tags_length_mismatch")
        .when(F.exists(names, lambda v: v.isNull()), "unknown_value")
    )
    values = F.array_sort(F.array_distinct(F.concat(names, tagged)))
    return rows.select("example_id", effective_text(F.col("curated_sentence"), F.col("sentence")).alias("text"), "tokens", "tags", values.alias("values"), F.col("document_id").alias("document"), "path", "ord", problem.alias("problem"))


def load_report(examples: DataFrame) -> DataFrame:
    """(reason, n) of all skipped rows."""
    return examples.filter("problem is not null").groupBy(F.col("problem").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def read_split(spark: SparkSession, folder: str) -> DataFrame:
    """Released JSON lines with the part from the file's name and the line's place."""
    rows = numbered(spark.read.json(f"{folder}/*.jsonl"), "path", "ord")
    return rows.withColumn("part", F.regexp_extract("path", r"([^/]+)\.jsonl$", 1)).drop("path")


def read_people(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("header", "true").csv(path)
    roles = F.filter(F.transform(F.split(F.coalesce("roles", F.lit("")), ";"), lambda r: F.trim(r)), lambda r: r != "")
    active = F.lower(F.trim(F.coalesce("active_curator", F.lit("")))).isin("true", "yes", "1", "y")
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in ("email", "orcid", "affiliation")}
    return rows.withColumns({"roles": roles, "active_curator": active, **text})


def read_citations(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("header", "true").csv(path)
    creators = F.filter(F.transform(F.split(F.coalesce("creators", F.lit("")), ";"), lambda c: F.trim(c)), lambda c: c != "")
    undated = F.lower(F.trim(F.coalesce("undated", F.lit("")))).isin("true", "yes", "1", "y")
    return rows.withColumns({"creators": creators, "issued_year": F.col("issued_year").try_cast("int"), "undated": undated})


def read_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, fault, array, i, record): elements of JSON arrays, parsed, with their place.

    fault: (position, line, column) where a text stops being JSON, all 0 if it is no
    UTF-8; array: whether it is a list; files without elements have one row without
    i.  Records that can be read as JSON but not parsed here (a repeated key, NaN)
    are null.
    """
    content = F.col("content")
    found, _ = existing(spark, paths)
    raw = spark.read.format("binaryFile").load(paths).select("path", F.is_valid_utf8(content.cast("string")).alias("utf8"), content.cast("string").alias("value"))
    # the reader leaves out files without a byte
    empty = spark.createDataFrame([(path, True, "") for path, size in found if not size], raw.schema)
    return parsed_records(raw.unionByName(empty))


def parsed_records(raw: DataFrame) -> DataFrame:
    """The rows of read_records for (path, utf8, value) and other columns, which stay."""
    value = F.col("value")
    good = raw.withColumn("whole", F.when(F.col("utf8") & is_json(value), F.try_parse_json(value)))
    nowhere = F.struct(*[F.lit(0).alias(x) for x in ("position", "line", "column")])
    faults = F.when(~F.col("utf8"), nowhere).when(F.col("whole").isNull(), json_fault(value))
    apart = F.when(F.col("whole").isNull() & F.col("fault").isNull(), F.transform(F.from_json(value, "array<string>"), F.try_parse_json))
    elements = F.coalesce(F.try_variant_get("whole", "$", "array<variant>"), apart)
    items = good.withColumn("fault", faults).withColumn("elements", elements).withColumn("array", F.col("elements").isNotNull())
    return items.select("*", F.posexplode_outer("elements").alias("i", "record")).drop("elements", "whole", "value", "utf8")


def findings(records: DataFrame) -> DataFrame:
    """(path, i, n, code, place) of every issue in the rows of read_records, numbered in each record; those of whole files without i."""
    whole = F.when(F.col("fault").isNotNull(), F.array(issue("invalid_json", "$"))).when(~F.col("array"), F.array(issue("invalid_document", "$")))
    found = F.coalesce(whole, F.when(F.col("i").isNotNull(), checked(F.col("record"))), F.array().cast(ISSUE))
    each = records.withColumn("_found", F.explode(F.filter(F.array(found), lambda x: F.size(x) > 0))).drop("record")
    return each.select("*", F.posexplode("_found").alias("n", "_x")).select("*", F.col("_x.code").alias("code"), F.col("_x.path").alias("place")).drop("_found", "_x")


def validated(records: DataFrame, *keys: str) -> DataFrame:
    """(path, state, records, issues, line, column) of each file of read_records: valid, invalid or parse_error."""
    keys = keys or ("path",)
    found = F.when(F.col("fault").isNotNull() | ~F.col("array"), 0).when(F.col("i").isNotNull(), F.size(checked(F.col("record")))).otherwise(0)
    sums = (
        records.withColumn("_n", found)
        .groupBy(*keys)
        .agg(F.max("fault").alias("fault"), F.bool_and("array").alias("array"), F.count("i").alias("records"), F.sum("_n").cast("long").alias("issues"))
    )
    issues = F.when(~F.col("array") & F.col("fault").isNull(), 1).otherwise(F.col("issues"))
    state = F.when(F.col("fault").isNotNull(), "parse_error").when(issues > 0, "invalid").otherwise("valid")
    return sums.select(*keys, state.alias("state"), "records", issues.alias("issues"), "fault.line", "fault.column")


def existing(spark: SparkSession, patterns: list[str]) -> tuple[list[tuple[str, int]], list[str]]:
    """The files of patterns with their sizes, and the patterns without one; the store is asked, no file is read."""
    found, none = [], []
    for pattern in patterns:
        path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
        got = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
        names = [(x.getPath().toString(), x.getLen()) for x in got] if got is not None else []
        found, none = [*found, *names], none if names else [*none, pattern]
    return found, none


def validate(spark: SparkSession, patterns: list[str], most: int = 20) -> tuple[DataFrame, int]:
    """(text) lines on all files of some patterns, in order, and the exit code.

    Each file has a line with its state, and up to `most` lines on its issues.  A
    pattern without a file has a line too and counts as an input that can't be read.
    """
    found, none = existing(spark, patterns)
    absent = spark.createDataFrame([(x, f"INPUT ERROR: {x}: no such file") for x in none], "path string, text string")
    if not found:
        return absent.select("text"), 2 if none else 1
    records = read_records(spark, [path for path, _ in found])
    report = validated(records)
    sums = F.concat_ws(" ", F.concat("path", F.lit(":")), "records", F.lit("records,"), "issues", F.lit("issues"))
    where = F.concat(F.lit("PARSE ERROR: "), "path", F.lit(": line "), "line", F.lit(", column "), "column")
    heads = report.select("path", F.when(F.col("state") == "parse_error", where).otherwise(F.concat(F.upper("state"), F.lit(": "), sums)).alias("text"))
    line = F.concat_ws(" ", F.lit("-"), "code", F.concat("place", F.lit(":")), message(F.col("code")))
    one_file = Window.partitionBy("path").orderBy("i", "n")
    listed = findings(records).filter("fault is null").withColumn("rank", F.row_number().over(one_file)).filter(F.col("rank") <= most)
    texts = heads.withColumn("rank", F.lit(0)).unionByName(listed.select("path", line.alias("text"), "rank")).unionByName(absent.withColumn("rank", F.lit(0)))
    return texts.orderBy("path", "rank").select("text"), max(exit_code(report), 2 if none else 0)


def exit_code(report: DataFrame) -> int:
    """0 if all files of validated are valid, 2 if one can't be parsed, else 1; no files are an error too (1)."""
    r = report.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("state") == "parse_error").alias("broken"), F.count_if(F.col("state") != "valid").alias("bad")).first()
    return 2 if r["broken"] else int(r["bad"] > 0 or not r["n"])


def source_files(spark: SparkSession, folder: str, deep: bool = True) -> DataFrame:
    """(source_path, checksum) of documents below a folder, or right in it."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(deep).lower()).option("pathGlobFilter", "*.{pdf,docx,PDF,DOCX}").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    root = folder.rstrip("/") + "/"
    return found.filter(~name.startswith("~$")).select(F.element_at(F.split("path", root), -1).alias("source_path"), F.sha2("content", 256).alias("checksum"))
