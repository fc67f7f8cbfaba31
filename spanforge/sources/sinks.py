"""Writers: JSON lines by part, flat CSV with JSON lists, nested packages with a manifest."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.sources.ordinals import order_differences

LISTS = ["values", "tokens", "entities", "ner_tags"]
COLUMNS = ["document_id", "sentence_id", "page", "sentence", "curated_sentence", "values", "tokens", "entities", "ner_tags", "schema_version"]


def write_split(rows: DataFrame, folder: str, published: DataFrame | None = None, key: str = "id") -> None:
    """JSON lines by part; nothing is written if a published split differs from the rows'.

    Where both have ord, the rows' places count too.
    """
    if published is not None:
        if "ord" in rows.columns and "ord" in published.columns:
            same = order_differences(published, rows, [key], "part").isEmpty()
        else:
            from spanforge.operators.registry import same_split

            same = same_split(published.select(key, "part"), rows.select(key, "part"))
        if not same:
            raise ValueError("the published split differs from the one at hand")
    rows.write.partitionBy("part").mode("errorifexists").json(folder)


def flat(records: DataFrame) -> DataFrame:
    """Records with list columns as JSON, in a fixed order of columns."""
    return records.select(*[F.to_json(c).alias(c) if c in LISTS else F.col(c) for c in COLUMNS])


def write_flat(records: DataFrame, folder: str) -> None:
    flat(records).write.option("header", "true").option("escape", '"').option("lineSep", "\n").csv(folder)


def nested(records: DataFrame) -> DataFrame:
    """(document_id, package): one JSON text for each document, its records in order of page and number."""
    fields = [c for c in COLUMNS if c not in ("document_id", "page", "sentence_id")]
    each = F.array_sort(F.collect_list(F.struct("page", "sentence_id", *fields)))
    grouped = records.groupBy("document_id").agg(each.alias("records"))
    return grouped.select("document_id", F.to_json(F.struct("document_id", F.size("records").alias("record_count"), "records")).alias("package"))


def write_jsonl(df: DataFrame, folder: str) -> None:
    df.write.json(folder)


def canonical(value) -> bytes:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def manifest(files: dict[str, bytes]) -> dict:
    """Names, sizes and checksums of a package's files, in order."""
    return {"resources": [{"path": n, "bytes": len(files[n]), "sha256": hashlib.sha256(files[n]).hexdigest()} for n in sorted(files)]}


def file_list(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, hash) of a written folder's data files, read back from the store."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", folder.rstrip("/").rsplit("/", 1)[-1] + "/"), -1)
    return found.filter(~F.element_at(F.split("path", "/"), -1).rlike("^[_.]")).select(name.alias("path"), F.col("length").alias("bytes"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("hash"))


def write_release(records: DataFrame, documents: DataFrame, issues: DataFrame, folder: str, ids: list[str] | None = None) -> DataFrame:
    """Writes a release of chosen documents and returns its files with sizes and hashes.

    documents: document_id, source_path, checksum; records: approved ones, with
    COLUMNS; issues: (document_id, code) of errors.  Written are annotations
    (nested JSON), table (flat CSV), build-log (membership with checksums of
    sources and annotations, and documents left out) and datapackage (the list of
    files), each a folder of parts.  An empty, repeated or unknown choice, no
    documents, or a chosen document with an issue is an error before anything is written.
    """
    from spanforge.operators.registry import selected

    spark = records.sparkSession
    chosen = selected(documents, ids)
    if chosen.isEmpty():
        raise ValueError("no documents to release")
    wrong = issues.join(chosen, "document_id", "left_semi").groupBy("code").agg(F.countDistinct("document_id").alias("n")).orderBy("code").collect()  # one row for each code
    if wrong:
        raise ValueError("documents are not ready: " + ", ".join(f"{r['code']} ({r['n']})" for r in wrong))
    kept = records.join(chosen, "document_id", "left_semi")
    packages = chosen.select("document_id").join(nested(kept), "document_id", "left")
    packages.write.mode("errorifexists").json(f"{folder}/annotations")
    write_flat(kept, f"{folder}/table")
    digest = F.sha2(F.coalesce("package", F.lit("")), 256)
    log = documents.select("document_id", "source_path", F.col("checksum").alias("source_checksum")).join(packages.select("document_id", digest.alias("annotations_checksum")), "document_id", "left")
    log.withColumn("released", F.col("annotations_checksum").isNotNull()).write.json(f"{folder}/build-log")
    files = file_list(spark, folder)
    files.write.json(f"{folder}/datapackage")
    return spark.read.schema(files.schema).json(f"{folder}/datapackage")


def validation_text(issues: DataFrame, key: str = "document_id") -> DataFrame:
    """(document_id, report): a document's issues as readable lines, with their places and what they mean.

    issues: document_id, code, and path if there is one; lines are in order of path and code.
    """
    from spanforge.operators.contract import message

    place = F.col("path") if "path" in issues.columns else F.lit("$")
    line = F.concat_ws(" ", F.lit("-"), "code", F.concat(F.coalesce(place, F.lit("$")), F.lit(":")), message(F.col("code")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(place.alias("path"), "code", line.alias("line")))), lambda x: F.rtrim(x.getField("line")))
    return issues.groupBy(key).agg(F.concat_ws("\n", F.col(key), lines).alias("report"))
