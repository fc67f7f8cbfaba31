"""Annotation-shaped views of the Parquet tables, in Spark and in DuckDB SQL.

The views use integer arithmetic and lengths only, so both engines agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions.vocabulary import VALUES
from spanforge.session import beside, dealt, table, together


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with gold and predicted label vectors and probabilities."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("collection"), F.col("lang").alias("document"), "n_chars", "text")
    i, n = F.col("doc_id"), F.col("n_chars")
    ks = F.array(*[F.lit(k).cast("long") for k in range(len(VALUES))])
    gold = F.transform(ks, lambda k: F.when((i * (2 * k + 3) + n) % 11 < 2, 1).otherwise(0))
    d = d.withColumn("gold", gold)
    noise = lambda k: (i * 37 + k * 101 + n * 7) % 10
    pred = F.transform(ks, lambda k: F.when(noise(k) < F.when(F.get("gold", k.cast("int")) == 1, 7).otherwise(1), 1).otherwise(0))
    prob = F.transform(ks, lambda k: ((i * 37 + k * 101 + n * 7) % 1000).cast("double") / 1000.0)
    return d.withColumns({"pred": pred, "prob": prob})


UNITS = """
vocab AS (SELECT unnest(range(8)) AS k, unnest(['social','economic','political','historic','aesthetical','scientific','age','ecological']) AS value),
units AS (SELECT doc_id, source AS collection, lang AS document, n_chars, k, value,
       CASE WHEN (doc_id * (2 * k + 3) + n_chars) % 11 < 2 THEN 1 ELSE 0 END AS g,
       ((doc_id * 37 + k * 101 + n_chars * 7) % 1000)::DOUBLE / 1000.0::DOUBLE AS prob,
       CASE WHEN (doc_id * 37 + k * 101 + n_chars * 7) % 10 < CASE WHEN (doc_id * (2 * k + 3) + n_chars) % 11 < 2 THEN 7 ELSE 1 END THEN 1 ELSE 0 END AS p
       FROM documents, vocab)
"""


def texts(spark: SparkSession, sf_dir: str, by_document: bool) -> DataFrame:
    """(doc_id, collection, text), dealt out evenly, or by document for steps that explode and join them."""
    rows = lambda s: table(s, sf_dir, "documents").select("doc_id", F.col("source").alias("collection"), "text")
    return together(rows(beside(spark)), "doc_id") if by_document else dealt(rows(spark))


def sequences(spark: SparkSession, sf_dir: str, by_document: bool = False) -> DataFrame:
    """Token arrays with gold and predicted tags, over whole texts."""
    d = texts(spark, sf_dir, by_document)
    tokens = F.split(F.trim(F.regexp_replace("text", "[ \t\n\r\f]+", " ")), " ")
    d = d.select("doc_id", "collection", tokens.alias("tokens"))
    values = F.array(*[F.lit(v) for v in VALUES])

    def tag(shift: bool):
        def one(token, pos):
            odd = F.when(pos % 7 == 0, 1).otherwise(0) if shift else F.lit(0)
            more = F.when(pos % 9 == 0, 1).otherwise(0) if shift else F.lit(0)
            index = (F.col("doc_id") + F.floor(pos / 4) + more) % len(VALUES)
            prefix = F.when(pos % 4 == 0, "B-").otherwise("I-")
            return F.when((F.length(token) + pos + odd) % 5 == 0, "O").otherwise(F.concat(prefix, F.get(values, index.cast("int"))))

        return one

    return d.withColumns({"gold": F.transform("tokens", tag(False)), "pred": F.transform("tokens", tag(True))})


TAGS = """
tok AS (SELECT doc_id, collection, unnest(ts) AS token, generate_subscripts(ts, 1) - 1 AS pos FROM (
        SELECT doc_id, source AS collection, string_split(trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g')), ' ') AS ts FROM documents)),
tags AS (SELECT doc_id, collection, token, pos,
        CASE WHEN (length(token) + pos) % 5 = 0 THEN 'O' ELSE (CASE WHEN pos % 4 = 0 THEN 'B-' ELSE 'I-' END)
             || (['social','economic','political','historic','aesthetical','scientific','age','ecological'])[(doc_id + pos // 4) % 8 + 1] END AS gold,
        CASE WHEN (length(token) + pos + CASE WHEN pos % 7 = 0 THEN 1 ELSE 0 END) % 5 = 0 THEN 'O' ELSE (CASE WHEN pos % 4 = 0 THEN 'B-' ELSE 'I-' END)
             || (['social','economic','political','historic','aesthetical','scientific','age','ecological'])[(doc_id + pos // 4 + CASE WHEN pos % 9 = 0 THEN 1 ELSE 0 END) % 8 + 1] END AS pred
        FROM tok)
"""


def sentences(spark: SparkSession, sf_dir: str, by_document: bool = False) -> DataFrame:
    """Sentence records of all texts, numbered, ten to a page."""
    d = texts(spark, sf_dir, by_document)
    parts = F.filter(F.transform(F.regexp_extract_all("text", F.lit(r"[^.!?\n]+[.!?]?"), 0), lambda s: F.trim(s)), lambda s: s != "")
    each = d.select("doc_id", "collection", F.posexplode(parts).alias("i", "sentence"))
    return each.select("doc_id", "collection", (F.col("i") + 1).cast("long").alias("sentence_id"), (F.floor(F.col("i") / 10) + 1).cast("long").alias("page"), "sentence")


SENTENCES = """
sentences AS (SELECT doc_id, collection, i::BIGINT AS sentence_id, ((i - 1) // 10 + 1)::BIGINT AS page, parts[i] AS sentence FROM (
    SELECT doc_id, collection, parts, unnest(range(1, len(parts) + 1)) AS i FROM (
        SELECT doc_id, source AS collection,
               list_filter(list_transform(regexp_extract_all(text, '[^.!?\\n]+[.!?]?'), lambda s: trim(s)), lambda s: s <> '') AS parts FROM documents)))
"""


def path_of(place):
    return F.concat(place, F.col("doc_id"), F.lit(".pdf"))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered sources: path and checksum; a tenth are no longer where they were."""
    place = F.when(F.col("doc_id") % 10 == 0, "archive/").otherwise("sources/")
    return table(spark, sf_dir, "documents").select(path_of(place).alias("source_path"), F.sha2(F.col("text").cast("binary"), 256).alias("checksum"))


def discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources found on disk: a seventh are new, some have changed."""
    place = F.when(F.col("doc_id") % 7 == 0, "incoming/").otherwise("sources/")
    content = F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select(path_of(place).alias("source_path"), F.sha2(content.cast("binary"), 256).alias("checksum"))


REGISTRY = """
registry AS (SELECT CASE WHEN doc_id % 10 = 0 THEN 'archive/' ELSE 'sources/' END || doc_id || '.pdf' AS source_path, sha256(text) AS checksum FROM documents),
discovered AS (SELECT CASE WHEN doc_id % 7 = 0 THEN 'incoming/' ELSE 'sources/' END || doc_id || '.pdf' AS source_path,
               sha256(CASE WHEN doc_id % 13 = 0 THEN text || 'x' ELSE text END) AS checksum FROM documents)
"""


def reviews(found: DataFrame) -> DataFrame:
    """A review of each sentence: status by number, with some stale digests."""
    i, s = F.col("doc_id"), F.col("sentence_id")
    status = F.element_at(F.array(*[F.lit(x) for x in ("pending", "approved", "needs_correction", "excluded")]), ((i + s) % 4 + 1).cast("int"))
    old = F.when((i * 31 + s) % 17 == 0, F.concat("sentence", F.lit("~"))).otherwise(F.col("sentence"))
    return found.select("doc_id", "sentence_id", status.alias("status"), F.sha2(old.cast("binary"), 256).alias("record_sha256"), (i * 1000 + s).alias("decided_at"))


REVIEWS = """
reviews AS (SELECT doc_id, sentence_id, (['pending','approved','needs_correction','excluded'])[(doc_id + sentence_id) % 4 + 1] AS status,
            sha256(CASE WHEN (doc_id * 31 + sentence_id) % 17 = 0 THEN sentence || '~' ELSE sentence END) AS record_sha256,
            doc_id * 1000 + sentence_id AS decided_at FROM sentences)
"""
