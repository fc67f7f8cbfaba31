"""The queries of this subpackage and their SQL; __spark_entry__.py adds both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm import chat, filter_audit, licenses, quality, sentence_pieces
from spanforge.llm.common import Scratch
from spanforge.llm.decontamination import contamination
from spanforge.llm.html_extract import extract
from spanforge.llm.lm_scoring import score
from spanforge.llm.near_duplicates import near_duplicates
from spanforge.llm.packing import pack
from spanforge.llm.substring_dedup import remove_repeats
from spanforge.llm.token_counts import count_tokens
from spanforge.llm.whitening import whiten


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), k=4, num=85, den=100)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chat(table(spark, sf_dir, "conversations"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(quality.ledger(documents(spark, sf_dir), "doc_id"))


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the current policy rejects, from a stored ledger."""
    folder = f"{Scratch(spark, 'quality').root}/ledger"
    return quality.ablation(quality.stored(documents(spark, sf_dir), folder, "doc_id"))


def tool_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whose assistant turns call a tool and whose user turns bring results, some of them odd.

    Every third call lacks what its tool needs, and results of every fifth turn name no call.
    """
    turn, conv = F.col("turn"), F.col("conv_id")
    name = lambda x: F.concat(F.lit("c"), conv, F.lit("-"), x)
    arguments = F.when(turn % 3 == 0, F.lit('{"limit":3}')).otherwise(F.concat(F.lit('{"query":"q'), turn, F.lit('","limit":2}')))
    call = F.concat(F.lit('Look. <tool_call>{"name":"search","arguments":'), arguments, F.lit(',"id":"'), name(turn), F.lit('"}</tool_call>'))
    result = F.concat(F.lit('{"content":"r'), turn, F.lit('","tool_call_id":"'), F.when(turn % 5 == 0, "none").otherwise(name(turn - 1)), F.lit('"}'))
    calls = table(spark, sf_dir, "conversations").dropDuplicates(["conv_id", "turn"])
    is_call = turn % 2 == 0
    return calls.select("conv_id", "turn", F.when(is_call, "assistant").otherwise("tool").alias("role"), F.when(is_call, call).otherwise(result).alias("text"))


def linked_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chat(tool_turns(spark, sf_dir))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.digests(sentence_pieces.encode_decode(documents(spark, sf_dir)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_html_extraction": op5_html_extraction,
    "op6_quality_rules": op6_quality_rules,
    "op7_packing": op7_packing,
    "op8_decontamination": op8_decontamination,
    "op9_token_counts": op9_token_counts,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_filter_audit": op11_filter_audit,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_sentence_pieces": op13_sentence_pieces,
    "quality_ablation": quality_ablation,
    "linked_tool_calls": linked_tool_calls,
}

ORACLES: dict[str, str] = {
    "op1_license_scan": licenses.oracle(),
    "op4_chat_formatting": chat.ORACLE,
    "op6_quality_rules": quality.ORACLE,
    "op11_filter_audit": filter_audit.ORACLE,
    "quality_ablation": quality.ABLATION_ORACLE,
    "linked_tool_calls": chat.LINKED_ORACLE,
}
