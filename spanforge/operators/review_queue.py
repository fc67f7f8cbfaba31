"""What each document still needs before release, and the queue that reviewers see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Gates in order, with the sentence that tells what is open.
REASONS = {
    "curator": "Select an active project curator.",
    "original_annotator": "Assign at least one original annotator to this document.",
    "citation": None,
    "color_configuration": "Review and confirm the document color configuration.",
    "extraction": "Run extraction and persist a non-empty sentence inventory.",
    "sentence_review": "Approve or exclude every extracted sentence.",
}
#: Counts that a document without records or review shows as 0.
COUNTS = ["pending", "approved", "needs_correction", "excluded", "flagged"]


def filled(c: str) -> Column:
    return F.coalesce(F.length(c) > 0, F.lit(False))


def some(c: str) -> Column:
    return F.coalesce(F.size(c) > 0, F.lit(False))


def gates(rows: DataFrame) -> DataFrame:
    """Adds a boolean for each gate and reasons, the sentences of the closed ones in order.

    rows, one for each document: active_curator; of the metadata original_annotators, human_confirmed, title, creators,
    citation_text, reference, not_findable_reason, colors_confirmed, color_statuses, resource_count; n_records; of the
    review n_reviewed and n_decided (approved or excluded).  What is null is not there.
    """
    true = lambda c: F.coalesce(F.col(c), F.lit(False))
    records = F.coalesce(F.col("n_records"), F.lit(0))
    settled = F.forall("color_statuses", lambda s: s.isin("approved", "ignored"))
    found = {
        "curator": true("active_curator"),
        "original_annotator": some("original_annotators"),
        "citation": true("human_confirmed") & filled("title") & some("creators") & filled("citation_text") & (filled("reference") | filled("not_findable_reason")),
        "color_configuration": true("colors_confirmed") & some("color_statuses") & F.coalesce(settled, F.lit(False)),
        "extraction": (records > 0) & F.coalesce(F.col("resource_count") == records, F.lit(False)),
        "sentence_review": (records > 0) & F.coalesce((F.col("n_reviewed") == records) & (F.col("n_decided") == records), F.lit(False)),
    }
    out = rows.withColumns(found)
    open_ = [F.when(~F.col(g), F.lit(text)) for g, text in REASONS.items() if text]
    return out.withColumn("reasons", F.array_compact(F.array(*open_)))


def flagged_counts(flags: DataFrame, accepted: DataFrame, *keys: str) -> DataFrame:
    """(document keys, flagged): records with a flag that no reviewer has accepted.

    flags: keys and codes (array) of each record, the last key names the record; accepted: the same with accepted.
    """
    joined = flags.join(accepted, list(keys), "left")
    left = F.size(F.array_except("codes", F.coalesce("accepted", F.array().cast("array<string>")))) > 0
    return joined.groupBy(*keys[:-1]).agg(F.count_if(left).alias("flagged"))


def queue(documents: DataFrame) -> DataFrame:
    """Rows of gates() with completion and counts; documents without records or review show zeros and are not complete.

    documents also has review_available, and the counts by status with flagged.
    """
    there = F.coalesce(F.col("review_available"), F.lit(False))
    whole = F.bround(100 * (F.col("approved") + F.col("excluded")) / F.col("n_records")).cast("int")
    percent = F.when(there & (F.col("n_records") > 0), whole).otherwise(0)
    complete = there
    for gate, text in REASONS.items():
        if text:
            complete = complete & F.col(gate)
    out = documents.withColumns({"completion_percent": percent, "annotation_complete": complete})
    shown = {c: F.when(there, F.coalesce(F.col(c), F.lit(0))).otherwise(0) for c in COUNTS}
    return out.withColumns({**shown, "total": F.when(there, F.coalesce(F.col("n_records"), F.lit(0))).otherwise(0)})
