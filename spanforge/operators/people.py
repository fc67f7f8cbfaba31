"""People, citations and their links to documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assign(documents: DataFrame, people: DataFrame, role: str) -> DataFrame:
    """Documents with a snapshot of each assigned person who has the role; others get the code of what is wrong.

    documents: document_id, person_id.
    """
    joined = documents.join(people, "person_id", "left")
    code = F.when(F.col("name").isNull(), "unknown_person").when(~F.array_contains("roles", role), "missing_role")
    return joined.select("document_id", "person_id", F.when(code.isNull(), F.struct("name", "affiliation", "orcid")).alias("snapshot"), code.alias("code"))


def documents_of(assignments: DataFrame) -> DataFrame:
    return assignments.groupBy("person_id").agg(F.array_sort(F.collect_set("document_id")).alias("documents"))


def active_curators(people: DataFrame) -> DataFrame:
    """One row: how many are active, and whether that is one at most."""
    n = F.count_if(F.col("active_curator"))
    return people.agg(n.alias("active"), (n <= 1).alias("valid"))


def unique_match(citations: DataFrame, sources: DataFrame) -> DataFrame:
    """Citations joined to the one source whose path or file name is theirs; code tells none or several.

    Sources are counted by name first, so a name that many citations and many sources
    share makes one row a citation and not one a pair.
    """
    names = F.array_distinct(F.array("source_path", F.element_at(F.split("source_path", "/"), -1)))
    keys = sources.select("source_path").distinct().select("source_path", F.explode(names).alias("source_filename"))
    found = keys.groupBy("source_filename").agg(F.count(F.lit(1)).alias("n"), F.min("source_path").alias("source_path"))
    joined = citations.join(found, "source_filename", "left")
    code = F.when(F.col("n").isNull(), "no_source").when(F.col("n") > 1, "ambiguous_source")
    return joined.withColumn("code", code).withColumn("source_path", F.when(code.isNull(), F.col("source_path"))).drop("n")


def current_decisions(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """The last decision on each document's latest candidate."""
    latest = candidates.groupBy("document_id").agg(F.max_by("candidate_id", "ord").alias("candidate_id"))
    last = decisions.groupBy("candidate_id").agg(F.max_by(F.struct("decision", "actor"), "ord").alias("d"))
    return latest.join(last, "candidate_id", "left").select("document_id", "candidate_id", "d.decision", "d.actor")


def proposed_citation(found: DataFrame) -> DataFrame:
    """Blank fields filled from embedded properties; the title else from the file name."""
    blank = lambda c: F.when(F.trim(F.col(c)) != "", F.trim(F.col(c)))
    stem = F.regexp_replace(F.regexp_replace(F.element_at(F.split("source_path", "/"), -1), r"\.[^.]*$", ""), "_", " ")
    return found.select("source_path", F.coalesce(blank("title"), blank("embedded_title"), stem).alias("title"), F.coalesce(blank("creator"), blank("embedded_author")).alias("creator"), F.coalesce(blank("year"), F.regexp_extract(F.coalesce("embedded_date", F.lit("")), r"(\d{4})", 1)).alias("year"))


def citation_valid():
    """A citation is valid if a person confirmed it or a program's check passed."""
    return F.coalesce(F.col("confirmed_by") != "", F.lit(False)) | F.coalesce(F.col("program_status") == "valid", F.lit(False))
