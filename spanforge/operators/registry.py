"""Source registries, reviews and releases as joins and conditional counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def synchronise(registry: DataFrame, found: DataFrame) -> DataFrame:
    """(source_path, checksum, observed_checksum, source_state) of registered and found sources.

    new, current, changed, or missing; both sides have one row for each path.
    """
    a = registry.select("source_path", "checksum")
    b = found.select("source_path", F.col("checksum").alias("observed_checksum"))
    joined = a.join(b, "source_path", "full_outer")
    state = (
        F.when(F.col("checksum").isNull(), "new")
        .when(F.col("observed_checksum").isNull(), "missing")
        .when(F.col("checksum") == F.col("observed_checksum"), "current")
        .otherwise("changed")
    )
    return joined.withColumn("source_state", state)


def registry_summary(states: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("source_state") == s).alias(s)
    return states.agg(F.count(F.lit(1)).alias("total"), n("new"), n("current"), n("changed"), n("missing"), F.count_if(F.col("checksum").isNotNull()).alias("registered"), F.coalesce(F.bool_and(F.col("source_state") == "current"), F.lit(True)).alias("up_to_date"))


def scan_report(states: DataFrame) -> DataFrame:
    """(source_state, source_path, position): sources that need attention, in order of path within each state."""
    open_ = states.filter("source_state <> 'current'")
    return open_.select("source_state", "source_path", F.row_number().over(Window.partitionBy("source_state").orderBy("source_path")).alias("position"))


def document_ids(paths: DataFrame, prefix: str = "doc", digits: int = 12) -> DataFrame:
    """Adds document_id: a prefix and the first hex digits of the path's SHA-256, four more for each collision."""
    digest = F.sha2(F.col("source_path").cast("binary"), 256)
    out = paths.withColumn("_h", digest)
    expression = None
    for width in range(digits, 65, 4):
        short = F.substring("_h", 1, width)
        alone = F.count(F.lit(1)).over(Window.partitionBy(short)) == 1
        if width <= digits + 8:  # collisions beyond need another 32 equal bits
            expression = [*(expression or []), F.when(alone, short)]
    return out.withColumn("document_id", F.concat(F.lit(prefix + "-"), F.coalesce(*expression, F.col("_h")))).drop("_h")


def register(registry: DataFrame, found: DataFrame, wanted: DataFrame) -> DataFrame:
    """New registry rows for wanted paths that are found and not yet registered."""
    return found.join(wanted, "source_path", "left_semi").join(registry, "source_path", "left_anti")


def unknown(wanted: DataFrame, found: DataFrame, key: str = "source_path") -> DataFrame:
    """Requests that match nothing."""
    return wanted.join(found, key, "left_anti")


def bound_sources(entries: DataFrame, bindings: DataFrame, found: DataFrame) -> DataFrame:
    """(document_id, path, problem): where each document's source is; problem is unbound, missing or changed, or null.

    entries: document_id, source_path, binding (project, or external for sources that bindings places), checksum;
    bindings: document_id, path; found: path, observed_checksum.
    """
    placed = entries.join(bindings.withColumnRenamed("path", "outside"), "document_id", "left")
    placed = placed.withColumn("path", F.when(F.col("binding") == "project", F.col("source_path")).otherwise(F.col("outside")))
    seen = placed.join(found, "path", "left")
    problem = F.when(F.col("path").isNull(), "unbound").when(F.col("observed_checksum").isNull(), "missing").when(F.col("observed_checksum") != F.col("checksum"), "changed")
    return seen.select("document_id", "path", problem.alias("problem"))


def selected(registered: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """Registered documents that are asked for; all of them if nobody asks.  An empty, repeated or unknown choice is an error."""
    if ids is None:
        return registered
    if not ids:
        raise ValueError("choose at least one document")
    if len(ids) != len(set(ids)):
        raise ValueError("a document is chosen twice")
    asked = registered.sparkSession.createDataFrame([(i,) for i in ids], "document_id string")  # as many as were typed in
    strange = sorted(r["document_id"] for r in asked.join(registered, "document_id", "left_anti").collect())
    if strange:
        raise ValueError(f"unknown documents: {strange}")
    return registered.join(asked, "document_id", "left_semi")


def collection(documents: DataFrame, records: DataFrame, issues: DataFrame) -> DataFrame:
    """(document_id, source_path, checksum, record_count, records) of all documents that are done, or an error if one of them has an issue.

    documents: document_id, source_path, checksum, status; records: document_id,
    page, sentence_id and more, sorted by both; issues: document_id, code.  A
    document without records has an empty list.
    """
    done = documents.filter("status = 'done'").drop("status")
    wrong = issues.join(done, "document_id", "left_semi").groupBy("code").agg(F.countDistinct("document_id").alias("n")).orderBy("code").collect()  # one row for each code
    if wrong:
        raise ValueError("documents with issues: " + ", ".join(f"{r['code']} ({r['n']})" for r in wrong))
    rest = [c for c in records.columns if c not in ("document_id", "page", "sentence_id")]
    each = F.array_sort(F.collect_list(F.struct("page", "sentence_id", *rest)))
    grouped = records.join(done, "document_id", "left_semi").groupBy("document_id").agg(each.alias("records"))
    out = done.join(grouped, "document_id", "left")
    found = F.coalesce("records", F.array().cast(grouped.schema["records"].dataType))
    return out.select("document_id", "source_path", "checksum", F.size(found).alias("record_count"), found.alias("records"))


def reusable(checkpoints: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds reuse: a checkpoint counts if source, mapping and number of records are those of now."""
    joined = sources.join(checkpoints.select("document_id", F.col("source_sha256").alias("s"), F.col("mapping_sha256").alias("m"), F.col("records").alias("r")), "document_id", "left")
    same = (F.col("s") == F.col("source_sha256")) & (F.col("m") == F.col("mapping_sha256")) & (F.col("r") == F.col("records"))
    return joined.withColumn("reuse", F.coalesce(same, F.lit(False))).drop("s", "m", "r")


# --- reviews ---------------------------------------------------------------------------

KEYS = ["doc_id", "sentence_id"]


def digest(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def stale_reviews(records: DataFrame, reviews: DataFrame) -> DataFrame:
    """Reviews whose record has changed or gone."""
    now = records.select(*KEYS, digest(F.col("sentence")).alias("now"))
    joined = reviews.join(now, KEYS, "left")
    reason = F.when(F.col("now").isNull(), "review_annotation_mismatch").when(F.col("now") != F.col("record_sha256"), "stale_sentence_review")
    return joined.withColumn("code", reason).filter("code is not null").select(*KEYS, "status", "code")


def refreshed_reviews(records: DataFrame, reviews: DataFrame) -> DataFrame:
    """One review for each record: the old one if its digest still fits, else pending; event tells a reset."""
    now = records.select(*KEYS, digest(F.col("sentence")).alias("now"))
    joined = now.join(reviews, KEYS, "left")
    kept = F.coalesce(F.col("now") == F.col("record_sha256"), F.lit(False))
    event = F.when(kept, "kept").when(F.col("record_sha256").isNull(), "created").otherwise("reset")
    return joined.select(*KEYS, F.when(kept, F.col("status")).otherwise("pending").alias("status"), F.col("now").alias("record_sha256"), F.when(kept, F.col("decided_at")).alias("decided_at"), event.alias("event"))


def review_counts(reviews: DataFrame, *keys: str) -> DataFrame:
    """Counts by status, completion in whole percent (half to even), completeness and last decision."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    total, decided = F.count(F.lit(1)), F.count_if(F.col("status").isin("approved", "excluded"))
    return reviews.groupBy(*keys).agg(
        total.alias("sentences"),
        n("pending"),
        n("approved"),
        n("needs_correction"),
        n("excluded"),
        F.when(total == 0, 0).otherwise(F.bround(100 * decided / total)).cast("int").alias("percent"),
        F.coalesce(F.bool_and(F.col("status").isin("approved", "excluded")), F.lit(True)).alias("complete"),
        F.max(F.when(F.col("status").isin("approved", "excluded"), F.col("decided_at"))).alias("reviewed_at"),
    )


def release_rows(records: DataFrame, reviews: DataFrame) -> DataFrame:
    """Approved records with a review that fits, with their place in the release of their document."""
    fits = reviews.filter("status = 'approved'").select(*KEYS, "record_sha256")
    with_digest = records.withColumn("record_sha256", digest(F.col("sentence")))
    kept = with_digest.join(fits, [*KEYS, "record_sha256"], "left_semi")
    return kept.withColumn("position", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "sentence_id")))


def latest_decisions(events: DataFrame, key: str, *order: str) -> DataFrame:
    """The last event of each key; aggregated, so a key with very many events costs no sort."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last")).select(key, "last.*")


#: What an edit leaves as it is.
IMMUTABLE = ["sentence_id", "page", "sentence", "schema_version", "mapping_provenance"]


def edit_issues(before: DataFrame, after: DataFrame) -> DataFrame:
    """Guarded edits: (doc_id, sentence_id, code, field) for what an edit must not do.

    before: records with doc_id and all their columns; after: the same, with place (the
    sentence_id of the record it replaces) and excluded (places of the entities it
    removes).  IMMUTABLE fields stay; tokens stay unless the curated sentence changes;
    no entity is added, each one removed is named, and of those kept no label with its
    colour occurs more often than before, so a removal shows what went.  An edit of a
    record that is not there, and a second one of the same, are issues too.
    """
    kinds = lambda e: F.transform(e, lambda x: F.struct(x.getField("label").alias("label"), x.getField("color").alias("color")))
    names = [*IMMUTABLE[1:], "curated_sentence", "tokens", "entities"]
    a = before.select("doc_id", F.col("sentence_id").alias("place"), *[F.col(c).alias(f"a_{c}") for c in ["sentence_id", *names]])
    found = before.groupBy("doc_id", F.col("sentence_id").alias("place")).agg(F.count(F.lit(1)).alias("records"))
    b = after.select("doc_id", "place", "excluded", *[F.col(c).alias(f"b_{c}") for c in ["sentence_id", *names]]).join(found, ["doc_id", "place"], "left")
    once = F.coalesce(F.col("records"), F.lit(0)) == 1
    missing = b.filter(~once).select("doc_id", F.col("place").alias("sentence_id"), F.lit("not_exactly_one_record").alias("code"), F.lit(None).cast("string").alias("field"))
    rows = b.filter(once).join(a, ["doc_id", "place"])
    same = lambda c: F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    n0, n1 = F.size("a_entities"), F.size("b_entities")
    gone = F.array_distinct(F.coalesce("excluded", F.array().cast("array<int>")))
    outside = F.exists(gone, lambda i: i.isNull() | (i < 0) | (i >= n0))
    kept = kinds(F.filter("a_entities", lambda e, i: ~F.array_contains(gone, i)))
    new = kinds(F.col("b_entities"))
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y.eqNullSafe(x)))
    more = F.exists(F.array_distinct(new), lambda x: count(new, x) > count(kept, x))
    one = lambda condition, code, field: F.when(condition, F.struct(F.lit(code).alias("code"), F.lit(field).alias("field")))
    codes = F.array_compact(
        F.array(
            *[one(~same(c), "immutable_field_changed", c) for c in IMMUTABLE],
            one(same("curated_sentence") & ~same("tokens"), "tokens_changed", "tokens"),
            one(outside, "excluded_out_of_range", "excluded"),
            one(~outside & (n1 > n0), "entity_added", "entities"),
            one(~outside & (n1 <= n0) & (n1 != n0 - F.size(gone)), "removal_not_named", "entities"),
            one(~outside & (n1 == n0 - F.size(gone)) & more, "labels_or_colors_changed", "entities"),
        )
    )
    found = rows.select("doc_id", F.col("place").alias("sentence_id"), F.explode(codes).alias("x"))
    return found.select("doc_id", "sentence_id", "x.code", "x.field").unionByName(missing)


def decide(reviews: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Applies (doc_id, sentence_id, status, actor, at) to reviews; returns new reviews and their audit events."""
    new = decisions.groupBy(*KEYS).agg(F.max_by(F.struct("status", "actor"), "at").alias("d"), F.max("at").alias("at"))
    joined = reviews.join(new, KEYS, "left")
    out = joined.select(*KEYS, F.coalesce("d.status", "status").alias("status"), "record_sha256", F.coalesce("at", "decided_at").alias("decided_at"))
    audit = decisions.join(reviews.select(*KEYS), KEYS, "left_semi").select(*KEYS, F.lit("decision").alias("event"), "actor", F.col("at").alias("occurred_at"), F.map_from_arrays(F.array(F.lit("status")), F.array("status")).alias("details"))
    return out, audit


def next_status(status: Column, event: Column) -> Column:
    """Workflow of a document: backlog, in_progress, in_review, done; other moves leave it as it is."""
    moves = {("backlog", "start"): "in_progress", ("in_progress", "submit"): "in_review", ("in_review", "approve"): "done", ("in_review", "reject"): "in_progress"}
    out = status
    for (a, e), b in moves.items():
        out = F.when((status == a) & (event == e), b).otherwise(out)
    return out


# --- packages ----------------------------------------------------------------------------


PACKAGE_FILES = ("package_metadata", "annotations", "review_state")


def package_issues(metadata: DataFrame, records: DataFrame, reviews: DataFrame, files: DataFrame) -> DataFrame:
    """(document_id, code) from all rules over packages, each code once for a document.

    metadata: document_id, record_count, source_state; records and reviews: document_id, sentence_id, record_sha256, reviews also status.
    files: document_id, file (one of PACKAGE_FILES), state (ok, missing, unreadable, invalid_json, or invalid for a
    content that breaks its schema), named_document (the id that the file states), resource_path (where the metadata
    has the annotations).  metadata has a row for every registered document; a file without a row is missing.  What can't
    be read is not compared with anything.  Each table is reduced to one wide row a document, and all rules read that row.
    """
    key, one = ["document_id", "sentence_id"], "document_id"
    any_ = lambda condition: F.coalesce(F.bool_or(condition), F.lit(False))
    is_ = lambda file, *states: (F.col("file") == file) & F.col("state").isin(*states)
    counts = records.groupBy(*key).agg(F.count(F.lit(1)).alias("k")).groupBy(one).agg(F.sum("k").alias("n"), F.count("sentence_id").alias("ids"))
    joined = records.select(*key, F.col("record_sha256").alias("now")).join(reviews, key, "full_outer")
    status = F.col("status")
    compared = joined.groupBy(one).agg(
        any_(F.col("now").isNull() | status.isNull()).alias("unmatched"),
        any_(F.col("now") != F.col("record_sha256")).alias("stale"),
        any_(status.isin("pending", "needs_correction")).alias("open"),
        any_(~status.isin("pending", "approved", "needs_correction", "excluded")).alias("odd"),
    )
    other = (F.col("state") == "ok") & (F.col("named_document") != F.col(one))
    seen = files.filter(F.col("file").isin(*PACKAGE_FILES)).groupBy(one).agg(
        F.countDistinct("file").alias("present"),
        *[any_(F.col("state") == x).alias(x) for x in ("missing", "unreadable", "invalid_json")],
        *[any_(is_(x, "invalid")).alias(f"invalid_{x}") for x in PACKAGE_FILES],
        *[any_(is_(x, "ok", *(["invalid"] if x == "annotations" else []))).alias(f"read_{x}") for x in PACKAGE_FILES],
        any_(other & (F.col("file") == "package_metadata")).alias("other_metadata"),
        any_(other & (F.col("file") == "review_state")).alias("other_review"),
        any_(is_("package_metadata", "ok") & (F.col("resource_path") != "annotations.json")).alias("other_resource"),
    )
    wide = metadata.join(counts, one, "full_outer").join(compared, one, "full_outer").join(seen, one, "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    known = F.col("source_state").isNotNull() | F.col("record_count").isNotNull()
    rules = [
        (known & (yes("missing") | (F.coalesce("present", F.lit(0)) < len(PACKAGE_FILES))), "missing_package_file"),
        (known & yes("unreadable"), "unreadable_package_file"),
        (known & yes("invalid_json"), "invalid_json"),
        (known & yes("invalid_package_metadata"), "invalid_package_metadata"),
        (known & yes("other_metadata"), "metadata_document_mismatch"),
        (known & yes("invalid_annotations"), "invalid_annotations_document"),
        (known & yes("other_resource"), "annotation_resource_mismatch"),
        (known & yes("other_review"), "review_document_mismatch"),
        (F.col("source_state") == "missing", "source_missing"),
        (F.col("source_state") == "changed", "source_not_current"),
        ((F.coalesce("n", F.lit(0)) != F.col("record_count")) & yes("read_package_metadata") & yes("read_annotations"), "annotation_count_mismatch"),
        (known & (F.col("ids") < F.col("n")), "duplicate_sentence_id"),
        (yes("unmatched") & (yes("read_review_state") | ~known), "review_annotation_mismatch"),
        (yes("stale"), "stale_sentence_review"),
        (yes("open"), "sentence_review_incomplete"),
        (yes("odd") | (known & yes("invalid_review_state")), "invalid_review_state"),
    ]
    return wide.select(one, F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for c, code in rules]))).alias("code"))


def project_summary(metadata: DataFrame, issues: DataFrame) -> DataFrame:
    """Valid and invalid documents; all_valid holds for no documents, release_ready does not."""
    bad = issues.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    joined = metadata.join(bad, "document_id", "left")
    valid = F.col("n").isNull()
    return joined.agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(valid).alias("valid"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("issues"),
        F.coalesce(F.bool_and(valid), F.lit(True)).alias("all_valid"),
        F.coalesce(F.bool_and(valid), F.lit(False)).alias("release_ready"),
    )


def batch_report(results: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return results.agg(n("completed"), n("reused"), n("failed"), (F.count_if(F.col("status") == "failed") == 0).alias("successful"))


def same_split(published: DataFrame, computed: DataFrame) -> bool:
    """Whether two split tables hold the same rows (K4, U6): both differences are empty."""
    return published.exceptAll(computed).isEmpty() and computed.exceptAll(published).isEmpty()


def complete_join(ids: DataFrame, examples: DataFrame, key: str = "example_id") -> DataFrame:
    """Inner join that fails if either side has a key that the other lacks."""
    lost = ids.select(key).join(examples.select(key), key, "left_anti").count() + examples.select(key).join(ids.select(key), key, "left_anti").count()
    if lost:
        raise ValueError(f"{lost} ids are on one side only")
    return ids.join(examples, key)


def guide(code: Column, path: Column) -> Column:
    """The page of the documentation that helps with an issue."""
    package = code.contains("package") | code.contains("resource") | path.contains("citation") | path.contains("rights")
    return F.when(package, "DATA_PACKAGE").when(F.startswith(code, F.lit("source_")) | path.contains("registry"), "TUTORIAL").otherwise("VALIDATION")
