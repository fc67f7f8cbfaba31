"""Reviews as events: what each event does, what it is refused for, and the state that all of them leave.

Events of a document are in order of seq.  An event names several sentences or the
whole document; if one of the sentences is unknown, all of it is refused.  A
sentence's state follows from its own events by windows; the number of a document's
open sentences follows from the changes of its sentences by a running sum.  Nothing is
changed in place: replaying the events gives the states again.

events: doc_id, seq, kind, actor, sentence_ids (array), status, code, record_sha256, at
  decide (status), accept_warning (code), accept_all, edit and source_changed
  (record_sha256, the record after it), submit
records: doc_id, sentence_id, record_sha256 before the first event
warnings: doc_id, sentence_id, record_sha256, code, severity of every version of a record

keep, where a function has it, writes a table and reads it again: the versions are read
by several steps, and are made once that way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["doc_id", "sentence_id"]
FINAL = ["approved", "excluded"]
STATUSES = ["approved", "needs_correction", "excluded"]
OF_SENTENCES = ["decide", "accept_warning", "edit", "source_changed"]


def blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def admitted(events: DataFrame, records: DataFrame) -> DataFrame:
    """Events with `refused`: what speaks against one by itself, without looking at other events; null if nothing does."""
    named = events.select("doc_id", "seq", F.explode(F.array_distinct("sentence_ids")).alias("sentence_id"))
    unknown = named.join(records.select(*KEYS), KEYS, "left_anti").select("doc_id", "seq").distinct().withColumn("unknown", F.lit(True))
    kind = F.col("kind")
    reason = (
        F.when(~kind.isin(*OF_SENTENCES, "accept_all", "submit"), "unknown_event")
        .when(blank("actor") & (kind != "source_changed"), "actor_required")
        .when((kind == "decide") & (F.col("status") == "pending"), "pending_is_no_decision")
        .when((kind == "decide") & ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "unknown_status")
        .when(kind.isin(*OF_SENTENCES) & (F.coalesce(F.size("sentence_ids"), F.lit(0)) <= 0), "sentence_required")
        .when(F.coalesce(F.col("unknown"), F.lit(False)), "unknown_sentence")
        .when(kind.isin("edit", "source_changed") & F.col("record_sha256").isNull(), "record_required")
    )
    return events.join(unknown, ["doc_id", "seq"], "left").withColumn("refused", reason).drop("unknown")


def versions(admitted_: DataFrame, records: DataFrame) -> DataFrame:
    """A row for each sentence and event that reaches it, with the record before and after it, and its version's number."""
    good = admitted_.filter("refused is null")
    direct = good.filter(F.col("kind").isin(*OF_SENTENCES)).withColumn("sentence_id", F.explode(F.array_distinct("sentence_ids")))
    whole = good.filter("kind = 'accept_all'").join(records.select(*KEYS), "doc_id")
    fields = [*KEYS, "seq", "kind", "actor", "status", "code", "record_sha256", "at"]
    rows = direct.select(*fields).unionByName(whole.select(*fields)).join(records.select(*KEYS, F.col("record_sha256").alias("first_sha")), KEYS)
    order = Window.partitionBy(*KEYS).orderBy("seq")
    changing = F.when(F.col("kind").isin("edit", "source_changed"), F.col("record_sha256"))
    before = F.coalesce(F.last(changing, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("first_sha"))
    rows = rows.withColumn("before", before).withColumn("after", F.coalesce(changing, "before"))
    changed = F.sum((F.col("after") != F.col("before")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.drop("first_sha").withColumn("version", changed)


def acceptances(rows: DataFrame, warnings: DataFrame) -> DataFrame:
    """(keys, seq, kind, actor, at, version, code, outcome) for each warning that an event would accept.

    A warning has to be there for the record as it then is; errors are never
    accepted; the first acceptance within a version counts.
    """
    asked = rows.filter("kind in ('accept_warning', 'accept_all')").select(*KEYS, "seq", "kind", "actor", "at", "version", F.col("before").alias("record_sha256"), F.col("code").alias("asked"))
    active = warnings.groupBy(*KEYS, "record_sha256", "code").agg(F.max("severity").alias("severity"))  # warning comes after error
    by_code = asked.filter("kind = 'accept_warning'").withColumn("code", F.col("asked")).join(active, [*KEYS, "record_sha256", "code"], "left")
    by_all = asked.filter("kind = 'accept_all'").join(active.filter("severity = 'warning'"), [*KEYS, "record_sha256"])
    found = by_code.unionByName(by_all.select(*by_code.columns))
    able = F.col("severity") == "warning"
    turn = F.row_number().over(Window.partitionBy(*KEYS, "version", "code").orderBy(F.when(able, 0).otherwise(1), "seq"))
    outcome = F.when(F.col("severity").isNull(), "warning_not_active").when(~able, "error_not_acceptable").when(turn > 1, "already_accepted").otherwise("applied")
    return found.withColumn("outcome", outcome).select(*KEYS, "seq", "kind", "actor", "at", "version", "code", "outcome")


def status_changes(rows: DataFrame, records: DataFrame) -> DataFrame:
    """(keys, seq, status, was, reviewer, decided_at): each change of a sentence's status; a new record goes back to pending, an edit needs correction."""
    after = F.when(F.col("kind") == "decide", F.col("status")).when(F.col("kind") == "edit", "needs_correction").when((F.col("kind") == "source_changed") & (F.col("after") != F.col("before")), "pending")
    found = rows.withColumn("to", after).filter("to is not null")
    decided = F.col("kind") == "decide"
    order = Window.partitionBy(*KEYS).orderBy("seq")
    was = F.coalesce(F.lag("to").over(order), F.lit("pending"))
    return found.select(*KEYS, "seq", F.col("to").alias("status"), was.alias("was"), F.when(decided, F.trim("actor")).alias("reviewer"), F.when(decided, F.col("at")).alias("decided_at"))


def submissions(admitted_: DataFrame, changes: DataFrame, records: DataFrame) -> DataFrame:
    """(doc_id, seq, open, outcome) of each submission: how many sentences then had no final decision."""
    final = lambda c: F.col(c).isin(*FINAL).cast("int")
    total = records.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"))
    steps = changes.groupBy("doc_id", "seq").agg(F.sum(final("status") - final("was")).alias("step"))
    asked = admitted_.filter("kind = 'submit' and refused is null").select("doc_id", "seq")
    each = steps.withColumn("asked", F.lit(False)).unionByName(asked.select("doc_id", "seq", F.lit(0).cast("long").alias("step"), F.lit(True).alias("asked")))
    closed = F.sum("step").over(Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = each.withColumn("closed", closed).filter("asked").join(total, "doc_id", "left")
    open_ = F.coalesce("total", F.lit(0)) - F.col("closed")
    return found.select("doc_id", "seq", open_.alias("open"), F.when(open_ > 0, "unresolved_sentences").otherwise("applied").alias("outcome"))


def outcomes(events: DataFrame, records: DataFrame, warnings: DataFrame, keep=lambda df: df) -> DataFrame:
    """(doc_id, seq, kind, outcome) of every event: applied, nothing_to_do, or why it was refused."""
    judged = keep(admitted(events, records))
    rows = keep(versions(judged, records))
    accepted = acceptances(rows, warnings)
    rank = F.when(F.col("outcome") == "applied", 0).when(F.col("outcome") == "already_accepted", 1).otherwise(2)
    of_warnings = accepted.groupBy("doc_id", "seq").agg(F.min_by("outcome", rank).alias("by_warning"))
    of_submits = submissions(judged, status_changes(rows, records), records).select("doc_id", "seq", F.col("outcome").alias("by_submit"))
    same = rows.filter("kind = 'source_changed'").groupBy("doc_id", "seq").agg(F.bool_or(F.col("after") != F.col("before")).alias("by_change"))
    all_ = judged.select("doc_id", "seq", "kind", "refused").join(of_warnings, ["doc_id", "seq"], "left").join(of_submits, ["doc_id", "seq"], "left").join(same, ["doc_id", "seq"], "left")
    idle = (F.col("kind") == "accept_all") & (F.coalesce("by_warning", F.lit("")) != "applied") | ~F.coalesce("by_change", F.lit(True)) | (F.col("by_warning") == "already_accepted")
    return all_.select("doc_id", "seq", "kind", F.coalesce("refused", "by_submit", F.when(F.coalesce(idle, F.lit(False)), "nothing_to_do"), "by_warning", F.lit("applied")).alias("outcome"))


def states(events: DataFrame, records: DataFrame, warnings: DataFrame, keep=lambda df: df) -> DataFrame:
    """(keys, record_sha256, status, reviewer, decided_at, accepted) of every sentence after all events.

    Last values are aggregates, so a sentence with very many events is no single task's.
    """
    rows = keep(versions(admitted(events, records), records))
    last = rows.groupBy(*KEYS).agg(F.max_by("after", "seq").alias("after"), F.max("version").alias("version"))
    status = status_changes(rows, records).groupBy(*KEYS).agg(F.max_by(F.struct("status", "reviewer", "decided_at"), "seq").alias("s"))
    taken = acceptances(rows, warnings).filter("outcome = 'applied'").groupBy(*KEYS, "version").agg(F.array_sort(F.collect_set("code")).alias("accepted"))
    found = records.select(*KEYS, "record_sha256").join(last, KEYS, "left").join(status, KEYS, "left").join(taken, [*KEYS, "version"], "left")
    return found.select(*KEYS, F.coalesce("after", "record_sha256").alias("record_sha256"), F.coalesce("s.status", F.lit("pending")).alias("status"), "s.reviewer", "s.decided_at", F.coalesce("accepted", F.array().cast("array<string>")).alias("accepted"))


def audit(events: DataFrame, records: DataFrame, warnings: DataFrame, keep=lambda df: df) -> DataFrame:
    """(keys, seq, event, actor, at, details): what is kept for each sentence; refused events leave nothing."""
    rows = keep(versions(admitted(events, records), records))
    changes = status_changes(rows, records).select(*KEYS, "seq", "was")
    detail = lambda **kw: F.to_json(F.struct(*[c.alias(k) for k, c in kw.items()]))
    decided = rows.filter("kind = 'decide'").join(changes, [*KEYS, "seq"]).select(*KEYS, "seq", F.lit("decision").alias("event"), "actor", "at", detail(**{"from": F.col("was"), "to": F.col("status")}).alias("details"))
    edited = rows.filter("kind = 'edit'").select(*KEYS, "seq", F.lit("edit").alias("event"), "actor", "at", detail(before=F.col("before"), after=F.col("after")).alias("details"))
    changed = rows.filter("kind in ('edit', 'source_changed') and after <> before").select(*KEYS, "seq", F.lit("source_record_changed").alias("event"), F.lit("system").alias("actor"), "at", detail(previous=F.col("before")).alias("details"))
    taken = acceptances(rows, warnings).filter("outcome = 'applied'").select(*KEYS, "seq", F.lit("warning_accepted").alias("event"), "actor", "at", detail(code=F.col("code")).alias("details"))
    return decided.unionByName(edited).unionByName(changed).unionByName(taken).withColumn("actor", F.trim("actor"))


# --- approvals ---------------------------------------------------------------------------


def approvals(events: DataFrame, people: DataFrame) -> DataFrame:
    """(doc_id, seq, candidate_id, outcome, current) of each approval by a data owner.

    events: doc_id, seq, kind, actor, candidate_id, decision, license, statement with
    the kinds candidate (a candidate is made), evidence (something it rests on changed),
    curate (decision on a candidate) and approve; people: person_id, roles.  An approval
    names the newest candidate, which a curator has accepted and whose evidence has not
    changed since; it is current as long as that stays so and no later one replaces it.
    """
    order = Window.partitionBy("doc_id").orderBy("seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    of = lambda kind, c: F.when(F.col("kind") == kind, c)
    rows = events.join(people.select(F.col("person_id").alias("actor"), F.array_contains("roles", "data_owner").alias("owner")), "actor", "left")
    made = F.last(of("candidate", F.struct("candidate_id", "seq")), ignorenulls=True).over(before)
    curated = F.last(of("curate", F.struct("candidate_id", "decision")), ignorenulls=True).over(before)
    touched = F.last(of("evidence", F.col("seq")), ignorenulls=True).over(before)
    rows = rows.withColumns({"made": made, "curated": curated, "touched": touched})
    stale = F.coalesce(F.col("touched") > F.col("made.seq"), F.lit(False))
    accepted = F.coalesce((F.col("curated.candidate_id") == F.col("made.candidate_id")) & (F.col("curated.decision") == "accepted"), F.lit(False))
    outcome = (
        F.when(F.col("owner").isNull(), "unknown_person")
        .when(~F.col("owner"), "not_a_data_owner")
        .when(F.col("made").isNull(), "no_candidate")
        .when(stale, "candidate_stale")
        .when(F.coalesce(F.col("candidate_id") != F.col("made.candidate_id"), F.lit(True)), "other_candidate")
        .when(~accepted, "candidate_not_accepted")
        .when(blank("license"), "license_required")
        .when(blank("statement"), "statement_required")
        .otherwise("applied")
    )
    judged = rows.withColumn("outcome", F.when(F.col("kind") == "approve", outcome))
    undone = F.max(F.when(F.col("kind").isin("candidate", "evidence") | (F.col("outcome") == "applied"), F.col("seq"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    current = (F.col("outcome") == "applied") & undone.isNull()
    return judged.withColumn("current", current).filter("kind = 'approve'").select("doc_id", "seq", "candidate_id", "outcome", "current")
