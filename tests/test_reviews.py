"""Review events replayed, guarded edits, approvals, ruled cells: hand-made cases."""

import pytest
from pyspark.sql import functions as F

from spanforge.operators import registry, review_events, ruling

EVENT = "doc_id int, seq long, kind string, actor string, sentence_ids array<int>, status string, code string, record_sha256 string, at long"


def replay(spark, *events):
    """Two sentences with two warnings and an error; each event is (kind, sentence_ids, what it says, actor)."""
    rows = []
    for n, (kind, ids, what, *actor) in enumerate(events):
        said = {"decide": "status", "accept_warning": "code", "edit": "sha", "source_changed": "sha"}.get(kind)
        rows.append((1, n, kind, (actor or ["anna "])[0], ids, what if said == "status" else None, what if said == "code" else None, what if said == "sha" else None, n * 10))
    events_ = spark.createDataFrame(rows, EVENT).repartition(2)
    records = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "doc_id int, sentence_id int, record_sha256 string")
    warnings = spark.createDataFrame([(1, 1, "a", "short", "warning"), (1, 1, "a", "broken", "error"), (1, 2, "b", "short", "warning"), (1, 2, "b", "end", "warning"), (1, 1, "a2", "short", "warning")], "doc_id int, sentence_id int, record_sha256 string, code string, severity string")
    outcomes = [r.outcome for r in review_events.outcomes(events_, records, warnings).orderBy("seq").collect()]
    states = {r.sentence_id: (r.record_sha256, r.status, r.reviewer, r.decided_at, r.accepted) for r in review_events.states(events_, records, warnings).collect()}
    trail = [(r.seq, r.sentence_id, r.event, r.actor) for r in review_events.audit(events_, records, warnings).orderBy("seq", "sentence_id", "event").collect()]
    return outcomes, states, trail


def test_decisions(spark):
    outcomes, states, trail = replay(spark, ("decide", [1, 2, 1], "approved"), ("decide", [2], "excluded", "ben"), ("decide", [1], "pending"), ("decide", [1], "approved", " "), ("decide", [1, 7], "excluded"), ("decide", [], "excluded"), ("decide", [1], None))
    assert outcomes == ["applied", "applied", "pending_is_no_decision", "actor_required", "unknown_sentence", "sentence_required", "unknown_status"]
    assert states == {1: ("a", "approved", "anna", 0, []), 2: ("b", "excluded", "ben", 10, [])}
    assert trail == [(0, 1, "decision", "anna"), (0, 2, "decision", "anna"), (1, 2, "decision", "ben")]


def test_warnings(spark):
    outcomes, states, trail = replay(spark, ("accept_warning", [1], "short"), ("accept_warning", [1], "short"), ("accept_warning", [1], "broken"), ("accept_warning", [1], "end"), ("accept_all", None, None), ("accept_all", None, None), ("accept_all", None, None, None))
    assert outcomes == ["applied", "nothing_to_do", "error_not_acceptable", "warning_not_active", "applied", "nothing_to_do", "actor_required"]
    assert {k: v[4] for k, v in states.items()} == {1: ["short"], 2: ["end", "short"]}
    assert [(s, i) for s, i, e, _ in trail if e == "warning_accepted"] == [(0, 1), (4, 2), (4, 2)]


def test_a_changed_record_starts_anew(spark):
    outcomes, states, trail = replay(spark, ("decide", [1, 2], "approved"), ("accept_warning", [1], "short"), ("source_changed", [1], "a", None), ("source_changed", [1], "a2", None), ("accept_warning", [1], "short"), ("edit", [2], "b2"), ("edit", [2], None))
    assert outcomes == ["applied", "applied", "nothing_to_do", "applied", "applied", "applied", "record_required"]
    assert states == {1: ("a2", "pending", None, None, ["short"]), 2: ("b2", "needs_correction", None, None, [])}
    assert [(s, i, e) for s, i, e, _ in trail if s > 2] == [(3, 1, "source_record_changed"), (4, 1, "warning_accepted"), (5, 2, "edit"), (5, 2, "source_record_changed")]


def test_submission_waits_for_every_sentence(spark):
    outcomes, *_ = replay(spark, ("submit", None, None), ("decide", [1], "approved"), ("submit", None, None), ("decide", [2], "excluded"), ("submit", None, None), ("edit", [1], "a2"), ("submit", None, None), ("decide", [1], "needs_correction"), ("submit", None, None), ("shred", None, None))
    assert outcomes == ["unresolved_sentences", "applied", "unresolved_sentences", "applied", "applied", "applied", "unresolved_sentences", "applied", "unresolved_sentences", "unknown_event"]


def test_no_events(spark):
    outcomes, states, trail = replay(spark)
    assert outcomes == [] and trail == [] and {v[1] for v in states.values()} == {"pending"} and len(states) == 2


ENTITY = "array<struct<label:string,color:string>>"
RECORD = f"doc_id int, sentence_id int, page int, sentence string, schema_version string, mapping_provenance struct<method:string,status:string>, curated_sentence string, tokens array<string>, entities {ENTITY}"
BEFORE = {"doc_id": 1, "sentence_id": 1, "page": 1, "sentence": "a b", "schema_version": "1.0", "mapping_provenance": None, "curated_sentence": None, "tokens": ["a", "b"], "entities": [("age", "#1"), ("age", "#1"), ("social", None)]}


@pytest.mark.parametrize(
    ("change", "issues"),
    [
        ({}, []),
        ({"sentence": "a c", "page": 2, "schema_version": None, "sentence_id": 4, "mapping_provenance": ("m", "approved")}, [("immutable_field_changed", x) for x in ("mapping_provenance", "page", "schema_version", "sentence", "sentence_id")]),
        ({"tokens": ["a"]}, [("tokens_changed", "tokens")]),
        ({"tokens": ["a"], "curated_sentence": "a"}, []),
        ({"entities": [("age", "#1"), ("social", None)], "excluded": [1]}, []),
        ({"entities": [("age", "#1"), ("social", None)], "excluded": [1, 1]}, []),
        ({"entities": [("age", "#1"), ("social", None)]}, [("removal_not_named", "entities")]),
        ({"entities": [("age", "#1"), ("social", None)], "excluded": [2]}, [("labels_or_colors_changed", "entities")]),
        ({"entities": [("age", "#1")] * 4}, [("entity_added", "entities")]),
        ({"entities": [("age", "#1"), ("age", "#2"), ("social", None)]}, [("labels_or_colors_changed", "entities")]),
        ({"entities": [("social", None), ("age", "#1"), ("age", "#1")]}, []),
        ({"excluded": [3]}, [("excluded_out_of_range", "excluded")]),
        ({"excluded": [-1]}, [("excluded_out_of_range", "excluded")]),
        ({"entities": [], "excluded": [0, 1, 2]}, []),
        ({"place": 9}, [("not_exactly_one_record", None)]),
    ],
)
def test_guarded_edits(spark, change, issues):
    before = spark.createDataFrame([BEFORE], RECORD)
    after = spark.createDataFrame([{**BEFORE, "place": 1, "excluded": [], **change}], RECORD + ", place int, excluded array<int>")
    assert sorted((r.code, r.field) for r in registry.edit_issues(before, after).collect()) == issues


def test_two_records_of_one_number(spark):
    before = spark.createDataFrame([BEFORE, BEFORE], RECORD)
    after = spark.createDataFrame([{**BEFORE, "place": 1, "excluded": []}], RECORD + ", place int, excluded array<int>")
    assert [r.code for r in registry.edit_issues(before, after).collect()] == ["not_exactly_one_record"]


def approvals(spark, *events):
    kind = "doc_id int, seq long, kind string, actor string, candidate_id string, decision string, license string, statement string"
    rows = [(1, n, *e, *[None] * (6 - len(e))) for n, e in enumerate(events)]
    people = spark.createDataFrame([("o", ["data_owner"]), ("c", ["curator"])], "person_id string, roles array<string>")
    return [(r.outcome, r.current) for r in review_events.approvals(spark.createDataFrame(rows, kind), people).orderBy("seq").collect()]


def test_approvals(spark):
    made, accepted, good = ("candidate", None, "k1"), ("curate", "c", "k1", "accepted"), ("approve", "o", "k1", None, "CC", "fine")
    assert approvals(spark, made, accepted, good) == [("applied", True)]
    assert approvals(spark, made, accepted, good, good) == [("applied", False), ("applied", True)]
    assert approvals(spark, made, accepted, good, ("evidence", None), good) == [("applied", False), ("candidate_stale", False)]
    assert approvals(spark, made, accepted, good, ("candidate", None, "k2"), good, ("approve", "o", "k2", None, "CC", "fine")) == [("applied", False), ("other_candidate", False), ("candidate_not_accepted", False)]
    assert approvals(spark, good, made, good, ("curate", "c", "k1", "rejected"), good) == [("no_candidate", False), ("candidate_not_accepted", False), ("candidate_not_accepted", False)]
    assert approvals(spark, made, accepted, ("approve", "c", "k1", None, "CC", "fine"), ("approve", "x", "k1", None, "CC", "fine"), ("approve", "o", "k1", None, " ", "fine"), ("approve", "o", "k1", None, "CC", None)) == [("not_a_data_owner", False), ("unknown_person", False), ("license_required", False), ("statement_required", False)]


# --- ruled cells ---------------------------------------------------------------------------


def cells(spark, *lines):
    df = spark.createDataFrame([(1, *map(float, x)) for x in lines], "page int, x0 double, y0 double, x1 double, y1 double")
    return [(r.x0, r.y0, r.x1, r.y1) for r in ruling.ruled_cells(df, "page").orderBy("cell").collect()]


def grid(xs, ys):
    return [(xs[0], y, xs[-1], y) for y in ys] + [(x, ys[0], x, ys[-1]) for x in xs]


def test_a_grid(spark):
    assert cells(spark, *grid([0, 50, 100], [0, 20, 40])) == [(0, 0, 50, 20), (50, 0, 100, 20), (0, 20, 50, 40), (50, 20, 100, 40)]


def test_askew_lines_in_pieces(spark):
    lines = [(0, 1, 48, 1), (100, 0, 50, 0), (0, 20, 100, 21), (0, 40, 100, 40), (1, 0, 0, 40), (51, 0, 51, 20), (50, 22, 50, 41), (100, 40, 100, 0), (0, 0, 70, 90), (5, 5, 5, 5)]
    assert len(cells(spark, *lines)) == 4


def test_rows_and_columns_alone_are_no_tables(spark):
    assert cells(spark, *grid([0, 50, 100], [0, 20])) == [] and cells(spark, *grid([0, 50], [0, 20, 40])) == [] and cells(spark, (0, 0, 9, 0)) == []
    both = grid([0, 50, 100], [0, 20]) + grid([200, 250], [0, 20, 40])  # a row and a column apart make no table together
    assert cells(spark, *both) == []


def test_joined_cells(spark):
    lines = [(0, 0, 100, 0), (0, 20, 100, 20), (0, 40, 100, 40), (0, 0, 0, 40), (50, 20, 50, 40), (100, 0, 100, 40)]
    assert cells(spark, *lines) == [(0, 0, 100, 20), (0, 20, 50, 40), (50, 20, 100, 40)]


def test_an_open_cell(spark):
    lines = [x for x in grid([0, 50, 100], [0, 20, 40]) if x != (100, 0, 100, 40)] + [(100, 0, 100, 20)]
    assert cells(spark, *lines) == [(0, 0, 50, 20), (50, 0, 100, 20), (0, 20, 50, 40)]


def test_lines_that_hang_together_far_away(spark):
    stairs = [line for k in range(6) for line in grid([k * 40, k * 40 + 40], [k * 20, k * 20 + 20])]
    assert len(cells(spark, *stairs)) == 6  # corner by corner, one table
    df = spark.createDataFrame([(1, *map(float, x)) for x in stairs], "page int, x0 double, y0 double, x1 double, y1 double")
    assert ruling.ruled_cells(df.limit(0), "page").count() == 0
    assert ruling.ruled_cells(df.withColumn("h", F.lit(1)).withColumn("place", F.lit(1)), "page").count() == 6
