"""Versions, places in files, archives and registries with history."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from spanforge.operators import dimensions
from spanforge.session import kept
from spanforge.sources import archive, packages, sinks
from spanforge.sources.ordinals import numbered, order_differences, ordered_fingerprint
from spanforge.sources.versions import VersionConflict, VersionedTable


def values(df):
    return sorted(r.x for r in df.collect())


@pytest.fixture
def versions(spark, tmp_path):
    return VersionedTable(spark, str(tmp_path / "table"))


def numbers(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "x int")


def negative(rows):
    return rows.filter("x < 0")


def test_versions_follow_each_other(spark, versions):
    assert versions.version() == 0 and versions.log() == [] and versions.archive() == []
    with pytest.raises(LookupError):
        versions.read()
    assert versions.write(numbers(spark, 1, 2), negative, "first") == 1 and versions.write(numbers(spark, 3)) == 2
    assert values(versions.read()) == [3] and values(versions.read(1)) == [1, 2]
    assert [(e["version"], e["action"], e["note"], e["rows"]) for e in versions.log()] == [(1, "write", "first", 2), (2, "write", "", 1)]
    assert versions.restore(1) == 3 and values(versions.read()) == [1, 2]
    assert [e["version"] for e in versions.archive()] == [2]


def test_a_failed_write_leaves_the_former_version(spark, versions):
    versions.write(numbers(spark, 1))
    with pytest.raises(ValueError, match="don't pass"):
        versions.write(numbers(spark, 1, -2), negative)
    broken = numbers(spark, 1, 0).select(F.when(F.col("x") == 0, F.raise_error(F.lit("torn"))).otherwise(F.col("x")).cast("int").alias("x"))
    with pytest.raises(Exception, match="torn"):
        versions.write(broken)
    assert versions.version() == 1 and values(versions.read()) == [1]
    assert len(versions._names("data")) == 1 and versions._names("staged") == []


def test_drafts(spark, versions):
    versions.write(numbers(spark, 1))
    mine, other = versions.draft(numbers(spark, 5)), versions.draft(numbers(spark, 6))
    assert values(versions.read()) == [1] and values(versions.rows_of(mine)) == [5]
    assert versions.publish(mine, negative, former=1) == 2
    with pytest.raises(VersionConflict):
        versions.publish(other, former=1)  # it was made from version 1
    versions.discard(mine)  # is published, so it stays
    assert values(versions.read()) == [5] and versions._names("staged") == []
    versions.discard(other)
    assert len(versions._names("data")) == 2


def test_reset_and_prune(spark, versions):
    versions.write(numbers(spark, 1))
    versions.write(numbers(spark, 2))
    assert versions.reset("anew") == 3
    with pytest.raises(LookupError, match="reset"):
        versions.read()
    assert [e["version"] for e in versions.archive()] == [1, 2]
    assert versions.restore(2) == 4 and values(versions.read()) == [2]
    assert len(versions.prune()) == 1
    with pytest.raises(LookupError):
        versions.restore(1)
    assert values(versions.read()) == [2] and versions.archive() == []


# --- places in files -----------------------------------------------------------------------


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_rows_know_their_place(spark, tmp_path, small_splits):
    sizes = {"b": 900, "a": 7, "c": 350}
    for name, n in sizes.items():
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"id": f"{name}{i}", "n": i}) + "\n" for i in range(n)))
    raw = spark.read.json(str(tmp_path))
    assert raw.rdd.getNumPartitions() > 10
    got = numbered(raw).collect()
    assert len(got) == sum(sizes.values()) and all(r.ord == r.n for r in got)
    rows = packages.read_split(spark, str(tmp_path))
    assert {(r.part, r.n) for r in rows.filter("ord <> n").collect()} == set() and {r.part for r in rows.collect()} == set(sizes)


def test_of_equal_records_the_files_first_counts(spark, tmp_path, small_splits):
    head = "document_id,sentence_id,page,sentence,tokens,values,entities,ner_tags\n"
    row = lambda i, text: f'd,{i},1,{text},"[""a""]",[],[],"[""O""]"\n'
    folder = tmp_path / "p"
    folder.mkdir()
    (folder / "annotations.csv").write_text(head + "".join(row(i % 100, f"text {i}") for i in range(300)))
    got = packages.load_examples(packages.read_packages(spark, str(tmp_path))).filter("problem is null").collect()
    assert {r.text for r in got} == {f"text {i}" for i in range(100)} and len(got) == 100


def test_order_counts(spark, tmp_path):
    rows = spark.createDataFrame([("a", i, f"x{i % 7}") for i in range(50)] + [("b", 0, "y")], "part string, ord long, id string")
    swapped = rows.withColumn("ord", F.when(F.col("ord") == 3, 4).when(F.col("ord") == 4, 3).otherwise(F.col("ord")).cast("long"))
    prints = lambda df: {r.part: (r.rows, r.a, r.b) for r in ordered_fingerprint(df, ["id"], "part").collect()}
    assert prints(rows) == prints(rows.repartition(5)) and prints(rows)["a"] != prints(swapped)["a"] and prints(rows)["b"] == prints(swapped)["b"]
    assert [(r.part, r.ord, r.code) for r in order_differences(rows, swapped, ["id"], "part").orderBy("ord").collect()] == [("a", 3, "other_row"), ("a", 4, "other_row")]
    assert [(r.ord, r.code) for r in order_differences(rows.filter("ord <> 9"), rows.filter("ord <> 8"), ["id"], "part").orderBy("ord").collect()] == [(8, "missing"), (9, "added")]
    with pytest.raises(ValueError, match="differs"):
        sinks.write_split(rows, str(tmp_path / "no"), published=swapped)
    sinks.write_split(rows, str(tmp_path / "yes"), published=rows.repartition(3))


# --- archives ------------------------------------------------------------------------------


def test_archives_equal_the_serial_ones(spark, tmp_path):
    files = {f"d{i % 5}/f{i}.txt": (f"text {i} " * (i * 37 % 400)).encode() for i in range(60)} | {"é.json": b"{}", "empty": b"", "a": bytes(range(256)) * 50}
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(files):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), files[name], zipfile.ZIP_DEFLATED)
    df = spark.createDataFrame(list(files.items()), "name string, content binary")
    for n, parts in enumerate((1, 7)):
        size = archive.write_zip(df.repartition(parts), str(tmp_path / f"{n}.zip"), kept(spark))
        written = (tmp_path / f"{n}.zip").read_bytes()
        assert len(written) == size and written == buffer.getvalue()
    assert archive.write_zip(df.limit(0), str(tmp_path / "none.zip"), kept(spark)) == 22
    assert zipfile.ZipFile(tmp_path / "none.zip").namelist() == []


# --- registries ----------------------------------------------------------------------------


def registry(spark, *events):
    rows = [("r", n, op, key, fields) for n, (op, key, *rest) in enumerate(events) for fields in [rest[0] if rest else None]]
    df = spark.createDataFrame(rows, "registry string, seq long, op string, key string, fields struct<name:string,mail:string>").repartition(2)
    judged = dimensions.judged(df)
    now = {r.key: (r.fields.name, r.fields.mail, r.confirmed, r.active) for r in dimensions.current(judged).collect()}
    past = sorted((r.key, r.version, r.valid_from, r.valid_to, r.fields.name, r.confirmed_at) for r in dimensions.history(judged).collect())
    return [r.outcome for r in judged.orderBy("seq").collect()], now, past


def test_add_update_and_activate(spark):
    outcomes, now, past = registry(spark, ("add", "a", (" First ", None)), ("add", "b", ("Second", " ")), ("update", "a", ("First Updated", " f@x ")), ("activate", "a"))
    assert outcomes == ["applied"] * 4
    assert now == {"a": ("First Updated", "f@x", False, True), "b": ("Second", None, False, False)}
    assert past == [("a", 1, 0, 2, "First", None), ("a", 2, 2, None, "First Updated", None), ("b", 1, 1, None, "Second", None)]


def test_what_is_refused(spark):
    outcomes, now, _ = registry(spark, ("add", "a", ("  ", None)), ("update", "a", ("x", None)), ("remove", "a"), ("add", "a", ("x", None)), ("add", "a", ("y", None)), ("update", "a", (None, "m")), ("add", None, ("x", None)), ("burn", "a"), ("activate", "b"))
    assert outcomes == ["name_required", "does_not_exist", "does_not_exist", "applied", "exists", "name_required", "key_required", "unknown_operation", "does_not_exist"]
    assert now == {"a": ("x", None, False, True)}


def test_removal_of_the_active_one(spark):
    add = lambda k: ("add", k, (k.upper(), None))
    assert {k: v[3] for k, v in registry(spark, add("a"), add("b"), ("remove", "b"))[1].items()} == {"a": True}
    assert {k: v[3] for k, v in registry(spark, add("a"), add("b"), add("c"), ("remove", "c"), ("remove", "a"))[1].items()} == {"b": True}
    assert {k: v[3] for k, v in registry(spark, add("a"), add("b"), ("activate", "a"), ("remove", "b"))[1].items()} == {"a": True}
    assert registry(spark, add("a"), ("remove", "a"))[1] == {}
    outcomes, now, past = registry(spark, add("a"), add("b"), ("remove", "a"), add("a"))
    assert {k: v[3] for k, v in now.items()} == {"a": True, "b": False} and [p[:4] for p in past if p[0] == "a"] == [("a", 1, 0, 2), ("a", 2, 3, None)]


def test_a_change_takes_a_confirmation_away(spark):
    add = ("add", "a", ("A", "m"))
    assert registry(spark, add, ("confirm", "a"))[1]["a"][2] is True
    assert registry(spark, add, ("confirm", "a"), ("update", "a", (" A ", "m")))[1]["a"][2] is True
    outcomes, now, past = registry(spark, add, ("confirm", "a"), ("update", "a", ("A", None)))
    assert now["a"] == ("A", None, False, True) and [p[5] for p in past] == [1, None]
