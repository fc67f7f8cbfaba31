"""Registries kept as events: people, annotators, citations with history, tombstones and confirmation.

events: registry, seq, op, key, fields (a struct of texts).  Operations are add,
update, remove, activate and confirm.  Fields are trimmed, blank ones are null.  What
an event is refused for depends on the key's own events; everything else is an
aggregate, so registries may be large and keys busy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPS = ["add", "update", "remove", "activate", "confirm"]


def cleaned(fields: Column, names: list[str]) -> Column:
    """Texts without white space at their ends; blank ones become null."""
    text = lambda n: F.trim(fields.getField(n))
    return F.struct(*[F.when(text(n) != "", text(n)).alias(n) for n in names])


def judged(events: DataFrame, required: str = "name") -> DataFrame:
    """Events with clean fields and outcome: applied, or why not: unknown_operation, key_required, a required field, exists, does_not_exist."""
    names = events.schema["fields"].dataType.names
    rows = events.withColumn("fields", cleaned(F.col("fields"), names))
    op = F.col("op")
    lacking = op.isin("add", "update") & F.coalesce(F.col("fields").getField(required).isNull(), F.lit(True))
    order = Window.partitionBy("registry", "key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    there = F.coalesce(F.last(F.when((op == "add") & ~lacking, True).when(op == "remove", False), ignorenulls=True).over(order), F.lit(False))
    rows = rows.withColumn("there", there)
    outcome = (
        F.when(~F.coalesce(op.isin(*OPS), F.lit(False)), "unknown_operation")
        .when(F.col("key").isNull(), "key_required")
        .when(lacking, f"{required}_required")
        .when((op == "add") & F.col("there"), "exists")
        .when((op != "add") & ~F.col("there"), "does_not_exist")
        .otherwise("applied")
    )
    return rows.withColumn("outcome", outcome).drop("there")


def history(judged_: DataFrame) -> DataFrame:
    """(registry, key, version, valid_from, valid_to, fields, confirmed_at): every version of every key.

    valid_to is when the next version or the removal came, null while it holds.  An
    update that changes nothing makes no version and leaves a confirmation; any change
    takes it away.
    """
    good = judged_.filter("outcome = 'applied'")
    order = Window.partitionBy("registry", "key").orderBy("seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    given = F.when(F.col("op").isin("add", "update"), F.col("fields")).when(F.col("op") == "remove", F.lit(None))
    was = F.last(F.when(F.col("op").isin("add", "update"), F.col("fields")), ignorenulls=True).over(before)
    rows = good.withColumn("was", was).withColumn("changes", (F.col("op") == "add") | (F.col("op") == "remove") | ((F.col("op") == "update") & ~given.eqNullSafe(F.col("was"))))
    rows = rows.withColumn("step", F.sum(F.col("changes").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    steps = rows.groupBy("registry", "key", "step").agg(F.min("seq").alias("valid_from"), F.min_by("op", "seq").alias("op"), F.min_by("fields", "seq").alias("fields"), F.max(F.when(F.col("op") == "confirm", F.col("seq"))).alias("confirmed_at"))
    by_step = Window.partitionBy("registry", "key").orderBy("step")
    steps = steps.withColumn("valid_to", F.lead("valid_from").over(by_step)).filter("op <> 'remove'")
    return steps.select("registry", "key", F.row_number().over(by_step).alias("version"), "valid_from", "valid_to", "fields", "confirmed_at")


def current(judged_: DataFrame) -> DataFrame:
    """(registry, key, fields, confirmed, active): what is there after all events.

    Adding or activating makes a key the active one; if it has been removed since, the
    one that was added first of those that are left is.
    """
    good = judged_.filter("outcome = 'applied'")
    now = history(judged_).filter("valid_to is null")
    chosen = good.filter("op in ('add', 'activate')").groupBy("registry").agg(F.max_by("key", "seq").alias("chosen"), F.max("seq").alias("chosen_at"))
    added = good.filter("op = 'add'").groupBy("registry", "key").agg(F.max("seq").alias("added"))
    removed = good.filter("op = 'remove'").groupBy("registry", "key").agg(F.max("seq").alias("removed"))
    kept = now.join(added, ["registry", "key"])
    first = kept.groupBy("registry").agg(F.min_by("key", "added").alias("first"))
    still = chosen.join(removed.withColumnRenamed("key", "chosen"), ["registry", "chosen"], "left").select("registry", F.when(F.col("removed").isNull() | (F.col("removed") < F.col("chosen_at")), F.col("chosen")).alias("still"))
    with_active = kept.join(first, "registry").join(still, "registry", "left")
    return with_active.select("registry", "key", "fields", F.col("confirmed_at").isNotNull().alias("confirmed"), (F.col("key") == F.coalesce("still", "first")).alias("active"))
