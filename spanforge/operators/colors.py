"""Colour configurations: observed colours, their labels, and drafts compiled with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def observed(records: DataFrame, *keys: str) -> DataFrame:
    """Distinct upper-case colours of entities."""
    return records.select(*keys, F.explode("entities").alias("e")).select(*keys, F.upper("e.color").alias("hex")).filter("hex is not null").distinct()


def unmapped(colors: DataFrame, palette: DataFrame, *keys: str) -> DataFrame:
    """Observed colours that the palette neither labels nor ignores."""
    settled = palette.filter("label is not null or status = 'ignored'").select(*keys, F.upper("hex").alias("hex"))
    return colors.join(settled, [*keys, "hex"], "left_anti")


def with_new_colors(palette: DataFrame, colors: DataFrame, key: str) -> DataFrame:
    """The palette and newly observed colours as pending; confirmed falls where something was added."""
    new = colors.join(palette.select(key, "hex"), [key, "hex"], "left_anti")
    added = new.select(key, "hex", F.lit(None).cast("string").alias("label"), F.lit("pending").alias("status"))
    touched = new.select(key).distinct().withColumn("reset", F.lit(True))
    out = palette.select(key, "hex", "label", "status").unionByName(added).join(touched, key, "left")
    return out.withColumn("confirmed", F.col("reset").isNull()).drop("reset")


def chosen_labels(colors: Column, confirmed: Column, authorised: Column) -> Column:
    """Map of hex to label: approved labels if confirmed, else suggestions if authorised, else null.

    colors: array of (hex, label, suggestion, status).
    """
    pick = lambda field, status: F.map_from_entries(
        F.transform(F.filter(colors, lambda c: c.getField("status").isin(*status) & c.getField(field).isNotNull()), lambda c: F.struct(F.upper(c.getField("hex")), c.getField(field)))
    )
    return F.when(confirmed, pick("label", ["approved"])).when(authorised, pick("suggestion", ["pending", "approved"]))


def resolve(colors: DataFrame, *tables: tuple[str, DataFrame]) -> DataFrame:
    """(hex, label, method): the first table in the given order that has the colour; manual if none does."""
    out = colors
    for name, t in tables:
        out = out.join(F.broadcast(t.select(F.upper("hex").alias("hex"), F.col("label").alias(f"_{name}"))) if t.isLocal() else t.select(F.upper("hex").alias("hex"), F.col("label").alias(f"_{name}")), "hex", "left")
    label = F.coalesce(*[F.col(f"_{n}") for n, _ in tables])
    method = F.coalesce(*[F.when(F.col(f"_{n}").isNotNull(), F.lit(n)) for n, _ in tables], F.lit("manual"))
    return out.select("hex", label.alias("label"), method.alias("method"))


def compile_draft(records: DataFrame, labels: Column, ignored: Column) -> DataFrame:
    """Colours of entities and tags become labels.

    labels: map of hex to label, ignored: array of hex; both may differ by row.
    Entities of ignored colours go, with their tags; values are the labels left;
    sentences without an entity go; unresolved lists colours that are neither.
    """
    hexes = F.transform("entities", lambda e: F.upper(e.getField("color")))
    unresolved = F.array_sort(F.array_distinct(F.filter(hexes, lambda h: F.element_at(labels, h).isNull() & ~F.array_contains(ignored, h))))
    kept = F.filter("entities", lambda e: F.element_at(labels, F.upper(e.getField("color"))).isNotNull())
    entities = F.transform(kept, lambda e: F.struct(e.getField("start").alias("start"), e.getField("end").alias("end"), e.getField("text").alias("text"), F.element_at(labels, F.upper(e.getField("color"))).alias("label"), F.upper(e.getField("color")).alias("color")))
    tag = lambda t: F.when(t == "O", t).otherwise(F.coalesce(F.concat(F.substring(t, 1, 2), F.element_at(labels, F.upper(F.substring(t, 3, 7)))), F.lit("O")))
    out = records.withColumn("unresolved", unresolved).withColumn("ner_tags", F.transform("ner_tags", tag)).withColumn("entities", entities)
    out = out.withColumn("values", F.array_sort(F.array_distinct(F.transform("entities", lambda e: e.getField("label")))))
    return out.filter((F.size("entities") > 0) | (F.size("unresolved") > 0))


def palette_conflicts(palette: DataFrame, *keys: str) -> DataFrame:
    """Colours with two labels or more, by configuration."""
    return palette.groupBy(*keys, F.upper("hex").alias("hex")).agg(F.countDistinct("label").alias("labels")).filter("labels > 1")


def shared_palette(palette: DataFrame, document: str) -> DataFrame:
    """One row: whether all documents have the same colours and labels, and all are confirmed."""
    each = palette.groupBy(document).agg(F.array_sort(F.collect_set(F.concat_ws("=", F.upper("hex"), "label"))).alias("p"), F.bool_and("confirmed").alias("confirmed"))
    return each.agg((F.countDistinct("p") <= 1).alias("same"), F.coalesce(F.bool_and("confirmed"), F.lit(True)).alias("confirmed"))


def batch_issues(palette: DataFrame, document: str) -> DataFrame:
    one = shared_palette(palette, document)
    codes = F.array_compact(F.array(F.when(~F.col("same"), "batch_palette_mismatch"), F.when(~F.col("confirmed"), "shared_mapping_unconfirmed")))
    return one.select(F.explode(codes).alias("code"))


def decision_issues(colors: DataFrame, decisions: DataFrame) -> DataFrame:
    """(hex, code): colours without a decision, decisions without a colour, twice decided, or with both or neither of label and reason."""
    found = colors.select(F.upper("hex").alias("hex"), F.lit(1).alias("seen")).distinct()
    made = decisions.groupBy(F.upper("hex").alias("hex")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label").isNotNull() == F.col("reason").isNotNull()).alias("odd"))
    joined = found.join(made, "hex", "full_outer")
    codes = F.array_compact(F.array(F.when(F.col("n").isNull(), "missing_decision"), F.when(F.col("seen").isNull(), "unknown_color"), F.when(F.col("n") > 1, "duplicate_decision"), F.when(F.col("odd") > 0, "label_xor_reason")))
    return joined.select("hex", F.explode(codes).alias("code"))


def evidence(records: DataFrame, most: int = 25, *keys: str) -> DataFrame:
    """For each colour, its first distinct sentences in order, up to a number that is the feature (top-k).

    The order is found by a window over distinct pairs, which keeps `most` rows a group.
    """
    pairs = records.select(*keys, "sentence", F.explode("entities").alias("e")).select(*keys, F.upper("e.color").alias("hex"), "sentence").filter("hex is not null").distinct()
    order = Window.partitionBy(*keys, "hex").orderBy("sentence")
    top = pairs.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most)
    return top.groupBy(*keys, "hex").agg(F.array_sort(F.collect_list("sentence")).alias("sentences"))


def occurrences(records: DataFrame, *keys: str) -> DataFrame:
    """(hex, keys, start, end): every place of every colour."""
    return records.select(*keys, F.explode("entities").alias("e")).select(F.upper("e.color").alias("hex"), *keys, "e.start", "e.end")


# --- versioned palettes ------------------------------------------------------------------


def next_version(versions: DataFrame, configuration: str) -> int:
    """One more than the highest version; 1 for a new configuration."""
    return versions.filter(F.col("configuration_id") == configuration).agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("v")).first()["v"]


def append_version(versions: DataFrame, colors: DataFrame, configuration: str) -> DataFrame:
    """Versions with a further immutable one."""
    new = colors.select(F.lit(configuration).alias("configuration_id"), F.lit(next_version(versions, configuration)).alias("version"), "hex", "label")
    return versions.select("configuration_id", "version", "hex", "label").unionByName(new)


def selected_version(versions: DataFrame, pointers: DataFrame) -> DataFrame:
    """Colours of the version that each configuration's pointer names."""
    return versions.join(pointers, ["configuration_id", "version"])
