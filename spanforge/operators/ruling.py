"""Table cells from ruling lines: snap, merge, cross, close.

Lines of a page that are nearly level are put on common heights, and pieces of one
line are merged, by sorted sweeps.  Where an upright line meets a level one is a
point.  A cell hangs on its upper left point: the next point to the right from
which a line goes down, the next point below from which a line goes right, and the
point where those two lines meet.  Cells of lines that hang together are a table;
tables of one row or one column are none.

Lines meet by an equality join on strips; connected lines are found by passing the
least name on until nothing changes, with a written table for each round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.operators.layout import STRIP

#: Distances below which lines stand on one height, pieces of a line touch, and lines meet.
SNAP, JOIN, MEET = 3.0, 3.0, 3.0


def straight(lines: DataFrame, *keys: str) -> DataFrame:
    """(keys, level, place, low, high): level and upright lines, snapped and merged.

    lines: keys, x0, y0, x1, y1 in any direction; slanted ones go.  place is the height
    of a level line or the distance of an upright one, the least of those that stand
    within SNAP of their neighbour; low and high are the ends of a merged line.
    """
    x0, x1, y0, y1 = F.least("x0", "x1"), F.greatest("x0", "x1"), F.least("y0", "y1"), F.greatest("y0", "y1")
    level, upright = (y1 - y0 <= SNAP) & (x1 - x0 > SNAP), (x1 - x0 <= SNAP) & (y1 - y0 > SNAP)
    rows = lines.select(*keys, F.when(level, True).when(upright, False).alias("level"), F.when(level, y0).otherwise(x0).cast("double").alias("place"), F.when(level, x0).otherwise(y0).cast("double").alias("low"), F.when(level, x1).otherwise(y1).cast("double").alias("high")).filter("level is not null")
    side = [*keys, "level"]
    by_place = Window.partitionBy(*side).orderBy("place")
    apart = F.coalesce(F.col("place") - F.lag("place").over(by_place) > SNAP, F.lit(True)).cast("int")
    rows = rows.withColumn("apart", apart).withColumn("cluster", F.sum("apart").over(by_place))
    same = Window.partitionBy(*side, "cluster")
    along = same.orderBy("low", "high")
    reach = F.max("high").over(along.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("snapped", F.min("place").over(same)).withColumn("gap", F.coalesce(F.col("low") > reach + JOIN, F.lit(True)).cast("int"))
    rows = rows.withColumn("piece", F.sum("gap").over(along))
    return rows.groupBy(*side, "cluster", "piece").agg(F.min("snapped").alias("place"), F.min("low").alias("low"), F.max("high").alias("high")).select(*side, "place", "low", "high")


def crossings(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, h, v, x, y, right, down): points where a level line h meets an upright one v, and whether they go on from there."""
    name = F.concat_ws(":", F.when(F.col("level"), "h").otherwise("v"), "place", "low")
    named = rows.withColumn("name", name)
    h = named.filter("level").select(*keys, F.col("name").alias("h"), F.col("place").alias("y"), F.col("low").alias("hl"), F.col("high").alias("hh"), F.floor(F.col("place") / STRIP).alias("strip"))
    reach = F.sequence(F.floor((F.col("low") - MEET) / STRIP), F.floor((F.col("high") + MEET) / STRIP))
    v = named.filter("not level").select(*keys, F.col("name").alias("v"), F.col("place").alias("x"), F.col("low").alias("vl"), F.col("high").alias("vh"), F.explode(reach).alias("strip"))
    met = h.join(v, [*keys, "strip"]).filter(F.col("x").between(F.col("hl") - MEET, F.col("hh") + MEET) & F.col("y").between(F.col("vl") - MEET, F.col("vh") + MEET))
    return met.select(*keys, "h", "v", "x", "y", (F.col("hh") > F.col("x") + MEET).alias("right"), (F.col("vh") > F.col("y") + MEET).alias("down"))


def connected(edges: DataFrame, keep, *keys: str) -> DataFrame:
    """(keys, h, table): the least name among the lines that hang together with each level line.

    keep writes a table and reads it again.  Rounds go on until no name changes; two
    rounds do for a full grid.
    """
    edges = keep(edges.select(*keys, "h", "v").distinct())
    names = edges.select(*keys, "h", F.col("h").alias("table")).distinct()
    while True:
        of_v = edges.join(names, [*keys, "h"]).groupBy(*keys, "v").agg(F.min("table").alias("table"))
        of_h = edges.join(of_v, [*keys, "v"]).groupBy(*keys, "h").agg(F.min("table").alias("table"))
        after = keep(of_h)
        changed = after.join(names.withColumnRenamed("table", "former"), [*keys, "h"]).filter("table <> former")
        done = changed.isEmpty()
        names = after
        if done:
            return names


def ruled_cells(lines: DataFrame, *keys: str, keep=lambda df: df.checkpoint()) -> DataFrame:
    """(keys, table, cell, x0, y0, x1, y1): cells of tables with two rows and two columns at least, in order of place on the page.

    lines: keys and x0, y0, x1, y1 of drawn lines.  Lines without length, with a null
    or slanted go; repeated lines are one; a page without a grid has no rows.
    """
    points = keep(crossings(straight(lines, *keys), *keys))
    ahead = lambda w, c: F.first(c, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    on_h, on_v = Window.partitionBy(*keys, "h").orderBy("x"), Window.partitionBy(*keys, "v").orderBy("y")
    right: Column = ahead(on_h, F.when(F.col("down"), F.struct("v", "x")))
    below: Column = ahead(on_v, F.when(F.col("right"), F.struct("h", "y")))
    hung = points.withColumn("r", right).withColumn("b", below).filter("right and down and r is not null and b is not null")
    corners = points.select(*keys, F.col("h").alias("bh"), F.col("v").alias("rv"))
    closed = hung.select(*keys, "h", "x", "y", F.col("r.v").alias("rv"), F.col("r.x").alias("x1"), F.col("b.h").alias("bh"), F.col("b.y").alias("y1")).join(corners, [*keys, "bh", "rv"], "left_semi")
    cells = closed.join(connected(points, keep, *keys), [*keys, "h"])
    shapes = cells.groupBy(*keys, "table").agg(F.countDistinct("y").alias("rows"), F.countDistinct("x").alias("columns")).filter("rows > 1 and columns > 1")
    found = cells.join(shapes.select(*keys, "table"), [*keys, "table"], "left_semi")
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("y", "x")) - 1
    return found.select(*keys, "table", number.alias("cell"), F.col("x").alias("x0"), F.col("y").alias("y0"), "x1", "y1")
