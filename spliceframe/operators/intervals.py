"""Interval operators: atomic split, merge, point numbers, containment, range and overlap joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def atomic_split(intervals: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Closed intervals of each key -> rows (keys, start, end): the disjoint pieces of their union, cut at every start
    and end. Pieces of one base are dropped. Coverage is a running sum of starts less ends, so no join is needed."""
    marks = intervals.select(*keys, F.col(start).alias("at"), F.lit(1).alias("d")).union(
        intervals.select(*keys, (F.col(end) + 1).alias("at"), F.lit(-1).alias("d"))
    )
    steps = marks.groupBy(*keys, "at").agg(F.sum("d").alias("d"))
    order = Window.partitionBy(*keys).orderBy("at")
    return (
        steps.withColumn("depth", F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("next", F.lead("at").over(order))
        .where("depth > 0 and next - 1 > at")
        .select(*keys, F.col("at").alias("start"), (F.col("next") - 1).alias("end"))
    )


def merge(intervals: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Union of each key's closed intervals as rows (keys, start, end); those that share a base are one."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return (
        intervals.withColumn("new", F.coalesce((F.col(start) > reach).cast("int"), F.lit(1)))
        .withColumn("island", island)
        .groupBy(*keys, "island")
        .agg(F.min(start).alias("start"), F.max(end).alias("end"))
        .drop("island")
    )


def number_points(intervals: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """rows (keys, at, point): the distinct border coordinates of each key, numbered from 0."""
    points = intervals.select(*keys, F.explode(F.array(start, end)).alias("at")).distinct()
    return points.withColumn("point", F.dense_rank().over(Window.partitionBy(*keys).orderBy("at")) - 1)


def contained_in(pieces: DataFrame, holders: DataFrame, keys: list[str]) -> DataFrame:
    """Each piece with each holder of its key that contains it; both have start and end, the holder's other columns
    are kept."""
    h = holders.withColumnsRenamed({"start": "h_start", "end": "h_end"})
    return pieces.join(h, keys).where("start >= h_start and end <= h_end").drop("h_start", "h_end")


def bin_width(ranges: DataFrame, low: Column, high: Column, least: int = 16) -> int:
    """Twice the mean length of the ranges: most then touch one or two bins, and bins stay small."""
    mean = ranges.agg(F.avg(high - low)).first()[0]
    return max(least, int(2 * (mean or 0)))


def range_join(
    points: DataFrame, ranges: DataFrame, keys: list[str], at: Column, low: Column, high: Column, where: Column, width: int | None = None
) -> DataFrame:
    """Rows of points and ranges with equal keys and `where`, which must imply low <= at <= high.

    Spark has no interval join: ranges are spread over the bins of `width` (taken from their lengths if not given) that
    they touch, points are in one bin, and the bins meet in an equi-join. Each pair meets once, as a point has one bin.
    """
    width = width or bin_width(ranges, low, high)
    spread = ranges.withColumn("_bin", F.explode(F.sequence(F.floor(low / width), F.floor(high / width))))
    return points.withColumn("_bin", F.floor(at / width)).join(spread, [*keys, "_bin"]).where(where).drop("_bin")


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], tolerance: int = 0, width: int | None = None) -> DataFrame:
    """Pairs of left (start, end) and right (r_start, r_end) with equal keys whose closed intervals, with tolerance at
    either end, overlap. Both sides are spread over bins; a pair counts in the first bin that both touch."""
    width = width or bin_width(left, F.col("start") - tolerance, F.col("end") + tolerance)
    spread = lambda df, s, e, t: df.withColumn(
        "_bin", F.explode(F.sequence(F.floor((F.col(s) - t) / width), F.floor((F.col(e) + t) / width)))
    )
    a, b = spread(left, "start", "end", tolerance), spread(right, "r_start", "r_end", 0)
    met = a.join(b, [*keys, "_bin"]).where(
        (F.col("r_start") < F.col("end") + tolerance + int(tolerance == 0))
        & (F.col("r_end") + 1 > F.col("start") - tolerance)
    )
    first = F.greatest(F.floor((F.col("start") - tolerance) / width), F.floor(F.col("r_start") / width))
    return met.where(F.col("_bin") == first).drop("_bin")


def as_of(points: DataFrame, table: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """Distinct points (keys, at) plus values: those of the row of table (keys, at, values) with the greatest `at` up to
    the point's, null where there is none. One pass over both, sorted by key: no bins and no pairs. Of rows of the table
    with equal keys and at, the one of the greatest values counts."""
    rows = table.groupBy(*keys, at).agg(F.max(F.struct(*values)).alias("_held"))
    asked = points.select(*keys, at).distinct()
    both = rows.select(*keys, at, "_held", F.lit(0).alias("_asked")).unionByName(
        asked.select(*keys, at, F.lit(None).cast(rows.schema["_held"].dataType).alias("_held"), F.lit(1).alias("_asked"))
    )
    order = Window.partitionBy(*keys).orderBy(at, "_asked").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_held", F.last("_held", ignorenulls=True).over(order)).where("_asked = 1")
    return found.select(*keys, at, *[F.col("_held")[v].alias(v) for v in values])


def bracket_of(points: DataFrame, brackets: DataFrame, keys: list[str], at: str = "at", values: list[str] | None = None) -> DataFrame:
    """points plus start, end and values of the disjoint closed bracket (keys, start, end, values) that holds `at`; null in
    gaps. A point's bracket is the last one that starts by it, if it hasn't ended."""
    columns = ["end", *(values or [])]
    named = brackets.select(*keys, F.col("start").alias(at), "start", *columns)
    found = as_of(points, named, keys, at, ["start", *columns])
    inside = F.col("end") >= F.col(at)
    held = found.select(*keys, at, *[F.when(inside, F.col(c)).alias(c) for c in ("start", *columns)])
    return points.join(held, [*keys, at], "left")
