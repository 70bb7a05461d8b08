"""Read-length distribution, its CDF and suffix sums, initial expression, and long-read conditional probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import conditional_probability
from ..plans.scratch import merged


def longest_stretch() -> Column:
    """Of a read's rows (iso_len, off5, off3) the longest stretch, 0 at least."""
    return F.greatest(F.max(F.col("iso_len") - F.col("off5") - F.col("off3")), F.lit(0)).cast("long")


def read_lengths(read_iso: DataFrame) -> DataFrame:
    """rows (name, read_len): the longest stretch of a read on any of its isoforms."""
    return read_iso.groupBy("name").agg(longest_stretch().alias("read_len"))


def histogram(lengths: DataFrame, length: str = "read_len", by: Sequence[str] = ()) -> DataFrame:
    """rows (by, read_len, n); by: the columns of a sample."""
    return lengths.groupBy(*by, F.col(length).alias("read_len")).agg(F.count("*").alias("n"))


def order_statistics(rows: DataFrame, by: str, column: str, parts: dict[str, int]) -> DataFrame:
    """rows (by, names of parts): for each part p the value that stands at n div p (from 0) among the n sorted values. A
    row for each distinct value is counted, not a list of all."""
    hist = rows.groupBy(by, F.col(column).alias("v")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(by).orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    laid = hist.withColumn("upto", upto).withColumn("n", F.sum("c").over(Window.partitionBy(by)))
    return laid.groupBy(by).agg(*[F.min(F.when(F.col("upto") > F.floor(F.col("n") / p), F.col("v"))).alias(name) for name, p in parts.items()])


def cdf_at(hist: DataFrame, at: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """at plus cdf: P(1 <= read_len <= column), within by. Both are one row per distinct length, laid on one line and
    summed."""
    marks = hist.select(*by, F.col("read_len").alias("x"), "n", F.lit(0).alias("asked")).union(
        at.select(*by, F.col(column).cast("long").alias("x"), F.lit(0).cast("long").alias("n"), F.lit(1).alias("asked")).distinct()
    )
    order = Window.partitionBy(*by).orderBy("x", "asked").rowsBetween(Window.unboundedPreceding, 0)  # a row for each distinct length
    held = F.sum(F.when(F.col("x") >= 1, F.col("n")).otherwise(0)).over(order)
    total = F.sum("n").over(Window.partitionBy(*by))
    table = marks.select(*by, "x", "asked", (held / total).alias("cdf")).where("asked = 1")
    return at.join(table.select(*by, F.col("x").alias(column), "cdf"), [*by, column], "left")


def cdf_below(hist: DataFrame, at: DataFrame, column: str) -> DataFrame:
    """Distinct rows (column, below): the number of reads (hist: read_len, n) shorter than column."""
    marks = hist.select(F.col("read_len").cast("long").alias("x"), "n", F.lit(1).alias("asked")).union(
        at.select(F.col(column).cast("long").alias("x"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("asked")).distinct()
    )
    order = Window.orderBy("x", "asked").rowsBetween(Window.unboundedPreceding, 0)  # a row for each distinct length
    return marks.withColumn("below", F.sum("n").over(order)).where("asked = 0").select(F.col("x").alias(column), "below")


def suffix_sums(hist: DataFrame, isoforms: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """rows (by, read_len, n, sm): sm sums theta / cdf over the isoforms (by, iso_len, theta, cdf) at least as long."""
    share = F.when((F.col("cdf") == 0) & (F.col("theta") > 0), float("inf")).otherwise(F.col("theta") / F.when(F.col("cdf") == 0, 1).otherwise(F.col("cdf")))
    by_len = isoforms.groupBy(*by, "iso_len").agg(F.sum(share).alias("v"))
    marks = hist.select(*by, F.col("read_len").alias("x"), "n", F.lit(0.0).alias("v"), F.lit(1).alias("asked")).union(
        by_len.select(*by, F.col("iso_len").alias("x"), F.lit(0).cast("long").alias("n"), "v", F.lit(0).alias("asked"))
    )
    order = Window.partitionBy(*by).orderBy(F.desc("x"), "asked").rowsBetween(Window.unboundedPreceding, 0)
    summed = marks.withColumn("sm", F.sum("v").over(order)).where("asked = 1")
    return summed.select(*by, F.col("x").alias("read_len"), "n", "sm")


def fractional_counts(read_iso: DataFrame, unique_only: bool = False) -> DataFrame:
    """rows (isoform, theta): each read and region shares one count among its isoforms."""
    n = F.count("*").over(Window.partitionBy("name", "chr", "gene", "path"))
    shared = read_iso.withColumn("k", n)
    share = F.when(F.col("k") == 1, 1.0).otherwise(0.0) if unique_only else 1.0 / F.col("k")
    return shared.groupBy("isoform").agg(F.sum(share).alias("theta"))


def with_expression(isoforms: DataFrame, theta: DataFrame) -> DataFrame:
    """isoforms (isoform, iso_len) and theta (isoform, theta) side by side; what one of them lacks is 0."""
    return isoforms.join(theta, "isoform", "full").fillna(0, ["iso_len", "theta"])


def compatibilities(read_iso: DataFrame, isoforms: DataFrame, form: str, unique_only: bool = False, floor: float = 1e-100, overrides: DataFrame | None = None) -> DataFrame:
    """rows (name, isoform, p) from offsets and isoforms (isoform, length); pairs of probability 0 stay, as they still
    tie reads to isoforms. overrides (read_len, n, sm) replaces the counted lengths."""
    lengths = read_lengths(read_iso)
    hist = overrides.select("read_len", "n") if overrides is not None else histogram(lengths)
    theta = fractional_counts(read_iso, unique_only)
    every = with_expression(isoforms.select("isoform", F.col("length").alias("iso_len")), theta)
    known = cdf_at(hist, every, "iso_len")
    sums = overrides if overrides is not None else suffix_sums(hist, known)
    total = hist.agg(F.sum("n").alias("total"))
    rows = (
        merged(read_iso.select("name", "isoform").join(lengths, "name")).join(known.select("isoform", "iso_len", "cdf"), "isoform")
        .join(sums, "read_len").crossJoin(F.broadcast(total))  # one row
    )
    p = conditional_probability(
        form, F.col("n") / F.col("total"), F.col("cdf"), F.col("sm"), F.col("iso_len"), F.col("read_len"), floor
    )
    return rows.select("name", "isoform", p.alias("p"))
