"""Short-read fragments: length statistics, effective lengths and compatibilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import effective_length, fragment_weight


def fragment_moments(fragments: DataFrame) -> DataFrame:
    """One row (mean, std): mean and population deviation of the fragment lengths."""
    return fragments.agg(F.avg("tlen").alias("mean"), F.stddev_pop("tlen").alias("std"))


def fragment_statistics(fragments: DataFrame) -> tuple[float, float]:
    row = fragment_moments(fragments).first()
    if row[0] is None:
        raise ValueError("there are no fragments")
    return float(row[0]), float(row[1])


def effective_lengths(lengths: DataFrame, mean: float, std: float) -> DataFrame:
    """lengths (isoform, length) -> (isoform, eff): computed once for each distinct length."""
    distinct = lengths.select("length").distinct().withColumn("eff", effective_length(F.col("length"), F.lit(mean), F.lit(std)))
    return lengths.join(distinct, "length").select("isoform", "eff")


def compatibilities(fragments: DataFrame, eff: DataFrame, mean: float, std: float) -> DataFrame:
    """fragments (name, isoform, tlen) -> (name, isoform, w); isoforms without an effective length have 1."""
    joined = fragments.join(eff, "isoform", "left").withColumn("eff", F.coalesce("eff", F.lit(1.0)))
    w = fragment_weight(F.col("tlen"), F.lit(mean), F.lit(std), F.col("eff"))
    return joined.select("name", "isoform", w.alias("w"))


def fractional_counts(fragments: DataFrame, eff: DataFrame) -> DataFrame:
    """rows (isoform, theta): each fragment shares one count among its isoforms, over the effective length."""
    shared = fragments.withColumn("k", F.count("*").over(Window.partitionBy("name")))
    counted = shared.groupBy("isoform").agg(F.sum(1.0 / F.col("k")).alias("c")).join(eff, "isoform", "left")
    return counted.select("isoform", (F.col("c") / F.coalesce("eff", F.lit(1.0))).alias("theta"))
