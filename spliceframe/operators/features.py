"""The feature vector of a community, from which a model predicts the weight of long reads."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATS = ("Min", "Max", "Mean", "Variance", "Skewness", "Kurtosis")
STRUCTURE = ("gene_length", "isoform_lengths", "exon_lengths", "region_lengths")
READS = ("unique_mapping_SRs", "multi_mapping_SRs", "unique_mapping_LRs", "multi_mapping_LRs", "5_end_truncation", "3_end_truncation")
#: The order of a model's input.
ALL = [
    "Num_genes", "Num_isoforms", "Num_exons", "Num_regions",
    *[f"{s}_{c}" for c in STRUCTURE for s in STATS],
    "Num_unique_mapping_SRs", "Num_multi_mapping_SRs", "Num_mapping_SRs",
    "Num_unique_mapping_LRs", "Num_multi_mapping_LRs", "Num_mapping_LRs",
    *[f"{s}_{c}" for c in READS for s in STATS],
    *[f"{s}_SR_kvalue" for s in STATS],
]
SELECTED = [f for f in ALL if not f.startswith(("Variance", "Skewness", "Kurtosis"))]


def describe(value: Column, name: str) -> list[Column]:
    """Min, max, mean, sample variance, and biased skewness and excess kurtosis of a column."""
    return [
        f(value).alias(f"{s}_{name}")
        for s, f in zip(STATS, (F.min, F.max, F.avg, F.var_samp, F.skewness, F.kurtosis), strict=True)
    ]


def community_features(community: DataFrame, lists: dict[str, DataFrame]) -> DataFrame:
    """community (gene, community) and, by name, rows (gene, value) -> a row of ALL for each community; statistics of
    nothing are NaN."""
    out = community.select("community").distinct()
    counts = {"gene_length": "Num_genes", "isoform_lengths": "Num_isoforms", "exon_lengths": "Num_exons", "region_lengths": "Num_regions"}
    counts |= {n: f"Num_{n}" for n in READS[:4]}
    for name in (*STRUCTURE, *READS, "SR_kvalue"):
        count = [F.count("value").alias(counts[name])] if name in counts else []
        if name in lists:
            rows = lists[name].join(community, "gene").groupBy("community").agg(*count, *describe(F.col("value"), name))
            out = out.join(rows, "community", "left")
        else:
            out = out.select("*", *[F.lit(None).cast("double").alias(f"{s}_{name}") for s in STATS], *[F.lit(0).alias(counts[name]) for _ in count])
    total = lambda kind: F.coalesce(f"Num_unique_mapping_{kind}", F.lit(0)) + F.coalesce(f"Num_multi_mapping_{kind}", F.lit(0))  # noqa: E731, E501
    out = out.withColumn("Num_mapping_SRs", total("SRs")).withColumn("Num_mapping_LRs", total("LRs"))
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(0.0 if c.startswith("Num_") else float("nan"))).alias(c) for c in ALL]
    return out.select("community", *filled)


def nearest_model(models: dict[str, tuple[int, int]], n_lr: int, n_sr: int) -> str:
    """The model (name -> long, short reads it was trained at) nearest in long reads, then in short ones."""
    return min(models, key=lambda m: (abs(models[m][0] - n_lr), abs(models[m][1] - n_sr)))


def predict_alpha(features: DataFrame, predict: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """rows (community, error, alpha): predict maps SELECTED features to the errors at alpha 0, 0.05 ... 1."""

    def solve(batches):
        for pdf in batches:
            errors = np.asarray(predict(pdf[SELECTED].to_numpy(dtype=float)))
            best = errors.argmin(axis=1)
            yield pd.DataFrame({"community": pdf["community"], "error": errors.min(axis=1), "alpha": best / 20})

    return features.mapInPandas(solve, "community string, error double, alpha double")
