"""Condition numbers of a gene's region x isoform matrix, from its Gram matrix alone.

With weight w_r of region r and column sums c_i, Gram_ij = sum over regions of both of w_r**2 / (c_i c_j): a self-join
within regions and a sum. The regions of one set of isoforms are summed to one row first. Only isoforms x isoforms numbers of one gene reach numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .paths import GENE


def entries(regions: DataFrame, weight: Column, normalize: bool = True) -> DataFrame:
    """regions (chr, gene, path, isoforms, ...) -> the matrix as rows (chr, gene, path, isoform, a)."""
    one = regions.select(*GENE, "path", weight.cast("double").alias("a"), F.explode("isoforms").alias("isoform"))
    if not normalize:
        return one
    total = F.sum("a").over(Window.partitionBy(*GENE, "isoform"))
    return one.withColumn("a", F.col("a") / F.when(total == 0, 1).otherwise(total))


def gram(matrix: DataFrame, keys: list[str], row: str = "path", column: str = "isoform", value: str = "a") -> DataFrame:
    """rows (keys, i, j, g) with i <= j: the Gram matrix of each key's matrix. A row's entries are paired inside it."""
    cells = matrix.groupBy(*keys, row).agg(F.array_sort(F.collect_list(F.struct(F.col(column).alias("c"), F.col(value).alias("v")))).alias("x"))
    paired = cells.select(*keys, "x", F.posexplode("x").alias("p", "left"))
    paired = paired.select(*keys, "left", F.explode(F.expr("slice(x, p + 1, size(x))")).alias("right"))
    return paired.groupBy(*keys, F.col("left.c").alias("i"), F.col("right.c").alias("j")).agg(
        F.sum(F.col("left.v") * F.col("right.v")).alias("g")
    )


def owner_sums(regions: DataFrame, weight: Column) -> DataFrame:
    """regions (chr, gene, isoforms, ...) -> rows (chr, gene, isoforms, n, w, w2): of the regions of each set of isoforms
    their number, and the sums of their weights and squared weights. A gene's regions come together, so that they are
    summed before a shuffle, and no path or cell is in it."""
    w = weight.cast("double")
    kept = regions.select(*GENE, F.array_sort("isoforms").alias("isoforms"), w.alias("w"))
    return kept.groupBy(*GENE, "isoforms").agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("w")).alias("w2"))


def gram_of_sums(sums: DataFrame, normalize: bool = True, weight: str = "w", square: str = "w2") -> DataFrame:
    """gram(entries(regions, ...)) from owner_sums; with n for weight and square that of weights 1."""
    each = sums.select(*GENE, "isoforms", F.col(weight).cast("double").alias("w"), F.col(square).cast("double").alias("w2"))
    left = each.select(*GENE, "w", "w2", "isoforms", F.posexplode("isoforms").alias("p", "i"))
    pairs = left.select(*GENE, "w", "w2", "i", F.explode(F.expr("slice(isoforms, p + 1, size(isoforms))")).alias("j"))
    cells = pairs.groupBy(*GENE, "i", "j").agg(F.sum("w2").alias("g"), F.sum("w").alias("c"))
    if not normalize:
        return cells.drop("c")
    gene = cells.groupBy(*GENE).agg(F.collect_list(F.struct("i", "j", "g", "c")).alias("cells"))
    total = "map_from_entries(transform(filter(cells, x -> x.i = x.j), x -> struct(x.i, if(x.c = 0, 1D, x.c))))"
    gene = gene.select(*GENE, "cells", F.expr(total).alias("c")).select(*GENE, "c", F.explode("cells").alias("x"))
    return gene.select(*GENE, "x.i", "x.j", F.expr("x.g / (c[x.i] * c[x.j])").alias("g"))


def numbers(g: np.ndarray, tolerance: float = 0.0) -> tuple[float, float, float, float]:
    """(k value, regular, generalized condition number, product of the extreme singular values) of a Gram matrix."""
    if not g.size or not np.isfinite(g).all():
        return (np.nan,) * 4
    return numbers_of(np.linalg.svd(g, compute_uv=False), tolerance)


def numbers_of(s: np.ndarray, tolerance: float = 0.0) -> tuple[float, float, float, float]:
    """The same from the singular values; those up to matrix_rank's bound are 0."""
    rank = int((s > s.max() * len(s) * np.finfo(s.dtype).eps).sum())
    if rank == 0 or (tolerance and not (s > tolerance).any()):
        return (np.nan,) * 4
    top = np.sqrt(s[0])
    least = np.sqrt(s[rank - 1] if tolerance == 0 else s[s > tolerance].min())
    bottom = np.sqrt(s[-1]) if rank == len(s) else 0.0
    k = (top - bottom) / top if rank == len(s) else top / least
    return float(k), float(top / bottom) if bottom else np.inf, float(top / least), float(top * least)


STACK = 1 << 20  # numbers of the matrices that are solved at a time


def singular_values(n: np.ndarray, grams: pa.ListArray) -> list[np.ndarray]:
    """Of each gene's Gram matrix, n x n with the entries (i, j, g) of a list; NaN where one isn't finite. Matrices of one size
    are solved together."""
    out: list = [None] * len(n)
    ends = np.concatenate([[0], np.cumsum(grams.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
    cells = grams.flatten()
    i, j, g = (cells.field(c).to_numpy(zero_copy_only=False) for c in ("i", "j", "g"))
    for size in np.unique(n).tolist():
        every = np.flatnonzero(n == size)
        for at in np.split(every, np.arange(0, len(every), max(1, STACK // (size * size)))[1:]):
            own = np.concatenate([np.arange(ends[k], ends[k + 1]) for k in at])
            row = np.repeat(np.arange(len(at)), ends[at + 1] - ends[at])
            mats = np.zeros((len(at), size, size))
            mats[row, i[own], j[own]] = g[own]
            mats[row, j[own], i[own]] = g[own]
            finite = np.isfinite(mats).all((1, 2))
            found = np.full((len(at), size), np.nan)
            found[finite] = np.linalg.svd(mats[finite], compute_uv=False)
            for k, s in zip(at.tolist(), found, strict=True):
                out[k] = s
    return out


def numbered(isoforms: DataFrame) -> DataFrame:
    """rows (chr, gene, at): the number of each isoform of a gene, by name, from 0."""
    gene = isoforms.groupBy(*GENE).agg(F.array_sort(F.collect_set("isoform")).alias("names"))
    return gene.select(*GENE, F.map_from_entries(F.transform("names", lambda x, k: F.struct(x, k))).alias("at"))


def dense(n: int, i: np.ndarray, j: np.ndarray, g: np.ndarray) -> np.ndarray:
    out = np.zeros((n, n))
    out[i, j] = g
    out[j, i] = g
    return out


RESULT = "kvalue double, regular double, generalized double, product double, singular_values array<double>"


def condition_numbers(weighted: DataFrame, plain: DataFrame, names: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Grams of the weighted and plain matrix and names (chr, gene, isoform) -> a row of RESULT for each gene.

    names gives every isoform of a gene, also those without a region. Singular values are those of the plain matrix.
    """
    sized = numbered(names)
    same = weighted is plain
    both = plain.withColumn("plain", F.lit(True))
    both = both if same else weighted.withColumn("plain", F.lit(False)).unionByName(both)
    # one row per gene, its Gram entries as arrays: batches of genes go to numpy, not a DataFrame for each
    cells = both.groupBy(*GENE).agg(
        *[F.collect_list(F.when(F.col("plain") == p, F.struct("i", "j", "g"))).alias(a) for p, a in ((False, "weighted"), (True, "ones"))]
    )
    at = F.col("at")
    placed = [F.transform(a, lambda x: F.struct(at[x["i"]].alias("i"), at[x["j"]].alias("j"), x["g"].alias("g"))).alias(a) for a in ("weighted", "ones")]
    packed = cells.join(sized, GENE).select(*GENE, F.size("at").alias("n"), *placed)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy()
            ones = singular_values(n, batch.column("ones"))
            weighted = ones if same else singular_values(n, batch.column("weighted"))
            out = [
                (*((np.nan,) * 4 if np.isnan(w).any() else numbers_of(w, tolerance)), np.sqrt(np.maximum(o, 0)).tolist())
                for w, o in zip(weighted, ones, strict=True)
            ]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            arrays = [pa.array(c, pa.float64()) for c in columns[:4]] + [pa.array(columns[4], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("chr"), batch.column("gene"), *arrays], names=[*GENE, *[c.split()[0] for c in RESULT.split(", ")]]
            )

    return packed.mapInArrow(solve, f"chr string, gene string, {RESULT}")
