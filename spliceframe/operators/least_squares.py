"""Abundance from region counts by least squares, as an alternative to EM.

For each gene, x minimises sum w |b - A x|^2 + beta |x|^2 over its matrices A (regions x isoforms) and abundances b of
weight w, with x at least 0 and, by unique_bounds, A x at least b in regions of one isoform alone. Such a row has one
cell, so it is a lower bound of one isoform: the programme is non-negative least squares about these bounds. A and b
reach numpy only as Gram matrices, right-hand sides and bounds of one gene: joins and sums make them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import safe_divide
from ..plans.scratch import merged
from .paths import GENE

Part = tuple[DataFrame, DataFrame, float]  # matrix (chr, gene, path, isoform, a), abundances (chr, gene, path, b), weight


def nonnegative(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The x >= 0 that minimises x'qx / 2 - c'x, q positive semidefinite: isoforms enter a free set by their gradient,
    and leave it where the free optimum would make them negative."""
    x, free = np.zeros(len(c)), np.zeros(len(c), bool)
    least = 1e-12 * max(1.0, np.abs(c).max(initial=0.0))
    for _ in range(3 * len(c) + 10):
        slope = np.where(free, -np.inf, c - q @ x)
        if not len(c) or slope.max() <= least:
            break
        free[slope.argmax()] = True
        while True:
            at = np.flatnonzero(free)
            best = np.zeros(len(c))
            best[at] = np.linalg.lstsq(q[np.ix_(at, at)], c[at], rcond=None)[0]
            low = at[best[at] <= 0]
            if not len(low):
                x = best
                break
            step = (x[low] / (x[low] - best[low])).min() if (x[low] > best[low]).all() else 0.0
            x = x + step * (best - x)
            gone = low[x[low] <= 1e-15 * max(1.0, x.max())]
            x[gone] = 0.0
            free[gone if len(gone) else low] = False
    return x


def bounded(q: np.ndarray, c: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The x >= low that minimises x'qx / 2 - c'x."""
    return low + nonnegative(q, c - q @ low)


STACK = 1 << 20  # numbers of the matrices that are solved at a time


def nonnegative_stack(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """nonnegative() of each of many q (genes x n x n) and c, all of one size: their free sets change side by side. Genes
    whose q isn't well-conditioned, or that don't settle, go one by one."""
    m, n = c.shape
    x, free = np.zeros((m, n)), np.zeros((m, n), bool)
    if not n or not m:
        return x
    least = 1e-12 * np.maximum(1.0, np.abs(c).max(1))
    ends = np.linalg.eigvalsh(q)
    alone = ends[:, 0] <= 1e-9 * np.abs(ends[:, -1])
    live = np.flatnonzero(~alone)
    for _ in range(3 * n + 10):
        slope = np.where(free[live], -np.inf, c[live] - (q[live] @ x[live][..., None])[..., 0])
        going = slope.max(1) > least[live]
        live, slope = live[going], slope[going]
        if not len(live):
            break
        free[live, slope.argmax(1)] = True
        inner = live
        while len(inner):
            f = free[inner]
            part = np.where(f[:, :, None] & f[:, None, :], q[inner], np.eye(n))
            best = np.linalg.solve(part, np.where(f, c[inner], 0.0)[..., None])[..., 0]
            low = f & (best <= 0)
            bad = low.any(1)
            x[inner[~bad]] = best[~bad]
            inner, best, low = inner[bad], best[bad], low[bad]
            now = x[inner]
            steps = np.where(low, now / np.where(now > best, now - best, 1.0), np.inf).min(1)
            steps = np.where((~low | (now > best)).all(1), steps, 0.0)
            now = now + steps[:, None] * (best - now)
            gone = low & (now <= 1e-15 * np.maximum(1.0, now.max(1, initial=0.0))[:, None])
            gone = np.where(gone.any(1)[:, None], gone, low)
            x[inner] = np.where(gone, 0.0, now)
            free[inner] &= ~gone
    alone[live] = True
    for k in np.flatnonzero(alone):
        x[k] = nonnegative(q[k], c[k])
    return x


def part_cells(matrix: DataFrame, b: DataFrame, weight: float, unique_bounds: bool = True) -> DataFrame:
    """rows (chr, gene, kind, i, j, v): of kind 0 the Gram matrix of a part, i <= j, of kind 1 its right-hand sides and of kind 2
    the greatest b / a over regions with a cell in one isoform alone. A region's cells meet its b once, and are paired in it."""
    x = F.array_sort(F.collect_list(F.struct(F.col("isoform").alias("c"), F.col("a").alias("v")))).alias("x")
    rows = matrix.groupBy(*GENE, "path").agg(x).join(merged(b.groupBy(*GENE, "path").agg(F.max("b").alias("b"))), [*GENE, "path"], "left")
    weight = float(weight)
    cell = "named_struct('kind', {}, 'i', {}, 'j', {}, 'v', {})".format
    pairs = f"flatten(transform(x, (l, p) -> transform(slice(x, p + 1, size(x)), r -> {cell(0, 'l.c', 'r.c', f'{weight!r}D * (l.v * r.v)')})))"
    right = f"if(b is null, slice(transform(x, l -> {cell(1, 'l.c', 'l.c', '0D')}), 1, 0), transform(x, l -> {cell(1, 'l.c', 'l.c', f'{weight!r}D * l.v * b')}))"
    own = f"if(b is not null and size(filter(x, l -> l.v <> 0)) = 1, transform(filter(x, l -> l.v <> 0), l -> {cell(2, 'l.c', 'l.c', 'b / l.v')}), slice(transform(x, l -> {cell(2, 'l.c', 'l.c', '0D')}), 1, 0))"
    each = rows.select(*GENE, F.explode(F.expr(f"concat({', '.join([pairs, right, *[own] * unique_bounds])})")).alias("y")).select(*GENE, "y.*")
    summed = each.groupBy(*GENE, "kind", "i", "j").agg(F.sum("v").alias("total"), F.max("v").alias("most"))
    return summed.select(*GENE, "kind", "i", "j", F.when(F.col("kind") == 2, F.col("most")).otherwise(F.col("total")).alias("v"))


def solve(parts: Sequence[Part], names: DataFrame, beta: float = 1e-6, unique_bounds: bool = True) -> DataFrame:
    """rows (chr, gene, isoform, x) for every isoform of names (chr, gene, isoform); 0 in genes without a cell."""
    cells = [part_cells(matrix, b, weight, unique_bounds) for matrix, b, weight in parts if weight]
    if not cells:
        raise ValueError("there is no matrix of a positive weight")
    isoforms = names.groupBy(*GENE).agg(F.array_sort(F.collect_set("isoform")).alias("isoforms"))
    at = lambda c: (F.array_position("isoforms", F.col(c)) - 1).cast("int").alias(c)
    placed = reduce(DataFrame.unionByName, cells).join(merged(isoforms), GENE).select(*GENE, "isoforms", "kind", at("i"), at("j"), "v")
    # one row per gene, so that a batch holds many genes
    packed = placed.groupBy(*GENE).agg(
        F.first("isoforms").alias("isoforms"), F.collect_list(F.struct("kind", "i", "j", "v")).alias("cells")
    )

    def of_genes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("isoforms").value_lengths().to_numpy(zero_copy_only=False)
            held = batch.column("cells").value_lengths().to_numpy(zero_copy_only=False)
            kind, i, j, v = (f.to_numpy(zero_copy_only=False) for f in batch.column("cells").flatten().flatten())
            gene, found = np.repeat(np.arange(len(n)), held), [None] * len(n)
            for size in np.unique(n).tolist():
                every = np.flatnonzero(n == size)
                for genes in np.split(every, np.arange(0, len(every), max(1, STACK // max(1, size * size)))[1:]):
                    row = np.full(len(n), -1)
                    row[genes] = np.arange(len(genes))
                    at, own = row[gene], row[gene] >= 0
                    q, c, low = np.zeros((len(genes), size, size)), np.zeros((len(genes), size)), np.zeros((len(genes), size))
                    of = lambda k: np.flatnonzero(own & (kind == k))  # noqa: B023, E731
                    np.add.at(q, (at[of(0)], i[of(0)], j[of(0)]), v[of(0)])
                    q = np.triu(q) + np.triu(q, 1).transpose(0, 2, 1) + beta * np.eye(size)
                    np.add.at(c, (at[of(1)], i[of(1)]), v[of(1)])
                    np.maximum.at(low, (at[of(2)], i[of(2)]), v[of(2)])
                    got = low + nonnegative_stack(q, c - (q @ low[..., None])[..., 0])
                    for k, x in zip(genes.tolist(), got.tolist(), strict=True):
                        found[k] = x
            columns = [batch.column("chr"), batch.column("gene"), batch.column("isoforms"), pa.array(found, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*GENE, "isoforms", "x"])

    solved = packed.mapInArrow(of_genes, "chr string, gene string, isoforms array<string>, x array<double>")
    rows = solved.select(*GENE, F.explode(F.arrays_zip("isoforms", "x")).alias("z")).select(*GENE, F.col("z.isoforms").alias("isoform"), F.col("z.x").alias("x"))
    every = names.select(*GENE, "isoform").distinct()
    return every.join(merged(rows), [*GENE, "isoform"], "left").fillna(0.0, ["x"])


def gene_shares(x: DataFrame) -> DataFrame:
    """rows (chr, gene, isoform, theta): x over its gene's sum."""
    total = F.sum("x").over(Window.partitionBy(*GENE))
    return x.select(*GENE, "isoform", safe_divide(F.col("x"), total).alias("theta"))


def by_total(theta: DataFrame, b: DataFrame) -> DataFrame:
    """rows (chr, gene, isoform, expression): theta's share of all reads of the gene's regions (b)."""
    reads = b.groupBy(*GENE).agg(F.sum("b").alias("reads"))
    return theta.join(reads, GENE, "left").select(*GENE, "isoform", (F.col("theta") * F.coalesce("reads", F.lit(0.0))).alias("expression"))


def reassign(theta: DataFrame, matrix: DataFrame, b: DataFrame) -> DataFrame:
    """rows (chr, gene, isoform, expression): the reads of each region dealt among its isoforms. theta: (chr, gene,
    isoform, theta) of every isoform.

    A region of one isoform gives it all. One of several deals its reads by a * theta; where that is 0 for some region of
    a gene, theta of the whole gene is raised first: by a hundredth of its least positive value, or made even where all
    of it is 0.
    """
    gene = Window.partitionBy(*GENE)
    region = Window.partitionBy(*GENE, "path")
    least = F.min(F.when(F.col("theta") > 0, F.col("theta"))).over(gene)
    raised = F.when(F.sum("theta").over(gene) == 0, 1.0 / F.count("*").over(gene)).otherwise(F.col("theta") + 0.01 * least)
    held = theta.withColumn("raised", raised)
    cells = matrix.where("a <> 0").join(b, [*GENE, "path"]).withColumn("k", F.count("*").over(region)).join(held, [*GENE, "isoform"])
    many = cells.where("k > 1 and b <> 0").withColumn("den", F.sum(F.col("a") * F.col("theta")).over(region))
    many = many.withColumn("weak", F.max(F.col("den") == 0).over(gene))
    many = many.withColumn("y", F.col("a") * F.when(F.col("weak"), F.col("raised")).otherwise(F.col("theta")))
    dealt = many.select(*GENE, "isoform", (F.col("b") * F.col("y") / F.sum("y").over(region)).alias("n"))
    summed = dealt.union(cells.where("k = 1").select(*GENE, "isoform", F.col("b").alias("n"))).groupBy(*GENE, "isoform").agg(F.sum("n").alias("expression"))
    return theta.select(*GENE, "isoform").join(summed, [*GENE, "isoform"], "left").fillna(0.0, ["expression"])


def per_million(expression: DataFrame) -> DataFrame:
    """expression plus tpm: its share of all, in millionths."""
    total = expression.agg(F.sum("expression").alias("total"))
    joined = expression.crossJoin(F.broadcast(total))  # one row
    return joined.withColumn("tpm", F.col("expression") * 1e6 / F.when(F.coalesce("total", F.lit(0.0)) == 0, 1).otherwise(F.col("total"))).drop("total")


def blended(expression: DataFrame, short: DataFrame, alpha: float) -> DataFrame:
    """expression (isoform, tpm, ...) with tpm blended with that of short reads (isoform, value): alpha of the long reads'
    and the rest of the short reads', 0 for isoforms they lack. Adds lr_tpm, sr_tpm and alpha."""
    values = merged(short.groupBy("isoform").agg(F.sum("value").alias("sr_tpm")))
    both = expression.withColumnRenamed("tpm", "lr_tpm").join(values, "isoform", "left").fillna(0.0, ["sr_tpm"])
    return both.withColumn("tpm", (1 - alpha) * F.col("sr_tpm") + alpha * F.col("lr_tpm")).withColumn("alpha", F.lit(float(alpha)))
