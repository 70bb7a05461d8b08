"""Least squares of region counts and read reassignment, against enumeration and numpy."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spliceframe import api
from spliceframe.config import KValueSettings
from spliceframe.operators import condition, least_squares as ls

CELLS = "chr string, gene string, path array<int>, isoform string, a double"
COUNTS = "chr string, gene string, path array<int>, b double"


def brute(q, c, low):
    """Least x'qx / 2 - c'x with x >= low, over all sets of isoforms that stand on their bounds."""
    n, best = len(c), (np.inf, None)
    for held in itertools.product([True, False], repeat=n):
        held, x = np.array(held), low.copy()
        free = np.flatnonzero(~held)
        if len(free):
            x[free] = np.linalg.lstsq(q[np.ix_(free, free)], c[free] - q[np.ix_(free, np.flatnonzero(held))] @ low[held], rcond=None)[0]
        if (x >= low - 1e-9).all():
            best = min(best, (x @ q @ x / 2 - c @ x, tuple(x)))
    return np.array(best[1])


def random_genes(seed, count=40):
    """{gene: (A, b)}: regions of random isoform sets, among them regions of one and isoforms without any."""
    r = np.random.default_rng(seed)
    out = {}
    for g in range(count):
        n, m = int(r.integers(1, 6)), int(r.integers(1, 9))
        a = (r.random((m, n)) < 0.5) * r.integers(1, 5, (m, n)).astype(float)
        b = (r.random(m) < 0.8) * r.integers(1, 50, m).astype(float)
        if g % 5 == 0:
            a[:, 0] = 0
        out[f"g{g}"] = a, b
    return out


def tables(spark, genes):
    cells = [("c", g, [int(k)], f"i{j}", float(a[k, j])) for g, (a, _) in genes.items() for k, j in zip(*np.nonzero(a), strict=True)]
    counts = [("c", g, [k], float(x)) for g, (a, b) in genes.items() for k, x in enumerate(b)]
    names = [("c", g, f"i{j}") for g, (a, _) in genes.items() for j in range(a.shape[1])]
    return spark.createDataFrame(cells, CELLS), spark.createDataFrame(counts, COUNTS), spark.createDataFrame(names, "chr string, gene string, isoform string")


def bounds_of(a, b):
    low = np.zeros(a.shape[1])
    for row, x in zip(a, b, strict=True):
        if np.count_nonzero(row) == 1:
            j = np.flatnonzero(row)[0]
            low[j] = max(low[j], x / row[j])
    return low


def test_nonnegative_by_enumeration():
    r = np.random.default_rng(3)
    for _ in range(300):
        n = int(r.integers(1, 6))
        a = r.normal(size=(n + 2, n)) * (r.random((n + 2, n)) < 0.7)
        q, c = a.T @ a + 1e-3 * np.eye(n), r.normal(size=n) * 10
        low = np.maximum(0, r.normal(size=n))
        assert ls.bounded(q, c, low) == pytest.approx(brute(q, c, low), abs=1e-6)
        assert ls.nonnegative(q, c) == pytest.approx(brute(q, c, np.zeros(n)), abs=1e-6)


@pytest.mark.parametrize("unique_bounds", [True, False])
@pytest.mark.parametrize("alpha", [1.0, 0.3])
def test_solve(spark, unique_bounds, alpha):
    long, short = random_genes(1), random_genes(2)
    short = {g: (np.vstack([a, np.zeros((1, a.shape[1]))])[:, :], np.append(b, 0)) for g, (a, b) in short.items()}
    # both kinds of reads have the same isoforms
    short = {g: (np.resize(a, (len(a), long[g][0].shape[1])), b) for g, (a, b) in short.items()}
    parts, total = [(*tables(spark, long)[:2], alpha)], {}
    if alpha < 1:
        parts.append((*tables(spark, short)[:2], 1 - alpha))
    names = tables(spark, long)[2]
    got = {(r.gene, r.isoform): r.x for r in ls.solve(parts, names, 0.01, unique_bounds).collect()}
    for g, (a, b) in long.items():
        n = a.shape[1]
        q, c, low = alpha * a.T @ a + 0.01 * np.eye(n), alpha * a.T @ b, bounds_of(a, b)
        if alpha < 1:
            s, t = short[g]
            q, c, low = q + (1 - alpha) * s.T @ s, c + (1 - alpha) * s.T @ t, np.maximum(low, bounds_of(s, t))
        want = brute(q, c, low if unique_bounds else np.zeros(n))
        if not a.any() and (alpha == 1 or not short[g][0].any()):
            want = np.zeros(n)
        assert [got[g, f"i{j}"] for j in range(n)] == pytest.approx(want, abs=1e-5), g
        total[g] = want
    assert len(got) == sum(map(len, total.values()))


def test_no_weight(spark):
    m, b, names = tables(spark, random_genes(1, 2))
    with pytest.raises(ValueError, match="weight"):
        ls.solve([(m, b, 0.0)], names)


def brute_reassign(theta, a, b):
    k = np.count_nonzero(a, axis=1)
    out = np.array([b[(k == 1) & (a[:, j] != 0)].sum() for j in range(a.shape[1])], float)
    many = (k > 1) & (b != 0)
    a, b = a[many], b[many]
    if (a @ theta == 0).any():
        theta = np.full(len(theta), 1 / len(theta)) if theta.sum() == 0 else theta + 0.01 * theta[theta > 0].min()
    return out + (b / (a @ theta)) @ (a * theta)


def test_reassign(spark):
    genes, r = random_genes(7), random.Random(2)
    theta = {g: np.array([r.choice([0, 0, 0.5, 0.25, 1]) for _ in range(a.shape[1])], float) for g, (a, _) in genes.items()}
    theta["g3"][:] = 0
    rows = [("c", g, f"i{j}", float(x)) for g, t in theta.items() for j, x in enumerate(t)]
    m, b, _ = tables(spark, genes)
    got = ls.reassign(spark.createDataFrame(rows, "chr string, gene string, isoform string, theta double"), m, b)
    got = {(x.gene, x.isoform): x.expression for x in got.collect()}
    for g, (a, b) in genes.items():
        assert [got[g, f"i{j}"] for j in range(a.shape[1])] == pytest.approx(brute_reassign(theta[g], a, b)), g
        # no read is lost
        assert sum(got[g, f"i{j}"] for j in range(a.shape[1])) == pytest.approx(b[a.any(axis=1)].sum())


def test_shares_and_millions(spark):
    x = spark.createDataFrame([("c", "g", "a", 1.0), ("c", "g", "b", 3.0), ("c", "h", "d", 0.0)], "chr string, gene string, isoform string, x double")
    b = spark.createDataFrame([("c", "g", [0], 6.0), ("c", "g", [1], 2.0)], COUNTS)
    got = ls.per_million(ls.by_total(ls.gene_shares(x), b))
    assert {r.isoform: (r.expression, r.tpm) for r in got.collect()} == {"a": (2.0, 250000.0), "b": (6.0, 750000.0), "d": (0.0, 0.0)}
    nothing = ls.per_million(ls.by_total(ls.gene_shares(x.where("x = 0")), b))
    assert nothing.select("tpm").first()[0] == 0


def test_gram_of_one_part(spark):
    """The Gram sums that the solver rests on."""
    genes = random_genes(5, 6)
    m, _, _ = tables(spark, genes)
    for r in condition.gram(m, ["chr", "gene"]).withColumn("i", F.expr("int(substring(i, 2))")).withColumn("j", F.expr("int(substring(j, 2))")).collect():
        a = genes[r.gene][0]
        assert r.g == pytest.approx((a.T @ a)[r.i, r.j])


def test_stacks_are_solved_as_one_by_one(monkeypatch):
    """Genes of one size together, as each alone; only those with dependent isoforms go one by one."""
    r = np.random.default_rng(5)
    for n in (1, 2, 3, 6):
        a = r.normal(size=(80, n + 2, n))
        a[:8, :, 0] = a[:8, :, -1]
        q, c = np.einsum("gri,grj->gij", a, a), r.normal(size=(80, n)) * 5
        want = np.array([ls.nonnegative(*g) for g in zip(q, c, strict=True)])
        alone = []
        plain = ls.nonnegative
        monkeypatch.setattr(ls, "nonnegative", lambda *g: alone.append(1) or plain(*g))
        got = ls.nonnegative_stack(q, c)
        monkeypatch.setattr(ls, "nonnegative", plain)
        assert np.allclose(got, want, atol=1e-6 * max(1, np.abs(want).max())) and len(alone) <= 12


def test_abundances_make_no_k_values(spark, monkeypatch):
    """Abundances of long reads need no region without reads and no condition number; K values are made once if asked for."""
    made, plain = [], api.condition.condition_numbers
    monkeypatch.setattr(api.condition, "condition_numbers", lambda *a: made.append(1) or plain(*a))
    exons = spark.createDataFrame([("c", "g", "a", "+", 1, 300), ("c", "g", "a", "+", 401, 700), ("c", "g", "b", "+", 1, 300)], "chr string, gene string, isoform string, strand string, start int, end int")
    reads = spark.createDataFrame([("r1", 0, "c", 1, 60, "300M100N300M"), ("r2", 0, "c", 1, 60, "250M")], "name string, flag int, chr string, pos int, mapq int, cigar string")
    found = api.k_values(spark, exons, KValueSettings(full_length_regions="none"), long_reads=reads)
    assert api.region_abundance(found, beta=0.01).count() == 2 and not made
    assert found.genes.count() == 1 and found.isoforms.count() == 2 and found.genes.count() == 1 and len(made) == 2
