"""Options of K values with reads, each where it changes a checked result; mapping of genes with many reads."""

import collections

import numpy as np
import pytest

from spliceframe import api
from spliceframe.config import KValueSettings, QuantifySettings
from spliceframe.operators import mapping, paths

EXONS = "chr string, gene string, isoform string, strand string, start int, end int"
READS = "name string, flag int, chr string, pos int, mapq int, cigar string"


def gene(name, at, isoforms):
    """Exons of 100 bases, 200 apart: isoforms is {name: numbers of its exons}."""
    return [("c", name, i, "+", at + 300 * k + 1, at + 300 * k + 100) for i, own in isoforms.items() for k in own]


def read(name, at, *own):
    """A read on whole exons, in order."""
    cigar = "100M" + "".join(f"{300 * (b - a) - 100}N100M" for a, b in zip(own, own[1:], strict=False))
    return (name, 0, "c", at + 300 * own[0] + 1, 60, cigar)


GENES = gene("g", 0, {"a": (0, 1, 2), "b": (0, 2)}) + gene("h", 10000, {"d": (0, 1), "e": (1, 2)}) + gene("q", 20000, {"z": tuple(range(12)), "y": (0,)})
LONG = [read(f"s{i}", 0, 0) for i in range(3)] + [read("w", 0, 0, 2), read("h1", 10000, 0), read("q1", 20000, 0), read("q2", 20000, *range(12))]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(GENES, EXONS), spark.createDataFrame(LONG, READS)


def regions_of(matrix):
    out = collections.defaultdict(set)
    for r in matrix.select("gene", "path").distinct().collect():
        out[r.gene].add(",".join(map(str, r.path)))
    return dict(out)


def test_full_length_regions(spark, tables):
    """All whole isoforms; none without reads; those of genes whose regions with reads don't tell their isoforms apart."""
    seen = {"g": {"0", "0,2"}, "h": {"0"}, "q": {"0", ",".join(map(str, range(12)))}}
    whole = {"g": {"0,1,2"}, "h": {"0,1", "1,2"}, "q": set()}
    for policy, wanted in (
        ("none", seen),
        ("all", {g: seen[g] | whole[g] for g in seen}),
        ("nonfullrank", seen | {"h": seen["h"] | whole["h"]}),
    ):
        got = api.k_values(spark, tables[0], KValueSettings(full_length_regions=policy), long_reads=tables[1])
        assert regions_of(got.lr_matrix) == wanted, policy
    with pytest.raises(ValueError, match="policy"):
        api.k_values(spark, tables[0], KValueSettings(full_length_regions="some"), long_reads=tables[1])


def test_filter_reads(spark, tables):
    """q1 lies on one exon of an isoform of twelve, and goes."""
    every = api.k_values(spark, tables[0], KValueSettings(full_length_regions="none"), long_reads=tables[1])
    good = api.k_values(spark, tables[0], KValueSettings(full_length_regions="none", filter_reads=True), long_reads=tables[1])
    count = lambda k: {(r.gene, len(r.path)): r.b for r in k.lr_b.collect()}
    assert count(every) == {("g", 1): 3, ("g", 2): 1, ("h", 1): 1, ("q", 1): 1, ("q", 12): 1}
    assert count(good) == {("g", 1): 3, ("g", 2): 1, ("h", 1): 1, ("q", 12): 1}


def test_keep_sr_regions(spark, tables):
    """Of regions without short reads, the exons (alone) stay by policy; only the selection real_data leaves any out."""
    exons, _ = tables
    short = spark.createDataFrame([read("r1", 0, 0, 2), read("r2", 0, 0), read("r3", 10000, 0)], READS)
    seen = {"g": {"0", "0,2"}, "h": {"0"}}
    alone = {"g": {"1", "2"}, "h": {"1", "2"}, "q": {str(i) for i in range(12)}}
    join = lambda a, b, genes="ghq": {g: a.get(g, set()) | b.get(g, set()) for g in genes}
    for policy, wanted in (
        ("none", seen),
        ("all", join(seen, alone)),
        # two regions tell a and b apart; one tells no two isoforms apart, and q has no region with reads
        ("nonfullrank", join(seen, {k: v for k, v in alone.items() if k != "g"})),
    ):
        s = KValueSettings(region_selection="real_data", keep_sr_regions=policy)
        got = api.k_values(spark, exons, s, short_reads=short)
        assert regions_of(got.matrix) == {k: v for k, v in wanted.items() if v}, policy
        b = {(r.gene, ",".join(map(str, r.path))): r.b for r in got.sr_b.collect()}
        assert b["g", "0,2"] > 0 and all(v == 0 for k, v in b.items() if k[1] not in seen.get(k[0], ()))
    whole = api.k_values(spark, exons, KValueSettings(read_length=90), short_reads=short)
    assert len(regions_of(whole.matrix)["q"]) >= 12


def test_weights_only_with_reads(spark, tables):
    """Cells of a gene without long reads keep their own values, though the table names it."""
    exons, reads = tables
    reads = reads.where("name not like 'h%'")
    rows = [("c", "g", "a", "0", 3.0), ("c", "g", "a", "0,1,2", 1.0), ("c", "g", "b", "0", 1.0), ("c", "h", "d", "0,1", 5.0), ("c", "h", "e", "9", 5.0)]
    weights = spark.createDataFrame(rows, "chr string, gene string, isoform string, region string, weight double")
    got = api.k_values(spark, exons, KValueSettings(full_length_regions="all"), long_reads=reads, weights=weights)
    cells = {(r.isoform, ",".join(map(str, r.path))): r.a for r in got.lr_matrix.where("gene in ('g', 'h')").collect()}
    assert cells["a", "0"] == 0.75 and cells["a", "0,1,2"] == 0.25 and cells["b", "0"] == 1 and cells["b", "0,2"] == 0
    assert cells["d", "0,1"] == 1 and cells["e", "1,2"] == 1
    with pytest.raises(ValueError, match="weights"):
        api.k_values(spark, exons, weights=weights)


@pytest.mark.parametrize("assign", ["linear_model", "reassign"])
def test_region_abundance(spark, tables, assign):
    """Of gene g, three reads are shared and one is of b alone."""
    exons, reads = tables
    k = api.k_values(spark, exons, KValueSettings(full_length_regions="all"), long_reads=reads)
    got = {r.isoform: r for r in api.region_abundance(k, assign=assign).collect()}
    assert set(got) == {"a", "b", "d", "e", "z", "y"}
    assert sum(got[i].expression for i in "ab") == pytest.approx(4) and sum(r.tpm for r in got.values()) == pytest.approx(1e6)
    a = np.array([[0.5, 0.5], [0.5, 0], [0, 0.5]])  # regions 0, the whole of a, the whole of b
    x = np.linalg.lstsq(np.vstack([a, 1e-3 * np.eye(2)]), np.array([3, 0, 1, 0, 0.0]), rcond=None)[0]
    assert [got["a"].theta, got["b"].theta] == pytest.approx(x / x.sum(), rel=1e-3)
    with pytest.raises(ValueError, match="assign"):
        api.region_abundance(k, assign="x")
    with pytest.raises(ValueError, match="reads"):
        api.region_abundance(api.k_values(spark, exons))


def test_genes_of_many_reads(spark, tables, monkeypatch):
    """The placements of one gene dealt over several tasks map as in one."""
    exons, _ = tables
    rows = [read(f"x{i}", 0, 0, 2)[:3] + (1 + i % 9, 60, f"{100 - i % 9}M500N{60 + i}M") for i in range(40)] + [read(f"y{i}", 10000, 0) for i in range(3)]
    reads = spark.createDataFrame(rows, READS)
    segs = paths.segments(exons)
    iso_paths = paths.paths(segs, exons)
    mapped = lambda: collections.Counter((r.name, r.gene, tuple(r.path)) for r in mapping.map_reads(reads, paths.gene_segments(segs), iso_paths, QuantifySettings()).collect())  # noqa: E731, E501
    one = mapped()
    monkeypatch.setattr(mapping, "GROUP_ROWS", 5)
    assert mapped() == one and sum(one.values()) == 43
    monkeypatch.setattr(mapping, "BROADCAST_GENES", 0)
    assert mapped() == one


def test_lengths_of_regions(spark):
    rows = spark.createDataFrame([("c", "g", [0], n) for n in (5, 5, 7)], "chr string, gene string, path array<int>, read_length int")
    got = mapping.region_counts(rows).first()
    assert got.n == 3 and sorted(map(tuple, got.lengths)) == [(5, 2), (7, 1)]
