"""Column functions against hand-made rows."""

import math

import pytest
from pyspark.sql import functions as F

from spliceframe.config import KValueSettings, QuantifySettings, settings_of
from spliceframe.functions import columns as C


def one(spark, **values):
    return spark.createDataFrame([tuple(values.values())], list(values))


@pytest.mark.parametrize(
    ("cigar", "lens", "mapped"),
    [
        ("10M", [10], 10),
        ("5S10M", [10], 10),
        ("10M5N10M", [10, 5, 10], 20),
        ("10M5N2I10M", [10, 5, 10], 20),
        ("3H4M1D4M", [9], 9),
        ("10M5N2I5N10M", [10, 5, 5, 10], 15),
        ("4=2X3P1M", [7], 7),
        ("*", [], 0),
        (None, [], 0),
    ],
)
def test_cigar(spark, cigar, lens, mapped):
    df = spark.createDataFrame([(cigar,)], "c string").select(C.cigar_lengths(F.col("c")).alias("l"))
    row = df.select("l", C.mapped_length(F.col("l")).alias("m"), C.blocks(F.col("l"), F.lit(100)).alias("b")).first()
    assert row["l"] == lens
    assert row["m"] == mapped
    at, want = 100, []
    for i, n in enumerate(lens):
        if i % 2 == 0:
            want.append((at, at + n - 1))
        at += n
    assert [tuple(x) for x in row["b"]] == want


def test_contigs_and_attributes(spark):
    names = {"chr1": "1", "chrX": "chrX", "CHR22": "22", "chr1_alt": "chr1_alt", "7": "7", "chrM": "chrM", "": ""}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = dict(df.select("n", C.canonical_contig(F.col("n"))).collect())
    assert got == names
    text = 'gene_id "G.1"; transcript_id "T1"; tag "a"; tag "b";'
    row = one(spark, a=text).select(C.attribute(F.col("a"), "gene_id"), C.attribute(F.col("a"), "none"), C.attributes(F.col("a"))).first()
    assert row[0] == "G.1" and row[1] is None
    assert row[2] == {"gene_id": "G.1", "transcript_id": "T1", "tag": "b"}


def test_best_gene_fold_depends_on_order(spark):
    def kept(*rows):
        df = spark.createDataFrame([([dict(zip(("gene", "overlap", "length"), r, strict=True)) for r in rows],)], "c array<struct<gene:string,overlap:bigint,length:bigint>>")
        return [x["gene"] for x in df.select(C.best_gene_fold(F.col("c"))).first()[0]]

    assert kept(("a", 100, 100), ("b", 99, 101)) == ["a", "b"]
    assert kept(("a", 100, 100), ("b", 101, 80)) == ["b"]
    assert kept(("a", 100, 100), ("b", 90, 10)) == ["a"]
    assert kept(("a", 100, 100), ("b", 102, 101), ("c", 104, 102)) == ["a", "b", "c"]
    assert kept(("a", 2, 50)) == []


def test_effective_length_is_a_constant_offset_far_from_the_mean(spark):
    df = spark.createDataFrame([(n,) for n in (900, 1025, 3768)], "n int")
    got = [n - e for n, e in df.select("n", C.effective_length(F.col("n"), F.lit(233.0), F.lit(30.0))).collect()]
    assert max(got) - min(got) < 1e-9
    small = one(spark, n=10).select(C.effective_length(F.col("n"), F.lit(233.0), F.lit(30.0))).first()[0]
    assert small == 1.0


def test_regions(spark):
    kinds = [r[0] for r in spark.range(1, 5).select(C.region_type(F.col("id"))).collect()]
    assert kinds == ["one_exon", "one_junction", "junctions", "junctions"]
    joined = [r[0] for r in spark.range(1, 5).select(C.region_type(F.col("id"), F.col("id") - 1)).collect()]
    assert joined == ["one_exon", "two_exons", "exons", "exons"]
    w = one(spark, i=200).select(C.inner_weight(F.col("i"), F.lit(150))).first()[0]
    assert w == 1.0
    assert one(spark, s="ACgtN").select(C.reverse_complement(F.col("s"))).first()[0] == "NacGT"
    row = one(spark, p=[0, 1, 3]).select(C.region_name(F.col("p")), C.path_text(F.col("p"))).first()
    assert tuple(row) == ("P0:P1-P2:P3-P6:P7", ",0,1,3,")


def test_division_guards(spark):
    row = one(spark, a=1.0, b=0.0).select(
        C.safe_divide(F.col("a"), F.col("b")), C.divide_or_infinity(F.col("a"), F.col("b")),
        C.zero_below(F.lit(float("nan"))), C.zero_below(F.lit(1e-120)), C.zero_below(F.lit(0.5)),
    ).first()
    assert row[0] == 1.0 and math.isinf(row[1]) and row[2] == 0.0 and row[3] == 0.0 and row[4] == 0.5


def test_options():
    assert settings_of(KValueSettings, read_length=100).read_length == 100
    with pytest.raises(ValueError, match="no effect"):
        settings_of(QuantifySettings, kde_path="x")
    with pytest.raises(ValueError, match="unknown"):
        settings_of(QuantifySettings, whatever=1)
    with pytest.raises(ValueError, match="cond_prob"):
        C.conditional_probability("form_9", *[F.lit(1)] * 5)
