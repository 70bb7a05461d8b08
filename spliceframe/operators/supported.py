"""Regions by the reads that support them: which of them make up a gene's matrix, and its abundance vector."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import merged, settle
from .condition import dense, gram_of_sums, numbered, owner_sums
from .paths import GENE, owners

POLICIES = ("all", "none", "nonfullrank")
EXON_KINDS = ("one_exon", "two_exons", "exons")


def counted(regions: DataFrame, mapped: DataFrame) -> DataFrame:
    """regions plus n: the reads (rows of mapped: chr, gene, path) of each, 0 for none."""
    n = mapped.groupBy(*GENE, "path").agg(F.count("*").alias("n"))
    return regions.drop("n").join(merged(n), [*GENE, "path"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def full_rank(regions: DataFrame, isoforms: DataFrame) -> DataFrame:
    """rows (chr, gene, full): whether the 0/1 matrix of a gene's regions has as many independent columns as isoforms
    (chr, gene, isoform). Genes without a region aren't listed."""
    at = F.col("at")
    sums = owner_sums(regions, F.lit(1.0))
    gene = gram_of_sums(sums, normalize=False).groupBy(*GENE).agg(F.collect_list(F.struct("i", "j", "g")).alias("cells"))
    packed = gene.join(numbered(isoforms), GENE).select(
        *GENE, F.size("at").alias("n"), F.transform("cells", lambda x: F.struct(at[x["i"]].alias("i"), at[x["j"]].alias("j"), x["g"].alias("g"))).alias("cells")
    )

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            full = []
            for n, c in zip(batch.column("n").to_pylist(), batch.column("cells"), strict=True):
                g = dense(n, *(c.values.field(f).to_numpy() for f in ("i", "j", "g")))
                full.append(int(np.linalg.matrix_rank(g)) == n)
            yield pa.RecordBatch.from_arrays([batch.column("chr"), batch.column("gene"), pa.array(full)], names=[*GENE, "full"])

    return packed.mapInArrow(rank, "chr string, gene string, full boolean")


def kept_by(policy: str, rows: DataFrame, spared: Column, isoforms: DataFrame) -> DataFrame:
    """rows (regions with n) with reads, and of those without the spared ones: in all genes, in none, or in genes whose
    regions with reads don't have full rank."""
    if policy not in POLICIES:
        raise ValueError(f"a policy is one of {', '.join(POLICIES)}, not {policy}")
    seen = F.col("n") > 0
    if policy == "none":
        return rows.where(seen)
    if policy == "all":
        return rows.where(seen | spared)
    rows = settle(rows)  # both sides of the join read them
    ranked = rows.join(full_rank(rows.where(seen), isoforms), GENE, "left")
    return ranked.where(seen | (spared & ~F.coalesce("full", F.lit(False)))).drop("full")


def long_read_regions(mapped: DataFrame, iso_paths: DataFrame, policy: str = "all") -> DataFrame:
    """rows (chr, gene, path, isoforms, n): regions with long reads, and by policy the whole paths of isoforms."""
    whole = iso_paths.where("size(path) > 0").select(*GENE, "path").distinct().withColumn("whole", F.lit(True))
    asked = mapped.select(*GENE, "path").distinct().join(whole, [*GENE, "path"], "full")
    owned = owners(asked, iso_paths).groupBy(*GENE, "path").agg(F.array_sort(F.collect_set("isoform")).alias("isoforms"))
    rows = counted(asked.join(merged(owned), [*GENE, "path"]), mapped)
    return kept_by(policy, rows, F.coalesce("whole", F.lit(False)), iso_paths).drop("whole")


def short_read_regions(regions: DataFrame, mapped: DataFrame, isoforms: DataFrame, selection: str, policy: str = "nonfullrank") -> DataFrame:
    """regions plus n. Only the selection real_data leaves out regions without reads; policy spares those of exons."""
    rows = counted(regions, mapped)
    return kept_by(policy, rows, F.col("kind").isin(*EXON_KINDS), isoforms) if selection == "real_data" else rows


def abundance(regions: DataFrame, eff: Column | None = None) -> DataFrame:
    """rows (chr, gene, path, b): reads of each region, for short reads over its effective length."""
    return regions.select(*GENE, "path", (F.col("n") / eff if eff is not None else F.col("n")).cast("double").alias("b"))


def counts_by_owner(regions: DataFrame) -> DataFrame:
    """rows (chr, gene, n_unique, n_multi): reads on regions of one isoform, and of several."""
    many = F.size("isoforms") > 1
    return regions.groupBy(*GENE).agg(
        F.sum(F.when(many, 0).otherwise(F.col("n"))).alias("n_unique"), F.sum(F.when(many, F.col("n")).otherwise(0)).alias("n_multi")
    )


def weighted(matrix: DataFrame, weights: DataFrame) -> DataFrame:
    """A 0/1 matrix (chr, gene, path, isoform, a) with the weights (chr, gene, isoform, region, weight) of its cells, and
    columns that sum to 1. In genes that weights names, cells without a weight are 0; other genes keep theirs. region is
    a path as text with commas. An isoform that stands for several (names joined by '-') takes the weights of its own
    name, or else of the first of these that has some."""
    named = matrix.withColumn("region", F.array_join(F.col("path").cast("array<string>"), ","))
    names = F.concat(F.array("isoform"), F.when(F.instr("isoform", "-") > 0, F.split("isoform", "-")).otherwise(F.array().cast("array<string>")))
    own = matrix.select(*GENE, "isoform").distinct().select(*GENE, "isoform", F.posexplode(names).alias("rank", "as"))
    known = weights.select(*GENE, F.col("isoform").alias("as")).distinct()
    chosen = own.join(known, [*GENE, "as"]).groupBy(*GENE, "isoform").agg(F.min_by("as", "rank").alias("as"))
    cells = weights.groupBy(*GENE, F.col("isoform").alias("as"), "region").agg(F.max("weight").alias("weight"))
    genes = weights.select(*GENE).distinct().withColumn("listed", F.lit(True))
    put = named.join(genes, GENE, "left").join(chosen, [*GENE, "isoform"], "left").join(cells, [*GENE, "as", "region"], "left")
    raw = put.withColumn("a", F.when(F.col("listed"), F.coalesce("weight", F.lit(0.0))).otherwise(F.col("a")))
    total = F.sum("a").over(Window.partitionBy(*GENE, "isoform"))
    return raw.select(*GENE, "path", "isoform", (F.col("a") / F.when(total == 0, 1).otherwise(total)).alias("a"))


def coordinates(regions: DataFrame, segs: DataFrame) -> DataFrame:
    """rows (chr, gene, path, coordinates): 'start-end' of each of a region's segments, with commas."""
    gene = segs.groupBy(*GENE).agg(
        F.map_from_entries(F.collect_list(F.struct("seg", F.concat_ws("-", F.col("start"), F.col("end"))))).alias("at")
    )
    text = F.array_join(F.transform("path", lambda p: F.col("at")[p]), ",")
    return regions.select(*GENE, "path").distinct().join(gene, GENE).select(*GENE, "path", text.alias("coordinates"))


def segment_distances(regions: DataFrame) -> DataFrame:
    """rows (kind, distance, n): reads by how many segments their region (chr, gene, path, isoforms, n) lacks of the longest
    listed region of its isoform (unique), or of the median of its isoforms (multi)."""
    # a distance depends on the owners and the size alone: paths are summed away before a gene's rows meet
    kinds = regions.where("size(isoforms) > 0").groupBy(*GENE, "isoforms", F.size("path").alias("size")).agg(F.sum(F.when(F.col("n") > 0, F.col("n"))).alias("n"))
    gene = kinds.groupBy(*GENE).agg(F.collect_list(F.struct("isoforms", "size", "n")).alias("rows"))
    most = "map_from_entries(transform(array_distinct(flatten(rows.isoforms)), i -> struct(i, array_max(transform(filter(rows, r -> array_contains(r.isoforms, i)), r -> r.size)))))"
    gene = gene.select("rows", F.expr(most).alias("most"))  # ahead of the explode: once for a gene
    each = gene.select("most", F.explode("rows").alias("r")).where("r.n > 0")
    each = each.select("r.n", F.size("r.isoforms").alias("k"), F.expr("array_sort(transform(r.isoforms, i -> most[i] - r.size))").alias("short"))
    median = F.expr("(short[(k - 1) div 2] + short[k div 2]) / 2D")
    kind = F.when(F.col("k") > 1, "multi").otherwise("unique")
    return each.groupBy(kind.alias("kind"), median.alias("distance")).agg(F.sum("n").alias("n"))


def short_isoforms(mapped: DataFrame, regions: DataFrame, iso: DataFrame) -> DataFrame:
    """rows (chr, gene, isoform, length, longest): isoforms of regions (chr, gene, path, isoforms) that are shorter than
    their gene's longest read (mapped: chr, gene, read_length)."""
    longest = mapped.groupBy(*GENE).agg(F.max("read_length").alias("longest"))
    owned = regions.select(*GENE, F.explode("isoforms").alias("isoform")).distinct().join(iso.select(*GENE, "isoform", "length"), [*GENE, "isoform"])
    return owned.join(longest, GENE).where("length < longest")
