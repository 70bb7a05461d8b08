"""Communities: connected components of the read-isoform-gene graph, found among genes.

All isoforms of a gene are tied, so only reads on several genes add edges; the graph that iterates has genes as nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import settle


def patterns(compat: DataFrame, value: str) -> DataFrame:
    """Reads with equal isoforms and probabilities as one: rows (pattern, members: array<struct(isoform, v)>, n)."""
    one = F.array_sort(F.collect_list(F.struct("isoform", F.col(value).alias("v"))))
    sets = compat.groupBy("name").agg(one.alias("members")).groupBy("members").agg(F.count("*").alias("n"))
    return sets.select(F.xxhash64("members").alias("pattern"), "members", "n")


def distinct_patterns(compat: DataFrame) -> DataFrame:
    """rows (isoforms, n): the distinct isoform sets of reads."""
    sets = compat.groupBy("name").agg(F.array_sort(F.collect_set("isoform")).alias("isoforms"))
    return sets.groupBy("isoforms").agg(F.count("*").alias("n"))


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """nodes (node), edges (u, v) -> rows (node, label): label is the least node of the component.

    Each round takes the least label around a node, then the label of that label, so long chains halve.
    """
    both = settle(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct())
    labels = settle(nodes.select("node", F.col("node").alias("label")).distinct())
    for _ in range(max_rounds):
        near = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("near"))
        hooked = labels.join(near, labels["node"] == near["u"], "left").select("node", F.least("label", F.coalesce("near", "label")).alias("label"), F.col("label").alias("old"))
        ends = hooked.select(F.col("node").alias("label"), F.col("label").alias("end"))
        after = settle(hooked.join(ends, "label").select("node", F.least("label", "end").alias("label"), "old"))
        if not after.where("label <> old").take(1):
            return after.select("node", "label")
        labels = after.select("node", "label")
    raise RuntimeError("components did not settle")


def communities(isoform_genes: DataFrame, *pattern_tables: DataFrame) -> DataFrame:
    """isoform_genes (isoform, gene) and pattern tables -> rows (isoform, gene, community): community is the least gene.

    A pattern ties all its genes; the first is joined to each of the others, not each to each.
    """
    edges = None
    for table in pattern_tables:
        rows = table.select("pattern", F.explode("members.isoform").alias("isoform")).join(isoform_genes, "isoform")
        tied = rows.groupBy("pattern").agg(F.array_sort(F.collect_set("gene")).alias("g")).where("size(g) > 1")
        some = tied.select(F.col("g")[0].alias("u"), F.explode(F.expr("slice(g, 2, size(g))")).alias("v")).distinct()
        edges = some if edges is None else edges.union(some)
    genes = isoform_genes.select(F.col("gene").alias("node")).distinct()
    if edges is None or not edges.take(1):
        return isoform_genes.withColumn("community", F.col("gene"))
    found = components(genes, edges)
    return isoform_genes.join(found, isoform_genes["gene"] == found["node"]).select("isoform", "gene", F.col("label").alias("community"))
