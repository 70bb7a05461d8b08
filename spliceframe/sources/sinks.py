"""Sinks: tab-separated results in one order, and matrix dumps in a bounded number of folders. Only the named path is replaced."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_tsv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """A folder of tab-separated parts with a header; in the order of the parts the rows are sorted."""
    out = df.orderBy(*order) if order else df
    flat = out.select(*[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) if t.startswith("array") else F.col(c) for c, t in out.dtypes])
    flat.write.mode("overwrite").csv(path, sep="\t", header=True, nullValue="NA")


MATRIX_FOLDERS = 256


def write_matrix(entries: DataFrame, path: str, folders: int = MATRIX_FOLDERS) -> None:
    """Matrix entries (chr, gene, region, isoform, a) as Parquet, in folders (part) that hold whole genes, sorted by gene: a
    folder for each gene where there are few, and no more than `folders` however many there are."""
    dealt = entries.withColumn("part", F.pmod(F.xxhash64("gene"), F.lit(folders))).repartition("part")
    dealt.sortWithinPartitions("part", "gene", "chr").write.mode("overwrite").partitionBy("part").parquet(path)
