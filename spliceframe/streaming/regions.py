"""Read counts from a stream of alignments: the stateless part of the analysis, then running counts.

Mapping a read needs only the annotation, so a stream of reads maps batch by batch; counts per region are a running
aggregation. EM doesn't extend to streams: it needs all counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import QuantifySettings
from ..operators import mapping, paths
from ..operators.paths import GENE


def count_regions(reads: DataFrame, exons: DataFrame, table_path: str, checkpoint: str, s: QuantifySettings | None = None) -> StreamingQuery:
    """Map each micro-batch of reads (name, chr, pos, cigar) and keep its counts under table_path/batch=<id>.

    A batch that is run again replaces its own folder, so each read counts once.
    """
    s = s or QuantifySettings()
    segs = paths.segments(exons)
    genes, iso_paths = paths.gene_segments(segs), paths.paths(segs, exons)

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        counts = mapping.region_counts(mapping.map_reads(batch, genes, iso_paths, s)).drop("lengths")
        counts.write.mode("overwrite").parquet(f"{table_path}/batch={batch_id}")

    return reads.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint).start()


def totals(counts: DataFrame) -> DataFrame:
    """rows (chr, gene, path, n) over all batches."""
    return counts.groupBy(*GENE, "path").agg(F.sum("n").alias("n"))
