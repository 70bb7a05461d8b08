"""Count long reads by region of each gene, and write the counts by chromosome.

    python -m jobs.region_counts --input DIR --output DIR [--config FILE]

The config's SQL makes exons (chr, gene, isoform, strand, start, end) and alignments (name, flag, chr, pos, mapq, cigar)
from the tables it names. Reads are mapped to the genes' segment paths; each is counted once. With filter_reads, reads on
regions much shorter than an isoform of theirs are left out. Output, partitioned by chr: gene, region (the numbers of its
segments), coordinates, isoforms, n (its reads), and the gene's n_unique and n_multi: reads on regions of one isoform and
of several. Regions without reads are there for whole isoforms, as the policy full_length_regions says.

With "chromosomes" in the config only these are read and replaced, and the others stay as they are; without, the whole
output is replaced. The same input gives the same files' contents each time.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import asked, checked, command_line, inputs, log, rows_seen, watched
from spliceframe.config import QuantifySettings, settings_of
from spliceframe.operators import mapping, paths, supported
from spliceframe.plans.scratch import merged, settle

CONFIG = os.path.join(os.path.dirname(os.path.abspath(__file__)), "region_counts.json")
GENE = paths.GENE


KEYS = "exons alignments chromosomes settings full_length_regions filter_reads"


def counts(exons: DataFrame, alignments: DataFrame, settings: QuantifySettings, policy: str, filter_reads: bool) -> DataFrame:
    """rows (chr, gene, region, coordinates, isoforms, n, n_unique, n_multi)."""
    segs, iso_paths = paths.laid_out(exons)
    alignments, read = watched(alignments, "alignments")
    mapped = settle(mapping.pick_one(mapping.map_reads(alignments, paths.gene_segments(segs), iso_paths, settings)))
    log.info("read %d alignments, %d reads are on a region", rows_seen(read), mapped.count())
    if filter_reads:
        mapped = mapping.region_qc(mapped, iso_paths, paths.isoforms(exons))
    regions = settle(supported.long_read_regions(mapped, iso_paths, policy))
    found = regions.join(supported.counts_by_owner(regions), GENE)
    found = found.join(supported.coordinates(regions, segs), [*GENE, "path"])
    names = F.array_join(F.col("path").cast("array<string>"), ",")
    owners = F.array_join("isoforms", "|")
    return found.select(*GENE, names.alias("region"), "coordinates", owners.alias("isoforms"), "n", "n_unique", "n_multi")


def run(spark: SparkSession, config: dict, input: str, output: str) -> DataFrame:
    """Read input, write output and read it back."""
    # by their compressed files genes would pass for a small table, and be broadcast by way of the driver
    tables = {name: merged(t) for name, t in inputs(spark, checked(config, KEYS), input).items()}
    exons, alignments = (asked(spark, config[k], tables) for k in ("exons", "alignments"))
    only = config.get("chromosomes")
    if only:
        exons, alignments = (t.where(F.col("chr").isin(only)) for t in (exons, alignments))
    settings = settings_of(QuantifySettings, **config.get("settings", {}))
    policy, qc = config.get("full_length_regions", "none"), config.get("filter_reads", False)
    found = counts(exons, alignments, settings, policy, qc)
    writer = found.repartition("chr").write.mode("overwrite").partitionBy("chr")
    writer.option("partitionOverwriteMode", "dynamic" if only else "static").parquet(output)
    schema = "gene string, region string, coordinates string, isoforms string, n long, n_unique long, n_multi long, chr string"
    back = spark.read.schema(schema).parquet(output)
    rows, chromosomes, reads = back.agg(F.count("*"), F.countDistinct("chr"), F.sum("n")).first()
    log.info("wrote %d regions of %d chromosomes with %s reads to %s", rows, chromosomes, reads, output)
    return back


if __name__ == "__main__":
    command_line(__doc__, run, {"input": "folder of the tables", "output": "folder to write to"}, CONFIG)
