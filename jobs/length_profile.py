"""Keep the read-length profile of each sample up to date as files of reads arrive.

    python -m jobs.length_profile --input DIR --output DIR --checkpoint DIR [--config FILE]

Reads are a table of texts in files that are added to over time; a file stream with a checkpoint takes each file once.
Its running counts are kept by sample and length in OUTPUT/lengths. From these and the isoforms' lengths, OUTPUT/profile
is written anew, by sample: read_len, n (reads of this length), cdf (share of the sample's reads of 1 to read_len), and
sm, the sum of theta / cdf over isoforms at least as long. read_len, n and sm of one sample are a table of read-length
overrides for quantify().

A run that finds no new file writes the same profile again. A run that is broken off is made good by the next one: what
the stream had not committed it takes again, and both outputs are replaced as a whole. Null texts are of length 0, which
counts in n and in no cdf; null samples are named `none`.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import asked, checked, command_line, inputs, log
from spliceframe.operators import readlen

CONFIG = os.path.join(os.path.dirname(os.path.abspath(__file__)), "length_profile.json")


def update_lengths(spark: SparkSession, reads: dict, folder: str, lengths: str, checkpoint: str) -> int:
    """Take the files that are new into the table of lengths (sample, read_len, n); how many reads they hold."""
    path = f"{folder.rstrip('/')}/{reads['path']}"
    kind, options = reads.get("format", "parquet"), reads.get("options", {})
    schema = spark.read.format(kind).options(**options).load(path).schema
    # a pattern that matches just this path: the stream then takes a folder that grows and a single file alike
    pattern = f"{path[:-1]}[{path[-1]}]"
    rows = spark.readStream.schema(schema).format(kind).options(**options)
    rows = rows.option("maxFilesPerTrigger", reads.get("files_a_batch", 1000)).load(pattern)
    sample = F.coalesce(F.col(reads["sample"]).cast("string"), F.lit("none"))
    length = F.coalesce(F.char_length(reads["text"]), F.lit(0)).cast("long")
    counts = readlen.histogram(rows.select(sample.alias("sample"), length.alias("read_len")), by=["sample"])

    def keep(every: DataFrame, batch: int) -> None:
        # a task for each partition of the state: one task for all of them would hold the hash tables of all
        every.write.mode("overwrite").parquet(lengths)
        log.info("batch %d: counts written to %s", batch, lengths)

    stream = counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", checkpoint)
    running = stream.trigger(availableNow=True).start()
    running.awaitTermination()
    taken = sum(p["numInputRows"] for p in running.recentProgress)
    log.info("read %d new rows of %s", taken, path)
    return taken


def profile(lengths: DataFrame, isoforms: DataFrame) -> DataFrame:
    """rows (sample, read_len, n, cdf, sm) from lengths (sample, read_len, n) and isoforms (isoform, iso_len, theta)."""
    by_length = isoforms.groupBy(F.col("iso_len").cast("long").alias("iso_len")).agg(F.sum("theta").alias("theta"))
    # each sample has its own CDF at each isoform length: a row for each sample and distinct length
    asked_at = lengths.select("sample").distinct().crossJoin(F.broadcast(by_length))
    known = readlen.cdf_at(lengths, asked_at, "iso_len", by=["sample"])
    sums = readlen.suffix_sums(lengths, known, by=["sample"])
    return readlen.cdf_at(sums, sums, "read_len", by=["sample"]).select("sample", "read_len", "n", "cdf", "sm")


def run(spark: SparkSession, config: dict, input: str, output: str, checkpoint: str) -> DataFrame:
    """Take what is new in input, write output and read its profile back."""
    lengths, out = f"{output.rstrip('/')}/lengths", f"{output.rstrip('/')}/profile"
    update_lengths(spark, checked(config, "reads isoforms")["reads"], input, lengths, checkpoint)
    isoforms = asked(spark, config["isoforms"], inputs(spark, config, input))
    found = profile(spark.read.parquet(lengths), isoforms)
    found.repartition("sample").write.mode("overwrite").partitionBy("sample").parquet(out)
    schema = "read_len long, n long, cdf double, sm double, sample string"
    back = spark.read.schema(schema).parquet(out)
    rows, samples, reads = back.agg(F.count("*"), F.countDistinct("sample"), F.sum("n")).first()
    log.info("wrote %d rows of %d samples and %s reads to %s", rows, samples, reads, out)
    return back


if __name__ == "__main__":
    paths = {"input": "folder of the tables", "output": "folder to write to", "checkpoint": "folder of the stream's checkpoint"}
    command_line(__doc__, run, paths, CONFIG)
