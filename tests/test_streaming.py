"""Region counts of a stream equal those of one batch."""

from spliceframe.config import QuantifySettings
from spliceframe.operators import mapping, paths
from spliceframe.streaming import regions


def test_stream_counts(spark, tmp_path):
    rows = [("1", "A", "A1", "+", 100, 199), ("1", "A", "A1", "+", 300, 399), ("1", "A", "A2", "+", 100, 199)]
    exons = spark.createDataFrame(rows, "chr string, gene string, isoform string, strand string, start int, end int")
    schema = "name string, chr string, pos int, cigar string"
    data = [(f"r{i}", "1", 110, "90M100N90M" if i % 3 else "80M") for i in range(12)]
    for k in range(2):
        spark.createDataFrame(data[k::2], schema).write.mode("append").parquet(f"{tmp_path}/in")
    reads = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = regions.count_regions(reads, exons, f"{tmp_path}/out", f"{tmp_path}/c")
    query.processAllAvailable()
    query.stop()
    got = {tuple(r.path): r.n for r in regions.totals(spark.read.parquet(f"{tmp_path}/out")).collect()}
    segs = paths.segments(exons)
    want = mapping.map_reads(spark.createDataFrame(data, schema), paths.gene_segments(segs), paths.paths(segs, exons), QuantifySettings())
    assert got == {tuple(r.path): r.n for r in mapping.region_counts(want).collect()} == {(0,): 4, (0, 1): 8}
