"""Sources: annotation, alignments and the small tables that override estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import attribute, attributes, canonical_contig, passes_flags, query_length, reverse_complement


def gtf_rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a GTF as (chr, source, feature, start, end, score, strand, frame, attributes), as written."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#"))
    f = F.split("value", "\t")
    names = ("chr", "source", "feature", "start", "end", "score", "strand", "frame", "attributes")
    rows = lines.where(F.size(f) >= 9).select(*[F.get(f, F.lit(i)).alias(n) for i, n in enumerate(names)])
    return rows.withColumns({c: F.expr(f"try_cast({c} as long)") for c in ("start", "end")})


def exons(spark: SparkSession, path: str, canonical: bool = True) -> DataFrame:
    """rows (chr, gene, isoform, strand, start, end) of the exon rows with both names and start <= end."""
    rows = gtf_rows(spark, path).where("feature = 'exon' and start <= end")
    named = rows.select(
        (canonical_contig(F.col("chr")) if canonical else F.col("chr")).alias("chr"),
        attribute(F.col("attributes"), "gene_id").alias("gene"),
        attribute(F.col("attributes"), "transcript_id").alias("isoform"),
        "strand",
        "start",
        "end",
    )
    return named.where("gene is not null and isoform is not null")


def rejected_exons(spark: SparkSession, path: str) -> DataFrame:
    """Exon rows that exons() leaves out, as they are: no number, start after end, or a name missing."""
    a = F.col("attributes")
    bad = F.expr("start is null or end is null or start > end")
    return gtf_rows(spark, path).where(
        (F.col("feature") == "exon") & (bad | attribute(a, "gene_id").isNull() | attribute(a, "transcript_id").isNull())
    )


def gene_ranges(spark: SparkSession, path: str) -> DataFrame:
    """rows (chr, gene, start, end) of the gene rows."""
    rows = gtf_rows(spark, path).where("feature = 'gene'")
    return rows.select("chr", attribute(F.col("attributes"), "gene_id").alias("gene"), "start", "end")


def gtf_attributes(spark: SparkSession, path: str) -> DataFrame:
    """All rows with their attributes as a map."""
    return gtf_rows(spark, path).withColumn("attributes", attributes(F.col("attributes")))


def alignments(spark: SparkSession, path: str, policy: str = "best", mask: int = 2820) -> DataFrame:
    """Long reads of a SAM text: rows (name, flag, chr, pos, mapq, cigar); no header, unmapped or filtered records."""
    lines = spark.read.text(path).where(~F.col("value").startswith("@"))
    f = F.split("value", "\t", 12)
    rows = lines.where(F.size(f) >= 11).select(
        F.get(f, F.lit(0)).alias("name"),
        F.get(f, F.lit(1)).try_cast("int").alias("flag"),
        F.get(f, F.lit(2)).alias("rname"),
        F.get(f, F.lit(3)).try_cast("long").alias("pos"),
        F.get(f, F.lit(4)).try_cast("int").alias("mapq"),
        F.get(f, F.lit(5)).alias("cigar"),
    )
    kept = rows.where(F.col("rname") != "*").where(passes_flags(F.col("flag"), F.col("mapq"), policy, mask))
    return kept.select("name", "flag", canonical_contig(F.col("rname")).alias("chr"), "pos", "mapq", "cigar")


def fragments(spark: SparkSession, path: str) -> DataFrame:
    """Short-read fragments of a SAM against transcripts: rows (name, isoform, tlen), template lengths above 0. Of
    repeated (name, isoform) the last line holds."""
    lines = spark.read.text(path).where(~F.col("value").startswith("@"))
    f = F.split("value", "\t", 12)
    rows = lines.where(F.size(f) >= 11).select(
        F.get(f, F.lit(0)).alias("name"), F.substring_index(F.get(f, F.lit(2)), "|", 1).alias("isoform"), F.get(f, F.lit(8)).try_cast("int").alias("tlen"),
        F.monotonically_increasing_id().alias("line"),
    )
    return rows.where("tlen > 0").groupBy("name", "isoform").agg(F.max_by("tlen", "line").alias("tlen"))


def all_fragment_lengths(spark: SparkSession, path: str) -> DataFrame:
    """Every template length above 0 with its isoform, repeats included: what the fragment statistics are taken of."""
    lines = spark.read.text(path).where(~F.col("value").startswith("@"))
    f = F.split("value", "\t", 12)
    rows = lines.where(F.size(f) >= 11).select(F.substring_index(F.get(f, F.lit(2)), "|", 1).alias("isoform"), F.get(f, F.lit(8)).try_cast("int").alias("tlen"))
    return rows.where("tlen > 0")


def sequence_lengths(spark: SparkSession, path: str) -> DataFrame:
    """rows (isoform, length) of a SAM's @SQ header lines; names are cut at the first bar."""
    lines = spark.read.text(path).where(F.col("value").startswith("@SQ"))
    return lines.select(
        F.substring_index(F.regexp_extract("value", "SN:([^\\t]*)", 1), "|", 1).alias("isoform"),
        F.regexp_extract("value", "LN:([0-9]+)", 1).try_cast("int").alias("length"),
    )


def first_read_length(spark: SparkSession, path: str, default: int = 150) -> int:
    """Query length of the first record that has one, or the default."""
    lines = spark.read.text(path).where(~F.col("value").startswith("@"))
    n = query_length(F.get(F.split("value", "\t", 12), F.lit(5)))
    row = lines.select(n.alias("n")).where("n > 0").first()
    return int(row["n"]) if row else default


def alphas(spark: SparkSession, path: str) -> DataFrame:
    """rows (community, alpha) of a tab-separated table of 2 (community, alpha) or 3 (id, error, alpha) columns with a
    header."""
    t = spark.read.csv(path, sep="\t", header=True)
    if len(t.columns) not in (2, 3):
        raise ValueError(f"an alpha table has 2 or 3 columns, not {len(t.columns)}")
    return t.select(F.col(t.columns[0]).cast("long").alias("community"), F.col(t.columns[-1]).cast("double").alias("alpha"))


def read_length_overrides(spark: SparkSession, path: str) -> DataFrame:
    """rows (read_len, n, sm) of a Parquet table that replaces the counted read lengths and their suffix sums."""
    return spark.read.parquet(path).select(F.col("read_len").cast("long"), F.col("n").cast("long"), F.col("sm").cast("double"))


def region_weights(spark: SparkSession, path: str) -> DataFrame:
    """rows (chr, gene, isoform, region, weight) of a Parquet table."""
    return spark.read.parquet(path).select("chr", "gene", "isoform", "region", F.col("weight").cast("double"))


def expression_table(spark: SparkSession, path: str, name: str = "target_id", value: str = "tpm") -> DataFrame:
    """rows (isoform, value) of a quantifier's tab-separated output with a header."""
    t = spark.read.csv(path, sep="\t", header=True)
    return t.select(F.substring_index(F.col(name), "|", 1).alias("isoform"), F.col(value).cast("double").alias("value"))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """rows (name, sequence) of a FASTA file; a name ends at white space. Records are cut at '>' at a line's start."""
    records = spark.read.option("lineSep", "\n>").text(path).where("trim(value) <> ''")
    clean = F.regexp_replace("value", "^>", "")
    return records.select(
        F.regexp_extract(clean, r"^(\S*)", 1).alias("name"),
        F.regexp_replace(F.regexp_replace(clean, r"^[^\n]*\n?", ""), r"\s", "").alias("sequence"),
    )


def transcripts(genome: DataFrame, isoforms: DataFrame) -> DataFrame:
    """rows (isoform, sequence): exons of (name, sequence) contigs put together, minus strands reverse-complemented."""
    joined = isoforms.join(genome, isoforms["chr"] == genome["name"])
    spliced = F.expr("array_join(transform(exons, x -> substring(sequence, x.s, x.e - x.s + 1)), '')")
    return joined.select(
        "isoform", F.when(F.col("strand") == "-", reverse_complement(spliced)).otherwise(spliced).alias("sequence")
    )


def gene_pred(isoforms: DataFrame) -> DataFrame:
    """Isoforms as genePred rows: 0-based starts, comma-ended lists."""
    listed = lambda e: F.expr(f"concat(array_join(transform(exons, x -> {e}), ','), ',')")
    return isoforms.select(
        F.col("isoform").alias("name"), F.col("chr").alias("chrom"), "strand",
        F.expr("exons[0].s - 1").alias("txStart"), F.expr("element_at(exons, -1).e").alias("txEnd"),
        F.col("n_exons").alias("exonCount"), listed("x.s - 1").alias("exonStarts"), listed("x.e").alias("exonEnds"),
    )
