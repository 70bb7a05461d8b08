"""Corpus pipeline: quality classifier, near-dedup, benchmark decontamination, source mixing, token-id files.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the last return the
columns of documents. Labels and benchmark are read from sf_dir. Further columns of documents pass through unchanged,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spliceframe.llm import decontamination, mixing, quality, simhash, tokens
from spliceframe.llm.common import stash
from spliceframe.llm.queries import WEIGHTS, table


def packed(docs: DataFrame, *used: str) -> DataFrame:
    """docs with the columns that a stage uses, and all others in one, so that none clashes with a stage's own."""
    rest = [c for c in docs.columns if c not in used]
    return docs.select(*used, F.struct(*[docs[c] for c in rest]).alias("pipeline_rest")) if rest else docs


def unpacked(kept: DataFrame, docs: DataFrame, *used: str) -> DataFrame:
    """The columns of docs, out of what a stage kept of packed(docs)."""
    return kept.select(*[F.col(c) if c in used else F.col("pipeline_rest").getField(c).alias(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, fitted on the labelled ones among docs, scores at its threshold or above."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(packed(docs, "doc_id", "text"), model)
    return unpacked(scored.where(F.col("quality_score") >= quality.THRESHOLD), docs, "doc_id", "text")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least doc_id, of each class of near copies."""
    return simhash.dedup(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that aren't contaminated by the benchmark."""
    found = decontamination.contamination(packed(docs, "doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return unpacked(found.where(~F.col("contaminated")), docs, "doc_id", "text")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture: Parquet files in the order of their names hold it row by row."""
    mixed = mixing.mix(packed(docs, "doc_id", "source"), WEIGHTS)
    placed = mixed.repartitionByRange("mix_position").sortWithinPartitions("mix_position")
    return unpacked(placed, docs, "doc_id", "source")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document of the written shards: start, n_tokens, ids_crc32. Shards follow the order of docs' files and rows,
    which is the mixture's; docs that don't come from files are written in the order of doc_id."""
    meta = docs.metadataColumn if "_metadata" not in docs.columns and docs.inputFiles() else None
    if meta is None:
        return tokens.round_trip(docs)
    placed = docs.select("doc_id", "text", meta("_metadata").file_name.alias("mix_file"), meta("_metadata").row_index.alias("mix_row"))
    return tokens.round_trip(placed, by=["mix_file", "mix_row"])


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("token-ID / binary output", token_stage),
]

#: SQL has no line CRF, XXH64 or BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written as Parquet and reread by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
