"""One query for each training-data operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    collocations,
    decontamination,
    fingerprints,
    host_rules,
    lm_scores,
    mixing,
    quality,
    repeats,
    secrets,
    simhash,
    tokens,
    warc,
)

#: Target weights of the mixture; sources that aren't named weigh 1.
WEIGHTS = {"src0": 4.0}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: held_out, score, predicted (1 if score >= 0.3)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model).select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page, from archives written and read back: payload_bytes, payload_digest, record_type, refers_to."""
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: fingerprints of its text and its edited text, and how near they and the next document's are."""
    fp = fingerprints
    pairs = fp.with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
    changed = pairs.withColumn("edited_text", fp.edited(F.col("text"), F.col("next_text")))
    changed = changed.withColumn("edited_signature", fp.signature(F.col("edited_text")))
    return changed.select(
        F.col("key").alias("doc_id"),
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        fp.written(F.col("signature")).alias("fingerprint"),
        fp.written(F.col("edited_signature")).alias("edited_fingerprint"),
        fp.likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
        fp.likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document, from shard files written and read back: start, n_tokens, ids_crc32."""
    return tokens.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: fingerprint (16 hexadecimal digits) and component_id."""
    found = simhash.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op8_bwt_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans, kept_sha256, and n_passage_words: words in 50 or more that repeat."""
    left = repeats.remove(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.sha2("kept", 256).alias("kept_sha256")
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", kept, "n_passage_words")


def op9_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"), WEIGHTS)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: n_assign, n_access, n_hex, base_sha256, spans. A null text has no spans."""
    model = secrets.train(secrets.samples(spark))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, model).select("doc_id", "secret_spans")
    of = lambda kind: F.filter("secret_spans", lambda s: s.kind == kind)
    written = lambda xs: F.array_join(
        F.transform(xs, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ","
    )
    base = F.filter("secret_spans", lambda s: s.kind != "markov")
    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in secrets.KINDS[:3]],
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("secret_spans")).alias("spans"),
    )


def op11_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: counts, base_failed, kept, host_rejected; a document's host is its source."""
    found = host_rules.judge(table(spark, sf_dir, "documents"), F.col("source"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return found.select("doc_id", *counts, "base_failed", "kept", "host_rejected")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language, its first 2000 phrases: lang, rank, phrase, a, l, r, n, score."""
    return collocations.mine(table(spark, sf_dir, "documents").select("lang", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_quality,
            op2_warc,
            op3_order_minhash,
            op4_lm_score,
            op5_decontamination,
            op6_token_ids,
            op7_simhash,
            op8_bwt_repeats,
            op9_pfair_mixing,
            op10_secret_scan,
            op11_host_rules,
            op12_collocations,
        )
    }
