"""Quality rules judged by host: failures aggregated by domain, rates shrunk by an empirical beta prior.

Each text is counted once (rule_counts). A host's failures of a rule are beta-binomial: its rate is drawn from a beta
distribution, whose mean and strength are estimated from all hosts by moments. A host of few documents is drawn to that
mean, one of many keeps its own rate: (failures + strength * mean) / (n + strength). A host is rejected where the shrunk
rate of any rule reaches HOST_LIMIT, and so are all its documents.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash, tidily

LEAST_WORDS = 50
REPEATED_PERCENT = 50
SYMBOL_PERCENT = 10
LINE_PERCENT = 30
HOST_LIMIT = 0.5  # shrunk failure rate from which a host is rejected
STRENGTH = (1.0, 1e6)  # the prior counts as this many documents, at least and at most
BROADCAST_HOSTS, BROADCAST_BYTES = 100_000, 1 << 24  # rejected hosts beyond either are joined by a shuffle
SALTS = 16

SPACE, SYMBOLS = b"\x20\x09\x0a\x0b\x0c\x0d", b"#*$%&|<>"
INNER = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that start no code point
COUNTS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of 3 that is met twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    pair = np.unique(ids[:-2] * len(number) + ids[1:-1], return_inverse=True)[1]
    _, which, n = np.unique(pair * len(number) + ids[2:], return_inverse=True, return_counts=True)
    again = n[which] > 1
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : len(words) - 2 + shift] |= again
    return int(covered.sum())


def counted(text: bytes) -> tuple[int, int, int, int, int, int]:
    """The numbers of COUNTS; words are what white space of ASCII leaves, which is what bytes.split() cuts at."""
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text.translate(None, SPACE + INNER)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


@tidily
def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(.., text) -> (.., *COUNTS)"""
    for batch in batches:
        found = np.array([counted(x.as_py()) for x in batch.column(batch.num_columns - 1)], np.int64).reshape(-1, 6)
        kept = batch.columns[:-1]
        names = [*batch.schema.names[:-1], *(c.split()[0] for c in COUNTS.split(", "))]
        yield pa.RecordBatch.from_arrays([*kept, *(pa.array(found[:, i]) for i in range(6))], names=names)


def rule_counts(docs: DataFrame, key: str, text: str, host: Column) -> DataFrame:
    """Rows (key, host, *COUNTS), one for each row of docs. Null texts count as empty ones."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), host.cast("string").alias("host"), body.alias("text"))
    return rows.mapInArrow(count_batches, f"key {kind}, host string, {COUNTS}")


def rules() -> dict[str, Column]:
    """Failures by rule, of rows with COUNTS. The first two are a document's own verdict."""
    return {
        "few_words": F.col("n_words") < LEAST_WORDS,
        "repeated_words": 100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"),
        "many_symbols": 100 * F.col("n_symbols") > SYMBOL_PERCENT * F.col("n_words"),
        "repeated_lines": 100 * F.col("n_dup_lines") > LINE_PERCENT * F.col("n_lines"),
    }


def host_of(url: Column) -> Column:
    """The lower-cased host of a URL without a leading www., null where there is none."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:@]+)", 1)
    return F.when(found != "", found)


def prior(hosts: DataFrame, rule: str) -> tuple[Column, Column]:
    """Aggregates (mean, strength) of the beta prior of a rule, over rows (host, n, one column of failures a rule).

    Moments of the beta-binomial: with the spread S = sum n (f/n - mean)^2, the correlation of two documents of a host is
    (S - mean (1 - mean) (hosts - 1)) / (mean (1 - mean) (N - sum n^2 / N - hosts + 1)), the strength 1 / that - 1.
    """
    n, f = F.col("n").cast("double"), F.col(rule).cast("double")
    every, mean = F.sum(n), F.sum(f) / F.sum(n)
    within = mean * (1 - mean)
    spread = F.sum(f * f / n) - every * mean * mean
    spare = F.count("*") - F.lit(1)
    room = within * (every - F.sum(n * n) / every - spare)
    alike = F.when(room > 0, (spread - within * spare) / room).otherwise(F.lit(0.0))
    low, high = STRENGTH
    strength = F.when(alike <= 1 / (high + 1), F.lit(high)).otherwise(F.greatest(F.lit(low), 1 / alike - 1))
    return mean, strength


def host_rates(counts: DataFrame) -> DataFrame:
    """Rows (host, n, one shrunk rate a rule, rejected) of all hosts that are not null."""
    failed = [F.sum(x.cast("long")).alias(name) for name, x in rules().items()]
    hosts = counts.where("host is not null").groupBy("host").agg(F.count("*").alias("n"), *failed)
    hosts = stash(hosts, "hosts")
    priors = {r: prior(hosts, r) for r in rules()}
    found = hosts.agg(*[c.alias(f"{r}_{i}") for r, p in priors.items() for i, c in enumerate(p)]).first()
    shrunk = {}
    for r in rules():
        mean, strength = found[f"{r}_0"] or 0.0, found[f"{r}_1"] or STRENGTH[1]
        shrunk[r] = F.round((F.col(r) + mean * strength) / (F.col("n") + strength), 9)
    rejected = F.greatest(*shrunk.values()) >= HOST_LIMIT
    return hosts.select("host", "n", *[c.alias(r) for r, c in shrunk.items()], rejected.alias("rejected"))


def judge(docs: DataFrame, host: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, host, *COUNTS, base_failed, host_rejected, kept), one for each row of docs.

    base_failed: fewer than LEAST_WORDS words, or more than REPEATED_PERCENT % of them in windows of 3 that repeat. kept:
    neither this nor of a rejected host. Rows without a host belong to none and are judged by themselves; an empty table
    has no rows. Repeated rows count as often as they are there, and other columns of docs are left out.

    The counts are written once and read twice. The hosts are aggregated before they are shuffled; rejected ones are
    joined back, as a broadcast while they are few, else by salted keys, as one host may hold a third of all rows.
    """
    counts = stash(rule_counts(docs, key, text, host), "rule_counts")
    bad = stash(host_rates(counts).where("rejected").select("host"), "rejected_hosts")
    few, size = bad.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("host")), F.lit(0))).first()
    bad = bad.withColumn("host_rejected", F.lit(True))
    if few <= BROADCAST_HOSTS and size <= BROADCAST_BYTES:
        joined = counts.join(F.broadcast(bad), "host", "left")
    else:
        salt = F.pmod(F.xxhash64("key", "n_words", "word_chars", "n_symbols"), F.lit(SALTS))
        bad = bad.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = counts.withColumn("salt", salt).join(bad, ["host", "salt"], "left").drop("salt")
    own = rules()
    joined = joined.withColumn("base_failed", own["few_words"] | own["repeated_words"])
    joined = joined.withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
    joined = joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
    names = [c.split()[0] for c in COUNTS.split(", ")]
    return joined.select(F.col("key").alias(key), "host", *names, "base_failed", "host_rejected", "kept")
