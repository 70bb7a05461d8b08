"""LM scoring: stupid-backoff scores of bigrams over words, from relational count tables.

Each document's distinct bigrams become rows (key, gram, n). They are dealt by the bigram, which brings a count table's
partition and the rows that ask it together; what other documents hold of the bigram is its count less the document's
own. A bigram that others hold scores log(others / c(v)); any other backs off to log(0.4 c(w) / N). Scores are summed
per document in each partition before they are dealt by document.

Unigrams are counted by word (63 bits of its hash), in a table that grows with the vocabulary. The most frequent words,
HOT at most, have numbers: a bigram of two of them is its two numbers, and their counts are broadcast. Any other bigram
is the hash of the pair and holds both words; counts of words that aren't hot are joined by a shuffle, after the rest
of each document's sum is made.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import release, stash

CLASS_BITS = 63  # of a word's hash: a signed long that isn't negative
HOT_BITS = 20
HOT = 1 << HOT_BITS  # words whose counts are broadcast, at most
STEPS = 16  # of the logarithm of a count: the histogram that tells how frequent a hot word is
BACKOFF = 0.4
PARTS = 2  # the bigrams are counted one part after the other, so that a part of them is on disk at a time
START = b"<s>"
WORDS = 1 << 16  # that are numbered together
ROWS = 1 << 18  # rows of an Arrow batch that goes back to the JVM
MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: bytes) -> np.ndarray:
    """The start mark's hash and those of the text's words: A-Z lower-cased, between ASCII white space."""
    from xxhash import xxh64_digest

    return np.frombuffer(b"".join(map(xxh64_digest, [START, *text.lower().split()])), dtype=">u8").astype(np.uint64)


def class_of(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(64 - CLASS_BITS)


def count_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> (class, n), summed over some million words at a time."""

    def out(held: list) -> pa.RecordBatch:
        kinds, n = np.unique(class_of(np.concatenate(held)).view(np.int64), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(n.astype(np.int64))], names=["class", "n"])

    held, size = [], 0
    for batch in batches:
        for text in batch.column(0):
            held.append(word_hashes(text.as_py()))
            size += len(held[-1])
            if size >= 8 * ROWS:
                yield out(held)
                held, size = [], 0
    if size:
        yield out(held)


def starts_of(hot: np.ndarray) -> tuple[np.ndarray, int]:
    """Where in hot (sorted classes) each value of their top bits begins, some one class for each; and the shift to these."""
    shift = CLASS_BITS - max(1, len(hot).bit_length())
    return np.searchsorted(hot, np.arange(1 << (CLASS_BITS - shift), dtype=np.int64) << shift).astype(np.int32), shift


def numbered(classes: np.ndarray, hot: np.ndarray, number: np.ndarray, starts: np.ndarray, shift: int) -> np.ndarray:
    """The numbers of words that are in hot (sorted classes), and -1 - class of all others. Classes are hashes: looking on
    from where their top bits begin takes few steps, which all words take together."""
    out = -1 - classes
    left, at = np.arange(len(classes)), starts[classes >> shift]
    while len(left):
        inside = at < len(hot)
        left, at = left[inside], at[inside]
        met, asked = hot[at], classes[left]
        same = met == asked
        out[left[same]] = number[at[same]]
        below = met < asked
        left, at = left[below], at[below] + 1
    return out


def grams(words: np.ndarray) -> np.ndarray:
    """One long for each word but the start mark: v and w where both have numbers, else a negative hash of the pair."""
    v, w = words[:-1], words[1:]
    pair = words.view(np.uint64)
    pair = ((pair[:-1] * MIX) ^ (pair[:-1] >> np.uint64(29))) + pair[1:]
    pair = (pair ^ (pair >> np.uint64(32))) * MIX
    return np.where((v >= 0) & (w >= 0), (v << HOT_BITS) | w, (pair | np.uint64(1 << 63)).view(np.int64))


def gram_counter(held_hot, part: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """held_hot: a broadcast (sorted classes of the hot words, their numbers)."""

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, text) -> (id, gram, n, words) for each distinct gram of a document that is in this part of PARTS, by its
        hash; words (v, w) of negative grams."""
        hot, number = held_hot.value
        starts = starts_of(hot)

        def words_of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
            """Each id with its text's words; those of many texts are numbered together."""
            keys, hashes, size = [], [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys.append(key)
                hashes.append(word_hashes(text.as_py()))
                size += len(hashes[-1])
                if size >= WORDS:
                    yield from together(keys, hashes)
                    keys, hashes, size = [], [], 0
            if size:
                yield from together(keys, hashes)

        def together(keys: list, hashes: list) -> Iterator[tuple[int, np.ndarray]]:
            words = numbered(class_of(np.concatenate(hashes)).view(np.int64), hot, number, *starts)
            return zip(keys, np.split(words, np.cumsum([len(h) for h in hashes])[:-1]), strict=True)

        def out(parts: list) -> pa.RecordBatch:
            ids = np.repeat(np.array([p[0] for p in parts], dtype=np.int64), [len(p[1]) for p in parts])
            kinds, n, v, w = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3, 4))
            words = pa.StructArray.from_arrays([pa.array(v), pa.array(w)], names=["v", "w"], mask=pa.array(kinds >= 0))
            return pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(kinds), pa.array(n.astype(np.int32)), words], names=["id", "gram", "n", "words"]
            )

        held, size = [], 0
        for batch in batches:
            for key, words in words_of(batch):
                every = grams(words)
                own = np.flatnonzero(((every.view(np.uint64) * MIX) >> np.uint64(40)) % np.uint64(PARTS) == part)
                kinds, first, n = np.unique(every[own], return_index=True, return_counts=True)
                first = own[first]
                held.append((key, kinds, n, words[first], words[first + 1]))
                size += len(kinds)
                if size >= ROWS:
                    yield out(held)
                    held, size = [], 0
        if size:
            yield out(held)

    return count_grams


def hot_words(counts: DataFrame, most: int) -> pa.Table:
    """(class, n) of the most frequent words, most at most: all whose count reaches a step of its logarithm."""
    step = F.floor(F.log("n") * STEPS).alias("step")
    steps = sorted(counts.groupBy(step).count().collect(), reverse=True)
    at, held = None, 0
    for s, n in steps:
        held += n
        if held > most:
            break
        at = s
    return counts.where(F.lit(at is not None) & (step >= (at or 0))).orderBy(F.desc("n"), "class").toArrow()


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", backoff: float = BACKOFF) -> DataFrame:
    """rows (key, n_words, lm_sum, lm_score), one for each row of docs; lm_score is lm_sum / n_words, natural logs.

    Counts are of all documents. Each row is scored against all other rows; rows that share a key, null included, get
    the sums of theirs. Texts without words (null, empty, white space) have n_words 0, lm_sum 0 and no lm_score.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    ids = F.coalesce(F.col(key).cast("long"), F.lit(-(2**63)).cast("long"))
    spark = docs.sparkSession
    counts = docs.select(body.alias("text")).mapInArrow(count_classes, "class long, n long")
    counts = stash(counts.groupBy("class").agg(F.sum("n").alias("n")), "classes")
    release(spark)  # the shuffle of that, ahead of the large one
    total = max(1, (counts.agg(F.sum("n")).first()[0] or 0) - docs.count())
    hot = hot_words(counts, HOT)
    kinds, number = hot["class"].to_numpy(), np.arange(len(hot), dtype=np.int64)
    order = np.argsort(kinds)
    held = spark.sparkContext.broadcast((kinds[order], number[order]))
    least = hot["n"].to_numpy().min(initial=2**62)
    hot = spark.createDataFrame(pa.table({"asked": number, "c": hot["n"].to_numpy()}), "asked long, c long")
    v = F.coalesce("words.v", F.shiftright("gram", HOT_BITS))
    w = F.coalesce("words.w", F.col("gram").bitwiseAND(F.lit((1 << HOT_BITS) - 1).cast("long")))
    seen = F.col("others") > 0
    sums = []
    for part in range(PARTS):
        rows = docs.select(ids.alias("id"), body.alias("text")).mapInArrow(
            gram_counter(held, part), "id long, gram long, n int, words struct<v: long, w: long>"
        )
        met = rows.withColumn("others", F.sum("n").over(Window.partitionBy("gram")) - F.col("n"))
        # the word whose count is asked, how often its logarithm counts, and the rest of the score
        met = met.select(
            "id",
            "n",
            F.when(seen, v).otherwise(w).alias("asked"),
            F.when(seen, -F.col("n")).otherwise(F.col("n")).alias("times"),
            (F.col("n") * F.when(seen, F.ln("others")).otherwise(F.lit(math.log(backoff / total)))).alias("s"),
        ).join(F.broadcast(hot), "asked", "left")
        met = met.groupBy("id", F.when(F.col("c").isNull(), -1 - F.col("asked")).alias("class")).agg(
            F.sum(F.col("s") + F.col("times") * F.coalesce(F.ln("c"), F.lit(0.0))).alias("s"),
            F.sum(F.when(F.col("c").isNull(), F.col("times")).otherwise(0)).alias("times"),
            F.sum("n").alias("c"),
        )
        sums.append(stash(met, "sums"))
        del rows, met
        release(spark)  # the shuffles of one part, ahead of the next
    met = reduce(DataFrame.union, sums)
    # a word that is met once has logarithm 0, so its count needn't be there
    rare = met.where("class is not null").join(counts.where((F.col("n") > 1) & (F.col("n") < int(least))), "class", "left")
    rare = rare.select("id", (F.col("s") + F.col("times") * F.ln(F.coalesce("n", F.lit(1)))).alias("s"), "c")
    summed = met.where("class is null").select("id", "s", "c").union(rare).groupBy("id").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
    every = docs.select(F.col(key).alias("key"), ids.alias("id")).join(summed, "id", "left")
    return every.select(
        F.col("key").alias(key),
        F.coalesce("c", F.lit(0)).cast("long").alias("n_words"),
        F.coalesce("s", F.lit(0.0)).alias("lm_sum"),
        (F.col("s") / F.col("c")).alias("lm_score"),
    )
