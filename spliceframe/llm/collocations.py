"""Phrase collocation mining: merged count-min sketches, exact counts of what survives them, scores, subsumption.

Pass 1 counts all phrases of 1 to 5 words in count-min sketches of two rows, one for each chunk of a task's words. The
merged sketch overestimates, so a phrase whose two cells reach the least count is all that can be frequent: one bit a
cell says so. Pass 2 counts the phrases whose bits are set exactly, by their words, and drops what is not frequent.

The sketch is as wide as the input asks for (a cell for BYTES_A_CELL bytes of text), 2**MAX_BITS cells a row at most, or
256 MB of bits for each worker. Wider inputs only let more phrases through to the exact counts; no result changes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release, stash, tidily

LONGEST = 5
MIN_COUNT = 100
TOP = 2000
INSIDE_PERCENT = 100
BYTES_A_CELL, MIN_BITS, MAX_BITS = 32, 20, 30
CHUNK = 1 << 19  # words that are counted together
HELD = 1 << 19  # phrases whose counts a task holds before it hands them on
SLICE = 1 << 18  # bytes of a text that are cut into words together
BLOCK_BITS = 16  # cells of one block of a sketch, as a power of 2
BLOCK_PHRASES = 17  # cells of the sketch for one block of exact counts, as a power of 2
SALTS = 64
EMPTY, END = b"", b"\n"  # tokens that are no words: nothing between two spaces, the end of a piece
TO_PLAIN = bytes.maketrans(b".,;:!?\x0b\x0c\x0d\t", b"\n\n\n\n\n\n\n\n\n ")
ODD, ODD2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


# ---------------------------------------------------------------- words of a task, by chunk


def pieces_of(text: bytes) -> Iterator[list[bytes]]:
    """Lists of tokens, of some SLICE bytes each: words, EMPTY and END."""
    plain = text.lower().translate(TO_PLAIN)
    at = 0
    while at < len(plain):
        cut = plain.find(b" ", at + SLICE) + 1 or len(plain)
        yield plain[at:cut].replace(b"\n", b" \n ").split(b" ")
        at = cut
    yield [END]


class Chunk:
    """Words of several texts in a row: ids (0: the end of a piece), numbers of languages, and the words by id. Phrases
    start at the first `starts` words; those after them are there for phrases that reach over."""

    def __init__(self, ids: np.ndarray, langs: np.ndarray, words: list[bytes], names: list, starts: int) -> None:
        self.ids, self.langs, self.words, self.names, self.starts = ids, langs, words, names, starts

    def hashes(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For 1 to LONGEST words, (whether a phrase of so many starts here, its hash)."""
        of_word = np.array([xxhash.xxh64_intdigest(w) for w in self.words], np.uint64)[self.ids]
        of_lang = np.array([xxhash.xxh64_intdigest(repr(x), seed=1) for x in self.names], np.uint64)[self.langs]
        held = mixed(of_word ^ of_lang)
        whole = self.ids > 0
        yield whole, held
        for k in range(1, LONGEST):
            whole = whole[:-1] & (self.ids[k:] > 0)
            held = mixed(held[:-1] * ODD + of_word[k:])
            yield whole, held


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * ODD
    x = (x ^ (x >> np.uint64(29))) * ODD2
    return x ^ (x >> np.uint64(32))


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """Batches (lang, text) as chunks of some CHUNK words. The last LONGEST - 1 words are met again by the next chunk."""
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    names: dict[str, int] = {}
    ids, langs, size = [], [], 0

    def start_over(kept: list[bytes], kept_langs: list) -> None:
        nonlocal ids, langs, size
        number.clear()
        names.clear()
        _ = number[END], number[EMPTY]
        ids = [np.array([number[w] for w in kept], np.int64)]
        langs = [np.array([names.setdefault(x, len(names)) for x in kept_langs], np.int64)]
        size = len(kept)

    def chunk(last: bool) -> Chunk:
        got = Chunk(np.concatenate(ids), np.concatenate(langs), list(number), list(names), 0)
        got.starts = len(got.ids) if last else max(0, len(got.ids) - LONGEST + 1)
        return got

    start_over([], [])
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for tokens in pieces_of(text.as_py()):
                new = np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens))
                new = new[new != 1]
                ids.append(new)
                langs.append(np.full(len(new), names.setdefault(lang, len(names)), np.int64))
                size += len(new)
                if size >= CHUNK:
                    got = chunk(False)
                    yield got
                    at = range(got.starts, len(got.ids))
                    start_over([got.words[got.ids[i]] for i in at], [got.names[got.langs[i]] for i in at])
    yield chunk(True)


def cells_of(held: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two cells of each hash: its upper and its lower bits."""
    return held >> np.uint64(64 - bits), held & np.uint64((1 << bits) - 1)


# ---------------------------------------------------------------- pass 1: sketches


def packed(cells: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted cells of a block, as steps, and their counts, byte by byte so that a shuffle compresses them."""
    steps = np.diff(cells, prepend=np.uint64(0)).astype("<u2")
    return np.concatenate([steps.view(np.uint8)[::2], steps.view(np.uint8)[1::2], n]).tobytes()


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    low, high, n = np.frombuffer(data, np.uint8).reshape(3, -1)
    return np.cumsum(low.astype(np.int64) | high.astype(np.int64) << 8), n


def sketcher(bits: int, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(lang, text) -> (block, cells): the sketch of each chunk, in blocks that have counts. Counts stop at least, which
    is all that is asked of their sum."""

    @tidily
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = np.uint64((1 << BLOCK_BITS) - 1)
        for chunk in chunks(batches):
            held = [h[: chunk.starts][w[: chunk.starts]] for w, h in chunk.hashes()]
            held = np.concatenate(held)
            for row, cells in enumerate(cells_of(held, bits)):
                cells, n = np.unique(cells, return_counts=True)
                n = np.minimum(n, least).astype(np.uint8)
                blocks = (cells >> np.uint64(BLOCK_BITS)).astype(np.int64)
                heads = np.flatnonzero(np.diff(blocks, prepend=-1))
                ends = np.append(heads, len(cells))[1:]
                data = [packed(cells[a:b] & low, n[a:b]) for a, b in zip(heads, ends, strict=True)]
                names = blocks[heads] + (row << (bits - BLOCK_BITS))
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(data, pa.binary())], names=["block", "cells"])

    return sketch


def merger(least: int) -> Callable:
    """The blocks of one name -> (block, bits): which cells of the merged sketch reach least. Reads batch by batch."""

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BLOCK_BITS, np.int64)
        for batch in batches:
            for data in batch.column("cells"):
                cells, n = unpacked(data.as_py())
                total[cells] += n
        full = total >= least
        if full.any():
            bits = np.packbits(full, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([bits])], names=["block", "bits"])

    return merge


def sketch_bits(rows: DataFrame, bits: int, least: int) -> np.ndarray:
    """The bits of both rows of the merged sketch of rows (lang, text), at most 2 * 2**MAX_BITS."""
    parts = rows.mapInArrow(sketcher(bits, least), "block long, cells binary")
    merged = parts.groupBy("block").applyInArrow(merger(least), "block long, bits binary")
    out = np.zeros(2 << (bits - 3), np.uint8)
    each = 1 << (BLOCK_BITS - 3)
    for block, data in merged.toLocalIterator():
        out[block * each : (block + 1) * each] = np.frombuffer(data, np.uint8)
    return out


# ---------------------------------------------------------------- pass 2: exact counts


BLOCKS = "block long, langs array<string>, phrases array<binary>, n array<long>"


def survivor_counter(held_bits, bits: int, blocks: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(lang, text) -> BLOCKS, dealt by the phrases' hashes: the counts of a task's phrases that pass the sketch, and that
    do so without their first word and without their last (a phrase is never more frequent than these). The empty phrase
    counts all words."""

    def passes(sketch: np.ndarray, held: np.ndarray) -> np.ndarray:
        one, two = cells_of(held, bits)
        two = two | np.uint64(1 << bits)
        seen = lambda c: sketch[c >> np.uint64(3)] >> (c & np.uint64(7)).astype(np.uint8) & np.uint8(1)
        return (seen(one) & seen(two)).astype(bool)

    @tidily
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = held_bits.value
        counts: dict[tuple[str, bytes], int] = defaultdict(int)

        def add(langs: list, phrases: list[bytes], n: np.ndarray) -> None:
            for pair, k in zip(zip(langs, phrases, strict=True), n.tolist(), strict=True):
                counts[pair] += k

        def out() -> pa.RecordBatch:
            langs, phrases = zip(*counts, strict=True) if counts else ((), ())
            to = np.array([xxhash.xxh64_intdigest(p) % blocks for p in phrases], np.int64)
            order = np.argsort(to, kind="stable")
            names, first = np.unique(to[order], return_index=True)
            ends = pa.array(np.append(first, len(to)), pa.int32())
            values = pa.array(langs, pa.string()), pa.array(phrases, pa.binary()), pa.array(counts.values(), pa.int64())
            lists = [pa.ListArray.from_arrays(ends, x.take(pa.array(order))) for x in values]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(names), *lists], names=["block", "langs", "phrases", "n"])

        for chunk in chunks(batches):
            words = np.bincount(chunk.langs[: chunk.starts][chunk.ids[: chunk.starts] > 0], minlength=len(chunk.names))
            add(chunk.names, [b""] * len(chunk.names), words)
            width = len(chunk.words)
            group, texts, of = chunk.langs, [b""] * len(chunk.names), chunk.names
            for k, (whole, held) in enumerate(chunk.hashes()):
                # group: the number of the phrase of k words here, -1 where it did not pass
                alive = whole if k == 0 else whole & (group[:-1] >= 0) & (group[1:] >= 0)
                at = np.flatnonzero(alive)
                at = at[passes(sketch, held[at])]
                kinds, which = np.unique(group[at] * width + chunk.ids[at + k], return_inverse=True)
                n = np.bincount(which[: np.searchsorted(at, chunk.starts)], minlength=len(kinds))
                group = np.full(len(whole), -1, np.int64)
                group[at] = which
                first, last = (kinds // width).tolist(), (kinds % width).tolist()
                join = (lambda a, b: b) if k == 0 else (lambda a, b: a + b" " + b)
                of = [of[i] for i in first]
                texts = [join(texts[i], chunk.words[j]) for i, j in zip(first, last, strict=True)]
                add(of, texts, n)
            if len(counts) >= HELD:
                yield out()
        yield out()

    return count


def summer(least: int) -> Callable:
    """The blocks of one name -> (lang, phrase, n) of what is met least times in all, and of the empty phrase. Reads batch
    by batch."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, bytes], int] = defaultdict(int)
        for batch in batches:
            lists = (batch.column(c).flatten().to_pylist() for c in ("langs", "phrases", "n"))
            for lang, phrase, k in zip(*lists, strict=True):
                total[lang, phrase] += k
        kept = [(*pair, k) for pair, k in total.items() if k >= least or not pair[1]]
        langs, phrases, n = zip(*kept, strict=True) if kept else ((), (), ())
        columns = [pa.array(langs, pa.string()), pa.array(phrases, pa.binary()), pa.array(n, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "n"])

    return add_up


def frequent(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = MIN_COUNT) -> DataFrame:
    """Rows (lang, phrase, n): all phrases of 1 to LONGEST words that are met least times or more in a language, counted
    exactly, and the empty phrase with the count of all words. Null languages are `und`; null texts are empty."""
    if not 1 <= least <= 255:
        raise ValueError("the least count must fit a byte of the sketch")
    named, body = F.coalesce(F.col(lang), F.lit("und")), F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(named.alias("lang"), body.alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MAX_BITS, max(MIN_BITS, (size // BYTES_A_CELL).bit_length()))
    held = docs.sparkSession.sparkContext.broadcast(sketch_bits(rows, bits, least))
    blocks = 1 << max(6, bits - BLOCK_PHRASES)
    counts = rows.mapInArrow(survivor_counter(held, bits, blocks), BLOCKS)
    counts = counts.groupBy("block").applyInArrow(summer(least), "lang string, phrase binary, n long")
    out = stash(counts.select("lang", F.col("phrase").cast("string").alias("phrase"), "n"), "phrases")
    held.unpersist()
    release(docs.sparkSession)
    return out


# ---------------------------------------------------------------- scores


def joined(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def scored(counts: DataFrame) -> DataFrame:
    """Rows (lang, phrase, a, l, r, n, score, cut) of the phrases of two words and more in counts, by the cut of the
    lowest score floor(1000 a n / (l r)), the first of several. Arithmetic is exact: decimals of 38 digits."""
    all_words = counts.where("phrase = ''").select("lang", F.col("n").alias("all"))
    words = F.split("phrase", " ")
    pairs = counts.select("lang", "phrase", F.col("n").alias("a"), words.alias("words")).where(F.size("words") > 1)
    cuts = pairs.select("*", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("cut"))
    cuts = cuts.select(
        "lang",
        "phrase",
        "a",
        "cut",
        joined(F.col("words"), F.lit(1), F.col("cut")).alias("first"),
        joined(F.col("words"), F.col("cut") + 1, F.size("words")).alias("rest"),
    )
    single = counts.where("phrase <> ''")
    cuts = cuts.join(single.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    cuts = cuts.join(single.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    # one small row a language, beside phrases: the count of all words
    cuts = cuts.join(all_words, "lang")
    whole = "cast(1000 as decimal(4)) * cast(a as decimal(18)) * cast(all as decimal(14))"
    score = F.expr(f"({whole}) div (cast(l as decimal(18)) * cast(r as decimal(18)))")
    best = F.min(F.struct(score.alias("score"), "cut", "l", "r", F.col("all").alias("n"))).alias("best")
    return cuts.groupBy("lang", "phrase", "a").agg(best).select("lang", "phrase", "a", "best.*")


def subsumed(counts: DataFrame, percent: int = INSIDE_PERCENT) -> DataFrame:
    """Rows (lang, phrase) of the phrases inside a longer one that is met at least percent % as often. One word more is
    enough to look at: a phrase is never less frequent than a longer one around it."""
    words = F.split("phrase", " ")
    longer = counts.select("lang", "n", words.alias("words")).where(F.size("words") > 2)
    inner = F.array(*[joined(F.col("words"), F.lit(s), F.size("words") - 1) for s in (1, 2)])
    longer = longer.select("lang", F.explode(inner).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("most"))
    met = longer.join(counts, ["lang", "phrase"])
    return met.where(F.lit(100) * F.col("most") >= F.lit(percent) * F.col("n")).select("lang", "phrase")


def mine(
    docs: DataFrame,
    lang: str = "lang",
    text: str = "text",
    least: int = MIN_COUNT,
    top: int = TOP,
    percent: int = INSIDE_PERCENT,
) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases by score, then a (both
    descending), then phrase. Empty tables and texts without phrases give no rows; repeated rows count as often as they
    are there; other columns of docs play no part."""
    counts = frequent(docs, lang, text, least)
    kept = scored(counts).join(subsumed(counts, percent), ["lang", "phrase"], "left_anti")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language may hold most phrases, so the first of each of SALTS parts come before the first of all
    part = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    kept = kept.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    kept = kept.where(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return kept.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

