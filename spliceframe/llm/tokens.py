"""Token ids in binary files with Re-Pair grammar compression.

A shard holds the ids of consecutive documents, each ended by an end id. Rounds of replacement count the shard's
adjacent id pairs and give the frequent ones nonterminals, until no pair is frequent; pairs that share an id go in
different rounds, and in a run of one id pairs are taken from its left. The file holds the rules with their expansion
lengths and the final sequence in blocks that are packed one by one, with the number of ids before each: a document is
decoded from its own blocks and the rules that it meets, without what stands before.

Layout, little-endian: MAGIC; counts (6 x u64: documents, ids, rules, sequence length, first terminal free for
nonterminals, blocks); rules (2 x u32 each); expansion lengths (u64 each); documents' keys (i64) and starts (u64); ids
before each block (u64); ends of the packed blocks (u64); the blocks: BLOCK symbols (u32 in byte planes, zstd).
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import open_shared, rename_shared, scratch_path, stash, tidily

MAGIC = b"REPAIR02"
END_ID = 1
BLOCK = 1 << 13  # symbols that are packed together, and read together for a document in them
LEAST_COUNT = 8  # a pair this frequent pays for its rule
SHARD_IDS = 1 << 21
SHARDS_A_TASK = 8  # read one after the other, as each Python task costs a tenth of a second by itself
TEXTS, CHARACTERS = 4096, 16 << 20  # encoded together, at most (but for one text)
CACHE_WORDS = 100_000  # words that a worker keeps, of those encoded by the library
#: Texts with the opening of a special token, or a character that is white space for Python and not for the vocabulary.
WHOLE = re.compile("<\\||[\x1c-\x1f\x85\u180e]")
#: Texts of these characters alone (ASCII, Latin letters, some punctuation) are cut into the vocabulary's own pieces:
#: letter runs, digits, other runs. Words with an apostrophe go to the library, as contractions are cut otherwise.
#: Letters whose lower case is none of LETTERS (as of U+018F, which is U+0259) aren't plain.
LETTERS = "a-z\u00df-\u00f6\u00f8-\u012f\u0131-\u024f"
LATIN = [c for c in map(chr, range(0xC0, 0x250)) if re.fullmatch(f"[{LETTERS}]", c.lower())]
PLAIN = re.compile(f"[\x09-\x0d\x20-\x7f{''.join(LATIN)}\u2013-\u2026]*\\Z")
PIECE_END, WORD_END = "\x01", "\x02"  # neither is in a PLAIN text
PIECES = re.compile(f"[{LETTERS}]+|[0-9]|[^\\s0-9{LETTERS}{WORD_END}]+")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# ---------------------------------------------------------------- tokenizing


def byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write bytes: printable Latin-1 as itself, the others from U+0100 on, in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(others)}


def merge_ranks(path: str) -> tuple[dict[bytes, int], np.ndarray]:
    """(ranks, ids): the vocabulary's tokens as bytes, PIECE_END behind those that end a piece, in the order of their
    merges, and the vocabulary's id of each rank.

    Merging by these ranks gives what the vocabulary's list of pairs gives, as each token's own bytes merge into that
    token and nothing else (tested): where two neighbours make up a token, they are the pair that the list has for it.
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    suffix, vocab, letters = model["end_of_word_suffix"], model["vocab"], byte_letters()
    of = {c: b for b, c in letters.items()}
    end = PIECE_END.encode()
    ranks = {bytes([b]): b for b in range(256)} | {bytes([b]) + end: 256 + b for b in range(256)}
    ids = [vocab[letters[b]] for b in range(256)] + [vocab[letters[b] + suffix] for b in range(256)]
    for pair in model["merges"]:
        token = "".join(pair.split(" ") if isinstance(pair, str) else pair)
        body = bytes(of[c] for c in token.removesuffix(suffix))
        ranks[body + end if token.endswith(suffix) else body] = len(ids)
        ids.append(vocab[token])
    return ranks, np.array(ids, dtype="<u4")


class Encoder:
    """Ids of whole texts, by their words between white space: this vocabulary drops white space and never joins what it
    parts. The distinct words of PLAIN texts are merged together, by tiktoken's core and the vocabulary's merges; all
    else is encoded by the library, and kept for a while, but for texts that match WHOLE, which it gets as they are."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        ranks, self.ids = merge_ranks(path)
        pieces = f"[^{PIECE_END}{WORD_END}]*{PIECE_END}|{WORD_END}"
        self.core = tiktoken.Encoding("own", pat_str=pieces, mergeable_ranks=ranks, special_tokens={})
        self.met: dict[str, np.ndarray] = {}  # by the library

    def other(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def others(self, words: list[str]) -> list[np.ndarray]:
        if len(self.met) > CACHE_WORDS:
            self.met.clear()
        for w in set(words) - self.met.keys():
            self.met[w] = self.other(w)
        return [self.met[w] for w in words]

    def lists(self, words: pa.Array) -> pa.ListArray:
        """Ids of distinct lower-case words of PLAIN texts."""
        every = pa.LargeListArray.from_arrays(pa.array([0, len(words)], pa.int64()), words)
        joined = pc.binary_join(every, pa.scalar(WORD_END, pa.large_string()))[0].as_py() + WORD_END
        ranks = np.array(self.core.encode_ordinary(PIECES.sub("\\g<0>" + PIECE_END, joined)), dtype=np.int64)
        inside = ranks != ord(WORD_END)
        ends = np.concatenate(([0], np.cumsum(inside)[~inside]))
        made = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(self.ids[ranks[inside]]))
        if "'" not in joined:
            return made
        quoted = np.flatnonzero(pc.match_substring(words, "'").to_numpy(zero_copy_only=False))
        own = self.others(words.take(pa.array(quoted)).to_pylist())
        ends = np.concatenate(([0], np.cumsum([len(x) for x in own])))
        more = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(own)))
        at = np.arange(len(words))
        at[quoted] = len(words) + np.arange(len(quoted))
        return pa.concat_arrays([made, more]).take(pa.array(at))

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts that match PLAIN: Arrow cuts them into words and numbers the distinct ones, which are encoded."""
        lists = pc.ascii_split_whitespace(pa.array([t.lower() for t in texts], pa.large_string()))
        coded = lists.flatten().dictionary_encode()
        if not len(coded):
            return [np.zeros(0, dtype="<u4") for _ in texts]
        got = self.lists(coded.dictionary).take(coded.indices)
        ids, ends = got.values.to_numpy(), got.offsets.to_numpy()
        words = ends[np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))].tolist()
        return [ids[a:b] for a, b in zip(words[:-1], words[1:], strict=True)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        easy = [PLAIN.match(t) is not None and "<|" not in t for t in texts]
        some = iter(self.plain([t for t, e in zip(texts, easy, strict=True) if e]))
        out = []
        for t, e in zip(texts, easy, strict=True):
            if e:
                out.append(next(some))
            elif WHOLE.search(t):
                out.append(self.other(t))
            else:
                out.append(np.concatenate([np.zeros(0, dtype="<u4"), *self.others(t.split())]))
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


# ---------------------------------------------------------------- Re-Pair


CELLS = 1 << 20


def cell_of(pairs: np.ndarray) -> np.ndarray:
    return ((pairs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).view(np.int64)


def occurrences(pairs: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where wanted pairs stand among the adjacent pairs, and which; in runs of one id every second place. Of wanted
    pairs that share a cell of the table the last is found, the others stay for a later round."""
    table = np.full(CELLS, len(wanted), dtype=np.int32)
    table[cell_of(wanted)] = np.arange(len(wanted), dtype=np.int32)
    which = table[cell_of(pairs)]
    at = np.flatnonzero(np.append(wanted, np.uint64(2**64 - 1))[which] == pairs)
    which = which[at]
    close = np.diff(at) == 1
    if close.any():
        # overlapping places follow each other by one: keep the first, third, ... of each such run
        run = np.concatenate(([0], np.cumsum(~close)))
        first = np.concatenate(([0], np.flatnonzero(~close) + 1))
        odd = (np.arange(len(at)) - first[run]) % 2 == 0
        at, which = at[odd], which[odd]
    return at, which


def frequent(pairs: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that occur `least` times, the most frequent first, and how often."""
    bins = np.bincount(cell_of(pairs), minlength=CELLS)
    ordered = np.sort(pairs[(bins >= least)[cell_of(pairs)]])
    edge = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1], [True]))) if len(ordered) else np.zeros(1, int)
    counts = np.diff(edge)
    often = np.flatnonzero(counts >= least)
    often = often[np.argsort(-counts[often], kind="stable")]
    return ordered[edge[often]], counts[often]


def compress(ids: np.ndarray, least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray, int]:
    """ids -> (sequence, rules (n, 2), first nonterminal). Rule i makes nonterminal first + i. Goes on until no pair
    occurs `least` times."""
    first = int(ids.max()) + 1 if len(ids) else 0
    seq, rules = ids.astype(np.uint32), [np.zeros((0, 2), dtype=np.uint32)]
    made = 0
    while len(seq) > 1:
        pairs = seq[:-1].astype(np.uint64)
        pairs <<= np.uint64(32)
        pairs |= seq[1:]
        kinds, _ = frequent(pairs, least)
        left, right = (kinds >> np.uint64(32)).astype(np.uint32), kinds.astype(np.uint32)
        chosen, used_left, used_right = [], set(), set()
        for i, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
            # no other chosen pair may begin with b or end with a
            if a in used_right or b in used_left or (a == b and (a in used_left or a in used_right)):
                continue
            used_left.add(a)
            used_right.add(b)
            chosen.append(i)
        if not chosen:
            break
        at, which = occurrences(pairs, kinds[chosen])
        seq = seq.copy()
        seq[at] = (first + made + which).astype(np.uint32)
        keep = np.ones(len(seq), dtype=bool)
        keep[at + 1] = False
        seq = seq[keep]
        rules.append(np.stack([left[chosen], right[chosen]], axis=1))
        made += len(chosen)
    return seq, np.concatenate(rules), first


def expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """Ids that each nonterminal stands for; a rule uses earlier nonterminals only."""
    out = np.zeros(len(rules), dtype=np.uint64)
    for i, (a, b) in enumerate(rules.tolist()):
        out[i] = sum(1 if x < first else int(out[x - first]) for x in (a, b))
    return out


def rules_met(seq: np.ndarray, rules: np.ndarray, first: int) -> np.ndarray:
    """The numbers of the rules that a sequence needs, in order: a rule comes after those in it."""
    met = np.zeros(len(rules), dtype=bool)
    new = np.unique(seq[seq >= first].astype(np.int64) - first)
    while len(new):
        met[new] = True
        inside = rules[new].astype(np.int64).ravel() - first
        inside = inside[inside >= 0]
        new = np.unique(inside[~met[inside]])
    return np.flatnonzero(met)


def expand(seq: np.ndarray, rules: np.ndarray, first: int) -> np.ndarray:
    """The ids of a sequence: each rule that it needs is written out once, and each symbol takes its part of that."""
    met = rules_met(seq, rules, first) if len(rules) else np.zeros(0, dtype=np.int64)
    if not len(met):
        return seq.astype(np.uint32)
    written: dict[int, tuple] = {}
    for i, (a, b) in zip(met.tolist(), rules[met].tolist(), strict=True):
        written[first + i] = written.get(a, (a,)) + written.get(b, (b,))
    # the rules' ids one after the other; a symbol that is no rule is its own
    flat = np.fromiter(itertools.chain.from_iterable(written.values()), dtype=np.uint32)
    size = np.fromiter(map(len, written.values()), dtype=np.int64, count=len(met))
    place = np.full(len(rules), -1, dtype=np.int64)
    place[met] = np.arange(len(met))
    high = seq >= first
    lengths = np.ones(len(seq), dtype=np.int64)
    which = place[seq[high].astype(np.int64) - first]
    lengths[high] = size[which]
    begin = np.cumsum(lengths) - lengths
    out = np.empty(int(lengths.sum()), dtype=np.uint32)
    out[begin[~high]] = seq[~high]
    base = (np.cumsum(size) - size)[which]
    count = lengths[high]
    inside = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    out[np.repeat(begin[high], count) + inside] = flat[np.repeat(base, count) + inside]
    return out


def symbol_lengths(seq: np.ndarray, lengths: np.ndarray, first: int) -> np.ndarray:
    out = np.ones(len(seq), dtype=np.uint64)
    high = seq >= first
    out[high] = lengths[seq[high] - first]
    return out


# ---------------------------------------------------------------- files


def write_shard(f, keys: list[int], documents: list[np.ndarray]) -> None:
    """MAGIC, six counts (documents, ids, rules, symbols, first nonterminal, blocks), the rules and their expansion lengths,
    keys, documents' starts, ids before each block, ends of the blocks, and the blocks: BLOCK symbols each, packed one by
    one."""
    ids = np.concatenate(documents) if documents else np.zeros(0, dtype=np.uint32)
    seq, rules, first = compress(ids)
    lengths = expansion_lengths(rules, first)
    before = np.concatenate(([0], np.cumsum(symbol_lengths(seq, lengths, first)))).astype("<u8")
    starts = np.concatenate(([0], np.cumsum([len(d) for d in documents])))[:-1].astype("<u8")
    packer = zstandard.ZstdCompressor(level=1)
    # plane by plane: the high bytes are mostly alike
    planes = (seq[i : i + BLOCK].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for i in range(0, len(seq), BLOCK))
    blocks = [packer.compress(x) for x in planes]
    f.write(MAGIC + struct.pack("<6Q", len(keys), len(ids), len(rules), len(seq), first, len(blocks)))
    f.write(rules.astype("<u4").tobytes() + lengths.astype("<u8").tobytes())
    f.write(np.array(keys, dtype="<i8").tobytes() + starts.tobytes() + before[:-1][::BLOCK].tobytes())
    f.write(np.cumsum([len(x) for x in blocks]).astype("<u8").tobytes())
    for x in blocks:
        f.write(x)


class Shard:
    """A shard in an open file. document(i) reads the blocks that the document lies in, and no others (blocks_read counts
    them), and expands the rules that it meets."""

    def __init__(self, f):
        self.file, self.blocks_read = f, 0
        if f.read(len(MAGIC)) != MAGIC:
            raise ValueError("not a shard of token ids")
        docs, self.n_ids, n_rules, self.n_seq, self.first, n_blocks = struct.unpack("<6Q", f.read(48))
        take = lambda kind, n: np.frombuffer(f.read(np.dtype(kind).itemsize * n), dtype=kind)
        self.rules = take("<u4", 2 * n_rules).reshape(-1, 2)
        self.lengths = take("<u8", n_rules)
        self.keys, self.starts = take("<i8", docs), take("<u8", docs)
        self.samples, self.ends = take("<u8", n_blocks), take("<u8", n_blocks)
        self.base = f.tell()

    def symbols(self, first: int, stop: int) -> np.ndarray:
        """The symbols of the blocks from first up to stop."""
        ends = [0, *self.ends.tolist()]
        self.file.seek(self.base + ends[first])
        packed = self.file.read(ends[stop] - ends[first])
        unpacker, parts = zstandard.ZstdDecompressor(), [np.zeros(0, dtype="<u4")]
        for i in range(first, stop):
            planes = unpacker.decompress(packed[ends[i] - ends[first] : ends[i + 1] - ends[first]])
            parts.append(np.frombuffer(planes, dtype=np.uint8).reshape(4, -1).T.copy().view("<u4").reshape(-1))
        self.blocks_read += stop - first
        return np.concatenate(parts)

    def ids(self) -> np.ndarray:
        return expand(self.symbols(0, len(self.ends)), self.rules, self.first)

    def document(self, i: int) -> np.ndarray:
        start = int(self.starts[i])
        stop = int(self.starts[i + 1]) if i + 1 < len(self.starts) else self.n_ids
        s = int(np.searchsorted(self.samples, start, side="right")) - 1
        e = int(np.searchsorted(self.samples, stop, side="left"))
        seq = self.symbols(s, e)
        # only the symbols that the document lies in
        upto = np.cumsum(symbol_lengths(seq, self.lengths, self.first)).astype(np.int64) + int(self.samples[s])
        a = int(np.searchsorted(upto, start, side="right"))
        b = int(np.searchsorted(upto, stop, side="left")) + 1
        skip = start - (int(upto[a - 1]) if a else int(self.samples[s]))
        return expand(seq[a:b], self.rules, self.first)[skip : skip + stop - start]


def runs(texts: list[str]) -> Iterator[slice]:
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and (i - first == TEXTS or size + len(t) > CHARACTERS):
            yield slice(first, i)
            first, size = i, 0
        size += len(t)
    if texts:
        yield slice(first, len(texts))


def write(docs: DataFrame, directory: str, key: str = "doc_id", text: str = "text", path: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Write docs as shards in ascending order of `by` (the key, if not given); rows (part, piece, path, n_ids).

    Rows are dealt by ranges of the order and sorted in each, so shards in the order of (part, piece) hold all
    documents in order. A null text is empty and a null key is -1 (the least of them first); equal keys stand in any
    order. Each document ends with END_ID. Shards close after SHARD_IDS ids.
    """
    path = path or vocabulary()
    order = by or [key]
    rows = docs.select(
        F.coalesce(F.col(key).cast("long"), F.lit(-1)).alias("key"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        *[F.col(c).alias(f"by{i}") for i, c in enumerate(order)],
    )
    names = [f"by{i}" for i in range(len(order))]
    dealt = rows.repartitionByRange(*names).sortWithinPartitions(*names).select("key", "text").withColumn("part", F.spark_partition_id())

    @tidily
    def write_part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done, keys, held, size = [], [], [], 0
        end, part = np.array([END_ID], dtype=np.uint32), 0

        def close() -> None:
            name = f"{directory}/{os.urandom(12).hex()}.ids"
            with open_shared(f"{name}.part", "wb") as f:
                write_shard(f, keys, held)
            rename_shared(f"{name}.part", name)
            done.append((part, len(done), name, size))

        for batch in batches:
            part = int(batch["part"].iloc[0]) if len(batch) else part
            texts = batch["text"].tolist()
            for some in runs(texts):
                for k, ids in zip(batch["key"].iloc[some].tolist(), encoder(path).encode(texts[some]), strict=True):
                    keys.append(int(k))
                    held.append(np.concatenate([ids, end]))
                    size += len(ids) + 1
                    if size >= SHARD_IDS:
                        close()
                        keys, held, size = [], [], 0
        if keys:
            close()
        yield pd.DataFrame(done, columns=["part", "piece", "path", "n_ids"]).astype(
            {"part": "int64", "piece": "int64", "path": str, "n_ids": "int64"}
        )

    return stash(dealt.mapInPandas(write_part, "part long, piece long, path string, n_ids long"), "shards")


def read(shards: DataFrame) -> DataFrame:
    """rows (key, start, ids_crc32, n_tokens) of all documents of shards; start: ids of all documents before it."""
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    total = lambda over: F.coalesce(F.sum("n_ids").over(earlier(over)), F.lit(0))
    # a row for each part of the deal, then the shards in each part
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", total(Window.orderBy("part")).alias("base"))
    inside = total(Window.partitionBy("part").orderBy("piece"))
    placed = shards.withColumn("inside", inside).join(parts, "part").select("path", F.expr("base + inside").alias("first"))

    @tidily
    def read_part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, first in zip(batch["path"], batch["first"], strict=True):
                with open_shared(name, "rb") as f:
                    shard = Shard(f)
                    ids = shard.ids()
                ends = np.concatenate((shard.starts[1:], [shard.n_ids])).astype(np.int64)
                starts = shard.starts.astype(np.int64)
                raw = memoryview(ids.astype("<u4").tobytes())
                yield pd.DataFrame(
                    {
                        "key": shard.keys.astype(np.int64),
                        "start": starts + int(first),
                        "n_tokens": ends - starts,
                        "ids_crc32": [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts, ends, strict=True)],
                    }
                )

    spread = placed.repartition(max(1, shards.count() // SHARDS_A_TASK))
    return spread.mapInPandas(read_part, "key long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, key: str = "doc_id", text: str = "text", by: list[str] | None = None) -> DataFrame:
    """Write docs into the shared folder and read what the files hold."""
    out = read(write(docs, scratch_path(docs.sparkSession, "ids"), key, text, by=by))
    return out.select(F.col("key").alias(key), "start", "n_tokens", "ids_crc32")
