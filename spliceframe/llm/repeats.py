"""Repeated byte strings by merging shard Burrows-Wheeler transforms.

A byte goes if it lies in a string of `length` bytes that also starts anywhere else. Three steps find these strings:

1. Each window of `length` bytes is named by its least hashed 16-byte string (leftmost of equal ones), so equal windows
   have one name wherever they stand. Neighbouring windows of one name form a piece. A piece whose whole content occurs
   twice has only repeated windows; a piece with a name of its own has none. Only names with several contents go on.
2. The contents of such names are cut into phrases at content-defined places, and shards of them get Burrows-Wheeler
   transforms over phrases. The transforms are merged by interleave refinement: blocks of suffixes that agree in k
   phrases, pushed through the shards' LF mappings, become those that agree in k + 1. The depth at which a suffix
   stands alone is its longest common prefix with any other suffix, and no suffix is sorted again.
3. Windows whose inner phrases lie in such a common prefix are compared by hash among the contents of their name; so
   the ends of a repeat, which phrases don't resolve, are exact to the byte.

A name with more contents than HOT (near copies without end) would be a large group in one task. Its windows get finer
names, of at most FINE neighbouring windows each: the hash of the bytes that all of these share. Step 2 then goes by the
finer names; where even one of them is hot, by names of single windows, of which equal ones are only to be counted.

Passages, which are PASSAGE words in a row that also start anywhere else, are found beside the bytes in the same way, but
for step 2: words are long enough for the windows of a name to be compared by hash straight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, stash, unstash

LENGTH = 400
PASSAGE = 50  # words
SEED_BYTES, SEED_WORDS = 16, 8
PLACE_BITS = 24
BUFFER = 4 << 20  # bytes of texts hashed at a time
SHARD = 1 << 20  # bytes of contents in a shard's transform
MERGE = 8 << 20  # bytes of contents merged at a time
HOT = 1024  # contents of a name, beyond which its windows get finer names
FINE = (16, 1)  # windows of a finer name, at most, and of one finer still
PHRASE_BITS = 4  # a phrase has 16 bytes on average
PHRASE_SEED = 4
SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def words_at(data: np.ndarray, width: int) -> np.ndarray:
    """The little-endian numbers of `width` (4 or 8) bytes at each place of data; len(data) - width + 1 of them."""
    n = len(data) - width + 1
    kind = np.dtype(f"<u{width}")
    out = np.empty(max(n, 0), dtype=kind)
    for i in range(min(width, max(n, 0))):
        part = data[i : i + (n - i + width - 1) // width * width]
        got = part[: len(part) // width * width].view(kind)
        out[i::width] = got[: len(out[i::width])]
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * M3
    return h ^ (h >> np.uint64(32))


def seeds(data: np.ndarray) -> np.ndarray:
    """A hash of the SEED_BYTES bytes at each place."""
    x = words_at(data, 8)
    return mixed((x[:-8] * M1) ^ ((x[8:] * M2) >> np.uint64(13)) + x[8:])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i : i + width]) for each i."""
    n = len(x) - width + 1
    full = -(-len(x) // width) * width
    padded = np.full(full, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    fore = np.minimum.accumulate(rows, axis=1).reshape(-1)
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], fore[width - 1 : width - 1 + n])


class Bytes:
    """Texts side by side, with a hash of the SEED_BYTES bytes at each place."""

    seed = SEED_BYTES

    def __init__(self, parts: list[bytes]):
        self.buffer = b"".join(parts)
        self.sizes = np.array([len(p) for p in parts], dtype=np.int64)
        self.marks = seeds(np.frombuffer(self.buffer, dtype=np.uint8))

    def hashes(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        view = memoryview(self.buffer)
        return np.array([xxh3_64_intdigest(view[a:b]) for a, b in zip(start.tolist(), stop.tolist(), strict=True)], dtype=np.uint64)

    @staticmethod
    def parts(text: bytes, length: int) -> Iterator[tuple[int, bytes]]:
        """(base, part): a very long text goes in overlapping parts, so that each window is in one of them."""
        for base in range(0, max(len(text) - length + 1, 0), BUFFER):
            yield base, text[base : base + BUFFER + length - 1]


class Words:
    """The words (between ASCII white space) of texts side by side, with a hash of the SEED_WORDS words at each place.

    A word is told by its length and its bytes, of which long ones (over 24) give the first 16 and the last 8.
    """

    seed = SEED_WORDS

    def __init__(self, parts: list[bytes]):
        data = np.frombuffer(b"\n".join([b"", *parts, b"\0" * 8]), dtype=np.uint8)
        space = SPACE[data]
        space[-8:] = True
        start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        stop = np.flatnonzero(~space[:-1] & space[1:]) + 1
        size = stop - start
        x = np.append(words_at(data, 8), np.zeros(16, dtype=np.uint64))
        masks = np.array([2 ** (8 * i) - 1 for i in range(8)] + [2**64 - 1], dtype=np.uint64)
        h = (x[start] & masks[np.minimum(size, 8)]) * M1
        h ^= (x[start + 8] & masks[np.clip(size - 8, 0, 8)]) * M2 + (x[np.maximum(stop - 8, 0)] & masks[np.where(size > 16, 8, 0)]) * M3
        h = mixed(h + size.astype(np.uint64) * M1)
        ends = np.cumsum(np.array([len(p) + 1 for p in parts], dtype=np.int64))
        self.sizes = np.diff(np.concatenate(([0], np.searchsorted(start, ends, side="right"))))
        n = len(h)
        power, self.inverse = (
            np.multiply.accumulate(np.append(np.uint64(1), np.full(n, m, dtype=np.uint64)))
            for m in (M3, np.uint64(pow(int(M3), -1, 2**64)))
        )
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum(h * power[:-1])))
        at = np.arange(max(n - self.seed + 1, 0))
        self.marks = self.hashes(at, at + self.seed)

    def hashes(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.inverse[start])

    @staticmethod
    def parts(text: bytes, length: int) -> Iterator[tuple[int, bytes]]:
        if len(text) <= BUFFER:
            if len(text) >= 2 * length - 1:
                yield 0, text
            return
        words, step = text.split(), BUFFER // 8
        for base in range(0, max(len(words) - length + 1, 0), step):
            yield base, b" ".join(words[base : base + step + length - 1])


def places(marks: np.ndarray) -> np.ndarray:
    """Hashes with their places in the low bits, so that of equal ones the leftmost is the least."""
    return (marks >> np.uint64(PLACE_BITS)) << np.uint64(PLACE_BITS) | np.arange(len(marks), dtype=np.uint64)


def pieces(texts: list[bytes], length: int = LENGTH, unit: type = Bytes) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays (text, start, windows, name, content) of the pieces of texts; texts shorter than length have none. The
    lowest bit of a name tells words (1) from bytes (0)."""

    def of_buffer(held: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
        line = unit([p[2] for p in held])
        least = sliding_least(places(line.marks), length - unit.seed + 1)
        starts = np.cumsum(line.sizes) - line.sizes
        after = starts + line.sizes - length + 1  # behind the last window of each text
        new = np.ones(len(least), dtype=bool)
        new[1:] = least[1:] != least[:-1]
        new[starts[starts < len(new)]] = True
        new[after[(after >= starts) & (after < len(new))]] = True
        at = np.flatnonzero(new)
        owner = np.searchsorted(starts, at, side="right") - 1
        stop = np.append(at[1:], len(least))
        good = at < after[owner]
        at, stop, owner = at[good], stop[good], owner[good]
        names = line.marks[(least[at] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)]
        names = names & ~np.uint64(1) | np.uint64(unit is Words)
        text, base = np.array([p[0] for p in held]), np.array([p[1] for p in held])
        return text[owner], base[owner] + at - starts[owner], stop - at, names, line.hashes(at, stop - 1 + length)

    held, size = [], 0
    for i, text in enumerate(texts):
        for base, part in unit.parts(text, length):
            held.append((i, base, part))
            size += len(part)
            if size >= BUFFER:
                yield of_buffer(held)
                held, size = [], 0
    if held:
        yield of_buffer(held)


def finer(content: bytes, length: int, unit: type, step: int) -> Iterator[tuple[int, int, int, int]]:
    """(first window, windows, finer name, content) of the parts of a content: runs of windows that hold its least
    hashed string at about the same place, named by what all of them share."""
    line = unit([content])
    n = int(line.sizes[0]) - length + 1
    least = int(places(line.marks).argmin())
    groups = np.arange((least - n + 1) // step, least // step + 1)
    first, last = np.maximum(least - (groups + 1) * step + 1, 0), np.minimum(least - groups * step, n - 1)
    shared = least - groups * step
    names = mixed(line.hashes(shared, shared + length - step + 1) * M1 + groups.astype(np.uint64))
    names = names & ~np.uint64(1) | np.uint64(unit is Words)
    contents = line.hashes(first, last + length)
    return zip(first.tolist(), (last - first + 1).tolist(), names.tolist(), contents.tolist(), strict=True)


# ---------------------------------------------------------------- shard transforms and their merge


class Transform:
    """The Burrows-Wheeler transform of strings of symbols, each ended by a mark of its own.

    last: symbol before each suffix, in suffix order; lf: where the suffix that begins one symbol earlier stands;
    places: the symbol place of each suffix. Symbols are numbers from `marks` on, marks those below.
    """

    def __init__(self, symbols: np.ndarray, ends: np.ndarray):
        n = len(symbols)
        rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
        step = 1
        while n and rank.max() < n - 1:
            later = np.zeros(n, dtype=np.int64)
            later[: n - step] = rank[step:] + 1
            rank = np.unique(rank * (n + 1) + later, return_inverse=True)[1].astype(np.int64)
            step *= 2
        self.places = np.empty(n, dtype=np.int64)
        self.places[rank] = np.arange(n)
        before = np.arange(n) - 1
        first = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else np.zeros(0, dtype=np.int64)
        before[first] = ends  # a string's first symbol follows its own mark
        self.last = symbols[before][self.places]
        self.lf = rank[before][self.places]


def merge(transforms: list[Transform]) -> list[np.ndarray]:
    """For each shard, by symbol place: how many symbols the suffix there has in common with some other suffix."""
    bases = np.concatenate(([0], np.cumsum([len(t.last) for t in transforms]))).astype(np.int64)
    last = np.concatenate([t.last for t in transforms])
    lf = np.concatenate([t.lf + b for t, b in zip(transforms, bases[:-1], strict=True)])
    n = len(last)
    depth = np.zeros(n, dtype=np.int32)
    before = np.empty(n, dtype=np.int64)
    before[lf] = np.arange(n)  # before[t]: the suffix one symbol shorter than t
    symbol = np.empty(n, dtype=np.int64)
    symbol[lf] = last
    block = np.full(n, -1, dtype=np.int64)

    def refine(at: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
        """Number the blocks of equal keys; those of one suffix are settled. The suffixes that stay."""
        _, number, count = np.unique(key, return_inverse=True, return_counts=True)
        more = count[number] > 1
        block[at] = np.where(more, number, -1)
        depth[at[more]] = k
        return at[more]

    live, k = refine(np.arange(n), symbol, 1), 1
    while len(live):
        k += 1
        held = block[before[live]]
        open_ = held >= 0
        block_now = held[open_]
        kinds = int(block_now.max()) + 1 if len(block_now) else 1
        names = np.unique(symbol[live[open_]], return_inverse=True)[1]
        key = names.astype(np.int64) * kinds + block_now
        gone, stay = live[~open_], live[open_]
        live = refine(stay, key, k) if len(stay) else stay
        block[gone] = -1
    out = []
    for t, a, b in zip(transforms, bases[:-1], bases[1:], strict=True):
        by_place = np.empty(b - a, dtype=np.int32)
        by_place[t.places] = depth[a:b]
        out.append(by_place)
    return out


@dataclass
class Phrases:
    """A shard of contents side by side, as phrase symbols.

    symbols and the places of the marks (ends); cuts: byte places where phrases begin; starts: where contents begin.
    """

    symbols: np.ndarray
    ends: np.ndarray
    cuts: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, contents: list[bytes]) -> Phrases:
        sizes = np.array([len(c) for c in contents], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(contents), dtype=np.uint8)
        x = words_at(data, PHRASE_SEED).astype(np.uint64) * M1
        cuts = np.flatnonzero((x >> np.uint64(64 - PHRASE_BITS)) == 0)
        owner = np.searchsorted(starts, cuts, side="right") - 1
        inside = cuts + PHRASE_SEED <= (starts + sizes)[owner]  # decided by bytes of the one content
        cuts, owner = cuts[inside], owner[inside]
        # a phrase's hash: its bytes times powers of an odd number, shifted back to its start
        power, inverse = (
            np.multiply.accumulate(np.append(np.uint64(1), np.full(len(data), m, dtype=np.uint64)))
            for m in (M3, np.uint64(pow(int(M3), -1, 2**64)))
        )
        upto = np.concatenate(([np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1])))
        whole = np.flatnonzero(owner[1:] == owner[:-1])  # from a cut to the next of the same content
        hashes = (upto[cuts[whole + 1]] - upto[cuts[whole]]) * inverse[cuts[whole]]
        hashes = (hashes >> np.uint64(2)).astype(np.int64) | np.int64(1 << 62)
        n = np.bincount(owner[whole], minlength=len(contents))
        ends = np.cumsum(n + 1) - 1
        symbols = np.empty(int(ends[-1]) + 1 if len(contents) else 0, dtype=np.int64)
        marks = np.zeros(len(symbols), dtype=bool)
        marks[ends] = True
        symbols[~marks] = hashes
        symbols[ends] = np.arange(len(contents))
        return cls(symbols, ends, cuts, starts)


def candidates(contents: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each content, whether each of its windows may occur in another: all that do are among them."""
    shards, size, part = [], 0, []
    for c in contents:
        part.append(c)
        size += len(c)
        if size >= SHARD:
            shards.append(part)
            size, part = 0, []
    if part:
        shards.append(part)
    made, seen = [], 0
    for s in shards:
        cut = Phrases.of(s)
        cut.symbols[cut.ends] += seen  # marks differ between shards too
        seen += len(s)
        made.append((Transform(cut.symbols, cut.ends), cut))
    out = []
    for depth, (_, cut), s in zip(merge([m[0] for m in made]), made, shards, strict=True):
        total = sum(map(len, s))
        ahead = np.zeros(total + 2, dtype=np.int64)
        ahead[cut.cuts + 1] = 1
        ahead = np.cumsum(ahead)  # ahead[i]: cuts before byte i
        # the symbol that begins at each cut; a content's last cut begins none, its mark stands there
        first = np.concatenate(([0], cut.ends[:-1] + 1))
        base = ahead[cut.starts]
        common = np.append(depth, 0)
        for c, start, at, cuts_before, end in zip(s, cut.starts, first, base, cut.ends, strict=True):
            n = len(c) - length + 1
            lo = ahead[start : start + n]
            hi = ahead[start + length - PHRASE_SEED + 1 : start + length - PHRASE_SEED + 1 + n] - 1
            got = common[np.minimum(lo - cuts_before + at, end)]
            out.append((hi <= lo) | (got >= hi - lo))
    return out


def window_hashes(content: bytes, wanted: np.ndarray, length: int = LENGTH) -> list[int]:
    from xxhash import xxh3_64_intdigest

    view = memoryview(content)
    return [xxh3_64_intdigest(view[i : i + length]) for i in wanted.tolist()]


def intervals(flags: np.ndarray) -> list[tuple[int, int]]:
    """Runs of true flags as (from, to), to excluded."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def repeated_in(names: list[int], contents: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each content, which of its windows occur in another content of its name."""
    may = candidates(contents, length)
    keys, where = [], []
    for i, (name, c, m) in enumerate(zip(names, contents, may, strict=True)):
        at = np.flatnonzero(m)
        keys.append(np.array(window_hashes(c, at, length), dtype=np.uint64) ^ np.uint64(name * int(M2) % 2**64))
        where.append(at)
    flat = np.concatenate(keys) if keys else np.zeros(0, dtype=np.uint64)
    _, number, count = np.unique(flat, return_inverse=True, return_counts=True)
    twice, out, n = count[number] > 1, [], 0
    for c, at in zip(contents, where, strict=True):
        flags = np.zeros(len(c) - length + 1, dtype=bool)
        flags[at] = twice[n : n + len(at)]
        n += len(at)
        out.append(flags)
    return out


def repeated_words(names: list[int], contents: list[bytes], length: int = PASSAGE) -> list[np.ndarray]:
    """The same for windows of words."""
    line = Words(contents)
    starts, n = np.cumsum(line.sizes) - line.sizes, line.sizes - length + 1
    at = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    keys = line.hashes(at, at + length) ^ np.repeat(np.array(names, dtype=np.int64).view(np.uint64) * M2, n)
    _, number, count = np.unique(keys, return_inverse=True, return_counts=True)
    return np.split(count[number] > 1, np.cumsum(n)[:-1])


# ---------------------------------------------------------------- the distributed steps

PIECE = "name long, content long, start int, windows int"


def signed(xs) -> np.ndarray:
    return np.asarray(xs, dtype=np.uint64).view(np.int64)


def text_hash(body: Column) -> Column:
    return F.xxhash64(body, F.octet_length(body))


def settled(rows: DataFrame, by: str) -> DataFrame:
    """rows (by, name, content, start, windows) -> stashed rows (name, content, windows, n, kinds, by, start): contents
    of names that occur twice, with the contents of the name and one place each. All sums are made of numbers, so they
    combine before they are dealt."""
    kinds = rows.groupBy("name", "content").agg(
        F.count("*").alias("n"), F.max("windows").alias("windows"), F.min(by).alias(by), F.min_by("start", by).alias("start")
    )
    names = kinds.groupBy("name").agg(F.count("*").alias("kinds"), F.sum("n").alias("total")).where("total > 1")
    return stash(kinds.join(names.drop("total"), "name"), "kinds")


def contents_of(kinds: DataFrame, texts: DataFrame, by: list[str], length: int) -> DataFrame:
    """rows (name, content, kinds, bytes) of the contents to compare, read from one text of texts (by, text) each."""
    asked = kinds.where("kinds > 1").select(*by, F.struct("name", "content", "kinds", "start", "windows").alias("one"))
    asked = asked.groupBy(*by).agg(F.collect_list("one").alias("asked"))  # of one text

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = part.column(1)
                one = lists.flatten()
                fields = {f: one.field(f) for f in ("name", "content", "kinds", "start", "windows")}
                owner = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                texts = [t.as_py() for t in part.column(0)]
                split: dict[int, list[bytes]] = {}
                data = []
                for o, a, k, name in zip(owner.tolist(), *(fields[f].to_pylist() for f in ("start", "windows", "name")), strict=True):
                    if name & 1:
                        if o not in split:
                            split[o] = texts[o].split()
                        data.append(b" ".join(split[o][a : a + k - 1 + PASSAGE]))
                    else:
                        data.append(texts[o][a : a + k - 1 + length])
                yield pa.RecordBatch.from_arrays(
                    [fields["name"], fields["content"], fields["kinds"], pa.array(data, pa.binary())],
                    names=["name", "content", "kinds", "bytes"],
                )

    source = texts.join(asked, by).select("text", "asked")
    return source.mapInArrow(read, "name long, content long, kinds long, bytes binary")


def compared(contents: DataFrame, length: int, tasks: int) -> DataFrame:
    """contents (name, content, bytes) -> rows (name, content, a, b): runs of windows that another content has too."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(rows: list[tuple]) -> pd.DataFrame:
            out = []
            for word, find_in, n in ((0, repeated_in, length), (1, repeated_words, PASSAGE)):
                some = [r for r in rows if r[0] & 1 == word]
                if some:
                    flags = find_in([r[0] for r in some], [r[2] for r in some], n)
                    out += [(r[0], r[1], a, b) for r, f in zip(some, flags, strict=True) for a, b in intervals(f)]
            return pd.DataFrame(out, columns=["name", "content", "a", "b"])

        held, size, seen = [], 0, set()
        for batch in batches:
            for row in zip(batch["name"], batch["content"], batch["bytes"], strict=True):
                if held and size >= MERGE and row[0] != held[-1][0]:
                    yield done(held)
                    held, size, seen = [], 0, set()
                if row[:2] not in seen:  # rows that share key and text give a content twice
                    seen.add(row[:2])
                    held.append(row)
                    size += len(row[2])
        if held:
            yield done(held)

    # a given number of tasks: their work isn't told by their bytes, by which Spark would join small ones
    dealt = contents.select("name", "content", "bytes").repartition(tasks, "name").sortWithinPartitions("name")
    return dealt.mapInPandas(compare, "name long, content long, a int, b int")


def whole(kinds: DataFrame) -> DataFrame:
    """Contents that occur twice: all their windows do."""
    return kinds.where("n > 1").select("name", "content", F.lit(0).alias("a"), F.col("windows").alias("b"))


def resolved(contents: DataFrame, length: int, tasks: int, steps: tuple[int, ...] = FINE) -> DataFrame:
    """Stashed contents (name, content, kinds, bytes) -> rows (name, content, a, b): runs of windows that another content
    of the name has too. Those of hot names are cut into parts under finer names, which are then resolved alike."""
    found = compared(contents.where(F.col("kinds") <= HOT), length, tasks)
    hot = contents.where(F.col("kinds") > HOT)
    if not steps or hot.isEmpty():
        return found

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, content, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                unit, n = (Words, PASSAGE) if name & 1 else (Bytes, length)
                rows += [(name, content, *part) for part in finer(data, n, unit, steps[0])]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns[:2]] + [pa.array(c, pa.int32()) for c in columns[2:4]]
                + [pa.array(signed(c)) for c in columns[4:]],
                names=["pn", "pc", "start", "windows", "name", "content"],
            )

    schema = "pn long, pc long, start int, windows int, name long, content long"
    parts = hot.select("name", "content", "bytes").mapInArrow(cut, schema).distinct()
    parts = stash(parts.select("*", F.xxhash64("pn", "pc").alias("parent")), "parts")
    kinds = settled(parts, "parent")
    held = hot.select(F.xxhash64("name", "content").alias("parent"), F.col("bytes").alias("text"))
    inner = stash(contents_of(kinds, held, ["parent"], length), "contents")
    met = resolved(inner, length, tasks, steps[1:]).union(whole(kinds))
    more = parts.join(met, ["name", "content"]).selectExpr("pn as name", "pc as content", "start + a as a", "start + b as b")
    return found.union(more)


def repeated(texts: DataFrame, unit: type, length: int, tasks: int) -> DataFrame:
    """texts (did, tk, text) -> stashed rows (tk, spans): for each distinct text with repeats of `length` bytes or words,
    the array of (a, b) of the starts of its repeated windows. What is written on the way is deleted."""
    spark = texts.sparkSession

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                for owner, start, windows, name, content in pieces([t.as_py() for t in part.column(1)], length, unit):
                    columns = [part.column(0).take(pa.array(owner)), *[pa.array(signed(x)) for x in (name, content)]]
                    columns += [pa.array(x.astype(np.int32)) for x in (start, windows)]
                    yield pa.RecordBatch.from_arrays(columns, names=["tk", "name", "content", "start", "windows"])

    every = stash(texts.select("tk", "text").mapInArrow(cut, f"tk long, {PIECE}"), "pieces")
    kinds = settled(every, "tk")
    release(spark)
    # of the copies of a text that holds contents to compare, the first is read
    firsts = texts.select("tk", "did").groupBy("tk").agg(F.min("did").alias("did"))
    contents = stash(contents_of(kinds.join(firsts, "tk"), texts, ["did", "tk"], length), "contents")
    release(spark)
    spans = stash(resolved(contents, length, tasks).union(whole(kinds)), "spans")
    for table in (contents, kinds):
        unstash(table)
    release(spark)
    one = F.struct((F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b"))
    found = every.join(spans, ["name", "content"]).groupBy("tk").agg(F.collect_set(one).alias("spans"))
    found = stash(found, "repeats")
    for table in (every, spans):
        unstash(table)
    release(spark)
    return found


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Stashed rows (tk, spans, passages): for each distinct text (its hash) with repeats, the arrays of (from, to) of the starts
    of its repeated windows, in bytes and in words. Copies of a text share a row. Null texts are empty and have none.

    Words come after bytes are done, so that only the tables of one of them are on disk at a time."""
    if not SEED_BYTES + max(FINE) < length < BUFFER:
        raise ValueError("length must be above 32 and below 4 MB")
    body = F.coalesce(F.col(text), F.lit(""))
    texts = docs.where(F.octet_length(body) >= min(length, 2 * PASSAGE - 1)).select(
        F.coalesce(F.col(key).cast("long"), F.lit(-(2**63)).cast("long")).alias("did"),
        text_hash(body).alias("tk"),
        body.cast("binary").alias("text"),
    )
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spans = repeated(texts, Bytes, length, tasks)
    passages = repeated(texts, Words, PASSAGE, tasks)
    found = stash(spans.join(passages.withColumnRenamed("spans", "passages"), "tk", "full"), "found")
    for table in (spans, passages):
        unstash(table)
    return found


def covered(a: np.ndarray, b: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs (from, to) of bytes covered by the windows that start in the spans (a, b)."""
    if not len(a):
        return a, b
    order = np.argsort(a, kind="stable")
    a, stop = a[order], np.maximum.accumulate(b[order] - 1 + length)
    new = np.flatnonzero(np.append(True, a[1:] > stop[:-1]))
    return a[new], stop[np.append(new[1:] - 1, len(a) - 1)]


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """rows (key, n_bytes, n_removed, n_spans, kept, n_passage_words): what is left of each text, as bytes, once every
    byte that lies in a string of `length` bytes that also starts elsewhere is gone (all judged on the input), and the
    words that lie in a passage, which may be shorter than `length` and then stays. Every row of docs stays; null texts
    are empty; texts of fewer bytes are whole; repeated rows repeat each other."""
    found = find(docs, key, text, length)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("key"), text_hash(body).alias("tk"), body.cast("binary").alias("text")
    )
    kind = docs.schema[key].dataType.simpleString()

    def runs_of(lists: pa.ListArray, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        at = np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
        first, last = (lists.flatten().field(f).to_numpy().astype(np.int64) for f in ("a", "b"))
        return [covered(first[i:j], last[i:j], n) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_removed, n_spans, kept = [], [], [], []
            found, words = (runs_of(batch.column(i), n) for i, n in ((2, length), (3, PASSAGE)))
            for t, runs in zip(batch.column(1), found, strict=True):
                t = t.as_py()
                edges = [0, *np.stack(runs, axis=1).reshape(-1).tolist(), len(t)]
                left = b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                n_bytes.append(len(t))
                n_removed.append(len(t) - len(left))
                n_spans.append(len(runs[0]))
                kept.append(left)
            numbers = [pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans, [int((b - a).sum()) for a, b in words])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *numbers[:3], pa.array(kept, pa.binary()), numbers[3]],
                names=["key", "n_bytes", "n_removed", "n_spans", "kept", "n_passage_words"],
            )

    joined = rows.join(found, "tk", "left").select("key", "text", "spans", "passages")
    out = joined.mapInArrow(strip, f"key {kind}, n_bytes long, n_removed long, n_spans long, kept binary, n_passage_words long")
    return out.withColumnRenamed("key", key)

