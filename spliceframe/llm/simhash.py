"""SimHash near-dedup through pivot distance tables.

Fingerprints whose Hamming distance is at most 2 are linked; a document's class is its connected component. For each
distinct fingerprint a table holds its distances to 8 reference fingerprints, each split into the parts that its four
16-bit blocks add: 32 coordinates, computed once. Two linked fingerprints differ in two bits at most, so in two blocks
at least all their coordinates are equal. A cell is a pair of blocks with their 16 coordinates; all candidates come from
cells. In a cell, pairs are discarded if the difference of some coordinate or of some whole distance is above 2 (the
triangle inequality), and the survivors are verified. Cells of more than `dense` fingerprints are cut finer (14 of 16
nibbles equal), where 256 distinct fingerprints are the most a cell can hold, so no pair is lost and no cell is large. A
cell emits a spanning forest of its links, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import components, stash, tidily

SEED = 42
LINK = 2
#: Reference fingerprints: multiples of an odd 64-bit constant.
PIVOTS = [(0x9E3779B97F4A7C15 * (2 * i + 1)) % 2**64 for i in range(8)]
BLOCK = 16  # bits
TABLE = [f"p{b}" for b in range(64 // BLOCK)]
PIECE = 1 << 18  # shingles hashed at a time, whatever the length of a text


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def fingerprint(text: bytes, width: int = 3) -> int:
    """SimHash of a UTF-8 text: A-Z lower-cased, words between ASCII white space, `width`-word shingles with repeats."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: both touch ASCII alone
    if not words:
        return 0
    n, total = max(1, len(words) - width + 1), np.zeros(64, dtype=np.int64)
    for at in range(0, n, PIECE):
        part = words[at : at + PIECE + width - 1]
        shingles = zip(*(part[i:] for i in range(width)), strict=False) if n > 1 or len(words) >= width else [part]
        hashes = np.array([xxh64_intdigest(b" ".join(s), SEED) for s in shingles], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


@F.pandas_udf(LongType())
@tidily
def fingerprint_of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([signed(fingerprint(t)) for t in batch], dtype="int64")


def mask(parts: tuple[int, ...], width: int) -> int:
    return sum(((1 << width) - 1) << (width * p) for p in parts)


def pivot_table(fp: Column) -> list[Column]:
    """A long for each block: in its eight bytes, what the block adds to the distances to the pivots."""

    def packed(block: int) -> Column:
        own = F.lit(signed(mask((block,), BLOCK))).cast("long")
        out = F.lit(0).cast("long")
        for i, p in enumerate(PIVOTS):
            part = F.bit_count(fp.bitwiseXOR(F.lit(signed(p)).cast("long")).bitwiseAND(own)).cast("long")
            out = out.bitwiseOR(F.shiftleft(part, 8 * i))
        return out

    return [packed(b).alias(c) for b, c in enumerate(TABLE)]


def pivot_cells() -> Column:
    """One cell for each pair of blocks that may be equal: (choice, their coordinates)."""
    pairs = combinations(TABLE, 2)
    return F.array(
        *[F.struct(F.lit(i).cast("short").alias("choice"), F.col(a).alias("a"), F.col(b).alias("b")) for i, (a, b) in enumerate(pairs)]
    )


def nibble_cells(fp: Column) -> Column:
    """One cell for each choice of two nibbles that may differ: (choice, the fingerprint without them)."""
    rest = lambda c: fp.bitwiseAND(F.lit(signed(2**64 - 1 - mask(c, 4))).cast("long"))
    choices = combinations(range(16), 2)
    return F.array(*[F.struct(F.lit(i).cast("short").alias("choice"), rest(c).alias("rest")) for i, c in enumerate(choices)])


@tidily
def links_in_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cells (fps and TABLE: lists) -> rows (u, v) that join what is linked in each cell."""
    for batch in batches:
        us, vs = [], []
        for fps, *parts in zip(batch["fps"], *(batch[c] for c in TABLE), strict=True):
            f = np.asarray(fps, dtype=np.int64)
            t = np.stack([np.asarray(p, dtype=np.int64) for p in parts], axis=1).view(np.uint8).reshape(len(f), -1).astype(np.int8)
            t = np.hstack([t, t.reshape(len(f), len(TABLE), -1).sum(axis=1, dtype=np.int8)])
            group = np.arange(len(f))
            for i in range(len(f) - 1):
                near = i + 1 + np.flatnonzero(np.abs(t[i + 1 :] - t[i]).max(axis=1) <= LINK)
                near = near[np.bitwise_count((f[near] ^ f[i]).view(np.uint64)) <= LINK]
                for j in near:
                    if group[i] != group[j]:
                        us.append(f[i])
                        vs.append(f[j])
                        group[group == group[j]] = group[i]
        yield pd.DataFrame({"u": np.array(us, dtype=np.int64), "v": np.array(vs, dtype=np.int64)})


def links(fps: DataFrame, dense: int = 256) -> DataFrame:
    """rows fp (distinct) -> rows (u, v): links enough to connect all fingerprints within LINK bits."""
    base = fps.select("fp", *pivot_table(F.col("fp")))
    wide = stash(base.withColumn("cell", F.explode(pivot_cells())), "cells")
    # counts are combined before they are dealt, and the join may split a large cell
    met = wide.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    wide = stash(wide.join(met, "cell"), "met")
    gather = [F.collect_list(c).alias(a) for c, a in (("fp", "fps"), *zip(TABLE, TABLE, strict=True))]
    few = wide.where(F.col("n") <= dense).groupBy("cell").agg(*gather)  # `dense` rows at most in a cell
    crowd = wide.where(F.col("n") > dense).select("fp", *TABLE).distinct()
    many = crowd.withColumn("cell", F.explode(nibble_cells(F.col("fp")))).groupBy("cell").agg(*gather).where("size(fps) > 1")
    return few.drop("cell").union(many.drop("cell")).mapInPandas(links_in_cells, "u long, v long")


def rooted(fps: DataFrame, least: Column) -> DataFrame:
    """rows fp, repeated -> rows (fp, root, least), one for each fingerprint: root names its class."""
    distinct = fps.groupBy("fp").agg(F.min(least).alias("least"))
    roots = components(links(distinct.select("fp"))).select(F.col("node").alias("fp"), "root")
    return distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """rows (key, fingerprint, component_id), one for each row of docs.

    component_id is the least key of the documents that links reach, the row's own included; equal texts share a
    fingerprint and so a class, and are not expanded into pairs. A null or empty text has fingerprint zero. Null keys
    are never the least; a class of null keys alone has component_id null.
    """
    fp = fingerprint_of(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    fps = stash(docs.select(F.col(key).alias("key"), fp.alias("fp")), "fingerprints")
    found = rooted(fps, F.col("key"))
    ids = found.groupBy("root").agg(F.min("least").alias("component_id"))
    named = found.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return fps.join(named, "fp").select(F.col("key").alias(key), F.col("fp").alias("fingerprint"), "component_id")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class: that with the least key, nulls last (of rows that share it, that with the least hash of
    its text; of equal rows, any one).

    Key and text name the row that a class keeps: equal texts are of one class, so no two classes keep the same.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    kept = [F.col(key).alias("kept_key"), F.xxhash64(body).alias("tie")]
    fps = stash(docs.select(*kept, fingerprint_of(body.cast("binary")).alias("fp")), "fingerprints")
    found = rooted(fps, F.struct(F.col("kept_key").isNull().alias("last"), "kept_key", "tie"))
    ids = found.groupBy("root").agg(F.min("least").alias("least")).select("least.kept_key", "least.tie")
    row = docs.select(F.struct("*").alias("row"), *kept)
    held = row.join(ids, row["kept_key"].eqNullSafe(ids["kept_key"]) & (row["tie"] == ids["tie"]), "left_semi")
    first = Window.partitionBy("kept_key", "tie").orderBy(F.lit(0))
    return held.withColumn("rn", F.row_number().over(first)).where("rn = 1").select("row.*")
