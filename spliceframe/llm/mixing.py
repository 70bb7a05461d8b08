"""Mixing sources to target weights by Pfair scheduling [native].

A source of share w (its weight over the sum of all weights, as fractions) has its k-th block released at slot
floor(k / w) and due by slot ceil((k + 1) / w); earliest deadline first among the released blocks fills the slots (ties:
the source that sorts first). On one line of slots this meets all deadlines, so at any slot t a source has had more than
t * w - 1 and fewer than t * w + 1 blocks. Where a source has run out, its slots are skipped.

Shares are whole numbers of slots of a period: the least one that holds all weights, after which the schedule repeats.
Where that is longer than LONGEST, the blocks that there are are scheduled one by one instead.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from itertools import count, islice
from math import gcd, lcm

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import open_shared, scratch_path, stash

LONGEST = 1 << 18  # slots of a repeated schedule, at most
PIECE = 1 << 16  # slots that the driver holds at a time
BLOCK_ROWS = 16
BUCKETS = 4096  # of the key's hash, within a source: a hot source is ranked in this many groups


def exact_units(sources: list[str], weights: dict[str, float] | None, default_weight: float) -> list[int]:
    """Whole slots of the least period that holds the weights as they are written."""
    shares = [Fraction(str((weights or {}).get(s, default_weight))) for s in sources]
    if any(w <= 0 for w in shares):
        raise ValueError("weights must be positive")
    scale = lcm(*[w.denominator for w in shares])
    whole = [int(w * scale) for w in shares]
    return [u // gcd(*whole) for u in whole]


def schedule(units: list[int], blocks: list[int]) -> Iterator[tuple[int, int, int]]:
    """(source, k, slot) of the first blocks of each source, in order, with units slots of sum(units) for a source."""
    period = sum(units)
    waiting = [(0, i) for i, n in enumerate(blocks) if n]
    done, due, slot = [0] * len(units), [], 0
    while waiting or due:
        if not due:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            i = heapq.heappop(waiting)[1]
            heapq.heappush(due, (-(-(done[i] + 1) * period // units[i]), i))
        i = heapq.heappop(due)[1]
        yield i, done[i], slot
        done[i] += 1
        slot += 1
        if done[i] < blocks[i]:
            heapq.heappush(waiting, (done[i] * period // units[i], i))


def schedule_table(spark: SparkSession, units: list[int], blocks: list[int]) -> DataFrame:
    """rows (i, k, slot) of schedule(), which the driver writes into the shared folder, PIECE slots at a time."""
    path, rows = scratch_path(spark, "slots"), schedule(units, blocks)
    kind = pa.schema([("i", pa.int64()), ("k", pa.int64()), ("slot", pa.int64())])
    for part in count():
        held = list(islice(rows, PIECE))
        if part and not held:
            break
        columns = [list(c) for c in zip(*held, strict=True)] or [[], [], []]
        with open_shared(f"{path}/part-{part:06d}.parquet", "wb") as file:
            pq.write_table(pa.table(columns, schema=kind), file)
    return spark.read.schema("i long, k long, slot long").parquet(path)


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    default_weight: float = 1.0,
    source: str = "source",
    key: str = "doc_id",
    block_rows: int = BLOCK_ROWS,
    buckets: int = BUCKETS,
) -> DataFrame:
    """All rows of docs, with mix_block (block of its source, from 0), mix_slot (virtual slot of that block) and
    mix_position (from 0, dense: the row's place in the mixture).

    Within a source rows are dealt in the order of md5(key as text), then key; equal keys in any order. A null source
    counts as the source ''; a null key sorts first. Each row gets one place, so rows are neither lost nor repeated.
    Weights are relative; sources that weights doesn't name have default_weight. An empty table gives an empty table.
    Input columns named like the three results are replaced.
    """
    if buckets & (buckets - 1) or not 16 <= buckets <= 2**20:
        raise ValueError("buckets must be a power of two from 16 to 2**20")
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    rows = docs.select(
        F.struct(*[c for c in docs.columns if c not in ("mix_block", "mix_slot", "mix_position")]).alias("row"),
        F.coalesce(F.col(source), F.lit("")).alias("source"),
        digest.alias("h"),
        F.col(key).alias("key"),
    ).withColumn("b", (F.conv(F.substring("h", 1, 5), 16, 10).cast("long") / (2**20 // buckets)).cast("int"))
    counts = rows.groupBy("source", "b").agg(F.count("*").alias("n"))
    sources = counts.groupBy("source").agg(F.sum("n").alias("n"))
    held = sorted(sources.collect(), key=lambda r: r.source.encode())
    units = exact_units([r.source for r in held], weights, default_weight) if held else []
    whole = sum(units)
    # a repeated schedule has all blocks of a period; any other has each block once
    blocks = [-(-r.n // block_rows) for r in held] if whole > LONGEST else units
    spark = docs.sparkSession
    per_source = spark.createDataFrame(
        [(r.source, i, n) for i, (r, n) in enumerate(zip(held, blocks, strict=True))], "source string, i long, units long"
    )
    slots = schedule_table(spark, units, blocks)
    # the pieces of blocks that lie in each bucket: their virtual slot and the rows before them
    until = F.sum("n").over(Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
    pieces = (
        counts.withColumn("until", until)
        .withColumn("earlier", F.col("until") - F.col("n"))
        .join(F.broadcast(per_source), "source")
        .selectExpr("*", f"explode(sequence(earlier div {block_rows}, (until - 1) div {block_rows})) as mix_block")
        .selectExpr(
            "source", "b", "i", "earlier", "mix_block", "mix_block % units as k", "mix_block div units as turn",
            f"greatest(earlier, mix_block * {block_rows}) as begin", f"least(until, (mix_block + 1) * {block_rows}) as end",
        )
        .join(slots if whole > LONGEST else F.broadcast(slots), ["i", "k"])
        .withColumn("mix_slot", F.expr(f"turn * {whole if whole <= LONGEST else 0}L + slot"))
        .select("source", "b", "earlier", "mix_block", "mix_slot", "begin", (F.col("end") - F.col("begin")).alias("size"))
        .repartitionByRange("mix_slot", "b")
        .withColumn("part", F.spark_partition_id())
    )
    pieces = stash(pieces, "pieces")
    before = lambda w: F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = pieces.groupBy("part").agg(F.sum("size").alias("size"))  # a row for each partition
    parts = parts.select("part", before(Window.partitionBy().orderBy("part")).alias("base"))
    place = F.col("base") + before(Window.partitionBy("part").orderBy("mix_slot", "b")) - F.col("begin")
    earlier = (
        pieces.join(F.broadcast(parts), "part")
        .select("source", "b", "earlier", F.struct("mix_block", "mix_slot", place.alias("shift")).alias("piece"))
        .groupBy("source", "b", "earlier")
        .agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    )
    own = Window.partitionBy("source", "b").orderBy("h", "key")
    return (
        rows.withColumn("rn", F.row_number().over(own) - 1)
        .join(earlier, ["source", "b"])
        .withColumn("ordinal", F.col("earlier") + F.col("rn"))
        .withColumn("piece", F.expr(f"pieces[cast(ordinal div {block_rows} - earlier div {block_rows} as int)]"))
        .selectExpr("row.*", "piece.mix_block", "piece.mix_slot", "ordinal + piece.shift as mix_position")
    )
