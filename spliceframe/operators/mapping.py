"""Mapping long reads to regions of genes.

Reads with one placement and CIGAR map alike, so distinct alignments are mapped once. Genes are found by a range join;
the search for the best chain of segments runs per (alignment, gene) over Arrow batches, gene by gene: in numpy for a whole
batch where each block can stand for one run of segments at most, chain by chain for the rest; the choice among genes is a
JVM fold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import QuantifySettings
from ..functions.columns import best_gene_fold, cigar_lengths
from ..plans.scratch import merged, settle
from .intervals import overlap_join, range_join
from .paths import GENE, owners
from .readlen import order_statistics

PLACE = ["pos", "chr", "cigar"]  # sorts by a number first: contigs are few
GROUP_ROWS = 200_000  # placements of one gene in one task, about
BROADCAST_GENES = 100_000  # genes of more than that; beyond, they are joined by a shuffle


def placements(reads: DataFrame) -> DataFrame:
    """rows (chr, pos, cigar, lens, r_start, r_end): distinct alignments that begin and end in a block; lens: the lengths of
    their blocks and gaps in turn."""
    one = reads.select("chr", "pos", "cigar").distinct()
    # a filter would be evaluated below the distinct as well, and fold each CIGAR twice
    whole = F.explode_outer(F.filter(F.array(cigar_lengths(F.col("cigar"))), lambda x: F.size(x) % 2 == 1))
    kept = one.select("chr", "pos", "cigar", whole.alias("lens")).where("lens is not null")
    return kept.select(
        "chr", "pos", "cigar", "lens", F.col("pos").alias("r_start"),
        (F.col("pos") - 1 + F.aggregate("lens", F.lit(0), lambda a, x: a + x)).alias("r_end"),
    )


def gene_candidates(placed: DataFrame, genes: DataFrame, tolerance: int = 20) -> DataFrame:
    """Each placement with the genes that hold it but for `tolerance` bases at either end (2 if it is short)."""
    slack = F.when(F.col("r_end") - F.col("r_start") > 2 * tolerance, tolerance).otherwise(2)
    within = (F.col("g_start") <= F.col("r_start") + slack) & (F.col("g_end") >= F.col("r_end") - slack)
    at = F.col("r_start") + slack
    return range_join(placed, genes, ["chr"], at, F.col("g_start") - 8, F.col("g_end") + 8, within)


class Paths:
    """The isoform paths of a gene, asked for contiguous slices."""

    def __init__(self, paths: list[str]):
        self.paths = paths
        self.known: dict[tuple[int, ...], bool] = {}

    def holds(self, part: tuple[int, ...]) -> bool:
        got = self.known.get(part)
        if got is None:
            text = "," + ",".join(map(str, part)) + ","
            got = self.known[part] = any(text in p for p in self.paths)
        return got


def block_options(block: tuple[int, int], segs: list[tuple[int, int]], first: bool, last: bool, ends: int, junction: int) -> list[tuple[int, int]]:
    """Runs (a, b) of segments a block can stand for, the right-most end first, then the shortest.

    Between blocks both edges must meet a segment edge within `junction`; at a read's own ends the block may stop
    anywhere inside, or reach at most `ends` beyond.
    """
    lo, hi = block[0] - junction, block[1] + junction
    near = [i for i, (s, e) in enumerate(segs) if s < hi and e + 1 > lo]
    out = []
    for b in reversed(near):
        over = block[1] - segs[b][1]
        if over > ends if last else abs(over) > junction:
            continue
        a = b
        while True:
            before = segs[a][0] - block[0]
            if before <= ends if first else abs(before) <= junction:
                out.append((a, b))
            if a - 1 < near[0] or segs[a][0] - segs[a - 1][1] > junction:
                break
            a -= 1
    return out


def best_chain(read: list[tuple[int, int]], segs: list[tuple[int, int]], paths: Paths, ends: int = 20, junction: int = 5, least: int = 15):
    """(path, overlap, length) of the best region for a read's blocks, or None.

    Chains are built block by block, ranked by (overlap, overlap / length); equal ones keep the order in which they
    were made. A beginning that no isoform holds can't end in a region and is dropped at once, which changes no rank.
    """
    if any(e - s < least for s, e in read):
        return None
    chains: list[tuple[tuple[int, ...], int, int]] = [((), 0, 0)]
    for k, block in enumerate(read):
        options = block_options(block, segs, k == 0, k == len(read) - 1, ends, junction)
        longer = []
        for path, overlap, length in chains:
            for a, b in options:
                if path and path[-1] >= a:
                    continue
                grown = path + tuple(range(a, b + 1))
                if not paths.holds(grown):
                    continue
                s, e = segs[a][0], segs[b][1]
                own = e - s + 1
                shared = own + block[1] - block[0] + 1 - (max(e, block[1]) - min(s, block[0]) + 1)
                longer.append((grown, overlap + shared, length + own))
        if not longer:
            return None
        chains = sorted(longer, key=lambda c: (c[1], c[1] / c[2]), reverse=True)
    return chains[0]


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), then those of first[1], and so on."""
    ends = np.cumsum(count)
    return np.repeat(first - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


def sums(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The sum of the first count[0] values, of the next count[1], and so on."""
    upto = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    ends = np.cumsum(count)
    return upto[ends] - upto[ends - count]


SPAN = 1 << 34  # of a gene, where several are laid on one line, each from its first segment on


class Batch:
    """Genes and the placements searched in them, as flat arrays. segs: (starts, ends) and how many of each gene; blocks: the
    same of each placement; gene: the gene's number of each placement, not falling."""

    def __init__(self, segs: tuple[np.ndarray, np.ndarray, np.ndarray], blocks: tuple[np.ndarray, np.ndarray, np.ndarray], gene: np.ndarray):
        (self.s, self.e, self.n_segs), (self.bs, self.be, self.n_blocks), self.gene = segs, blocks, gene
        self.at = np.cumsum(self.n_segs) - self.n_segs  # a gene's first segment
        self.first = np.cumsum(self.n_blocks) - self.n_blocks  # a placement's first block

    def options(self, ends: int, junction: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each block the number of its block_options, and one (a, b) of them, as numbers of segments of the batch."""
        own = np.repeat(self.gene, self.n_blocks)
        place = np.arange(len(self.bs))
        starts = np.repeat(self.first, self.n_blocks) == place
        stops = np.repeat(self.first + self.n_blocks - 1, self.n_blocks) == place
        least = np.zeros(len(self.n_segs), np.int64)
        least[self.n_segs > 0] = self.s[self.at[self.n_segs > 0]]
        shift = np.arange(len(self.n_segs)) * SPAN - least
        line = np.repeat(shift, self.n_segs)
        low = np.searchsorted(line + self.e, shift[own] + self.bs - junction)
        low = np.maximum(low, self.at[own])
        high = np.searchsorted(line + self.s, shift[own] + self.be + junction)
        near = np.maximum(np.minimum(high, (self.at + self.n_segs)[own]) - low, 0)
        # a row for each block and segment near it
        block, seg = np.repeat(place, near), ranges(low, near)
        over, before = self.be[block] - self.e[seg], self.s[seg] - self.bs[block]
        right = np.where(stops[block], over <= ends, np.abs(over) <= junction)
        left = np.where(starts[block], before <= ends, np.abs(before) <= junction)
        linked = np.zeros(len(seg), bool)
        linked[1:] = (block[1:] == block[:-1]) & (self.s[seg[1:]] - self.e[seg[:-1]] <= junction)
        # in a stretch of linked segments, each left edge up to a right edge makes an option with it
        upto = np.cumsum(left)
        head = np.maximum.accumulate(np.where(linked, 0, np.arange(len(seg)))) if len(seg) else np.zeros(0, np.int64)
        made = np.where(right, upto - upto[head] + left[head], 0)
        count = sums(made, near)
        last = seg[np.maximum.accumulate(np.where(left, np.arange(len(seg)), 0))] if len(seg) else seg
        a, b = np.full(len(place), -1), np.full(len(place), -1)
        found = np.flatnonzero(made)
        a[block[found]], b[block[found]] = last[found], seg[found]
        return count, a, b

    def chains(self, ends: int, junction: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Placements whose one chain of segments is in order, with its segments' number, the segments (numbers in the gene, one
        placement after another), overlap and length; and the placements that have several chains, or no block."""
        count, a, b = self.options(ends, junction)
        inner = np.ones(len(a), bool)
        inner[1:] = b[:-1] < a[1:]
        inner[self.first[self.n_blocks > 0]] = True
        gap = (count == 0) | (self.be - self.bs < least)
        none = sums(gap, self.n_blocks) > 0
        many = ~none & ((sums(count > 1, self.n_blocks) > 0) | (self.n_blocks == 0))
        one = np.flatnonzero(~none & ~many & (sums(~inner, self.n_blocks) == 0))
        n = self.n_blocks[one]
        blocks = ranges(self.first[one], n)
        a, b, bs, be = a[blocks], b[blocks], self.bs[blocks], self.be[blocks]
        s, e = self.s[a], self.e[b]
        own = e - s + 1
        shared = own + be - bs + 1 - (np.maximum(e, be) - np.minimum(s, bs) + 1)
        size = sums(b - a + 1, n)
        path = ranges(a, b - a + 1) - np.repeat(self.at[self.gene[one]], size)
        return one, size, path, sums(shared, n), sums(own, n), np.flatnonzero(many)


FOUND = "pos long, chr string, cigar string, r_end long, gene string, read_length int, path array<int>, overlap long, length long"
CARRIED = ["pos", "chr", "cigar", "r_end", "gene"]


def flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """s, e and their number in each list of structs (s, e); a null list has none."""
    s, e = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in lists.flatten().flatten())
    return s, e, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def laid(pos: np.ndarray, lens: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """s and e of the blocks of placements, and their number in each, from lengths of blocks and gaps in turn."""
    n = lens.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    each = lens.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    ahead = np.concatenate([[0], np.cumsum(each)])
    first = np.cumsum(n) - n
    start = np.repeat(pos - ahead[first], n) + ahead[:-1]
    block = (np.arange(len(each)) - np.repeat(first, n)) % 2 == 0
    return start[block], (start + each - 1)[block], (n + 1) // 2


def found_rows(rows: pa.RecordBatch, bases: np.ndarray, size: np.ndarray, path: np.ndarray, overlap: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
    paths = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(path, pa.int32()))
    columns = [rows.column(c) for c in CARRIED] + [pa.array(bases, pa.int32()), paths, pa.array(overlap, pa.int64()), pa.array(length, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=[*CARRIED, "read_length", "path", "overlap", "length"])


def search_batches(batches: Iterator[pa.RecordBatch], s: QuantifySettings) -> Iterator[pa.RecordBatch]:
    """Rows of FOUND from rows of genes (segs, paths), each ahead of those of the placements (lens) searched in it."""
    limits = s.end_tolerance, s.junction_tolerance, s.least_block
    held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)), Paths([])  # the last gene of the batch before
    for batch in batches:
        is_gene = batch.column("segs").is_valid().to_numpy(zero_copy_only=False)
        listed = np.flatnonzero(is_gene)
        (s0, e0, n0), before = held
        s1, e1, n1 = flat(batch.column("segs"))
        segs = np.concatenate([s0, s1]), np.concatenate([e0, e1]), np.concatenate([n0, n1[listed]])
        known = [before] + [Paths(p) for p in batch.column("paths").take(pa.array(listed)).to_pylist()]
        rows = batch.select([*CARRIED, "lens"]).take(pa.array(np.flatnonzero(~is_gene)))
        bs, be, n_blocks = laid(rows.column("pos").to_numpy(), rows.column("lens"))
        made = Batch(segs, (bs, be, n_blocks), np.cumsum(is_gene)[~is_gene])
        bases = sums(be - bs + 1, n_blocks)
        one, size, path, overlap, length, many = made.chains(*limits)
        ends = np.cumsum(size).tolist()
        numbers = path.tolist()
        kept = np.array([known[g].holds(tuple(numbers[b - n : b])) for g, n, b in zip(made.gene[one].tolist(), size.tolist(), ends, strict=True)], bool)
        yield found_rows(rows.take(pa.array(one[kept])), bases[one[kept]], size[kept], path[np.repeat(kept, size)], overlap[kept], length[kept])
        out = []
        for k in many.tolist():
            g, at = made.gene[k], made.first[k]
            held_segs = slice(made.at[g], made.at[g] + made.n_segs[g])
            own = list(zip(made.s[held_segs].tolist(), made.e[held_segs].tolist(), strict=True))
            read = slice(at, at + made.n_blocks[k])
            got = best_chain(list(zip(made.bs[read].tolist(), made.be[read].tolist(), strict=True)), own, known[g], *limits)
            if got:
                out.append((k, *got))
        if out:
            index, chains, overlap, length = zip(*out, strict=True)
            size = np.array([len(c) for c in chains])
            path = np.array([i for c in chains for i in c], np.int64)
            yield found_rows(rows.take(pa.array(index)), bases[list(index)], size, path, np.array(overlap), np.array(length))
        last = slice(made.at[-1], made.at[-1] + segs[2][-1])
        held = (segs[0][last], segs[1][last], segs[2][-1:]), known[-1]


def map_placements(candidates: DataFrame, genes: DataFrame, s: QuantifySettings) -> DataFrame:
    """candidates (chr, pos, cigar, lens, r_end, gene) -> rows of FOUND; genes: (chr, gene, segs, paths).

    A gene's segments and paths go once to each task that searches it, ahead of its placements. The placements of a gene
    that has more than GROUP_ROWS are dealt over several tasks. candidates are read twice.
    """
    sizes = candidates.groupBy(*GENE).agg(F.count("*").alias("n")).where(F.col("n") > GROUP_ROWS)
    large = settle(sizes.select(*GENE, F.ceil(F.col("n") / GROUP_ROWS).alias("parts")))
    large = F.broadcast(large) if large.count() <= BROADCAST_GENES else large
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    rows = candidates.join(large, GENE, "left").withColumn("part", F.pmod(F.xxhash64("pos", "cigar"), parts))
    held = genes.join(large, GENE, "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    rows = rows.select(*GENE, "part", F.col("pos").cast("long").alias("pos"), "cigar", "lens", F.col("r_end").cast("long").alias("r_end"))
    held = held.select(*GENE, "part", "segs", "paths")
    both = held.unionByName(rows, allowMissingColumns=True).repartition(*GENE, "part")
    dealt = both.sortWithinPartitions("gene", "chr", "part", F.col("segs").isNull())
    return dealt.mapInArrow(lambda batches: search_batches(batches, s), FOUND)


def choose_genes(mapped: DataFrame) -> DataFrame:
    """Of each placement's genes the best, or all that tie: rows (pos, chr, cigar, r_end, read_length, gene, path)."""
    one = F.collect_list(F.struct("gene", "overlap", "length", "path"))
    kept = mapped.groupBy(*PLACE).agg(F.first("r_end").alias("r_end"), F.first("read_length").alias("read_length"), one.alias("x"))
    alone = (F.size("x") == 1) & (F.col("x")[0]["overlap"] > 2)  # the fold keeps it
    kept = kept.withColumn("k", F.explode(F.when(alone, F.col("x")).otherwise(best_gene_fold(F.col("x")))))
    return kept.select(*PLACE, "r_end", "read_length", "k.gene", "k.path")


def pick_one(kept: DataFrame) -> DataFrame:
    """One gene of each read's ties, that of the least MD5 of name:gene (then the least path): rows (name, ..., gene, path)
    with a name column."""
    order = F.md5(F.concat_ws(":", F.col("name").cast("string"), F.col("gene").cast("string")))
    cols = [c for c in kept.columns if c != "name"]
    best = kept.groupBy("name").agg(F.min_by(F.struct(*cols), F.struct(order, "gene", "path")).alias("k"))
    return best.select("name", "k.*")


def map_reads(reads: DataFrame, gene_segs: DataFrame, iso_paths: DataFrame, s: QuantifySettings) -> DataFrame:
    """rows (name, chr, gene, path, r_start, r_end, read_length): the regions of each read."""
    reads = reads.withColumn("pos", F.col("pos").cast("long"))
    texts = iso_paths.select(*GENE, F.concat(F.lit(","), F.array_join(F.col("path").cast("array<string>"), ","), F.lit(",")).alias("p"))
    genes = settle(gene_segs.join(texts.groupBy(*GENE).agg(F.collect_list("p").alias("paths")), GENE))
    candidates = gene_candidates(placements(reads), genes.select(*GENE, "g_start", "g_end"), s.gene_tolerance)
    candidates = settle(candidates.select(*GENE, "pos", "cigar", "lens", "r_end"))
    found = merged(choose_genes(map_placements(candidates, genes, s)))  # in the order of the join below: a shuffle less
    full = merged(reads.select("name", *PLACE)).join(found, PLACE)
    return merged(full.select("name", *GENE, "path", F.col("pos").alias("r_start"), "r_end", "read_length"))


def rejected_reads(reads: DataFrame, mapped: DataFrame) -> DataFrame:
    """Reads that no region took."""
    return reads.join(mapped.select("name").distinct(), "name", "left_anti")


def isoform_offsets(mapped: DataFrame, owned: DataFrame, iso: DataFrame, strand_strict: bool = True) -> DataFrame:
    """rows (name, chr, gene, isoform, iso_len, off5, off3, read_length, n_isoforms): a read against each isoform that
    owns its region; a read and isoform that meet twice count once."""
    joined = mapped.join(owned, [*GENE, "path"]).join(iso.select(*GENE, "isoform", "exons", "strand", "length"), [*GENE, "isoform"])
    ahead = F.aggregate(
        "exons",
        F.struct(F.lit(0).cast("long").alias("off"), F.lit(False).alias("met")),
        lambda acc, x: F.when(acc["met"], acc)
        .when(x["e"] > F.col("r_start"), F.struct((acc["off"] + F.col("r_start") - x["s"] + 1).alias("off"), F.lit(True).alias("met")))
        .otherwise(F.struct((acc["off"] + x["e"] - x["s"] + 1).alias("off"), F.lit(False).alias("met"))),
        lambda acc: acc["off"],
    )
    laid = joined.withColumn("a", ahead).withColumn("b", F.col("length") - F.col("a") - F.col("read_length"))
    a, b = F.greatest("a", F.lit(0)), F.greatest("b", F.lit(0))
    flip = F.lit(False) if strand_strict else F.col("strand") == "-"
    out = laid.select(
        "name", *GENE, "path", "isoform", F.col("length").alias("iso_len"),
        F.when(flip, b).otherwise(a).alias("off5"), F.when(flip, a).otherwise(b).alias("off3"), "read_length",
    )
    return out.dropDuplicates(["name", "isoform"])


def read_qc(read_iso: DataFrame, exon_counts: DataFrame) -> DataFrame:
    """Reads that pass: none of their isoforms has over 7 more exons than the region and 5 times its length."""
    joined = read_iso.join(exon_counts, ["isoform"])
    bad = joined.where("n_exons - size(path) > 7 and read_length / iso_len <= 0.2").select("name").distinct()
    return read_iso.join(bad, "name", "left_anti")


def region_qc(mapped: DataFrame, iso_paths: DataFrame, iso: DataFrame) -> DataFrame:
    """Of reads (chr, gene, path, read_length, ...) on one gene each, those that read_qc passes. A read fails by the longest of
    the isoforms that have over 7 more exons than its region: that is one number of a region, and no read meets its isoforms."""
    owned = owners(mapped, iso_paths).join(iso_paths.select(*GENE, "isoform", F.size("path").alias("n_exons")), [*GENE, "isoform"])
    owned = owned.join(iso.select(*GENE, "isoform", F.col("length").alias("iso_len")), [*GENE, "isoform"])
    longest = F.max(F.when(F.col("n_exons") - F.size("path") > 7, F.col("iso_len"))).alias("_longest")
    limits = owned.groupBy(*GENE, "path").agg(longest)
    passed = F.col("_longest").isNull() | (F.col("read_length") / F.col("_longest") > 0.2)
    return mapped.join(merged(limits), [*GENE, "path"]).where(passed).drop("_longest")


def region_counts(mapped: DataFrame) -> DataFrame:
    """rows (chr, gene, path, n, lengths): reads of each region, and how many (n) of each read_length."""
    each = mapped.groupBy(*GENE, "path", "read_length").agg(F.count("*").alias("n"))
    return each.groupBy(*GENE, "path").agg(F.sum("n").alias("n"), F.collect_list(F.struct("read_length", "n")).alias("lengths"))


def best_gene(reads: DataFrame, genes: DataFrame) -> DataFrame:
    """rows (name, chr, gene, overlap): of genes (chr, gene, start, end) that a read (name, chr, pos, length) overlaps, the
    one that shares most bases with it, counting one more past its end; of equal ones the least."""
    left = reads.withColumns({"start": F.col("pos"), "end": F.expr("pos + length - 1")})
    met = overlap_join(left, genes.withColumnsRenamed({"start": "r_start", "end": "r_end"}), ["chr"])
    span = F.greatest(F.col("pos") + F.col("length"), "r_end") - F.least("pos", "r_start") + 1
    met = met.withColumn("overlap", F.col("r_end") - F.col("r_start") + 1 + F.col("length") - span).where("overlap > 0")
    best = F.min(F.struct((-F.col("overlap")).alias("less"), "gene")).alias("best")
    return met.groupBy("name", "chr", "pos", "length").agg(best).select("name", "chr", F.col("best.gene").alias("gene"), (-F.col("best.less")).alias("overlap"))


def least_overlaps(reads: DataFrame, genes: DataFrame, part: int = 10) -> DataFrame:
    """rows (chr, gene, decile): of the overlaps of a gene's reads in order, the one at their number div part."""
    found = best_gene(reads, genes).withColumn("key", F.struct("chr", "gene"))
    return order_statistics(found, "key", "overlap", {"decile": part}).select("key.chr", "key.gene", "decile")
