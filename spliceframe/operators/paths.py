"""Annotation operators: isoforms as paths over atomic segments, and the regions (contiguous sub-paths) they own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import KValueSettings
from ..functions.columns import path_text, region_effective_length, region_is_valid, region_type
from ..plans.scratch import merged, settle
from .intervals import atomic_split, contained_in

GENE = ["chr", "gene"]


def isoforms(exons: DataFrame) -> DataFrame:
    """rows (chr, gene, isoform, strand, exons, n_exons, length): exons sorted by (s, e)."""
    one = F.struct(F.col("start").alias("s"), F.col("end").alias("e"))
    found = exons.groupBy(*GENE, "isoform").agg(
        F.first("strand").alias("strand"),
        F.array_sort(F.collect_list(one)).alias("exons"),
        F.count("*").cast("int").alias("n_exons"),
        F.sum(F.expr("end - start + 1")).cast("long").alias("length"),
    )
    return merged(found)


def segments(exons: DataFrame) -> DataFrame:
    """rows (chr, gene, seg, start, end, len): a gene's atomic pieces, numbered from 0."""
    order = Window.partitionBy(*GENE).orderBy("start")
    pieces = atomic_split(exons, GENE).select(
        *GENE, (F.row_number().over(order) - 1).alias("seg"), "start", "end", F.expr("end - start + 1").alias("len")
    )
    return merged(pieces)


def gene_segments(segs: DataFrame) -> DataFrame:
    """rows (chr, gene, segs, g_start, g_end): a gene's pieces as one array."""
    one = F.struct(F.col("start").alias("s"), F.col("end").alias("e"))
    return segs.groupBy(*GENE).agg(
        F.array_sort(F.collect_list(one)).alias("segs"), F.min("start").alias("g_start"), F.max("end").alias("g_end")
    )


def paths(segs: DataFrame, exons: DataFrame) -> DataFrame:
    """rows (chr, gene, isoform, path): the segments inside an isoform's exons, in order."""
    held = contained_in(segs, exons.select(*GENE, "isoform", "start", "end"), GENE)
    return merged(held.groupBy(*GENE, "isoform").agg(F.array_sort(F.collect_set("seg")).alias("path")))


def laid_out(exons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """segments and paths as tables, each computed once: what reads them by several ways holds no plan of theirs."""
    segs = settle(segments(exons))
    return segs, settle(paths(segs, exons))


def slices(iso_paths: DataFrame, segs: DataFrame, longest_inner: int | None = None) -> DataFrame:
    """rows (chr, gene, path, len, first, last, inner, isoforms): every contiguous sub-path with its owners.

    Lengths are differences of prefix sums. With longest_inner, sub-paths whose inner length (without first and last
    segment) is above it are never made, so the square of a long isoform isn't either.

    A sub-path's owners are the isoforms whose path, as text, holds its text. The first of them makes it: each is made once,
    in its gene's row, and none is sorted, shuffled or grouped. A gene's row is gathered from both tables in one grouping.
    """
    parts = segs.select(*GENE, F.struct("seg", "len").alias("piece")).unionByName(
        iso_paths.where("size(path) > 0").select(*GENE, F.struct("isoform", "path").alias("own")), allowMissingColumns=True
    )
    gene = parts.groupBy(*GENE).agg(F.map_from_entries(F.collect_list("piece")).alias("len_of"), F.array_sort(F.collect_list("own")).alias("owns"))
    # an isoform without a name makes sub-paths and owns none
    gene = gene.withColumn("every", F.transform("owns", lambda o, k: F.struct(k.alias("k"), o["isoform"].alias("isoform"), path_text(o["path"]).alias("text"))))
    laid = gene.select(*GENE, "every", "len_of", F.posexplode("owns").alias("k", "own"))
    laid = laid.select(*GENE, "every", "k", "own.path", F.expr("transform(own.path, p -> cast(len_of[p] as bigint))").alias("lens"))
    # one running sum over the path
    laid = laid.withColumn(
        "ends",
        F.expr("aggregate(lens, cast(array() as array<bigint>), (a, x) -> concat(a, array(coalesce(try_element_at(a, -1), 0L) + x)))"),
    )
    one = laid.select("*", F.posexplode("path").alias("i", "at"))
    stop = "size(path) - 1"
    if longest_inner is not None:
        # inner length grows with j, so the fitting ones are a prefix
        fits = f"size(filter(sequence(i, {stop}), j -> j <= i + 1 or ends[j - 1] - ends[i] <= {longest_inner}))"
        stop = f"i + {fits} - 1"
    each = one.select("*", F.explode(F.expr(f"sequence(i, {stop})")).alias("j"))
    each = each.select(
        *GENE, "every", "k",
        F.expr("slice(path, i + 1, j - i + 1)").alias("path"),
        F.expr("ends[j] - ends[i] + lens[i]").alias("len"),
        F.expr("lens[i]").alias("first"),
        F.expr("lens[j]").alias("last"),
        F.expr("if(j - i > 1, ends[j - 1] - ends[i], 0L)").alias("inner"),
    ).withColumn("text", path_text(F.col("path")))
    new = each.where("not exists(every, x -> x.k < k and instr(x.text, text) > 0)")
    return new.select(
        *GENE, "path", "len", "first", "last", "inner",
        F.expr("transform(filter(every, x -> x.k >= k and x.isoform is not null and instr(x.text, text) > 0), x -> x.isoform)").alias("isoforms"),
    )


def regions(iso_paths: DataFrame, segs: DataFrame, s: KValueSettings) -> DataFrame:
    """The regions that the selection keeps, with kind and eff_len."""
    inner = s.read_length - 2 * s.least_junction if s.region_selection == "read_length" else None
    every = slices(iso_paths, segs, inner)
    kind = region_type(F.size("path"))
    every = every.withColumn("kind", kind)
    if s.region_selection == "read_length":
        every = every.where(
            region_is_valid(F.col("kind"), F.col("len"), F.col("first"), F.col("last"), F.col("inner"), s.read_length, s.least_junction)
        )
    elif s.region_selection == "num_exons":
        every = every.where(F.size("path") <= 2)
    elif s.region_selection != "real_data":
        raise ValueError(f"region_selection must be read_length, num_exons or real_data, not {s.region_selection}")
    rl, j = F.lit(s.read_length), F.lit(s.least_junction)
    return every.withColumn("eff_len", region_effective_length(F.col("kind"), F.col("len"), F.col("inner"), rl, j))


def owners(asked: DataFrame, iso_paths: DataFrame) -> DataFrame:
    """asked (chr, gene, path) -> rows (chr, gene, path, isoform): isoforms of which the path is a contiguous slice."""
    own = iso_paths.select(*GENE, "isoform", path_text(F.col("path")).alias("_whole"))
    asked = asked.select(*GENE, "path").distinct().withColumn("_part", path_text(F.col("path")))
    return asked.join(own, GENE).where("instr(_whole, _part) > 0").drop("_whole", "_part")


def full_length(rows: DataFrame, by: list[str], size: str = "n_segments") -> DataFrame:
    """Rows whose size is the greatest of their group."""
    return rows.withColumn("_most", F.max(size).over(Window.partitionBy(*by))).where(F.col(size) == F.col("_most")).drop("_most")


def identical_isoforms(exons: DataFrame) -> DataFrame:
    """rows (chr, gene, exons, isoforms): isoforms of a gene with the very same exons, where there are several."""
    same = isoforms(exons).groupBy(*GENE, "exons").agg(F.array_sort(F.collect_list("isoform")).alias("isoforms"))
    return same.where("size(isoforms) > 1")


def gene_info(exons: DataFrame, segs: DataFrame) -> DataFrame:
    """rows (chr, gene, num_isoforms, num_exons, num_split_exons)."""
    raw = exons.groupBy(*GENE).agg(
        F.countDistinct("isoform").alias("num_isoforms"), F.countDistinct("start", "end").alias("num_exons")
    )
    split = segs.groupBy(*GENE).agg(F.count("*").alias("num_split_exons"))
    return raw.join(split, GENE, "left").withColumn("num_split_exons", F.coalesce("num_split_exons", F.lit(0)))


def near_maximal(rows: DataFrame) -> DataFrame:
    """Of regions (chr, gene, path, isoforms, ...), those that some isoform keeps: of its regions the ones within one
    segment of the longest, or, where none has two segments, one alone (the least path)."""
    least = F.coalesce(F.get("path", F.lit(0)), F.lit(-1))
    each = rows.select(*GENE, F.size("path").alias("size"), least.alias("least"), F.explode("isoforms").alias("isoform"))
    tops = each.groupBy(*GENE, "isoform").agg(F.max("size").alias("most"), F.min("least").alias("least"))
    gene = tops.groupBy(*GENE).agg(F.map_from_entries(F.collect_list(F.struct("isoform", F.struct("most", "least")))).alias("tops"))
    kept = F.exists("isoforms", lambda i: F.when(F.col("tops")[i]["most"] > 1, F.size("path") >= F.col("tops")[i]["most"] - 1).otherwise(least == F.col("tops")[i]["least"]))
    # the genes' maps are what is held of a partition; the regions pass by, unsorted
    return rows.join(gene.hint("shuffle_hash"), GENE).where(kept).drop("tops")
