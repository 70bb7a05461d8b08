"""Column expressions of the analyses; all run in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_contig(name: Column) -> Column:
    """A contig's canonical name where that is a number (chr1 -> 1), else the name as it is."""
    upper = F.upper(name)
    stripped = F.when(upper.contains("CHR"), F.regexp_extract(upper, "CHR(.*)", 1)).otherwise(upper)
    return F.when(stripped.rlike("^[0-9]+$"), stripped).otherwise(name)


def attribute(text: Column, key: str) -> Column:
    """A GTF attribute's value, or null where the key isn't there."""
    return F.nullif(F.regexp_extract(text, f'(?:^|[\\s;]){key} "([^"]*)"', 1), F.lit(""))


def attributes(text: Column) -> Column:
    """All GTF attributes as a map; of a repeated key the last value holds."""
    keys, values = (F.regexp_extract_all(text, F.lit('([A-Za-z0-9_]+) "([^"]*)"'), F.lit(i)) for i in (1, 2))
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def cigar_lengths(cigar: Column) -> Column:
    """Alternating lengths on the reference: block, gap, block ... '*' and null give an empty array.

    M, =, X and D extend a block; N a gap; I, S and H end a gap but are no reference; P is left out.
    """
    ops = F.arrays_zip(
        F.regexp_extract_all(cigar, F.lit("([0-9]+)([MNIDS=XHP])"), F.lit(1)).alias("n"),
        F.regexp_extract_all(cigar, F.lit("([0-9]+)([MNIDS=XHP])"), F.lit(2)).alias("op"),
    )
    start = F.struct(
        F.lit(0).alias("open"), F.lit(True).alias("block"), F.array().cast("array<int>").alias("done")
    )

    def step(acc: Column, x: Column) -> Column:
        n, op = x["n"].cast("int"), x["op"]
        extends, gap = op.isin("M", "=", "X", "D"), op == "N"
        turn = F.when(gap, acc["block"]).otherwise((extends | op.isin("I", "S", "H")) & ~acc["block"])
        return F.struct(
            (F.when(turn, 0).otherwise(acc["open"]) + F.when(extends | gap, n).otherwise(0)).alias("open"),
            F.when(gap, False).when(extends, True).otherwise(acc["block"]).alias("block"),
            F.when(turn, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"),
        )

    def finish(acc: Column) -> Column:
        return F.filter(F.concat(acc["done"], F.array(acc["open"])), lambda x: x != 0)

    known = F.coalesce(cigar, F.lit("*"))
    # blocks and single gaps alone: the lengths as they stand
    plain = F.transform(F.filter(F.split(F.translate(known, "MN", ",,"), ","), lambda x: x != ""), lambda x: x.cast("int"))
    return (
        F.when(known == "*", F.array().cast("array<int>"))
        .when(known.rlike("^[0-9]+M([0-9]+N[0-9]+M)*$"), F.filter(plain, lambda x: x != 0))
        .otherwise(F.aggregate(ops, start, step, finish))
    )


def mapped_length(lengths: Column) -> Column:
    """Reference bases in blocks: the lengths at even places."""
    even = F.filter(lengths, lambda x, i: i % 2 == 0)
    return F.aggregate(even, F.lit(0), lambda a, x: a + x)


def blocks(lengths: Column, pos: Column) -> Column:
    """Closed intervals (s, e) of the blocks, from 1-based pos."""
    start = F.struct(pos.cast("long").alias("at"), F.lit(0).alias("i"), F.array().cast("array<struct<s:bigint,e:bigint>>").alias("out"))
    return F.aggregate(
        lengths,
        start,
        lambda acc, n: F.struct(
            (acc["at"] + n).alias("at"),
            (acc["i"] + 1).alias("i"),
            F.when(
                acc["i"] % 2 == 0,
                F.concat(acc["out"], F.array(F.struct(acc["at"].alias("s"), (acc["at"] + n - 1).alias("e")))),
            ).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: acc["out"],
    )


def query_length(cigar: Column) -> Column:
    """Bases of the read that a CIGAR consumes."""
    found = F.regexp_extract_all(cigar, F.lit("([0-9]+)[MIS=X]"), F.lit(1))
    return F.aggregate(found, F.lit(0), lambda a, x: a + x.cast("int"))


def passes_flags(flag: Column, mapq: Column, policy: str = "best", mask: int = 2820) -> Column:
    """Reads with none of the mask's flags; unique_only also asks for a mapping quality of 10."""
    if policy not in ("best", "unique_only"):
        raise ValueError(f"read_filter must be best or unique_only, not {policy}")
    keep = flag.bitwiseAND(F.lit(mask)) == 0
    return keep & (mapq >= 10) if policy == "unique_only" else keep


def overlap_length(a_start: Column, a_end: Column, a_len: Column, b_start: Column, b_end: Column) -> Column:
    """Length shared by two closed intervals, of which a may have holes; negative where they stand apart."""
    span = F.greatest(a_end, b_end) - F.least(a_start, b_start) + 1
    return a_len + (b_end - b_start + 1) - span


def region_type(n_segments: Column, n_joined: Column | None = None) -> Column:
    """Kind of a sub-path of n_segments pieces, of which n_joined share a border point (0 after a disjoint split)."""
    joined = F.lit(0) if n_joined is None else n_joined
    dashes = n_segments - joined - 1
    return (
        F.when((n_segments == 1), "one_exon")
        .when((dashes == 0) & (n_segments == 2), "two_exons")
        .when(dashes == 1, "one_junction")
        .when(dashes == 0, "exons")
        .otherwise("junctions")
    )


def region_effective_length(kind: Column, length: Column, inner: Column, read_length: Column, least_junction: Column) -> Column:
    """Places where a short read can fall into a region, one at least."""
    single = F.when(read_length < length, length - read_length + 1).otherwise(1)
    value = (
        F.when(kind == "one_junction", read_length - least_junction)
        .when(kind == "two_exons", read_length - 1)
        .when(kind == "one_exon", single)
        .when(kind == "exons", read_length - inner - 1)
        .otherwise(read_length - inner - least_junction)
    )
    return F.greatest(F.lit(1), value)


def region_is_valid(kind: Column, length: Column, first: Column, last: Column, inner: Column, read_length: int, least_junction: int) -> Column:
    """Whether a read of read_length can show the region (the read_length selection)."""
    flanks = (first > least_junction) & (last > least_junction)
    spans = inner + 2 * least_junction <= read_length
    return (length > read_length) & (
        kind.isin("one_exon", "two_exons")
        | ((kind == "one_junction") & flanks)
        | ((kind == "exons") & (inner + 3 <= read_length))
        | ((kind == "junctions") & flanks & spans)
    )


def inner_weight(inner: Column, read_length: Column) -> Column:
    """(RL - inner - 1) / RL, or 1 where that isn't in (0, 1]."""
    w = (read_length - inner - 1) / read_length
    return F.when((w <= 0) | (w > 1), 1.0).otherwise(w)


def safe_divide(a: Column, b: Column) -> Column:
    return a / F.when(b == 0, 1).otherwise(b)


def zero_below(x: Column, floor: float = 1e-100) -> Column:
    """x, with what is below floor, infinite or not a number as 0."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")) | (x < floor), 0.0).otherwise(x)


def divide_or_infinity(a: Column, b: Column) -> Column:
    return F.when(b == 0, float("inf")).otherwise(a / F.when(b == 0, 1).otherwise(b))


def fragment_weight(length: Column, mean: Column, std: Column, effective: Column) -> Column:
    """Likelihood of a fragment length on an isoform; its constant cancels in the E-step."""
    return 1 / (std * math.sqrt(math.pi)) * F.exp(-0.5 * F.pow((length - mean) / std, 2)) / effective


def effective_length(length: Column, mean: Column, std: Column) -> Column:
    """Mean number of places of a fragment on an isoform: L - E[j | j <= L] + 1 under a normal law; 1 for isoforms far
    below the mean, and at least 1."""
    density = lambda j: F.exp(-0.5 * F.pow((j - mean) / std, 2))
    sums = F.aggregate(
        F.sequence(F.lit(1), length),
        F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("jn")),
        lambda acc, j: F.struct((acc["n"] + density(j)).alias("n"), (acc["jn"] + j * density(j)).alias("jn")),
        lambda acc: acc["jn"] / acc["n"],
    )
    value = F.greatest(F.lit(1.0), length - sums + 1)
    return F.when(length < mean - 5 * std, 1.0).otherwise(value)


def conditional_probability(form: str, pdf: Column, cdf: Column, sm: Column, isoform_length: Column, read_length: Column, floor: float = 1e-100) -> Column:
    """P(read | isoform) of a long read; what isn't a positive number is 0."""
    by_form = {
        "form_1": pdf / F.when(cdf == 0, 1).otherwise(cdf) / F.when(sm == 0, 1).otherwise(sm),
        "form_2": pdf / F.when(cdf == 0, 1).otherwise(cdf),
        "no_read_length": F.lit(1.0),
        "no_isoform_specific": pdf,
    }
    if form not in by_form:
        raise ValueError(f"cond_prob must be one of {', '.join(by_form)}, not {form}")
    p = F.when((cdf == 0) | (sm == 0), pdf).otherwise(by_form[form])
    places = isoform_length - read_length + 1
    p = F.when(places == 0, 0.0).otherwise(p / F.when(places == 0, 1).otherwise(places))
    return F.when(p <= floor, 0.0).otherwise(zero_below(p, floor))


def best_gene_fold(candidates: Column) -> Column:
    """Genes a read goes to, from array<struct(gene, overlap, length, ...)>: in the order of genes, a candidate within 2
    of the held overlap ties (within 2 of its length), or wins if shorter; any other wins if it overlaps more. The held
    values move with each accepted candidate."""
    first = F.array_sort(candidates)
    start = F.struct(F.lit(0).cast("long").alias("o"), F.lit(1).cast("long").alias("l"), F.slice(first, 1, 0).alias("p"))
    took = lambda x, p: F.struct(x["overlap"].cast("long").alias("o"), x["length"].cast("long").alias("l"), p.alias("p"))

    def step(acc: Column, x: Column) -> Column:
        near = F.abs(x["overlap"] - acc["o"]) <= 2
        tie = near & (F.abs(x["length"] - acc["l"]) <= 2)
        wins = (near & (x["length"] < acc["l"])) | (~near & (x["overlap"] > acc["o"]))
        return F.when(tie, took(x, F.concat(acc["p"], F.array(x)))).when(wins, took(x, F.array(x))).otherwise(acc)

    return F.aggregate(first, start, step, lambda acc: acc["p"])


def path_text(path: Column) -> Column:
    """A segment path as text in which a contiguous slice is a substring: ',0,1,5,'."""
    return F.concat(F.lit(","), F.array_join(path.cast("array<string>"), ","), F.lit(","))


def region_name(path: Column) -> Column:
    """P0:P1-P4:P5: the points of a path's segments, two for each segment."""
    return F.array_join(
        F.transform(path, lambda i: F.concat(F.lit("P"), 2 * i, F.lit(":P"), 2 * i + 1)), "-"
    )


def reverse_complement(sequence: Column) -> Column:
    return F.reverse(F.translate(sequence, "GATCgatc", "CTAGctag"))
