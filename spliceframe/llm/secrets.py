"""Secret scans [native]: fixed patterns, and character Markov models compared by log-likelihood ratio.

Two first-order Markov chains over one alphabet (one of random strings, one of ordinary identifiers) are trained from
labelled samples. A candidate run of 20 or more token characters is a `markov` span if the mean log-likelihood ratio of
its transitions is at least `margin`, and it overlaps no span of the patterns.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let

# The patterns and their least lengths.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 8
# A run is as long as it can be, so asking for the least length in the pattern keeps the same matches.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIDE = len(ALPHABET) + 1  # index 0: the edge of a token
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"


@dataclass(frozen=True)
class MarkovModel:
    """ratios[SIDE * a + b]: log P(b after a | random) - log P(b after a | ordinary); `margin` is per character."""

    ratios: tuple[float, ...]
    margin: float = 0.35


def samples(spark: SparkSession, n: int = 8000) -> DataFrame:
    """Labelled samples made by rule: (text, label), label 1 for random strings, 0 for what is ordinary: identifiers,
    compounds, paths, dates, and runs of one or two characters, as in rules and tables."""
    words = F.array(*map(F.lit, (
        "get set user name list order item count page index file path read write load save open close data table "
        "column value node graph tree parse token render update delete create find search filter group sort merge "
        "split join build test config option model layer batch size time date start stop error message request "
        "response client server local remote cache store queue event handler view action state context format "
        "string number array object result total average point line color image the and with for from that this "
        "ation tion ing ent er re es on an in ver lich keit ung sch ment eau elle ción mente ado "
        "bundes land wirt schaft haus halt kranken gesundheits gesetz gericht arbeit zeit auf gaben fleisch rind "
        "etikett ierung wach ungs fahrt dampf schiff gesell versicherung recht straf verfahren www http html index"
    ).split()))
    number = lambda k, most: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(most))
    w = lambda k: F.element_at(words, (number(k, len(ALPHABET) ** 2) % F.size(words) + 1).cast("int"))
    a = lambda k: F.substring(F.lit("-=_+/" * 8 + ALPHABET), (number(k, 40 + len(ALPHABET)) + 1).cast("int"), F.lit(1))  # noqa: E731, E501
    digits = number("n", 2100).cast("string")
    day = F.date_add(F.lit("1990-01-01").cast("date"), number("day", 15000).cast("int"))
    clock = F.format_string("%02d-%02d-%02d", number("h", 24), number("m", 60), number("s", 60))
    long = (number("long", 40) + 20).cast("int")
    plain = F.element_at(
        F.array(
            F.concat_ws("_", w(1), w(2), w(3), w(4)),
            F.concat(w(1), F.initcap(w(2)), F.initcap(w(3)), F.initcap(w(4)), F.initcap(w(5))),
            F.concat_ws("-", w(1), w(2), w(3), digits),
            F.concat_ws("/", w(1), w(2), w(3), w(4)),
            F.upper(F.concat_ws("_", w(1), w(2), w(3), w(4))),
            F.concat(w(1), w(2), w(3), w(4), w(5), w(6)),
            F.initcap(F.concat(w(1), w(2), w(3), w(4))),
            F.concat_ws("/", w(1), digits, F.date_format(day, "MM/dd"), F.concat_ws("-", w(2), w(3), w(4))),
            F.concat(day.cast("string"), F.when(number("t", 2) == 0, F.concat(F.lit("T"), clock)).otherwise(F.concat(F.lit("/"), F.date_add(day, 30).cast("string")))),
            F.concat(digits, digits, digits, digits, digits, digits),
            F.repeat(a("x"), long),
            F.repeat(F.concat(a("x"), a("y")), long),
            F.concat(F.repeat(a("x"), long), w(1), F.repeat(a("x"), long)),
        ),
        (number("form", 13) + 1).cast("int"),
    )
    ids = spark.range(n)
    key = F.sha2(F.col("id").cast("string"), 256)
    code = F.base64(F.unhex(key))
    form = F.col("id") % 4
    secret = F.when(form == 0, F.substring(key, 1, 31)).when(form == 1, F.translate(code, "+/=", "-_")).otherwise(code)
    return ids.select(plain.alias("text"), F.lit(0).alias("label")).union(
        ids.select(secret.alias("text"), F.lit(1).alias("label"))
    )


def indexes(text: Column) -> Column:
    """A token's characters as alphabet indexes, with the edge (0) before and after."""
    chars = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return F.concat(F.array(F.lit(0)), chars, F.array(F.lit(0)))


def train(labelled: DataFrame, margin: float = 0.35, smoothing: float = 0.5) -> MarkovModel:
    """Fit both chains on rows (text, label); at most 2 * SIDE**2 counts reach the driver."""
    pairs = (
        labelled.where("text is not null and label is not null")
        .select("label", indexes(F.col("text")).alias("x"))
        .select("label", F.explode(F.arrays_zip(F.slice("x", 1, F.size("x") - 1).alias("a"), F.slice("x", 2, F.size("x") - 1).alias("b"))).alias("p"))
        .groupBy("label", "p.a", "p.b")
        .count()
        .collect()
    )
    seen = {0: [smoothing] * SIDE**2, 1: [smoothing] * SIDE**2}
    for label, a, b, n in pairs:
        seen[label][SIDE * a + b] += n
    logs = {}
    for label, c in seen.items():
        rows = [sum(c[SIDE * a : SIDE * (a + 1)]) for a in range(SIDE)]
        logs[label] = [math.log(v / rows[i // SIDE]) for i, v in enumerate(c)]
    return MarkovModel(tuple(round(r - o, 6) for r, o in zip(logs[1], logs[0], strict=True)), margin)


def prefix_sums(lengths: Column, chunk: int = 128) -> Column:
    """Sums of what comes before each element; in chunks, so that long arrays don't cost their square."""
    scan = lambda xs, first: F.aggregate(
        xs,
        F.struct(first.alias("sum"), F.array().cast("array<bigint>").alias("out")),
        lambda acc, x: F.struct((acc.sum + x).alias("sum"), F.concat(acc.out, F.array(acc.sum)).alias("out")),
        lambda acc: acc.out,
    )

    def in_chunks(xs: Column) -> Column:
        parts = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / chunk).cast("int")),
            lambda i: F.slice(xs, i * chunk + 1, F.lit(chunk)),
        )
        zero = F.lit(0).cast("bigint")
        return let(
            parts,
            lambda ps: let(
                scan(F.transform(ps, lambda p: F.aggregate(p, zero, lambda a, x: a + x)), zero),
                lambda firsts: F.flatten(F.transform(ps, lambda p, i: scan(p, F.get(firsts, i)))),
            ),
        )

    empty = F.array().cast("array<bigint>")
    return let(lengths.cast("array<bigint>"), lambda xs: F.when(F.size(xs) == 0, empty).otherwise(in_chunks(xs)))


def spans(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches, in order: array of (start, end, match), in code points, end exclusive.

    Spark gives matches without places; what split() leaves between them gives the places.
    """
    kind = "array<struct<start:bigint,end:bigint,match:string>>"

    def placed(ms: Column, gaps: Column) -> Column:
        lengths = F.transform(ms, lambda m, i: F.char_length(m) + F.char_length(F.get(gaps, i)))
        return let(
            prefix_sums(lengths),
            lambda before: F.transform(
                ms,
                lambda m, i: F.struct(
                    (F.get(before, i) + F.char_length(F.get(gaps, i))).alias("start"),
                    (F.get(before, i) + F.char_length(F.get(gaps, i)) + F.char_length(m)).alias("end"),
                    m.alias("match"),
                ),
            ),
        )

    found = let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda ms: let(F.split(text, pattern, -1), lambda gaps: placed(ms, gaps)),
    )
    return F.when(text.rlike(pattern), found).otherwise(F.array()).cast(kind)


def score(token: Column, model: MarkovModel) -> Column:
    """Mean log-likelihood ratio, random against ordinary, of a token's transitions."""
    table = F.lit(",".join(map(str, model.ratios)))
    table = F.split(table, ",").cast("array<double>")
    return let(
        indexes(token),
        lambda x: F.aggregate(
            F.sequence(F.lit(1), F.size(x) - 1),
            F.lit(0.0),
            lambda acc, i: acc + F.get(table, F.get(x, i - 1) * SIDE + F.get(x, i)),
        )
        / (F.size(x) - 1),
    )


def scan(docs: DataFrame, model: MarkovModel, text: str = "text") -> DataFrame:
    """docs with `secret_spans`: array of (start, rank, end, kind, match), by start, then by kind as listed in KINDS.

    A null text is empty and has no spans. All rows stay; repeated rows get the same spans. An input column named
    secret_spans is replaced.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    ranked = lambda s, rank: F.transform(
        s, lambda m: F.struct(m.start.alias("start"), F.lit(rank).alias("rank"), m.end.alias("end"), F.lit(KINDS[rank]).alias("kind"), m.match.alias("match"))
    )
    assign = F.filter(
        spans(body, ASSIGN), lambda m: F.char_length(F.regexp_extract(m.match, ASSIGN, 2)) >= ASSIGN_LEAST
    )
    base = F.concat(ranked(assign, 0), ranked(spans(body, ACCESS), 1), ranked(spans(body, HEX), 2))
    high = lambda m: score(m.match, model) >= model.margin

    def added(held: Column) -> Column:
        free = lambda m: ~F.exists(held, lambda h: (h.start < m.end) & (m.start < h.end))
        return ranked(F.filter(spans(body, CANDIDATE), lambda m: free(m) & high(m)), 3)

    return docs.withColumn(
        "secret_spans", let(base, lambda held: F.array_sort(F.concat(held, added(held))))
    )
