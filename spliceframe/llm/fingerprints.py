"""Document fingerprints by Order MinHash [native].

Tokens are runs of at most 16 characters without white space; a k-mer is k consecutive tokens, numbered by its
occurrence in the text, and hashed to 34 bits with that number. The hash space is cut into `bins`; of each bin that has
a k-mer, the l minimal k-mers from the bin's start on are put into text order and hashed as a tuple (where a bin has
fewer than l, the next bins give the rest, and after the last the first ones). So a bin agrees when both texts hold the
same k-mers in the same order, which follows edit distance, not just the set of k-mers; only a text of fewer than l
k-mers has shorter tuples. One pass of hashing serves all bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, runs

K, L, BINS = 3, 2, 64
PLACE_BITS = 30  # a text has fewer than 2**30 tokens, as a string has fewer than 2**31 bytes
PLACE = (1 << PLACE_BITS) - 1
TOKEN = r"\S{1,16}"


def with_place(hashed: Column, place: Column) -> Column:
    return hashed.bitwiseAND(F.lit(~PLACE).cast("long")).bitwiseOR(place.cast("long"))


def occurrences(ordered: Column) -> Column:
    """Of sorted (hash, place) longs, how many equal hashes stand before each."""
    high = F.transform(ordered, lambda x: F.shiftright(x, PLACE_BITS))
    return let(
        high,
        lambda hs: let(
            runs(hs),
            lambda ss: F.flatten(
                F.transform(
                    ss, lambda s, j: F.sequence(F.lit(0), F.coalesce(F.get(ss, j + 1), F.size(hs)) - s - 1)
                )
            ),
        ),
    )


def signature(text: Column, k: int = K, l: int = L, bins: int = BINS) -> Column:  # noqa: E741
    """array<long>: for each bin that isn't empty, bin << 32 | 32-bit hash of its tuple. bins: a power of two."""
    low = F.lit(PLACE).cast("long")
    shift = 64 - (bins.bit_length() - 1)
    bin_of = lambda x: F.shiftright(x, shift)

    def tuples(chosen: Column, grams: Column) -> Column:
        round_ = F.concat(chosen, F.slice(chosen, 1, F.least(F.size(chosen), F.lit(l)) - 1))
        starts = let(F.transform(chosen, bin_of), runs)
        one = lambda s, ring: let(
            F.sort_array(F.transform(F.slice(ring, s + 1, F.lit(l)), lambda x: x.bitwiseAND(low))),
            lambda ps: F.shiftleft(bin_of(F.get(ring, s)) + bins // 2, 32).bitwiseOR(
                F.aggregate(ps, F.lit(42).cast("long"), lambda acc, p: F.xxhash64(acc, F.get(grams, p.cast("int"))))
                .bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
            ),
        )
        return let(round_, lambda ring: F.transform(starts, lambda s: one(s, ring)))

    def chosen_of(grams: Column) -> Column:
        ordered = F.sort_array(F.transform(grams, with_place))
        numbered = lambda xs: let(
            occurrences(xs),
            lambda ns: F.transform(
                xs, lambda x, i: with_place(F.xxhash64(F.shiftright(x, PLACE_BITS), F.get(ns, i)), x.bitwiseAND(low))
            ),
        )
        least = lambda ys: F.filter(ys, lambda x, i: (i < l) | (bin_of(F.get(ys, i - l)) != bin_of(x)))
        return let(ordered, lambda xs: let(F.sort_array(numbered(xs)), least))

    def grams_of(tokens: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(tokens) - k, F.lit(0))),
            lambda i: F.xxhash64(*[F.get(tokens, i + j) for j in range(k)]),
        )

    hashed = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t))
    whole = let(hashed, lambda ts: let(grams_of(ts), lambda gs: let(chosen_of(gs), lambda cs: tuples(cs, gs))))
    return F.when(text.rlike(r"\S"), whole).otherwise(F.array().cast("array<long>"))


def likeness(a: Column, b: Column) -> Column:
    """Share of the bins that aren't empty in both and agree; 1 for two signatures without bins."""
    bins = lambda s: F.transform(s, lambda x: F.shiftright(x, 32))
    filled = F.size(F.array_union(bins(a), bins(b)))
    return F.when(filled == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / filled)


def written(sig: Column) -> Column:
    """A signature as text: for each bin, its number and its hash in hexadecimal."""
    return F.array_join(F.transform(sig, lambda x: F.lower(F.lpad(F.hex(x), 10, "0"))), "")


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", rows_per_range: int = 2000) -> DataFrame:
    """rows (key, text, signature, next_text, next_signature): next is the next lower key; after the least key comes
    the greatest. Signatures are made before rows are dealt, once for each row.

    Keys are cut into ranges at quantiles (4,096 at most), so no task orders all rows; the first row of each range is
    also sent to the range above, as what follows its last. Equal keys go by a hash of their texts; a null key is the
    least. Null texts are empty.
    """
    rows = fingerprints(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "key").withColumn(
        "ord", F.coalesce(F.col("key").cast("long"), F.lit(-(2**63)).cast("long"))
    )
    n = min(4095, max(1, docs.count() // rows_per_range))
    cuts = rows.select("ord").agg(F.percentile_approx("ord", [i / (n + 1) for i in range(1, n + 1)], 20 * n)).first()[0]
    cuts = sorted(set(cuts or []))
    table = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<long>") if cuts else F.array().cast("array<long>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(12))])
    below = F.aggregate(
        steps,
        F.lit(0),
        lambda at, s: F.when(
            (at + s <= len(cuts)) & (F.get(table, at + s - 1) < F.col("ord")), at + s
        ).otherwise(at),
    )
    rows = rows.withColumn("range", below)
    up = Window.orderBy("range")
    heads = rows.groupBy("range").agg(F.max("ord").alias("head"))  # 4,096 rows at most
    heads = heads.select("head", F.coalesce(F.lead("range").over(up), F.min("range").over(Window.partitionBy())).alias("to"))
    sent = rows.join(F.broadcast(heads), rows["ord"] == heads["head"], "left").select(
        "key",
        "text",
        "signature",
        "ord",
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.col("range").alias("range"), F.lit(0).alias("copy")),
                    F.struct(F.col("to").alias("range"), F.lit(1).alias("copy")),
                ),
                lambda x: x.range.isNotNull(),
            )
        ).alias("at"),
    )
    order = Window.partitionBy("at.range").orderBy("at.copy", F.desc("ord"), F.xxhash64("text"))
    led = sent.select(
        "*", *[F.lead(c).over(order).alias(f"next_{c}") for c in ("text", "signature")]
    ).where("at.copy = 0")
    return led.select("key", "text", "signature", "next_text", "next_signature")


def edited(text: Column, following: Column) -> Column:
    """text with its last third (floor) of code points replaced by the first as many, or all, of what follows."""
    n = F.char_length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(following, F.lit(1), third))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """rows (key, text, signature) for every row; a null text is empty and has no bins."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias(key), body.alias("text"), signature(body).alias("signature"))
