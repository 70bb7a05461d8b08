"""Benchmark decontamination [native]: a positional inverted index over the training texts.

A phrase is `window` consecutive words of a benchmark item (an item of fewer words is one phrase). The index stores
postings (word, key, pos; word: a term's number) of the terms that anchor a phrase: its rarest ones by their count in the corpus. For each
phrase the offset-adjusted list of its rarest term is intersected with those of the next rarest, and what is left with
the lists of all its other terms, read from the texts that still have a candidate. key is a hash of a text, so copies
of a text are indexed once, however many there are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stash

# Fixed value: what separates words, once A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
ANCHORS = 3
#: Rows of a benchmark vocabulary, phrase table or key set up to which it is broadcast; beyond, Spark shuffles.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    """The words of a text; a null text has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), lambda w: w != "")


def text_key(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("a"), F.hash(text, F.octet_length(text)).alias("b"))


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if its rows are few; df must be cheap to count."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def phrases(benchmark: DataFrame, window: int = WINDOW, item: str = "item_id", text: str = "text") -> DataFrame:
    """rows (item, terms): every phrase of every item. Items without words have none; a null id is the id ''."""
    w = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), words(F.col(text)).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window, F.lit(0)) + 1)
    return w.where(F.size("w") > 0).select("item", F.explode(F.transform(starts, lambda s: F.slice("w", s, F.lit(window)))).alias("terms")).distinct()


@dataclass
class Index:
    """phrases (phrase, terms, words): the phrases, numbered, their terms and these terms' numbers; terms (term, word, n): the
    benchmark's terms that the texts have, numbered, with counts; anchors (phrase, rank, word, offset); postings (word, key, pos).
    What grows with the texts holds numbers alone."""

    docs: DataFrame
    phrases: DataFrame
    terms: DataFrame
    anchors: DataFrame
    postings: DataFrame


def build(docs: DataFrame, wanted: DataFrame, anchors: int = ANCHORS, text: str = "text") -> Index:
    """Index docs for the phrases wanted(terms).

    Reads docs twice: counts of the benchmark's terms, then the anchors' postings, which are written to the shared
    folder. Phrases with a term that no text has are left out.
    """
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t")).where("t <> ''")
    each = stash(wanted.select("terms").distinct().withColumn("phrase", F.monotonically_increasing_id()), "numbered")
    vocabulary = stash(each.select(F.explode("terms").alias("term")).distinct().withColumn("word", F.monotonically_increasing_id()), "vocabulary")
    tokens = texts.select(F.explode(words(F.col("t"))).alias("term"))
    counts = tokens.join(small(vocabulary), "term").groupBy("word").agg(F.count("*").alias("n"))
    terms = stash(vocabulary.join(counts, "word"), "terms")
    placed = each.select("phrase", F.posexplode("terms").alias("offset", "term")).join(terms, "term", "left")
    ranked = placed.groupBy("phrase").agg(
        F.min(F.coalesce("n", F.lit(0))).alias("least"),
        F.array_sort(F.collect_list(F.struct("n", "offset", "word"))).alias("r"),
        F.array_sort(F.collect_list(F.struct("offset", "word"))).alias("words"),
    )  # fmt: skip  # a phrase has `window` terms at most
    ranked = stash(ranked.where("least > 0"), "ranked")
    known = stash(each.join(ranked.select("phrase", F.col("words.word").alias("words")), "phrase"), "phrases-known")
    chosen = ranked.select("phrase", F.posexplode(F.slice("r", 1, anchors)).alias("rank", "x"))
    table = stash(chosen.select("phrase", "rank", "x.word", "x.offset"), "anchors")
    at = texts.select(text_key(F.col("t")).alias("key"), F.posexplode(words(F.col("t"))).alias("pos", "term"))
    anchored = terms.join(table.select("word").distinct(), "word").select("term", "word")
    kept = at.join(small(anchored), "term").select("word", "key", "pos").distinct()
    return Index(docs, known, terms, table, stash(kept, "postings"))


def candidates(index: Index, anchors: int = ANCHORS) -> DataFrame:
    """rows (phrase, key, start): places where a phrase's anchors stand at their offsets, from the rarest on."""
    of = lambda rank: index.anchors.where(F.col("rank") == rank).drop("rank")
    first = of(0).join(index.postings, "word").where("pos >= offset")
    found = first.select("phrase", "key", (F.col("pos") - F.col("offset")).alias("start"))
    for rank in range(1, anchors):
        # phrases of fewer terms have no anchor of this rank and stay
        more = found.join(of(rank), "phrase", "left").withColumn("pos", F.col("start") + F.col("offset"))
        hit = more.where("word is not null").join(index.postings, ["word", "key", "pos"], "left_semi")
        found = hit.select("phrase", "key", "start").union(more.where("word is null").select("phrase", "key", "start"))
    return found


def occurrences(index: Index, anchors: int = ANCHORS, text: str = "text") -> DataFrame:
    """rows (phrase, key, start, size): every occurrence of every phrase, once for each distinct text, and the phrase's terms."""
    found = stash(candidates(index, anchors), "candidates")
    texts = index.docs.select(F.coalesce(F.col(text), F.lit("")).alias("t")).where("t <> ''")
    keyed = texts.withColumn("key", text_key(F.col("t")))
    left = keyed.join(small(found.select("key").distinct()), "key", "left_semi")
    lists = (
        left.select("key", F.posexplode(words(F.col("t"))).alias("pos", "term"))
        .join(small(index.terms.select("term", "word")), "term")
        .select("key", "pos", "word")
        .distinct()
    )
    laid = found.join(small(index.phrases.select("phrase", "words")), "phrase")
    asked = laid.select("phrase", "key", "start", F.size("words").alias("size"), F.posexplode("words").alias("offset", "word"))
    asked = asked.withColumn("pos", F.col("start") + F.col("offset")).drop("offset")
    met = asked.join(lists, ["key", "pos", "word"], "left_semi").groupBy("phrase", "key", "start", "size")
    return met.agg(F.count("*").alias("n")).where("n = size").drop("n")


def phrase_matches(index: Index, anchors: int = ANCHORS, text: str = "text") -> DataFrame:
    """rows (terms, key, start): every occurrence of every phrase, once for each distinct text."""
    found = occurrences(index, anchors, text).join(small(index.phrases.select("phrase", "terms")), "phrase")
    return found.select("terms", "key", "start")


def near_matches(index: Index, slack: int = 3) -> DataFrame:
    """Proximity: rows (terms, key, start) where a phrase's two rarest terms stand at most `slack` words further from
    or nearer to each other than in the phrase. Positions meet by blocks of slack + 1, not all by all."""
    side = lambda rank: (
        index.anchors.where(F.col("rank") == rank).drop("rank").join(index.postings, "word").select(
            "phrase", "key", (F.col("pos") - F.col("offset")).alias(f"s{rank}"))
    )
    block = lambda c: F.floor(F.col(c) / (slack + 1))
    a = side(0).withColumn("block", F.explode(F.array(block("s0") - 1, block("s0"), block("s0") + 1)))
    b = side(1).withColumn("block", block("s1"))
    met = a.join(b, ["phrase", "key", "block"]).where(F.abs(F.col("s0") - F.col("s1")) <= slack)
    met = met.select("phrase", "key", F.col("s0").alias("start")).distinct()
    return met.join(index.phrases, "phrase").select("terms", "key", "start")


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    anchors: int = ANCHORS,
    share: int = 20,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """docs with n_words, n_hit (words inside any occurrence of a phrase), items (ids of the items that occur, sorted
    as strings) and contaminated (n_hit > 0 and share * n_hit >= n_words).

    Every row of docs stays, repeated ones too. Null and empty texts have no words and are clean. An empty benchmark
    makes all clean. Input columns named like the results are replaced.
    """
    wanted = stash(phrases(benchmark, window), "phrases")
    index = build(docs, wanted, anchors, text)
    met = stash(occurrences(index, anchors, text), "matches")
    hit = (
        met.select("key", F.explode(F.expr("sequence(start, start + size - 1)")).alias("pos"))
        .distinct()
        .groupBy("key")
        .agg(F.count("*").alias("n_hit"))
    )
    items = stash(wanted.join(index.phrases.select("phrase", "terms"), "terms").select("phrase", "item"), "items")
    named = (
        met.select("key", "phrase").distinct().join(items, "phrase").select("key", "item").distinct()
        .groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    )
    found = hit.join(named, "key").withColumnRenamed("key", "text_key")
    row = F.struct(*[c for c in docs.columns if c not in ("n_words", "n_hit", "items", "contaminated")])
    body = F.coalesce(F.col(text), F.lit(""))
    every = docs.select(
        row.alias("row"), F.size(words(body)).cast("long").alias("n_words"), text_key(body).alias("text_key")
    )
    return every.join(small(stash(found, "found")), "text_key", "left").select(
        "row.*",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.expr(f"coalesce(n_hit, 0) > 0 and {share}L * n_hit >= n_words").alias("contaminated"),
    )
