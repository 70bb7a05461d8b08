"""Host rules and collocations against brute force."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from spliceframe.llm import collocations, host_rules, queries

SPACES = r"[\x20\x09-\x0D]+"

# ---------------------------------------------------------------- host rules


def brute_counts(text):
    words = [w for w in re.split(SPACES, text or "") if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines), dup, len(covered)


def brute_rejected(rows):
    """rows (host, counts) -> hosts whose shrunk rate of some rule is a half or more."""
    fails = [
        lambda c: c[0] < 50,
        lambda c: 100 * c[5] > 50 * c[0],
        lambda c: 100 * c[2] > 10 * c[0],
        lambda c: 100 * c[4] > 30 * c[3],
    ]
    out = set()
    for rule in fails:
        n, f = collections.Counter(), collections.Counter()
        for host, c in rows:
            if host is not None:
                n[host] += 1
                f[host] += rule(c)
        if not n:
            return out
        every, mean = sum(n.values()), sum(f.values()) / sum(n.values())
        within, spare = mean * (1 - mean), len(n) - 1
        room = within * (every - sum(x * x for x in n.values()) / every - spare)
        spread = sum(n[h] * (f[h] / n[h] - mean) ** 2 for h in n)
        alike = (spread - within * spare) / room if room > 0 else 0
        strength = 1e6 if alike <= 1 / (1e6 + 1) else max(1.0, 1 / alike - 1)
        out |= {h for h in n if round((f[h] + mean * strength) / (n[h] + strength), 9) >= 0.5}
    return out


ODD = ["a b a b a b a b", " a\x0bb\tc\rd \x0c e", "x y z w \x1c q \x85 r", "same\nsame\n \nsame \nother", "#*$%&|<> é#", "日本 語\n日本 語", "w"]


def test_host_rules(spark, docs, corpus, empty):
    r = random.Random(4)
    extra = [(1000 + i, x, "en", "odd", *corpus[0][4:]) for i, x in enumerate(ODD)]
    good = " ".join(f"w{i}" for i in range(80))
    extra += [(2000 + i, good if r.random() < 0.2 else "too few", None, "bad.example", *corpus[0][4:]) for i in range(40)]
    extra += [(3000 + i, f"{good} {i}", None, "good.example", *corpus[0][4:]) for i in range(40)]
    extra += [(4000, "too few", None, "small.example", *corpus[0][4:])]
    rows = [*corpus, *extra]
    df = docs.union(spark.createDataFrame(extra, docs.schema))
    got = host_rules.judge(df, F.col("source"))
    counted = [(c[3], brute_counts(c[1])) for c in rows]
    rejected = brute_rejected(counted)
    assert "bad.example" in rejected and "good.example" not in rejected
    want = collections.Counter()
    for c, (host, k) in zip(rows, counted, strict=True):
        failed = k[0] < 50 or 100 * k[5] > 50 * k[0]
        want[(c[0], host, *k, failed, host in rejected, not failed and host not in rejected)] += 1
    assert collections.Counter(map(tuple, got.collect())) == want
    assert host_rules.judge(empty, F.col("source")).count() == 0


def test_shrinkage(spark):
    """A host of one failing document follows the others; with a shuffle the verdicts are the same."""
    rows = [(i, f"h{i % 10}", *([100, 1, 0, 1, 0, 0] if i % 11 else [3, 1, 0, 1, 0, 0])) for i in range(400)] + [(900, "once", 3, 1, 0, 1, 0, 0)]
    counts = spark.createDataFrame(rows, f"key long, host string, {host_rules.COUNTS}")
    rates = {r.host: r for r in host_rules.host_rates(counts).collect()}
    assert rates["once"].few_words < 0.5 and not rates["once"].rejected


def test_rejected_hosts_by_shuffle(spark, monkeypatch):
    good = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(i, "few" if i % 4 == 0 and i % 8 else f"{good} {i}", f"s{i % 4}") for i in range(300)] + [(i, "few", "s9") for i in range(60)] + [(5000, good, "s9")], "doc_id long, text string, source string")
    one = host_rules.judge(docs, F.col("source"))
    assert {r.source for r in one.where("host_rejected").withColumnRenamed("host", "source").collect()} == {"s9"}
    assert one.where("doc_id = 5000 and not kept and not base_failed").count() == 1
    monkeypatch.setattr(host_rules, "BROADCAST_HOSTS", 0)
    two = host_rules.judge(docs, F.col("source")).select(one.columns)
    assert collections.Counter(map(tuple, one.collect())) == collections.Counter(map(tuple, two.collect()))


def test_host_of(spark):
    urls = {
        "http://www.Example.com/a?x=1": "example.com",
        "https://u:p@m.test.org:8080#top": "m.test.org",
        "no url": None,
        "mailto:x": None,
        None: None,
    }
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r.url: r.h for r in df.select("url", host_rules.host_of(F.col("url")).alias("h")).collect()} == urls


# ---------------------------------------------------------------- collocations


def brute_phrases(rows, least, top, percent=100):
    grams, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for m in range(1, 6):
                for s in range(len(w) - m + 1):
                    grams[lang, tuple(w[s : s + m])] += 1
    f = {k: v for k, v in grams.items() if v >= least}
    out = collections.defaultdict(list)
    for (lang, w), a in f.items():
        inside = any(
            x[s : s + len(w)] == w and 100 * v >= percent * a
            for (g, x), v in f.items()
            if g == lang and len(x) > len(w)
            for s in range(len(x) - len(w) + 1)
        )
        if len(w) > 1 and not inside:
            cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted(
        (lang, i + 1, p.decode(), -a, left, r, n[lang], -score)
        for lang, found in out.items()
        for i, (score, a, p, left, r) in enumerate(sorted(found)[:top])
    )


def phrases_corpus():
    r = random.Random(5)
    base = "the Of new york city, in. new\tyork  times; a a a a é\x0bÜber:w".split(" ")
    rows = []
    for i in range(120):
        text = " ".join(r.choice(base) for _ in range(r.randrange(0, 60)))
        rows.append((r.choice(["en", "fr", "", None, "und"]), text))
    rows += [("en", "one and only phrase of five words here")] * 9
    return [*rows, ("en", None), (None, ""), ("fr", " \t\n"), ("x", "..,,"), ("z", "dies " * 400), ("z", "ſ K" * 9)]


@pytest.mark.parametrize("chunk, cut", [(1 << 20, 1 << 18), (50, 7)])
def test_collocations(spark, monkeypatch, chunk, cut):
    """Whole batches and chunks of a few words, whose phrases reach over, give the same."""
    rows = phrases_corpus()
    docs = spark.createDataFrame(rows, "lang string, text string").withColumn("n", F.lit("x")).withColumn("phrase", F.lit(1))
    monkeypatch.setattr(collocations, "CHUNK", chunk)
    monkeypatch.setattr(collocations, "SLICE", cut)
    monkeypatch.setattr(collocations, "HELD", chunk)
    got = collocations.mine(docs.repartition(3), least=8, top=15)
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, 8, 15)
    loose = collocations.mine(docs, least=8, top=15, percent=60)
    assert sorted(map(tuple, loose.collect())) == brute_phrases(rows, 8, 15, 60)


def test_collocations_edges(spark, empty):
    assert collocations.mine(empty).count() == 0
    none = spark.createDataFrame([(None, None), ("en", ""), ("en", "few words")], "lang string, text string")
    assert collocations.mine(none).count() == 0
    with pytest.raises(ValueError, match="least"):
        collocations.frequent(none, least=300)


def test_sketch_overestimates(spark, monkeypatch):
    """A sketch that is far too narrow lets more through, and the counts are the same."""
    rows = phrases_corpus()
    docs = spark.createDataFrame(rows, "lang string, text string")
    wide = sorted(map(tuple, collocations.frequent(docs, least=8).collect()))
    monkeypatch.setattr(collocations, "MIN_BITS", 3)
    monkeypatch.setattr(collocations, "MAX_BITS", 3)
    monkeypatch.setattr(collocations, "BLOCK_BITS", 3)
    assert sorted(map(tuple, collocations.frequent(docs, least=8).collect())) == wide


def test_large_products(spark):
    """Products beyond 64 bits are exact."""
    n, a, left, r = 9 * 10**13, 7 * 10**11 + 1, 8 * 10**11 + 3, 9 * 10**11 + 7
    counts = spark.createDataFrame([("en", "", n), ("en", "x", left), ("en", "y", r), ("en", "x y", a)], "lang string, phrase string, n long")
    got = collocations.scored(counts).first()
    assert got.score == 1000 * a * n // (left * r)


def test_queries_run(spark):
    got = queries.op11_host_rules(spark, "/root/testdata/sf0.001")
    assert got.count() == 200 and dict(got.dtypes)["kept"] == "boolean"
    assert dict(queries.op12_collocations(spark, "/root/testdata/sf0.001").dtypes)["score"] == "bigint"
