"""Density weights, global EM and its starts, as-of joins and read statistics, against brute force."""

import collections
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spliceframe import api
from spliceframe.config import KValueSettings, QuantifySettings
from spliceframe.operators import density, em, global_em, intervals, least_squares, mapping, paths, readlen, supported
from spliceframe.plans.scratch import settle
from spliceframe.sources import sinks

REGIONS = "chr string, gene string, path array<int>, isoforms array<string>, n long"

# ---------------------------------------------------------------- density


def brute_density(samples, iso_len, t, h1, h2, reach):
    total = sum(n for _, _, n in samples)
    k = lambda d, h: math.exp(-0.5 * (d / h) ** 2) / (h * math.sqrt(2 * math.pi)) if abs(d) <= reach * h else 0.0
    return sum(n * k(iso_len - a, h1) * k(t - b, h2) for a, b, n in samples) / total


def brute_places(path, length, first, last, inner, t, least):
    """In how many ways t bases lie inside one segment, or span the region with `least` bases on either end."""
    if len(path) == 1:
        return max(0, length - t + 1) if t >= min(least, length) else 0
    low, high = min(first, last), max(first, last)
    if inner + high + least + 1 <= t <= first + last + inner:
        return first + last + inner - t + 1
    if inner + low + least <= t <= inner + high + least:
        return low
    if inner + 2 * least <= t <= inner + low + least - 1:
        return t - 1 - inner
    return 0


SAMPLES = [(300, 120, 5), (300, 40, 2), (200, 130, 9), (500, 1, 3), (290, 0, 4)]


@pytest.fixture(scope="module")
def table(spark):
    samples = spark.createDataFrame(SAMPLES, "iso_len long, read_len long, n long")
    lengths = spark.createDataFrame([(300,), (200,), (210,), (300,), (5000,)], "iso_len long")
    return density.density(samples, lengths, 10.0, 7.5).cache()


def test_density(table):
    got = {(r.iso_len, r.read_len): r.d for r in table.collect()}
    for iso_len in (300, 200, 210, 5000):
        for t in range(1, 200):
            assert got.get((iso_len, t), 0.0) == pytest.approx(brute_density(SAMPLES, iso_len, t, 10.0, 7.5, 4.0), abs=1e-15)
    assert all(t >= 1 for _, t in got) and not any(length == 5000 for length, _ in got)


@pytest.mark.parametrize("least", [1, 4])
def test_region_weights(spark, table, least):
    r = random.Random(3)
    rows = [([0], 100, 100, 100, 0), ([1], 2, 2, 2, 0), ([0, 1], 102, 100, 2, 0), ([0, 2], 130, 60, 70, 0), ([3], 150, 150, 150, 0)]
    for _ in range(12):
        first, last, inner = r.randrange(1, 60), r.randrange(1, 60), r.randrange(0, 90)
        rows.append(([4, 5, 6 + len(rows)], first + last + inner, first, last, inner))
    regions = spark.createDataFrame([("c", "g", *x, ["a", "b", "far"]) for x in rows], "chr string, gene string, path array<int>, len long, first long, last long, inner long, isoforms array<string>")
    lengths = {"a": 300, "b": 210, "far": 5000}
    isoforms = spark.createDataFrame([("c", "g", i, n) for i, n in lengths.items()], "chr string, gene string, isoform string, length long")
    got = {(x.isoform, x.region): x.weight for x in density.region_weights(regions, isoforms, table, least).collect()}
    assert len(got) == 3 * len(rows)
    for path, *sizes in rows:
        for i, n in lengths.items():
            want = sum(brute_places(path, *sizes, t, least) * brute_density(SAMPLES, n, t, 10.0, 7.5, 4.0) for t in range(1, 400))
            assert got[i, ",".join(map(str, path))] == pytest.approx(want, rel=1e-9, abs=1e-12), (path, i)


def gene_tables(spark):
    exons = [("c", "g", "a", "+", 1, 100), ("c", "g", "a", "+", 301, 400), ("c", "g", "a", "+", 601, 700), ("c", "g", "b", "+", 1, 100), ("c", "g", "b", "+", 601, 700)]
    reads = [(f"r{i}", 0, "c", 1 + i % 20, 60, x) for i, x in enumerate(["60M"] * 5 + ["80M200N50M"] * 7 + ["80M500N50M"] * 4)]
    reads = [(n, f, c, p, m, x.replace("80M", f"{101 - p}M")) for n, f, c, p, m, x in reads]
    return (
        spark.createDataFrame(exons, "chr string, gene string, isoform string, strand string, start int, end int"),
        spark.createDataFrame(reads, "name string, flag int, chr string, pos int, mapq int, cigar string"),
    )


def test_density_weights_for_k_values(spark):
    """The weights are taken by k_values, and each isoform's column is their share."""
    exons, reads = gene_tables(spark)
    weights = api.density_weights(spark, exons, reads, 40.0, 30.0)
    got = api.k_values(spark, exons, KValueSettings(full_length_regions="none"), long_reads=reads, weights=weights)
    held = {(r.isoform, r.region): r.weight for r in weights.collect()}
    cells = {(r.isoform, ",".join(map(str, r.path))): r.a for r in got.lr_matrix.collect()}
    for i in "ab":
        own = {k: held[k] for k in cells if k[0] == i}
        for k, v in own.items():
            assert cells[k] == pytest.approx(v / sum(own.values()))


# ---------------------------------------------------------------- as-of joins


def test_as_of_and_brackets(spark):
    r = random.Random(5)
    brackets, points = [], [(None, 5), ("c", None), ("none", 3)]
    for key in "abc":
        at = 0
        for i in range(12):
            start = at + r.randrange(1, 5)
            at = start + r.randrange(0, 6)
            brackets.append((key, start, at, f"{key}{i}"))
        points += [(key, x) for x in range(-2, at + 4) for _ in range(1 + x % 2)]
    b = spark.createDataFrame(brackets, "key string, start long, end long, name string")
    p = spark.createDataFrame(points, "key string, at long")
    got = intervals.bracket_of(p.where("key is not null and at is not null"), b, ["key"], values=["name"])
    inside = lambda key, x: next(((s, e, n) for k, s, e, n in brackets if k == key and s <= x <= e), (None,) * 3)
    want = collections.Counter((k, x, *inside(k, x)) for k, x in points if k and x is not None)
    assert collections.Counter((r.key, r.at, r.start, r.end, r.name) for r in got.collect()) == want
    last = intervals.as_of(p, b.select("key", F.col("start").alias("at"), "name"), ["key"], "at", ["name"])
    for r_ in last.where("at is not null and key is not null").collect():
        before = [(s, n) for k, s, _, n in brackets if k == r_.key and s <= r_.at]
        assert r_.name == (max(before)[1] if before else None)
    assert intervals.bracket_of(p.where("false"), b, ["key"], values=["name"]).count() == 0


# ---------------------------------------------------------------- regions and reads


def random_regions(seed):
    r = random.Random(seed)
    out = {}
    for _ in range(60):
        start = r.randrange(0, 5)
        path = tuple(range(start, start + r.randrange(1, 5)))
        out[f"g{r.randrange(6)}", path] = (tuple(sorted(r.sample("abcd", r.randrange(1, 4)))), r.randrange(0, 5))
    return [("c", g, list(p), list(i), n) for (g, p), (i, n) in out.items()]


def test_near_maximal(spark):
    rows = random_regions(1) + [("c", "single", [k], ["z"], 1) for k in (3, 1, 2)]
    kept = set()
    for gene, iso in {(g, i) for _, g, _, owners, _ in rows for i in owners}:
        own = [p for _, g, p, owners, _ in rows if g == gene and iso in owners]
        most = max(map(len, own))
        kept |= {(gene, tuple(p)) for p in own if len(p) >= most - 1} if most > 1 else {(gene, tuple(min(own)))}
    got = paths.near_maximal(spark.createDataFrame(rows, REGIONS))
    assert {(r.gene, tuple(r.path)) for r in got.collect()} == kept
    assert ("single", (1,)) in kept and ("single", (2,)) not in kept


def test_segment_distances(spark):
    rows = random_regions(2)
    most = collections.defaultdict(int)
    for _, g, p, owners, _ in rows:
        for i in owners:
            most[g, i] = max(most[g, i], len(p))
    want = collections.Counter()
    for _, g, p, owners, n in rows:
        if n:
            want["multi" if len(owners) > 1 else "unique", float(np.median([most[g, i] - len(p) for i in owners]))] += n
    got = supported.segment_distances(spark.createDataFrame(rows, REGIONS))
    assert {(r.kind, r.distance): r.n for r in got.collect()} == dict(want)


def test_best_gene(spark):
    r = random.Random(6)
    genes = [(f"c{i % 2}", f"g{i:02}", s, s + r.randrange(0, 60)) for i, s in enumerate(r.randrange(0, 300) for _ in range(30))] + [("c0", "g99", 500, 520), ("c0", "g98", 500, 520)]
    reads = [(f"r{i}", f"c{i % 3}", r.randrange(0, 340), r.randrange(1, 50)) for i in range(200)] + [("tie", "c0", 505, 5)]
    want, lists = {}, collections.defaultdict(list)
    for name, c, pos, n in reads:
        found = []
        for k, g, s, e in genes:
            if k == c and s < pos + n and e + 1 > pos:
                shared = e - s + 1 + n - (max(pos + n, e) - min(pos, s) + 1)
                if shared > 0:
                    found.append((-shared, g))
        if found:
            want[name] = (min(found)[1], -min(found)[0])
            lists[c, min(found)[1]].append(-min(found)[0])
    g = spark.createDataFrame(genes, "chr string, gene string, start long, end long")
    df = spark.createDataFrame(reads, "name string, chr string, pos long, length long")
    assert {r.name: (r.gene, r.overlap) for r in mapping.best_gene(df, g).collect()} == want
    assert want["tie"][0] == "g98"
    got = {(r.chr, r.gene): r.decile for r in mapping.least_overlaps(df, g).collect()}
    assert got == {k: sorted(v)[len(v) // 10] for k, v in lists.items()}


# ---------------------------------------------------------------- global EM


def reads_and_isoforms(seed=7):
    r = random.Random(seed)
    length = {f"i{k}": r.randrange(20, 60) for k in range(8)}
    rows = []
    for k in range(120):
        read_len = r.randrange(5, 55)
        fit = [i for i, n in length.items() if n >= read_len] or list(length)[:1]
        for i in r.sample(fit, min(len(fit), r.randrange(1, 4))):
            rows.append((f"r{k}", i, length[i], 0, max(0, length[i] - read_len)))
    return rows, length


def brute_em(rows, length, form, rounds, tolerance):
    read_len = {}
    for name, _, n, a, b in rows:
        read_len[name] = max(read_len.get(name, 0), n - a - b)
    total = len(read_len)
    hist = collections.Counter(read_len.values())
    cdf = {i: sum(v for x, v in hist.items() if 1 <= x <= n) / total if form == "form_1" else 1.0 for i, n in length.items()}
    owners = collections.defaultdict(list)
    for name, i, *_ in rows:
        owners[name].append(i)
    theta = {i: sum(1 / len(o) for o in owners.values() if i in o) / total for i in length}
    for done in range(rounds):
        q = collections.Counter()
        for name, own in owners.items():
            x = read_len[name]
            sm = sum(theta[i] / (cdf[i] or 1) if cdf[i] or not theta[i] else math.inf for i, n in length.items() if n >= x)
            p = {}
            for i in own:
                places = length[i] - x + 1
                v = hist[x] / total if cdf[i] == 0 or sm == 0 else hist[x] / total / cdf[i] / sm
                p[i] = max(0.0, v / places) * theta[i] if places else 0.0
            for i, v in p.items():
                q[i] += v / (sum(p.values()) or 1)
        new = {i: q[i] / sum(q.values()) for i in length}
        if not any(new[i] > 0 and abs(new[i] - theta[i]) > tolerance * new[i] for i in length):
            return theta, done
        theta = new
    return theta, rounds


@pytest.mark.parametrize("form", global_em.FORMS)
@pytest.mark.parametrize("rounds, tolerance", [(3, 0.0), (40, 0.05)])
def test_iterate(spark, form, rounds, tolerance):
    rows, length = reads_and_isoforms()
    read_iso = spark.createDataFrame([(*x, "c", "g", [0]) for x in rows], "name string, isoform string, iso_len long, off5 long, off3 long, chr string, gene string, path array<int>")
    isoforms = spark.createDataFrame(list(length.items()), "isoform string, iso_len long")
    lengths = readlen.read_lengths(read_iso)
    hist = readlen.histogram(lengths)
    start = global_em.starting_theta(isoforms, "LR", lr=readlen.fractional_counts(read_iso))
    known = readlen.cdf_at(hist, isoforms, "iso_len")
    found, done = global_em.iterate(global_em.length_patterns(read_iso, lengths), known, hist, start, form, rounds, tolerance)
    want, rounds_taken = brute_em(rows, length, form, rounds, tolerance)
    assert {r.isoform: r.theta for r in found.collect()} == pytest.approx(want)
    assert done == rounds_taken
    with pytest.raises(ValueError, match="form"):
        global_em.iterate(read_iso, known, hist, start, "form_9")


def test_quantify_globally(spark):
    exons, reads = gene_tables(spark)
    got = {r.isoform: r for r in api.quantify_globally(spark, exons, reads, rounds=20).collect()}
    assert sum(r.tpm for r in got.values()) == pytest.approx(1e6)
    assert got["a"].theta > got["b"].theta > 0


def test_starts(spark):
    names = spark.createDataFrame([(f"i{k}",) for k in range(50)], "isoform string")
    lr = spark.createDataFrame([(f"i{k}", float(k)) for k in range(10)], "isoform string, theta double")
    sr = spark.createDataFrame([("i1", 4.0), ("i49", 4.0), ("other", 9.0)], "isoform string, theta double")
    of = lambda df: {r.isoform: r.theta for r in df.collect()}
    for how, strategy in (("LR", None), ("SR", "add_eps"), ("hybrid", "add_eps_small"), ("uniform", None), ("random", None), ("random", "add_eps")):
        got = of(global_em.starting_theta(names, how, lr, sr, strategy, 0.1, 0.5))
        assert len(got) == 50 and sum(got.values()) == pytest.approx(1)
        assert strategy is None or min(got.values()) > 0
    assert of(global_em.starting_theta(names, "LR", lr))["i9"] == pytest.approx(9 / 45)
    small = of(global_em.starting_theta(names, "LR", lr, strategy="add_eps_small", share=0.1, pseudo=0.5))
    count = {k: (k if k < 10 else 0) + (0.5 if k < 4.5 or k >= 10 else 0) for k in range(50)}
    assert small == pytest.approx({f"i{k}": v / sum(count.values()) for k, v in count.items()})
    both = of(global_em.starting_theta(names, "hybrid", lr, sr))
    assert both["i1"] == pytest.approx((1 / 45 + 4 / 8) / 2)
    # a draw depends on the isoform and the seed alone
    one = of(global_em.starting_theta(names.repartition(1), "random", seed=4))
    many = of(global_em.starting_theta(names.repartition(50).union(names.limit(3)), "random", seed=4))
    assert one == pytest.approx(many, rel=1e-12)
    assert one != pytest.approx(of(global_em.starting_theta(names, "random", seed=5)))
    for bad in (("LR", {}), ("zipf", {})):
        with pytest.raises(ValueError, match="start"):
            global_em.starting_theta(names, bad[0], **bad[1])
    with pytest.raises(ValueError, match="strategy"):
        global_em.starting_theta(names, "LR", lr, strategy="more")


def test_draws_are_exponential(spark):
    x = np.array([r.x for r in spark.range(4000).select(global_em.unit_gamma(F.col("id"), 1).alias("x")).collect()])
    assert x.min() > 0 and x.mean() == pytest.approx(1, abs=0.06) and (x > 1).mean() == pytest.approx(math.exp(-1), abs=0.03)


def test_scored_probabilities(spark):
    rows, length = reads_and_isoforms()
    rows += [("low", "i0", length["i0"], 10**6, 0), ("rare", "new", 999, 3, 4)]
    read_iso = spark.createDataFrame(rows, "name string, isoform string, iso_len long, off5 long, off3 long")
    theta = spark.createDataFrame([(i, 0.125) for i in length], "isoform string, theta double")
    mean, width = np.array([40, 5, 5]), np.array([10, 20, 30])

    def score(x):
        return -0.5 * (((x - mean) / width) ** 2).sum(axis=1) - np.log(width).sum()

    got = collections.Counter((r.name, r.isoform, round(r.p, 9)) for r in global_em.scored_probabilities(read_iso, theta, score).collect())
    share = collections.Counter()
    for n in length.values():
        share[n] += 0.125
    want = collections.Counter()
    for name, i, n, a, b in rows:
        log = float(score(np.array([[n, a, b]]))[0]) - (math.log(share[n]) if share[n] else math.inf)
        want[name, i, round(math.exp(log), 9) if log > -300 else 0.0] += 1
    assert got == want


def test_sampled_probabilities(spark):
    r = random.Random(8)
    samples = [(r.choice([100, 100.4, 200, 203, 99.2]), r.choice([3, 4, 3.5, 9]), r.choice([0, 1, 0.25])) for _ in range(300)]
    rows = [(f"r{i}", f"i{n}", n, r.randrange(2, 6), r.randrange(0, 3)) for i in range(60) for n in (100, 200, 400)]
    rows += [rows[0], ("far", "i400", 400, 390, 9)]
    hist = {n - a - b: k % 5 + 1 for k, (_, _, n, a, b) in enumerate(rows) if n == 400 and k % 2} | {50: 3}
    got = global_em.sampled_probabilities(
        spark.createDataFrame(rows, "name string, isoform string, iso_len long, off5 long, off3 long"),
        spark.createDataFrame([tuple(map(float, s)) for s in samples], "iso_len double, off5 double, off3 double"),
        spark.createDataFrame(list(hist.items()), "read_len long, n long"),
    )
    want = collections.Counter()
    for name, i, n, a, b in rows:
        near = [s for s in samples if abs(s[0] - n) < 0.01 * n]
        if near:
            p = sum(abs(s[1] - a) < 1 and abs(s[2] - b) < 1 for s in near) / len(near) / 4
        else:
            p = hist.get(n - a - b, 0) / (sum(v for k, v in hist.items() if k < n) or 1)
        want[name, i, round(p, 9)] += 1
    assert collections.Counter((x.name, x.isoform, round(x.p, 9)) for x in got.collect()) == want
    assert any(p > 0 for _, i, p in want if i == "i100") and any(p > 0 for _, i, p in want if i == "i400")


def test_blend_and_training_rows(spark, tmp_path):
    exons, reads = gene_tables(spark)
    found = api.k_values(spark, exons, KValueSettings(full_length_regions="none"), long_reads=reads)
    long = api.region_abundance(found)
    short = spark.createDataFrame([("a", 5e5), ("a", 1e5), ("other", 1.0)], "isoform string, value double")
    both = {r.isoform: r for r in least_squares.blended(long, short, 0.75).collect()}
    assert both["a"].sr_tpm == 6e5 and both["b"].sr_tpm == 0
    assert both["a"].tpm == pytest.approx(0.25 * 6e5 + 0.75 * both["a"].lr_tpm) and both["b"].alpha == 0.75
    rows = api.training_rows(found, least_squares.blended(long, short, 0.75)).where("reads = 'LR'").collect()
    assert {(r.isoform, r.region) for r in rows} == {(r.isoform, r.region) for r in found.matrix_info().where("reads = 'LR'").collect()}
    assert all(r.tpm == both[r.isoform].tpm for r in rows) and {r.b for r in rows} == {5, 7, 4}
    more = exons.union(spark.createDataFrame([("c", "quiet", "q", "+", 9000, 9099)], exons.schema))
    api.write_region_abundance(f"{tmp_path}", long, more)
    back = {r.Gene: float(r.TPM) for r in spark.read.csv(f"{tmp_path}/expression_gene.out", sep="\t", header=True).collect()}
    assert back == pytest.approx({"g": 1e6, "quiet": 0})


def test_matrix_folders_do_not_grow_with_genes(spark, tmp_path):
    rows = [("c", f"g{k}", "P0:P1", f"i{k}", 1.0) for k in range(60) for _ in range(2)]
    sinks.write_matrix(spark.createDataFrame(rows, "chr string, gene string, region string, isoform string, a double"), f"{tmp_path}/m", 8)
    assert 2 <= sum(x.is_dir() for x in os.scandir(f"{tmp_path}/m")) <= 8
    back = spark.read.parquet(f"{tmp_path}/m")
    assert sorted(tuple(r) for r in back.select("chr", "gene", "region", "isoform", "a").collect()) == sorted(rows)
    assert back.groupBy("gene").agg(F.countDistinct("part").alias("n")).where("n > 1").count() == 0


def test_many_communities_in_one_task_as_alone(spark):
    """Batches end inside communities; one community spans several batches."""
    names = [(f"i{c}-{k}", f"g{c}", f"c{c}") for c in range(30) for k in range(1 + c % 4 + 40 * (c == 7))]
    rows = [(c * 1000 + p, [(f"i{c}-{k}", 1.0 + (p + k) % 3) for k in range(p % (1 + c % 4) + 1)], p % 5 + 1) for c in range(30) if c != 9 for p in range(12)]
    members = spark.createDataFrame(names, "isoform string, gene string, community string")
    lr = spark.createDataFrame(rows, "pattern long, members array<struct<isoform:string,v:double>>, n long")
    s = QuantifySettings(max_iterations=5, relative_tolerance=0.0, tested_above=0.0)
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.isoform: r for r in em.run(members, lr, None, None, None, s).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert set(got) == {x[0] for x in names}
    for c in range(30):
        own = sorted(x[0] for x in names if x[2] == f"c{c}")
        theta = dict.fromkeys(own, 1 / len(own))
        for _ in range(5):
            q = dict.fromkeys(own, 0.0)
            for p, m, n in rows:
                if p // 1000 == c:
                    den = sum(v * theta[i] for i, v in m)
                    for i, v in m:
                        q[i] += n * v * theta[i] / den if den else 0.0
            total = sum(q.values()) or 1.0
            theta = {i: x / total for i, x in q.items()}
        for i in own:
            assert got[i].community == f"c{c}" and got[i].rounds == len(got[i].trace) <= 5 and got[i].trace[-1] == got[i].theta
            assert np.isclose(got[i].theta, theta[i], atol=1e-12)


def test_tables_of_small_files_are_not_broadcast(spark):
    """Joins with settled tables and with the annotation's are merge joins: their files say nothing of their size in memory."""
    x = spark.range(200).selectExpr("'c' as chr", "cast(id as string) as gene", "concat('i', id) as isoform", "'+' as strand", "cast(id * 100 + 1 as int) as start", "cast(id * 100 + 60 as int) as end")
    segs = paths.segments(x)
    many = settle(x).select("gene", F.explode(F.sequence(F.lit(1), F.lit(50))).alias("k"))
    for made in (paths.paths(segs, x), many.join(x.select("gene", "start"), "gene"), paths.gene_info(x, segs)):
        assert "BroadcastHashJoin" not in made._jdf.queryExecution().executedPlan().toString()


def test_rounds_of_large_communities_join_no_rows_with_proportions(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(f"r{k}", f"i{i}", rng.random()) for k in range(60) for i in rng.sample(range(12), rng.randint(1, 4))]
    one = F.array_sort(F.collect_list(F.struct("isoform", "v"))).alias("members")
    pats = settle(spark.createDataFrame(rows, "name string, isoform string, v double").groupBy("name").agg(one).select(F.xxhash64("name").alias("pattern"), "members", F.lit(2).cast("long").alias("n")))
    members = spark.createDataFrame([(f"i{i}", "g", "c") for i in range(12)] + [("alone", "h", "d")], "isoform string, gene string, community string")
    found = {}
    for most in (0, 1 << 20):
        monkeypatch.setattr(em, "BROADCAST_ISOFORMS", most)
        for sr in (None, pats):
            got = em.run(members, pats, sr, None, None, QuantifySettings(em_rows_per_task=0, max_iterations=5))
            found[most, sr is None] = {r.isoform: (r.community, r.rounds, r.theta) for r in got.collect()}
        monkeypatch.setattr(em, "expected", None)  # the joins that shuffle rows: not met below
    for alone in (True, False):
        assert found[0, alone].keys() == found[1 << 20, alone].keys()
        for isoform, (community, rounds, theta) in found[0, alone].items():
            got = found[1 << 20, alone][isoform]
            assert got[:2] == (community, rounds) and got[2] == pytest.approx(theta, abs=1e-12)


def test_iterate_makes_the_lengths_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def passed(batches):
        calls.add(1)
        yield from batches

    hist = spark.createDataFrame([(5, 2), (9, 1)], "read_len long, n long").coalesce(1).mapInArrow(passed, "read_len long, n long")
    known = spark.createDataFrame([("a", 10, 1.0), ("b", 12, 1.0)], "isoform string, iso_len long, cdf double")
    pats = spark.createDataFrame([(1, 5, "a", 2), (1, 5, "b", 2), (2, 9, "b", 1)], "pattern long, read_len long, isoform string, n long")
    start = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "isoform string, theta double")
    theta, done = global_em.iterate(pats, known, hist, start, rounds=2, tolerance=0.0)
    assert done == 2 and theta.agg(F.sum("theta")).first()[0] == pytest.approx(1)
    assert calls.value == 1


@pytest.mark.parametrize("form", global_em.FORMS)
@pytest.mark.parametrize("rounds, tolerance", [(3, 0.0), (40, 0.05)])
def test_rounds_shuffle_sums_alone_and_go_by_joins_for_many_isoforms(spark, monkeypatch, form, rounds, tolerance):
    rows, length = reads_and_isoforms(9)
    length |= {"unread": 70}
    read_iso = spark.createDataFrame(rows, "name string, isoform string, iso_len long, off5 long, off3 long")
    isoforms = spark.createDataFrame(list(length.items()), "isoform string, iso_len long")
    plain, plans = global_em.settle, []
    monkeypatch.setattr(global_em, "settle", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df))
    sets = plain(global_em.length_sets(read_iso))
    hist = sets.groupBy("read_len").agg(F.sum("n").alias("n"))
    assert rows_of(hist) == rows_of(readlen.histogram(readlen.read_lengths(read_iso)))
    start = global_em.starting_theta(isoforms, "LR", lr=global_em.shared_counts(sets))
    known = readlen.cdf_at(hist, isoforms, "iso_len")
    want, rounds_taken = brute_em(rows, length, form, rounds, tolerance)
    for most, joined in ((1 << 20, False), (0, True)):
        monkeypatch.setattr(global_em, "BROADCAST_ISOFORMS", most)
        plans.clear()
        found, done = global_em.iterate(sets, known, hist, start, form, rounds, tolerance)
        assert {r.isoform: r.theta for r in found.collect()} == pytest.approx(want) and done == rounds_taken
        assert any("hashpartitioning(pattern" in p for p in plans) == joined


def rows_of(df):
    return collections.Counter(map(tuple, df.select(*sorted(df.columns)).collect()))


def test_region_weights_are_looked_up_without_spreading_ends(spark, table, monkeypatch):
    rows = [("c", f"g{k % 3}", [k], 90 + k, 90 + k, 90 + k, 0, ["a", "b", "far"]) for k in range(9)]
    rows += [("c", f"g{k}", [0, 3 + k], 400, 150 + 9 * k, 180, 70 - k, ["b", "a"]) for k in range(3)]
    regions = spark.createDataFrame(rows, "chr string, gene string, path array<int>, len long, first long, last long, inner long, isoforms array<string>")
    lengths = [("c", f"g{k}", i, n) for k in range(3) for i, n in (("a", 300), ("b", 210), ("far", 5000))]
    isoforms = spark.createDataFrame(lengths, "chr string, gene string, isoform string, length long")
    found = []
    for most in (density.BROADCAST_SUMS, 0):  # 0: ends that a table of sums doesn't hold meet them by a join, as where there are very many
        monkeypatch.setattr(density, "BROADCAST_SUMS", most)
        got = density.region_weights(regions, isoforms, table)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert ("sign" in plan) == (most == 0)
        found.append({(r.gene, r.isoform, r.region): r.weight for r in got.collect()})
    assert len(found[0]) == 33 and sum(v > 0 for v in found[0].values()) > 10 and found[0] == pytest.approx(found[1], abs=1e-12)
    none = density.region_weights(regions, isoforms, table.where("false"))  # no read at all
    assert {r.weight for r in none.collect()} == {0.0} and none.count() == 33
