"""Interval and path operators against brute force on small random genes."""

import random
import re

from spliceframe.operators import communities, intervals, paths


def random_exons(seed, genes=4):
    r = random.Random(seed)
    rows = []
    for g in range(genes):
        for i in range(r.randrange(1, 4)):
            at = r.randrange(1, 30)
            for _ in range(r.randrange(1, 5)):
                end = at + r.randrange(0, 12)
                rows.append(("1", f"g{g}", f"g{g}i{i}", "+", at, end))
                at = end + r.randrange(2, 9)
    return rows


COLUMNS = "chr string, gene string, isoform string, strand string, start int, end int"


def atoms(rows):
    """Maximal runs of covered bases under the same set of exons; runs of one base are dropped."""
    out = []
    under = lambda x: frozenset(k for k, (s, e) in enumerate(rows) if s <= x <= e)
    borders = sorted({s for s, _ in rows} | {e + 1 for _, e in rows})
    for a, b in zip(borders, borders[1:], strict=False):
        if under(a) and b - 1 > a:
            out.append((a, b - 1))
    return out


def test_split_merge_points(spark):
    rows = random_exons(5)
    df = spark.createDataFrame(rows, COLUMNS)
    got = {(r.gene, r.start, r.end) for r in intervals.atomic_split(df, ["chr", "gene"]).collect()}
    merged = {(r.gene, r.start, r.end) for r in intervals.merge(df, ["chr", "gene"]).collect()}
    for g in {r[1] for r in rows}:
        own = sorted({(r[4], r[5]) for r in rows if r[1] == g})
        assert {(s, e) for gg, s, e in got if gg == g} == set(atoms(own))
        islands = []
        for s, e in own:
            if islands and s <= islands[-1][1]:
                islands[-1] = (islands[-1][0], max(e, islands[-1][1]))
            else:
                islands.append((s, e))
        assert {(s, e) for gg, s, e in merged if gg == g} == set(islands)
    points = intervals.number_points(df, ["gene"]).collect()
    for g in {r[1] for r in rows}:
        own = sorted({x for r in rows if r[1] == g for x in r[4:6]})
        assert sorted((p.at, p.point) for p in points if p.gene == g) == [(x, i) for i, x in enumerate(own)]


def test_touching_and_nested(spark):
    def split(*pairs):
        df = spark.createDataFrame([("g", a, b) for a, b in pairs], "gene string, start int, end int")
        return sorted((r.start, r.end) for r in intervals.atomic_split(df, ["gene"]).collect())

    assert split((1, 10), (2, 4), (3, 5)) == [(3, 4), (6, 10)]
    assert split((1, 5), (5, 9)) == [(1, 4), (6, 9)]
    assert split((1, 5), (6, 9)) == [(1, 5), (6, 9)]


def test_paths_and_slices(spark):
    rows = random_exons(9)
    df = spark.createDataFrame(rows, COLUMNS)
    segs = paths.segments(df)
    seg = {}
    for r in segs.collect():
        seg.setdefault(r.gene, {})[r.seg] = (r.start, r.end)
    got = {r.isoform: list(r.path) for r in paths.paths(segs, df).collect()}
    want = {}
    for g, own in seg.items():
        for iso in {r[2] for r in rows if r[1] == g}:
            ex = [(r[4], r[5]) for r in rows if r[2] == iso]
            path = [i for i, (s, e) in sorted(own.items()) if any(s >= a and e <= b for a, b in ex)]
            if path:
                want[iso] = path
    assert got == want
    slices = {(r.gene, tuple(r.path)): r for r in paths.slices(paths.paths(segs, df), segs).collect()}
    expected = {}
    for iso, path in want.items():
        g = iso[:2]
        for i in range(len(path)):
            for j in range(i, len(path)):
                expected.setdefault((g, tuple(path[i : j + 1])), set()).add(iso)
    assert {k: set(r.isoforms) for k, r in slices.items()} == expected
    for (g, path), r in slices.items():
        size = [seg[g][i][1] - seg[g][i][0] + 1 for i in path]
        assert (r["len"], r["first"], r["last"], r["inner"]) == (sum(size), size[0], size[-1], sum(size[1:-1]))


def test_overlap_and_range_join(spark):
    r = random.Random(2)
    left = [(i, a := r.randrange(300), a + r.randrange(60)) for i in range(60)]
    right = [(i, a := r.randrange(300), a + r.randrange(60)) for i in range(60)]
    a = spark.createDataFrame([("k", *x) for x in left], "k string, i int, start int, end int")
    b = spark.createDataFrame([("k", *x) for x in right], "k string, j int, r_start int, r_end int")
    got = sorted((x.i, x.j) for x in intervals.overlap_join(a, b, ["k"], 5, width=16).collect())
    assert got == sorted((i, j) for i, s, e in left for j, rs, re in right if rs < e + 5 and re + 1 > s - 5)


def test_components_match_union_find(spark):
    r = random.Random(7)
    nodes = [f"n{i:03}" for i in range(120)]
    edges = [(r.choice(nodes), r.choice(nodes)) for _ in range(80)] + [(nodes[i], nodes[i + 1]) for i in range(40)]
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        parent[b] = a
    got = communities.components(spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame(edges, "u string, v string"))
    assert dict(got.collect()) == {n: find(n) for n in nodes}


def test_slices_are_made_once_and_without_a_shuffle_of_their_own(spark):
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    for seed in range(3):
        rows = random_exons(seed, 5)
        rows += [(c, g, i + "x", s, a, b) for c, g, i, s, a, b in rows if i.endswith("0")]  # the same exons again
        x = spark.createDataFrame(rows, COLUMNS)
        segs = paths.segments(x)
        iso = paths.paths(segs, x)
        want = {}
        for r in iso.collect():
            for i in range(len(r.path)):
                for j in range(i, len(r.path)):
                    want.setdefault((r.gene, tuple(r.path[i : j + 1])), set()).add(r.isoform)
        length = {(r.gene, r.seg): r.len for r in segs.collect()}
        made = paths.slices(iso, segs)
        got = made.collect()
        assert len(got) == len(want)
        for r in got:
            own = [length[r.gene, p] for p in r.path]
            assert r.isoforms == sorted(want[r.gene, tuple(r.path)])
            assert (r.len, r.first, r.last, r.inner) == (sum(own), own[0], own[-1], sum(own[1:-1]))
    assert not re.search(r"Aggregate\(keys=\[[^\]]*path#", plan(made))  # slices aren't grouped
    laid = paths.slices(*reversed(paths.laid_out(x)))
    assert "Join" not in plan(laid)  # a gene's row is gathered in one grouping
    assert sorted(map(str, laid.collect())) == sorted(map(str, got))
