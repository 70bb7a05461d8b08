"""The jobs: two runs over growing input, reruns, broken runs, and rows that are odd."""

import collections
import json
import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import length_profile, region_counts
from jobs.common import asked, inputs, load_config
from spliceframe.config import QuantifySettings, settings_of
from spliceframe.operators import mapping, paths
from spliceframe.plans.scratch import merged

DATA = os.environ.get("TESTDATA_DIR", "/root/testdata/sf0.001")
READS = "doc_id long, text string, source string, other int"
LENGTHS = load_config(length_profile.CONFIG)
REGIONS = load_config(region_counts.CONFIG)


def rows_of(df):
    return collections.Counter(map(tuple, df.select(*sorted(df.columns)).collect()))


def brute_profile(texts, isoforms):
    """{(sample, length): (n, cdf, sm)}"""
    out = {}
    for sample in {s for s, _ in texts}:
        lengths = [len(t or "") for s, t in texts if s == sample]
        cdf = lambda x, held=lengths: sum(1 <= v <= x for v in held) / len(held)
        for x in set(lengths):
            part = [float("inf") if cdf(i) == 0 else 1 / cdf(i) for i in isoforms if i >= x]
            out["none" if sample is None else sample, x] = lengths.count(x), cdf(x), sum(part)
    return out


FIRST = [("a", "acgt"), ("a", "acgt"), ("a", "acgtacgtaa"), ("b", "ac"), (None, "acg"), ("b", None), ("b", "")]
LATER = [("a", "ac"), ("b", "acgtac" * 30), ("c d/e=f", "ñññ"), (None, None)]
SEQUENCES = ["acgta", "acgtacgtacgt", "ac", "acgta", "", None]


@pytest.fixture
def lake(spark, tmp_path):
    def put(rows, mode="append"):
        df = spark.createDataFrame([(i, t, s, 1) for i, (s, t) in enumerate(rows)], READS).withColumn("n", F.lit(7))
        df.repartition(2).write.mode(mode).parquet(f"{tmp_path}/in/documents.parquet")

    items = spark.createDataFrame(list(enumerate(SEQUENCES)), "item_id int, text string")
    items.write.parquet(f"{tmp_path}/in/benchmark.parquet")
    return put, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark"


def same_profile(got, texts):
    have = {(r.sample, r.read_len): (r.n, r.cdf, r.sm) for r in got.collect()}
    want = brute_profile(texts, [len(x) for x in SEQUENCES if x])
    assert have.keys() == want.keys()
    for k, v in want.items():
        assert have[k] == pytest.approx(v), k


def test_length_profile_grows(spark, lake):
    put, source, out, mark = lake
    put(FIRST)
    same_profile(length_profile.run(spark, LENGTHS, source, out, mark), FIRST)
    # nothing new: the same rows
    assert length_profile.update_lengths(spark, LENGTHS["reads"], source, f"{out}/lengths", mark) == 0
    same_profile(length_profile.run(spark, LENGTHS, source, out, mark), FIRST)
    put(LATER)
    assert length_profile.update_lengths(spark, LENGTHS["reads"], source, f"{out}/lengths", mark) == len(LATER)
    same_profile(length_profile.run(spark, LENGTHS, source, out, mark), FIRST + LATER)
    # partitioned by sample
    assert any(x.startswith("sample=") for x in os.listdir(f"{out}/profile"))


def test_length_profile_file_by_file(spark, lake):
    put, source, out, mark = lake
    put(FIRST)
    put(LATER)
    config = LENGTHS | {"reads": LENGTHS["reads"] | {"files_a_batch": 1}}
    same_profile(length_profile.run(spark, config, source, out, mark), FIRST + LATER)


def test_length_profile_after_a_broken_run(spark, lake, monkeypatch):
    """A run that ends before its profile is written, or whose last batch wasn't committed, is made good."""
    put, source, out, mark = lake
    put(FIRST)
    length_profile.run(spark, LENGTHS, source, out, mark)
    put(LATER)
    with monkeypatch.context() as m:
        m.setattr(length_profile, "profile", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            length_profile.run(spark, LENGTHS, source, out, mark)
    same_profile(length_profile.run(spark, LENGTHS, source, out, mark), FIRST + LATER)
    newest = max(int(x) for x in os.listdir(f"{mark}/commits") if x.isdigit())
    for x in (f"{newest}", f".{newest}.crc"):
        if os.path.exists(f"{mark}/commits/{x}"):
            os.remove(f"{mark}/commits/{x}")
    shutil.rmtree(f"{out}/profile")
    same_profile(length_profile.run(spark, LENGTHS, source, out, mark), FIRST + LATER)


def test_length_profile_without_reads(spark, lake):
    put, source, out, mark = lake
    put([])
    got = length_profile.run(spark, LENGTHS, source, out, mark)
    assert got.count() == 0 and set(got.columns) == {"sample", "read_len", "n", "cdf", "sm"}


def test_overrides_for_quantify(spark, lake):
    """One sample of the profile is what formats.read_length_overrides reads."""
    from spliceframe.sources import formats

    put, source, out, mark = lake
    put(FIRST)
    length_profile.run(spark, LENGTHS, source, out, mark)
    got = formats.read_length_overrides(spark, f"{out}/profile/sample=a")
    assert {r.read_len: r.n for r in got.collect()} == {4: 2, 10: 1}


# ---------------------------------------------------------------- region counts


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("shop"))
    c = [(k, k % 3) for k in range(1, 31)]
    o = [(k, 1 + (k * 7) % 29) for k in range(400)]
    spark.createDataFrame(c, "c_custkey long, c_nationkey int").write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame(o, "o_orderkey long, o_custkey long").write.parquet(f"{folder}/orders.parquet")
    return folder, c, o


def brute_regions(c, o):
    n = collections.Counter()
    for key, k in o:
        kind, d = key % 3, key // 3 % 13 - 6
        if kind == 0 or abs(d) <= 5:
            n[k, ("0", "0,1", "0,2")[kind]] += 1
    for k, _ in c:
        for whole in ("0,1,2", "0,2"):
            n[k, whole] += 0
    out = collections.Counter()
    for (k, region), x in n.items():
        shared = n.get((k, "0"), 0)
        alone = sum(v for (g, r), v in n.items() if g == k and r != "0")
        out[f"chr{dict(c)[k]}", str(k), region, x, alone, shared] += 1
    return out


def test_region_counts(spark, shop, tmp_path):
    folder, c, o = shop
    columns = ["chr", "gene", "region", "n", "n_unique", "n_multi"]
    for _ in range(2):
        got = region_counts.run(spark, REGIONS, folder, f"{tmp_path}/out")
        assert collections.Counter(map(tuple, got.select(columns).collect())) == brute_regions(c, o)
    first = got.where("gene = '3' and region = '0,2'").first()
    assert (first.coordinates, first.isoforms) == ("3001-3100,3601-3700", "b3")


def test_region_counts_of_some_chromosomes(spark, shop, tmp_path):
    """Only the named chromosomes are replaced."""
    folder, _, _ = shop
    whole = rows_of(region_counts.run(spark, REGIONS, folder, f"{tmp_path}/out"))
    shutil.rmtree(f"{tmp_path}/out/chr=chr1")
    os.mkdir(f"{tmp_path}/out/chr=chr9")
    spark.createDataFrame([("g", "0", "1-2", "i", 1, 1, 0)], "gene string, region string, coordinates string, isoforms string, n long, n_unique long, n_multi long").write.mode("overwrite").parquet(f"{tmp_path}/out/chr=chr9")
    before = os.listdir(f"{tmp_path}/out/chr=chr2")
    mended = region_counts.run(spark, REGIONS | {"chromosomes": ["chr1"]}, folder, f"{tmp_path}/out")
    assert rows_of(mended.where("chr <> 'chr9'")) == whole and mended.where("chr = 'chr9'").count() == 1
    assert os.listdir(f"{tmp_path}/out/chr=chr2") == before
    # a whole run leaves nothing of an earlier input
    assert rows_of(region_counts.run(spark, REGIONS, folder, f"{tmp_path}/out")) == whole


def test_read_filter(spark):
    """A read on a tenth of an isoform of ten more exons is left out with filter_reads."""
    exons = [("c", "g", "long", "+", 1000 * i, 1000 * i + 199) for i in range(1, 12)] + [("c", "g", "short", "+", 1000, 1199)]
    reads = [("part", 0, "c", 1010, 60, "150M"), ("most", 0, "c", 1010, 60, "190M" + "800N200M" * 10)]
    exons = spark.createDataFrame(exons, "chr string, gene string, isoform string, strand string, start int, end int")
    reads = spark.createDataFrame(reads, "name string, flag int, chr string, pos int, mapq int, cigar string")
    settings = region_counts.QuantifySettings()
    every = region_counts.counts(exons, reads, settings, "none", False)
    good = region_counts.counts(exons, reads, settings, "none", True)
    assert (every.agg(F.sum("n")).first()[0], good.agg(F.sum("n")).first()[0]) == (2, 1)


def test_no_reads(spark, shop, tmp_path):
    folder, c, _ = shop
    config = REGIONS | {"alignments": [*REGIONS["alignments"], "WHERE false"], "full_length_regions": "none"}
    assert region_counts.run(spark, config, folder, f"{tmp_path}/out").count() == 0


def test_config_sql(spark):
    one = spark.createDataFrame([(1,)], "x int")
    assert asked(spark, ["SELECT x + 1 AS y", "FROM {t}"], {"t": one}).first().y == 2
    assert not spark.catalog.listTables()


def test_unknown_config_keys(spark, shop, tmp_path):
    with pytest.raises(ValueError, match="chromosome"):
        region_counts.run(spark, REGIONS | {"chromosome": "chr1"}, shop[0], f"{tmp_path}/out")
    with pytest.raises(ValueError, match="samples"):
        length_profile.run(spark, LENGTHS | {"samples": 1}, shop[0], f"{tmp_path}/out", f"{tmp_path}/mark")


def test_logs(spark, shop, tmp_path, caplog):
    """What was read and written is in the log, with the counts of the run itself."""
    folder, _, o = shop
    with caplog.at_level("INFO", logger="jobs"):
        got = region_counts.run(spark, REGIONS, folder, f"{tmp_path}/out")
    said = caplog.text
    assert f"read {len(o)} alignments" in said and f"{folder}/orders.parquet" in said
    assert f"wrote {got.count()} regions of 3 chromosomes" in said and f"{tmp_path}/out" in said


ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_imports():
    """Nothing of the training-data operators is imported."""
    code = "import sys, jobs.length_profile, jobs.region_counts; sys.exit(any('llm' in m or m == 'corpus_pipeline' for m in sys.modules if m.startswith(('spliceframe', 'corpus'))))"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0


def test_command_lines(spark, lake, shop, tmp_path):
    """Each job run as a program, with a config file of its own; a second run of the first takes what is new."""
    put, source, out, mark = lake
    put(FIRST)
    config = tmp_path / "regions.json"
    config.write_text(json.dumps(REGIONS | {"chromosomes": ["chr1"]}))
    go = lambda job, *args: subprocess.run([sys.executable, "-m", f"jobs.{job}", *args], cwd=ROOT, capture_output=True, text=True, timeout=300)  # noqa: E731, E501
    first = go("length_profile", "--input", source, "--output", out, "--checkpoint", mark)
    assert first.returncode == 0 and f"read {len(FIRST)} new rows" in first.stderr, first.stderr[-2000:]
    put(LATER)
    again = go("length_profile", "--input", source, "--output", out, "--checkpoint", mark)
    assert f"read {len(LATER)} new rows" in again.stderr
    same_profile(spark.read.schema("read_len long, n long, cdf double, sm double, sample string").parquet(f"{out}/profile"), FIRST + LATER)
    some = go("region_counts", "--config", str(config), "--input", shop[0], "--output", f"{tmp_path}/regions")
    assert some.returncode == 0 and os.listdir(f"{tmp_path}/regions").count("chr=chr1") == 1, some.stderr[-2000:]
    assert "--checkpoint" in go("length_profile", "--help").stdout


def test_region_counts_broadcasts_no_table_and_keeps_no_long_plan(spark):
    tables = {name: merged(t) for name, t in inputs(spark, REGIONS, DATA).items()}
    exons, alignments = (asked(spark, REGIONS[k], tables) for k in ("exons", "alignments"))
    assert "Broadcast" not in alignments._jdf.queryExecution().executedPlan().toString()
    found = region_counts.counts(exons, alignments, settings_of(QuantifySettings, **REGIONS["settings"]), "all", True)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "customer" not in plan and "orders" not in plan  # segments, paths and regions are read, not made again


def test_region_qc_is_read_qc(spark):
    path = list(range(12))
    iso_paths = spark.createDataFrame([("1", "g", "long", path), ("1", "g", "short", [0, 1])], "chr string, gene string, isoform string, path array<int>")
    iso = spark.createDataFrame([("1", "g", "long", 1000), ("1", "g", "short", 150)], "chr string, gene string, isoform string, length long")
    reads = [("a", [0], 100), ("b", [0], 201), ("c", [0, 1], 200), ("d", path[:4], 200), ("e", path[:5], 100), ("f", path, 10)]
    mapped = spark.createDataFrame([(n, "1", "g", p, k) for n, p, k in reads], "name string, chr string, gene string, path array<int>, read_length int")
    owned = paths.owners(mapped, iso_paths).join(iso.withColumnRenamed("length", "iso_len"), [*paths.GENE, "isoform"])
    exact = iso_paths.selectExpr("isoform", "size(path) as n_exons")
    want = mapping.read_qc(mapped.join(owned, [*paths.GENE, "path"]), exact).select("name").distinct().collect()
    got = mapping.region_qc(mapped, iso_paths, iso).select("name").collect()
    assert sorted(got) == sorted(want) and {r.name for r in got} == {"b", "e", "f"}


def test_each_part_of_the_lengths_is_written_by_its_own_task(spark, tmp_path):
    rows = [(i, "x" * (i % 90), f"s{i % 7}", 0) for i in range(700)]
    spark.createDataFrame(rows, READS).write.parquet(f"{tmp_path}/in/documents.parquet")
    taken = length_profile.update_lengths(spark, LENGTHS["reads"], f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert taken == 700 and back.agg(F.sum("n")).first()[0] == 700
    assert back.select(F.input_file_name()).distinct().count() > 1
