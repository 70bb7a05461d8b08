"""Every driver query with SQL gives DuckDB's rows on the smallest tables."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
import __spark_entry__ as entry  # noqa: E402
from spliceframe import driver_queries  # noqa: E402

DATA = os.environ.get("TESTDATA_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float):
        return f"{v:.5g}" if abs(v) > 1e-9 else "0"
    return str(v)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in values)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(driver_queries.SQL))
def test_against_duckdb(spark, duck, name):
    got = entry.queries()[name](spark, DATA)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_entry_and_others(spark):
    assert entry.entry(spark).count() > 0
    for name in set(driver_queries.QUERIES) - set(driver_queries.SQL):
        assert driver_queries.QUERIES[name](spark, DATA).count() > 0


def test_components_of_all_rows(spark, tmp_path):
    rows = [(k, s) for k in range(1, 80) for s in ((k % 4, k % 4 + 4) if k % 40 else (9, 9))] + [(81, 7), (81, 6), (83, 12), (None, 13)]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    label = {s: s for _, s in rows}
    for _ in label:
        for a, s in rows:
            for b, t in rows:
                if a is not None and a == b:
                    label[s] = min(label[s], label[t])
    got = driver_queries.QUERIES["components"](spark, str(tmp_path))
    assert {r.node: r.label for r in got.collect()} == label


def test_cond_prob_deals_rows_in_parts_of_bounded_size(spark, monkeypatch):
    sf_dir = DATA
    want = sorted(map(tuple, driver_queries.QUERIES["cond_prob_form1"](spark, sf_dir).collect()))
    monkeypatch.setattr(driver_queries, "ROWS_OF_TASK", 50, raising=False)
    rows = driver_queries.table(spark, sf_dir, "lineitem").count()
    got = driver_queries.QUERIES["cond_prob_form1"](spark, sf_dir)
    assert f"{-(-rows // 50)}), REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == want == sorted(set(want))


def test_reads_are_mapped_once_on_one_model(spark, monkeypatch):
    from spliceframe import driver_reads

    calls, laid_out = [], driver_reads.paths.laid_out
    monkeypatch.setattr(driver_reads.paths, "laid_out", lambda x: calls.append(1) or laid_out(x))
    got = driver_queries.QUERIES["long_read_regions"](spark, DATA)
    assert len(calls) == 1
    assert "MapInPandas" not in got._jdf.queryExecution().executedPlan().toString()  # what follows reads the table of mapped reads


@pytest.mark.parametrize("name", ["kvalue_files", "map_reads", "gtf_exons", "job2_region_counts"])
def test_positions_beyond_32_bits(spark, tmp_path, name):
    customers = [3, 2_147_483, 5_400_000, 10**13]
    orders = [(i, customers[i % 4]) for i in range(1, 160)]
    spark.createDataFrame([(k, k % 3) for k in customers], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    for t in ("customer", "orders"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got, want = entry.queries()[name](spark, str(tmp_path)), con.sql(entry.oracle_sql()[name])
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())
