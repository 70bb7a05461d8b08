"""The jobs as queries: each is run twice over the driver's tables into one new folder, and its output read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobs import length_profile, region_counts
from jobs.common import load_config

from .driver_queries import query
from .driver_reads import scratch


@query("""WITH h AS (SELECT coalesce(source, 'none') AS sample, length(coalesce(text, '')) AS read_len, count(*) AS n FROM documents GROUP BY 1, 2),
iso AS (SELECT length(text) AS iso_len, count(*)::double AS theta FROM benchmark WHERE text <> '' GROUP BY 1),
t AS (SELECT sample, sum(n) AS total FROM h GROUP BY 1),
u AS (SELECT *, sum(CASE WHEN read_len >= 1 THEN n ELSE 0 END) OVER (PARTITION BY sample ORDER BY read_len) AS upto FROM h),
c AS (SELECT t.sample, iso_len, theta, coalesce((SELECT max(upto) FROM u WHERE u.sample = t.sample AND u.read_len <= iso_len), 0) / total::double AS cdf FROM t CROSS JOIN iso),
v AS (SELECT sample, iso_len, CASE WHEN cdf = 0 THEN 'inf'::double ELSE theta / cdf END AS v FROM c)
SELECT sample, read_len, n, round(upto / total::double, 6) AS cdf,
  round(coalesce((SELECT sum(v) FROM v WHERE v.sample = u.sample AND v.iso_len >= u.read_len), 0), 4) AS sm
FROM u JOIN t USING (sample)""")
def job1_length_profile(spark, sf_dir) -> DataFrame:
    """The length profile of each source's texts; the second run finds no new file."""
    config, out = load_config(length_profile.CONFIG), scratch(spark, "job1")
    for _ in range(2):
        got = length_profile.run(spark, config, sf_dir, f"{out}/output", f"{out}/checkpoint")
    return got.select("sample", "read_len", "n", F.round("cdf", 6).alias("cdf"), F.round("sm", 4).alias("sm"))


@query("""WITH r AS (SELECT c_nationkey, c_custkey AS k, o_orderkey % 3 AS kind, (o_orderkey // 3) % 13 - 6 AS d FROM orders JOIN customer ON o_custkey = c_custkey),
n AS (SELECT k, CASE kind WHEN 0 THEN '0' WHEN 1 THEN '0,1' ELSE '0,2' END AS region, count(*) AS n FROM r WHERE kind = 0 OR abs(d) <= 5 GROUP BY 1, 2),
w AS (SELECT c_custkey AS k, unnest(['0,1,2', '0,2']) AS region FROM customer),
e AS (SELECT k, region, n FROM n UNION ALL SELECT k, region, 0 FROM w ANTI JOIN n USING (k, region)),
t AS (SELECT k, sum(CASE WHEN region = '0' THEN 0 ELSE n END) AS n_unique, sum(CASE WHEN region = '0' THEN n ELSE 0 END) AS n_multi FROM e GROUP BY k)
SELECT 'chr' || c_nationkey AS chr, k::varchar AS gene, region, array_to_string(list_transform(string_split(region, ','),
    lambda s: (1000 * k + 1 + 300 * s::int) || '-' || (1000 * k + 100 + 300 * s::int)), ',') AS coordinates,
  CASE region WHEN '0' THEN 'a' || k || '|b' || k WHEN '0,2' THEN 'b' || k ELSE 'a' || k END AS isoforms,
  n, cast(n_unique AS bigint) AS n_unique, cast(n_multi AS bigint) AS n_multi
FROM e JOIN t USING (k) JOIN customer ON c_custkey = k""")
def job2_region_counts(spark, sf_dir) -> DataFrame:
    """Reads (orders) of each region of the genes (customers); the second run replaces the first's files."""
    config, out = load_config(region_counts.CONFIG), scratch(spark, "job2")
    for _ in range(2):
        got = region_counts.run(spark, config, sf_dir, out)
    return got.select("chr", "gene", "region", "coordinates", "isoforms", "n", "n_unique", "n_multi")
