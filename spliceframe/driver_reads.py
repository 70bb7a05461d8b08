"""Queries that map reads, run the K-value path with reads, and write files and read them back, each beside its SQL.

Roles: customers are genes of three exons, with an isoform of all (a) and one without the middle (b); orders are reads
on them, of one block or spliced, whose inner edges are up to six bases off.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import k_values, quantify
from .config import KValueSettings, QuantifySettings
from .driver_queries import JOINED, compat, exons as order_exons, query, table  # noqa: F401
from .operators import communities, condition, em, features, mapping, paths, readlen, shortread, supported
from .plans.scratch import merged, settle, shared_folder
from .sources import formats, sinks

PARTS = ((1, 100, "ab"), (301, 400, "a"), (601, 700, "ab"))


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def gene_exons(spark, sf_dir) -> DataFrame:
    k = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    rows = [F.struct(F.lit(i).alias("isoform"), F.lit(s).alias("s"), F.lit(e).alias("e")) for s, e, held in PARTS for i in held]
    one = k.select("k", F.explode(F.array(*rows)).alias("x"))
    return one.selectExpr(
        "'c' as chr", "cast(k as string) as gene", "concat(x.isoform, k) as isoform", "'+' as strand",
        "cast(1000 * k + x.s as long) as start", "cast(1000 * k + x.e as long) as end",
    )


def order_reads(spark, sf_dir) -> DataFrame:
    r = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "o_custkey as k", "o_orderkey % 3 as kind", "o_orderkey % 30 as off", "(o_orderkey div 3) % 13 - 6 as d", "20 + o_orderkey % 50 as len"
    )
    cigar = "case kind when 0 then concat(len, 'M') else concat(100 + d - off, 'M', if(kind = 1, 200, 500) - d, 'N', len, 'M') end"
    return r.selectExpr("cast(o_orderkey as string) as name", "0 as flag", "'c' as chr", "cast(1000 * k + 1 + off as long) as pos", "60 as mapq", f"{cigar} as cigar")


READS = """r AS (SELECT o_orderkey, o_custkey AS k, o_orderkey % 3 AS kind, o_orderkey % 30 AS off, (o_orderkey // 3) % 13 - 6 AS d, 20 + o_orderkey % 50 AS len FROM orders),
m AS (SELECT *, CASE kind WHEN 0 THEN '0' WHEN 1 THEN '0,1' ELSE '0,2' END AS path, 1000 * k + 1 + off AS r_start,
  CASE kind WHEN 0 THEN len ELSE 100 + d - off + len END AS read_length FROM r WHERE kind = 0 OR abs(d) <= 5),
n AS (SELECT k, path, count(*) AS n FROM m GROUP BY 1, 2),
rk AS (SELECT k, count(*) AS seen FROM n GROUP BY 1)"""


def model(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    x = gene_exons(spark, sf_dir)
    return x, *paths.laid_out(x)


def mapped_reads(spark, sf_dir, segs: DataFrame | None = None, iso_paths: DataFrame | None = None) -> DataFrame:
    """The reads as mapped, computed once; on the model's tables if they are given."""
    if segs is None:
        _, segs, iso_paths = model(spark, sf_dir)
    return settle(mapping.map_reads(order_reads(spark, sf_dir), paths.gene_segments(segs), iso_paths, QuantifySettings()))


# ---------------------------------------------------------------- mapping


@query(f"WITH {READS} SELECT o_orderkey::varchar AS name, k::varchar AS gene, path, cast(r_start AS bigint) AS r_start, cast(read_length AS bigint) AS read_length FROM m")
def map_reads(spark, sf_dir):
    got = mapped_reads(spark, sf_dir)
    return got.select("name", "gene", F.expr(JOINED).alias("path"), F.col("r_start").cast("long").alias("r_start"), F.col("read_length").cast("long").alias("read_length"))


@query("SELECT o_orderkey::varchar AS name FROM orders WHERE o_orderkey % 3 > 0 AND abs((o_orderkey // 3) % 13 - 6) > 5")
def rejected_reads(spark, sf_dir):
    return mapping.rejected_reads(order_reads(spark, sf_dir), mapped_reads(spark, sf_dir)).select("name")


@query(f"""WITH {READS}, i AS (SELECT *, 'a' AS i, 300 AS l FROM m WHERE kind < 2 UNION ALL SELECT *, 'b', 200 FROM m WHERE kind <> 1)
SELECT o_orderkey::varchar AS name, i || k AS isoform, cast(off + 1 AS bigint) AS off5, cast(greatest(l - off - 1 - read_length, 0) AS bigint) AS off3 FROM i""")
def read_isoforms(spark, sf_dir):
    x, _, iso_paths = model(spark, sf_dir)
    got = mapped_reads(spark, sf_dir)
    rows = mapping.isoform_offsets(got, paths.owners(got, iso_paths), paths.isoforms(x))
    return rows.select("name", "isoform", F.col("off5").cast("long").alias("off5"), F.col("off3").cast("long").alias("off3"))


@query("""SELECT l_orderkey AS name, l_linenumber::varchar AS gene, l_partkey AS at FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY md5(l_orderkey || ':' || l_linenumber), l_partkey) = 1""")
def pick_one(spark, sf_dir):
    """One of each order's lines, as one gene of a read's ties."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as name", "cast(l_linenumber as string) as gene", "array(l_partkey) as path")
    return mapping.pick_one(rows).select("name", "gene", F.col("path")[0].alias("at"))


# ---------------------------------------------------------------- regions by reads


@query(f"""WITH {READS}, w AS (SELECT c_custkey AS k, unnest(['0,1,2', '0,2']) AS path FROM customer),
u AS (SELECT k, path, n FROM n UNION ALL SELECT w.k, w.path, 0 FROM w LEFT JOIN rk ON rk.k = w.k WHERE coalesce(seen, 0) < 2 AND NOT EXISTS (SELECT 1 FROM n WHERE n.k = w.k AND n.path = w.path))
SELECT k::varchar AS gene, path, n, CASE path WHEN '0' THEN 'a' || k || '|b' || k WHEN '0,2' THEN 'b' || k ELSE 'a' || k END AS isoforms FROM u""")
def long_read_regions(spark, sf_dir):
    """Regions with reads; the whole paths of isoforms too where those don't have full rank."""
    _, segs, iso_paths = model(spark, sf_dir)
    got = supported.long_read_regions(mapped_reads(spark, sf_dir, segs, iso_paths), iso_paths, "nonfullrank")
    return got.select("gene", F.expr(JOINED).alias("path"), "n", F.array_join("isoforms", "|").alias("isoforms"))


def real_regions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    _, segs, iso_paths = model(spark, sf_dir)
    return paths.regions(iso_paths, segs, KValueSettings(region_selection="real_data")), iso_paths


@query(f"""WITH {READS}, w AS (SELECT c_custkey AS k, unnest(['0', '1', '2']) AS path FROM customer),
u AS (SELECT k, path, n FROM n UNION ALL SELECT w.k, w.path, 0 FROM w LEFT JOIN rk ON rk.k = w.k WHERE coalesce(seen, 0) < 2 AND NOT EXISTS (SELECT 1 FROM n WHERE n.k = w.k AND n.path = w.path))
SELECT k::varchar AS gene, path, n, round(n / CASE WHEN path LIKE '%,%' THEN 149.0::double ELSE 1.0::double END, 6) AS b FROM u""")
def short_read_regions(spark, sf_dir):
    """Regions with reads, of exons also without where those don't have full rank; and the abundance vector."""
    regions, iso_paths = real_regions(spark, sf_dir)
    got = supported.short_read_regions(regions, mapped_reads(spark, sf_dir), iso_paths, "real_data", "nonfullrank")
    b = supported.abundance(got, F.col("eff_len"))
    return got.join(b, ["chr", "gene", "path"]).select("gene", F.expr(JOINED).alias("path"), "n", F.round("b", 6).alias("b"))


@query(f"WITH {READS} SELECT k::varchar AS gene, seen >= 2 AS full FROM rk")
def rank_test(spark, sf_dir):
    _, _, iso_paths = model(spark, sf_dir)
    seen = supported.long_read_regions(mapped_reads(spark, sf_dir), iso_paths, "none")
    return supported.full_rank(seen, iso_paths).select("gene", "full")


@query(f"""WITH {READS} SELECT k::varchar AS gene, cast(sum(CASE WHEN path = '0' THEN 0 ELSE n END) AS bigint) AS n_unique, cast(sum(CASE WHEN path = '0' THEN n ELSE 0 END) AS bigint) AS n_multi FROM n GROUP BY k""")
def owner_counts(spark, sf_dir):
    rows = supported.long_read_regions(mapped_reads(spark, sf_dir), model(spark, sf_dir)[2], "none")
    return supported.counts_by_owner(rows).drop("chr")


@query(f"""WITH {READS}, c AS (SELECT k, path, unnest(CASE path WHEN '0' THEN ['a', 'b'] WHEN '0,1' THEN ['a'] ELSE ['b'] END) AS i FROM n),
w AS (SELECT *, CASE WHEN k % 2 = 1 THEN 1.0::double WHEN i = 'a' AND path = '0' THEN 2.0 WHEN i = 'a' THEN 1.0 WHEN path = '0,2' THEN 3.0 ELSE 0.0 END AS v FROM c)
SELECT k::varchar AS gene, path, i || k AS isoform, round(v / CASE WHEN sum(v) OVER (PARTITION BY k, i) = 0 THEN 1 ELSE sum(v) OVER (PARTITION BY k, i) END, 8) AS a FROM w""")
def weight_merge(spark, sf_dir):
    """The weights of every other gene put into the long-read matrix, by a Parquet table."""
    rows = supported.long_read_regions(mapped_reads(spark, sf_dir), model(spark, sf_dir)[2], "none")
    given = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(r).alias("region"), F.lit(w).alias("weight")) for i, r, w in (("a", "0", 2.0), ("a", "0,1", 1.0), ("b", "0,2", 3.0))])
    genes = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.explode(given).alias("x"))
    path = scratch(spark, "weights")
    genes.selectExpr("'c' as chr", "cast(k as string) as gene", "concat(x.i, k) as isoform", "x.region", "x.weight").write.parquet(path)
    got = supported.weighted(condition.entries(rows, F.lit(1.0), normalize=False), formats.region_weights(spark, path))
    return got.select("gene", F.expr(JOINED).alias("path"), "isoform", F.round("a", 8).alias("a"))


@query(f"""WITH {READS}, s AS (SELECT k, count(*) AS rows, count(*) FILTER (path <> '0,2') AS na, count(*) FILTER (path <> '0,1') AS nb, count(*) FILTER (path = '0') AS nab FROM n GROUP BY k),
g AS (SELECT *, CASE WHEN na = 0 THEN 0 ELSE 1.0::double / na END AS aa, CASE WHEN nb = 0 THEN 0 ELSE 1.0::double / nb END AS bb, CASE WHEN na * nb = 0 THEN 0 ELSE nab::double / (na * nb) END AS ab FROM s),
l AS (SELECT *, (aa + bb + sqrt(pow(aa - bb, 2) + 4 * ab * ab)) / 2 AS hi, (aa + bb - sqrt(pow(aa - bb, 2) + 4 * ab * ab)) / 2 AS lo FROM g)
SELECT c_custkey::varchar AS gene, 2::bigint AS num_isoforms, CASE WHEN rows IS NULL THEN NULL ELSE '(4, 2)' END AS sr_dim, '(' || rows || ', 2)' AS lr_dim,
  round(CASE WHEN lo < 1e-9 THEN 1.0 ELSE sqrt(hi / lo) END, 6) AS lr_generalized FROM customer LEFT JOIN l ON l.k = c_custkey""")
def kvalue_reads(spark, sf_dir):
    """K values of regions with long reads; genes without any have no numbers, of short reads either."""
    got = k_values(spark, gene_exons(spark, sf_dir), KValueSettings(full_length_regions="none"), long_reads=order_reads(spark, sf_dir))
    return got.genes.select("gene", "num_isoforms", "sr_dim", "lr_dim", F.round("lr_generalized", 6).alias("lr_generalized"))


@query(f"""WITH {READS}, c AS (SELECT k, path, unnest(CASE path WHEN '0' THEN ['a', 'b'] WHEN '0,1' THEN ['a'] ELSE ['b'] END) AS i, n FROM n)
SELECT k::varchar AS gene, CASE path WHEN '0' THEN '0,1' WHEN '0,1' THEN '0,1,2,3' ELSE '0,1,4,5' END AS region, (1000 * k + 1) || '-' || (1000 * k + 100) || CASE path WHEN '0' THEN '' WHEN '0,1' THEN ',' || (1000 * k + 301) || '-' || (1000 * k + 400) ELSE ',' || (1000 * k + 601) || '-' || (1000 * k + 700) END AS coordinates,
  i || k AS isoform, round(1.0::double / count(*) OVER (PARTITION BY k, i), 6) AS a, cast(n AS double) AS b FROM c""")
def matrix_info(spark, sf_dir):
    """The long-read matrices, their abundance vectors and coordinates, written by gene and read back."""
    got = k_values(spark, gene_exons(spark, sf_dir), KValueSettings(full_length_regions="none"), long_reads=order_reads(spark, sf_dir))
    path = scratch(spark, "matrix")
    rows = got.matrix_info().where("reads = 'LR'").withColumn("gene", F.concat(F.lit("g"), "gene"))
    sinks.write_matrix(rows.join(got.lr_matrix.select("chr", F.concat(F.lit("g"), "gene").alias("gene"), "isoform").distinct(), ["chr", "gene", "isoform"], "left_semi"), path)
    back = spark.read.parquet(path)
    plain = F.regexp_replace(F.regexp_replace("region", "[^0-9]+", ","), "^,|,$", "")
    return back.select(F.expr("substring(gene, 2)").alias("gene"), plain.alias("region"), "coordinates", "isoform", F.round("a", 6).alias("a"), "b")


# ---------------------------------------------------------------- abundance


def nation_sql(rounds: int) -> str:
    out = ["""WITH c AS (SELECT l_orderkey AS r, s_nationkey AS c, l_suppkey AS i, sum(l_quantity) AS p FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3),
t0 AS (SELECT s_nationkey AS c, s_suppkey AS i, 1.0::double / count(*) OVER (PARTITION BY s_nationkey) AS th FROM supplier)"""]
    for k in range(1, rounds + 1):
        out.append(f"""q{k} AS (SELECT c, i, sum(x) AS q FROM (SELECT c.c, c.i, p * th / sum(p * th) OVER (PARTITION BY r, c.c) AS x FROM c JOIN t{k - 1} t ON t.i = c.i) GROUP BY 1, 2),
t{k} AS (SELECT t.c, t.i, coalesce(q, 0) / sum(q) OVER (PARTITION BY t.c) AS th FROM t0 t LEFT JOIN q{k} q ON q.i = t.i)""")  # fmt: skip
    return ", ".join(out) + f" SELECT c::varchar AS community, i::varchar AS isoform, round(th, 7) AS theta FROM t{rounds}"


def nation_patterns(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    genes = table(spark, sf_dir, "supplier").selectExpr("cast(s_suppkey as string) as isoform", "cast(s_nationkey as string) as gene")
    rows = compat(spark, sf_dir).selectExpr("read", "cast(isoform as string) as isoform", "p").join(genes, "isoform")
    return genes, settle(communities.patterns(rows.selectExpr("concat(read, '-', gene) as name", "isoform", "p"), "p"))


def nation_em(spark, sf_dir, **options) -> DataFrame:
    genes, pats = nation_patterns(spark, sf_dir)
    s = QuantifySettings(relative_tolerance=0.0, tested_above=0.0, max_iterations=8, **options)
    got = em.run(communities.communities(genes, pats), pats, None, None, None, s)
    return got.select("community", "isoform", F.round("theta", 7).alias("theta"))


@query(nation_sql(8))
def em_rounds(spark, sf_dir):
    """Eight rounds in each nation's suppliers, a community by itself."""
    return nation_em(spark, sf_dir)


@query(nation_sql(8))
def em_rounds_as_tables(spark, sf_dir):
    """The same by the way that large communities go."""
    return nation_em(spark, sf_dir, em_rows_per_task=0)


@query("""WITH q AS (SELECT s_nationkey AS c, l_suppkey AS i, sum(l_quantity) AS q FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
n AS (SELECT s_nationkey AS c, count(DISTINCT l_orderkey) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1)
SELECT i AS isoform, round(n / sum_n * th * 1e6, 4) AS tpm FROM (SELECT q.i, n.n, (SELECT sum(n) FROM n)::double AS sum_n, q / sum(q) OVER (PARTITION BY q.c) AS th FROM q JOIN n USING (c))""")
def tpm_lr(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    q = rows.groupBy(F.col("s_nationkey").alias("c"), F.col("l_suppkey").alias("isoform")).agg(F.sum("l_quantity").alias("q"))
    n = rows.groupBy(F.col("s_nationkey").alias("c")).agg(F.countDistinct("l_orderkey").alias("n"))
    total = n.agg(F.sum("n").alias("sum_n"))
    held = em.proportions(q, ["c"]).join(n, "c").crossJoin(F.broadcast(total))  # one row
    return em.tpm_of_reads(held, F.col("n"), F.col("sum_n")).select("isoform", F.round("tpm", 4).alias("tpm"))


@query("""WITH q AS (SELECT s_nationkey AS c, s_suppkey AS i, 10.0 + s_suppkey % 13 AS eff, sum(l_quantity) AS q, count(*) AS k FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3),
t AS (SELECT *, q / sum(q) OVER (PARTITION BY c) AS th, sum(k) OVER (PARTITION BY c) AS n FROM q),
u AS (SELECT *, n * th / sum(th * eff) OVER (PARTITION BY c) AS u FROM t)
SELECT i AS isoform, round(sum(u) OVER (PARTITION BY c) / sum(u) OVER () * th * 1e6, 4) AS tpm FROM u""")
def tpm_hybrid(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey as isoform", "s_nationkey as community", "10.0D + s_suppkey % 13 as eff")
    q = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("isoform")).agg(F.sum("l_quantity").alias("q"), F.count("*").alias("k"))
    held = em.proportions(q.join(s, "isoform"), ["community"])
    reads = held.groupBy("community").agg(F.sum("k").alias("n"))
    return em.tpm_of_bases(held.join(reads, "community"), F.col("n")).select("isoform", F.round("tpm", 4).alias("tpm"))


@query("""SELECT coalesce(c_custkey, o_custkey) AS custkey, coalesce(cast(floor(c_acctbal) AS bigint), 0) AS iso_len, coalesce(n, 0) AS theta
FROM customer FULL JOIN (SELECT o_custkey + 7 AS o_custkey, cast(count(*) AS double) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey""")
def outer_fill(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") + 7).alias("isoform")).agg(F.count("*").cast("double").alias("theta"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("isoform"), F.floor("c_acctbal").alias("iso_len"))
    return readlen.with_expression(c, n).withColumnRenamed("isoform", "custkey")


@query("""WITH f AS (SELECT DISTINCT l_orderkey AS r, l_linenumber AS i, (l_orderkey + l_linenumber) % 50 + 1 AS t FROM lineitem WHERE l_orderkey % 5 <> 0),
k AS (SELECT r, i, count(*) OVER (PARTITION BY r) AS k FROM f)
SELECT 'i' || i AS isoform, round(sum(1.0 / k) / coalesce(any_value(10.0 + p_size), 1.0), 6) AS theta FROM k LEFT JOIN part ON p_partkey = i GROUP BY i""")
def short_fractional_counts(spark, sf_dir):
    """Short reads of a file, dealt evenly among their isoforms and over effective lengths."""
    eff = table(spark, sf_dir, "part").select(F.concat(F.lit("i"), "p_partkey").alias("isoform"), (10.0 + F.col("p_size")).alias("eff"))
    got = shortread.fractional_counts(formats.fragments(spark, short_sam(spark, sf_dir)), eff)
    return got.select("isoform", F.round("theta", 6).alias("theta"))


def two_isoform_sql(rounds: int) -> str:
    out = [f"""WITH {READS}, i AS (SELECT o_orderkey AS r, k, 'a' AS i, 300 AS l, off, read_length AS n FROM m WHERE kind < 2 UNION ALL SELECT o_orderkey, k, 'b', 200, off, read_length FROM m WHERE kind <> 1),
s AS (SELECT r, greatest(max(l - (off + 1) - greatest(l - off - 1 - n, 0)), 0) AS len FROM i GROUP BY 1),
w AS (SELECT i.r, k, i, CASE WHEN l - len + 1 <= 0 THEN 0 ELSE 1.0::double / (l - len + 1) END AS p FROM i JOIN s USING (r)),
t0 AS (SELECT c_custkey AS k, unnest(['a', 'b']) AS i, 0.5::double AS th FROM customer)"""]
    for k in range(1, rounds + 1):
        out.append(f"""q{k} AS (SELECT k, i, sum(x) AS q FROM (SELECT w.k, w.i, p * th / CASE WHEN sum(p * th) OVER (PARTITION BY r) = 0 THEN 1 ELSE sum(p * th) OVER (PARTITION BY r) END AS x FROM w JOIN t{k - 1} t ON t.k = w.k AND t.i = w.i) GROUP BY 1, 2),
t{k} AS (SELECT t.k, t.i, coalesce(q, 0) / coalesce(sum(q) OVER (PARTITION BY t.k), 1) AS th FROM t0 t LEFT JOIN q{k} q ON q.k = t.k AND q.i = t.i)""")  # fmt: skip
    return ", ".join(out) + f""", reads AS (SELECT k, count(DISTINCT r) AS n FROM w GROUP BY 1)
SELECT t.i || t.k AS "Isoform", t.k::varchar AS "Gene", round(coalesce(n, 0) / (SELECT sum(n) FROM reads)::double * th * 1e6, 3) AS tpm, round(th, 6) AS theta, t.k::varchar AS community, coalesce(n, 0) AS num_lrs
FROM t{rounds} t LEFT JOIN reads ON reads.k = t.k"""


@query(two_isoform_sql(6))
def abundance_files(spark, sf_dir):
    """Abundances from long reads, six rounds: the two files written and read back."""
    s = QuantifySettings(cond_prob="no_read_length", max_iterations=6, relative_tolerance=0.0, tested_above=0.0)
    path = scratch(spark, "abundance")
    quantify(spark, gene_exons(spark, sf_dir), order_reads(spark, sf_dir), settings=s).write(path)
    read = lambda name, schema: spark.read.csv(f"{path}/{name}", sep="\t", header=True, schema=schema)
    tpm = read("Isoform_abundance.out", "Isoform string, Gene string, TPM double")
    more = read("LR_EM_expression.out", "Isoform string, Gene string, t double, theta double, community string, community_num_LRs long")
    return merged(tpm).join(more.drop("Gene", "t"), "Isoform").select(
        "Isoform", "Gene", F.round("TPM", 3).alias("tpm"), F.round("theta", 6).alias("theta"), "community", F.col("community_num_LRs").alias("num_lrs")
    )


# ---------------------------------------------------------------- features


@query("""WITH c AS (SELECT c_nationkey AS community, count(*) AS genes, min(c_acctbal) AS lo, max(c_acctbal) AS hi, avg(c_acctbal) AS mean FROM customer GROUP BY 1),
o AS (SELECT c_nationkey AS community, count(*) AS n, max(o_totalprice) AS hi FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1)
SELECT community, cast(genes AS double) AS num_genes, round(lo, 2) AS lo, round(c.hi, 2) AS hi, round(mean, 4) AS mean, cast(coalesce(n, 0) AS double) AS num_lrs, round(coalesce(o.hi, 'nan'::double), 2) AS longest, 0.0::double AS num_srs
FROM c LEFT JOIN o USING (community)""")
def feature_join(spark, sf_dir):
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey as gene", "c_nationkey as community", "c_acctbal as value")
    o = table(spark, sf_dir, "orders").selectExpr("o_custkey as gene", "o_totalprice as value")
    got = features.community_features(c.select("gene", "community"), {"gene_length": c.select("gene", "value"), "unique_mapping_LRs": o})
    return got.select(
        "community", F.col("Num_genes").alias("num_genes"), F.round("Min_gene_length", 2).alias("lo"), F.round("Max_gene_length", 2).alias("hi"),
        F.round("Mean_gene_length", 4).alias("mean"), F.col("Num_mapping_LRs").alias("num_lrs"),
        F.round("Max_unique_mapping_LRs", 2).alias("longest"), F.col("Num_mapping_SRs").alias("num_srs"),
    )


@query("SELECT c_custkey::varchar AS community, c_nationkey::double AS error, (c_custkey % 21) / 20.0::double AS alpha FROM customer")
def alpha_argmin(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("community"),
        *[(F.col("c_custkey") % 21 if i == 0 else F.col("c_nationkey") if i == 1 else F.lit(0)).cast("double").alias(c) for i, c in enumerate(features.SELECTED)],
    )

    def errors(x):  # least where the first feature says, by as much as the second
        return (x[:, :1] - list(range(21))) ** 2 + x[:, 1:2]

    return features.predict_alpha(rows, errors)


@query("""SELECT l_suppkey, list_sort(list(l_quantity))[1 + count(*) // 2] AS median, list_sort(list(l_quantity))[1 + count(*) // 10] AS decile FROM lineitem GROUP BY 1""")
def length_quantiles(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity")
    return readlen.order_statistics(rows, "l_suppkey", "l_quantity", {"median": 2, "decile": 10})


# ---------------------------------------------------------------- files


def put_lines(lines: DataFrame, name: str) -> str:
    """The lines (value) as text files of a new folder."""
    path = scratch(lines.sparkSession, name)
    lines.write.text(path)
    return path


def gtf(spark, sf_dir) -> str:
    x = gene_exons(spark, sf_dir)
    line = lambda feature, a, b: F.concat_ws("\t", F.lit("chr7"), F.lit("src"), F.lit(feature), a, b, F.lit("."), F.lit("+"), F.lit("."), F.concat(F.lit('gene_id "'), "gene", F.lit('"; transcript_id "'), "isoform", F.lit('";')))  # noqa: E731, E501
    genes = x.groupBy("gene").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.lit("").alias("isoform"))
    odd = x.where("cast(gene as long) % 10 = 0").select(line("exon", F.col("end"), F.col("start")).alias("value"))  # start after end
    rows = x.select(line("exon", F.col("start"), F.col("end")).alias("value")).union(genes.select(line("gene", F.col("start"), F.col("end"))))
    return put_lines(rows.union(odd).union(spark.range(1).select(F.lit("# header"))), "gtf")


EXON_ROWS = """(SELECT c_custkey AS k, unnest([{'i': 'a', 's': 1, 'e': 100}, {'i': 'b', 's': 1, 'e': 100}, {'i': 'a', 's': 301, 'e': 400}, {'i': 'a', 's': 601, 'e': 700}, {'i': 'b', 's': 601, 'e': 700}]) AS x FROM customer)"""


@query(f"SELECT '7' AS chr, k::varchar AS gene, x.i || k AS isoform, '+' AS strand, 1000 * k + x.s AS first, 1000 * k + x.e AS last FROM {EXON_ROWS}")
def gtf_exons(spark, sf_dir):
    got = formats.exons(spark, gtf(spark, sf_dir))
    return got.select("chr", "gene", "isoform", "strand", F.col("start").cast("long").alias("first"), F.col("end").cast("long").alias("last"))


@query("SELECT 'chr7' AS chr, c_custkey::varchar AS gene, 1000 * c_custkey + 1 AS first, 1000 * c_custkey + 700 AS last FROM customer")
def gtf_genes(spark, sf_dir):
    got = formats.gene_ranges(spark, gtf(spark, sf_dir))
    return got.select("chr", "gene", F.col("start").cast("long").alias("first"), F.col("end").cast("long").alias("last"))


@query(f"SELECT 1000 * k + x.e AS first, 1000 * k + x.s AS last FROM {EXON_ROWS} WHERE k % 10 = 0")
def gtf_rejected(spark, sf_dir):
    got = formats.rejected_exons(spark, gtf(spark, sf_dir))
    return got.select(F.col("start").cast("long").alias("first"), F.col("end").cast("long").alias("last"))


def sam_line(*fields) -> Column:
    return F.concat_ws("\t", *[f.cast("string") for f in fields])


def sam(spark, sf_dir) -> str:
    r = table(spark, sf_dir, "lineitem")
    c = F.col
    line = sam_line(
        F.concat_ws("-", "l_orderkey", "l_linenumber"), (c("l_linenumber") * 256 + c("l_partkey")) % 4096, F.when(c("l_suppkey") % 7 == 0, "*").otherwise(F.concat(F.lit("chr"), c("l_suppkey"))),
        c("l_partkey"), c("l_suppkey") % 30, F.concat(c("l_quantity").cast("int"), F.lit("M")), F.lit("*"), F.lit(0), F.lit(0), F.lit("*"), F.lit("*"),
    )
    return put_lines(spark.range(1).select(F.lit("@HD\tVN:1.6").alias("value")).union(r.select(line)), "sam")


@query("""SELECT l_orderkey || '-' || l_linenumber AS name, cast((l_linenumber * 256 + l_partkey) % 4096 AS bigint) AS flag, l_suppkey::varchar AS chr, l_partkey AS pos, l_suppkey % 30 AS mapq, cast(l_quantity AS int) || 'M' AS cigar
FROM lineitem WHERE ((l_linenumber * 256 + l_partkey) % 4096) & 2820 = 0 AND l_suppkey % 30 >= 10 AND l_suppkey % 7 <> 0""")
def sam_alignments(spark, sf_dir):
    got = formats.alignments(spark, sam(spark, sf_dir), "unique_only")
    return got.select("name", F.col("flag").cast("long").alias("flag"), "chr", F.col("pos").cast("long").alias("pos"), F.col("mapq").cast("long").alias("mapq"), "cigar")


def short_sam(spark, sf_dir) -> str:
    c = F.col
    line = sam_line(
        c("l_orderkey"), F.lit(0), F.concat(F.lit("i"), c("l_linenumber"), F.lit("|x")), F.lit(1), F.lit(60), F.lit("9M2I5S"), F.lit("="), F.lit(1),
        F.expr("if(l_orderkey % 5 = 0, -1, 1) * ((l_orderkey + l_linenumber) % 50 + 1)"), F.lit("*"), F.lit("*"),
    )
    head = table(spark, sf_dir, "part").select(F.concat(F.lit("@SQ\tSN:i"), "p_partkey", F.lit("|more\tLN:"), "p_size").alias("value"))
    return put_lines(head.union(table(spark, sf_dir, "lineitem").select(line)), "short-sam")


@query("SELECT DISTINCT l_orderkey::varchar AS name, 'i' || l_linenumber AS isoform, (l_orderkey + l_linenumber) % 50 + 1 AS tlen FROM lineitem WHERE l_orderkey % 5 <> 0")
def sam_fragments(spark, sf_dir):
    got = formats.fragments(spark, short_sam(spark, sf_dir))
    return got.select("name", "isoform", F.col("tlen").cast("long").alias("tlen"))


@query("SELECT 'i' || p_partkey AS isoform, cast(p_size AS bigint) AS length FROM part")
def sam_header(spark, sf_dir):
    return formats.sequence_lengths(spark, short_sam(spark, sf_dir)).select("isoform", F.col("length").cast("long").alias("length"))


@query("""SELECT cast(l_quantity + l_linenumber AS bigint) AS n FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity LIMIT 1""")
def sniffed_length(spark, sf_dir):
    """The length of the first record of sorted files that has a CIGAR, here after records without."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    rows = table(spark, sf_dir, "lineitem").select(*order).orderBy(*order)
    line = lambda cigar: sam_line(F.col("l_orderkey"), F.lit(0), F.lit("i1"), F.lit(1), F.lit(60), cigar, F.lit("="), F.lit(1), F.lit(9), F.lit("*"), F.lit("*"))  # noqa: E731, E501
    cigar = F.concat(F.col("l_quantity").cast("int"), F.lit("M3N"), F.col("l_linenumber"), F.lit("S4H"))
    path = put_lines(rows.select(F.concat_ws("\n", F.lit("@CO\tnote"), line(F.lit("*")), line(cigar)).alias("value")), "sorted-sam")
    n = formats.first_read_length(spark, f"{path}/part-00000*")
    return spark.range(1).select(F.lit(n).cast("long").alias("n"))


@query("SELECT 'p' || p_partkey AS name, replace(p_type, ' ', '') || p_size AS sequence FROM part")
def fasta_records(spark, sf_dir):
    c = F.col
    value = F.concat(F.lit(">p"), c("p_partkey"), F.lit(" note\n"), F.substring("p_type", 1, 7), F.lit("\n"), F.expr("substring(p_type, 8)"), c("p_size"))
    return formats.fasta(spark, put_lines(table(spark, sf_dir, "part").select(value.alias("value")), "fasta"))


@query(f"SELECT x.i || k AS name, 'c' AS chrom, string_agg((1000 * k + x.s - 1)::varchar, ',' ORDER BY x.s) || ',' AS \"exonStarts\", string_agg((1000 * k + x.e)::varchar, ',' ORDER BY x.s) || ',' AS \"exonEnds\" FROM {EXON_ROWS} GROUP BY x.i, k")
def gene_pred(spark, sf_dir):
    return formats.gene_pred(paths.isoforms(gene_exons(spark, sf_dir))).select("name", "chrom", "exonStarts", "exonEnds")


@query("SELECT s_suppkey AS community, round(s_nationkey / 25.0::double, 4) AS alpha FROM supplier")
def alpha_table(spark, sf_dir):
    path = scratch(spark, "alpha")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit(0.5).alias("error"), (F.col("s_nationkey") / 25.0).alias("alpha"))
    sinks.write_tsv(rows, path, ["id"])
    return formats.alphas(spark, path).select("community", F.round("alpha", 4).alias("alpha"))


@query("SELECT 'p' || p_partkey AS isoform, round(p_retailprice, 2) AS value FROM part")
def quantifier_table(spark, sf_dir):
    path = scratch(spark, "tpm")
    sinks.write_tsv(table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey", F.lit("|long name")).alias("target_id"), F.col("p_retailprice").alias("tpm")), path)
    return formats.expression_table(spark, path).select("isoform", F.round("value", 2).alias("value"))


@query("SELECT cast(l_quantity AS bigint) AS read_len, count(*) AS n, cast(sum(l_linenumber) AS double) AS sm FROM lineitem GROUP BY 1")
def length_overrides(spark, sf_dir):
    path = scratch(spark, "lengths")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_quantity").cast("long").alias("read_len")).agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("sm"))
    rows.write.parquet(path)
    return formats.read_length_overrides(spark, path)


@query(f"""WITH {READS} SELECT c_custkey::varchar AS "Gene", 'c' AS "Chr", '2' AS "Num_isoforms", CASE WHEN seen IS NULL THEN 'NA' ELSE '(4, 2)' END AS "SR_A_dim", coalesce('(' || seen || ', 2)', 'NA') AS "LR_A_dim"
FROM customer LEFT JOIN rk ON k = c_custkey""")
def kvalue_files(spark, sf_dir):
    """The K-value tables as written, the one of genes read back as text."""
    got = k_values(spark, gene_exons(spark, sf_dir), KValueSettings(full_length_regions="none"), long_reads=order_reads(spark, sf_dir))
    path = scratch(spark, "kvalues")
    got.write(path)
    return spark.read.csv(f"{path}/kvalues_gene.out", sep="\t", header=True).select("Gene", "Chr", "Num_isoforms", "SR_A_dim", "LR_A_dim")
