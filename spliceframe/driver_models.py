"""Queries of the other estimators and of the read statistics, each beside its SQL. Roles as in driver_reads."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .api import k_values, region_abundance, write_region_abundance
from .config import KValueSettings, QuantifySettings
from .driver_queries import JOINED, RANGES, SLICES, exons as order_exons, query, table
from .driver_reads import READS, gene_exons, mapped_reads, model, order_reads, scratch
from .operators import density, global_em, intervals, least_squares, mapping, paths, readlen, supported
from .plans.scratch import merged, settle
from .sources import formats, sinks

# ---------------------------------------------------------------- least squares

#: Counts n0 (shared), n1 (isoform a alone) and n2 (b alone) of a gene, its matrix with columns that sum to 1 (the shared
#: region's cells are aa and ab, the others 1 - these), q and c of the normal equations, and the bounds by n1 and n2.
NORMAL = f"""{READS}, g AS (SELECT c_custkey AS k, coalesce(max(n) FILTER (path = '0'), 0) AS n0, coalesce(max(n) FILTER (path = '0,1'), 0) AS n1,
  coalesce(max(n) FILTER (path = '0,2'), 0) AS n2 FROM customer LEFT JOIN n ON n.k = c_custkey GROUP BY 1),
p AS (SELECT *, (n0 > 0)::int AS r0, (n1 > 0)::int AS r1, (n2 > 0)::int AS r2 FROM g),
a AS (SELECT *, CASE WHEN r0 + r1 = 0 THEN 0 ELSE 1.0::double / (r0 + r1) END AS va, CASE WHEN r0 + r2 = 0 THEN 0 ELSE 1.0::double / (r0 + r2) END AS vb FROM p),
q AS (SELECT *, (r0 + r1) * va * va + 0.01 AS qaa, (r0 + r2) * vb * vb + 0.01 AS qbb, r0 * va * vb AS qab, va * (n0 + n1) AS ca, vb * (n0 + n2) AS cb,
  CASE WHEN r1 = 1 THEN n1 / va ELSE 0 END AS la, CASE WHEN r2 = 1 THEN n2 / vb ELSE 0 END AS lb FROM a),
y AS (SELECT *, ca - qaa * la - qab * lb AS ya, cb - qab * la - qbb * lb AS yb, qaa * qbb - qab * qab AS det FROM q),
u AS (SELECT *, (ya * qbb - yb * qab) / det AS ua, (yb * qaa - ya * qab) / det AS ub FROM y),
x AS (SELECT *, la + CASE WHEN ua >= 0 AND ub >= 0 THEN ua WHEN ya > 0 AND yb - qab * ya / qaa <= 0 THEN ya / qaa ELSE 0 END AS xa,
  lb + CASE WHEN ua >= 0 AND ub >= 0 THEN ub WHEN ya > 0 AND yb - qab * ya / qaa <= 0 THEN 0 WHEN yb > 0 THEN yb / qbb ELSE 0 END AS xb FROM u),
t AS (SELECT *, xa / CASE WHEN xa + xb = 0 THEN 1 ELSE xa + xb END AS ta, xb / CASE WHEN xa + xb = 0 THEN 1 ELSE xa + xb END AS tb, n0 + n1 + n2 AS reads FROM x)"""


def counted_genes(spark, sf_dir):
    return k_values(spark, gene_exons(spark, sf_dir), KValueSettings(full_length_regions="none"), long_reads=order_reads(spark, sf_dir))


@query(f"""WITH {NORMAL}, o AS (SELECT k, unnest([{{'i': 'a', 't': ta}}, {{'i': 'b', 't': tb}}]) AS o, reads FROM t)
SELECT o.i || k AS isoform, round(o.t, 6) AS theta, round(o.t * reads, 4) AS expression, round(o.t * reads * 1e6 / sum(o.t * reads) OVER (), 4) AS tpm FROM o""")
def least_squares_total(spark, sf_dir) -> DataFrame:
    """Region counts of long reads as a bounded least-squares problem of each gene; shares of the gene's reads."""
    got = region_abundance(counted_genes(spark, sf_dir), beta=0.01)
    return got.select("isoform", *[F.round(c, d).alias(c) for c, d in (("theta", 6), ("expression", 4), ("tpm", 4))])


@query(f"""WITH {NORMAL}, z AS (SELECT *, n1 + n0 * CASE WHEN ta + tb = 0 THEN 0.5 ELSE va * ta / (va * ta + vb * tb) END AS ea FROM t),
o AS (SELECT k, unnest([{{'i': 'a', 'e': ea}}, {{'i': 'b', 'e': reads - ea}}]) AS o FROM z)
SELECT o.i || k AS isoform, round(o.e, 4) AS expression FROM o""")
def least_squares_reassigned(spark, sf_dir) -> DataFrame:
    """The same, with the reads of shared regions dealt by it."""
    got = region_abundance(counted_genes(spark, sf_dir), beta=0.01, assign="reassign")
    return got.select("isoform", F.round("expression", 4).alias("expression"))


@query(f"""WITH {NORMAL}, o AS (SELECT k, unnest([{{'i': 'a', 't': ta}}, {{'i': 'b', 't': tb}}]) AS o, reads FROM t)
SELECT o.i || k AS "Isoform", k::varchar AS "Gene", 1000 * k + 1 AS first, 1000 * k + 700 AS last, CASE o.i WHEN 'a' THEN 300 ELSE 200 END::bigint AS len,
  round(0.25 * coalesce(CASE o.i WHEN 'a' THEN p_retailprice END, 0) + 0.75 * o.t * reads * 1e6 / sum(o.t * reads) OVER (), 3) AS tpm FROM o LEFT JOIN part ON p_partkey = k""")
def expression_files(spark, sf_dir) -> DataFrame:
    """Least-squares abundances blended with a short-read quantifier's table, written and read back."""
    x, path = gene_exons(spark, sf_dir), scratch(spark, "expression")
    short = table(spark, sf_dir, "part").select(F.concat(F.lit("a"), "p_partkey", F.lit("|x")).alias("target_id"), F.col("p_retailprice").alias("tpm"))
    sinks.write_tsv(short, f"{path}/short")
    long = region_abundance(counted_genes(spark, sf_dir), beta=0.01)
    write_region_abundance(path, least_squares.blended(long, formats.expression_table(spark, f"{path}/short"), 0.75), x)
    schema = "Isoform string, Gene string, Chr string, Start long, End long, Isoform_length long, TPM double, Alpha double"
    back = spark.read.csv(f"{path}/expression_isoform.out", sep="\t", header=True, schema=schema)
    return back.select("Isoform", "Gene", F.col("Start").alias("first"), F.col("End").alias("last"), F.col("Isoform_length").alias("len"), F.round("TPM", 3).alias("tpm"))


@query(f"""WITH {READS}, g AS (SELECT k, max(read_length) AS longest FROM m GROUP BY 1), o AS (SELECT DISTINCT k, unnest(CASE path WHEN '0' THEN ['a', 'b'] WHEN '0,1' THEN ['a'] ELSE ['b'] END) AS i FROM n)
SELECT i || k AS isoform, CASE i WHEN 'a' THEN 240 ELSE 140 END::bigint AS len, cast(longest AS bigint) AS longest FROM o JOIN g USING (k) WHERE CASE i WHEN 'a' THEN 240 ELSE 140 END < longest""")
def short_isoforms(spark, sf_dir) -> DataFrame:
    """Isoforms (60 bases less than they are) shorter than their gene's longest read."""
    x, segs, iso_paths = model(spark, sf_dir)
    got = mapped_reads(spark, sf_dir, segs, iso_paths)
    iso = paths.isoforms(x).withColumn("length", F.col("length") - 60)
    rows = supported.short_isoforms(got, supported.long_read_regions(got, iso_paths, "none"), iso)
    return rows.select("isoform", F.col("length").cast("long").alias("len"), F.col("longest").cast("long").alias("longest"))


@query("""WITH m AS (SELECT s_nationkey AS g, l_orderkey AS r, l_suppkey AS i, sum(l_quantity) AS a FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3),
th AS (SELECT s_nationkey AS g, s_suppkey AS i, (s_suppkey % 3)::double AS th, min(CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey % 3 END) OVER (PARTITION BY s_nationkey) AS least,
  sum(s_suppkey % 3) OVER (PARTITION BY s_nationkey) AS every, count(*) OVER (PARTITION BY s_nationkey) AS k FROM supplier),
c AS (SELECT m.g, r, m.i, a, th, CASE WHEN every = 0 THEN 1.0::double / k ELSE th + 0.01 * least END AS up, (r % 9)::double AS b, count(*) OVER (PARTITION BY m.g, r) AS owners,
  sum(a * th) OVER (PARTITION BY m.g, r) AS den FROM m JOIN th ON th.i = m.i),
w AS (SELECT *, max(CASE WHEN owners > 1 AND b <> 0 AND den = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY g) AS weak FROM c),
d AS (SELECT g, i, CASE WHEN owners = 1 THEN b WHEN b = 0 THEN 0 ELSE b * a * CASE WHEN weak = 1 THEN up ELSE th END / sum(a * CASE WHEN weak = 1 THEN up ELSE th END) OVER (PARTITION BY g, r) END AS n FROM w)
SELECT th.i AS isoform, round(coalesce(sum(n), 0), 4) AS expression FROM th LEFT JOIN d ON d.i = th.i GROUP BY 1""")
def read_reassignment(spark, sf_dir) -> DataFrame:
    """Orders as regions of nations, suppliers as isoforms, of which a third have no expression yet."""
    gene = F.lit("c").alias("chr"), F.col("s_nationkey").cast("string").alias("gene")
    s = table(spark, sf_dir, "supplier").select(*gene, F.col("s_suppkey").alias("isoform"), (F.col("s_suppkey") % 3).cast("double").alias("theta"))
    rows = table(spark, sf_dir, "lineitem").join(s.withColumnRenamed("isoform", "l_suppkey"), "l_suppkey")
    matrix = rows.groupBy("chr", "gene", F.col("l_orderkey").alias("path"), F.col("l_suppkey").alias("isoform")).agg(F.sum("l_quantity").alias("a"))
    b = matrix.select("chr", "gene", "path").distinct().withColumn("b", (F.col("path") % 9).cast("double"))
    got = least_squares.reassign(s, matrix, b)
    return got.select("isoform", F.round("expression", 4).alias("expression"))


# ---------------------------------------------------------------- K values of pairs


PAIRS = SLICES.replace("o_orderpriority AS isoform", "(o_orderkey % 2)::varchar AS isoform")


@query(f"""WITH {PAIRS}, g AS (SELECT gene, path, any_value(len) AS len, any_value(first) AS first, any_value(last) AS last, any_value(inner_len) AS il, any_value(j - i + 1) AS n,
  max((isoform = '0')::int) AS i0, max((isoform = '1')::int) AS i1 FROM named GROUP BY 1, 2),
r AS (SELECT gene, i0, i1, greatest(1, CASE n WHEN 1 THEN CASE WHEN 150 < len THEN len - 149 ELSE 1 END WHEN 2 THEN 149 ELSE 149 - il END)::double AS w
  FROM g WHERE len > 150 AND (n = 1 OR (first > 1 AND last > 1 AND (n = 2 OR il + 2 <= 150)))),
c AS (SELECT gene, count(*) AS rows, sum(w * i0) AS c0, sum(w * i1) AS c1, sum(w * w * i0) AS s0, sum(w * w * i1) AS s1, sum(w * w * i0 * i1) AS s01 FROM r GROUP BY 1),
q AS (SELECT gene, rows, CASE WHEN c0 = 0 THEN 0 ELSE s0 / (c0 * c0) END AS aa, CASE WHEN c1 = 0 THEN 0 ELSE s1 / (c1 * c1) END AS bb, CASE WHEN c0 * c1 = 0 THEN 0 ELSE s01 / (c0 * c1) END AS ab FROM c),
l AS (SELECT *, (aa + bb + sqrt(pow(aa - bb, 2) + 4 * ab * ab)) / 2 AS hi, (aa * bb - ab * ab) / ((aa + bb + sqrt(pow(aa - bb, 2) + 4 * ab * ab)) / 2) AS lo FROM q),
i AS (SELECT gene, count(DISTINCT isoform) AS num_isoforms FROM exons GROUP BY 1)
SELECT i.gene, num_isoforms, cast(rows AS bigint) AS num_regions, CASE WHEN rows IS NULL THEN NULL WHEN lo < 1e-9 * hi THEN 1.0 ELSE round(sqrt(hi / lo), 4) END AS kvalue FROM i LEFT JOIN l ON l.gene = i.gene""")
def kvalue_pairs(spark, sf_dir) -> DataFrame:
    """K values of all genes, whose exons are dealt to two isoforms, from effective lengths."""
    got = k_values(spark, pair_exons(spark, sf_dir))
    rows = got.regions.where("size(isoforms) > 0").groupBy("chr", "gene").agg(F.count("*").alias("num_regions"))  # a row for each path
    return got.genes.join(rows, ["chr", "gene"], "left").select("gene", "num_isoforms", "num_regions", F.round("sr_generalized", 4).alias("kvalue"))


def pair_exons(spark, sf_dir) -> DataFrame:
    day = "datediff(o_orderdate, date'1970-01-01')"
    return table(spark, sf_dir, "orders").selectExpr(
        "'c' as chr", "cast(o_custkey as string) as gene", "cast(o_orderkey % 2 as string) as isoform", "'+' as strand", f"{day} as start", f"{day} + cast(o_orderkey % 400 as int) as end"
    )


# ---------------------------------------------------------------- reads on several genes

TWINS = "r AS (SELECT o_orderkey, o_custkey AS k, o_orderkey % 3 AS kind, (o_orderkey // 3) % 13 - 6 AS d FROM orders), m AS (SELECT *, CASE kind WHEN 0 THEN '0' WHEN 1 THEN '0,1' ELSE '0,2' END AS path FROM r WHERE kind = 0 OR abs(d) <= 5)"


@query(f"WITH {TWINS} SELECT o_orderkey::varchar AS name, k::varchar AS gene, path FROM m UNION ALL SELECT o_orderkey::varchar, 't' || k, path FROM m WHERE k % 2 = 0")
def mapped_ties(spark, sf_dir) -> DataFrame:
    """Reads of genes that stand twice are on both."""
    x = gene_exons(spark, sf_dir)
    twins = x.where("cast(gene as long) % 2 = 0").withColumns({"gene": F.concat(F.lit("t"), "gene"), "isoform": F.concat(F.lit("t"), "isoform")})
    x = x.unionByName(twins)
    segs, iso_paths = paths.laid_out(x)
    got = mapping.map_reads(order_reads(spark, sf_dir), paths.gene_segments(segs), iso_paths, QuantifySettings())
    return got.select("name", "gene", F.expr(JOINED).alias("path"))


# ---------------------------------------------------------------- EM of all isoforms together


def theta_sql(rounds: int) -> str:
    out = ["""WITH iso AS (SELECT p_partkey AS i, cast(p_size + 30 AS bigint) AS iso_len FROM part),
m AS (SELECT DISTINCT l_orderkey AS r, iso.i, iso_len FROM lineitem JOIN iso ON iso.i = l_suppkey * 20),
l AS (SELECT l_orderkey AS r, max(cast(l_quantity AS bigint)) AS read_len FROM lineitem JOIN iso ON iso.i = l_suppkey * 20 GROUP BY 1),
h AS (SELECT read_len, count(*) AS n FROM l GROUP BY 1), total AS (SELECT sum(n)::double AS total FROM h),
c AS (SELECT i, iso_len, (SELECT sum(n) FROM h WHERE read_len <= iso_len) / total AS cdf FROM iso, total),
b AS (SELECT m.r, m.i, l.read_len, h.n / total / cdf AS base, m.iso_len - l.read_len + 1 AS places FROM m JOIN l USING (r) JOIN h USING (read_len) JOIN c ON c.i = m.i, total),
f AS (SELECT i, sum(1.0::double / k) AS x FROM (SELECT r, i, count(*) OVER (PARTITION BY r) AS k FROM m) GROUP BY 1),
t0 AS (SELECT iso.i, iso_len, coalesce(x, 0) / (SELECT sum(x) FROM f) AS th FROM iso LEFT JOIN f ON f.i = iso.i)"""]
    for k in range(1, rounds + 1):
        out.append(f"""s{k} AS (SELECT read_len, sum(th / cdf) AS sm FROM h, c JOIN t{k - 1} USING (i) WHERE c.iso_len >= read_len GROUP BY 1),
p{k} AS (SELECT b.r, b.i, CASE WHEN places > 0 THEN base / sm / places * th ELSE 0 END AS p FROM b JOIN s{k} USING (read_len) JOIN t{k - 1} t ON t.i = b.i),
q{k} AS (SELECT i, sum(x) AS q FROM (SELECT i, p / CASE WHEN sum(p) OVER (PARTITION BY r) = 0 THEN 1 ELSE sum(p) OVER (PARTITION BY r) END AS x FROM p{k}) GROUP BY 1),
t{k} AS (SELECT t.i, iso_len, coalesce(q, 0) / (SELECT sum(q) FROM q{k}) AS th FROM t{k - 1} t LEFT JOIN q{k} q ON q.i = t.i)""")  # fmt: skip
    return ", ".join(out) + f" SELECT i AS isoform, round(th, 8) AS theta FROM t{rounds}"


@query(theta_sql(3))
def em_theta_k3(spark, sf_dir) -> DataFrame:
    """Three rounds with suffix sums made anew in each: orders as reads of their largest quantity, parts as isoforms."""
    iso = table(spark, sf_dir, "part").selectExpr("p_partkey as isoform", "cast(p_size + 30 as bigint) as iso_len")
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as name", "l_suppkey * 20 as isoform", "cast(l_quantity as bigint) as q")
    read_iso = merged(rows).join(merged(iso), "isoform").selectExpr("name", "isoform", "iso_len", "0L as off5", "iso_len - q as off3")
    sets = settle(global_em.length_sets(read_iso))
    hist = settle(sets.groupBy("read_len").agg(F.sum("n").alias("n")))
    start = settle(global_em.starting_theta(iso, "LR", lr=settle(global_em.shared_counts(sets))))
    found, _ = global_em.iterate(sets, readlen.cdf_at(hist, iso, "iso_len"), hist, start, rounds=3, tolerance=0.0)
    return found.select("isoform", F.round("theta", 8).alias("theta"))


@query("""WITH g AS (SELECT p_partkey AS i, -ln((('0x' || substr(md5(p_partkey || '-7'), 1, 12))::bigint + 0.5::double) / 281474976710656.0::double) AS x FROM part),
r AS (SELECT i, x / sum(x) OVER () * (SELECT sum(l_quantity) FROM lineitem) AS n FROM g)
SELECT i AS isoform, round((n + 2.5) / sum(n + 2.5) OVER (), 10) AS theta FROM r""")
def theta_random_start(spark, sf_dir) -> DataFrame:
    """A seeded draw as counts of all reads, raised by a pseudo-count."""
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("isoform")).agg(F.sum("l_quantity").alias("theta"))
    got = global_em.starting_theta(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("isoform")), "random", lr=n, strategy="add_eps", pseudo=2.5, seed=7)
    return got.select("isoform", F.round("theta", 10).alias("theta"))


@query("""WITH l AS (SELECT l_suppkey AS i, count(*)::double AS n FROM lineitem GROUP BY 1), s AS (SELECT s_suppkey AS i, coalesce(n, 0) AS lr, s_acctbal::double AS b FROM supplier LEFT JOIN l ON l.i = s_suppkey),
p AS (SELECT i, lr, CASE WHEN b > 0 THEN b ELSE 0 END AS sr FROM s),
u AS (SELECT i, lr + CASE WHEN lr / sum(lr) OVER () < 0.01 THEN 3 ELSE 0 END AS lr, sr + CASE WHEN sr / sum(sr) OVER () < 0.01 THEN 3 ELSE 0 END AS sr FROM p)
SELECT i AS isoform, round((lr / sum(lr) OVER () + sr / sum(sr) OVER ()) / 2, 8) AS theta FROM u""")
def theta_hybrid_start(spark, sf_dir) -> DataFrame:
    """The mean of two kinds of counts, of which small shares are raised."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("isoform"), F.greatest("s_acctbal", F.lit(0.0)).alias("theta"))
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("isoform")).agg(F.count("*").cast("double").alias("theta"))
    got = global_em.starting_theta(s, "hybrid", n, s, "add_eps_small", 0.01, 3.0)
    return got.select("isoform", F.round("theta", 8).alias("theta"))


@query("""WITH m AS (SELECT l_orderkey || '-' || l_linenumber AS name, l_suppkey AS i, l_suppkey % 10 * 10 + 50 AS l, cast(l_quantity AS bigint) % 8 AS a, l_linenumber AS b FROM lineitem),
s AS (SELECT (50 + p_partkey % 90) * 1.004 AS l, p_size % 9 + (p_partkey % 3) * 0.4 AS a, p_partkey % 8 + (p_partkey % 2) * 0.5 AS b FROM part),
h AS (SELECT cast(l_quantity AS bigint) + 30 AS len, count(*) AS n FROM lineitem GROUP BY 1),
w AS (SELECT ml.l, s.a, s.b FROM (SELECT DISTINCT l FROM m) ml JOIN s ON abs(s.l - ml.l) < 0.01 * ml.l),
t AS (SELECT l, count(*) AS total FROM w GROUP BY 1), o AS (SELECT DISTINCT l, a, b FROM m),
k AS (SELECT o.l, o.a, o.b, count(*) AS k FROM o JOIN w ON w.l = o.l AND abs(w.a - o.a) < 1 AND abs(w.b - o.b) < 1 GROUP BY 1, 2, 3)
SELECT name, i AS isoform, round(CASE WHEN total IS NULL THEN coalesce(h.n, 0) / coalesce((SELECT sum(n) FROM h WHERE len < m.l), 1)::double ELSE coalesce(k, 0) / total::double / 4 END, 9) AS p
FROM m LEFT JOIN t ON t.l = m.l LEFT JOIN k ON k.l = m.l AND k.a = m.a AND k.b = m.b LEFT JOIN h ON h.len = m.l - m.a - m.b""")
def cond_prob_sampled(spark, sf_dir) -> DataFrame:
    """Probabilities by the share of samples near a read's place on an isoform; parts are samples."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("concat(l_orderkey, '-', l_linenumber) as name", "l_suppkey as isoform", "l_suppkey % 10 * 10 + 50 as iso_len", "cast(l_quantity as bigint) % 8 as off5", "cast(l_linenumber as bigint) as off3")
    samples = table(spark, sf_dir, "part").selectExpr("(50 + p_partkey % 90) * 1.004 as iso_len", "p_size % 9 + (p_partkey % 3) * 0.4 as off5", "p_partkey % 8 + (p_partkey % 2) * 0.5 as off3")
    lengths = table(spark, sf_dir, "lineitem").groupBy((F.col("l_quantity").cast("long") + 30).alias("read_len")).agg(F.count("*").alias("n"))
    return global_em.sampled_probabilities(rows, samples, lengths).select("name", "isoform", F.round("p", 9).alias("p"))


@query("""WITH m AS (SELECT l_orderkey || '-' || l_linenumber AS name, l_suppkey AS i, l_suppkey % 10 * 10 + 50 AS l, cast(l_quantity AS bigint) AS a, l_linenumber AS b FROM lineitem),
t AS (SELECT s_suppkey % 10 * 10 + 50 AS l, sum(s_suppkey % 4) / (SELECT sum(s_suppkey % 4) FROM supplier)::double AS share FROM supplier WHERE s_suppkey IN (SELECT i FROM m) GROUP BY 1)
SELECT name, i AS isoform, round(CASE WHEN share > 0 THEN exp(-0.5 * (pow((m.l - 90) / 30.0, 2) + pow((a - 20) / 9.0, 2) + pow((b - 3) / 2.0, 2)) - ln(30 * 9 * 2)) / share ELSE 0 END, 9) AS p FROM m JOIN t ON t.l = m.l""")
def cond_prob_scored(spark, sf_dir) -> DataFrame:
    """Probabilities by a density model, here a Gaussian kernel of one sample."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("concat(l_orderkey, '-', l_linenumber) as name", "l_suppkey as isoform", "l_suppkey % 10 * 10 + 50 as iso_len", "cast(l_quantity as bigint) as off5", "cast(l_linenumber as bigint) as off3")
    theta = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("isoform"), (F.col("s_suppkey") % 4).alias("n"))
    theta = theta.crossJoin(F.broadcast(theta.agg(F.sum("n").alias("total")))).select("isoform", (F.col("n") / F.col("total")).alias("theta"))  # one row

    def score(x):
        return -0.5 * (((x - [90, 20, 3]) / [30, 9, 2]) ** 2).sum(axis=1) - np.log(30 * 9 * 2)

    return global_em.scored_probabilities(rows, theta, score).select("name", "isoform", F.round("p", 9).alias("p"))


# ---------------------------------------------------------------- densities


def kernel_sql(distance: str, width: float) -> str:
    return f"exp(-0.5 * pow(({distance}) / {width}::double, 2)) / ({width}::double * sqrt(2 * pi()))"


DENSITY = f"""s AS (SELECT l_partkey * 7 % 1500 + 1 AS a, cast(l_quantity AS bigint) * 8 AS b, count(*) AS n FROM lineitem GROUP BY 1, 2),
w AS (SELECT l, b, sum(n * {kernel_sql("l - a", 40.0)}) AS w FROM lens JOIN s ON l BETWEEN a - 160 AND a + 160 GROUP BY 1, 2),
d AS (SELECT l, t, sum(w * {kernel_sql("t - b", 10.0)}) / (SELECT count(*) FROM lineitem) AS d FROM w JOIN range(1, 441) r(t) ON t BETWEEN b - 40 AND b + 40 GROUP BY 1, 2)"""


def read_density_of(spark, sf_dir, lengths: DataFrame) -> DataFrame:
    samples = table(spark, sf_dir, "lineitem").groupBy(F.expr("l_partkey * 7 % 1500 + 1").alias("iso_len"), F.expr("cast(l_quantity as bigint) * 8").alias("read_len")).agg(F.count("*").alias("n"))
    return density.density(samples, lengths, 40.0, 10.0)


@query(f"WITH lens AS (SELECT DISTINCT cast(p_size * 29 AS bigint) AS l FROM part), {DENSITY} SELECT l AS iso_len, t AS read_len, round(d, 12) AS d FROM d")
def read_density(spark, sf_dir) -> DataFrame:
    """Density of line items' quantities as read lengths, at isoform lengths from parts' sizes."""
    got = read_density_of(spark, sf_dir, table(spark, sf_dir, "part").select((F.col("p_size") * 29).cast("long").alias("iso_len")))
    return got.select("iso_len", F.col("read_len").cast("long").alias("read_len"), F.round("d", 12).alias("d"))


@query(f"""WITH {SLICES}, il AS (SELECT gene, isoform, cast(sum(e - s + 1) AS bigint) AS l FROM exons GROUP BY 1, 2), lens AS (SELECT DISTINCT l FROM il), {DENSITY},
g AS (SELECT DISTINCT gene, isoform, path, len, first, last, inner_len AS il, j - i + 1 AS k, least(first, last) AS lo, greatest(first, last) AS hi FROM named
  WHERE len > 150 AND (j = i OR (first > 1 AND last > 1 AND (j - i = 1 OR inner_len + 2 <= 150)))),
p AS (SELECT g.gene, g.isoform, path, d * CASE WHEN k = 1 THEN CASE WHEN t <= len THEN len - t + 1 ELSE 0 END
    WHEN t >= g.il + hi + 2 AND t <= first + last + g.il THEN first + last + g.il - t + 1 WHEN t >= g.il + lo + 1 AND t <= g.il + hi + 1 THEN lo
    WHEN t >= g.il + 2 AND t <= g.il + lo THEN t - 1 - g.il ELSE 0 END AS x FROM g JOIN il ON il.gene = g.gene AND il.isoform = g.isoform LEFT JOIN d ON d.l = il.l)
SELECT gene, isoform, path AS region, round(coalesce(sum(x), 0), 8) AS weight FROM p GROUP BY 1, 2, 3""")
def density_region_weights(spark, sf_dir) -> DataFrame:
    """The weights of regions by that density, from running sums."""
    x = order_exons(spark, sf_dir)
    iso = settle(paths.isoforms(x).select(*paths.GENE, "isoform", "length"))  # no chr that is a constant: joins then keep regions where they are
    segs, iso_paths = paths.laid_out(x)
    regions = paths.regions(iso_paths, segs, KValueSettings())
    held = read_density_of(spark, sf_dir, iso.select(F.col("length").cast("long").alias("iso_len")))
    return density.region_weights(regions, iso, held).select("gene", "isoform", "region", F.round("weight", 8).alias("weight"))


# ---------------------------------------------------------------- lookups and statistics


@query("""WITH b AS (SELECT o_orderkey, o_orderkey % 20 AS chr, o_orderkey * 3 AS s, o_orderkey * 3 + o_orderkey % 40 AS e FROM orders)
SELECT event_id, b.s AS first, b.e AS last, b.o_orderkey FROM events LEFT JOIN b ON b.chr = user_id % 20 AND event_id * 5 BETWEEN b.s AND b.e""")
def bracket_lookup(spark, sf_dir) -> DataFrame:
    """The disjoint bracket of each point, by one sorted pass."""
    brackets = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderkey % 20 as chr", "o_orderkey * 3 as start", "o_orderkey * 3 + o_orderkey % 40 as end")
    points = table(spark, sf_dir, "events").selectExpr("event_id", "user_id % 20 as chr", "event_id * 5 as at")
    got = intervals.bracket_of(points, brackets, ["chr"], values=["o_orderkey"])
    return got.select("event_id", F.col("start").alias("first"), F.col("end").alias("last"), "o_orderkey")


BEST = f"""{RANGES}, p AS (SELECT event_id, user_id % 20 AS chr, event_id AS pos, event_id % 90 + 1 AS len FROM events),
o AS (SELECT event_id, p.chr, o_orderkey::varchar AS gene, ge - gs + 1 + len - (greatest(pos + len, ge) - least(pos, gs) + 1) AS shared FROM p JOIN g ON p.chr = g.chr AND gs < pos + len AND ge + 1 > pos),
best AS (SELECT * FROM o WHERE shared > 0 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY shared DESC, gene) = 1)"""


def reads_and_genes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    reads = table(spark, sf_dir, "events").selectExpr("event_id as name", "user_id % 20 as chr", "event_id as pos", "event_id % 90 + 1 as length")
    genes = table(spark, sf_dir, "orders").selectExpr("o_custkey % 20 as chr", "cast(o_orderkey as string) as gene", "o_orderkey as start", "o_orderkey + 40 + o_orderkey % 50 as end")
    return reads, genes


@query(f"WITH {BEST} SELECT event_id, gene, shared FROM best")
def best_overlap_gene(spark, sf_dir) -> DataFrame:
    """The gene that a read shares most bases with."""
    return mapping.best_gene(*reads_and_genes(spark, sf_dir)).select(F.col("name").alias("event_id"), "gene", F.col("overlap").alias("shared"))


@query(f"WITH {BEST} SELECT chr, gene, list_sort(list(shared))[1 + count(*) // 10] AS decile FROM best GROUP BY 1, 2")
def gene_overlap_decile(spark, sf_dir) -> DataFrame:
    """The lowest decile of those overlaps, by gene."""
    return mapping.least_overlaps(*reads_and_genes(spark, sf_dir))


OWNED = f"{SLICES}, x AS (SELECT gene, isoform, path, j - i + 1 AS k, max(j - i + 1) OVER (PARTITION BY gene, isoform) AS most, min(string_split(path, ',')::int[]) OVER (PARTITION BY gene, isoform) AS least, len FROM named)"


@query(f"WITH {OWNED} SELECT DISTINCT gene, path FROM x WHERE CASE WHEN most > 1 THEN k >= most - 1 ELSE string_split(path, ',')::int[] = least END")
def near_maximal_regions(spark, sf_dir) -> DataFrame:
    """Regions within one segment of the longest of an isoform."""
    x = order_exons(spark, sf_dir)
    segs = paths.segments(x)
    return paths.near_maximal(paths.slices(paths.paths(segs, x), segs)).select("gene", F.expr(JOINED).alias("path"))


@query(f"""WITH {OWNED}, r AS (SELECT gene, path, any_value(len) % 5 AS n, count(DISTINCT isoform) AS owners, median(most - k) AS distance FROM x GROUP BY 1, 2)
SELECT CASE WHEN owners > 1 THEN 'multi' ELSE 'unique' END AS kind, distance, cast(sum(n) AS bigint) AS n FROM r WHERE n > 0 GROUP BY 1, 2""")
def segment_distances(spark, sf_dir) -> DataFrame:
    """Reads (of a number by the region's length) by how far their region is from whole."""
    x = order_exons(spark, sf_dir)
    segs = paths.segments(x)
    return supported.segment_distances(paths.slices(paths.paths(segs, x), segs).withColumn("n", F.col("len") % 5))
