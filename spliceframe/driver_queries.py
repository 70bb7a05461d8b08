"""Queries over the driver's tables that run the library's operators, each beside its DuckDB SQL.

Roles: orders are exons (gene o_custkey, isoform o_orderpriority, start the order's day, length from its key); line
items are reads (read l_orderkey, isoform l_suppkey, weight l_quantity); events are read placements.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import KValueSettings, QuantifySettings
from .functions import columns as C
from .operators import communities, condition, em, features, intervals, mapping, paths, readlen, shortread
from .plans.scratch import merged, settle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "'c' as chr", "cast(o_custkey as string) as gene", "o_orderpriority as isoform", "'+' as strand",
        "datediff(o_orderdate, date'1970-01-01') as start",
        "datediff(o_orderdate, date'1970-01-01') + cast(o_orderkey % 400 as int) as end",
    )


EXONS = """exons AS (SELECT cast(o_custkey AS varchar) AS gene, o_orderpriority AS isoform,
  datediff('day', DATE '1970-01-01', o_orderdate::DATE) AS s,
  datediff('day', DATE '1970-01-01', o_orderdate::DATE) + o_orderkey % 400 AS e FROM orders)"""
SEGMENTS = (
    EXONS
    + """, marks AS (SELECT gene, s AS x FROM exons UNION SELECT gene, e + 1 FROM exons),
cuts AS (SELECT gene, x AS s, lead(x) OVER (PARTITION BY gene ORDER BY x) - 1 AS e FROM marks),
held AS (SELECT gene, s, e FROM cuts WHERE e > s AND EXISTS (SELECT 1 FROM exons x WHERE x.gene = cuts.gene AND x.s <= cuts.s AND x.e >= cuts.e)),
segs AS (SELECT gene, row_number() OVER (PARTITION BY gene ORDER BY s) - 1 AS seg, s, e, e - s + 1 AS len FROM held)"""
)
MEMBERS = (
    SEGMENTS
    + """, mem AS (SELECT DISTINCT segs.gene, isoform, seg, segs.s, segs.e, len FROM segs JOIN exons x ON segs.gene = x.gene AND segs.s >= x.s AND segs.e <= x.e),
pos AS (SELECT *, row_number() OVER (PARTITION BY gene, isoform ORDER BY seg) AS k,
  sum(len) OVER (PARTITION BY gene, isoform ORDER BY seg) AS upto FROM mem)"""
)
SLICES = (
    MEMBERS
    + """, spans AS (SELECT a.gene, a.isoform, a.k AS i, b.k AS j, a.len AS first, b.len AS last, b.upto - a.upto + a.len AS len,
  CASE WHEN b.k - a.k > 1 THEN b.upto - b.len - a.upto ELSE 0 END AS inner_len
  FROM pos a JOIN pos b ON a.gene = b.gene AND a.isoform = b.isoform AND a.k <= b.k),
named AS (SELECT spans.*, (SELECT string_agg(p.seg::varchar, ',' ORDER BY p.k) FROM pos p
  WHERE p.gene = spans.gene AND p.isoform = spans.isoform AND p.k BETWEEN i AND j) AS path FROM spans)"""
)
JOINED = "array_join(cast(path as array<string>), ',')"

# ---------------------------------------------------------------- scalar functions


def described(part: DataFrame) -> DataFrame:
    return part.withColumn(
        "text", F.format_string('level %d; gene_id "%s"; transcript_id "%s"; type "%s";', "p_size", "p_brand", "p_name", "p_type")
    )


@query("""SELECT p_partkey, nullif(regexp_extract(t, '(?:^|[\\s;])gene_id "([^"]*)"', 1), '') AS gene,
  nullif(regexp_extract(t, '(?:^|[\\s;])transcript_id "([^"]*)"', 1), '') AS isoform
FROM (SELECT p_partkey, 'gene_id "' || p_brand || '"; transcript_id "' || p_name || '";' AS t FROM part)""")
def attr_extract(spark, sf_dir):
    t = F.col("text")
    return described(table(spark, sf_dir, "part")).select(
        "p_partkey", C.attribute(t, "gene_id").alias("gene"), C.attribute(t, "transcript_id").alias("isoform")
    )


@query("""SELECT p_partkey, len(regexp_extract_all(t, '[A-Za-z_]+ "[^"]*"')) AS n, regexp_extract(t, ' type "([^"]*)"', 1) AS kind
FROM (SELECT p_partkey, 'level ' || p_size || '; gene_id "' || p_brand || '"; transcript_id "' || p_name || '"; type "' || p_type || '";' AS t FROM part)""")
def attr_map(spark, sf_dir):
    m = C.attributes(F.col("text"))
    return described(table(spark, sf_dir, "part")).select("p_partkey", F.size(m).alias("n"), m["type"].alias("kind"))


@query("""WITH n AS (SELECT 'chr' || n_nationkey AS name FROM nation UNION ALL SELECT n_name FROM nation
  UNION ALL SELECT 'Chr' || n_nationkey || '_x' FROM nation UNION ALL SELECT cast(n_nationkey AS varchar) FROM nation)
SELECT name, CASE WHEN regexp_full_match(CASE WHEN upper(name) LIKE '%CHR%' THEN regexp_extract(upper(name), 'CHR(.*)', 1) ELSE upper(name) END, '[0-9]+')
  THEN CASE WHEN upper(name) LIKE '%CHR%' THEN regexp_extract(upper(name), 'CHR(.*)', 1) ELSE upper(name) END ELSE name END AS contig FROM n""")
def contig_canon(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey").cast("string")
    forms = F.array(F.concat(F.lit("chr"), key), F.col("n_name"), F.concat(F.lit("Chr"), key, F.lit("_x")), key)
    return n.select(F.explode(forms).alias("name")).withColumn("contig", C.canonical_contig(F.col("name")))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, cast(l_quantity AS int) AS a, cast(l_partkey % 5 AS int) AS b, cast(l_suppkey % 4 AS int) AS d, l_linenumber AS e FROM lineitem),
l AS (SELECT *, list_filter([a, b, d + e], lambda x: x <> 0) AS lens FROM c)
SELECT l_orderkey, l_linenumber, len(lens) AS n_lens, cast(lens[1] + coalesce(lens[3], 0) AS bigint) AS read_length,
  cast(100 + list_sum(lens) - CASE WHEN len(lens) = 2 THEN lens[2] ELSE 0 END - 1 AS bigint) AS last_end FROM l""")
def cigar_fold(spark, sf_dir):
    cigar = F.format_string("2S%dM%dN1I%dD%d=3H", F.col("l_quantity").cast("int"), F.expr("cast(l_partkey % 5 as int)"), F.expr("cast(l_suppkey % 4 as int)"), F.col("l_linenumber"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", C.cigar_lengths(cigar).alias("lens"))
    return rows.select(
        "l_orderkey", "l_linenumber", F.size("lens").cast("long").alias("n_lens"),
        C.mapped_length(F.col("lens")).cast("long").alias("read_length"),
        F.element_at(C.blocks(F.col("lens"), F.lit(100)), -1)["e"].cast("long").alias("last_end"),
    )


@query("SELECT l_orderkey, l_linenumber, cast(l_quantity + l_linenumber + 5 AS bigint) AS n FROM lineitem")
def query_length(spark, sf_dir):
    cigar = F.format_string("%dM7N%dI5S2H", F.col("l_quantity").cast("int"), F.col("l_linenumber"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", C.query_length(cigar).cast("long").alias("n"))


@query("""SELECT l_orderkey, l_linenumber FROM lineitem
WHERE ((l_linenumber * 256 + l_partkey) % 4096) & 2820 = 0 AND l_suppkey % 30 >= 10""")
def flag_filter(spark, sf_dir):
    flag = F.expr("cast((l_linenumber * 256 + l_partkey) % 4096 as int)")
    keep = C.passes_flags(flag, F.expr("l_suppkey % 30"), "unique_only")
    return table(spark, sf_dir, "lineitem").where(keep).select("l_orderkey", "l_linenumber")


REGION_TYPE = """CASE WHEN n = 1 THEN 'one_exon' WHEN n - j - 1 = 0 AND n = 2 THEN 'two_exons' WHEN n - j - 1 = 1 THEN 'one_junction'
  WHEN n - j - 1 = 0 THEN 'exons' ELSE 'junctions' END"""


def order_regions(spark, sf_dir) -> DataFrame:
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("n"), F.sum(F.expr("if(l_linenumber > 1 and l_partkey % 2 = 0, 1, 0)")).alias("j"),
        F.sum(F.col("l_quantity").cast("int")).alias("len"), F.min(F.col("l_quantity").cast("int")).alias("inner"),
        F.min("l_partkey").alias("first"), F.max("l_partkey").alias("last"),
    )
    return n.withColumn("kind", C.region_type(F.col("n"), F.least("j", F.col("n") - 1)))


ORDER_REGIONS = f"""r0 AS (SELECT l_orderkey, count(*) AS n, sum(CASE WHEN l_linenumber > 1 AND l_partkey % 2 = 0 THEN 1 ELSE 0 END) AS j0,
  sum(cast(l_quantity AS int)) AS len, min(cast(l_quantity AS int)) AS inner_len, min(l_partkey) AS first, max(l_partkey) AS last FROM lineitem GROUP BY 1),
r AS (SELECT *, {REGION_TYPE} AS kind FROM (SELECT *, least(j0, n - 1) AS j FROM r0))"""


@query(f"WITH {ORDER_REGIONS} SELECT l_orderkey, kind FROM r")
def region_type(spark, sf_dir):
    return order_regions(spark, sf_dir).select("l_orderkey", "kind")


@query(f"""WITH {ORDER_REGIONS} SELECT l_orderkey, cast(greatest(1, CASE kind WHEN 'one_junction' THEN 150 - 10 WHEN 'two_exons' THEN 149
  WHEN 'one_exon' THEN CASE WHEN 150 < len THEN len - 149 ELSE 1 END WHEN 'exons' THEN 149 - inner_len ELSE 150 - inner_len - 10 END) AS bigint) AS eff FROM r""")
def eff_region_len(spark, sf_dir):
    r = order_regions(spark, sf_dir)
    eff = C.region_effective_length(F.col("kind"), F.col("len"), F.col("inner"), F.lit(150), F.lit(10))
    return r.select("l_orderkey", eff.cast("long").alias("eff"))


@query(f"""WITH {ORDER_REGIONS} SELECT l_orderkey FROM r WHERE len > 100 AND (kind IN ('one_exon', 'two_exons')
  OR (kind = 'one_junction' AND first > 20 AND last > 20) OR (kind = 'exons' AND inner_len + 3 <= 100)
  OR (kind = 'junctions' AND first > 20 AND last > 20 AND inner_len + 40 <= 100))""")
def region_filter(spark, sf_dir):
    valid = C.region_is_valid(F.col("kind"), F.col("len"), F.col("first"), F.col("last"), F.col("inner"), 100, 20)
    return order_regions(spark, sf_dir).where(valid).select("l_orderkey")


@query(f"""WITH {ORDER_REGIONS}, w AS (SELECT l_orderkey, (60 - inner_len - 1) / 60.0::double AS w FROM r)
SELECT l_orderkey, round(CASE WHEN w <= 0 OR w > 1 THEN 1.0 ELSE w END, 6) AS w FROM w""")
def inner_weight(spark, sf_dir):
    w = C.inner_weight(F.col("inner"), F.lit(60))
    return order_regions(spark, sf_dir).select("l_orderkey", F.round(w, 6).alias("w"))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN x < 0.01 THEN 0.0 ELSE x END, 6) AS x FROM (SELECT *, l_tax / CASE WHEN l_discount = 0 THEN 1 ELSE l_discount END AS x FROM lineitem)")
def safe_divide(spark, sf_dir):
    x = C.zero_below(C.safe_divide(F.col("l_tax"), F.col("l_discount")), 0.01)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(x, 6).alias("x"))


@query("SELECT p_partkey, reverse(translate(p_type, 'GATCgatc', 'CTAGctag')) AS rc FROM part")
def reverse_complement(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", C.reverse_complement(F.col("p_type")).alias("rc"))


# ---------------------------------------------------------------- intervals and paths


@query(f"""WITH {EXONS}, a AS (SELECT *, max(e) OVER (PARTITION BY gene ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM exons),
b AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY gene ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM a)
SELECT gene, cast(min(s) AS bigint) AS island_start, cast(max(e) AS bigint) AS island_end FROM b GROUP BY gene, island""")
def interval_merge(spark, sf_dir):
    got = intervals.merge(exons(spark, sf_dir), ["gene"])
    return got.select("gene", F.col("start").cast("long").alias("island_start"), F.col("end").cast("long").alias("island_end"))


@query(f"WITH {SEGMENTS} SELECT gene, seg, cast(s AS bigint) AS seg_start, cast(e AS bigint) AS seg_end FROM segs")
def interval_split(spark, sf_dir):
    got = paths.segments(exons(spark, sf_dir))
    return got.select("gene", F.col("seg").cast("long").alias("seg"), F.col("start").cast("long").alias("seg_start"), F.col("end").cast("long").alias("seg_end"))


@query(f"""WITH {EXONS}, p AS (SELECT gene, s AS x FROM exons UNION SELECT gene, e FROM exons)
SELECT gene, cast(x AS bigint) AS coord, dense_rank() OVER (PARTITION BY gene ORDER BY x) - 1 AS point FROM p""")
def point_index(spark, sf_dir):
    got = intervals.number_points(exons(spark, sf_dir), ["gene"])
    return got.select("gene", F.col("at").cast("long").alias("coord"), F.col("point").cast("long").alias("point"))


@query(f"WITH {MEMBERS} SELECT gene, isoform, string_agg(seg::varchar, ',' ORDER BY seg) AS path FROM mem GROUP BY gene, isoform")
def containment_join(spark, sf_dir):
    x = exons(spark, sf_dir)
    return paths.paths(paths.segments(x), x).select("gene", "isoform", F.expr(JOINED).alias("path"))


@query(f"""WITH {SLICES} SELECT gene, path, cast(any_value(len) AS bigint) AS region_len, cast(any_value(inner_len) AS bigint) AS inner_len,
  string_agg(DISTINCT isoform, '|' ORDER BY isoform) AS owners FROM named GROUP BY gene, path""")
def path_slices(spark, sf_dir):
    x = exons(spark, sf_dir)
    segs = paths.segments(x)
    got = paths.slices(paths.paths(segs, x), segs)
    return got.select("gene", F.expr(JOINED).alias("path"), F.col("len").cast("long").alias("region_len"), F.col("inner").cast("long").alias("inner_len"), F.array_join("isoforms", "|").alias("owners"))


@query(f"""WITH {SLICES}, g AS (SELECT gene, path, any_value(len) AS len, any_value(first) AS first, any_value(last) AS last,
  any_value(inner_len) AS il, any_value(j - i + 1) AS n FROM named GROUP BY gene, path)
SELECT gene, path, CASE n WHEN 1 THEN 'one_exon' WHEN 2 THEN 'one_junction' ELSE 'junctions' END AS kind,
  cast(greatest(1, CASE n WHEN 1 THEN CASE WHEN 150 < len THEN len - 149 ELSE 1 END WHEN 2 THEN 149 ELSE 149 - il END) AS bigint) AS eff_len
FROM g WHERE len > 150 AND (n = 1 OR (first > 1 AND last > 1 AND (n = 2 OR il + 2 <= 150)))""")
def region_selection(spark, sf_dir):
    x = exons(spark, sf_dir)
    segs = paths.segments(x)
    got = paths.regions(paths.paths(segs, x), segs, KValueSettings())
    return got.select("gene", F.expr(JOINED).alias("path"), "kind", F.col("eff_len").cast("long").alias("eff_len"))


@query(f"""WITH {SEGMENTS} SELECT gene, num_isoforms, num_exons, coalesce(n, 0) AS num_split_exons FROM
(SELECT gene, count(DISTINCT isoform) AS num_isoforms, count(DISTINCT (s, e)) AS num_exons FROM exons GROUP BY gene)
LEFT JOIN (SELECT gene, count(*) AS n FROM segs GROUP BY gene) USING (gene)""")
def gene_info(spark, sf_dir):
    x = exons(spark, sf_dir)
    return paths.gene_info(x, paths.segments(x)).drop("chr")


@query(f"""WITH {EXONS}, x AS (SELECT gene, isoform, string_agg(s || '-' || e, ',' ORDER BY s, e) AS ex FROM (SELECT gene, isoform, s % 3 AS s, 5 AS e FROM exons) GROUP BY 1, 2)
SELECT gene, string_agg(isoform, '|' ORDER BY isoform) AS isoforms FROM x GROUP BY gene, ex HAVING count(*) > 1""")
def identical_isoforms(spark, sf_dir):
    x = exons(spark, sf_dir).withColumn("start", F.col("start") % 3).withColumn("end", F.lit(5))
    return paths.identical_isoforms(x).select("gene", F.array_join("isoforms", "|").alias("isoforms"))


EVENTS = "p AS (SELECT event_id, user_id % 20 AS chr, event_id AS s, event_id + event_id % 90 AS e FROM events)"
RANGES = "g AS (SELECT o_orderkey, o_custkey % 20 AS chr, o_orderkey AS gs, o_orderkey + 40 + o_orderkey % 50 AS ge FROM orders)"


def placements(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf_dir, "events").selectExpr("event_id", "user_id % 20 as chr", "event_id as r_start", "event_id + event_id % 90 as r_end")
    g = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey % 20 as chr", "o_orderkey as g_start", "o_orderkey + 40 + o_orderkey % 50 as g_end")
    return p, g


@query(f"""WITH {EVENTS}, {RANGES} SELECT event_id, count(*) AS n, min(o_orderkey) AS least FROM p JOIN g ON p.chr = g.chr
  AND gs <= s + CASE WHEN e - s > 40 THEN 20 ELSE 2 END AND ge >= e - CASE WHEN e - s > 40 THEN 20 ELSE 2 END GROUP BY event_id""")
def range_join_tol(spark, sf_dir):
    p, g = placements(spark, sf_dir)
    got = mapping.gene_candidates(p, g)
    return got.groupBy("event_id").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("least"))


@query(f"""WITH {EVENTS}, {RANGES} SELECT event_id, count(*) AS n, cast(sum((ge - gs + 1) + (e - s + 1) - (greatest(ge, e) - least(gs, s) + 1)) AS bigint) AS overlap
FROM p JOIN g ON p.chr = g.chr AND gs < e + 5 AND ge + 1 > s - 5 GROUP BY event_id""")
def overlap_join(spark, sf_dir):
    p, g = placements(spark, sf_dir)
    left = p.withColumnsRenamed({"r_start": "start", "r_end": "end"})
    right = g.withColumnsRenamed({"g_start": "r_start", "g_end": "r_end"})
    got = intervals.overlap_join(left, right, ["chr"], 5)
    shared = C.overlap_length(F.col("r_start"), F.col("r_end"), F.expr("r_end - r_start + 1"), F.col("start"), F.col("end"))
    return got.groupBy("event_id").agg(F.count("*").alias("n"), F.sum(shared).cast("long").alias("overlap"))


# ---------------------------------------------------------------- choices, sets, joins


@query("""WITH RECURSIVE c AS (SELECT l_orderkey AS r, l_linenumber AS g, cast(l_quantity AS bigint) AS o, l_partkey % 5 AS l,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_partkey % 5, l_suppkey) AS k FROM lineitem),
f AS (SELECT DISTINCT r, 0::bigint AS k, 0::bigint AS o, 1::bigint AS l, '' AS p FROM c
UNION ALL SELECT f.r, c.k,
  CASE WHEN t OR w THEN c.o ELSE f.o END, CASE WHEN t OR w THEN c.l ELSE f.l END,
  CASE WHEN t THEN f.p || ',' || c.g WHEN w THEN ',' || c.g ELSE f.p END
FROM f JOIN c ON c.r = f.r AND c.k = f.k + 1, LATERAL (SELECT abs(c.o - f.o) <= 2 AND abs(c.l - f.l) <= 2 AS t,
  (abs(c.o - f.o) <= 2 AND abs(c.l - f.l) > 2 AND c.l < f.l) OR (abs(c.o - f.o) > 2 AND c.o > f.o) AS w))
SELECT r AS l_orderkey, substr(p, 2) AS kept FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY k DESC) AS rn FROM f) WHERE rn = 1""")
def tie_fold(spark, sf_dir):
    one = F.struct(F.col("l_linenumber").alias("gene"), F.col("l_quantity").cast("long").alias("overlap"), F.expr("l_partkey % 5 as length"), "l_suppkey")
    got = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(C.best_gene_fold(F.collect_list(one)).alias("k"))
    return got.select("l_orderkey", F.array_join(F.expr("transform(k, x -> cast(x.gene as string))"), ",").alias("kept"))


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, max(day(o_orderdate)) OVER (PARTITION BY o_custkey) AS most FROM orders) WHERE day(o_orderdate) = most""")
def full_length_regions(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("n_segments", F.dayofmonth("o_orderdate"))
    return paths.full_length(rows, ["o_custkey"]).select("o_custkey", "o_orderkey")


@query("""SELECT isoforms, count(*) AS n FROM (SELECT l_orderkey, string_agg(DISTINCT (l_suppkey % 10)::varchar, ',' ORDER BY (l_suppkey % 10)::varchar) AS isoforms
FROM lineitem GROUP BY l_orderkey) GROUP BY isoforms""")
def distinct_patterns(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as name", "cast(l_suppkey % 10 as string) as isoform")
    return communities.distinct_patterns(rows).select(F.array_join("isoforms", ",").alias("isoforms"), "n")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem),
b AS (SELECT DISTINCT x.s AS u, y.s AS v FROM e x JOIN e y ON x.o = y.o WHERE x.s <> y.s),
r AS (SELECT DISTINCT s AS node, s AS label FROM e UNION SELECT b.u, r.label FROM r JOIN b ON b.v = r.node)
SELECT node, min(label) AS label FROM r GROUP BY node""")
def components(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    least = rows.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("v"))
    edges = rows.join(least, "l_orderkey").select(F.col("l_suppkey").alias("u"), "v")
    return communities.components(rows.select(F.col("l_suppkey").alias("node")), edges)


# ---------------------------------------------------------------- counts and probabilities


def reads(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as name", "'c' as chr", "'g' as gene", "array(0) as path", "l_suppkey as isoform",
        "cast(l_quantity as bigint) as read_len", "l_quantity as w",
    )


@query("""SELECT isoform, round(sum(1.0 / k), 6) AS theta FROM (SELECT l_suppkey AS isoform, count(*) OVER (PARTITION BY l_orderkey) AS k FROM lineitem) GROUP BY isoform""")
def fractional_counts(spark, sf_dir):
    return readlen.fractional_counts(reads(spark, sf_dir)).select("isoform", F.round("theta", 6).alias("theta"))


HIST = "h AS (SELECT cast(l_quantity AS bigint) AS read_len, count(*) AS n FROM lineitem GROUP BY 1)"
ISO = "iso AS (SELECT p_partkey AS isoform, cast(p_size AS bigint) AS iso_len, p_partkey % 7 AS theta FROM part)"
CDF = f"{HIST}, {ISO}, c AS (SELECT isoform, iso_len, theta, coalesce((SELECT sum(n) FROM h WHERE read_len >= 1 AND read_len <= iso_len), 0) / (SELECT sum(n) FROM h)::double AS cdf FROM iso)"
SM = f"""{CDF}, s AS (SELECT read_len, n, coalesce((SELECT sum(CASE WHEN cdf = 0 AND theta > 0 THEN 'inf'::double ELSE theta / CASE WHEN cdf = 0 THEN 1 ELSE cdf END END)
  FROM c WHERE iso_len >= read_len), 0) AS sm FROM h)"""


def hist_and_isoforms(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    iso = table(spark, sf_dir, "part").selectExpr("p_partkey as isoform", "cast(p_size as bigint) as iso_len", "p_partkey % 7 as theta")
    hist = readlen.histogram(reads(spark, sf_dir))
    return hist, readlen.cdf_at(hist, iso, "iso_len")


@query(f"WITH {HIST} SELECT read_len, n, round(n / sum(n) OVER ()::double, 6) AS pdf FROM h")
def read_len_pdf(spark, sf_dir):
    h = readlen.histogram(reads(spark, sf_dir))
    return h.select("read_len", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("pdf"))


@query(f"WITH {CDF} SELECT isoform, round(cdf, 6) AS cdf FROM c")
def read_len_cdf(spark, sf_dir):
    return hist_and_isoforms(spark, sf_dir)[1].select("isoform", F.round("cdf", 6).alias("cdf"))


@query(f"WITH {SM} SELECT read_len, round(sm, 4) AS sm FROM s")
def suffix_sum(spark, sf_dir):
    return readlen.suffix_sums(*hist_and_isoforms(spark, sf_dir)).select("read_len", F.round("sm", 4).alias("sm"))


ROWS_OF_TASK = 1 << 20  # whose equal ones are found in one task, about
LENGTHS = 1 << 16  # distinct read lengths that are broadcast, at most


def cond_prob(spark, sf_dir, form: str) -> DataFrame:
    hist, iso = hist_and_isoforms(spark, sf_dir)
    rows = reads(spark, sf_dir).select("name", "read_len", F.expr("isoform * 20").alias("isoform"))
    total = F.sum("n").over(Window.partitionBy())
    sums = readlen.suffix_sums(hist, iso).withColumn("total", total)
    # p depends on isoform and length alone: equal rows go ahead of the joins, in parts that grow in number and not in size
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS_OF_TASK))
    rows = rows.repartition(parts, "isoform").distinct()
    sums = settle(sums)  # a row for each distinct length
    met = rows.join(merged(iso), "isoform").join(F.broadcast(sums) if sums.count() <= LENGTHS else sums, "read_len")
    p = C.conditional_probability(form, F.col("n") / F.col("total"), F.col("cdf"), F.col("sm"), F.col("iso_len"), F.col("read_len"))
    return met.select("name", "isoform", "read_len", F.round(p, 8).alias("p"))


def cond_sql(value: str) -> str:
    return f"""WITH {SM}, m AS (SELECT l_orderkey AS name, c.isoform, s.read_len, n / (SELECT sum(n) FROM h)::double AS pdf, cdf, sm, iso_len - s.read_len + 1 AS places
FROM lineitem JOIN c ON c.isoform = l_suppkey * 20 JOIN s ON s.read_len = cast(l_quantity AS bigint)),
v AS (SELECT *, CASE WHEN places = 0 THEN 0 ELSE CASE WHEN cdf = 0 OR sm = 0 THEN pdf ELSE {value} END / places END AS p FROM m)
SELECT DISTINCT name, isoform, read_len, round(CASE WHEN p <= 1e-100 THEN 0 ELSE p END, 8) AS p FROM v"""


@query(cond_sql("pdf / cdf"))
def cond_prob_form2(spark, sf_dir):
    return cond_prob(spark, sf_dir, "form_2")


@query(cond_sql("pdf / cdf / sm"))
def cond_prob_form1(spark, sf_dir):
    return cond_prob(spark, sf_dir, "form_1")


@query("""SELECT s_suppkey, min(off5) AS off5, min(off3) AS off3, count(*) AS n FROM (
  SELECT l_suppkey AS s_suppkey, l_orderkey, greatest(q + 1 - CASE WHEN q < 10 THEN 1 ELSE 21 - 10 END, 0) AS off5,
    greatest(l - (q + 1 - CASE WHEN q < 10 THEN 1 ELSE 21 - 10 END) - 5, 0) AS off3
  FROM (SELECT DISTINCT l_suppkey, l_orderkey, min(cast(l_quantity AS bigint)) OVER (PARTITION BY l_suppkey, l_orderkey) AS q, 40 AS l FROM lineitem)) GROUP BY s_suppkey""")
def read_offsets(spark, sf_dir):
    mapped = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.min(F.col("l_quantity").cast("long")).alias("r_start"))
    mapped = mapped.selectExpr("l_orderkey as name", "'c' as chr", "cast(l_suppkey as string) as gene", "array(0) as path", "r_start", "5 as read_length")
    gene = table(spark, sf_dir, "supplier").selectExpr("'c' as chr", "cast(s_suppkey as string) as gene", "concat('i', s_suppkey) as isoform", "array(0) as path")
    iso = gene.selectExpr("chr", "gene", "isoform", "array(named_struct('s', 1, 'e', 10), named_struct('s', 21, 'e', 50)) as exons", "'+' as strand", "40L as length")
    got = mapping.isoform_offsets(mapped, gene, iso)
    return got.groupBy(F.col("gene").cast("long").alias("s_suppkey")).agg(F.min("off5").cast("long").alias("off5"), F.min("off3").cast("long").alias("off3"), F.count("*").alias("n"))


@query("""SELECT l_suppkey AS gene, l_linenumber AS region, count(*) AS n, cast(sum(cast(l_quantity AS bigint)) AS bigint) AS bases FROM lineitem GROUP BY 1, 2""")
def region_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("'c' as chr", "l_suppkey as gene", "array(l_linenumber) as path", "cast(l_quantity as bigint) as read_length")
    got = mapping.region_counts(rows)
    return got.select("gene", F.col("path")[0].alias("region"), "n", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x.read_length * x.n).alias("bases"))


@query("""SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber + 4 - 1 > 7 AND l_quantity / 100.0 <= 0.2)""")
def read_qc(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as name", "l_linenumber as isoform", "array(1) as path", "l_quantity as read_length", "100 as iso_len")
    counts = rows.select("isoform").distinct().withColumn("n_exons", F.col("isoform") + 4)
    return mapping.read_qc(rows, counts).select(F.col("name").alias("l_orderkey")).distinct()


@query("SELECT round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std FROM lineitem")
def fragment_stats(spark, sf_dir):
    got = shortread.fragment_moments(table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("tlen")))
    return got.select(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("""SELECT l_orderkey, l_linenumber, round(1 / (7 * sqrt(pi())) * exp(-0.5 * pow((l_quantity - 25) / 7, 2)) / (l_linenumber + 1), 8) AS w FROM lineitem""")
def gauss_weight(spark, sf_dir):
    w = C.fragment_weight(F.col("l_quantity"), F.lit(25.0), F.lit(7.0), F.col("l_linenumber") + 1)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(w, 8).alias("w"))


@query("""WITH l AS (SELECT DISTINCT p_size AS n FROM part), e AS (SELECT n, CASE WHEN n < 20 - 5 * 3 THEN 1.0 ELSE greatest(1.0, n - (SELECT
  sum(j * exp(-0.5 * pow((j - 20) / 3.0, 2))) / sum(exp(-0.5 * pow((j - 20) / 3.0, 2))) FROM range(1, n + 1) t(j)) + 1) END AS eff FROM l)
SELECT p_partkey, round(eff, 6) AS eff FROM part JOIN e ON p_size = n""")
def eff_len_gauss(spark, sf_dir):
    lengths = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("isoform"), F.col("p_size").alias("length"))
    got = shortread.effective_lengths(lengths, 20.0, 3.0)
    return got.select(F.col("isoform").alias("p_partkey"), F.round("eff", 6).alias("eff"))


# ---------------------------------------------------------------- matrices and EM

READS = "c AS (SELECT l_orderkey AS r, l_suppkey AS i, sum(l_quantity) AS p FROM lineitem GROUP BY 1, 2)"


def compat(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("read"), F.col("l_suppkey").alias("isoform")).agg(F.sum("l_quantity").alias("p"))


@query(f"WITH {READS} SELECT r, i, round(p / sum(p) OVER (PARTITION BY r), 6) AS q FROM c")
def row_normalise(spark, sf_dir):
    q = C.safe_divide(F.col("p"), F.sum("p").over(Window.partitionBy("read")))
    return compat(spark, sf_dir).select(F.col("read").alias("r"), F.col("isoform").alias("i"), F.round(q, 6).alias("q"))


@query("""WITH a AS (SELECT l_orderkey AS r, l_suppkey AS i, any_value(l_orderkey % 9 + 1) AS w FROM lineitem GROUP BY 1, 2)
SELECT r, i, round(w / sum(w) OVER (PARTITION BY i)::double, 6) AS a FROM a""")
def col_normalise(spark, sf_dir):
    return matrix(spark, sf_dir).select(F.col("path").alias("r"), F.col("isoform").alias("i"), F.round("a", 6).alias("a"))


def matrix(spark, sf_dir) -> DataFrame:
    regions = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("isoforms"))
    regions = regions.select(F.lit("c").alias("chr"), F.lit("g").alias("gene"), F.col("l_orderkey").alias("path"), "isoforms")
    return condition.entries(regions, F.expr("path % 9 + 1"))


@query("""WITH a AS (SELECT DISTINCT l_orderkey AS r, l_suppkey AS i, l_orderkey % 9 + 1 AS w FROM lineitem), n AS (SELECT r, i, w / sum(w) OVER (PARTITION BY i)::double AS a FROM a)
SELECT x.i AS i, y.i AS j, round(sum(x.a * y.a), 8) AS g FROM n x JOIN n y ON x.r = y.r AND x.i <= y.i GROUP BY 1, 2""")
def gram_matrix(spark, sf_dir):
    got = condition.gram(matrix(spark, sf_dir), ["gene"])
    return got.select("i", "j", F.round("g", 8).alias("g"))


@query()
def condition_number(spark, sf_dir):
    """The whole of a K value with customers as genes and order priorities as isoforms."""
    from .api import k_values

    return k_values(spark, exons(spark, sf_dir)).summary()


def em_sql(rounds: int) -> str:
    out = [f"WITH {READS}", "t0 AS (SELECT DISTINCT i, 1.0 / (SELECT count(DISTINCT i) FROM c) AS th FROM c)"]
    for k in range(1, rounds + 1):
        out.append(f"""q{k} AS (SELECT i, sum(x) AS q FROM (SELECT c.i, p * th / sum(p * th) OVER (PARTITION BY r) AS x FROM c JOIN t{k - 1} USING (i)) GROUP BY i),
t{k} AS (SELECT i, q / sum(q) OVER () AS th FROM q{k})""")  # fmt: skip
    return ", ".join(out) + f" SELECT i AS isoform, round(th, 8) AS theta FROM t{rounds}"


@query(em_sql(3))
def em_lr_k3(spark, sf_dir):
    c = compat(spark, sf_dir)
    theta = c.select("isoform").distinct().withColumn("theta", 1.0 / F.count("*").over(Window.partitionBy()))
    for _ in range(3):
        theta = em.proportions(em.expected(c.join(theta, "isoform"), F.col("p") * F.col("theta")))
    return theta.select("isoform", F.round("theta", 8).alias("theta"))


def hybrid_sql(rounds: int) -> str:
    out = [f"WITH {READS}", "w AS (SELECT l_partkey AS r, l_suppkey AS i, sum(1.0 + l_linenumber) AS v FROM lineitem GROUP BY 1, 2)",
           "e AS (SELECT s_suppkey AS i, 10.0 + s_suppkey % 13 AS eff FROM supplier)",
           "t0 AS (SELECT i, 1.0 / (SELECT count(*) FROM e) AS th FROM e)"]
    for k in range(1, rounds + 1):
        t = f"t{k - 1}"
        out.append(f"""b{k} AS (SELECT sum(th * eff) AS b FROM {t} JOIN e USING (i)),
l{k} AS (SELECT i, sum(x) AS q FROM (SELECT c.i, p * th / sum(p * th) OVER (PARTITION BY r) AS x FROM c JOIN {t} USING (i)) GROUP BY i),
s{k} AS (SELECT i, sum(x) AS q FROM (SELECT w.i, v * th * eff / sum(v * th * eff) OVER (PARTITION BY r) AS x FROM w JOIN {t} USING (i) JOIN e USING (i)) GROUP BY i),
m{k} AS (SELECT i, eff, coalesce(l{k}.q, 0) AS ql, coalesce(s{k}.q, 0) AS qs FROM e LEFT JOIN l{k} USING (i) LEFT JOIN s{k} USING (i)),
n{k} AS (SELECT i, (0.6 * qs + 0.4 * ql) / (0.6 * sum(qs * eff) OVER () / (SELECT b FROM b{k}) + 0.4 * sum(ql) OVER ()) AS x FROM m{k}),
t{k} AS (SELECT i, x / sum(x) OVER () AS th FROM n{k})""")  # fmt: skip
    return ", ".join(out) + f" SELECT i AS isoform, round(th, 8) AS theta FROM t{rounds}"


@query(hybrid_sql(3))
def em_hybrid_k3(spark, sf_dir):
    c = compat(spark, sf_dir)
    w = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("read"), F.col("l_suppkey").alias("isoform")).agg(F.sum(F.expr("1.0D + l_linenumber")).alias("v"))
    eff = table(spark, sf_dir, "supplier").selectExpr("s_suppkey as isoform", "10.0D + s_suppkey % 13 as eff")
    theta = eff.select("isoform", (1.0 / F.count("*").over(Window.partitionBy())).alias("theta"))
    for _ in range(3):
        q_lr = em.expected(c.join(theta, "isoform"), F.col("p") * F.col("theta"))
        q_sr = em.expected(w.join(theta, "isoform").join(eff, "isoform"), F.col("v") * F.col("theta") * F.col("eff"))
        theta = em.blend(q_lr, q_sr, eff, theta, F.lit(0.4))
    return theta.select("isoform", F.round("theta", 8).alias("theta"))


@query(f"""WITH RECURSIVE {READS}, s AS (SELECT s_suppkey AS i, s_nationkey::varchar AS g FROM supplier),
e AS (SELECT DISTINCT x.g AS u, y.g AS v FROM (SELECT r, g FROM c JOIN s USING (i)) x JOIN (SELECT r, min(g) AS g FROM c JOIN s USING (i) GROUP BY 1) y USING (r)),
ties AS (SELECT u, v FROM e UNION SELECT v, u FROM e), reach AS (SELECT DISTINCT g AS node, g AS label FROM s UNION SELECT b.u, l.label FROM reach l JOIN ties b ON b.v = l.node),
com AS (SELECT i, community, 1.0::double / count(*) OVER (PARTITION BY community) AS start FROM s JOIN (SELECT node, min(label) AS community FROM reach GROUP BY 1) ON node = g),
st AS (SELECT 0 AS k, i, community, start AS th, true AS moved FROM com
UNION ALL SELECT k + 1, i, community, th, max(ABS(th - old) > 1e-6 * th AND th > 1e-7) OVER (PARTITION BY community) FROM (
  SELECT st.k, st.i, st.community, st.th AS old, coalesce(q, 0) / sum(q) OVER (PARTITION BY st.community) AS th FROM st LEFT JOIN (
    SELECT i, sum(x) AS q FROM (SELECT c.i, p * th / sum(p * th) OVER (PARTITION BY r) AS x FROM c JOIN st USING (i) WHERE moved AND k < 200) GROUP BY 1) n ON n.i = st.i
  WHERE st.moved AND st.k < 200))
SELECT community, i::varchar AS isoform, round(th, 5) AS theta FROM st QUALIFY row_number() OVER (PARTITION BY i ORDER BY k DESC) = 1""")
def em_to_convergence(spark, sf_dir):
    """Communities of suppliers (by nation) solved to the end."""
    rows = compat(spark, sf_dir).selectExpr("read as name", "cast(isoform as string) as isoform", "p")
    genes = table(spark, sf_dir, "supplier").selectExpr("cast(s_suppkey as string) as isoform", "cast(s_nationkey as string) as gene")
    pats = settle(communities.patterns(rows, "p"))
    got = em.run(communities.communities(genes, pats), pats, None, None, None, QuantifySettings())
    return got.select("community", "isoform", F.round("theta", 5).alias("theta"))


# ---------------------------------------------------------------- features


@query("""WITH m AS (SELECT event_type, min(value) AS lo, max(value) AS hi, avg(value) AS mean, var_samp(value) AS var, avg(value) AS u FROM events GROUP BY 1),
c AS (SELECT event_type, avg(pow(value - u, 2)) AS m2, avg(pow(value - u, 3)) AS m3, avg(pow(value - u, 4)) AS m4 FROM events JOIN m USING (event_type) GROUP BY 1)
SELECT event_type, round(lo, 6) AS lo, round(hi, 6) AS hi, round(mean, 6) AS mean, round(var, 4) AS variance, round(m3 / pow(m2, 1.5), 4) AS skew, round(m4 / (m2 * m2) - 3, 4) AS kurt
FROM m JOIN c USING (event_type)""")
def describe_moments(spark, sf_dir):
    got = table(spark, sf_dir, "events").groupBy("event_type").agg(*features.describe(F.col("value"), "v"))
    names = {"Min_v": ("lo", 6), "Max_v": ("hi", 6), "Mean_v": ("mean", 6), "Variance_v": ("variance", 4), "Skewness_v": ("skew", 4), "Kurtosis_v": ("kurt", 4)}
    return got.select("event_type", *[F.round(c, d).alias(n) for c, (n, d) in names.items()])


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return condition_number(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
