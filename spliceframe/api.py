"""The two analyses: k_values() of an annotation, and quantify() of reads."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cache, cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import KValueSettings, QuantifySettings
from .functions.columns import inner_weight, region_effective_length, region_name
from .operators import communities, condition, density, em, features, global_em, intervals, least_squares, mapping, paths, readlen, shortread, supported
from .plans.scratch import merged, settle
from .sources import formats, sinks

GENE = paths.GENE

# The names that the result tables' columns must have.
GENE_COLUMNS = {
    "gene": "Gene", "chr": "Chr", "num_isoforms": "Num_isoforms", "num_exons": "Num_exons", "num_split_exons": "Num_split_exons",
    "sr_product": "SR_singular_value_product", "sr_kvalue": "SR_k_value", "sr_regular": "SR_regular_condition_number",
    "sr_generalized": "SR_generalized_condition_number", "sr_dim": "SR_A_dim",
    "lr_product": "LR_singular_value_product", "lr_kvalue": "LR_k_value", "lr_regular": "LR_regular_condition_number",
    "lr_generalized": "LR_generalized_condition_number", "lr_dim": "LR_A_dim",
}
ISOFORM_COLUMNS = {
    "isoform": "Isoform", "gene": "Gene", "chr": "Chr", "n_exons": "Num_exons", "length": "Isoform_length", "num_isoforms": "Num_isoforms",
    **{c: n for c, n in GENE_COLUMNS.items() if c.startswith(("sr_", "lr_")) and not c.endswith("_dim")},
}
EXPRESSION_COLUMNS = {"isoform": "Isoform", "gene": "Gene", "tpm": "TPM", "eff": "Effective length", "theta": "theta", "community": "community"}


def named(columns: dict[str, str]) -> list[Column]:
    return [F.col(c).alias(n) for c, n in columns.items()]


@dataclass
class KValues:
    """genes: K value and the rest for each gene, nulls for genes without a region; matrix, lr_matrix: the weighted
    matrices of short and long reads; sr_b, lr_b: their abundance vectors, where there are reads. What is made of all regions
    is computed when it is first asked for: abundances of long reads need none of it."""

    names: DataFrame
    lr_matrix: DataFrame
    segments: DataFrame
    made: dict[str, Callable[[], DataFrame]]
    sr_b: DataFrame | None = None
    lr_b: DataFrame | None = None

    @cached_property
    def genes(self) -> DataFrame:
        return self.made["genes"]()

    @cached_property
    def isoforms(self) -> DataFrame:
        return self.made["isoforms"]()

    @cached_property
    def matrix(self) -> DataFrame:
        return self.made["matrix"]()

    @cached_property
    def regions(self) -> DataFrame:
        return self.made["regions"]()

    def summary(self) -> DataFrame:
        """Gene, Chr, Num_isoforms, Kvalue (the generalized condition number)."""
        return self.genes.select(
            F.col("gene").alias("Gene"), F.col("chr").alias("Chr"), F.col("num_isoforms").alias("Num_isoforms"),
            F.col("sr_generalized").alias("Kvalue"),
        )

    def write(self, directory: str, matrices: bool = False) -> None:
        sinks.write_tsv(self.summary(), f"{directory}/kvalues.out", ["Gene"])
        sinks.write_tsv(self.genes.select(*named(GENE_COLUMNS)), f"{directory}/kvalues_gene.out", ["Gene"])
        sinks.write_tsv(self.isoforms.select(*named(ISOFORM_COLUMNS)), f"{directory}/kvalues_isoform.out", ["Gene", "Isoform"])
        for kind in ("sr", "lr"):
            one = self.genes.select("gene", F.col(f"{kind}_singular_values").alias("singular_values"))
            sinks.write_tsv(one, f"{directory}/{kind.upper()}_singular_values.out", ["gene"])
        if matrices:
            sinks.write_matrix(self.matrix_info(), f"{directory}/matrix_info")

    def matrix_info(self) -> DataFrame:
        """rows (chr, gene, reads, region, coordinates, isoform, a, b) of both matrices."""
        out = None
        for kind, matrix, b in (("SR", self.matrix, self.sr_b), ("LR", self.lr_matrix, self.lr_b)):
            one = matrix.join(merged(supported.coordinates(matrix, self.segments)), [*GENE, "path"])
            one = one.join(merged(b), [*GENE, "path"], "left") if b is not None else one.withColumn("b", F.lit(None).cast("double"))
            one = one.select(*GENE, F.lit(kind).alias("reads"), region_name(F.col("path")).alias("region"), "coordinates", "isoform", "a", "b")
            out = one if out is None else out.unionByName(one)
        return out


def region_reads(spark: SparkSession, source: str | DataFrame | None, segs: DataFrame, iso_paths: DataFrame) -> DataFrame | None:
    """rows (name, chr, gene, path, r_start, r_end, read_length) of the reads of a genome-aligned SAM path or a table of
    alignments, each on one gene."""
    if source is None:
        return None
    reads = formats.alignments(spark, source) if isinstance(source, str) else source
    return mapping.pick_one(mapping.map_reads(reads, paths.gene_segments(segs), iso_paths, QuantifySettings()))


def k_values(
    spark: SparkSession,
    annotation: str | DataFrame,
    settings: KValueSettings | None = None,
    long_reads: str | DataFrame | None = None,
    short_reads: str | DataFrame | None = None,
    weights: str | DataFrame | None = None,
) -> KValues:
    """Condition numbers of every gene of a GTF path or an exons table.

    long_reads and short_reads, if given, are genome-aligned SAM paths or tables of alignments, whose counts decide which
    regions take part. weights (a Parquet path or a table: chr, gene, isoform, region, weight) replaces the cells of the
    long-read matrix in genes with long reads.
    """
    s = settings or KValueSettings()
    exons = formats.exons(spark, annotation) if isinstance(annotation, str) else annotation
    segs, iso_paths = paths.laid_out(exons)
    iso = settle(paths.isoforms(exons))
    names = iso.select(*GENE, "isoform")
    every = paths.regions(iso_paths, segs, s)
    regions = cache(lambda: settle(every))  # read by each of the matrices below
    sr = lr = regions
    sr_b = lr_b = None
    rl = F.lit(s.read_length)
    srs, lrs = (region_reads(spark, r, segs, iso_paths) for r in (short_reads, long_reads))
    if srs is not None:
        srs = settle(srs)
        rl = F.lit(float(srs.agg(F.avg("read_length")).first()[0] or s.read_length))
        counted = supported.short_read_regions(regions(), srs, names, s.region_selection, s.keep_sr_regions)
        eff = region_effective_length(F.col("kind"), F.col("len"), F.col("inner"), rl, F.lit(s.least_junction))
        counted = settle(counted.withColumn("eff_len", eff))
        sr = lambda: counted
        sr_b = supported.abundance(counted, F.col("eff_len"))
    if lrs is not None:
        if s.filter_reads:
            lrs = mapping.region_qc(settle(lrs), iso_paths, iso)
        seen = settle(supported.long_read_regions(settle(lrs), iso_paths, s.full_length_regions))
        lr = lambda: seen
        lr_b = supported.abundance(seen)
    if s.multi_exon_weight == "minus_inner_region":
        many = F.col("kind").isin("junctions", "exons")
        weight = F.when(many, inner_weight(F.col("inner"), rl)).otherwise(1.0)
    else:
        weight = F.col("eff_len") if s.sr_design == "weight" else F.lit(1.0)
    ones = F.lit(1.0)
    sr_matrix = cache(lambda: condition.entries(sr(), weight, s.normalize_sr))
    lr_matrix = condition.entries(lr(), ones, s.normalize_lr)
    if weights is not None:
        if lrs is None:
            raise ValueError("weights take the place of cells of genes with long reads, and there are no long reads")
        table = formats.region_weights(spark, weights) if isinstance(weights, str) else weights
        lr_matrix = supported.weighted(lr_matrix, table.join(lr().where("n > 0").select(*GENE).distinct(), GENE, "left_semi"))

    def solved(weighted: DataFrame, plain: DataFrame, sums: DataFrame, kind: str) -> DataFrame:
        found = condition.condition_numbers(weighted, plain, names, s.singular_tolerance)
        size = sums.groupBy(*GENE).agg(F.sum("n").alias("_rows"))
        found = found.join(size, GENE).withColumnsRenamed({c: f"{kind}_{c}" for c in found.columns if c not in GENE})
        return found.withColumnRenamed("_rows", f"{kind}_regions")

    @cache
    def genes() -> DataFrame:
        sr_sums = settle(condition.owner_sums(sr(), weight))
        lr_sums = sr_sums if lrs is None and srs is None else settle(condition.owner_sums(lr(), ones))
        gram_of = lambda sums, normalize, *w: settle(condition.gram_of_sums(sums, normalize, *w))
        lr_gram = settle(condition.gram(lr_matrix, GENE)) if weights is not None else gram_of(lr_sums, s.normalize_lr, "n", "n")
        same = srs is None and lrs is None and weights is None and s.normalize_sr == s.normalize_lr
        sr_grams = gram_of(sr_sums, s.normalize_sr), lr_gram if same else gram_of(sr_sums, s.normalize_sr, "n", "n")
        info = paths.gene_info(exons, segs)
        numbers = solved(*sr_grams, sr_sums, "sr").join(solved(lr_gram, lr_gram, lr_sums, "lr"), GENE)  # genes with both matrices
        out = info.join(merged(numbers), GENE, "left")
        for kind in ("sr", "lr"):
            n = F.col(f"{kind}_regions")
            out = out.withColumn(f"{kind}_dim", F.when(n.isNotNull(), F.format_string("(%d, %d)", n, "num_isoforms"))).drop(n)
        return settle(out)  # files sort it, which computes it twice, and there are several

    def isoforms() -> DataFrame:
        left_out = ("num_exons", "num_split_exons", "sr_singular_values", "lr_singular_values", "sr_dim", "lr_dim")
        return iso.select(*GENE, "isoform", "n_exons", "length").join(genes().drop(*left_out), GENE)

    return KValues(names, lr_matrix, segs, {"genes": genes, "isoforms": isoforms, "matrix": sr_matrix, "regions": regions}, sr_b, lr_b)


def region_abundance(found: KValues, alpha: float = 1.0, beta: float = 1e-6, unique_bounds: bool = True, assign: str = "linear_model") -> DataFrame:
    """rows (chr, gene, isoform, theta, expression, tpm) of k_values with reads, by least squares of the regions' counts.

    alpha weighs long reads, the rest short ones, whose abundances sum to 1 in a gene. expression is by theta's share of
    the gene's long reads (linear_model), or deals each region's among its isoforms (reassign).
    """
    if assign not in ("linear_model", "reassign"):
        raise ValueError(f"assign is linear_model or reassign, not {assign}")
    if found.lr_b is None or (alpha < 1 and found.sr_b is None):
        raise ValueError("k_values had no reads to take abundances from")
    parts = [(found.lr_matrix, found.lr_b, alpha)]
    if alpha < 1:
        total = F.sum("b").over(Window.partitionBy(*GENE))
        parts.append((found.matrix, found.sr_b.withColumn("b", F.col("b") / F.when(total == 0, 1).otherwise(total)), 1 - alpha))
    names = found.names
    theta = settle(least_squares.gene_shares(least_squares.solve(parts, names, beta, unique_bounds)))
    if assign == "reassign":
        got = least_squares.reassign(theta, found.lr_matrix, found.lr_b)
    else:
        got = least_squares.by_total(theta, found.lr_b)
    return theta.join(merged(least_squares.per_million(settle(got))), [*GENE, "isoform"])  # its total, and its rows


def write_region_abundance(directory: str, expression: DataFrame, exons: DataFrame) -> None:
    """expression_gene.out and expression_isoform.out of region_abundance's rows, blended or not; isoforms of exons that have
    none are at 0."""
    iso = exons.groupBy(*GENE, "isoform").agg(F.min("start").alias("Start"), F.max("end").alias("End"))
    iso = iso.join(paths.isoforms(exons).select(*GENE, "isoform", "length"), [*GENE, "isoform"])
    alpha = F.col("alpha") if "alpha" in expression.columns else F.lit(1.0)
    rows = merged(iso).join(expression.select(*GENE, "isoform", "tpm", alpha.alias("alpha")), [*GENE, "isoform"], "left").fillna(0.0, ["tpm"])
    rows = rows.select(F.col("isoform").alias("Isoform"), F.col("gene").alias("Gene"), F.col("chr").alias("Chr"), "Start", "End", F.col("length").alias("Isoform_length"), F.col("tpm").alias("TPM"), F.col("alpha").alias("Alpha"))
    rows = settle(rows)
    sinks.write_tsv(rows.groupBy("Gene", "Chr").agg(F.sum("TPM").alias("TPM")), f"{directory}/expression_gene.out", ["Gene"])
    sinks.write_tsv(rows, f"{directory}/expression_isoform.out", ["Gene", "Isoform"])


def training_rows(found: KValues, expression: DataFrame) -> DataFrame:
    """rows (chr, gene, reads, region, isoform, a, b, tpm columns): matrices, abundances and results side by side, to train
    models of gene weights on."""
    results = [c for c in expression.columns if c.endswith("tpm")]
    return found.matrix_info().drop("coordinates").join(expression.select(*GENE, "isoform", *results), [*GENE, "isoform"])


@dataclass
class Abundance:
    """isoforms (isoform, gene, eff, theta, community, community reads, tpm) and what led there. lr_counts, sr_counts: reads
    dealt evenly among their isoforms, short ones over the effective length; what EM is often compared with."""

    isoforms: DataFrame
    lr_patterns: DataFrame | None
    sr_patterns: DataFrame | None
    mapped: DataFrame | None
    rejected: DataFrame | None
    alphas: DataFrame | None
    lr_counts: DataFrame | None = None
    sr_counts: DataFrame | None = None

    def table(self, hybrid: bool) -> DataFrame:
        eff = [F.col("eff").alias("Effective length")] if hybrid else []
        return self.isoforms.select(F.col("isoform").alias("Isoform"), F.col("gene").alias("Gene"), *eff, F.col("tpm").alias("TPM"))

    def trace(self) -> DataFrame:
        """rows (isoform, round, theta), after each round."""
        rows = self.isoforms.select("isoform", F.posexplode("trace").alias("round", "theta"))
        return rows.withColumn("round", F.col("round") + 1)

    def write(self, directory: str) -> None:
        hybrid = self.sr_patterns is not None
        sinks.write_tsv(self.table(hybrid), f"{directory}/Isoform_abundance.out", ["Gene", "Isoform"])
        for kind, table in (("LR", self.lr_patterns), ("SR", self.sr_patterns)):
            if table is not None:
                columns = {c: n for c, n in EXPRESSION_COLUMNS.items() if c != "eff" or kind == "SR"}
                columns[f"community_num_{kind.lower()}s"] = f"community_num_{kind}s"
                sinks.write_tsv(self.expression(kind).select(*named(columns)), f"{directory}/{kind}_EM_expression.out", ["Gene", "Isoform"])
        for kind, counts in (("LR", self.lr_counts), ("SR", self.sr_counts)):
            if counts is not None:
                every = self.isoforms.select("isoform", "gene").join(counts, "isoform", "left").fillna(0.0, ["theta"])
                named_ = every.select(F.col("isoform").alias("Isoform"), F.col("gene").alias("Gene"), F.col("theta").alias("Count"))
                sinks.write_tsv(named_, f"{directory}/{kind}_count.tsv", ["Gene", "Isoform"])
        sinks.write_tsv(self.trace(), f"{directory}/EM_iterations.tsv", ["isoform", "round"])
        if self.alphas is not None:
            error = F.col("error") if "error" in self.alphas.columns else F.lit(None).cast("double").alias("error")
            sinks.write_tsv(self.alphas.select(F.col("community").alias("id"), error, "alpha"), f"{directory}/hybrid_alpha.tsv", ["id"])

    def expression(self, kind: str) -> DataFrame:
        """The isoforms with tpm by the long reads (LR) or the short ones (SR) of each community."""
        if kind == "SR":
            return em.tpm_of_bases(self.isoforms, F.col("community_num_srs"))
        n = self.lr_patterns.agg(F.sum("n").alias("n_lrs"))
        joined = self.isoforms.crossJoin(F.broadcast(n))  # one row
        return em.tpm_of_reads(joined, F.col("community_num_lrs"), F.coalesce("n_lrs", F.lit(1))).drop("n_lrs") if self.sr_patterns is not None else self.isoforms


def quantify(
    spark: SparkSession,
    annotation: str | DataFrame,
    long_reads: str | DataFrame | None = None,
    short_reads: str | None = None,
    settings: QuantifySettings | None = None,
    model: Callable | dict[tuple[int, int], Callable] | None = None,
    read_length_overrides: str | DataFrame | None = None,
) -> Abundance:
    """Isoform abundances from long reads, short reads or both (settings.em_choice).

    Hybrid weighs long reads by settings.alpha, by a table (alpha_path), or by a model: a function from the SELECTED
    features to 21 errors, or several by the numbers of long and short reads they were trained at, of which the nearest
    is taken.
    """
    s = settings or QuantifySettings()
    use_lr, use_sr = s.em_choice in ("LR", "hybrid"), s.em_choice in ("SR", "hybrid")
    if not (use_lr or use_sr) or (use_lr and long_reads is None) or (use_sr and short_reads is None):
        raise ValueError(f"em_choice {s.em_choice} lacks its reads; it is LR, SR or hybrid")
    exons = formats.exons(spark, annotation) if isinstance(annotation, str) else annotation
    if isinstance(read_length_overrides, str):
        read_length_overrides = formats.read_length_overrides(spark, read_length_overrides)
    segs, iso_paths = paths.laid_out(exons)
    iso = settle(paths.isoforms(exons))
    mapped = rejected = lr = sr = eff = read_iso = fragments = lr_counts = sr_counts = None
    if use_lr:
        reads = formats.alignments(spark, long_reads, s.read_filter) if isinstance(long_reads, str) else long_reads
        mapped = mapping.map_reads(reads, paths.gene_segments(segs), iso_paths, s)
        rejected = mapping.rejected_reads(reads, mapped)
        owned = paths.owners(mapped, iso_paths)
        read_iso = settle(mapping.isoform_offsets(mapped, owned, iso, s.strand_strict))
        unique = s.initial_theta.endswith("_unique")
        lr = settle(communities.patterns(readlen.compatibilities(read_iso, iso, s.cond_prob, unique, s.floor, read_length_overrides), "p"))
        lr_counts = readlen.fractional_counts(read_iso, unique)
    if use_sr:
        if not formats.first_read_length(spark, short_reads, 0):
            raise ValueError(f"no short read in {short_reads} has a CIGAR")
        known = iso.select("isoform", "length")
        every = formats.all_fragment_lengths(spark, short_reads).join(known, "isoform", "left_semi")
        mean, std = shortread.fragment_statistics(every)
        mean, std = s.mean_f_len or mean, s.std_f_len or std
        lengths = formats.sequence_lengths(spark, short_reads).join(known.select("isoform"), "isoform", "left_semi")
        eff = settle(shortread.effective_lengths(lengths, mean, std))
        fragments = formats.fragments(spark, short_reads).join(known, "isoform", "left_semi")
        sr = settle(communities.patterns(shortread.compatibilities(fragments, eff, mean, std), "w"))
        sr_counts = shortread.fractional_counts(fragments, eff)
    tables = [t for t in (lr, sr) if t is not None]
    members = settle(communities.communities(iso.select("isoform", "gene"), *tables))
    if isinstance(model, dict):
        n_lr, n_sr = (t.agg(F.sum("n")).first()[0] or 0 if t is not None else 0 for t in (lr, sr))
        model = model[features.nearest_model({m: m for m in model}, n_lr, n_sr)]
    alphas = community_alphas(spark, s, members, model, exons, segs, iso, iso_paths, read_iso, fragments) if use_sr else None
    solved = settle(em.run(members, lr, sr, eff, alphas, s))  # read by each of the files

    def reads_of(table: DataFrame | None, name: str) -> DataFrame:
        if table is None:
            return members.select("community").distinct().withColumn(name, F.lit(0).cast("long"))
        first = table.select("n", F.col("members")[0]["isoform"].alias("isoform")).join(members, "isoform")
        return first.groupBy("community").agg(F.sum("n").alias(name))

    out = solved.join(members.select("isoform", "gene"), "isoform")
    out = out.join(eff, "isoform", "left") if eff is not None else out.withColumn("eff", F.lit(1.0))
    for table, name in ((lr, "community_num_lrs"), (sr, "community_num_srs")):
        out = out.join(merged(reads_of(table, name)), "community", "left")
    out = out.fillna(0, ["community_num_lrs", "community_num_srs"]).fillna(1.0, ["eff"])
    if not use_sr:
        n = (lr.agg(F.sum("n")).first()[0] or 0) + s.phantom_rows
        out = em.tpm_of_reads(out, F.col("community_num_lrs"), F.lit(n or 1))
    else:
        out = em.tpm_of_bases(out, F.col("community_num_srs"))
    return Abundance(out, lr, sr, mapped, rejected, alphas, lr_counts, sr_counts)


def quantify_globally(
    spark: SparkSession,
    annotation: str | DataFrame,
    long_reads: str | DataFrame,
    settings: QuantifySettings | None = None,
    form: str = "form_1",
    start: str = "LR",
    rounds: int = 2000,
    tolerance: float = 1e-3,
    seed: int = 0,
) -> DataFrame:
    """rows (isoform, gene, theta, tpm) from long reads, whose probabilities follow theta in each round (global_em)."""
    s = settings or QuantifySettings()
    exons = formats.exons(spark, annotation) if isinstance(annotation, str) else annotation
    iso, read_iso = read_isoforms(spark, exons, long_reads, s)
    sets = settle(global_em.length_sets(read_iso))
    hist = settle(sets.groupBy("read_len").agg(F.sum("n").alias("n")))
    known = readlen.cdf_at(hist, iso.select("isoform", F.col("length").alias("iso_len")), "iso_len")
    counts = settle(readlen.fractional_counts(read_iso, s.initial_theta.endswith("_unique")))
    theta = settle(global_em.starting_theta(iso, start, lr=counts, seed=seed))
    found, _ = global_em.iterate(sets, known, hist, theta, form, rounds, tolerance, s.floor)
    total = F.sum("theta").over(Window.partitionBy())
    tpm = F.col("theta") / F.when(total == 0, 1).otherwise(total) * 1e6
    return iso.select("isoform", "gene").join(found, "isoform").withColumn("tpm", tpm)


def read_isoforms(spark: SparkSession, exons: DataFrame, long_reads: str | DataFrame, s: QuantifySettings) -> tuple[DataFrame, DataFrame]:
    """(isoforms, reads against their isoforms) of a SAM path or a table of alignments."""
    segs, iso = paths.segments(exons), paths.isoforms(exons)
    iso_paths = paths.paths(segs, exons)
    reads = formats.alignments(spark, long_reads, s.read_filter) if isinstance(long_reads, str) else long_reads
    mapped = mapping.map_reads(reads, paths.gene_segments(segs), iso_paths, s)
    return iso, settle(mapping.isoform_offsets(mapped, paths.owners(mapped, iso_paths), iso, s.strand_strict))


def density_weights(
    spark: SparkSession,
    annotation: str | DataFrame,
    long_reads: str | DataFrame,
    iso_width: float = 100.0,
    read_width: float = 50.0,
    least: int = 1,
    settings: QuantifySettings | None = None,
) -> DataFrame:
    """rows (chr, gene, isoform, region, weight), for k_values(weights=...): each region by the density of the long reads
    over isoform length and read length."""
    exons = formats.exons(spark, annotation) if isinstance(annotation, str) else annotation
    iso, read_iso = read_isoforms(spark, exons, long_reads, settings or QuantifySettings())
    segs = paths.segments(exons)
    lengths = iso.select(F.col("length").cast("long").alias("iso_len"))
    table = settle(density.density(settle(density.samples_of(read_iso)), lengths, iso_width, read_width))
    return density.region_weights(paths.slices(paths.paths(segs, exons), segs), iso, table, least)


def community_alphas(spark, s, members, model, exons, segs, iso, iso_paths, read_iso, fragments) -> DataFrame:
    """rows (community, alpha): fixed, from a table, or predicted from the communities' features."""
    names = members.select("community").distinct()
    if s.em_choice == "SR":
        return names.withColumn("alpha", F.lit(0.0))
    if s.alpha is not None:
        return names.withColumn("alpha", F.lit(float(s.alpha)))
    if s.alpha_path:
        # communities in a table are numbered in the order of their names
        numbered = names.withColumn("id", F.row_number().over(Window.orderBy("community")) - 1)
        table = formats.alphas(spark, s.alpha_path).withColumnRenamed("community", "id")
        return numbered.join(table, "id").select("community", "alpha")
    if model is None:
        raise ValueError("hybrid needs alpha, alpha_path or a model")
    lists = feature_lists(spark, exons, segs, iso, iso_paths, read_iso, fragments, s)
    found = features.community_features(members.select("gene", "community").distinct(), lists)
    return features.predict_alpha(found, model).select("community", "alpha", "error")


def feature_lists(spark, exons, segs, iso, iso_paths, read_iso, fragments, s: QuantifySettings) -> dict[str, DataFrame]:
    """rows (gene, value) of each list that the features describe."""
    value = lambda df, c: df.select("gene", F.expr(c).cast("double").alias("value"))
    raw = exons.select(*GENE, "start", "end").distinct()
    islands = intervals.merge(raw, GENE)
    # the first exon of each island stands for the whole island among the exon lengths
    first = raw.join(islands.withColumnRenamed("end", "i_end"), [*GENE, "start"], "left")
    first = first.withColumn("rn", F.row_number().over(Window.partitionBy(*GENE, "start").orderBy("end")))
    lists = {
        "gene_length": value(islands.groupBy(*GENE).agg(F.sum(F.expr("end - start + 1")).alias("v")), "v"),
        "isoform_lengths": value(iso, "length"),
        "exon_lengths": value(first, "if(rn = 1, coalesce(i_end, end), end) - start + 1"),
        "region_lengths": value(paths.slices(iso_paths, segs), "len"),
        "SR_kvalue": value(k_values(spark, exons).genes, "sr_generalized"),
    }
    if read_iso is not None:
        k = read_iso.withColumn("k", F.count("*").over(Window.partitionBy("name", *GENE, "path")))
        one, many = k.where("k = 1"), k.where("k > 1").dropDuplicates(["name", *GENE, "path"])
        lists |= {"unique_mapping_LRs": value(one, "read_length"), "multi_mapping_LRs": value(many, "read_length")}
        lists |= {"5_end_truncation": value(one, "off5 / iso_len"), "3_end_truncation": value(one, "off3 / iso_len")}
    if fragments is not None:
        k = fragments.join(iso.select("isoform", "gene"), "isoform").withColumn("k", F.count("*").over(Window.partitionBy("name")))
        lists |= {"unique_mapping_SRs": value(k.where("k = 1"), "tlen"), "multi_mapping_SRs": value(k.where("k > 1"), "tlen")}
    return lists
