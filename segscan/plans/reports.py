"""Queries that put the operators together or pick rows for a report, with the SQL that must agree with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segscan.functions.tails import chi2_tail, t_tails
from segscan.operators import cohort, segments
from segscan.operators.footprint import footprint
from segscan.operators.probes import edge_ranks
from segscan.operators.running import cumulate
from segscan.plans import cohort as plan
from segscan.plans import figures, nomination
from segscan.plans import probes as probe_plan
from segscan.plans.cohort import _CLEAN, _SCREEN
from segscan.plans.evaluation import ORACLE as _EVALUATION
from segscan.plans.nomination import _SCORED, _SPAN, _TRUTH, KEY, _segments
from segscan.sources.tables import table

#: Colours of a heat map by whole copies from 0 on, the last for all above.
SHADES = ["blue", "skyblue", "white", "mistyrose", "salmon", "red", "darkred"]


def cohort_features(spark: SparkSession, d: str) -> DataFrame:
    """One table of features: states, runs and footprint of every chromosome of a run, its contrast within the run, and whether it is listed."""
    rows = _segments(spark, d)
    both = segments.segment_features(rows).select(*KEY, "n_segments", "n_states", "oscillation_excess", "chain_k3", "frac_loh")
    runs = segments.run_structure(rows).select(*KEY, "n_changes", "two_state_dominance", "median_run_length")
    foot = footprint(rows).select(*KEY, "altered_union_frac", "n_altered_islands")
    all_ = both.join(runs, list(KEY)).join(foot, list(KEY)).join(plan._labels(spark, d), list(KEY), "left")
    out = segments.within_sample(all_.withColumn("n_changes_d", F.col("n_changes").cast("double")), "facets_id", ["n_changes_d"])
    return out.select(*KEY, "n_segments", "n_states", "n_changes", "chain_k3", "median_run_length", "n_altered_islands", F.col("n_changes_d_rank").alias("changes_rank"), F.coalesce("truth", F.lit(False)).alias("truth"), *[F.round(c, 6).alias(n) for c, n in (("oscillation_excess", "oscillation_excess"), ("frac_loh", "frac_loh"), ("two_state_dominance", "two_state_dominance"), ("altered_union_frac", "altered_union_frac"), ("n_changes_d_ratio", "changes_ratio"))])


def longest_segments(spark: SparkSession, d: str) -> DataFrame:
    """The 15 segments with most marks."""
    return _segments(spark, d).filter("num_mark IS NOT NULL").orderBy(F.col("num_mark").desc(), "facets_id", "chrom", "loc_start").limit(15).select("facets_id", "chrom", "loc_start", "num_mark")


def best_of_each_class(spark: SparkSession, d: str) -> DataFrame:
    """The five chromosomes of highest score among the listed ones, and among the others."""
    rows = nomination._with_truth(spark, d).select(*KEY, F.coalesce("truth", F.lit(False)).alias("truth"), F.round("ctx_suppress", 9).alias("ctx_suppress"))
    return cohort.first_of_each(rows, "truth", [F.col("ctx_suppress").desc(), F.col("facets_id"), F.col("chrom")], 5)


def sampled_chromosomes(spark: SparkSession, d: str) -> DataFrame:
    """400 chromosomes in an order that only looks random: by a digest of their name and a seed."""
    names = _segments(spark, d).select("facets_id", "chrom").distinct()
    return names.orderBy(F.md5(F.concat_ws("/", "facets_id", "chrom", F.lit("seed 0")))).limit(400)


def patient_order(spark: SparkSession, d: str) -> DataFrame:
    """Patients by their altered genes, the first gene before all others, then by name."""
    odd = F.coalesce(F.sum(F.when(F.col("alteration") == "AF", F.col("l_quantity")).cast("long")) % 2 == 1, F.lit(False))
    flags = figures._altered(spark, d).groupBy("patient").pivot("gene", figures.GENES).agg(odd)
    order = F.struct(*[~F.coalesce(F.col(g), F.lit(False)) for g in figures.GENES], "patient")
    return cumulate(flags, [], order, place=("count", "patient")).select("patient", "place")


def called_cases(spark: SparkSession, d: str) -> DataFrame:
    """Rows of ctx_details whose run has a chromosome that passes the screen."""
    called = plan.merge_screen(spark, d).filter("n_oscil >= 3 AND n_seg >= 5").select("facets_id")
    return table(spark, d, "ctx_details").select("row_id", "study_id", "facets_id").join(called, "facets_id", "left_semi")


def shaded_segments(spark: SparkSession, d: str) -> DataFrame:
    """How many segments of each chromosome have which colour."""
    copies = F.least(F.greatest(F.rint("tcn"), F.lit(0.0)), F.lit(len(SHADES) - 1.0)).cast("int")
    return _segments(spark, d).filter("tcn IS NOT NULL").groupBy("chrom", F.element_at(F.array(*map(F.lit, SHADES)), copies + 1).alias("shade")).agg(F.count("*").alias("n"))


def segment_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Segments in ranks of the probes of their chromosome."""
    points = probe_plan.probes(spark, d)
    rows = probe_plan.item_segments(spark, d).select(*probe_plan.KEY, "loc_start", "loc_end")
    first = edge_ranks(rows, points, probe_plan.KEY, "loc_start", "maploc").withColumnRenamed("rank", "first_rank")
    both = edge_ranks(first, points, probe_plan.KEY, "loc_end", "maploc")
    size = points.groupBy(*probe_plan.KEY).agg(F.count("*").alias("n_probes"))
    return both.join(size, probe_plan.KEY).select(*probe_plan.KEY, "loc_start", "first_rank", F.least("rank", F.col("n_probes") - 1).alias("last_rank"))


def chain_support(spark: SparkSession, d: str) -> DataFrame:
    """Probes within the longest oscillation chain of their chromosome."""
    key = probe_plan.KEY
    chains = footprint(probe_plan.item_segments(spark, d), tuple(key)).select(*key, "osc_chain_start", "osc_chain_end")
    inside = F.col("maploc").between(F.col("osc_chain_start"), F.col("osc_chain_end"))
    counts = chains.join(probe_plan.probes(spark, d).select(*key, "maploc"), key, "left").groupBy(*key).agg(F.count_if(inside).alias("osc_chain_n_probes"), F.count("maploc").alias("_n"))
    return counts.select(*key, "osc_chain_n_probes", F.round(F.try_divide("osc_chain_n_probes", "_n"), 6).alias("osc_chain_frac_probes"))


def log_rank_p(spark: SparkSession, d: str) -> DataFrame:
    pairs = figures.pairwise_log_rank(spark, d)
    return cohort.step_up(pairs.withColumn("p_value", chi2_tail(F.col("chi2"), 1)), "p_value", "q_value")


def mean_contrast_p(spark: SparkSession, d: str) -> DataFrame:
    return nomination.mean_contrast(spark, d).withColumn("p_value", t_tails(F.col("t"), F.col("df")))


QUERIES = {q.__name__: q for q in (cohort_features, longest_segments, best_of_each_class, sampled_chromosomes, patient_order, called_cases, shaded_segments, segment_ranks, chain_support, log_rank_p, mean_contrast_p)}

_SHADE = "[" + ", ".join(f"'{s}'" for s in SHADES) + "]"
_FSEG = probe_plan.SEGMENTS.replace("(q % 9 - 4) / 4.0 AS cnlr_median", "p * 1000.0 + 500 + 10 * q AS loc_end, CAST(CASE WHEN q % 11 <> 0 THEN q % 2 END AS DOUBLE) AS lcn")

ORACLE = {
    "cohort_features": f"""WITH f AS ({plan.ORACLE["seg_features"]}), r AS ({_EVALUATION["seg_run_structure"]}), sp AS (WITH {_SPAN} SELECT facets_id, chrom, islands, union_ / nullif(total, 0) AS uf FROM foot), st AS (WITH {_SCORED}, {_TRUTH} SELECT facets_id, chrom, truth FROM st),
a AS (SELECT f.facets_id, f.chrom, f.n_segments, f.n_states, r.n_changes, f.chain_k3, r.median_run_length, sp.islands, f.oscillation_excess, f.frac_loh, r.two_state_dominance, uf, truth FROM f JOIN r ON (r.facets_id, r.chrom) = (f.facets_id, f.chrom) JOIN sp ON (sp.facets_id, sp.chrom) = (f.facets_id, f.chrom) JOIN st ON (st.facets_id, st.chrom) = (f.facets_id, f.chrom))
SELECT facets_id, chrom, n_segments, n_states, n_changes, chain_k3, median_run_length, islands AS n_altered_islands, CAST(rank() OVER (PARTITION BY facets_id ORDER BY n_changes DESC) AS INTEGER) AS changes_rank, truth, oscillation_excess, frac_loh, two_state_dominance, round(uf, 6) AS altered_union_frac, round(n_changes / nullif(median(n_changes) OVER (PARTITION BY facets_id), 0), 6) AS changes_ratio FROM a""",
    "longest_segments": f"WITH {_CLEAN} SELECT facets_id, chrom, loc_start, num_mark FROM s WHERE num_mark IS NOT NULL ORDER BY num_mark DESC, facets_id, chrom, loc_start LIMIT 15",
    "best_of_each_class": f"WITH {_SCORED}, {_TRUTH} SELECT facets_id, chrom, truth, round(sup, 9) AS ctx_suppress, row_number() OVER (PARTITION BY truth ORDER BY round(sup, 9) DESC, facets_id, chrom) AS place FROM st QUALIFY place <= 5",
    "sampled_chromosomes": f"WITH {_CLEAN} SELECT facets_id, chrom FROM (SELECT DISTINCT facets_id, chrom FROM s) ORDER BY md5(facets_id || '/' || chrom || '/seed 0') LIMIT 400",
    "patient_order": f"""WITH {figures._ALTERED}, f AS (SELECT patient, {", ".join(f"coalesce(CAST(sum(l_quantity) FILTER (alteration = 'AF' AND gene = '{g}') AS BIGINT) % 2 = 1, false) AS {g}" for g in figures.GENES)} FROM al GROUP BY ALL)
SELECT patient, row_number() OVER (ORDER BY {", ".join(f"{g} DESC" for g in figures.GENES)}, patient) AS place FROM f""",
    "called_cases": f"WITH {_SCREEN} SELECT row_id, study_id, facets_id FROM ctx_details WHERE facets_id IN (SELECT facets_id FROM screen WHERE n_oscil >= 3 AND n_seg >= 5)",
    "shaded_segments": f"WITH {_CLEAN} SELECT chrom, {_SHADE}[CAST(least(greatest(round_even(tcn, 0), 0), {len(SHADES) - 1}) AS INTEGER) + 1] AS shade, count(*) AS n FROM s WHERE tcn IS NOT NULL GROUP BY ALL",
    "segment_ranks": f"""WITH {probe_plan.PROBES}, {_FSEG}, n AS (SELECT sample_id, chrom, count(*) AS n, list(maploc) AS l FROM pts GROUP BY ALL)
SELECT sample_id, chrom, CAST(loc_start AS DOUBLE) AS loc_start, CAST(len(list_filter(l, lambda x: x < loc_start)) AS BIGINT) AS first_rank, CAST(least(len(list_filter(l, lambda x: x < loc_end)), n - 1) AS BIGINT) AS last_rank FROM segs JOIN n USING (sample_id, chrom)""",
    "chain_support": f"""WITH {probe_plan.PROBES}, {_FSEG}, {_SPAN.replace(_CLEAN + ",", "").strip().replace("facets_id", "sample_id").replace("sum(num_mark)", "count(*)").replace("FROM s)", "FROM segs)")},
b AS (SELECT i.sample_id, i.chrom, arg_min(loc_start, i) AS a, arg_max(loc_end, i) AS z FROM i JOIN best ON (i.sample_id, i.chrom) = (best.sample_id, best.chrom) AND i.i BETWEEN a AND b GROUP BY ALL)
SELECT base.sample_id, base.chrom, count(*) FILTER (maploc BETWEEN b.a AND b.z) AS osc_chain_n_probes, round(count(*) FILTER (maploc BETWEEN b.a AND b.z) / nullif(count(maploc), 0), 6) AS osc_chain_frac_probes FROM base LEFT JOIN b ON (b.sample_id, b.chrom) = (base.sample_id, base.chrom) LEFT JOIN pts ON (pts.sample_id, pts.chrom) = (base.sample_id, base.chrom) GROUP BY ALL""",
}
