"""Queries that judge scores and calls against the listed chromosomes, and the SQL that must agree with them.

The truth of a chromosome is whether chr_ctx of ctx_details lists it for the run (manifest lists by sample, not by run).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segscan.functions.text import bare_chrom, path_key, sample_key
from segscan.operators import evaluation, scores, segments
from segscan.operators.joins import lookup
from segscan.operators.learned import out_of_fold
from segscan.operators.packed import unpack
from segscan.plans.cohort import _BLANK, _CLEAN
from segscan.plans.nomination import _SCORED, _TRUTH, KEY, _scored, _segments, _with_truth
from segscan.plans.preparation import ORACLE as _PREPARATION
from segscan.sources.tables import checkpointed, table

#: Thresholds of the sweep, and of the search for the best one.
SWEEP = [round(0.05 * i, 2) for i in range(1, 20)]
SEARCH = [round(0.02 * i, 3) for i in range(1, 50)]
R = scores.Ramps()
REGISTER = ["facets_id", "chrom", "marks", "osc_chain", "interleave"]


def _called(spark: SparkSession, d: str) -> DataFrame:
    return scores.nominate(_with_truth(spark, d), "ctx_suppress", "noise")


def seg_run_structure(spark: SparkSession, d: str) -> DataFrame:
    return segments.run_structure(_segments(spark, d)).select(*KEY, "n_changes", F.round("two_state_dominance", 6).alias("two_state_dominance"), "median_run_length", "n_singleton_runs")


def seg_scores_gated(spark: SparkSession, d: str) -> DataFrame:
    gates = scores.Gates(amplitude=(F.col("amplitude"), 2), levels=(F.col("levels"), 3, 0.25), loh=F.col("frac_loh"))
    ways = [F.round(scores.evidence(F.col("osc_chain"), F.col("interleave"), F.col("marks"), how, gates=gates), 6).alias(f"gated_{how}") for how in ("sum", "product")]
    return _scored(spark, d).select(*KEY, *ways)


def sample_flags(spark: SparkSession, d: str) -> DataFrame:
    return scores.flag_samples(scores.nominate(_scored(spark, d), "ctx_suppress", "noise"), "facets_id", "nominated")


def seg_nominations_by_noise(spark: SparkSession, d: str) -> DataFrame:
    df = _with_truth(spark, d)
    score = scores.suppressed(scores.evidence(F.col("osc_chain"), F.col("interleave"), F.col("marks"), "sum"), F.col("confidence"))
    out = scores.nominate_by_noise(df.withColumn("score_sum", score), "score_sum", "noise", F.col("truth"))
    return out.select(*KEY, "score_pass", "noise_max", "noise_veto", "nominated")


def chromosome_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return _called(spark, d).select(*KEY, evaluation.chromosome_outcome(F.col("nominated"), F.col("truth")).alias("outcome"))


def classifier_report(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.classifier_report(_called(spark, d), "facets_id", F.col("nominated"), F.col("truth"))


def _sweep(spark: SparkSession, d: str, thresholds: list[float]) -> DataFrame:
    return evaluation.sample_sweep(_with_truth(spark, d), "facets_id", F.col("ctx_suppress"), F.col("truth"), thresholds)


def sample_sweep(spark: SparkSession, d: str) -> DataFrame:
    return _sweep(spark, d, SWEEP)


def best_threshold(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.best_threshold(_sweep(spark, d, SEARCH))


def compare_scores(spark: SparkSession, d: str) -> DataFrame:
    """Each way of combining the evidence at its best threshold, with intervals from 2,000 resamples of whole samples."""
    ways = ("sum", "product", "min", "geom", "osc_primary", "noisy_and")
    each = [F.round(scores.evidence(F.col("osc_chain"), F.col("interleave"), F.col("marks"), how), 9).alias(how) for how in ways]
    df = checkpointed(_with_truth(spark, d).select("facets_id", "truth", *each))  # eight columns, read once per way
    found = None
    for how in ways:
        best = evaluation.best_threshold(evaluation.sample_sweep(df, "facets_id", F.col(how), F.col("truth"), SEARCH)).withColumn("score", F.lit(how))
        found = best if found is None else found.unionByName(best)
    return evaluation.bootstrap(found)


def score_means(spark: SparkSession, d: str) -> DataFrame:
    return _with_truth(spark, d).groupBy(F.coalesce("truth", F.lit(False)).alias("truth")).agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in ("ctx_score", "ctx_suppress", "osc_chain", "interleave")])


def positive_register(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.positive_register(_with_truth(spark, d), "facets_id", F.col("truth"), "ctx_suppress", R.threshold, REGISTER).withColumn("ctx_suppress", F.round("ctx_suppress", 9))


def false_positive_register(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.false_positive_register(_with_truth(spark, d), "facets_id", F.col("truth"), "ctx_suppress", R.threshold, REGISTER[1:]).withColumn("ctx_suppress", F.round("ctx_suppress", 9))


def marks_residual(spark: SparkSession, d: str) -> DataFrame:
    counts = _segments(spark, d).groupBy(*KEY).agg(F.count("*").alias("n_segments"), F.sum("num_mark").alias("marks"))
    return evaluation.residual(counts, "n_segments", "marks").select(*KEY, F.round("n_segments_residual", 5).alias("n_segments_residual"))


def _listed(spark: SparkSession, d: str) -> DataFrame:
    """``sample, chrom, truth``: chromosomes that manifest lists for a sample, in any of its rows."""
    return unpack(table(spark, d, "manifest").select(sample_key("sample_id").alias("sample"), "chr_ctx").filter("sample IS NOT NULL"), "chr_ctx", "chrom", "pos").select("sample", "chrom", F.lit(True).alias("truth")).distinct()


def penalty_calibration(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "cp_features").select(sample_key("sample_id").alias("sample"), bare_chrom("chrom").alias("chrom"), "pen_const", "cp_n_changepoints", "file_id")
    return evaluation.calibration(lookup(rows, _listed(spark, d), ["sample", "chrom"], F.col("file_id")), "pen_const", "cp_n_changepoints", F.col("truth"))


def sample_ledger(spark: SparkSession, d: str) -> DataFrame:
    """What each row of manifest has: a path, a file listed there now, purity and ploidy, listed chromosomes; how often its sample is listed; whether it can be processed."""
    manifest = table(spark, d, "manifest").withColumns({"key": sample_key("sample_id"), "path": path_key("facets_cncf_path")})
    there = table(spark, d, "facets_files").filter("deleted_at IS NULL").select(path_key("file_path").alias("path"), F.lit(True).alias("there")).distinct()
    lists = unpack(manifest.select("row_id", "chr_ctx"), "chr_ctx", "chrom", "pos").groupBy("row_id").agg(F.count("*").alias("n_chrom"))
    often = manifest.filter("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n_rows"))
    rows = lookup(lookup(manifest, there, ["path"], F.col("row_id")), often, ["key"], F.col("row_id")).join(lists, "row_id", "left")
    has_path, exists, fit = F.col("path").isNotNull(), F.coalesce("there", F.lit(False)), F.col("purity").isNotNull() & F.col("ploidy").isNotNull()
    return rows.select("row_id", has_path.alias("has_path"), exists.alias("cncf_exists"), fit.alias("has_purity_ploidy"), (F.coalesce("n_chrom", F.lit(0)) > 0).alias("has_chr_ctx"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), (has_path & exists & fit).alias("processable"))


def learned_scores(spark: SparkSession, d: str) -> DataFrame:
    return out_of_fold(_with_truth(spark, d), list(KEY), ["osc_chain", "interleave", "marks", "amplitude", "frac_loh", "altered_union_frac", "altered_span_frac", "n_altered_islands", "confidence", "noise", "levels"], "facets_id", F.col("truth"))


QUERIES = {q.__name__: q for q in (seg_run_structure, seg_scores_gated, sample_flags, seg_nominations_by_noise, chromosome_outcomes, classifier_report, sample_sweep, best_threshold, compare_scores, score_means, positive_register, false_positive_register, marks_residual, penalty_calibration, sample_ledger, learned_scores)}

_KEYED = f"CASE WHEN upper(trim({{0}}, {_BLANK})) NOT IN ('', 'NA') THEN upper(trim({{0}}, {_BLANK})) END"
_CALLED = f"{_SCORED}, {_TRUTH}, called AS (SELECT *, coalesce(sup >= 0.35 AND osc_chain >= 5 AND NOT veto AND NOT weak, false) AS nom FROM st)"
_EXTREMES = f"{_SCORED}, {_TRUTH}, x AS (SELECT facets_id, bool_or(truth) AS pos, max(sup) AS best, max(sup) FILTER (truth) AS best_true FROM st GROUP BY ALL)"
_SWEPT = """sw AS (SELECT t AS threshold, count(*) FILTER (pos) AS n_pos, count(*) FILTER (NOT pos) AS n_neg, count(*) FILTER (pos AND best_true >= t) AS pos_recovered, count(*) FILTER (pos AND NOT coalesce(best_true >= t, false)) AS pos_missed, count(*) FILTER (NOT pos AND NOT coalesce(best >= t, false)) AS neg_correct,
  count(*) FILTER (NOT pos AND best >= t) AS neg_false_positive, count(*) FILTER (CASE WHEN pos THEN NOT coalesce(best_true >= t, false) ELSE coalesce(best >= t, false) END) AS sample_errors FROM x, (SELECT unnest({}::DOUBLE[]) AS t) GROUP BY t)"""
_CODES = "codes AS (SELECT facets_id, 'C' || lpad(CAST(row_number() OVER (ORDER BY facets_id) AS VARCHAR), greatest(2, length(CAST(count(*) OVER () AS VARCHAR)))::INTEGER, '0') AS code FROM (SELECT DISTINCT facets_id FROM st WHERE truth))"

ORACLE = {
    "seg_run_structure": f"""WITH {_CLEAN}, i AS (SELECT *, row_number() OVER (PARTITION BY facets_id, chrom ORDER BY loc_start, loc_end) AS i FROM s),
t AS (SELECT *, CASE WHEN tcn IS NOT NULL AND lcn IS NOT NULL THEN concat(tcn, '|', lcn) ELSE concat('row', i) END AS tok FROM i),
l AS (SELECT *, lag(tok) OVER (PARTITION BY facets_id, chrom ORDER BY i) AS p FROM t),
r AS (SELECT *, sum(CASE WHEN p = tok THEN 0 ELSE 1 END) OVER (PARTITION BY facets_id, chrom ORDER BY i) AS run FROM l),
n AS (SELECT facets_id, chrom, run, count(*) AS len FROM r GROUP BY ALL),
o AS (SELECT facets_id, chrom, median(len) AS median_run_length, count(*) FILTER (len = 1) AS n_singleton_runs, count(*) - 1 AS n_changes FROM n GROUP BY ALL),
q AS (SELECT facets_id, chrom, max(c) AS top FROM (SELECT facets_id, chrom, least(p, tok), greatest(p, tok), count(*) AS c FROM l WHERE p <> tok GROUP BY ALL) GROUP BY ALL)
SELECT o.facets_id, o.chrom, n_changes, coalesce(round(top / n_changes, 6), 0.0) AS two_state_dominance, median_run_length, n_singleton_runs FROM o LEFT JOIN q ON (q.facets_id, q.chrom) = (o.facets_id, o.chrom)""",
    "seg_scores_gated": f"""WITH {_SCORED}, g AS (SELECT *, CASE WHEN amplitude >= 2 THEN o ELSE 0 END * pow(0.75, greatest(coalesce(levels, 0) - 3, 0)) AS go,
  0.25 + 0.75 * CASE WHEN coalesce(marks, 0) >= 4 THEN greatest(greatest(least((interleave - 1) / 5.0, 1), 0), greatest(least((frac_loh - 0.3) / (0.7 - 0.3), 1), 0)) ELSE 0 END AS ga FROM sc)
SELECT facets_id, chrom, round(CAST(0.6 * go + 0.4 * ga AS DOUBLE), 6) AS gated_sum, round(CAST(go * ga AS DOUBLE), 6) AS gated_product FROM g""",
    "sample_flags": f"WITH {_CALLED} SELECT facets_id, bool_or(nom) AS flagged, count(*) FILTER (nom) AS n_nominated FROM called GROUP BY ALL",
    "seg_nominations_by_noise": f"""WITH {_SCORED}, {_TRUTH}, p AS (SELECT *, coalesce((0.6 * o + 0.4 * a) * greatest(least(coalesce(confidence, 0) / 3, 1), 0) >= 0.558, false) AS pass FROM st), m AS (SELECT max(noise) FILTER (pass AND truth) AS noise_max FROM p)
SELECT facets_id, chrom, pass AS score_pass, noise_max, coalesce(noise > noise_max, false) AS noise_veto, pass AND NOT coalesce(noise > noise_max, false) AS nominated FROM p, m""",
    "chromosome_outcomes": f"WITH {_CALLED} SELECT facets_id, chrom, CASE WHEN truth AND nom THEN 'caught' WHEN truth THEN 'MISSED' WHEN nom THEN 'false_positive' ELSE 'true_negative' END AS outcome FROM called",
    "classifier_report": f"""WITH {_CALLED}, c AS (SELECT count(*) FILTER (truth AND nom) AS caught, count(*) FILTER (truth AND NOT nom) AS missed_chrom, count(*) FILTER (NOT truth AND nom) AS false_positive, count(*) FILTER (NOT truth AND NOT nom) AS true_negative FROM called),
g AS (SELECT facets_id, bool_or(truth) AS p, bool_or(nom) AS n, bool_or(truth AND nom) AS r FROM called GROUP BY ALL)
SELECT c.*, (SELECT count(*) FROM g WHERE p) AS n_positive, (SELECT count(*) FROM g WHERE p AND r) AS recovered, (SELECT count(*) FROM g WHERE p AND NOT r) AS missed, (SELECT count(*) FROM g WHERE NOT p AND n) AS sample_false_positive, (SELECT count(*) FROM g WHERE (p AND NOT r) OR (NOT p AND n)) AS errors FROM c""",
    "sample_sweep": f"WITH {_EXTREMES}, {_SWEPT.format(SWEEP)} SELECT * FROM sw",
    "best_threshold": f"WITH {_EXTREMES}, {_SWEPT.format(SEARCH)} SELECT * FROM sw ORDER BY sample_errors, pos_recovered DESC, threshold LIMIT 1",
    "score_means": f"WITH {_SCORED}, {_TRUTH} SELECT truth, count(*) AS n, round(avg(score), 6) AS mean_ctx_score, round(avg(sup), 6) AS mean_ctx_suppress, round(avg(osc_chain), 6) AS mean_osc_chain, round(avg(interleave), 6) AS mean_interleave FROM st GROUP BY ALL",
    "positive_register": f"WITH {_SCORED}, {_TRUTH}, {_CODES} SELECT code, st.facets_id, chrom, CAST(marks AS BIGINT) AS marks, osc_chain, interleave, round(sup, 9) AS ctx_suppress, sup >= 0.35 AS nominated, CASE WHEN sup >= 0.35 THEN 'caught' ELSE 'MISSED' END AS status FROM st JOIN codes USING (facets_id) WHERE truth",
    "false_positive_register": f"""WITH {_SCORED}, {_TRUTH}, w AS (SELECT *, bool_or(truth) OVER (PARTITION BY facets_id) AS p FROM st)
SELECT facets_id, chrom, CAST(marks AS BIGINT) AS marks, osc_chain, interleave, round(sup, 9) AS ctx_suppress, CASE WHEN p THEN 'pos_sample_wrong_chrom' ELSE 'neg_sample' END AS fp_type FROM w WHERE NOT truth AND sup >= 0.35""",
    "marks_residual": f"""WITH {_CLEAN}, c AS (SELECT facets_id, chrom, count(*) AS n, sum(num_mark) AS m FROM s GROUP BY ALL), l AS (SELECT count(*) FILTER (m IS NOT NULL) AS k, regr_slope(n, ln(1 + m)) AS b1, regr_intercept(n, ln(1 + m)) AS b0 FROM c)
SELECT facets_id, chrom, round(CASE WHEN k > 10 THEN n - (b0 + b1 * ln(1 + m)) END, 5) AS n_segments_residual FROM c, l""",
    "penalty_calibration": f"""WITH p1 AS ({_PREPARATION["p1_found"]}), listed AS (SELECT DISTINCT {_KEYED.format("sample_id")} AS sample, chrom_value AS chrom FROM p1 JOIN manifest USING (row_id) WHERE src_table = 'manifest'),
f AS (SELECT pen_const, cp_n_changepoints AS n, EXISTS (SELECT 1 FROM listed l WHERE l.sample = {_KEYED.format("c.sample_id")} AND l.chrom = regexp_replace(trim(c.chrom, {_BLANK}), '^chr', '', 'i')) AS t FROM cp_features c WHERE pen_const IS NOT NULL AND cp_n_changepoints IS NOT NULL)
SELECT pen_const, median(n) FILTER (NOT t) AS neg_median, round(avg(n) FILTER (NOT t), 2) AS neg_mean, quantile_cont(n, 0.9) FILTER (NOT t) AS neg_p90, median(n) FILTER (t) AS pos_median, round(avg(n) FILTER (t), 2) AS pos_mean, count(*) FILTER (NOT t) AS n_neg, count(*) FILTER (t) AS n_pos FROM f GROUP BY ALL""",
    "sample_ledger": f"""WITH p1 AS ({_PREPARATION["p1_found"]}), m AS (SELECT *, {_KEYED.format("sample_id")} AS k, CASE WHEN upper(trim(facets_cncf_path, {_BLANK})) NOT IN ('', 'NA') THEN trim(facets_cncf_path, {_BLANK}) END AS p FROM manifest),
e AS (SELECT *, p IS NOT NULL AND p IN (SELECT trim(file_path, {_BLANK}) FROM facets_files WHERE deleted_at IS NULL) AS x, purity IS NOT NULL AND ploidy IS NOT NULL AS f, CASE WHEN k IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY k) END AS n FROM m)
SELECT row_id, p IS NOT NULL AS has_path, coalesce(x, false) AS cncf_exists, f AS has_purity_ploidy, row_id IN (SELECT row_id FROM p1 WHERE src_table = 'manifest') AS has_chr_ctx, n AS n_rows, p IS NOT NULL AND coalesce(x, false) AND f AS processable FROM e""",
}
