"""Queries of the footprint, score, evaluation and cohort operators and the SQL that must agree with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segscan.functions.text import bare_chrom, sample_key
from segscan.operators import cohort, scores, segments
from segscan.operators.footprint import footprint
from segscan.operators.joins import lookup
from segscan.operators.packed import unpack
from segscan.plans.cohort import _BLANK, _CLEAN
from segscan.plans.preparation import ORACLE as _PREPARATION
from segscan.sources.tables import shared_folder, table
from segscan.streaming.incremental import aggregate_available, file_stream

KEY = ("facets_id", "chrom")
SPANS = ("chrom_seg_len_mb", "osc_chain_span_mb", "osc_chain_len_sum_mb", "osc_chain_frac_chrom", "osc_chain_len_frac_chrom", "osc_chain_density_per_mb", "altered_union_mb", "altered_union_frac", "altered_span_mb", "altered_span_frac", "largest_altered_island_mb", "largest_altered_island_frac", "state_change_span_mb", "state_change_span_frac")
SCREENED = ("n_segments", "osc_chain", "interleave", "altered_union_frac", "n_altered_islands", "ctx_score")
#: The penalty whose changepoint features the scores use.
PENALTY = 3.0


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return segments.clean_segments(table(spark, d, "cncf"))


def seg_footprint(spark: SparkSession, d: str) -> DataFrame:
    return footprint(_segments(spark, d)).select(*KEY, "osc_chain", "osc_chain_n_segments", "n_altered_islands", "bp_per_osc_transition_mb", F.round("osc_chain_frac_segments", 6).alias("osc_chain_frac_segments"), F.round("osc_transition_density_per_mb", 6).alias("osc_transition_density_per_mb"), *[F.round(c, 6).alias(c) for c in SPANS])


def _scored(spark: SparkSession, d: str) -> DataFrame:
    along = Window.partitionBy(*KEY).orderBy("loc_start", "loc_end")
    rows = _segments(spark, d).withColumn("_loh", F.coalesce(F.col("lcn") == 0, F.lit(False)))
    rows = rows.withColumn("_mixed", F.lag("_loh").over(along) != F.col("_loh"))
    foot = footprint(rows, more={"interleave": F.count_if("_mixed"), "marks": F.sum("num_mark"), "sample": F.min(sample_key("sample_id")), "amplitude": F.coalesce(F.max(F.rint("tcn")) - F.min(F.rint("tcn")), F.lit(0.0)), "frac_loh": F.avg(F.col("_loh").cast("double"))})
    probes = table(spark, d, "cp_features").filter((F.col("pen_const") == PENALTY) & F.col("cp_n_probes").isNotNull()).groupBy(sample_key("sample_id").alias("sample"), bare_chrom("chrom").alias("chrom")).agg(F.min_by(F.struct("cp_osc_confidence", "cp_within_dispersion", "cp_n_levels"), F.struct("file_id", "line_no")).alias("_p"))
    all_ = lookup(foot, probes, ["sample", "chrom"], F.col("facets_id")).withColumns({"confidence": F.col("_p.cp_osc_confidence"), "noise": F.col("_p.cp_within_dispersion"), "levels": F.col("_p.cp_n_levels")})
    return all_.withColumn("ctx_score", scores.evidence(F.col("osc_chain"), F.col("interleave"), F.col("marks"), "product")).withColumn("ctx_suppress", scores.suppressed(F.col("ctx_score"), F.col("confidence")))


def seg_scores(spark: SparkSession, d: str) -> DataFrame:
    chain, inter, marks = F.col("osc_chain"), F.col("interleave"), F.col("marks")
    ways = [F.round(scores.evidence(chain, inter, marks, how), 6).alias(f"score_{how}") for how in ("sum", "product", "min", "geom", "osc_primary", "noisy_and")]
    return _scored(spark, d).select(*KEY, *ways, F.round("ctx_suppress", 10).alias("ctx_suppress"))


def seg_nominations(spark: SparkSession, d: str) -> DataFrame:
    return scores.nominate(_scored(spark, d), "ctx_suppress", "noise").select(*KEY, "score_pass", "noise_veto", "weak_footprint", "nominated")


def seg_nominations_by_span(spark: SparkSession, d: str) -> DataFrame:
    return scores.nominate(_scored(spark, d), "ctx_suppress", "noise", by_span=True, by_chain=False).select(*KEY, "score_pass", "noise_veto", "weak_footprint", "nominated")


def _with_truth(spark: SparkSession, d: str) -> DataFrame:
    truth = unpack(table(spark, d, "ctx_details").select("facets_id", "chr_ctx").filter("facets_id IS NOT NULL"), "chr_ctx", "chrom", "pos").select("facets_id", "chrom", F.lit(True).alias("truth")).distinct()
    return _scored(spark, d).join(truth, list(KEY), "left")


def feature_screen(spark: SparkSession, d: str) -> DataFrame:
    out = cohort.feature_screen(_with_truth(spark, d), list(SCREENED), F.col("truth"))
    return out.select("feature", "n", "n_pos", F.round("average_precision", 6).alias("average_precision"), F.round("auroc", 6).alias("auroc"))


def sample_outcomes(spark: SparkSession, d: str) -> DataFrame:
    called = scores.nominate(_with_truth(spark, d), "ctx_suppress", "noise")
    return cohort.entity_outcomes(called, "facets_id", F.col("nominated"), F.col("truth"))


def _times(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.floor(F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")) / 30).alias("time"), (F.col("o_orderstatus") == "F").alias("event"), F.col("o_orderpriority").alias("grp"))


def log_rank_tests(spark: SparkSession, d: str) -> DataFrame:
    return cohort.log_rank(_times(spark, d), "time", "event", "grp").select("group", "n", "observed", F.round("expected", 5).alias("expected"), F.round("chi2", 5).alias("chi2"))


def numbers_at_risk(spark: SparkSession, d: str) -> DataFrame:
    return cohort.at_risk(_times(spark, d), "time", "grp", [0, 20, 40, 60, 80, 200])


def mean_contrast(spark: SparkSession, d: str) -> DataFrame:
    rows = _segments(spark, d)
    return cohort.unequal_variance_t(rows, "num_mark", F.col("lcn") == 0).select("n_1", "n_0", *[F.round(c, 6).alias(c) for c in ("mean_1", "mean_0", "t", "df")])


def stream_segments(spark: SparkSession, d: str) -> DataFrame:
    path = f"{d}/cncf.parquet"
    stream = file_stream(spark, f"{path}*", spark.read.parquet(path).schema)
    keys = {"month": F.date_format("loaded_at", "yyyy-MM"), "chrom": bare_chrom("chrom")}
    return aggregate_available(stream, keys, {"n_rows": F.lit(1), "n_marks": F.col("num_mark").cast("long")}, shared_folder(spark, "stream"))


QUERIES = {q.__name__: q for q in (seg_footprint, seg_scores, seg_nominations, seg_nominations_by_span, feature_screen, sample_outcomes, log_rank_tests, numbers_at_risk, mean_contrast, stream_segments)}

_SPAN = f"""{_CLEAN},
i AS (SELECT *, row_number() OVER (PARTITION BY facets_id, chrom ORDER BY loc_start, loc_end) AS i, round_even(tcn, 0) AS v, round_even(lcn, 0) AS w, greatest(loc_end - loc_start, 0) AS len FROM s),
mode_ AS (SELECT facets_id, chrom, v AS mode_v FROM (SELECT facets_id, chrom, v, count(*) AS c FROM i WHERE v IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY facets_id, chrom ORDER BY c DESC, v) = 1),
al AS (SELECT i.*, coalesce(v <> mode_v, false) AS alt, i > 1 AND lag(CASE WHEN v IS NOT NULL AND w IS NOT NULL THEN concat(v, '|', w) END) OVER q IS DISTINCT FROM CASE WHEN v IS NOT NULL AND w IS NOT NULL THEN concat(v, '|', w) END AS moved FROM i LEFT JOIN mode_ USING (facets_id, chrom) WINDOW q AS (PARTITION BY facets_id, chrom ORDER BY i)),
isl AS (SELECT facets_id, chrom, sum(len) AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY facets_id, chrom ORDER BY i) AS g FROM al WHERE alt) GROUP BY facets_id, chrom, g),
isl2 AS (SELECT facets_id, chrom, count(*) FILTER (l > 0) AS islands, max(l) AS largest FROM isl GROUP BY ALL),
base AS (SELECT facets_id, chrom, count(*) AS n_segments, max(loc_end) - min(loc_start) AS span, coalesce(sum(len), 0) AS total, coalesce(sum(len) FILTER (alt), 0) AS union_, coalesce(max(loc_end) FILTER (alt) - min(loc_start) FILTER (alt), 0) AS alt_span, coalesce(max(loc_start) FILTER (moved) - min(loc_start) FILTER (moved), 0) AS move_span, sum(num_mark) AS marks, coalesce(max(v) - min(v), 0) AS amplitude FROM al GROUP BY ALL),
val AS (SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY facets_id, chrom ORDER BY i) THEN 0 ELSE 1 END AS new FROM i WHERE v IS NOT NULL),
runs AS (SELECT facets_id, chrom, j, min(v) AS v, min(i) AS a, max(i) AS b FROM (SELECT *, sum(new) OVER (PARTITION BY facets_id, chrom ORDER BY i) AS j FROM val) GROUP BY ALL),
win AS (SELECT x.facets_id, x.chrom, x.j AS lo, y.j - x.j + 1 AS n, min(x.a) AS a, min(y.b) AS b FROM runs x JOIN runs y ON (x.facets_id, x.chrom) = (y.facets_id, y.chrom) AND y.j >= x.j JOIN runs z ON (z.facets_id, z.chrom) = (x.facets_id, x.chrom) AND z.j BETWEEN x.j AND y.j GROUP BY x.facets_id, x.chrom, x.j, y.j HAVING count(DISTINCT z.v) <= 3),
best AS (SELECT * FROM win QUALIFY row_number() OVER (PARTITION BY facets_id, chrom ORDER BY n DESC, lo) = 1),
chain AS (SELECT i.facets_id, i.chrom, any_value(n) AS n, count(*) AS m, arg_max(loc_end, i) - arg_min(loc_start, i) AS cspan, coalesce(sum(len), 0) AS clen FROM i JOIN best ON (i.facets_id, i.chrom) = (best.facets_id, best.chrom) AND i.i BETWEEN a AND b GROUP BY ALL),
foot AS (SELECT base.*, CAST(coalesce(n, 0) AS INTEGER) AS osc_chain, CAST(coalesce(m, 0) AS INTEGER) AS m, cspan, clen, coalesce(islands, 0) AS islands, coalesce(largest, 0) AS largest FROM base LEFT JOIN isl2 USING (facets_id, chrom) LEFT JOIN chain USING (facets_id, chrom))"""
_SCORED = f"""{_SPAN},
lohs AS (SELECT facets_id, chrom, count(*) FILTER (i > 1 AND ph <> loh) AS interleave, avg(CASE WHEN loh THEN 1.0 ELSE 0.0 END) AS frac_loh FROM (SELECT *, lag(loh) OVER (PARTITION BY facets_id, chrom ORDER BY i) AS ph FROM (SELECT *, coalesce(lcn = 0, false) AS loh FROM i)) GROUP BY ALL),
smp AS (SELECT facets_id, chrom, min(k) AS sample FROM (SELECT facets_id, regexp_replace(trim(chrom, {_BLANK}), '^chr', '', 'i') AS chrom, loc_start, CASE WHEN upper(trim(sample_id, {_BLANK})) NOT IN ('', 'NA') THEN upper(trim(sample_id, {_BLANK})) END AS k, loaded_at, row_id FROM cncf WHERE facets_id IS NOT NULL AND chrom IS NOT NULL AND loc_start IS NOT NULL QUALIFY row_number() OVER (PARTITION BY facets_id, regexp_replace(trim(chrom, {_BLANK}), '^chr', '', 'i'), loc_start ORDER BY loaded_at NULLS FIRST, row_id) = 1) GROUP BY ALL),
prb AS (SELECT upper(trim(sample_id, {_BLANK})) AS sample, regexp_replace(trim(chrom, {_BLANK}), '^chr', '', 'i') AS chrom, cp_osc_confidence AS confidence, cp_within_dispersion AS noise, cp_n_levels AS levels FROM cp_features WHERE pen_const = 3 AND cp_n_probes IS NOT NULL AND upper(trim(sample_id, {_BLANK})) NOT IN ('', 'NA') QUALIFY row_number() OVER (PARTITION BY upper(trim(sample_id, {_BLANK})), regexp_replace(trim(chrom, {_BLANK}), '^chr', '', 'i') ORDER BY file_id, line_no) = 1),
fac AS (SELECT foot.*, smp.sample, interleave, frac_loh, confidence, noise, levels, greatest(least((osc_chain - 2) / 4.0, 1), 0)::DOUBLE AS o, (0.25 + 0.75 * CASE WHEN coalesce(marks, 0) >= 4 THEN greatest(least((interleave - 1) / 5.0, 1), 0) ELSE 0 END)::DOUBLE AS a
        FROM foot JOIN lohs USING (facets_id, chrom) JOIN smp USING (facets_id, chrom) LEFT JOIN prb ON prb.sample = smp.sample AND prb.chrom = foot.chrom),
sc AS (SELECT *, o * a AS score, o * a * greatest(least(coalesce(confidence, 0) / 3, 1), 0) AS sup, coalesce(union_ / nullif(total, 0) < 0.15, true) AND islands <= 3 AS weak, coalesce(alt_span / nullif(span, 0) < 0.25, true) AS short, coalesce(noise > 1.135, false) AS veto FROM fac)"""
_TRUTH = f"""p1 AS ({_PREPARATION["p1_found"]}), truth AS (SELECT DISTINCT c.facets_id, p.chrom_value AS chrom FROM p1 p JOIN ctx_details c ON p.row_id = c.row_id WHERE p.src_table = 'ctx_details' AND c.facets_id IS NOT NULL),
st AS (SELECT sc.*, truth.chrom IS NOT NULL AS truth FROM sc LEFT JOIN truth ON truth.facets_id = sc.facets_id AND truth.chrom = sc.chrom)"""
_TIMES = """r AS (SELECT o_orderpriority AS "group", CAST(floor(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) / 30) AS BIGINT) AS time, o_orderstatus = 'F' AS ev FROM orders)"""
_VALUES = ", ".join(f"('{f}', CAST({c} AS DOUBLE))" for f, c in zip(SCREENED, ("n_segments", "osc_chain", "interleave", "union_ / nullif(total, 0)", "islands", "score")))

ORACLE = {
    "seg_footprint": f"""WITH {_SPAN} SELECT facets_id, chrom, osc_chain, m AS osc_chain_n_segments, islands AS n_altered_islands, round(total / 1e6, 6) AS chrom_seg_len_mb, round(cspan / 1e6, 6) AS osc_chain_span_mb, round(clen / 1e6, 6) AS osc_chain_len_sum_mb,
  round(cspan / nullif(span, 0), 6) AS osc_chain_frac_chrom, round(clen / nullif(total, 0), 6) AS osc_chain_len_frac_chrom, round(osc_chain / nullif(cspan / 1e6, 0), 6) AS osc_chain_density_per_mb, round(m / n_segments, 6) AS osc_chain_frac_segments, round(greatest(osc_chain - 1, 0) / nullif(cspan / 1e6, 0), 6) AS osc_transition_density_per_mb, CASE WHEN osc_chain > 1 THEN cspan / 1e6 / (osc_chain - 1) END AS bp_per_osc_transition_mb,
  round(union_ / 1e6, 6) AS altered_union_mb, round(union_ / nullif(total, 0), 6) AS altered_union_frac, round(alt_span / 1e6, 6) AS altered_span_mb, round(alt_span / nullif(span, 0), 6) AS altered_span_frac, round(largest / 1e6, 6) AS largest_altered_island_mb,
  round(largest / nullif(total, 0), 6) AS largest_altered_island_frac, round(move_span / 1e6, 6) AS state_change_span_mb, round(move_span / nullif(span, 0), 6) AS state_change_span_frac FROM foot""",
    "seg_scores": f"""WITH {_SCORED} SELECT facets_id, chrom, round(0.6 * o + 0.4 * a, 6) AS score_sum, round(o * a, 6) AS score_product, round(least(o, a), 6) AS score_min, round(pow(o, 0.6) * pow(a, 0.4), 6) AS score_geom, round(o * (0.5 + 0.5 * a), 6) AS score_osc_primary,
  round(1 - (1 - o) * (1 - a) * (1 - least(o, a)), 6) AS score_noisy_and, round(sup, 10) AS ctx_suppress FROM sc""",
    "seg_nominations": f"WITH {_SCORED} SELECT facets_id, chrom, sup >= 0.35 AS score_pass, veto AS noise_veto, weak AS weak_footprint, sup >= 0.35 AND osc_chain >= 5 AND NOT veto AND NOT weak AS nominated FROM sc",
    "seg_nominations_by_span": f"WITH {_SCORED} SELECT facets_id, chrom, sup >= 0.35 AS score_pass, veto AS noise_veto, weak OR short AS weak_footprint, sup >= 0.35 AND NOT veto AND NOT (weak OR short) AS nominated FROM sc",
    "feature_screen": f"""WITH {_SCORED}, {_TRUTH}, l AS (SELECT truth, f.feature, f.x FROM st, LATERAL (VALUES {_VALUES}) f(feature, x) WHERE f.x IS NOT NULL),
h AS (SELECT feature, dir, truth, CASE WHEN dir = 'high' THEN -x ELSE x END AS o FROM l CROSS JOIN (VALUES ('high'), ('low')) d(dir)),
p AS (SELECT feature, dir, o, count(*) FILTER (truth) AS p, count(*) AS c FROM h GROUP BY ALL),
r AS (SELECT *, sum(p) OVER w AS tp, sum(c) OVER w AS m, sum(p) OVER g AS np, sum(c) OVER g AS n FROM p WINDOW w AS (PARTITION BY feature, dir ORDER BY o), g AS (PARTITION BY feature, dir)),
e AS (SELECT feature, dir, CAST(max(n) AS BIGINT) AS n, CAST(max(np) AS BIGINT) AS n_pos, sum(p / np * tp / m) AS ap, sum((c - p) * (tp - p / 2) / (np * (n - np))) AS auc FROM r WHERE n >= 20 AND np > 0 AND np < n GROUP BY ALL)
SELECT feature, n, n_pos, round(ap, 6) AS average_precision, round(auc, 6) AS auroc FROM e QUALIFY row_number() OVER (PARTITION BY feature ORDER BY round(ap, 9) DESC, dir) = 1""",
    "sample_outcomes": f"""WITH {_SCORED}, {_TRUTH}, n AS (SELECT facets_id, truth, sup >= 0.35 AND osc_chain >= 5 AND NOT veto AND NOT weak AS called FROM st)
SELECT facets_id, CASE WHEN bool_or(called AND truth) THEN 'recovered' WHEN bool_or(truth) THEN 'missed' WHEN bool_or(called) THEN 'false_positive' ELSE 'correct_negative' END AS outcome FROM n GROUP BY ALL""",
    "log_rank_tests": f"""WITH {_TIMES}, t AS (SELECT DISTINCT time FROM r WHERE ev), k AS (SELECT "group", t.time, count(*) FILTER (r.time >= t.time) AS g, count(*) FILTER (r.time = t.time AND ev) AS o FROM r, t WHERE r.time IS NOT NULL AND ev IS NOT NULL GROUP BY ALL),
a AS (SELECT *, sum(g) OVER (PARTITION BY time) AS n, sum(o) OVER (PARTITION BY time) AS d FROM k),
x AS (SELECT "group", CAST(sum(o) AS BIGINT) AS observed, sum(d * g / n) AS expected, sum(CASE WHEN n > 1 THEN d * (g / n) * (1 - g / n) * (n - d) / (n - 1) ELSE 0 END) AS v FROM a GROUP BY ALL)
SELECT x."group", c.n, observed, round(expected, 5) AS expected, round(CASE WHEN v > 1e-9 THEN pow(observed - expected, 2) / v END, 5) AS chi2 FROM x JOIN (SELECT "group", count(*) AS n FROM r WHERE time IS NOT NULL AND ev IS NOT NULL GROUP BY ALL) c ON c."group" = x."group" """,
    "numbers_at_risk": f"""WITH {_TIMES} SELECT "group", CAST(m AS DOUBLE) AS time, count(*) FILTER (r.time >= m) AS n_risk FROM r CROSS JOIN (VALUES (0), (20), (40), (60), (80), (200)) t(m) GROUP BY "group", m""",
    "mean_contrast": f"""WITH {_CLEAN}, a AS (SELECT count(num_mark) FILTER (lcn = 0) AS n_1, count(num_mark) FILTER (lcn <> 0) AS n_0, avg(num_mark) FILTER (lcn = 0) AS mean_1, avg(num_mark) FILTER (lcn <> 0) AS mean_0, var_samp(num_mark) FILTER (lcn = 0) AS v1, var_samp(num_mark) FILTER (lcn <> 0) AS v0 FROM s)
SELECT n_1, n_0, round(mean_1, 6) AS mean_1, round(mean_0, 6) AS mean_0, round((mean_1 - mean_0) / sqrt(v1 / n_1 + v0 / n_0), 6) AS t, round(pow(v1 / n_1 + v0 / n_0, 2) / (pow(v1 / n_1, 2) / (n_1 - 1) + pow(v0 / n_0, 2) / (n_0 - 1)), 6) AS df FROM a""",
    "stream_segments": f"SELECT strftime(loaded_at, '%Y-%m') AS month, regexp_replace(trim(chrom, {_BLANK}), '^chr', '', 'i') AS chrom, count(*) AS n_rows, CAST(sum(num_mark) AS BIGINT) AS n_marks FROM cncf GROUP BY ALL",
}
