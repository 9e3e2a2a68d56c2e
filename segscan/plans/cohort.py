"""Queries of the copy-number and cohort operators and the SQL that must agree with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segscan.functions.text import bare_chrom, sample_key
from segscan.operators import cohort, segments
from segscan.operators.changepoints import probe_segments
from segscan.operators.joins import lookup
from segscan.operators.packed import unpack
from segscan.plans.preparation import ORACLE as _PREPARATION
from segscan.sources.tables import table


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return segments.clean_segments(table(spark, d, "cncf"))


def seg_clean(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d).select("facets_id", "chrom", "loc_start", "loc_end", "tcn", "lcn", segments.chrom_order(F.col("chrom")).alias("chrom_order"))


def seg_features(spark: SparkSession, d: str) -> DataFrame:
    names = ("n_segments", "n_changes", "n_states", "n_allelic_changes", "loh_het_interleave", "chain_cn_amplitude", "chain_k2", "chain_k3")
    return segments.segment_features(_segments(spark, d)).select("facets_id", "chrom", *names, *[F.round(c, 6).alias(c) for c in ("frac_loh", "oscillation_excess", "chrom_span_mb")])


def merge_screen(spark: SparkSession, d: str) -> DataFrame:
    return segments.merge_screen(_segments(spark, d))


def merge_screen_calls(spark: SparkSession, d: str) -> DataFrame:
    return merge_screen(spark, d).filter("n_oscil >= 3 AND n_seg >= 5").groupBy("chrom").agg(F.count("*").alias("relaxed"), F.count_if(F.col("n_oscil") >= 7).alias("strict"))


def tcn_from_ratio(spark: SparkSession, d: str) -> DataFrame:
    latest = table(spark, d, "manifest").withColumn("key", sample_key("sample_id")).filter("key IS NOT NULL").groupBy("key").agg(F.max_by(F.struct("purity", "ploidy"), F.struct("loaded_at", "row_id")).alias("m"))
    rows = table(spark, d, "cncf").select("row_id", sample_key("sample_id").alias("key"), segments.number("cnlr_median").alias("cnlr"))
    return lookup(rows, latest, ["key"], F.col("row_id")).select("row_id", F.round(segments.tcn_estimate(F.col("cnlr"), F.col("m.purity"), F.col("m.ploidy")), 6).alias("tcn_estimate"))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return unpack(table(spark, d, "ctx_details").select("facets_id", "chr_ctx").filter("facets_id IS NOT NULL"), "chr_ctx", "chrom", "pos").select("facets_id", bare_chrom("chrom").alias("chrom"), F.lit(True).alias("truth")).distinct()


def screen_against_labels(spark: SparkSession, d: str) -> DataFrame:
    """Calls of the merge screen against the chromosomes listed in chr_ctx, as counts of both kinds of agreement and error.

    Counts the screened chromosomes only, those with five segments or more; ``screen_against_all_labels`` counts every one.
    """
    joined = merge_screen(spark, d).join(_labels(spark, d), ["facets_id", "chrom"], "left")
    return cohort.confusion(joined, (F.col("n_oscil") >= 3) & (F.col("n_seg") >= 5), F.col("truth"))


def screen_against_all_labels(spark: SparkSession, d: str) -> DataFrame:
    """Like ``screen_against_labels`` over every chromosome that has segments or a label; one that was not screened is not called."""
    on = ["facets_id", "chrom"]
    joined = _segments(spark, d).select(*on).distinct().join(_labels(spark, d), on, "full").join(merge_screen(spark, d), on, "left")
    return cohort.confusion(joined, (F.col("n_oscil") >= 3) & (F.col("n_seg") >= 5), F.col("truth"))


def within_sample_contrast(spark: SparkSession, d: str) -> DataFrame:
    counts = _segments(spark, d).groupBy("facets_id", "chrom").agg(F.count("*").cast("double").alias("n"), F.sum(F.col("num_mark").cast("double")).alias("marks"))
    return segments.within_sample(counts, "facets_id", ["n", "marks"]).select("facets_id", "chrom", F.round("n_ratio", 6).alias("n_ratio"), "n_rank", F.round("marks_ratio", 6).alias("marks_ratio"), "marks_rank")


def survival_curves(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.floor(F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")) / 30).alias("time"), (F.col("o_orderstatus") == "F").alias("event"), F.col("o_orderpriority").alias("grp"))
    return cohort.kaplan_meier(rows, "time", "event", "grp").withColumn("survival", F.round("survival", 8))


def ratio_sweep(spark: SparkSession, d: str) -> DataFrame:
    return cohort.sweep(_segments(spark, d).select("num_mark", "lcn"), "num_mark", F.col("lcn") == 0)


def event_changepoints(spark: SparkSession, d: str) -> DataFrame:
    probes = table(spark, d, "events").select("user_id", F.pmod("event_id", F.lit(4)).alias("chrom"), "event_id", "value")
    return probe_segments(probes, ["user_id", "chrom"], "event_id", "value").select("user_id", "chrom", "seg", "n_probes", "first", "last", "level")


QUERIES = {q.__name__: q for q in (seg_clean, seg_features, merge_screen, merge_screen_calls, tcn_from_ratio, screen_against_labels, screen_against_all_labels, within_sample_contrast, survival_curves, ratio_sweep, event_changepoints)}

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"
_CLEAN = f"""
n0 AS (SELECT facets_id, regexp_replace(trim(chrom, {_BLANK}), '^chr', '', 'i') AS chrom, loc_start, loc_end, num_mark, CASE WHEN NOT isnan(tcn) THEN tcn END AS tcn, CASE WHEN NOT isnan(lcn) THEN lcn END AS lcn, loaded_at, row_id FROM cncf WHERE facets_id IS NOT NULL AND chrom IS NOT NULL AND loc_start IS NOT NULL),
s AS (SELECT * FROM n0 QUALIFY row_number() OVER (PARTITION BY facets_id, chrom, loc_start ORDER BY loaded_at NULLS FIRST, row_id) = 1)"""
_SCREEN = f"""{_CLEAN},
a AS (SELECT *, CASE WHEN tcn = lag(tcn) OVER w AND lcn = lag(lcn) OVER w THEN 0 ELSE 1 END AS new FROM (SELECT * FROM s QUALIFY count(*) OVER (PARTITION BY facets_id, chrom) >= 5) WINDOW w AS (PARTITION BY facets_id, chrom ORDER BY loc_start, loc_end)),
b AS (SELECT *, sum(new) OVER (PARTITION BY facets_id, chrom ORDER BY loc_start, loc_end) AS run FROM a),
m AS (SELECT facets_id, chrom, run, min(tcn) AS tcn, min(loc_start) AS loc_start, arg_max(loc_end, loc_start) AS loc_end FROM b GROUP BY ALL),
c AS (SELECT facets_id, chrom, min(tcn) AS basecn FROM (SELECT facets_id, chrom, tcn FROM m WHERE tcn IS NOT NULL GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL),
e AS (SELECT m.*, basecn, coalesce(tcn <= basecn, false) AS is_base, tcn IS NULL OR basecn IS NULL AS is_open FROM m LEFT JOIN c USING (facets_id, chrom)),
f AS (SELECT *, is_base AND NOT lag(is_base) OVER (PARTITION BY facets_id, chrom ORDER BY run) AS back FROM e),
g AS (SELECT facets_id, chrom, count(*) AS n_seg, count(DISTINCT tcn) + max(CASE WHEN tcn IS NULL THEN 1 ELSE 0 END) AS n_tcn_state, min(basecn) AS b, 1 + count(*) FILTER (back) AS o, count(*) FILTER (is_base OR is_open) AS nb, CASE WHEN NOT bool_or(is_open) THEN sum(loc_end - loc_start) FILTER (is_base) END AS lb, sum(loc_end - loc_start) AS lt FROM f GROUP BY ALL),
screen AS (SELECT facets_id, chrom, n_seg, n_tcn_state, CASE WHEN n_seg >= 3 THEN b END AS basecn, CASE WHEN n_seg >= 3 THEN o END AS n_oscil, CASE WHEN n_seg >= 3 THEN nb END AS n_seg_basecn, CASE WHEN n_seg >= 3 THEN lb END AS length_seg_basecn, CASE WHEN n_seg >= 3 THEN lt END AS length_seg_total FROM g)"""
_CHAIN = """(SELECT facets_id, chrom, max(w) AS chain_k{k} FROM (SELECT x.facets_id, x.chrom, x.j AS lo, y.j AS hi, y.j - x.j + 1 AS w FROM col x JOIN col y ON x.facets_id = y.facets_id AND x.chrom = y.chrom AND y.j >= x.j JOIN col z ON z.facets_id = x.facets_id AND z.chrom = x.chrom AND z.j BETWEEN x.j AND y.j GROUP BY ALL HAVING count(DISTINCT z.v) <= {k}) GROUP BY ALL)"""

ORACLE = {
    "seg_clean": f"WITH {_CLEAN} SELECT facets_id, chrom, loc_start, loc_end, tcn, lcn, CASE upper(chrom) WHEN 'X' THEN 23 WHEN 'Y' THEN 24 WHEN 'M' THEN 25 WHEN 'MT' THEN 25 ELSE coalesce(TRY_CAST(chrom AS INTEGER), 99) END AS chrom_order FROM s",
    "seg_features": f"""WITH {_CLEAN},
i AS (SELECT *, row_number() OVER (PARTITION BY facets_id, chrom ORDER BY loc_start, loc_end) AS i FROM s),
t AS (SELECT *, CASE WHEN tcn IS NOT NULL AND lcn IS NOT NULL THEN concat(tcn, '|', lcn) ELSE concat('row', i) END AS token, coalesce(lcn = 0, false) AS loh FROM i),
l AS (SELECT *, lag(token) OVER w AS pt, lag(lcn) OVER w AS pl, lag(loh) OVER w AS ph FROM t WINDOW w AS (PARTITION BY facets_id, chrom ORDER BY i)),
f AS (SELECT facets_id, chrom, count(*) AS n_segments, count(*) FILTER (i > 1 AND pt <> token) AS n_changes, count(DISTINCT token) FILTER (tcn IS NOT NULL OR lcn IS NOT NULL) AS n_states, count(*) FILTER (i > 1 AND NOT coalesce(pl = lcn, false)) AS n_allelic_changes, count(*) FILTER (i > 1 AND ph <> loh) AS loh_het_interleave,
      CAST(coalesce(max(round_even(tcn, 0)) - min(round_even(tcn, 0)), 0) AS INTEGER) AS chain_cn_amplitude, round(avg(CASE WHEN loh THEN 1.0 ELSE 0.0 END), 6) AS frac_loh, round((max(loc_end) - min(loc_start)) / 1e6, 6) AS chrom_span_mb FROM l GROUP BY ALL),
v AS (SELECT facets_id, chrom, i, round_even(tcn, 0) AS v FROM i WHERE tcn IS NOT NULL),
col AS (SELECT facets_id, chrom, v, row_number() OVER (PARTITION BY facets_id, chrom ORDER BY i) AS j FROM (SELECT * FROM v QUALIFY v IS DISTINCT FROM lag(v) OVER (PARTITION BY facets_id, chrom ORDER BY i)))
SELECT f.*, coalesce(chain_k2, 0) AS chain_k2, coalesce(chain_k3, 0) AS chain_k3, round(CASE WHEN n_changes > 0 THEN (n_changes - greatest(n_states - 1, 0)) / n_changes ELSE 0 END, 6) AS oscillation_excess
FROM f LEFT JOIN {_CHAIN.format(k=2)} USING (facets_id, chrom) LEFT JOIN {_CHAIN.format(k=3)} USING (facets_id, chrom)""",
    "merge_screen": f"WITH {_SCREEN} SELECT * FROM screen",
    "merge_screen_calls": f"WITH {_SCREEN} SELECT chrom, count(*) AS relaxed, count(*) FILTER (n_oscil >= 7) AS strict FROM screen WHERE n_oscil >= 3 AND n_seg >= 5 GROUP BY ALL",
    "tcn_from_ratio": f"""WITH m AS (SELECT upper(trim(sample_id, {_BLANK})) AS k, purity, ploidy FROM manifest WHERE upper(trim(sample_id, {_BLANK})) NOT IN ('', 'NA') QUALIFY row_number() OVER (PARTITION BY upper(trim(sample_id, {_BLANK})) ORDER BY loaded_at DESC, row_id DESC) = 1)
SELECT row_id, round(CASE WHEN purity > 0 THEN ((purity * ploidy + (1 - purity) * 2) * pow(2.0, CASE WHEN NOT isnan(cnlr_median) THEN cnlr_median END) - (1 - purity) * 2) / purity END, 6) AS tcn_estimate FROM cncf LEFT JOIN m ON m.k = upper(trim(sample_id, {_BLANK}))""",
    "screen_against_labels": f"""WITH {_SCREEN}, p1 AS ({_PREPARATION["p1_found"]}), truth AS (SELECT DISTINCT c.facets_id, p.chrom_value AS chrom, true AS t FROM p1 p JOIN ctx_details c ON p.row_id = c.row_id WHERE p.src_table = 'ctx_details' AND c.facets_id IS NOT NULL),
j AS (SELECT coalesce(n_oscil >= 3 AND n_seg >= 5, false) AS c, coalesce(t, false) AS t FROM screen LEFT JOIN truth USING (facets_id, chrom))
SELECT count(*) FILTER (c AND t) AS tp, count(*) FILTER (c AND NOT t) AS fp, count(*) FILTER (NOT c AND t) AS fn, count(*) FILTER (NOT c AND NOT t) AS tn FROM j""",
    "screen_against_all_labels": f"""WITH {_SCREEN}, p1 AS ({_PREPARATION["p1_found"]}), truth AS (SELECT DISTINCT c.facets_id, p.chrom_value AS chrom, true AS t FROM p1 p JOIN ctx_details c ON p.row_id = c.row_id WHERE p.src_table = 'ctx_details' AND c.facets_id IS NOT NULL),
every AS (SELECT DISTINCT facets_id, chrom FROM s),
j AS (SELECT coalesce(n_oscil >= 3 AND n_seg >= 5, false) AS c, coalesce(t, false) AS t FROM every FULL JOIN truth USING (facets_id, chrom) LEFT JOIN screen USING (facets_id, chrom))
SELECT count(*) FILTER (c AND t) AS tp, count(*) FILTER (c AND NOT t) AS fp, count(*) FILTER (NOT c AND t) AS fn, count(*) FILTER (NOT c AND NOT t) AS tn FROM j""",
    "within_sample_contrast": f"""WITH {_CLEAN}, c AS (SELECT facets_id, chrom, CAST(count(*) AS DOUBLE) AS n, sum(CAST(num_mark AS DOUBLE)) AS marks FROM s GROUP BY ALL)
SELECT facets_id, chrom, round(n / nullif(median(n) OVER g, 0), 6) AS n_ratio, rank() OVER (PARTITION BY facets_id ORDER BY n DESC) AS n_rank, round(marks / nullif(median(marks) OVER g, 0), 6) AS marks_ratio,
       CASE WHEN marks IS NOT NULL THEN rank() OVER (PARTITION BY facets_id ORDER BY marks DESC NULLS LAST) END AS marks_rank FROM c WINDOW g AS (PARTITION BY facets_id)""",
    "survival_curves": """WITH r AS (SELECT o_orderpriority AS "group", CAST(floor(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) / 30) AS BIGINT) AS time, o_orderstatus = 'F' AS ev FROM orders),
p AS (SELECT "group", time, count(*) FILTER (ev) AS n_event, count(*) AS n FROM r WHERE time IS NOT NULL AND ev IS NOT NULL GROUP BY ALL),
q AS (SELECT *, CAST(sum(n) OVER (PARTITION BY "group" ORDER BY time DESC) AS BIGINT) AS n_risk FROM p)
SELECT "group", time, n_risk, n_event, n - n_event AS n_censored, round(product(1 - n_event / n_risk) OVER (PARTITION BY "group" ORDER BY time), 8) AS survival FROM q""",
    "ratio_sweep": f"""WITH {_CLEAN}, p AS (SELECT num_mark AS threshold, count(*) FILTER (lcn = 0) AS t, count(*) AS n FROM s WHERE num_mark IS NOT NULL GROUP BY ALL)
SELECT threshold, CAST(sum(t) OVER w AS BIGINT) AS tp, CAST(sum(n - t) OVER w AS BIGINT) AS fp FROM p WINDOW w AS (ORDER BY threshold DESC)""",
}
