"""Queries on probe signals and the SQL that must agree with them.

The test data hold no probes. ``events`` is read as one signal per user and quarter of the event numbers, ``lineitem``
as segments per supplier and part number: the projections are in ``PROBES`` and ``SEGMENTS``, for Spark and SQL alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segscan.operators import probes as ops
from segscan.operators.segments import tcn_estimate
from segscan.sources.tables import table

KEY = ["sample_id", "chrom"]
ORDER = ["maploc"]
PENALTIES = [2.0, 3.0, 5.0]


def probes(spark: SparkSession, d: str) -> DataFrame:
    """sample_id, chrom, maploc, cnlr, lorvar, vaf_t, het, purity, ploidy, tcn_estimate."""
    from pyspark.sql import Window

    c = F.round(F.col("value") * 100).cast("long")
    rn = F.row_number().over(Window.partitionBy("user_id", F.pmod("event_id", F.lit(4))).orderBy("event_id"))
    rows = table(spark, d, "events").select(
        F.col("user_id").alias("sample_id"), (F.pmod("event_id", F.lit(4)) + 1).cast("int").alias("chrom"), (F.col("event_id") * 12000).cast("double").alias("maploc"),
        ((F.when(F.floor((rn - 1) / 5) % 2 == 1, 48).otherwise(-16) + F.pmod(c, F.lit(16))) / 64.0).alias("cnlr"), ((1 + F.col("user_id") % 5) / 64.0).alias("lorvar"), (F.pmod(c, F.lit(129)) / 128.0).alias("vaf_t"),
        F.col("event_type").isin("view", "click").alias("het"), (0.25 + (F.col("user_id") % 4) / 8.0).alias("purity"), (2 + (F.col("user_id") % 3) / 2.0).alias("ploidy"),
    )
    return rows.withColumn("tcn_estimate", tcn_estimate(F.col("cnlr"), F.col("purity"), F.col("ploidy")))


def item_segments(spark: SparkSession, d: str) -> DataFrame:
    """sample_id, chrom, loc_start, loc_end, tcn, lcn, cnlr_median."""
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("sample_id"), (F.col("l_partkey") % 23 + 1).cast("int").alias("chrom"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("p")).agg(F.max(F.col("l_quantity").cast("long")).alias("q"))
    start = (F.col("p") * 1000).cast("double")
    return rows.select("sample_id", "chrom", start.alias("loc_start"), (start + 500 + 10 * F.col("q")).alias("loc_end"), (1 + F.col("q") % 5).cast("double").alias("tcn"), F.when(F.col("q") % 11 != 0, F.col("q") % 2).cast("double").alias("lcn"), ((F.col("q") % 9 - 4) / 4.0).alias("cnlr_median"))


def _rounded(df: DataFrame, n: int = 6) -> DataFrame:
    return df.select(*[F.round(c, n).alias(c) if t == "double" and c not in ("maploc", "pen_const") else F.col(c) for c, t in df.dtypes])


def probe_dispersion(spark: SparkSession, d: str) -> DataFrame:
    rows = probes(spark, d)
    return _rounded(ops.dispersion(rows, KEY, ORDER, "tcn_estimate", "dot").join(ops.dispersion(rows, KEY, ORDER, "cnlr", "cnlr"), KEY).drop("cnlr_sd_total", "cnlr_mad_total"), 5)


def probe_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ops.probe_summary(probes(spark, d), KEY))


def probe_states(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ops.rolling_states(probes(spark, d), KEY, ORDER, "tcn_estimate"))


def probe_support(spark: SparkSession, d: str) -> DataFrame:
    """Segments against the probes of their chromosome: segments per probe, spread over noise, levels that the noise leaves apart."""
    per = item_segments(spark, d).groupBy(*KEY).agg(F.count("*").alias("n_segments"), (F.max("cnlr_median") - F.min("cnlr_median")).alias("_spread"), F.collect_set("cnlr_median").alias("_levels"))
    rows = per.join(ops.probe_summary(probes(spark, d), KEY).select(*KEY, "n_probes", "probe_noise"), KEY, "left")
    noise = F.sqrt("probe_noise")
    return _rounded(rows.select(*KEY, "n_segments", F.coalesce("n_probes", F.lit(0)).alias("n_probes"), F.try_divide("n_segments", "n_probes").alias("segments_per_probe"), F.when(noise > 0, F.col("_spread") / noise).alias("cnlr_snr"), ops.resolved_levels(F.col("_levels"), noise).alias("n_resolved_levels")))


def probe_changepoints(spark: SparkSession, d: str) -> DataFrame:
    """Features of changepoints for each of three penalties."""
    return ops.changepoint_features(probes(spark, d), KEY, "maploc", "cnlr", PENALTIES, "lorvar", "purity", "ploidy")


QUERIES = {q.__name__: q for q in (probe_dispersion, probe_summary, probe_states, probe_support, probe_changepoints)}

PROBES = """probes AS (SELECT sample_id, chrom, maploc, ((CASE WHEN ((rn - 1) // 5) % 2 = 1 THEN 48 ELSE -16 END) + ((c % 16) + 16) % 16) / 64.0 AS cnlr, lorvar, (((c % 129) + 129) % 129) / 128.0 AS vaf_t, het, purity, ploidy FROM (
  SELECT user_id AS sample_id, CAST(event_id % 4 + 1 AS INTEGER) AS chrom, CAST(event_id * 12000 AS DOUBLE) AS maploc, CAST(round(value * 100) AS BIGINT) AS c, row_number() OVER (PARTITION BY user_id, event_id % 4 ORDER BY event_id) AS rn, (1 + user_id % 5) / 64.0 AS lorvar,
    event_type IN ('view', 'click') AS het, 0.25 + (user_id % 4) / 8.0 AS purity, 2 + (user_id % 3) / 2.0 AS ploidy FROM events)),
pts AS (SELECT *, ((purity * ploidy + (1 - purity) * 2) * pow(2.0, cnlr) - (1 - purity) * 2) / purity AS tcn_estimate FROM probes)"""
SEGMENTS = """segs AS (SELECT sample_id, chrom, p * 1000.0 AS loc_start, CAST(1 + q % 5 AS DOUBLE) AS tcn, (q % 9 - 4) / 4.0 AS cnlr_median FROM (SELECT l_suppkey AS sample_id, CAST(l_partkey % 23 + 1 AS INTEGER) AS chrom, l_orderkey * 8 + l_linenumber AS p, max(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY ALL))"""


def _dispersion(value: str, prefix: str) -> str:
    return f"""{prefix}1 AS (SELECT sample_id, chrom, {value} AS x, {value} - lag({value}) OVER (PARTITION BY sample_id, chrom ORDER BY maploc) AS dx FROM pts),
{prefix}2 AS (SELECT *, median(x) OVER (PARTITION BY sample_id, chrom) AS mx, median(dx) OVER (PARTITION BY sample_id, chrom) AS md FROM {prefix}1),
{prefix} AS (SELECT sample_id, chrom, CASE WHEN count(*) > 1 THEN stddev_samp(x) END AS sd_total, CASE WHEN count(*) > 1 THEN 1.4826 * median(abs(x - mx)) END AS mad_total, stddev_samp(dx) / sqrt(2) AS sd_within, CASE WHEN count(*) > 1 THEN 1.4826 * median(abs(dx - md)) / sqrt(2) END AS mad_within FROM {prefix}2 GROUP BY ALL)"""


_SUMMARY = "su AS (SELECT sample_id, chrom, count(*) AS n_probes, CAST(count(*) FILTER (het) AS INTEGER) AS n_het_probes, CASE WHEN count(*) FILTER (het) > 1 THEN stddev_pop(abs(vaf_t - 0.5)) FILTER (het) END AS sd, median(lorvar) AS noise FROM pts GROUP BY ALL)"

ORACLE = {
    "probe_dispersion": f"""WITH {PROBES}, {_dispersion("tcn_estimate", "dd")}, {_dispersion("cnlr", "cc")}
SELECT sample_id, chrom, round(dd.sd_total, 5) AS dot_sd_total, round(dd.mad_total, 5) AS dot_mad_total, round(dd.sd_within, 5) AS dot_sd_within, round(dd.mad_within, 5) AS dot_mad_within, round(cc.sd_within, 5) AS cnlr_sd_within, round(cc.mad_within, 5) AS cnlr_mad_within FROM dd JOIN cc USING (sample_id, chrom)""",
    "probe_summary": f"WITH {PROBES}, {_SUMMARY} SELECT sample_id, chrom, n_probes, n_het_probes, round(sd, 6) AS vaf_imbalance_sd, round(noise, 6) AS probe_noise FROM su",
    "probe_states": f"""WITH {PROBES}, r AS (SELECT sample_id, chrom, tcn_estimate AS x, row_number() OVER (PARTITION BY sample_id, chrom ORDER BY maploc) AS i, count(*) OVER (PARTITION BY sample_id, chrom) AS n, median(tcn_estimate) OVER (PARTITION BY sample_id, chrom) AS base FROM pts),
w AS (SELECT *, least(51, greatest(5, CAST(n // 30 AS INTEGER) | 1)) // 2 AS h FROM r),
m AS (SELECT a.sample_id, a.chrom, a.i, any_value(a.x) AS x, any_value(a.n) AS n, any_value(a.base) AS base, CAST(greatest(round_even(median(b.x), 0), 0) AS INTEGER) AS v FROM w a JOIN w b ON (a.sample_id, a.chrom) = (b.sample_id, b.chrom) AND b.i BETWEEN a.i - a.h AND a.i + a.h GROUP BY ALL),
k AS (SELECT *, median(abs(x - base)) OVER (PARTITION BY sample_id, chrom) AS mad, v IS DISTINCT FROM lag(v) OVER (PARTITION BY sample_id, chrom ORDER BY i) AS new FROM m),
col AS (SELECT sample_id, chrom, v, row_number() OVER (PARTITION BY sample_id, chrom ORDER BY i) AS j FROM k WHERE new),
ch AS (SELECT sample_id, chrom, max(w) AS c FROM (SELECT x.sample_id, x.chrom, y.j - x.j + 1 AS w FROM col x JOIN col y ON (x.sample_id, x.chrom) = (y.sample_id, y.chrom) AND y.j >= x.j JOIN col z ON (z.sample_id, z.chrom) = (x.sample_id, x.chrom) AND z.j BETWEEN x.j AND y.j GROUP BY x.sample_id, x.chrom, x.j, y.j HAVING count(DISTINCT z.v) <= 3) GROUP BY ALL),
g AS (SELECT sample_id, chrom, any_value(n) AS n, count(*) FILTER (new) - 1 AS changes, count(DISTINCT v) AS states, avg(CASE WHEN x > base + 4 * greatest(1.4826 * mad, 1e-3) THEN 1.0 ELSE 0.0 END) AS spike FROM k GROUP BY ALL)
SELECT sample_id, chrom, CAST(CASE WHEN n >= 5 THEN c ELSE 0 END AS INTEGER) AS probe_osc_chain, CASE WHEN n >= 5 THEN changes ELSE 0 END AS probe_n_state_changes, CASE WHEN n >= 5 THEN states ELSE 0 END AS probe_reseg_n_states, round(CASE WHEN n >= 5 THEN spike ELSE 0 END, 6) AS probe_amp_spike_frac FROM g JOIN ch USING (sample_id, chrom)""",
    "probe_support": f"""WITH {PROBES}, {SEGMENTS}, {_SUMMARY}, per AS (SELECT sample_id, chrom, count(*) AS n_segments, max(cnlr_median) - min(cnlr_median) AS spread, list_sort(list(DISTINCT cnlr_median)) AS levels FROM segs GROUP BY ALL),
j AS (SELECT per.*, n_probes, sqrt(noise) AS noise FROM per LEFT JOIN su USING (sample_id, chrom))
SELECT sample_id, chrom, n_segments, coalesce(n_probes, 0) AS n_probes, round(n_segments / n_probes, 6) AS segments_per_probe, round(spread / noise, 6) AS cnlr_snr,
  CASE WHEN noise > 0 THEN CAST(list_reduce(list_transform(levels, lambda x: {{'l': CAST(x AS DOUBLE), 'n': 1}}), lambda a, b: CASE WHEN b.l - a.l > 2 * noise THEN {{'l': b.l, 'n': a.n + 1}} ELSE a END).n AS INTEGER) END AS n_resolved_levels FROM j""",
}
