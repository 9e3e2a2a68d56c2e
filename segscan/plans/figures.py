"""Queries for cohort tables and plots, and for text tables, with the SQL that must agree with them.

Alterations are read off ``lineitem`` (patient: supplier, gene: part number by nine, alteration: both flags), courses of
patients off ``orders``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segscan.functions.text import bare_chrom, path_key
from segscan.operators import cohort, segments, tables, tracks
from segscan.operators.packed import unpack
from segscan.plans.cohort import _BLANK, _CLEAN
from segscan.plans.nomination import _TIMES, _segments, _times
from segscan.plans.preparation import ORACLE as _PREPARATION
from segscan.sources.delimited import preferred_files as _preferred
from segscan.sources.delimited import read_delimited, sibling, write_delimited
from segscan.sources.tables import shared_folder, table

GENES = [f"G{i}" for i in range(9)]


def _altered(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("patient"), F.concat(F.lit("G"), F.col("l_partkey") % 9).alias("gene"), F.concat("l_returnflag", "l_linestatus").alias("alteration"), "l_quantity")


def _wide(spark: SparkSession, d: str) -> DataFrame:
    return _altered(spark, d).groupBy("patient").pivot("gene", GENES).agg(F.array_join(F.array_sort(F.collect_set("alteration")), ";"))


def alteration_rows(spark: SparkSession, d: str) -> DataFrame:
    return tables.alterations_long(_wide(spark, d), "patient", GENES)


def alteration_fractions(spark: SparkSession, d: str) -> DataFrame:
    rows = alteration_rows(spark, d)
    return rows.groupBy("gene", "alteration").agg(F.count("*").alias("n")).crossJoin(F.broadcast(_altered(spark, d).agg(F.count_distinct("patient").alias("_all")))).select("gene", "alteration", F.round(F.col("n") / F.col("_all"), 6).alias("fraction"))  # one row


def alteration_table(spark: SparkSession, d: str) -> DataFrame:
    return tables.contingency(_altered(spark, d), "gene", "alteration")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    odd = F.sum(F.when(F.col("alteration") == "AF", F.col("l_quantity")).cast("long")) % 2 == 1
    return tables.pair_counts(_altered(spark, d).groupBy("patient").pivot("gene", GENES).agg(odd), GENES)


def gene_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).withColumn("odds_ratio", F.round("odds_ratio", 6))


def gene_pair_tests(spark: SparkSession, d: str) -> DataFrame:
    return tables.pair_tests(_pairs(spark, d))


def box_stats(spark: SparkSession, d: str) -> DataFrame:
    return tables.box_stats(table(spark, d, "events"), "event_type", "value")


def pairwise_log_rank(spark: SparkSession, d: str) -> DataFrame:
    out = cohort.pairwise_log_rank(_times(spark, d), "time", "event", "grp")
    return out.select("group_1", "group_2", "n_1", "observed_1", F.round("expected_1", 5).alias("expected_1"), F.round("chi2", 5).alias("chi2"))


def adjusted_p(spark: SparkSession, d: str) -> DataFrame:
    """Segment run lengths as if they were p values (the test data hold none): each adjusted for the number of all."""
    p = F.round(1 / (1 + F.col("num_mark") + F.col("row_id") % 1000), 9)
    return cohort.step_up(table(spark, d, "cncf").filter("num_mark IS NOT NULL").select("row_id", p.alias("p")), "p").withColumn("q", F.round("q", 8))


def stage_bubbles(spark: SparkSession, d: str) -> DataFrame:
    return tables.contingency(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority").withColumn("size", F.round(F.sqrt("n") / 7, 6))


def patient_courses(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of each patient in months from the first order: one per order, and one of the whole course with its state."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("begin"), F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 90).cast("int")).alias("end"), "o_orderstatus")
    first = orders.groupBy("o_custkey").agg(F.min("begin").alias("first"), F.max("end").alias("last"), F.bool_or(F.col("o_orderstatus") == "F").alias("event"), F.count_if(F.col("o_orderstatus") == "O").alias("n_open"))
    state = F.when(F.col("event") & (F.col("n_open") == 0), "ended").when(F.col("event"), "ended, some open").when(F.col("n_open") > 0, "open").otherwise("other")
    whole = first.select("o_custkey", F.lit(None).cast("long").alias("o_orderkey"), state.alias("kind"), F.lit(0.0).alias("from_month"), F.round(tables.months(F.col("first"), F.col("last")), 6).alias("to_month"))
    each = orders.join(first.select("o_custkey", "first"), "o_custkey").select("o_custkey", F.col("o_orderkey").cast("long").alias("o_orderkey"), F.lit("treatment").alias("kind"), F.round(tables.months(F.col("first"), F.col("begin")), 6).alias("from_month"), F.round(tables.months(F.col("first"), F.col("end")), 6).alias("to_month"))
    return whole.unionByName(each)


def loh_appended(spark: SparkSession, d: str) -> DataFrame:
    """The listed chromosomes of each patient, with LOH appended where the patient's first segment has lost the minor copy."""
    patient = lambda c: F.substring_index(F.upper(F.trim(c)), "-", 2)
    wide = table(spark, d, "manifest").filter("sample_id IS NOT NULL").groupBy(patient("sample_id").alias("patient")).agg(F.min("chr_ctx").alias("listed"))
    cncf = table(spark, d, "cncf").filter("sample_id IS NOT NULL").select("row_id", "sample_id", segments.number("lcn").alias("lcn"))
    return tables.append_first(wide, cncf, "patient", "listed", patient("sample_id"), "row_id", F.col("lcn") == 0, "LOH")


def genome_track(spark: SparkSession, d: str) -> DataFrame:
    rows = _segments(spark, d)
    return tracks.track(rows, tracks.offsets(rows)).select("facets_id", "label", "x_start", "x_end", "tcn_shown", "lcn_shown")


def listed_areas(spark: SparkSession, d: str) -> DataFrame:
    lists = {c: unpack(table(spark, d, "ctx_details").select("study_id", c), c, "chrom", "pos") for c in ("chr_ctx", "amp_ctx")}
    return tracks.areas(lists["chr_ctx"], lists["amp_ctx"], tracks.offsets(_segments(spark, d)), "study_id")


def segment_arms(spark: SparkSession, d: str) -> DataFrame:
    """Segments of each arm, and their lost minor copies."""
    centro = table(spark, d, "centromeres").select(bare_chrom("chr").alias("chrom"), "centro_start", "centro_end")
    rows = tracks.arms(_segments(spark, d).withColumn("chrom", F.when(F.col("chrom") == "23", "X").otherwise(F.col("chrom"))), centro)
    return rows.groupBy("facets_id", "chrom", "arm").agg(F.count("*").alias("n_segments"), F.count_if(F.col("lcn") == 0).alias("n_loh"))


def text_table(spark: SparkSession, d: str) -> DataFrame:
    """manifest written as tab-separated text and read again."""
    folder = shared_folder(spark, "text")
    columns = ["row_id", "sample_id", "facets_cncf_path", "purity", "ploidy"]
    write_delimited(table(spark, d, "manifest").select(*reversed(columns)), folder)
    return read_delimited(spark, folder, "row_id long, sample_id string, facets_cncf_path string, purity double, ploidy double", ("sample_id", "facets_cncf_path"))


def preferred_files(spark: SparkSession, d: str) -> DataFrame:
    """One segment file per patient, the last by name, and the probe file beside it."""
    key = F.substring_index(F.element_at(F.split(path_key("file_path"), "/"), -2), "-", 2)
    out = _preferred(table(spark, d, "facets_files").withColumn("file_path", path_key("file_path")), "file_path", key, prefer="PX5")
    return out.withColumn("probes", sibling(F.col("path"), ".cncf.txt", ".Rdata"))


QUERIES = {q.__name__: q for q in (alteration_rows, alteration_fractions, alteration_table, gene_pairs, gene_pair_tests, box_stats, pairwise_log_rank, adjusted_p, stage_bubbles, patient_courses, loh_appended, genome_track, listed_areas, segment_arms, text_table, preferred_files)}

_ALTERED = "al AS (SELECT l_suppkey AS patient, 'G' || CAST(l_partkey % 9 AS VARCHAR) AS gene, l_returnflag || l_linestatus AS alteration, l_quantity FROM lineitem)"
_PLACES = f"""{_CLEAN}, len AS (SELECT CASE chrom WHEN '23' THEN 'X' WHEN '24' THEN 'Y' ELSE chrom END AS label, max(loc_end) AS length FROM s WHERE loc_end IS NOT NULL GROUP BY ALL),
places AS (SELECT label, length, coalesce(sum(length) OVER (ORDER BY CASE upper(label) WHEN 'X' THEN 23 WHEN 'Y' THEN 24 WHEN 'M' THEN 25 WHEN 'MT' THEN 25 ELSE coalesce(TRY_CAST(label AS INTEGER), 99) END, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset" FROM len)"""
_LABEL = "CASE {0} WHEN '23' THEN 'X' WHEN '24' THEN 'Y' ELSE {0} END"

ORACLE = {
    "alteration_rows": f"WITH {_ALTERED} SELECT DISTINCT patient, gene, alteration FROM al",
    "alteration_fractions": f"WITH {_ALTERED} SELECT gene, alteration, round(count(DISTINCT patient) / (SELECT count(DISTINCT patient) FROM al), 6) AS fraction FROM al GROUP BY ALL",
    "alteration_table": f"WITH {_ALTERED} SELECT g.gene, a.alteration, count(al.patient) AS n FROM (SELECT DISTINCT gene FROM al) g CROSS JOIN (SELECT DISTINCT alteration FROM al) a LEFT JOIN al ON al.gene = g.gene AND al.alteration = a.alteration GROUP BY ALL",
    "gene_pairs": f"""WITH {_ALTERED}, f AS (SELECT p.patient, g.gene, coalesce(CAST(sum(l_quantity) FILTER (alteration = 'AF') AS BIGINT) % 2 = 1, false) AS x FROM (SELECT DISTINCT patient FROM al) p CROSS JOIN (SELECT DISTINCT gene FROM al) g LEFT JOIN al ON al.patient = p.patient AND al.gene = g.gene GROUP BY ALL),
c AS (SELECT a.gene AS g1, b.gene AS g2, count(*) FILTER (a.x AND b.x) AS n11, count(*) FILTER (a.x AND NOT b.x) AS n10, count(*) FILTER (NOT a.x AND b.x) AS n01, count(*) FILTER (NOT a.x AND NOT b.x) AS n00 FROM f a JOIN f b USING (patient) GROUP BY ALL)
SELECT *, round(n11 * n00 / nullif(n10 * n01, 0), 6) AS odds_ratio FROM c""",
    "box_stats": """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL AND NOT isnan(value)),
p AS (SELECT *, floor((n + 3) / 2) / 2 AS q FROM r),
h AS (SELECT event_type, any_value(n) AS n, (max(value) FILTER (i = floor(q)) + max(value) FILTER (i = ceil(q))) / 2 AS hinge_low, (max(value) FILTER (i = floor((n + 1) / 2)) + max(value) FILTER (i = ceil((n + 1) / 2))) / 2 AS median, (max(value) FILTER (i = floor(n + 1 - q)) + max(value) FILTER (i = ceil(n + 1 - q))) / 2 AS hinge_high FROM p GROUP BY ALL)
SELECT event_type AS "group", any_value(h.n) AS n, min(value) AS low, any_value(hinge_low) AS hinge_low, any_value(median) AS median, any_value(hinge_high) AS hinge_high, max(value) AS high FROM h JOIN r USING (event_type) WHERE value BETWEEN hinge_low - 1.5 * (hinge_high - hinge_low) AND hinge_high + 1.5 * (hinge_high - hinge_low) GROUP BY event_type""",
    "pairwise_log_rank": f"""WITH {_TIMES}, q AS (SELECT "group" AS g, time, ev FROM r WHERE time IS NOT NULL AND ev IS NOT NULL), pr AS (SELECT a.g AS g1, b.g AS g2 FROM (SELECT DISTINCT g FROM q) a JOIN (SELECT DISTINCT g FROM q) b ON a.g < b.g),
k AS (SELECT g1, g2, t.time, count(*) FILTER (q.time >= t.time) AS n, count(*) FILTER (q.time >= t.time AND q.g = g1) AS n1, count(*) FILTER (q.time = t.time AND q.ev) AS d, count(*) FILTER (q.time = t.time AND q.ev AND q.g = g1) AS d1 FROM pr JOIN q ON q.g IN (g1, g2) CROSS JOIN (SELECT DISTINCT time FROM q WHERE ev) t GROUP BY ALL),
x AS (SELECT g1, g2, sum(d1) AS o, sum(CASE WHEN n > 0 THEN d * n1 / n ELSE 0 END) AS e, sum(CASE WHEN n > 1 THEN d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1) ELSE 0 END) AS v FROM k GROUP BY ALL)
SELECT g1 AS group_1, g2 AS group_2, (SELECT count(*) FROM q WHERE g = g1) AS n_1, CAST(o AS BIGINT) AS observed_1, round(e, 5) AS expected_1, round(CASE WHEN v > 1e-9 THEN pow(o - e, 2) / v END, 5) AS chi2 FROM x""",
    "adjusted_p": """WITH a AS (SELECT row_id, round(1 / (1 + num_mark + row_id % 1000), 9) AS p FROM cncf WHERE num_mark IS NOT NULL),
b AS (SELECT row_id, p, p * count(*) OVER () / (rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1) AS x FROM a)
SELECT row_id, p, round(least(1.0, min(x) OVER (ORDER BY p DESC)), 8) AS q FROM b""",
    "stage_bubbles": "SELECT s.o_orderstatus, p.o_orderpriority, count(o.o_orderkey) AS n, round(sqrt(count(o.o_orderkey)) / 7, 6) AS size FROM (SELECT DISTINCT o_orderstatus FROM orders) s CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders) p LEFT JOIN orders o ON o.o_orderstatus = s.o_orderstatus AND o.o_orderpriority = p.o_orderpriority GROUP BY ALL",
    "patient_courses": """WITH o AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS b, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INTEGER) AS e, o_orderstatus FROM orders),
f AS (SELECT o_custkey, min(b) AS f, max(e) AS l, bool_or(o_orderstatus = 'F') AS ev, count(*) FILTER (o_orderstatus = 'O') AS op FROM o GROUP BY ALL)
SELECT o_custkey, CAST(NULL AS BIGINT) AS o_orderkey, CASE WHEN ev AND op = 0 THEN 'ended' WHEN ev THEN 'ended, some open' WHEN op > 0 THEN 'open' ELSE 'other' END AS kind, CAST(0 AS DOUBLE) AS from_month, round((l - f) * 12.0::DOUBLE / 365, 6) AS to_month FROM f
UNION ALL SELECT o.o_custkey, o_orderkey, 'treatment', round((b - f) * 12.0::DOUBLE / 365, 6), round((e - f) * 12.0::DOUBLE / 365, 6) FROM o JOIN f ON f.o_custkey = o.o_custkey""",
    "loh_appended": """WITH w AS (SELECT array_to_string(string_split(upper(trim(sample_id)), '-')[1:2], '-') AS patient, min(chr_ctx) AS listed FROM manifest WHERE sample_id IS NOT NULL GROUP BY ALL),
c AS (SELECT array_to_string(string_split(upper(trim(sample_id)), '-')[1:2], '-') AS patient, arg_min(coalesce(lcn = 0, false), row_id) AS loh FROM cncf WHERE sample_id IS NOT NULL GROUP BY ALL)
SELECT w.patient, CASE WHEN loh THEN CASE WHEN coalesce(listed, '') = '' THEN 'LOH' ELSE listed || ';LOH' END ELSE listed END AS listed FROM w LEFT JOIN c ON c.patient = w.patient""",
    "genome_track": f"""WITH {_PLACES} SELECT facets_id, label, loc_start + "offset" AS x_start, loc_end + "offset" AS x_end, CASE WHEN tcn IS NOT NULL THEN least(tcn, 11) END AS tcn_shown, coalesce(lcn, 1) AS lcn_shown FROM s JOIN places ON label = {_LABEL.format("chrom")}""",
    "listed_areas": f"""WITH {_PLACES}, p1 AS ({_PREPARATION["p1_found"]}), p2 AS ({_PREPARATION["p1_found"].replace("row_id, chr_ctx FROM manifest", "row_id, NULL::VARCHAR AS chr_ctx FROM manifest").replace("row_id, chr_ctx FROM ctx_details", "row_id, amp_ctx FROM ctx_details")}),
l AS (SELECT DISTINCT study_id, {_LABEL.format("chrom_value")} AS label FROM p1 JOIN ctx_details USING (row_id) WHERE src_table = 'ctx_details'), a AS (SELECT DISTINCT study_id, {_LABEL.format("chrom_value")} AS label FROM p2 JOIN ctx_details USING (row_id) WHERE src_table = 'ctx_details')
SELECT l.study_id, l.label, CASE WHEN a.label IS NOT NULL THEN 'listed and amplified' ELSE 'listed' END AS kind, "offset" AS x_start, "offset" + length AS x_end FROM l JOIN places USING (label) LEFT JOIN a ON a.study_id = l.study_id AND a.label = l.label""",
    "segment_arms": f"""WITH {_CLEAN}, c AS (SELECT regexp_replace(trim(chr, {_BLANK}), '^chr', '', 'i') AS k, centro_start, centro_end FROM centromeres),
x AS (SELECT facets_id, CASE chrom WHEN '23' THEN 'X' ELSE chrom END AS chrom, loc_start, loc_end, lcn FROM s)
SELECT facets_id, chrom, CASE WHEN loc_end <= centro_start THEN 'p' WHEN loc_start >= centro_end THEN 'q' WHEN centro_start IS NOT NULL AND loc_end IS NOT NULL THEN 'centromere' END AS arm, count(*) AS n_segments, count(*) FILTER (lcn = 0) AS n_loh FROM x LEFT JOIN c ON k = chrom GROUP BY ALL""",
    "text_table": "SELECT row_id, nullif(nullif(sample_id, ''), 'NA') AS sample_id, nullif(nullif(facets_cncf_path, ''), 'NA') AS facets_cncf_path, purity, ploidy FROM manifest",
    "preferred_files": f"""WITH f AS (SELECT trim(file_path, {_BLANK}) AS p FROM facets_files), k AS (SELECT array_to_string(string_split(string_split(p, '/')[-2], '-')[1:2], '-') AS key, p FROM f WHERE contains(p, '_hisens') AND p <> '' AND upper(p) <> 'NA'),
b AS (SELECT key, arg_max(p, (contains(p, 'PX5'), p)) AS path FROM k WHERE key IS NOT NULL GROUP BY ALL)
SELECT key, path, CASE WHEN path LIKE '%.cncf.txt' THEN path[:-10] || '.Rdata' END AS probes FROM b""",
}
