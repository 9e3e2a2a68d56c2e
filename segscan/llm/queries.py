"""Queries of the operators for training data (p5 to p8) and the SQL that must agree with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segscan.functions.text import bare_chrom
from segscan.llm.containers import CAPACITY, fill_containers
from segscan.llm.leaks import find_leaks
from segscan.llm.levels import reading_level
from segscan.llm.runs import collapse_runs
from segscan.sources.tables import table

#: Squared copies that a boundary costs: below 1/4 only equal whole copies join, see ``collapse_runs``.
SAME_COPIES = 0.2
#: Near-identical: runs may waver by about one copy.
NEAR_COPIES = 1.5


def _runs(spark: SparkSession, d: str, penalty: float) -> DataFrame:
    events = table(spark, d, "cncf").select("facets_id", bare_chrom("chrom").alias("chrom"), "loc_start", "loc_end", F.round("tcn").alias("tcn"), F.round("lcn").alias("lcn"), "loaded_at", "row_id")
    return collapse_runs(events, ["facets_id", "chrom"], "loc_start", "loc_end", ["tcn", "lcn"], penalty, ["loaded_at", "row_id"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d, SAME_COPIES).filter("n_events >= 2 AND NOT missing").select("facets_id", "chrom", F.col("run_start").cast("long"), F.col("run_end").cast("long"))


def p5_runs(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d, SAME_COPIES).select("facets_id", "chrom", F.col("run_start").cast("long"), F.col("run_end").cast("long"), "n_events", F.col("duration").cast("long"), F.round("mean_tcn").cast("int").alias("tcn"), F.round("mean_lcn").cast("int").alias("lcn"))


def p5_near_runs(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d, NEAR_COPIES)


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return fill_containers(table(spark, d, "documents"))


def p6_kept(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the containers, in one row: documents in them, containers above the capacity, texts split that fit, texts whose pieces are not one of each."""
    filled = p6_containers(spark, d)
    docs = filled.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens"), F.count_distinct("piece").alias("pieces"), F.max("piece").alias("last"))
    over = filled.groupBy("container_id").agg(F.sum("n_tokens").alias("tokens")).agg(F.count_if(F.col("tokens") > CAPACITY).alias("n_over"))
    return docs.agg(F.count("*").alias("n_docs"), F.count_if((F.col("n") > 1) & (F.col("tokens") <= CAPACITY)).alias("n_split"), F.count_if((F.col("n") != F.col("pieces")) | (F.col("last") + 1 != F.col("n"))).alias("n_torn")).crossJoin(over)  # one row each


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).filter("is_leak").select("doc_id", "item_id")


def p7_moved(spark: SparkSession, d: str) -> DataFrame:
    """Passages whose parts stand in a text in another order, so that they are no leak: the share of the passage under tiles."""
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).filter("NOT is_leak").select("doc_id", "item_id", "tile_share")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_levels(spark, d).filter("level >= 4").select("doc_id")


def p8_levels(spark: SparkSession, d: str) -> DataFrame:
    return reading_level(table(spark, d, "documents"), table(spark, d, "level_labels"))


QUERIES = {q.__name__: q for q in (p5_found, p5_runs, p5_near_runs, p6_containers, p6_kept, p7_found, p7_moved, p8_found, p8_levels)}

_RUNS = """
WITH n AS (SELECT facets_id, regexp_replace(trim(chrom, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)), '^chr', '', 'i') AS chrom, loc_start, loc_end,
                  round(CASE WHEN NOT isnan(tcn) THEN tcn END) AS t, round(CASE WHEN NOT isnan(lcn) THEN lcn END) AS l, loaded_at, row_id FROM cncf WHERE facets_id IS NOT NULL AND loc_start IS NOT NULL),
u AS (SELECT * FROM n WHERE chrom IS NOT NULL QUALIFY row_number() OVER (PARTITION BY facets_id, chrom, loc_start ORDER BY loaded_at NULLS FIRST, row_id) = 1),
e AS (SELECT *, CASE WHEN t = lag(t) OVER w AND l = lag(l) OVER w THEN 0 ELSE 1 END AS new FROM u WINDOW w AS (PARTITION BY facets_id, chrom ORDER BY loc_start)),
g AS (SELECT *, sum(new) OVER (PARTITION BY facets_id, chrom ORDER BY loc_start) AS run FROM e),
r AS (SELECT facets_id, chrom, CAST(min(loc_start) AS BIGINT) AS run_start, CAST(arg_max(loc_end, loc_start) AS BIGINT) AS run_end, count(*) AS n_events, min(t) AS t, min(l) AS l FROM g GROUP BY facets_id, chrom, run)
"""
ORACLE = {
    "p6_kept": "SELECT count(DISTINCT doc_id) AS n_docs, CAST(0 AS BIGINT) AS n_over, CAST(0 AS BIGINT) AS n_split, CAST(0 AS BIGINT) AS n_torn FROM documents WHERE length(text) > 0",
    "p5_found": _RUNS + "SELECT facets_id, chrom, run_start, run_end FROM r WHERE n_events >= 2",
    "p5_runs": _RUNS + "SELECT facets_id, chrom, run_start, run_end, n_events, run_end - run_start AS duration, CAST(CASE WHEN l IS NOT NULL THEN t END AS INTEGER) AS tcn, CAST(CASE WHEN t IS NOT NULL THEN l END AS INTEGER) AS lcn FROM r",
}
