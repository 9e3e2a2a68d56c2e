"""Queries of the general data-preparation operators (p1 to p4) and the SQL that must agree with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segscan.functions.text import bare_chrom, path_key, sample_key, strip
from segscan.operators.compaction import assign_groups, compact, read_published
from segscan.operators.packed import unpack
from segscan.operators.references import find_orphans, orphan_report
from segscan.sources.raw_segments import ingest, promote, replay, schema_changes, segments_of, unreadable
from segscan.sources.tables import shared_folder, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    fields = None
    for name in ("manifest", "ctx_details"):
        part = table(spark, d, name).select(F.lit(name).alias("src_table"), "row_id", "chr_ctx")
        fields = part if fields is None else fields.unionByName(part)
    return unpack(fields, "chr_ctx", "chrom_value", "pos").select("src_table", "row_id", "pos", "chrom_value")


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    manifest, files = table(spark, d, "manifest"), table(spark, d, "facets_files")
    refs = None
    for name, col, target, key in (("cncf", "sample_id", "manifest", sample_key), ("ctx_details", "dmp_sample", "manifest", sample_key), ("manifest", "facets_cncf_path", "facets_files", path_key)):
        part = table(spark, d, name).select(F.lit(name).alias("src_table"), "row_id", F.lit(target).alias("target"), key(col).alias("key"), F.col("loaded_at").alias("at"))
        refs = part if refs is None else refs.unionByName(part)
    goals = manifest.select(F.lit("manifest").alias("target"), sample_key("sample_id").alias("key"), F.col("loaded_at").alias("since"), F.col("deleted_at").alias("until")).unionByName(
        files.select(F.lit("facets_files").alias("target"), path_key("file_path").alias("key"), F.col("listed_at").alias("since"), F.col("deleted_at").alias("until"))
    )
    return find_orphans(refs, goals)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("src_table", "row_id")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_orphans(spark, d))


#: Raw bytes per output file: the test tables' tiny files are 2.8 MB at sf0.1, so that they make a dozen files; for real data, 128 MB.
RAW_BYTES = 256 << 10
MEASURES = ("cp_n_changepoints", "cp_osc_chain", "cp_within_dispersion", "cp_osc_confidence", "cp_n_levels", "cp_n_probes")


def _record() -> dict:
    return {"sample_id": F.upper(strip("sample_id")), "chrom": bare_chrom("chrom"), "pen_const": F.col("pen_const"), **{m: F.col(m) for m in MEASURES}}


def _compacted(spark: SparkSession, d: str, left_out: bool, *columns: str) -> DataFrame:
    records = table(spark, d, "cp_features")
    folder = shared_folder(spark, "compact")
    compact(records, table(spark, d, "cp_files"), _record(), folder, RAW_BYTES)
    return read_published(spark, folder, records.select(*columns or "*").schema, left_out)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _compacted(spark, d, True, "file_id", "line_no")


def p3_compacted(spark: SparkSession, d: str) -> DataFrame:
    return _compacted(spark, d, False)


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return assign_groups(table(spark, d, "cp_files"), RAW_BYTES).groupBy("group_id").agg(F.count("*").alias("n_files"), F.sum("n_bytes").alias("n_bytes"), F.sum("n_records").alias("n_records"))


def p3_balance(spark: SparkSession, d: str) -> DataFrame:
    """The groups in one row; ``balanced``: no two differ by more than the longest file."""
    longest = F.max(F.col("n_bytes")).alias("_longest")
    loads = p3_groups(spark, d).agg(F.count("*").alias("n_groups"), F.sum("n_files").alias("n_files"), F.sum("n_bytes").alias("n_bytes"), F.sum("n_records").alias("n_records"), (F.max("n_bytes") - F.min("n_bytes")).alias("_apart"))
    return loads.crossJoin(table(spark, d, "cp_files").agg(longest)).select("n_groups", "n_files", "n_bytes", "n_records", (F.col("_apart") <= F.col("_longest")).alias("balanced"))  # one row each


def _ingested(spark: SparkSession, d: str) -> DataFrame:
    return ingest(table(spark, d, "cncf_files"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_changes(_ingested(spark, d))


def p4_table(spark: SparkSession, d: str) -> DataFrame:
    return segments_of(_ingested(spark, d))


def p4_replayed(spark: SparkSession, d: str) -> DataFrame:
    return replay(promote(segments_of(_ingested(spark, d)), {"cf.em": "double", "nhet": "int", "arm": "string", "qc_flag": "string"}))


def p4_unreadable(spark: SparkSession, d: str) -> DataFrame:
    return unreadable(_ingested(spark, d))


QUERIES = {q.__name__: q for q in (p1_found, p2_found, p2_report, p3_found, p3_compacted, p3_groups, p3_balance, p4_found, p4_table, p4_replayed, p4_unreadable)}

_STRIP = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160))"
_SAMPLE = f"upper({_STRIP})"
_CHROM = f"regexp_replace({_STRIP.format('chrom')}, '^chr', '', 'i')"
_REFS = f"""
  SELECT * FROM (
    SELECT 'cncf' AS src_table, row_id, 'm' AS target, {_SAMPLE.format('sample_id')} AS k, loaded_at AS ts FROM cncf
    UNION ALL SELECT 'ctx_details', row_id, 'm', {_SAMPLE.format('dmp_sample')}, loaded_at FROM ctx_details
    UNION ALL SELECT 'manifest', row_id, 'f', {_STRIP.format('facets_cncf_path')}, loaded_at FROM manifest)
  WHERE k IS NOT NULL AND k <> '' AND upper(k) <> 'NA'"""
_GOALS = f"""
  SELECT 'm' AS target, {_SAMPLE.format('sample_id')} AS k, loaded_at AS since, deleted_at AS until FROM manifest
  UNION ALL SELECT 'f', {_STRIP.format('file_path')}, listed_at, deleted_at FROM facets_files"""
_SAME = ", ".join(("s", "c", "pen_const", *MEASURES))
_AGREE = " AND ".join(f"(t.{x} IS NULL OR t.{x} = f.{x})" for x in ("c", "pen_const", *MEASURES))
_PARSED = r"""
  aliases AS (SELECT unnest(['id','sample','sample_id','tumor_id','chrom','chr','chromosome','loc.start','loc_start','locstart','start','start_position','loc.end','loc_end','locend','end','end_position','num.mark','num_mark','nummark','cnlr.median','cnlr_median','cnlr.med','mafr','maf.r','maf_r','tcn','tcn.em','tcn_em','total_cn','lcn','lcn.em','lcn_em','minor_cn','seg','segment','seg_no']) AS alias,
                     unnest(['id','id','id','id','chrom','chrom','chrom','loc_start','loc_start','loc_start','loc_start','loc_start','loc_end','loc_end','loc_end','loc_end','loc_end','num_mark','num_mark','num_mark','cnlr_median','cnlr_median','cnlr_median','maf_r','maf_r','maf_r','tcn','tcn','tcn','tcn','lcn','lcn','lcn','lcn','seg','seg','seg']) AS field),
  once AS (SELECT feed_code, seq_no, any_value(content) AS content FROM cncf_files GROUP BY ALL),
  lines AS (SELECT feed_code, seq_no, list_filter(regexp_split_to_array(content, '\r\n|\r|\n'), lambda x: NOT regexp_matches(x, '^\s*(#|$)')) AS l FROM once),
  parts AS (SELECT *, CASE WHEN contains(l[1], chr(9)) THEN chr(9) ELSE ';' END AS sep FROM lines),
  names AS (SELECT feed_code, seq_no, generate_subscripts(string_split(l[1], sep), 1) AS i, unnest(string_split(l[1], sep)) AS raw FROM parts),
  cells AS (SELECT feed_code, seq_no, generate_subscripts(v, 1) AS i, trim(unnest(v), ' "' || chr(9)) AS x FROM (SELECT feed_code, seq_no, string_split(unnest(l[2:]), sep) AS v FROM parts)),
  kinds AS (SELECT feed_code, seq_no, i, CASE WHEN count(*) = 0 THEN NULL WHEN bool_or(NOT regexp_matches(x, '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$')) THEN 'text' WHEN bool_or(regexp_matches(x, '[.eE]')) THEN 'decimal' ELSE 'integer' END AS kind
            FROM cells WHERE lower(x) NOT IN ('', 'na', 'nan', '.') GROUP BY ALL),
  fields AS (SELECT n.feed_code, n.seq_no, coalesce(a.field, 'x:' || n.name) AS field, n.name, k.kind
             FROM (SELECT *, trim(raw, ' "' || chr(9)) AS name FROM names) n LEFT JOIN aliases a ON a.alias = lower(n.name) LEFT JOIN kinds k ON (k.feed_code, k.seq_no, k.i) = (n.feed_code, n.seq_no, n.i)),
  olds AS (SELECT feed_code, seq_no + 1 AS seq_no, field, name, kind FROM fields),
  pairs AS (SELECT feed_code, seq_no FROM fields INTERSECT SELECT feed_code, seq_no FROM olds)
"""

_RESCUED = _PARSED + r""",
  first AS (SELECT feed_code, seq_no, min(file_id) AS file_id, arg_min(delivered_at, file_id) AS loaded_at FROM cncf_files GROUP BY ALL),
  body AS (SELECT feed_code, seq_no, sep, generate_subscripts(l[2:], 1) AS line_no, unnest(l[2:]) AS line FROM parts),
  each AS (SELECT feed_code, seq_no, line_no, generate_subscripts(v, 1) AS i, unnest(v) AS raw FROM (SELECT *, string_split(line, sep) AS v FROM body)),
  vals AS (SELECT e.feed_code, e.seq_no, e.line_no, e.i, n.field, n.name, trim(e.raw, ' "' || chr(9)) AS x FROM each e JOIN (SELECT f.feed_code, f.seq_no, f.field, f.name, p.i FROM fields f JOIN (SELECT feed_code, seq_no, i, trim(raw, ' "' || chr(9)) AS name FROM names) p USING (feed_code, seq_no, name)) n ON (n.feed_code, n.seq_no, n.i) = (e.feed_code, e.seq_no, e.i)),
  seen AS (SELECT *, lower(x) IN ('', 'na', 'nan', '.') AS absent, field IN ('loc_start','loc_end','cnlr_median','maf_r','tcn','lcn') AS dbl, field IN ('num_mark','seg') AS int_, field LIKE 'x:%' AS extra, {mend} AS mended FROM vals),
  num AS (SELECT *, CASE WHEN (dbl OR int_) AND NOT absent AND regexp_matches(coalesce(mended, x), '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN TRY_CAST(coalesce(mended, x) AS DOUBLE) END AS n0 FROM seen),
  cast_ AS (SELECT *, CASE WHEN dbl OR (n0 = round_even(n0, 0) AND abs(n0) < 2147483648) THEN n0 END AS n FROM num),
  told AS (SELECT *, (extra AND NOT ({promoted})) OR ((dbl OR int_) AND NOT absent AND n IS NULL) AS lost FROM cast_)
SELECT first.file_id, CAST(line_no AS INTEGER) AS line_no, regexp_replace(max(x) FILTER (field = 'id' AND NOT absent), '_hisens$', '') AS sample_id, max(x) FILTER (field = 'id' AND NOT absent) AS facets_id, max(x) FILTER (field = 'chrom' AND NOT absent) AS chrom,
  max(n) FILTER (field = 'loc_start') AS loc_start, max(n) FILTER (field = 'loc_end') AS loc_end, CAST(max(n) FILTER (field = 'num_mark') AS INTEGER) AS num_mark, max(n) FILTER (field = 'cnlr_median') AS cnlr_median, max(n) FILTER (field = 'maf_r') AS maf_r, max(n) FILTER (field = 'tcn') AS tcn, max(n) FILTER (field = 'lcn') AS lcn,
  CAST(max(n) FILTER (field = 'seg') AS INTEGER) AS seg, any_value(first.loaded_at) AS loaded_at, '{{' || string_agg('"' || CASE WHEN extra THEN field[3:] ELSE field END || '":"' || replace(replace(x, '\', '\\'), '"', '\"') || '"', ',' ORDER BY i) FILTER (lost) || '}}' AS rescued {more}
FROM told JOIN first USING (feed_code, seq_no) GROUP BY first.file_id, line_no"""
_MEND = r"CASE WHEN (field IN ('loc_start','loc_end','cnlr_median','maf_r','tcn','lcn','num_mark','seg')) THEN CASE WHEN regexp_matches(x, '^[+-]?[0-9]+,[0-9]+$') THEN replace(x, ',', '.') WHEN regexp_matches(x, '^(s|CN)[0-9]+$') THEN regexp_replace(x, '^(s|CN)', '') WHEN regexp_matches(x, '^~[0-9.]+$') THEN x[2:] WHEN regexp_matches(x, '^[0-9.]+\*$') THEN x[:-2] END END"

ORACLE = {
    "p4_table": "WITH " + _RESCUED.replace("{mend}", "NULL").replace("{promoted}", "false").replace("{more}", "").replace("{{", "{").replace("}}", "}"),
    "p4_replayed": "WITH " + _RESCUED.replace("{mend}", _MEND).replace("{promoted}", "(name = 'cf.em' AND TRY_CAST(x AS DOUBLE) IS NOT NULL) OR (name = 'nhet' AND TRY_CAST(x AS INTEGER) IS NOT NULL) OR name IN ('arm', 'qc_flag')")
    .replace("{more}", ", max(TRY_CAST(x AS DOUBLE)) FILTER (name = 'cf.em') AS cf_em, max(TRY_CAST(x AS INTEGER)) FILTER (name = 'nhet') AS nhet, max(x) FILTER (name = 'arm') AS arm, max(x) FILTER (name = 'qc_flag') AS qc_flag").replace("{{", "{").replace("}}", "}"),
    "p4_unreadable": r"SELECT file_id, feed_code, seq_no FROM (SELECT *, row_number() OVER (PARTITION BY feed_code, seq_no ORDER BY file_id) AS rn FROM cncf_files) WHERE rn = 1 AND NOT regexp_matches(coalesce(content, ''), '(^|[\r\n])\s*[^#\s]')",
    "p1_found": r"""
WITH f AS (SELECT 'manifest' AS src_table, row_id, chr_ctx FROM manifest UNION ALL SELECT 'ctx_details', row_id, chr_ctx FROM ctx_details),
b AS (SELECT src_table, row_id, regexp_replace(regexp_replace(trim(chr_ctx, ' ' || chr(9) || chr(10) || chr(13)), '^c?[(\[{]|[)\]}]$', '', 'g'), '(^|[\s,;|])[nN]/[aA]($|[\s,;|])', '\1\2', 'g') AS x FROM f),
t AS (SELECT src_table, row_id, regexp_extract_all(x, '"(?:[^"]|"")*"|''[^'']*''|[^\s,;|/\\&+·，；、"'']+') AS l FROM b),
u AS (SELECT src_table, row_id, generate_subscripts(l, 1) AS i, unnest(l) AS v FROM t),
q AS (SELECT src_table, row_id, i, v AS raw, CASE WHEN v LIKE '"%' THEN replace(v[2:-2], '""', '"') WHEN v LIKE '''%' THEN v[2:-2] ELSE v END AS v FROM u WHERE lower(v) <> 'and'),
w AS (SELECT src_table, row_id, i, trim(regexp_replace(trim(v), '^chr', '', 'i')) AS chrom_value FROM q)
SELECT src_table, row_id, CAST(row_number() OVER (PARTITION BY src_table, row_id ORDER BY i) AS INTEGER) AS pos, chrom_value
FROM w WHERE lower(chrom_value) NOT IN ('', 'na', 'n/a', 'nan', 'none', 'null', 'nil', '-', '.')""",
    "p2_found": f"""
SELECT src_table, row_id FROM ({_REFS}) r
WHERE NOT EXISTS (SELECT 1 FROM ({_GOALS}) g WHERE g.target = r.target AND g.k = r.k AND g.since <= r.ts AND (g.until IS NULL OR g.until > r.ts))""",
    "p2_report": f"""
WITH r AS ({_REFS}), g AS ({_GOALS}),
o AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.target = r.target AND g.k = r.k AND g.since <= r.ts AND (g.until IS NULL OR g.until > r.ts))),
f AS (SELECT target, k, min(since) AS first_since FROM g GROUP BY ALL)
SELECT src_table, strftime(ts, '%Y-%m') AS month, CASE WHEN first_since IS NULL THEN 'missing' WHEN first_since > ts THEN 'late' ELSE 'deleted' END AS problem, count(*) AS n_rows
FROM o LEFT JOIN f USING (target, k) GROUP BY ALL""",
    "p3_found": f"""
WITH n AS (SELECT *, {_SAMPLE.format('sample_id')} AS s, {_CHROM} AS c FROM cp_features),
d AS (SELECT *, row_number() OVER (PARTITION BY {_SAME} ORDER BY file_id, line_no) AS rn FROM n)
SELECT file_id, line_no FROM d t WHERE rn > 1
   OR (cp_n_probes IS NULL AND EXISTS (SELECT 1 FROM (SELECT DISTINCT {_SAME} FROM n WHERE cp_n_probes IS NOT NULL) f WHERE f.s = t.s AND {_AGREE}))""",
    "p3_compacted": f"""
WITH n AS (SELECT *, {_SAMPLE.format('sample_id')} AS s, {_CHROM} AS c FROM cp_features),
d AS (SELECT *, row_number() OVER (PARTITION BY {_SAME} ORDER BY file_id, line_no) AS rn FROM n)
SELECT * EXCLUDE (s, c, rn) FROM d t WHERE rn = 1
   AND NOT (cp_n_probes IS NULL AND EXISTS (SELECT 1 FROM (SELECT DISTINCT {_SAME} FROM n WHERE cp_n_probes IS NOT NULL) f WHERE f.s = t.s AND {_AGREE}))""",
    "p3_balance": f"SELECT CAST(ceil(sum(n_bytes) / {RAW_BYTES}.0) AS BIGINT) AS n_groups, count(*) AS n_files, CAST(sum(n_bytes) AS BIGINT) AS n_bytes, CAST(sum(n_records) AS BIGINT) AS n_records, true AS balanced FROM cp_files",
    "p4_found": f"""
WITH {_PARSED}
SELECT feed_code, CAST(seq_no AS INTEGER) AS seq_no, change_kind, field_name FROM (
  SELECT feed_code, seq_no, 'added' AS change_kind, name AS field_name FROM fields f SEMI JOIN pairs USING (feed_code, seq_no) ANTI JOIN olds o USING (feed_code, seq_no, field)
  UNION ALL SELECT feed_code, seq_no, 'removed', name FROM olds SEMI JOIN pairs USING (feed_code, seq_no) ANTI JOIN fields USING (feed_code, seq_no, field)
  UNION ALL SELECT feed_code, seq_no, 'renamed', f.name FROM fields f JOIN olds o USING (feed_code, seq_no, field) WHERE f.name <> o.name
  UNION ALL SELECT feed_code, seq_no, 'retyped', f.name FROM fields f JOIN olds o USING (feed_code, seq_no, field) WHERE f.kind <> o.kind)""",
}
