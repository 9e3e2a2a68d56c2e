"""Raw segment files whose schema drifts: rescue-column ingestion and a report of every change.

Each file is read against the target schema. What its header calls by a known name becomes a typed column; fields
that are unknown, and values that can't be cast, are kept as JSON in ``rescued``. With its lines the ingestion gives one
report of the file: the fields that it found, under which name, and what their values are. Changes from file to file are
read off these reports. Approved fields can be promoted to columns later, and rescued values replayed through approved
rules, without reading the raw files again.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from segscan.operators.joins import lookup
from segscan.sources.tables import checkpointed

# The names by which headers call the target's fields, in lower case and without anything but letters and digits.
ALIASES = {
    "id": ("id", "sample", "sampleid", "tumorid", "tumorsamplebarcode", "facetsid", "runid"),
    "chrom": ("chrom", "chr", "chromosome"),
    "loc_start": ("locstart", "start", "startposition", "startpos", "segstart", "chromstart"),
    "loc_end": ("locend", "end", "endposition", "endpos", "segend", "chromend"),
    "num_mark": ("nummark", "nummarks", "nmark", "nmarks", "numprobes", "nprobes"),
    "cnlr_median": ("cnlrmedian", "cnlrmed", "mediancnlr"),
    "maf_r": ("mafr",),
    "tcn": ("tcn", "tcnem", "totalcn", "totalcopynumber"),
    "lcn": ("lcn", "lcnem", "minorcn", "minorcopynumber", "lessercn"),
    "seg": ("seg", "segment", "segno", "segid", "segmentno", "segmentid"),
}
# The target's types.
TYPES = {"id": "string", "chrom": "string", "loc_start": "double", "loc_end": "double", "num_mark": "int", "cnlr_median": "double", "maf_r": "double", "tcn": "double", "lcn": "double", "seg": "int"}
ABSENT = ("", "na", "nan", ".")
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
# Rules for rescued values: what to replace before the cast is tried again.
REPLAY = {"decimal or thousands comma": (r"^([+-]?[0-9]+),([0-9]+)$", "$1.$2"), "letter before a number": (r"^(?:s|CN)([0-9]+)$", "$1"), "about": (r"^~([0-9.]+)$", "$1"), "starred": (r"^([0-9.]+)\*$", "$1")}


_FIELD = pa.struct([("field", pa.string()), ("name", pa.string()), ("kind", pa.string())])
_CHUNK = 1000
_KNOWN = {alias: field for field, aliases in ALIASES.items() for alias in aliases}
_CODE = {field: i for i, field in enumerate(TYPES)}


def _bare(cells: pa.Array) -> pa.Array:
    """Without outer white space and one pair of quote marks."""
    cells = pc.utf8_trim_whitespace(cells)
    for mark in ('"', "'"):
        cells = pc.replace_substring_regex(cells, f"^{mark}(.*){mark}$", "\\1")
    return pc.utf8_trim_whitespace(cells)


@lru_cache(maxsize=10_000)
def _targets(names: tuple[str, ...]) -> list[str]:
    """The target's field of each name, or ``x:`` and the name; what is claimed twice, or would be one key, gets a number."""
    taken: set[str] = set()
    out = []
    for name in names:
        field = _KNOWN.get(re.sub("[^a-z0-9]", "", name.lower()))
        if field is None or field in taken:
            key, k = name, 1
            while key in TYPES or f"x:{key}" in taken:  # its key among the rescued values is its own
                k += 1
                key = f"{name} {k}"
            field = f"x:{key}"
        out.append(field)
        taken.add(field)
    return out


def _floats(cells: pa.Array) -> np.ndarray:
    """The numbers that match ``NUMBER``; those too large for a double are infinite."""
    try:
        return pc.cast(pc.utf8_ltrim(cells, "+"), pa.float64()).to_numpy(zero_copy_only=False)
    except pa.ArrowInvalid:
        return np.array(cells.to_pylist(), dtype=object).astype(float)


def _as_json(keys: pa.Array, values: pa.Array) -> pa.Array:
    """``"key":"value"`` of each pair."""

    def safe(x: pa.Array) -> pa.Array:
        plain = pc.replace_substring(pc.replace_substring(x, "\\", "\\\\"), '"', '\\"')
        control = pc.match_substring_regex(x, "[\\x00-\\x1f]")
        return pc.replace_with_mask(plain, control, pa.array([json.dumps(v, ensure_ascii=False)[1:-1] for v in x.filter(control).to_pylist()], pa.string()))

    return pc.binary_join_element_wise('"', safe(keys), '":"', safe(values), '"', "")


class _Lines:
    """Files that all have a header line and one separator, read against the target schema."""

    def __init__(self, content: pa.Array, sep: str) -> None:
        lines = pc.split_pattern_regex(content, "\r\n|\r|\n")
        file_of = pc.list_parent_indices(lines).to_numpy()
        flat = pc.list_flatten(lines)
        real = ~pc.match_substring_regex(flat, r"^\s*(#|$)").to_numpy(zero_copy_only=False)
        file_of, flat = file_of[real], flat.filter(pa.array(real))
        is_header = np.concatenate(([True], file_of[1:] != file_of[:-1]))
        split = pc.split_pattern(flat, sep)
        width = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        cells = _bare(pc.list_flatten(split))
        line_of = np.repeat(np.arange(len(flat)), width)
        column = np.arange(len(cells)) - np.repeat(np.concatenate(([0], np.cumsum(width)[:-1])), width)
        in_header = is_header[line_of]
        most = int(width.max())
        size = len(content) * most
        spot = file_of[line_of] * most + column
        # What the header calls each place of a file: a field of the target, an extra one, or nothing.
        names = cells.filter(pa.array(in_header))
        header_spots, ends = spot[in_header], np.cumsum(width[is_header])
        listed = names.to_pylist()
        targets = [t for e, n in zip(ends, width[is_header]) for t in _targets(tuple(listed[e - n : e]))]
        code = np.full(size, -2)
        code[header_spots] = [_CODE.get(t, -1) for t in targets]
        # What each value is, and whether the target's type can take it.
        body = ~in_header
        self.cells = cells = cells.filter(pa.array(body))
        spot, self.column = spot[body], column[body]
        self.file = file_of[~is_header]
        before = np.cumsum(~is_header) - 1
        self.line = before[line_of[body]]
        self.code = code[spot]
        self.absent = pc.is_in(pc.utf8_lower(cells), pa.array(ABSENT)).to_numpy(zero_copy_only=False)
        is_number = pc.match_substring_regex(cells, NUMBER).to_numpy(zero_copy_only=False) & ~self.absent
        pointed = pc.match_substring_regex(cells, "[.eE]").to_numpy(zero_copy_only=False)
        some, text, decimal = (np.bincount(spot[m], minlength=size) > 0 for m in (~self.absent, ~self.absent & ~is_number, is_number & pointed))
        kind = np.where(~some, 0, np.where(text, 1, np.where(decimal, 2, 3)))
        self.value = np.full(len(cells), np.nan)
        numeric = is_number & np.isin(self.code, [i for f, i in _CODE.items() if TYPES[f] != "string"])
        self.value[numeric] = _floats(cells.filter(pa.array(numeric)))
        whole = np.isin(self.code, [i for f, i in _CODE.items() if TYPES[f] == "int"])
        with np.errstate(invalid="ignore"):
            self.value[whole & ~((self.value == np.rint(self.value)) & (np.abs(self.value) < 2**31))] = np.nan
        strings = np.isin(self.code, [i for f, i in _CODE.items() if TYPES[f] == "string"])
        lost = (self.code >= 0) & ~strings & ~self.absent & np.isnan(self.value)
        empty = pc.equal(cells, "").to_numpy(zero_copy_only=False)
        self.rescue = lost | (self.code == -1) | ((self.code == -2) & ~empty)
        keys = np.full(size, "", object)
        keys[header_spots] = [t.removeprefix("x:") for t in targets]
        self.keys = keys[spot]
        kinds = pa.array([None, "text", "decimal", "integer"]).take(pa.array(kind[header_spots]))
        self.fields = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(targets), names, kinds], fields=list(_FIELD)))

    def typed(self, field: str) -> pa.Array:
        """The column of the target: one value per line, null where it is missing or can't be cast."""
        at = np.full(len(self.file), -1)
        mine = np.flatnonzero((self.code == _CODE[field]) & ~self.absent)
        at[self.line[mine]] = mine
        if TYPES[field] == "string":
            return self.cells.take(pa.array(at, mask=at < 0))
        found = np.where(at >= 0, self.value[at], np.nan) if len(self.value) else np.zeros(0)
        missing = np.isnan(found)
        return pa.array(np.where(missing, 0, found).astype(np.int32 if TYPES[field] == "int" else float), mask=missing)

    def rescued(self) -> pa.Array:
        """One JSON object per line of what has no typed place, null where all has one."""
        at = np.flatnonzero(self.rescue)
        beyond = self.code[at] == -2
        keys = self.keys[at]
        keys[beyond] = [f" column {c + 1}" for c in self.column[at][beyond]]
        pairs = _as_json(pa.array(keys, pa.string()), self.cells.take(pa.array(at)))
        count = np.bincount(self.line[at], minlength=len(self.file))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32)), pairs)
        joined = pc.binary_join_element_wise("{", pc.binary_join(lists, ","), "}", "")
        return pc.if_else(pa.array(count > 0), joined, pa.scalar(None, pa.string()))

    def line_no(self) -> np.ndarray:
        """From 1 in each file."""
        first = np.flatnonzero(np.concatenate(([True], self.file[1:] != self.file[:-1]))) if len(self.file) else np.zeros(0, int)
        return np.arange(len(self.file)) - np.repeat(first, np.diff(np.concatenate((first, [len(self.file)])))) + 1


_REPORT = "fields array<struct<field:string,name:string,kind:string>>"
_COLUMNS = "line_no int, sample_id string, facets_id string, " + ", ".join(f"{f} {t}" for f, t in TYPES.items() if f != "id")


def delivered_once(files: DataFrame) -> DataFrame:
    """Without files of one feed and number that came again: the lowest ``file_id`` stays. Null feeds and numbers are never copies."""
    ids = files.groupBy("feed_code", "seq_no", "file_id").agg(F.count("*").alias("_n"))
    again = checkpointed(ids.groupBy("feed_code", "seq_no").agg(F.min("file_id").alias("_first"), F.count("*").alias("_files"), F.max("_n").alias("_n")).filter("_files > 1 OR _n > 1"))
    if again.filter("_n > 1").limit(1).count():
        files = files.dropDuplicates(["file_id"])
    copies = again.filter("feed_code IS NOT NULL AND seq_no IS NOT NULL AND _files > 1").select("feed_code", "seq_no", "_first")
    known = lookup(files, copies, ["feed_code", "seq_no"], F.col("file_id"))
    return known.filter(F.col("_first").isNull() | (F.col("_first") == F.col("file_id"))).drop("_first")


def ingest(files: DataFrame) -> DataFrame:
    """All files in one table: feed_code, seq_no, file_id, line_no, the columns of the target, loaded_at, ``rescued`` (JSON or null), ``fields``.

    ``files``: feed_code, seq_no, file_id, delivered_at, content. Each line is a row, numbered from 1; ``fields`` is null there. The
    run's name gives ``facets_id``, and without the ending _hisens ``sample_id``; ``loaded_at`` is the delivery. Each
    file has one more row, with line_no 0, that reports its ``fields``: array of (field, name, kind), in the order of the
    header. ``field`` is the target's name or ``x:`` and the name as it stands, ``kind`` is text, decimal, integer or
    null (no value). If two columns claim one field the first has it; repeated names, and the target's own, get a number. A
    file without a header line (null, empty or comments only) has that row alone, with null ``fields``. Lines that begin
    with # and blank lines are left out. Cells beyond the header that aren't empty are rescued as " column 12", by their
    place in the line. A file that came twice is read once. Batches are read as Arrow arrays.
    """
    kept = ("feed_code", "seq_no", "file_id")
    schema = T.StructType([files.schema[c] for c in kept] + T.StructType.fromDDL(_COLUMNS).fields + [T.StructField("loaded_at", files.schema["delivered_at"].dataType)] + T.StructType.fromDDL(f"rescued string, {_REPORT}").fields)
    arrow = to_arrow_schema(schema)

    def batch_of(columns: dict[str, pa.Array], n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in arrow], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _CHUNK):
                batch = whole.slice(at, _CHUNK)
                text = pc.fill_null(batch.column("content"), "")
                header = pc.struct_field(pc.extract_regex(text, r"(?:^|[\r\n])\s*(?P<h>[^#\s][^\r\n]*)"), "h")
                found = pc.is_valid(header)
                tabbed = pc.fill_null(pc.match_substring(header, "\t"), False)
                if (bad := batch.filter(pc.invert(found))).num_rows:
                    yield batch_of({c: bad.column(c) for c in kept} | {"loaded_at": bad.column("delivered_at"), "line_no": pa.array(np.zeros(bad.num_rows, np.int32))}, bad.num_rows)
                for sep, mine in (("\t", tabbed), (";", pc.and_(pc.invert(tabbed), found))):
                    part = batch.filter(mine)
                    if not part.num_rows:
                        continue
                    lines = _Lines(part.column("content"), sep)
                    yield batch_of({c: part.column(c) for c in kept} | {"loaded_at": part.column("delivered_at"), "line_no": pa.array(np.zeros(part.num_rows, np.int32)), "fields": lines.fields}, part.num_rows)
                    of = part.take(pa.array(lines.file))
                    run_id = lines.typed("id")
                    columns = {c: of.column(c) for c in kept} | {"loaded_at": of.column("delivered_at"), "line_no": pa.array(lines.line_no()), "rescued": lines.rescued()}
                    columns |= {"facets_id": run_id, "sample_id": pc.replace_substring_regex(run_id, "_hisens$", "")} | {f: lines.typed(f) for f in TYPES if f != "id"}
                    yield batch_of(columns, of.num_rows)

    return delivered_once(files.select(*kept, "delivered_at", "content")).mapInArrow(run, schema)


def segments_of(ingested: DataFrame) -> DataFrame:
    """The segments of all files: file_id, line_no, the columns of the target, loaded_at, ``rescued``."""
    return ingested.filter("line_no > 0").drop("feed_code", "seq_no", "fields")


def unreadable(ingested: DataFrame) -> DataFrame:
    """``file_id, feed_code, seq_no`` of the files that have no header line."""
    return ingested.filter("line_no = 0 AND fields IS NULL").select("file_id", "feed_code", "seq_no")


def schema_changes(ingested: DataFrame) -> DataFrame:
    """``feed_code, seq_no, change_kind, field_name``: how each file differs from the one before it in its feed, by the reports of the ingestion.

    A file whose predecessor is not there or unreadable reports nothing, nor does one with null feed or number. One shuffle
    by feed and number, whatever the size of a feed.
    """
    files = ingested.filter("line_no = 0 AND fields IS NOT NULL AND feed_code IS NOT NULL AND seq_no IS NOT NULL")
    both = files.select("feed_code", "fields", F.explode(F.array(F.struct(F.col("seq_no"), F.lit(True).alias("newer")), F.struct((F.col("seq_no") + 1).alias("seq_no"), F.lit(False).alias("newer")))).alias("_s")).select("feed_code", "fields", "_s.*")
    pair = both.groupBy("feed_code", "seq_no").agg(F.first(F.when(F.col("newer"), F.col("fields")), True).alias("new"), F.first(F.when(~F.col("newer"), F.col("fields")), True).alias("old")).filter("new IS NOT NULL AND old IS NOT NULL")

    def other(side: str, x: Column) -> Column:
        return F.get(F.filter(side, lambda y: y["field"] == x["field"]), F.lit(0))

    def told(side: str, keep, change: str) -> Column:
        return F.transform(F.filter(side, keep), lambda x: F.struct(F.lit(change).alias("change_kind"), x["name"].alias("field_name")))

    changes = [
        told("new", lambda x: other("old", x).isNull(), "added"),
        told("old", lambda x: other("new", x).isNull(), "removed"),
        told("new", lambda x: F.coalesce(other("old", x)["name"] != x["name"], F.lit(False)), "renamed"),
        told("new", lambda x: F.coalesce(other("old", x)["kind"] != x["kind"], F.lit(False)), "retyped"),
    ]
    return pair.select("feed_code", "seq_no", F.explode(reduce(lambda a, b: F.concat(a, b), changes)).alias("c")).select("feed_code", "seq_no", "c.change_kind", "c.field_name")


def _cast(value: Column, field: str) -> Column:
    number = F.when(value.rlike(NUMBER), value.try_cast("double"))
    return number if TYPES[field] == "double" else F.when(number == F.rint(number), number).try_cast("int")


def promote(rows: DataFrame, approved: dict[str, str]) -> DataFrame:
    """Approved extra fields taken out of ``rescued`` into columns: name to type (dots become underscores)."""
    m = F.from_json("rescued", "map<string,string>")
    out = rows.withColumn("_r", m)
    for name, kind in approved.items():
        out = out.withColumn(name.replace(".", "_"), F.try_element_at("_r", F.lit(name)).try_cast(kind))
    done = F.map_filter("_r", lambda k, v: ~F.coalesce(F.element_at(F.create_map(*[x for n in approved for x in (F.lit(n), F.col(n.replace(".", "_")).isNotNull())]), k), F.lit(False)))
    return out.withColumn("rescued", F.when(F.size(done) > 0, F.to_json(done))).drop("_r")


def replay(rows: DataFrame, rules: dict[str, tuple[str, str]] = REPLAY) -> DataFrame:
    """Rescued values of the target's numeric fields put into their columns where an approved rule makes them numbers."""
    fields = [f for f in TYPES if f not in ("id", "chrom")]

    def mend(key: Column, value: Column) -> Column:
        return F.coalesce(*[F.when(value.rlike(p), F.regexp_replace(value, p, to)) for p, to in rules.values()])

    out = rows.withColumn("_r", F.from_json("rescued", "map<string,string>")).withColumn("_n", F.transform_values("_r", mend))
    out = out.select(*[F.coalesce(F.col(c), _cast(F.try_element_at("_n", F.lit(c)), c)).alias(c) if c in fields else F.col(c) for c in out.columns])
    left = F.map_filter("_r", lambda k, v: ~F.coalesce(F.element_at(F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f).isNotNull())]), k), F.lit(False)))
    return out.withColumn("rescued", F.when(F.size(left) > 0, F.to_json(left))).drop("_r", "_n")
