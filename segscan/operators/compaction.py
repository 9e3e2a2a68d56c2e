"""Far too many small files: a few well-sized files that hold each record once.

1. Files are given to output groups by longest-first scheduling with a least-loaded heap. Blocks of files, spread
   by hash, are scheduled side by side, so that no task sees the whole listing.
2. Copies of a record, and records torn off while being written, are left out; the first copy stays. Only digests and
   places of records are shuffled for that; what stays is marked by a row of its own that meets its record in the group.
3. Each group is written through pyarrow into one data file; what was left out goes to a file per block, or per group.
   Where a block has few records, one task takes it whole: it schedules and writes, and rows are shuffled once, by block.
   Larger blocks are shuffled by group.
4. The written files are read back by tasks and compared with what went in, by row counts and sums of row hashes. Only
   then a manifest that names them is written, under a new name, and a pointer to it put in place. Files of lost or
   repeated tasks carry another name and are never named in it. The driver holds names and sums, and lists no files.
"""

from __future__ import annotations

import heapq
import itertools
import json
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from segscan.operators.joins import BROADCAST_ROWS, lookup
from segscan.sources.tables import checkpointed, stored

#: Raw bytes that one output file takes in, and files that one task schedules.
TARGET_BYTES = 128 << 20
BLOCK_FILES = 50_000
#: Bytes that a record of a file without listing is taken for.
RECORD_BYTES = 64
#: Records up to which one task takes a whole block, rows that a task reads back, and keys that are broadcast at once.
BLOCK_RECORDS = 500_000
READ_ROWS = 200_000
BROADCAST_KEYS = 1_000_000
#: Blocks from which half of them are shuffled and written at a time, so that less lies on disk at once.
HALVED_BLOCKS = 16
# Where file and line fit into these bits, a place is one number.
_FILE_BITS, _LINE_BITS = 40, 23
# Stand for a missing file and line: after all others.
_NO_FILE, _NO_LINE = (1 << 63) - 1, (1 << 31) - 1


def balance(sizes: list[int], groups: int) -> list[int]:
    """The group of each item: the longest first, each to the group that holds least so far."""
    heap = [(0, g) for g in range(groups)]
    chosen = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        load, g = heapq.heappop(heap)
        chosen[i] = g
        heapq.heappush(heap, (load + sizes[i], g))
    return chosen


def _scheduled(sizes: np.ndarray, target_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """The (first) group of each file of a block, and its number of groups."""
    parts = np.maximum(1, -(-sizes // target_bytes))
    small, large = parts == 1, parts > 1
    groups = max(1, -(-int(sizes[small].sum()) // target_bytes))
    local = np.zeros(len(sizes), np.int64)
    local[small] = balance(sizes[small].tolist(), groups)
    local[large] = groups + parts[large].cumsum() - parts[large]
    return local, parts


def assign_groups(files: DataFrame, target_bytes: int = TARGET_BYTES, block_files: int = BLOCK_FILES) -> DataFrame:
    """``file_id, n_bytes, n_records, group_id, n_parts``: the output group of each file.

    A file larger than ``target_bytes`` gets ``n_parts`` groups of its own, from ``group_id`` on. Null and negative
    sizes count as 0. A file listed twice is one file (the larger size holds). An empty listing gives no row.
    """
    files = checkpointed(files.groupBy("file_id").agg(F.max(F.greatest(F.coalesce("n_bytes", F.lit(0)), F.lit(0))).cast("long").alias("n_bytes"), F.max("n_records").cast("long").alias("n_records")))  # counted, then scheduled
    blocks = max(1, -(-files.count() // block_files))

    def schedule(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("file_id", ignore_index=True)
        local, parts = _scheduled(pdf["n_bytes"].to_numpy(np.int64), target_bytes)
        return pdf.assign(group_id=(int(key[0]) << 32) + local, n_parts=parts)[["file_id", "n_bytes", "n_records", "group_id", "n_parts"]]

    block = F.pmod(F.xxhash64("file_id"), F.lit(blocks)).alias("block")
    return files.select("*", block).groupBy("block").applyInPandas(lambda key, pdf: schedule(key, pdf.drop(columns="block")), "file_id long, n_bytes long, n_records long, group_id long, n_parts long")


def _file() -> Column:
    return F.coalesce(F.col("file_id").cast("long"), F.lit(_NO_FILE))


def _block(file: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(file), F.lit(blocks)).cast("int").alias("_block")


def _digest(keys: list[str], mask: Column | int, within: int | None = None) -> Column:
    """128 bits of the fields in ``keys`` that ``within`` has (all by default); ``mask`` says which are there, as hashes skip nulls."""
    fields = [F.col(k) for i, k in enumerate(keys) if within is None or within >> i & 1]
    mask = F.lit(mask) if isinstance(mask, int) else mask
    return F.struct(mask.alias("m"), F.xxhash64(mask, *fields).alias("a"), F.xxhash64(F.lit(-1), *fields[::-1], mask).alias("b"))


def _keyed(records: DataFrame, identity: dict[str, Column]) -> tuple[DataFrame, list[str]]:
    """``records`` with their normalised fields, ``_d`` (digest) and ``_at`` (place: the lowest is the first written)."""
    keys = [f"_k_{n}" for n in identity]
    keyed = records.select("*", *[e.alias(k) for k, e in zip(keys, identity.values())])
    mask = sum((F.when(F.col(k).isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, k in enumerate(keys)), F.lit(0))
    at = _file().cast("decimal(19,0)") * F.lit(10**10).cast("decimal(11,0)") + F.coalesce(F.col("line_no").cast("long"), F.lit(_NO_LINE)).cast("decimal(11,0)")
    return keyed.withColumn("_d", _digest(keys, mask)).withColumn("_at", at.cast("decimal(31,0)")), keys


def first_copies(records: DataFrame, identity: dict[str, Column]) -> DataFrame:
    """``_d, _at, _file`` of the records to keep: of equal ones the first by file and line, and no torn row that a full one covers.

    ``identity``: name and normalised expression of the fields that make a record, in the order in which they are
    written. Nulls agree with nulls; a null file or line comes after all others. A torn row has a null in the last field;
    it is left out if some full row agrees with it in every field that it has (one that has nothing agrees with all).
    Copies are reduced before the shuffle, to one row of numbers per task, however many there are.
    """
    keyed, keys = _keyed(records, identity)
    full_bit = 1 << (len(keys) - 1)
    best = checkpointed(keyed.groupBy("_d.m", "_d.a", "_d.b").agg(F.min("_at").alias("_at"), F.min(_file()).alias("_file")))
    kept = best.select(F.struct("m", "a", "b").alias("_d"), "_at", "_file")
    torn = best.filter(F.col("m").bitwiseAND(full_bit) == 0)
    patterns = sorted(r[0] for r in torn.select("m").distinct().collect())  # at most 2 ** (fields - 1)
    if not patterns:
        return kept
    # Full rows stay where they are read if the torn ones are few enough to be broadcast; else their digests are joined by shuffle.
    each = F.explode(F.array(*[_digest(keys, m, m) for m in patterns])).alias("_d")
    covers = keyed.filter(F.col(keys[-1]).isNotNull()).select(each).select("_d.m", "_d.a", "_d.b")
    few = torn.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    covered = (covers.join(F.broadcast(torn.select("m", "a", "b")), ["m", "a", "b"], "left_semi") if few else covers).distinct()
    whole = torn.select(F.struct("m", "a", "b").alias("_d"), "_at", "_file", "m", "a", "b").join(covered, ["m", "a", "b"], "left_anti").select("_d", "_at", "_file")
    return kept.filter(F.col("_d.m").bitwiseAND(full_bit) != 0).unionByName(whole)


def _met(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` joined with stored ``keys`` on ``m, a, b``; the keys are broadcast in slices by ``a``, so that no key is one task."""
    slices = max(1, -(-keys.count() // BROADCAST_KEYS))
    named = keys.withColumnsRenamed({"m": "_m", "b": "_b"})
    met = [rows.join(F.broadcast(named.filter(F.pmod("a", F.lit(slices)) == i) if slices > 1 else named), "a").filter((F.col("m") == F.col("_m")) & (F.col("b") == F.col("_b"))).drop("_m", "_b") for i in range(slices)]
    return reduce(DataFrame.unionByName, met)


def _place() -> Column:
    """File and line as one number; missing ones come last."""
    file, line = (F.coalesce(F.col(c).cast("long"), F.lit((1 << bits) - 1)) for c, bits in (("file_id", _FILE_BITS), ("line_no", _LINE_BITS)))
    return file * F.lit(1 << _LINE_BITS) + line


def later_copies(records: DataFrame, identity: dict[str, Column], work: str) -> DataFrame:
    """``_p, a, b, n``: how many records with this place and digest are to be left out; what ``first_copies`` keeps is not among them.

    Only digests and places are shuffled, reduced before. Records met once give no row, and of two copies the later place is
    known at once; three or more are looked up by digest. ``work``: a folder for what is read more than once.
    """
    keyed, keys = _keyed(records, identity)
    last = F.col(keys[-1])
    digests = keyed.select("_d.m", "_d.a", "_d.b", _place().alias("_p"))
    again = stored(digests.groupBy("m", "a", "b").agg(F.count("*").alias("n"), F.min("_p").alias("_first"), F.max("_p").alias("_last")).filter("n > 1"), f"{work}/again")
    torn = stored(keyed.filter(last.isNull()).select("_d.m", "_d.a", "_d.b").distinct(), f"{work}/torn")
    patterns = sorted(r[0] for r in torn.select("m").distinct().collect())  # at most 2 ** (fields - 1)
    many = again.filter("n > 2").select("m", "a", "b", "_first")
    twice = again.filter("n = 2").select("m", "a", "b", "_last")
    if patterns:
        each = F.explode(F.array(*[_digest(keys, m, m) for m in patterns])).alias("_d")
        covered = stored(_met(keyed.filter(last.isNotNull()).select(each).select("_d.m", "_d.a", "_d.b"), torn).distinct(), f"{work}/covered")
        many, twice = (df.join(covered, ["m", "a", "b"], "left_anti") for df in (many, twice))
        many = many.unionByName(covered.withColumn("_first", F.lit(None).cast("long")))
    found = _met(digests, stored(many, f"{work}/many")).groupBy("_p", "a", "b").agg((F.count("*") - F.max(F.when(F.col("_p") == F.col("_first"), 1).otherwise(0))).alias("n")).filter("n > 0")
    return found.unionByName(twice.select(F.col("_last").alias("_p"), "a", "b", F.lit(1).cast("long").alias("n")))


def _block_writer(folder: str, schema: pa.Schema, target_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Schedules and writes blocks: of each its records (kind 0), what is to be left out (1) and its listing (2), in any order."""

    def block(key: int, table: pa.Table, fs: pafs.FileSystem, root: str) -> list[tuple]:
        column = lambda t, c: t.column(c).to_numpy()
        kind = column(table, "_kind")
        rows, marks, listing = (table.filter(pa.array(kind == k)) for k in range(3))
        if not rows.num_rows:
            return []
        place, a, b, h = (column(rows, c) for c in ("_p", "a", "b", "_h"))
        files = place >> _LINE_BITS
        records = pd.Series(files).value_counts()
        listed = column(listing, "_p") >> _LINE_BITS
        sizes = np.where(listing["_n"].is_null().to_numpy(), records.reindex(listed).fillna(0) * RECORD_BYTES, listing["_n"].fill_null(0).to_numpy())
        sizes = pd.Series(sizes.astype(np.int64), index=listed).clip(lower=0).groupby(level=0).max()
        unlisted = records.index.difference(sizes.index)
        sizes = pd.concat([sizes, records[unlisted] * RECORD_BYTES]).sort_index()
        first, parts = _scheduled(sizes.to_numpy(np.int64), target_bytes)
        at = np.searchsorted(sizes.index.to_numpy(), files)
        group = first[at]
        if (parts > 1).any():  # a file larger than the target is cut by lines
            order = np.argsort(place, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order)) - np.searchsorted(files[order], files[order])
            group = group + rank * parts[at] // records.reindex(files).to_numpy()
        left = np.zeros(len(place), bool)
        if marks.num_rows:
            near = np.flatnonzero(np.isin(a, column(marks, "a")))
            keys = {c: column(marks, c) for c in ("_p", "a", "b")}
            met = pd.DataFrame({"_p": place[near], "a": a[near], "b": b[near]}).merge(pd.DataFrame(keys | {"n": column(marks, "_n")}), "left", ["_p", "a", "b"])
            left[near] = met.groupby(["_p", "a", "b"]).cumcount().to_numpy() < met["n"].fillna(0).to_numpy()
            if left.sum() != column(marks, "_n").sum():
                raise RuntimeError("a record to be left out is not there")
        order = np.lexsort((place, group, left))
        n_kept = len(order) - int(left.sum())
        sorted_rows = rows.select(schema.names).take(pa.array(order)).cast(schema)
        group, h = group[order], h[order]
        left_file = f"left_out-{key}-{uuid.uuid4().hex}.parquet"
        if n_kept < len(order):
            pq.write_table(sorted_rows.slice(n_kept), f"{root}/{left_file}", filesystem=fs, compression="zstd")
        done = []
        for g in np.unique(group).tolist():
            lo, hi = np.searchsorted(group[:n_kept], [g, g + 1]).tolist()
            from_, to = (n_kept + np.searchsorted(group[n_kept:], [g, g + 1])).tolist()
            name = f"data-{(key << 32) + g}-{uuid.uuid4().hex}.parquet"
            if lo < hi:
                pq.write_table(sorted_rows.slice(lo, hi - lo), f"{root}/{name}", filesystem=fs, compression="zstd")
            with np.errstate(over="ignore"):
                done.append(((key << 32) + g, name, left_file, hi - lo, int(h[lo:hi].sum()), to - from_, int(h[from_:to].sum())))
        return done

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        open_block, held = None, []
        for batch in itertools.chain(batches, [None]):
            keys = batch.column("_block").to_numpy() if batch is not None else np.array([-1])
            edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for lo, hi in zip(edges, edges[1:]):
                if lo < hi and keys[lo] != open_block:
                    if held:
                        done = block(int(open_block), pa.Table.from_batches(held), fs, root)
                        yield pa.RecordBatch.from_pydict({k: [d[i] for d in done] for i, k in enumerate(_STATS.names)}, schema=_STATS)
                    open_block, held = keys[lo], []
                if batch is not None and lo < hi:
                    held.append(batch.slice(lo, hi - lo))

    return run


def _reader(folder: str, schema: pa.Schema, named: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The rows of the files in column ``name``; ``named``: with the name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                with pq.ParquetFile(f"{root}/{name}", filesystem=fs) as f:
                    for rows in f.iter_batches(columns=schema.names):
                        rows = rows.select(schema.names).cast(schema)
                        yield rows.append_column("_name", pa.array([name] * rows.num_rows, pa.string())) if named else rows

    return run


def _read(spark: SparkSession, folder: str, schema: T.StructType, files: dict[str, int], named: bool = False) -> DataFrame:
    """The rows of ``files`` (name and rows), of which each task opens about ``READ_ROWS``; Spark lists no file for it."""
    sc = spark.sparkContext
    tasks, open_rows = [], READ_ROWS
    for name, n in files.items():
        if open_rows >= READ_ROWS:
            tasks.append([])
            open_rows = 0
        tasks[-1].append((name,))
        open_rows += n
    to = T.StructType([*schema.fields, T.StructField("_name", T.StringType())]) if named else schema
    if not tasks:
        return spark.createDataFrame([], to)
    names = spark.createDataFrame(sc.parallelize(tasks, len(tasks)).flatMap(lambda x: x), "name string")
    return names.mapInArrow(_reader(folder, to_arrow_schema(schema), named), to)


def _rows(written: list[dict], kind: str) -> dict[str, int]:
    n = "n_kept" if kind == "data" else "n_left"
    rows: dict[str, int] = {}
    for w in written:
        if w[n]:
            rows[w[f"{kind}_file"]] = rows.get(w[f"{kind}_file"], 0) + w[n]
    return rows


def _sums(row_hash: Column) -> list[Column]:
    """Rows and the sum of their hashes, by halves that can't overflow."""
    return [F.count("*").alias("n"), F.sum(F.shiftright(row_hash, 32)).alias("high"), F.sum(row_hash.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low")]


def _writer(folder: str, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes rows sorted by group; a mark stands right before the record that it keeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        open_group, out, marked = None, {}, False
        done: list[tuple] = []
        totals = np.zeros((2, 2), np.int64)  # rows and sums of row hashes, kept and left out

        def close() -> None:
            if open_group is not None:
                for w, _ in out.values():
                    if w:
                        w.close()
                done.append((open_group, out["data"][1], out["left_out"][1], *totals.ravel().tolist()))

        for batch in batches:
            if not batch.num_rows:
                continue
            mark = batch.column("_mark").to_numpy(zero_copy_only=False)
            keep = np.concatenate(([marked], mark[:-1])) & ~mark
            marked = bool(mark[-1])
            group, hashes = batch.column("_group").to_numpy(), batch.column("_h").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
            rows = pa.Table.from_batches([batch]).select(schema.names).cast(schema)
            for lo, hi in zip(edges, edges[1:]):
                if group[lo] != open_group:
                    close()
                    open_group = int(group[lo])
                    totals[:] = 0
                    out = {}
                    for kind in ("data", "left_out"):
                        out[kind] = (None, f"{kind}-{open_group}-{uuid.uuid4().hex}.parquet")
                for i, (kind, which) in enumerate((("data", keep[lo:hi]), ("left_out", ~keep[lo:hi] & ~mark[lo:hi]))):
                    if which.any():
                        w, name = out[kind]
                        w = w or pq.ParquetWriter(f"{root}/{name}", schema, filesystem=fs, compression="zstd")
                        out[kind] = (w, name)
                        w.write_table(rows.slice(lo, hi - lo).filter(pa.array(which)))
                        with np.errstate(over="ignore"):
                            totals[i] += (which.sum(), hashes[lo:hi][which].astype(np.int64).sum())
        close()
        yield pa.RecordBatch.from_pydict({k: [d[i] for d in done] for i, k in enumerate(_STATS.names)}, schema=_STATS)

    return run


_STATS = pa.schema([("group_id", pa.int64()), ("data_file", pa.string()), ("left_out_file", pa.string()), ("n_kept", pa.int64()), ("h_kept", pa.int64()), ("n_left", pa.int64()), ("h_left", pa.int64())])


def compact(records: DataFrame, files: DataFrame, identity: dict[str, Column], folder: str, target_bytes: int = TARGET_BYTES) -> dict:
    """Write ``records`` into few files below ``folder`` and publish their manifest, which is returned.

    ``records`` need ``file_id`` and ``line_no``, which may be null or repeated; a file that isn't listed counts
    ``RECORD_BYTES`` per record. The manifest is published only if the files, read back, hold every record read once,
    whole and unchanged. Empty input gives an empty manifest. The records are read five times at most, their rows are
    shuffled once (twice where blocks are large and the listing too large to broadcast). ``folder`` belongs to the caller,
    who removes it.
    """
    spark = records.sparkSession
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    row_hash = F.xxhash64(*records.columns)
    blocks = max(1, -(-files.count() // BLOCK_FILES))
    ends = [f(c).alias(f"{c}_{f.__name__}") for f in (F.min, F.max) for c in ("file_id", "line_no")]
    seen = [r.asDict() for r in records.groupBy(_block(_file(), blocks)).agg(*_sums(row_hash), *ends).collect()]  # a row per block
    listed = files.agg(F.min("file_id"), F.max("file_id")).first()
    reach = {c: [x for r in seen for x in (r[f"{c}_min"], r[f"{c}_max"]) if x is not None] for c in ("file_id", "line_no")}
    reach["file_id"] += [x for x in listed if x is not None]
    fits = all(0 <= x < (1 << bits) - 1 for c, bits in (("file_id", _FILE_BITS), ("line_no", _LINE_BITS)) for x in reach[c])
    if fits and all(r["n"] <= BLOCK_RECORDS for r in seen):
        stats = _by_block(records, files, identity, folder, target_bytes, blocks)
    else:
        stats = _by_group(records, files, identity, folder, target_bytes)
    written = sorted((r.asDict() for r in stats.collect()), key=lambda w: w["group_id"])  # a row per output file
    fs.delete_dir_contents(f"{root}/work", missing_dir_ok=True)
    back = _read(spark, folder, records.schema, _rows(written, "data") | _rows(written, "left_out"), named=True)
    found = {r["_name"]: (r["n"], (r["high"] << 32) + r["low"]) for r in back.groupBy("_name").agg(*_sums(row_hash)).collect()}
    read = sum(r["n"] for r in seen)
    verify(written, found, read)
    if (sum((r["high"] << 32) + r["low"] for r in seen) - sum(h for _, h in found.values())) % (1 << 64):
        raise RuntimeError("other records were written than read: nothing is published")
    manifest = {"folder": folder, "records": read, "kept": sum(w["n_kept"] for w in written), "files": written}
    name = f"manifest-{uuid.uuid4().hex}.json"
    for path, text in ((name, json.dumps(manifest)), ("current.tmp", name)):
        with fs.open_output_stream(f"{root}/{path}") as f:
            f.write(text.encode())
    fs.move(f"{root}/current.tmp", f"{root}/current")
    return manifest


_STATS_DDL = "group_id long, data_file string, left_out_file string, n_kept long, h_kept long, n_left long, h_left long"


def _by_block(records: DataFrame, files: DataFrame, identity: dict[str, Column], folder: str, target_bytes: int, blocks: int) -> DataFrame:
    """A row per output file, by tasks that take whole blocks. Digests and hashes are taken behind the shuffle, so that only the records travel.

    Many blocks are taken in two rounds, and the shuffle files of the first are given back before the second.
    """
    file_bit, line_bit = (1 << _FILE_BITS) - 1, (1 << _LINE_BITS) - 1
    schema = records.schema

    def other(df: DataFrame, kind: int, n: Column, a: Column, b: Column, **at: Column) -> DataFrame:
        known = [at[f.name].cast(f.dataType).alias(f.name) if f.name in at else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
        return df.select(*known, F.struct(F.lit(kind).alias("kind"), n.cast("long").alias("n"), a.cast("long").alias("a"), b.cast("long").alias("b")).alias("_x"))

    none = F.lit(None)
    file, line = F.shiftright("_p", _LINE_BITS), F.col("_p").bitwiseAND(F.lit(line_bit))
    marks = other(stored(later_copies(records, identity, f"{folder}/work"), f"{folder}/work/marks"), 1, F.col("n"), F.col("a"), F.col("b"), file_id=F.when(file != file_bit, file), line_no=F.when(line != line_bit, line))
    listing = other(files, 2, F.col("n_bytes"), none, none, file_id=F.col("file_id"))
    rows = records.withColumn("_x", F.lit(None).cast(listing.schema["_x"].dataType))
    block = _block(_file(), blocks)
    kind = F.coalesce("_x.kind", F.lit(0))
    rounds = 2 if blocks >= HALVED_BLOCKS else 1

    def turn(i: int) -> DataFrame:
        own = [df.filter(F.pmod(block, F.lit(rounds)) == i) if rounds > 1 else df for df in (rows, marks, listing)]
        placed = reduce(DataFrame.unionByName, own).repartition(block).withColumn("_block", block).sortWithinPartitions("_block")
        keyed, _ = _keyed(placed, identity)
        full = keyed.select(*records.columns, _place().alias("_p"), *[F.when(kind == 0, F.col(f"_d.{c}")).otherwise(F.col(f"_x.{c}")).alias(c) for c in "ab"], F.col("_x.n").alias("_n"), F.xxhash64(*records.columns).alias("_h"), kind.alias("_kind"), "_block")
        return stored(full.mapInArrow(_block_writer(folder, to_arrow_schema(records.schema), target_bytes), _STATS_DDL), f"{folder}/work/stats-{i}")

    return reduce(DataFrame.unionByName, [turn(i) for i in range(rounds)])


def _by_group(records: DataFrame, files: DataFrame, identity: dict[str, Column], folder: str, target_bytes: int) -> DataFrame:
    """A row per output file, by tasks that stream groups."""
    counted = records.groupBy(_file().alias("file_id")).agg(F.count("*").alias("_n"))
    sized = files.select(_file().alias("file_id"), "n_bytes", "n_records").join(counted, "file_id", "full").select("file_id", F.coalesce("n_bytes", F.col("_n") * RECORD_BYTES).alias("n_bytes"), F.coalesce("_n", "n_records").alias("n_records"))
    groups = checkpointed(assign_groups(sized, target_bytes).select(F.col("file_id").alias("_file"), "group_id", "n_parts"))
    keyed, _ = _keyed(records, identity)
    rows = keyed.select(*records.columns, "_d", "_at", _file().alias("_file"), F.xxhash64(*records.columns).alias("_h"), F.lit(False).alias("_mark"))
    marks = first_copies(records, identity).select(*[F.lit(None).cast(records.schema[c].dataType).alias(c) for c in records.columns], "_d", "_at", "_file", F.lit(0).cast("long").alias("_h"), F.lit(True).alias("_mark"))
    both = lookup(rows.unionByName(marks), groups, ["_file"], F.col("_d"))
    # A file larger than the target is spread over its groups by record, so that a mark goes where its record goes.
    part = F.pmod(F.xxhash64("_d", "_at"), F.col("n_parts"))
    placed = both.select(*records.columns, "_d", "_at", "_h", "_mark", (F.col("group_id") + part).alias("_group"))
    order = ["_group", "_at", "_d", F.col("_mark").desc()]
    return placed.repartition("_group").sortWithinPartitions(*order).drop("_d", "_at").mapInArrow(_writer(folder, to_arrow_schema(records.schema)), _STATS_DDL)


def verify(written: list[dict], found: dict[str, tuple[int, int]], read: int) -> None:
    """Raises RuntimeError unless the files hold what went into them, each group was written once and no record is missing.

    ``found``: rows and sum of row hashes by file, as read back; a file without rows may be absent. Groups may share a file of what was left out.
    """
    went: dict[str, tuple[int, int]] = {}
    for w in written:
        for name, n, h in ((w["data_file"], w["n_kept"], w["h_kept"]), (w["left_out_file"], w["n_left"], w["h_left"])):
            before = went.get(name, (0, 0))
            went[name] = (before[0] + n, before[1] + h)
    for name, (n, h) in went.items():
        have = found.get(name, (0, 0))
        if have[0] != n or (have[1] - h) % (1 << 64):
            raise RuntimeError(f"{name} holds other records than were written: nothing is published")
    total = sum(w["n_kept"] + w["n_left"] for w in written)
    if total != read or len({w["group_id"] for w in written}) != len(written):
        raise RuntimeError(f"{read} records read, {total} written: nothing is published")


def read_published(spark: SparkSession, folder: str, schema: T.StructType, left_out: bool = False) -> DataFrame:
    """The records of the published manifest, or those that it left out; ``schema`` may have fewer columns than were written."""
    fs, root = pafs.FileSystem.from_uri(folder)
    text = ""
    for path in ("current", ""):
        with fs.open_input_stream(f"{root}/{path or text}") as f:
            text = f.read().decode()
    return _read(spark, folder, schema, _rows(json.loads(text)["files"], "left_out" if left_out else "data"))
