"""Core operators: against SQL on the small tables, against brute force, and on nulls, ties and empty input."""

import glob
import json
import os
import random
from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from segscan.operators import cohort as stats
from segscan.operators import segments
from segscan.operators.changepoints import breakpoints, probe_segments
from segscan.operators.compaction import assign_groups, balance, first_copies
from segscan.operators.packed import split_values, unpack
from segscan.operators.references import find_orphans, orphan_report
from segscan.plans import cohort, evaluation, figures, nomination, preparation, probes, reports
from segscan.sources.raw_segments import ingest, replay, schema_changes, segments_of, unreadable

PLANS = (preparation, cohort, nomination, evaluation, probes, figures, reports)
QUERIES = {k: q for p in PLANS for k, q in p.QUERIES.items()}
ORACLE = {k: q for p in PLANS for k, q in p.ORACLE.items()}


def _plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, small, name):
    import duckdb

    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = sorted(repr([_plain(r[c]) for c in columns]) for r in df.collect())
    if name not in ORACLE:
        return
    db = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    r = db.execute(ORACLE[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == columns
    assert got == sorted(repr([_plain(row[names.index(c)]) for c in columns]) for row in r.fetchall())


def test_packed_values():
    got = split_values(pa.array(["chr1, 2;X", None, "", "NA", '"a, ""b""",Chr3', "[1|2]", "c(4, 4)", "1 and 2", "n/a"])).to_pylist()
    assert got == [["1", "2", "X"], [], [], [], ['a, "b"', "3"], ["1", "2"], ["4", "4"], ["1", "2"], []]


def test_unpack_edges(spark):
    df = spark.createDataFrame([(1, "1,2"), (1, "1,2"), (2, None)], "k long, v string")
    assert sorted((r.k, r.pos, r.value) for r in unpack(df, "v").collect()) == [(1, 1, "1"), (1, 1, "1"), (1, 2, "2"), (1, 2, "2")]
    assert unpack(df.limit(0), "v").count() == 0
    with pytest.raises(ValueError):
        unpack(df.withColumn("pos", F.lit(1)), "v")


@pytest.mark.parametrize("hot", [0, 2, 10_000])
def test_orphans(spark, hot):
    day = lambda n: datetime(2024, 1, n)
    refs = [("t", i, "m", k, at) for i, (k, at) in enumerate([("A", day(5)), ("A", day(9)), ("B", day(5)), ("C", day(5)), (None, day(5)), ("A", None), ("A", day(5)), ("D", day(5))])]
    goals = [("m", "A", day(1), day(9)), ("m", "C", day(6), None), ("m", "D", day(5), None), ("m", "D", None, None)]
    out = find_orphans(spark.createDataFrame(refs, "src_table string, row_id long, target string, key string, at timestamp"), spark.createDataFrame(goals, "target string, key string, since timestamp, until timestamp"), hot)
    assert {(r.row_id, r.problem) for r in out.collect()} == {(1, "deleted"), (2, "missing"), (3, "late"), (5, "late")}
    assert sum(r.n_rows for r in orphan_report(out).collect()) == 4


@pytest.mark.parametrize("hot", [3, 40, 10_000])
def test_orphans_of_keys_hot_on_both_sides(spark, hot):
    rng = random.Random(11)
    moment = lambda: datetime(2024, 1, rng.randint(1, 4), rng.randint(0, 1))
    refs = [("t", i, "m", rng.choice("AAAAB"), moment() if rng.random() > 0.05 else None) for i in range(300)] + [("t", 900, "m", "none", moment())]
    goals = [("m", rng.choice("AAAB"), moment(), None) for _ in range(2)] + [("m", "A", at := moment(), datetime(2024, 1, min(5, at.day + 1))) for _ in range(150)] + [("m", "B", datetime(2024, 1, 3), datetime(2024, 1, 4))] * 30
    out = find_orphans(spark.createDataFrame(refs, "src_table string, row_id long, target string, key string, at timestamp"), spark.createDataFrame(goals, "target string, key string, since timestamp, until timestamp"), hot)
    want = set()
    for _, i, _, k, at in refs:
        mine = [(a, b) for _, x, a, b in goals if x == k]
        if at is None or not any(a <= at and (b is None or b > at) for a, b in mine):
            want.add((i, "missing" if not mine else "late" if at is None or all(a > at for a, _ in mine) else "deleted"))
    got = out.collect()
    assert {(r.row_id, r.problem) for r in got} == want and len(got) == len(want) > 10


def test_groups_are_balanced(spark):
    rng = random.Random(2)
    sizes = [rng.randint(1, 1000) for _ in range(500)]
    loads = np.bincount(balance(sizes, 7), weights=sizes)
    assert loads.max() - loads.min() <= 1000
    files = spark.createDataFrame([(1, 10, 1), (1, 10, 1), (2, None, None), (3, 250, 4), (4, -5, 0)], "file_id long, n_bytes long, n_records int")
    got = {r.file_id: r.n_parts for r in assign_groups(files, target_bytes=100).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1}
    assert assign_groups(files.limit(0)).count() == 0


RECORDS = [(1, 1, "a", 1.0, 5), (1, 2, "a", 1.0, 5), (2, 1, "a", 1.0, None), (2, 2, "a", 2.0, None), (3, 1, "b", None, 1), (3, 2, None, None, None)]
IDENTITY = {"s": F.col, "p": F.col, "n": F.col}


def _identity():
    return {k: f(k) for k, f in IDENTITY.items()}


@pytest.mark.parametrize("most", [0, 1000])
def test_first_copies(spark, monkeypatch, most):
    from segscan.operators import compaction

    monkeypatch.setattr(compaction, "BROADCAST_ROWS", most)
    df = spark.createDataFrame(RECORDS, "file_id long, line_no int, s string, p double, n int")
    kept = first_copies(df, _identity())
    assert {(int(r["_at"]) // 10**10, int(r["_at"]) % 10**10) for r in kept.collect()} == {(1, 1), (2, 2), (3, 1)}


def test_nulls_are_not_values_of_the_next_field(spark):
    # One digest for both would need equal fields: 3 then nothing, or nothing then 3.
    df = spark.createDataFrame([(1, 1, 3, None, 1), (1, 2, None, 3, 1), (1, 3, 3, None, None), (1, 4, None, 4, None)], "file_id long, line_no int, s int, p int, n int")
    assert sorted(int(r["_at"]) % 10**10 for r in first_copies(df, _identity()).collect()) == [1, 2, 4]


def test_compact_in_several_groups(spark, tmp_path):
    from segscan.operators.compaction import compact, read_published

    rng = random.Random(8)
    rows = [(rng.randint(1, 40), i, rng.choice("abcdefgh"), float(rng.randint(1, 9)), rng.choice([1, 2, 3, None])) for i in range(600)]
    rows += [(None, 7, "z", 1.0, 1), (None, 8, "z", 1.0, 1), (5, None, "y", 1.0, 1), (6, 1, "x", 1.0, 1), (6, 1, "x", 1.0, 1), (6, 1, "w", 1.0, 1), (99, 1, "u", 1.0, 1)]
    df = spark.createDataFrame(rows, "file_id long, line_no int, s string, p double, n int")
    files = spark.createDataFrame([(i, 40 * i, 3) for i in range(1, 42)], "file_id long, n_bytes long, n_records int")
    manifest = compact(df, files, _identity(), str(tmp_path / "a"), target_bytes=1000)
    assert len(manifest["files"]) > 8 and manifest["records"] == len(rows)
    kept = [tuple(r) for r in read_published(spark, str(tmp_path / "a"), df.schema).collect()]
    left = [tuple(r) for r in read_published(spark, str(tmp_path / "a"), df.schema, True).collect()]
    assert sorted(map(repr, kept + left)) == sorted(map(repr, rows))
    last = lambda r: (r[0] is None, r[0], r[1] is None, r[1])
    want, full = {}, {r[2:] for r in rows if r[4] is not None}
    for r in sorted(rows, key=last):
        if r[4] is not None or not any(x[:2] == r[2:4] for x in full):
            want.setdefault(r[2:], r)
    assert sorted(map(repr, kept)) == sorted(map(repr, want.values()))
    assert compact(df.limit(0), files, _identity(), str(tmp_path / "b"))["files"] == []
    assert read_published(spark, str(tmp_path / "b"), df.schema).count() == 0


@pytest.mark.parametrize("settings", [{}, {"BLOCK_FILES": 2, "BROADCAST_KEYS": 3}, {"BLOCK_FILES": 2, "HALVED_BLOCKS": 99}, {"BLOCK_RECORDS": 0}])
def test_compact_by_block_and_by_group(spark, tmp_path, monkeypatch, settings):
    from segscan.operators import compaction

    for k, v in settings.items():
        monkeypatch.setattr(compaction, k, v)
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(1, 60)]), rng.choice([None, 1, 2, 3]), rng.choice("abcdef"), rng.choice([None, 1.0, 2.0]), rng.choice([1, 2, None])) for _ in range(900)]
    rows += [(7, i, "same", 1.0, 1) for i in range(200)] + [(9, 1, "same", 1.0, 1)] * 50 + [(8, 1, "same", None, None), (8, 2, None, None, None), (70, 1, "alone", 3.0, None), (71, 1, None, 8.0, 8)]
    df = spark.createDataFrame(rows, "file_id long, line_no int, s string, p double, n int")
    files = spark.createDataFrame([(i, None if i % 9 == 0 else 70 * i, 3) for i in range(1, 52)] + [(7, 5000, 1), (8, -4, 1), (None, 10, 1), (200, 10, 1)], "file_id long, n_bytes long, n_records int")
    manifest = compaction.compact(df, files, _identity(), str(tmp_path), target_bytes=900)
    assert manifest["records"] == len(rows) and len(manifest["files"]) > 30
    kept, left = ([tuple(r) for r in compaction.read_published(spark, str(tmp_path), df.schema, x).collect()] for x in (False, True))
    full = [r[2:] for r in rows if r[4] is not None]
    want = {}
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0)):
        if r[4] is not None or not any(all(x is None or x == y for x, y in zip(r[2:], f)) for f in full):
            want.setdefault(r[2:], r)
    assert sorted(map(repr, kept)) == sorted(map(repr, want.values()))
    assert sorted(map(repr, kept + left)) == sorted(map(repr, rows))
    few = compaction.read_published(spark, str(tmp_path), df.select("p", "file_id").schema, True).collect()
    assert sorted(map(repr, few)) == sorted(repr(r) for r in spark.createDataFrame([(x[3], x[0]) for x in left], "p double, file_id long").collect())


def test_ids_that_are_no_short_numbers_are_compacted_by_group(spark, tmp_path):
    from segscan.operators.compaction import compact

    rows = [(-3, 1, "a", 1.0, 1), (1 << 60, 2, "a", 1.0, 1), (5, 1 << 25, "b", 1.0, 1), (5, 1, "b", 1.0, 1), (0, 0, "c", 1.0, 1)]
    df = spark.createDataFrame(rows, "file_id long, line_no int, s string, p double, n int")
    assert compact(df, spark.createDataFrame([(5, 1, 1)], "file_id long, n_bytes long, n_records int"), _identity(), str(tmp_path))["kept"] == 3


def test_tasks_do_not_grow_with_output_files(spark, tmp_path):
    from segscan.operators.compaction import compact, read_published

    n = 400
    df = spark.createDataFrame([(i, 1, f"s{i // 2}", 1.0, 1) for i in range(n)], "file_id long, line_no int, s string, p double, n int")
    files = spark.createDataFrame([(i, 100, 1) for i in range(n)], "file_id long, n_bytes long, n_records int")
    spark.sparkContext.setJobGroup("compact", "compact")
    try:
        assert len(compact(df, files, _identity(), str(tmp_path), target_bytes=100)["files"]) == n
        assert [read_published(spark, str(tmp_path), df.schema, x).count() for x in (False, True)] == [n // 2, n // 2]
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    status = spark.sparkContext.statusTracker()
    stages = [status.getStageInfo(k) for j in status.getJobIdsForGroup("compact") for k in status.getJobInfo(j).stageIds]
    assert max(x.numTasks for x in stages if x) < 50  # no task for each file; the driver lists none of them
    assert len(list(tmp_path.glob("left_out-*.parquet"))) == 1


def test_nothing_is_published_that_does_not_agree():
    from segscan.operators.compaction import verify

    w = {"group_id": 1, "data_file": "d", "left_out_file": "l", "n_kept": 2, "h_kept": -5, "n_left": 0, "h_left": 0}
    verify([w], {"d": (2, (1 << 64) - 5)}, 2)
    for written, found, read in (([w], {"d": (2, 6)}, 2), ([w], {"d": (1, -5)}, 2), ([w], {}, 2), ([w], {"d": (2, -5)}, 3), ([w, w], {"d": (2, -5)}, 4)):
        with pytest.raises(RuntimeError):
            verify(written, found, read)


def _longest(states, k):
    a = [x for i, x in enumerate(states) if i == 0 or x != states[i - 1]]
    return max((j - i for i in range(len(a)) for j in range(i + 1, len(a) + 1) if len(set(a[i:j])) <= k), default=0)


def test_longest_run(spark):
    rng = random.Random(4)
    arrays = [[], [1], [1, 1, 1], [1, 2, 1, 2, 1], [1, 2, 3, 4, 5]] + [[rng.randint(0, 4) for _ in range(rng.randint(0, 30))] for _ in range(200)]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "i int, a array<int>")
    for k in (2, 3):
        got = {r[0]: r[1] for r in df.select("i", segments.longest_run(F.col("a"), k)).collect()}
        assert got == {i: _longest(a, k) for i, a in enumerate(arrays)}


def test_merge_screen_micro(spark):
    for tcn, n, base in (([2, 1, 2, 1, 2, 1], 4, 1), ([1, 2, 1, 2, 1], 3, 1)):
        rows = [("f", "1", float(i), i + 0.5, float(t), float(i % 2)) for i, t in enumerate(tcn)]
        r = segments.merge_screen(spark.createDataFrame(rows, "facets_id string, chrom string, loc_start double, loc_end double, tcn double, lcn double")).first()
        assert (r.n_oscil, r.basecn) == (n, base)


def test_merge_screen_counts_segments_below_the_base(spark):
    # By hand: 3 stands twice, 1 once, so 3 is the base and 1 lies below it. Steps up to a base segment from none: 4 to 3, 4 to 1.
    rows = [("f", "1", 10.0 * i, 10.0 * i + 4, t, 1.0) for i, t in enumerate([3.0, 4.0, 3.0, 5.0, 1.0, 6.0])]
    # Only 2 stands twice: the segment without a copy number leaves the length unknown, and is counted with the base segments.
    rows += [("f", "2", 10.0 * i, 10.0 * i + 4, t, 1.0) for i, t in enumerate([2.0, 4.0, 2.0, None, 2.0])]
    # Nothing stands twice: no base, one oscillation, all segments counted.
    rows += [("f", "3", 10.0 * i, 10.0 * i + 4, float(i), 1.0) for i in range(5)]
    df = spark.createDataFrame(rows, "facets_id string, chrom string, loc_start double, loc_end double, tcn double, lcn double")
    got = {r.chrom: (r.basecn, r.n_oscil, r.n_seg_basecn, r.length_seg_basecn, r.length_seg_total) for r in segments.merge_screen(df).collect()}
    assert got == {"1": (3.0, 3, 3, 12.0, 24.0), "2": (2.0, 3, 4, None, 20.0), "3": (None, 1, 5, None, 20.0)}


def test_lookup_beyond_the_broadcast(spark):
    from segscan.operators.joins import lookup

    rows = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1), (None, 2)], "k string, i int")
    keyed = spark.createDataFrame([("a", 1), ("c", 2), (None, 3)], "k string, v int")
    for most in (0, 10):
        got = lookup(rows, keyed, ["k"], F.col("i"), most=most).collect()
        assert len(got) == 52 and sum(r.v == 1 for r in got) == 50 and sum(r.v is None for r in got) == 2
        assert lookup(rows, keyed, ["k"], F.col("i"), "left_anti", most).count() == 2


def test_running_totals_in_ranges(spark):
    from pyspark.sql import Window

    from segscan.operators.running import cumulate

    rng = random.Random(3)
    df = spark.createDataFrame([(rng.choice(["a", "a", "b", None]), i, rng.randint(-9, 9) if i % 7 else None) for i in range(500)], "g string, o int, v int")
    for adaptive in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        for by in ([], ["g"]):
            got = {r.o: (r.s, r.m, r.c) for r in cumulate(df, by, -F.col("o"), s=("sum", "v"), m=("min", "v"), c=("count", "v")).collect()}
            w = Window.partitionBy(*(by or [F.lit(1)])).orderBy(F.col("o").desc())
            assert got == {r.o: (r.s, r.m, r.c) for r in df.select("o", F.sum("v").over(w).alias("s"), F.min("v").over(w).alias("m"), F.count("v").over(w).alias("c")).collect()}
    spark.conf.unset("spark.sql.adaptive.enabled")
    assert cumulate(df.limit(0), [], F.col("o"), s=("sum", "v")).count() == 0


def test_survival_and_step_up(spark):
    km = stats.kaplan_meier(spark.createDataFrame([(1, 1, "g"), (2, 1, "g"), (2, 0, "g"), (3, 1, "g"), (None, 1, "g")], "t int, e int, g string"), "t", "e", "g")
    assert [round(r.survival, 6) for r in km.orderBy("time").collect()] == [0.75, 0.5, 0.0]
    q = stats.step_up(spark.createDataFrame([(0.01,), (0.04,), (0.03,), (0.5,), (None,)], "p double"), "p")
    assert {r.p: r.q and round(r.q, 6) for r in q.collect()} == {0.01: 0.04, 0.03: 0.053333, 0.04: 0.053333, 0.5: 0.5, None: None}


def test_breakpoints_are_optimal(spark):
    rng = np.random.default_rng(6)
    for _ in range(30):
        x = np.repeat(rng.integers(0, 3, 5), rng.integers(3, 9, 5)) + rng.normal(0, 0.3, 5 * 0 + 1)
        n, pen = len(x), 0.5
        cost = [-pen] + [np.inf] * n
        for b in range(5, n + 1):
            cost[b] = min(cost[a] + ((x[a:b] - x[a:b].mean()) ** 2).sum() + pen for a in range(b - 4) if cost[a] < np.inf)
        ends = breakpoints(x, pen)
        assert n < 10 or abs(sum(((x[a:b] - x[a:b].mean()) ** 2).sum() + pen for a, b in zip([0, *ends], ends)) - pen - cost[n]) < 1e-6
    df = spark.createDataFrame([("k", float(i), 0.0 if i < 5 else 1.0) for i in range(10)] + [("k", None, 1.0), ("k", 3.0, float("nan"))], "k string, p double, x double")
    assert [(r.seg, r.n_probes, r.level) for r in probe_segments(df, ["k"], "p", "x").orderBy("seg").collect()] == [(0, 5, 0.0), (1, 5, 1.0)]
    assert probe_segments(df.limit(0), ["k"], "p", "x").count() == 0


def test_labels_off_the_screen_are_missed(spark, tmp_path):
    at = datetime(2024, 1, 1)
    rows = [("f", "f", c, 10 * i, 10 * i + 9, 5, 0.0, 2.0 - i % 2, 1.0, at, i) for c, n in (("1", 8), ("2", 3), ("3", 2)) for i in range(n)]
    spark.createDataFrame(rows, "sample_id string, facets_id string, chrom string, loc_start int, loc_end int, num_mark int, cnlr_median double, tcn double, lcn double, loaded_at timestamp, row_id long").write.parquet(f"{tmp_path}/cncf.parquet")
    spark.createDataFrame([("f", "1, chr2, 9"), ("g", "4"), (None, "1")], "facets_id string, chr_ctx string").write.parquet(f"{tmp_path}/ctx_details.parquet")
    assert cohort.screen_against_all_labels(spark, str(tmp_path)).collect() == [(1, 0, 3, 1)]


def test_one_group_of_any_length(spark):
    n = 2_000_001
    df = spark.range(n).selectExpr("'k' AS k", "double(id) AS p", f"IF(id < {n // 2}, 0D, 1D) AS x")
    assert [(r.seg, r.n_probes, r.level) for r in probe_segments(df, ["k"], "p", "x").orderBy("seg").collect()] == [(0, n // 2, 0.0), (1, n - n // 2, 1.0)]


@pytest.mark.parametrize("step", [0.0, 1.0])
def test_levels_drop_no_boundary(step):
    rng = np.random.default_rng(7)
    x = rng.normal(0, 0.3, 600) + step * (np.arange(600) >= 300)
    cost = [-1.5] + [np.inf] * 600
    for b in range(5, 601):
        cost[b] = min(cost[a] + x[a:b].var() * (b - a) + 1.5 for a in range(b - 4))
    ends = breakpoints(x, 1.5)
    assert abs(sum(x[a:b].var() * (b - a) + 1.5 for a, b in zip([0, *ends], ends)) - 1.5 - cost[600]) < 1e-6


def test_breakpoints_of_many_signals():
    rng = np.random.default_rng(12)
    for _ in range(5000):
        n = int(rng.integers(6, 45))
        x = np.round(rng.normal(0, 1, n).cumsum() * rng.choice([0.2, 1.0]), 3)
        pen, least = float(rng.choice([0.2, 1.0, 4.0])), int(rng.choice([2, 3, 5]))
        s1, s2 = np.concatenate(([0.0], x.cumsum())), np.concatenate(([0.0], (x * x).cumsum()))
        cost = np.full(n + 1, np.inf)
        cost[0] = -pen
        for b in range(least, n + 1):
            a = np.arange(b - least + 1)
            cost[b] = (cost[a] + s2[b] - s2[a] - (s1[b] - s1[a]) ** 2 / (b - a) + pen).min()
        ends = breakpoints(x, pen, least)
        if n >= 2 * least:
            got = sum(s2[b] - s2[a] - (s1[b] - s1[a]) ** 2 / (b - a) + pen for a, b in zip([0, *ends], ends)) - pen
            assert abs(got - cost[n]) < 1e-6 and min(np.diff([0, *ends])) >= least


@pytest.mark.parametrize("end", ["\r", "\n", "\r\n"])
@pytest.mark.parametrize("sep", ["\t", ";"])
def test_header_after_a_comment(spark, sep, end):
    text = end.join(["# a\tb;c", "", "  # d", f"id{sep}chrom", f"s{sep}1", ""])
    files = _files(spark, [("f", 1, 1, text), ("f", 2, 2, end.join(["# only", ""])), ("f", 3, 3, None)])
    got = ingest(files)
    assert [(r.file_id, r.line_no, r.facets_id, r.chrom) for r in segments_of(got).collect()] == [(1, 1, "s", "1")]
    assert [[f.field for f in r.fields] for r in got.filter("fields IS NOT NULL").collect()] == [["id", "chrom"]]
    assert sorted(r.file_id for r in unreadable(got).collect()) == [2, 3]


def _files(spark, rows):
    return spark.createDataFrame([(f, s, i, datetime(2024, 1, 1), t, "x") for f, s, i, t in rows], "feed_code string, seq_no int, file_id long, delivered_at timestamp, content string, rescued string")


def test_surplus_cells_and_repeated_names_are_rescued(spark):
    text = "id\tchrom\ttcn.em\ttcn\tnote\tnote\nr\t1\tbad\t3\ta\tb\tc\t\td\nr\t2\t2\t\t\t\n"
    files = _files(spark, [("f", 1, 1, text)])
    for rows in (segments_of(ingest(files)), replay(segments_of(ingest(files)))):
        first, second = rows.orderBy("line_no").collect()
        assert json.loads(first.rescued) == {"tcn": "bad", "tcn 2": "3", "note": "a", "note 2": "b", " column 7": "c", " column 9": "d"}
        assert (first.tcn, second.tcn, json.loads(second.rescued)) == (None, 2.0, {"tcn 2": "", "note": "", "note 2": ""})


def test_values_that_the_target_cannot_take(spark):
    text = 'ID;Total CN;num.mark;seg;note\na_hisens;+1.5;3.0;1e999;say "hi" \\\tx\nb;.;2.5;99999999999;\n'
    first, second = segments_of(ingest(_files(spark, [(None, 1, 1, text)]))).orderBy("line_no").collect()
    assert (first.sample_id, first.facets_id, first.tcn, first.num_mark, first.seg, first.chrom) == ("a", "a_hisens", 1.5, 3, None, None)
    assert json.loads(first.rescued) == {"seg": "1e999", "note": 'say "hi" \\\tx'}
    assert (second.tcn, second.num_mark) == (None, None) and json.loads(second.rescued) == {"num_mark": "2.5", "seg": "99999999999", "note": ""}


def test_changes_come_from_the_reports(spark):
    one, two = "ID;tcn;lcn\na;1;2\n", "ID;Total-CN;lcn;x\na;1.0;t;\n"
    files = _files(spark, [("f", 1, 1, one), ("f", 2, 2, two), ("f", 2, 9, one), ("f", 4, 4, one), (None, 5, 5, one), ("g", 1, 6, one), ("g", 2, 7, one.replace("tcn", "y")), ("g", 2, 7, one.replace("tcn", "y"))])
    got = sorted(tuple(r) for r in schema_changes(ingest(files)).collect())
    assert got == [("f", 2, "added", "x"), ("f", 2, "renamed", "Total-CN"), ("f", 2, "retyped", "Total-CN"), ("f", 2, "retyped", "lcn"), ("g", 2, "added", "y"), ("g", 2, "removed", "tcn")]
    assert ingest(files).count() == 6 + 6 and ingest(files.limit(0)).count() == 0
