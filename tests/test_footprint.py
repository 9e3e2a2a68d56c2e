"""Footprints, scores, cohort tests and the stream: against brute force, and on nulls, ties and empty input."""

import random

import pytest
from pyspark.sql import functions as F

from segscan.operators import cohort, scores
from segscan.operators.footprint import footprint, longest_window
from segscan.streaming.incremental import aggregate_available, file_stream

SEGMENTS = "facets_id string, chrom string, loc_start double, loc_end double, tcn double, lcn double"


def _first_longest(a, k):
    best = (0, 1, 0)
    for i in range(len(a)):
        for j in range(i, len(a)):
            if len(set(a[i : j + 1])) <= k and j - i + 1 > best[0]:
                best = (j - i + 1, i + 1, j + 1)
    return best


def test_longest_window(spark):
    rng = random.Random(1)
    arrays = [[]]
    for _ in range(150):
        a = [rng.randint(0, 4) for _ in range(rng.randint(1, 20))]
        arrays.append([x for i, x in enumerate(a) if i == 0 or x != a[i - 1]])
    df = spark.createDataFrame(list(enumerate(arrays)), "i int, a array<int>")
    got = {r[0]: tuple(r[1]) for r in df.select("i", longest_window(F.col("a"), 3)).collect()}
    assert got == {i: _first_longest(a, 3) for i, a in enumerate(arrays)}


def test_footprint_edges(spark):
    tcn = [2.0, 3.0, None, 3.0, 2.0, 2.0]
    rows = [("f", "1", i * 1e6, (i + 1) * 1e6, t, None) for i, t in enumerate(tcn)] + [("f", "2", 0.0, 1e6, None, None), ("f", "3", 5e6, 4e6, 2.5, 1.0)]
    got = {r.chrom: r for r in footprint(spark.createDataFrame(rows, SEGMENTS)).collect()}
    one = got["1"]
    # Two separate islands: the segment without a value is not altered; the chain skips it, but its bounds hold it.
    assert (one.osc_chain, one.osc_chain_n_segments, one.n_altered_islands, one.altered_union_mb, one.altered_span_mb) == (3, 6, 2, 2.0, 3.0)
    assert one.state_change_span_mb == 0.0  # no segment has both copy numbers: all pairs are one state
    assert (got["2"].osc_chain, got["2"].osc_chain_n_segments, got["2"].osc_chain_span_mb) == (0, 0, None)
    assert (got["3"].chrom_seg_len_mb, got["3"].altered_union_frac) == (0.0, None)
    assert footprint(spark.createDataFrame([], SEGMENTS)).count() == 0


def test_pairs_with_a_null_are_one_state(spark):
    # By hand: (2,1), (2,-), (3,-), (-,1), (2,1): the three pairs with a null are one state, so the changes begin at 10 and 40.
    pairs = [(2.0, 1.0), (2.0, None), (3.0, None), (None, 1.0), (2.0, 1.0)]
    rows = [("f", "1", 10e6 * i, 10e6 * i + 5e6, t, l) for i, (t, l) in enumerate(pairs)]
    assert footprint(spark.createDataFrame(rows, SEGMENTS)).first().state_change_span_mb == 30.0


def test_scores_edges(spark):
    df = spark.createDataFrame([(6, 6, 10), (4, 3, 3), (None, None, None)], "c int, i int, m int")
    got = [tuple(r) for r in df.select(*[scores.evidence(F.col("c"), F.col("i"), F.col("m"), how) for how in ("sum", "product", "min", "noisy_and")]).collect()]
    assert got[0] == (1.0, 1.0, 1.0, 1.0)
    assert got[1] == pytest.approx((0.4, 0.125, 0.25, 1 - 0.5 * 0.75 * 0.75))
    assert got[2] == pytest.approx((0.1, 0.0, 0.0, 0.25))
    assert [r[0] for r in df.select(scores.ramp(F.col("c").cast("double"), 5, 5)).collect()] == [1.0, 0.0, None]
    weights = df.select(scores.quality(F.lit(None).cast("double"), F.col("m"), F.lit(0.0)), scores.quality(F.lit(0.35), F.lit(15), F.lit(0.05)))
    assert [tuple(r) for r in weights.collect()] == [(None, 1.0)] * 3
    with pytest.raises(ValueError):
        scores.combine("other", F.lit(1.0), F.lit(1.0))


def test_log_rank(spark):
    rng = random.Random(3)
    rows = [(rng.randint(1, 9), rng.randint(0, 1), rng.choice("abc")) for _ in range(80)]
    got = {r.group: r for r in cohort.log_rank(spark.createDataFrame([*rows, (None, 1, "a"), (1, None, "a"), (1, 1, None)], "t int, e int, g string"), "t", "e", "g").collect()}
    for g in "abc":
        o = e = v = 0.0
        for t in {t for t, ev, _ in rows if ev}:
            n, mine = sum(x[0] >= t for x in rows), sum(x[0] >= t and x[2] == g for x in rows)
            d = sum(x[0] == t and x[1] for x in rows)
            o += sum(x[0] == t and x[1] and x[2] == g for x in rows)
            e += d * mine / n
            v += d * mine / n * (1 - mine / n) * (n - d) / (n - 1) if n > 1 else 0
        assert (got[g].observed, got[g].expected, got[g].chi2) == (o, pytest.approx(e), pytest.approx((o - e) ** 2 / v))
    alone = cohort.log_rank(spark.createDataFrame([(1, 1, "a"), (2, 1, "a")], "t int, e int, g string"), "t", "e", "g").first()
    assert (alone.expected, alone.chi2) == (2.0, None)


def test_feature_screen_ties(spark):
    rows = [(1.0, 5.0, True)] * 10 + [(1.0, 1.0, False)] * 5 + [(1.0, float("nan"), False), (None, None, True), (2.0, 1.0, None)] + [(0.0, 1.0, False)] * 10
    got = {r.feature: r for r in cohort.feature_screen(spark.createDataFrame(rows, "x double, y double, t boolean"), ["x", "y"], F.col("t")).collect()}
    assert (got["y"].n, got["y"].n_pos, got["y"].direction, got["y"].average_precision, got["y"].auroc) == (26, 10, "high", 1.0, 1.0)
    assert got["x"].n == 27 and 0.5 < got["x"].auroc < 1


def test_outcomes_and_t(spark):
    df = spark.createDataFrame([("a", True, True), ("a", False, True), ("b", None, True), ("c", True, None), ("d", False, False)], "s string, c boolean, t boolean")
    assert {r.s: r.outcome for r in cohort.entity_outcomes(df, "s", F.col("c"), F.col("t")).collect()} == {"a": "recovered", "b": "missed", "c": "false_positive", "d": "correct_negative"}
    t = cohort.unequal_variance_t(spark.createDataFrame([(1.0, True), (3.0, True), (2.0, False), (None, False)], "x double, g boolean"), "x", F.col("g")).first()
    assert (t.n_1, t.n_0, t.mean_1, t.t) == (2, 1, 2.0, None)


def test_stream_reads_each_file_once(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "state")
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 5)], "k string, n long")
    df.coalesce(1).write.parquet(source)
    run = lambda: {r.k: r.n for r in aggregate_available(file_stream(spark, source, df.schema), {"k": F.col("k")}, {"n": F.col("n")}, folder).collect()}
    assert run() == {"a": 3, None: 5}
    assert run() == {"a": 3, None: 5}  # nothing new
    df.coalesce(1).write.mode("append").parquet(source)
    assert run() == {"a": 6, None: 10}
