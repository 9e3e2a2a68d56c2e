"""Evaluation, probe, table, track and text operators: against brute force, and on nulls, ties and empty input."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from segscan.operators import cohort, evaluation, probes, scores, tables, tracks
from segscan.sources.delimited import preferred_files, read_delimited, sibling, write_delimited

CALLS = [("a", "1", 0.9, True), ("a", "2", 0.2, False), ("b", "1", 0.5, True), ("b", "2", 0.95, None), ("c", "1", None, False), ("d", "1", 0.9, False), ("d", "2", float("nan"), True), (None, "1", 0.9, True), ("e", "1", 0.1, None)]


def _calls(spark):
    return spark.createDataFrame(CALLS, "s string, chrom string, x double, t boolean").withColumn("sample", F.lit("z")).withColumn("best", F.lit(1))


def _tally(t):
    out = {"pos_recovered": 0, "pos_missed": 0, "neg_correct": 0, "neg_false_positive": 0}
    for s in {r[0] for r in CALLS}:
        mine = [(x is not None and x >= t, bool(tr)) for a, _, x, tr in CALLS if a == s]
        if any(tr for _, tr in mine):
            out["pos_recovered" if any(c and tr for c, tr in mine) else "pos_missed"] += 1
        else:
            out["neg_false_positive" if any(c for c, _ in mine) else "neg_correct"] += 1
    return out | {"sample_errors": out["pos_missed"] + out["neg_false_positive"]}


def test_sample_sweep(spark):
    thresholds = [0.05, 0.3, 0.5, 0.9, 0.99]
    swept = evaluation.sample_sweep(_calls(spark), "s", F.col("x"), F.col("t"), thresholds)
    got = {r.threshold: {k: r[k] for k in ("pos_recovered", "pos_missed", "neg_correct", "neg_false_positive", "sample_errors")} for r in swept.collect()}
    assert got == {t: _tally(t) for t in thresholds}
    best = evaluation.best_threshold(swept).first()
    assert best.threshold == min(thresholds, key=lambda t: (_tally(t)["sample_errors"], -_tally(t)["pos_recovered"], t))
    empty = evaluation.sample_sweep(_calls(spark).limit(0), "s", F.col("x"), F.col("t"), [0.5]).first()
    assert (empty.n_pos, empty.n_neg, empty.sample_errors) == (0, 0, 0)


def test_bootstrap(spark):
    points = spark.createDataFrame([(0.5, 30, 70, 24, 6, 60, 10, 16), (0.7, 0, 0, 0, 0, 0, 0, 0)], "threshold double, n_pos int, n_neg int, pos_recovered int, pos_missed int, neg_correct int, neg_false_positive int, sample_errors int")
    got = {r.threshold: r for r in evaluation.bootstrap(points).collect()}
    rng = np.random.default_rng(1)  # resamples of whole samples, one by one
    outcome = np.repeat([0, 1, 2, 3], [24, 6, 60, 10])
    errors = [(lambda x: (x == 1).sum() + (x == 3).sum())(rng.choice(outcome, 100)) for _ in range(4000)]
    assert abs(got[0.5].sample_errors_lo - np.percentile(errors, 2.5)) <= 1 and abs(got[0.5].sample_errors_hi - np.percentile(errors, 97.5)) <= 1
    assert (got[0.7].sample_errors_lo, got[0.7].pos_recovered_hi) == (0.0, 0.0)
    assert evaluation.bootstrap(points).orderBy("threshold").collect() == [got[0.5], got[0.7]]


def test_report_and_outcomes(spark):
    df = _calls(spark).withColumn("c", F.col("x") >= 0.5)
    r = evaluation.classifier_report(df.fillna({"c": False}).withColumn("c", F.when(F.isnan("x"), False).otherwise(F.col("c"))), "s", F.col("c"), F.col("t")).first()
    want = _tally(0.5)
    assert (r.caught, r.missed_chrom, r.false_positive, r.true_negative) == (3, 1, 2, 3)
    assert (r.n_positive, r.recovered, r.missed, r.sample_false_positive, r.errors) == (4, want["pos_recovered"], want["pos_missed"], 0, want["sample_errors"])
    assert evaluation.classifier_report(df.limit(0), "s", F.col("c"), F.col("t")).first().errors == 0
    assert [x[0] for x in df.filter("s = 'b'").orderBy("chrom").select(evaluation.chromosome_outcome(F.col("c"), F.col("t"))).collect()] == ["caught", "false_positive"]


def test_registers(spark):
    df = _calls(spark)
    pos = evaluation.positive_register(df, "s", F.col("t"), "x", 0.6, ["s", "chrom"])
    assert sorted((r.code, r.s, r.chrom, r.status) for r in pos.filter("s IS NOT NULL").collect()) == [("C01", "a", "1", "caught"), ("C02", "b", "1", "MISSED"), ("C03", "d", "2", "caught")]
    assert pos.filter("s IS NULL").first().code is None
    wrong = evaluation.false_positive_register(df, "s", F.col("t"), "x", 0.6, ["chrom"])
    assert sorted((r.s, r.chrom, r.fp_type) for r in wrong.collect()) == [("b", "2", "pos_sample_wrong_chrom"), ("d", "1", "pos_sample_wrong_chrom")]
    many = spark.range(120).select(F.format_string("s%03d", "id").alias("s"), F.lit(True).alias("t"))
    assert {r.sample: r.code for r in evaluation.sample_codes(many, "s", F.col("t")).collect()} == {f"s{i:03d}": f"C{i + 1:03d}" for i in range(120)}
    assert evaluation.positive_register(df.limit(0), "s", F.col("t"), "x", 0.6, ["s"]).count() == 0


def test_residual_and_calibration(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(0, 50), 3 + rng.random()) for i in range(30)] + [(100, None, 1.0), (101, 5, None)]
    df = spark.createDataFrame(rows, "k int, x int, y double")
    xs, ys = np.array([math.log1p(r[1]) for r in rows[:30]]), np.array([r[2] for r in rows[:30]])
    b1, b0 = np.polyfit(xs, ys, 1)
    got = {r.k: r.y_residual for r in evaluation.residual(df, "y", "x").collect()}
    assert all(abs(got[i] - (ys[i] - b0 - b1 * xs[i])) < 1e-9 for i in range(30)) and got[100] is None and got[101] is None
    assert {r.y_residual for r in evaluation.residual(df.limit(10), "y", "x").collect()} == {None}
    cal = evaluation.calibration(spark.createDataFrame([(2.0, 1, False), (2.0, 3, None), (2.0, 8, True), (3.0, 0, True), (None, 1, True), (3.0, None, True)], "p double, n int, t boolean"), "p", "n", F.col("t"))
    assert {r.p: (r.neg_median, r.neg_p90, r.pos_mean, r.n_neg, r.n_pos) for r in cal.collect()} == {2.0: (2.0, pytest.approx(2.8), 8.0, 2, 1), 3.0: (None, None, 0.0, 0, 1)}


def test_gates_and_noise(spark):
    df = spark.createDataFrame([(6, 6, 10, 1, 5, 0.7), (6, 1, 10, 2, 5, 0.7), (None, None, None, None, None, None)], "c int, i int, m int, a int, l int, f double")
    e = lambda **g: [r[0] for r in df.select(scores.evidence(F.col("c"), F.col("i"), F.col("m"), "product", gates=scores.Gates(**g))).collect()]
    assert e() == [1.0, 0.25, 0.0]
    assert e(amplitude=(F.col("a"), 2)) == [0.0, 0.25, 0.0]
    assert e(levels=(F.col("l"), 3, 0.5)) == pytest.approx([0.25, 0.0625, 0.0])
    assert e(loh=F.col("f")) == [1.0, 1.0, 0.0]
    assert e(probe_chain=F.lit(6)) == [1.0, 0.25, 0.25]
    rows = spark.createDataFrame([(0.6, 1.0, True), (0.7, 2.0, True), (0.9, 3.0, False), (0.1, 9.0, True), (0.9, None, None)], "s double, n double, t boolean")
    got = scores.nominate_by_noise(rows, "s", "n", F.col("t")).collect()
    assert [(r.noise_max, r.noise_veto, r.nominated) for r in got] == [(2.0, False, True), (2.0, False, True), (2.0, True, False), (2.0, True, False), (2.0, False, True)]
    assert not any(r.noise_veto for r in scores.nominate_by_noise(rows.filter("NOT t"), "s", "n", F.col("t")).collect())
    flags = scores.flag_samples(spark.createDataFrame([("a", True), ("a", None), ("b", None), ("b", False)], "s string, c boolean"), "s", "c").collect()
    assert {r.s: (r.flagged, r.n_nominated) for r in flags} == {"a": (True, 1), "b": (False, 0)}


def test_learned_scores_of_unseen_groups(spark):
    from segscan.operators.learned import informative, out_of_fold

    rng = random.Random(13)
    rows = []
    for g in range(60):
        for c in range(10):
            y = rng.random() < 0.15
            rows.append((f"g{g}", c, 3.0 * y + rng.gauss(0, 1), rng.gauss(0, 1), None if rng.random() < 0.2 else 2.0 * y + rng.gauss(0, 1), 7.0, None, True if y else rng.choice([False, None])))
    df = spark.createDataFrame(rows, "g string, c int, a double, b double, d double, same double, none double, y boolean")
    names = ["a", "b", "d", "same", "none"]
    assert informative(df, names) == ["a", "b", "d"]
    got = {(r.g, r.c): r.p for r in out_of_fold(df, ["g", "c"], names, "g", F.col("y")).collect()}
    assert len(got) == 600
    pos, neg = ([got[r[0], r[1]] for r in rows if bool(r[7]) == t] for t in (True, False))
    assert sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg) > 0.95
    assert {r.p for r in out_of_fold(df.filter("NOT y"), ["g", "c"], names, "g", F.col("y")).collect()} == {None}
    assert out_of_fold(df.limit(0), ["g", "c"], names, "g", F.col("y")).count() == 0


def test_run_structure(spark):
    from segscan.operators.segments import run_structure

    rng = random.Random(5)
    states = {}
    for c in range(40):
        states[str(c)] = [rng.choice([(2.0, 1.0), (3.0, 1.0), (1.0, 0.0), (2.0, None), (None, None)]) for _ in range(rng.randint(1, 25))]
    rows = [("f", c, float(i), i + 0.5, *s) for c, seq in states.items() for i, s in enumerate(seq)]
    got = {r.chrom: tuple(r)[2:] for r in run_structure(spark.createDataFrame(rows, "facets_id string, chrom string, loc_start double, loc_end double, tcn double, lcn double")).collect()}
    for c, seq in states.items():
        tok = [s if None not in s else ("row", i) for i, s in enumerate(seq)]
        lens = [len(list(g)) for _, g in itertools.groupby(tok)]
        pairs = [frozenset(p) for p in zip(tok, tok[1:]) if p[0] != p[1]]
        top = max((pairs.count(p) for p in pairs), default=0)
        assert got[c] == (len(pairs), pytest.approx(top / len(pairs) if pairs else 0), float(np.median(lens)), lens.count(1))


def _signal(spark, rows):
    return spark.createDataFrame(rows, "k string, p double, x double, v double").withColumn("kk", F.lit(1))


def test_probe_dispersion(spark):
    df = _signal(spark, [("a", float(i), x, None) for i, x in enumerate([1.0, 2.0, 4.0, 8.0])] + [("a", 9.0, None, None), ("b", 0.0, 1.0, None), ("c", 0.0, 1.0, None), ("c", 1.0, 3.0, None)])
    got = {r.k: tuple(r)[1:] for r in probes.dispersion(df, ["k"], ["p"], "x", "d").collect()}
    assert got["a"] == pytest.approx((3.095696, 2.2239, 1.080123, 1.048357), abs=1e-5)
    assert got["b"] == (None,) * 4 and got["c"][2] is None and got["c"][3] == 0.0


def test_rolling_states(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for g, n in (("a", 3), ("b", 40), ("c", 700), ("d", 2000)):
        x = np.repeat(rng.integers(0, 5, n // 3 + 1), 3)[:n] + rng.normal(0, 0.4, n)
        rows += [(g, float(i), float(v), None) for i, v in enumerate(x)]
        w = min(51, max(5, (n // 30) | 1)) // 2
        q = [max(int(np.rint(np.median(x[max(0, i - w) : i + w + 1]))), 0) for i in range(n)]
        rle = [k for k, _ in itertools.groupby(q)]
        chain = max(j - i for i in range(len(rle)) for j in range(i + 1, len(rle) + 1) if len(set(rle[i:j])) <= 3)
        base = np.median(x)
        spike = float(np.mean(x > base + 4 * max(1.4826 * np.median(np.abs(x - base)), 1e-3)))
        want[g] = (chain, len(rle) - 1, len(set(rle)), spike) if n >= 5 else (0, 0, 0, 0.0)
    got = {r.k: tuple(r)[1:] for r in probes.rolling_states(_signal(spark, rows), ["k"], ["p"], "x").collect()}
    assert {g: got[g] for g in want} == {g: (*t[:3], pytest.approx(t[3])) for g, t in want.items()}
    assert probes.rolling_states(_signal(spark, rows).limit(0), ["k"], ["p"], "x").count() == 0


def test_resolved_levels(spark):
    df = spark.createDataFrame([([0.0, 0.1, 0.5], 0.2), ([], 0.2), ([1.0, 1.0], 0.0), ([3.0, 0.0, 1.0, 2.0], 0.25), (None, 1.0)], "l array<double>, n double")
    assert [r[0] for r in df.select(probes.resolved_levels(F.col("l"), F.col("n"))).collect()] == [2, None, None, 4, None]


def test_changepoint_features(spark):
    step = [("a", float(i), 0.0 if i < 5 else 1.0, None) for i in range(10)]
    df = _signal(spark, step + [("b", float(i), 0.0, None) for i in range(9)] + [("b", 99.0, None, None)])
    got = {(r.k, r.pen_const): r for r in probes.changepoint_features(df, ["k"], "p", "x", [3.0, 1e9]).collect()}
    a = got["a", 3.0]
    assert (a.cp_n_changepoints, a.cp_n_levels, a.cp_osc_chain, a.cp_osc_confidence, a.cp_within_dispersion, a.cp_n_probes) == (1, 2, 2, 2.0, 0.0, 10)
    assert got["a", 1e9].cp_n_changepoints == 0 and got["a", 1e9].cp_osc_chain == 1
    assert tuple(got["b", 3.0])[2:] == (0, 0, 0.0, 0.0, 0, 10)
    noisy = probes.changepoint_features(df.withColumn("v", F.lit(100.0)), ["k"], "p", "x", [3.0], "v").filter("k = 'a'").first()
    assert noisy.cp_n_changepoints == 0  # the modelled variance is the larger


def test_long_alterations_and_tables(spark):
    wide = spark.createDataFrame([(1, "a; b", None), (2, "", "c"), (3, ";;a", "c;c")], "e int, `g.1` string, g2 string")
    assert sorted(tuple(r) for r in tables.alterations_long(wide, "e", ["g.1", "g2"]).collect()) == [(1, "g.1", "a"), (1, "g.1", "b"), (2, "g2", "c"), (3, "g.1", "a"), (3, "g2", "c"), (3, "g2", "c")]
    df = spark.createDataFrame([("x", 1), ("x", 1), ("y", 2), (None, 1), ("y", None)], "a string, b int")
    assert {(r.a, r.b): r.n for r in tables.contingency(df, "a", "b").collect()} == {("x", 1): 2, ("x", 2): 0, ("y", 1): 0, ("y", 2): 1}
    assert tables.contingency(df.limit(0), "a", "b").count() == 0
    rows = spark.createDataFrame([("p1-a", 2, 1), ("p1-b", 1, 0), ("p2-a", 1, None)], "s string, i int, l int")
    got = tables.append_first(spark.createDataFrame([("p1", "x"), ("p2", "y"), ("p3", None)], "e string, g string"), rows, "e", "g", F.substring_index("s", "-", 1), "i", F.col("l") == 0, "LOH").collect()
    assert {r.e: r.g for r in got} == {"p1": "x;LOH", "p2": "y", "p3": None}


def test_pairs_and_exact_test(spark):
    rng = random.Random(7)
    rows = [tuple(rng.choice([True, False, None]) for _ in range(3)) for _ in range(40)]
    counts = tables.pair_counts(spark.createDataFrame(rows, "a boolean, b boolean, c boolean"), ["a", "b", "c"])
    for r in counts.collect():
        i, j = "abc".index(r.g1), "abc".index(r.g2)
        assert (r.n11, r.n10, r.n01, r.n00) == tuple(sum(bool(x[i]) == p and bool(x[j]) == q for x in rows) for p, q in ((1, 1), (1, 0), (0, 1), (0, 0)))
    # By hand: 3, 1, 1, 3: p = 34/70; the mean is 3 at the ratio t with t^4 - 36 t^2 - 32 t - 3 = 0.
    p, t = tables.exact_test(3, 1, 1, 3)
    assert p == pytest.approx(34 / 70) and 6 < t < 7 and abs(t**4 - 36 * t**2 - 32 * t - 3) < 1e-6
    assert tables.exact_test(0, 5, 5, 0) == (pytest.approx(2 / 252), 0.0) and math.isnan(tables.exact_test(0, 0, 3, 4)[1])
    tested = tables.pair_tests(counts).collect()
    assert len(tested) == 9 and all(r.q_value >= r.p_value - 1e-12 and not (r.starred and r.g1 == r.g2) for r in tested)


def test_box_stats(spark):
    rng = random.Random(9)
    rows = [(g, rng.choice([1.0, 2.0, 2.0, 5.5, 7.0, 30.0])) for g in "ab" for _ in range(rng.randint(5, 60))] + [("c", 4.0), (None, 1.0), (None, 2.0), ("a", None), ("a", float("nan"))]
    got = {r.group: tuple(r)[1:] for r in tables.box_stats(spark.createDataFrame(rows, "g string, x double"), "g", "x").collect()}
    for g in ("a", "b", "c", None):
        x = sorted(v for k, v in rows if k == g and v is not None and v == v)
        n = len(x)
        q = math.floor((n + 3) / 2) / 2
        at = lambda p: (x[math.floor(p) - 1] + x[math.ceil(p) - 1]) / 2
        lo, mid, hi = at(q), at((n + 1) / 2), at(n + 1 - q)
        inside = [v for v in x if lo - 1.5 * (hi - lo) <= v <= hi + 1.5 * (hi - lo)]
        assert got[g] == (n, min(inside), lo, mid, hi, max(inside))


def test_pairwise_log_rank(spark):
    rng = random.Random(3)
    rows = [(rng.randint(1, 9), rng.randint(0, 1), rng.choice("abc")) for _ in range(90)]
    df = spark.createDataFrame(rows, "t int, e int, g string")
    for r in cohort.pairwise_log_rank(df, "t", "e", "g").collect():
        two = cohort.log_rank(df.filter(F.col("g").isin(r.group_1, r.group_2)), "t", "e", "g").filter(F.col("group") == r.group_1).first()
        assert (r.n_1, r.observed_1, r.expected_1, r.chi2) == (two.n, two.observed, pytest.approx(two.expected), pytest.approx(two.chi2))
    assert cohort.pairwise_log_rank(df.limit(0), "t", "e", "g").count() == 0
    with pytest.raises(ValueError):
        cohort.pairwise_log_rank(df, "t", "e", "g", most_groups=2)


def test_tracks(spark):
    rows = [("f", "2", 10.0, 50.0, 20.0, None), ("f", "1", 0.0, 100.0, 2.0, 1.0), ("f", "23", 0.0, 30.0, None, 0.0), ("f", "odd", 1.0, 7.0, 1.0, 1.0), ("f", "1", 5.0, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "facets_id string, chrom string, loc_start double, loc_end double, tcn double, lcn double")
    places = tracks.offsets(df)
    assert {r.label: (r.length, r.offset) for r in places.collect()} == {"1": (100.0, 0.0), "2": (50.0, 100.0), "X": (30.0, 150.0), "odd": (7.0, 180.0)}
    shown = {r.label: r for r in tracks.track(df, places).filter("loc_end IS NOT NULL").collect()}
    assert (shown["2"].x_start, shown["2"].tcn_shown, shown["2"].lcn_shown, shown["X"].tcn_shown) == (110.0, 11.0, 1.0, None)
    listed = spark.createDataFrame([("p", "1"), ("p", "1"), ("p", "23"), ("q", "99")], "id string, chrom string")
    got = tracks.areas(listed, spark.createDataFrame([("p", "X")], "id string, chrom string"), places, "id").collect()
    assert sorted((r.label, r.kind, r.x_end) for r in got) == [("1", "listed", 100.0), ("X", "listed and amplified", 180.0)]
    arms = tracks.arms(df, spark.createDataFrame([("1", 100.0, 120.0), ("2", 5.0, 10.0), ("23", 10.0, 20.0)], "chrom string, centro_start double, centro_end double"))
    assert {r.chrom: r.arm for r in arms.filter("loc_end IS NOT NULL").collect()} == {"1": "p", "2": "q", "23": "centromere", "odd": None}


def test_delimited_text(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('b\ta\tmore\n1\tx\tq\n2\ty\n3\tz\tq\textra\nbad\t"q\tt"\tNA\n\tw\t\n')
    rows = read_delimited(spark, str(tmp_path / "a.tsv"), "a string, b int, other double", ("a",))
    assert sorted(map(repr, map(tuple, rows.collect()))) == sorted(map(repr, [("x", 1, None), ("y", 2, None), ("q\tt", None, None), ("w", None, None)]))
    with pytest.raises(KeyError):
        read_delimited(spark, str(tmp_path / "a.tsv"), "a string", ("a", "c"))
    df = spark.createDataFrame([(' s "x"\t', 1.5), (None, None), ("", 2.0)], "a string, b double")
    write_delimited(df, str(tmp_path / "out"))
    assert sorted(map(repr, map(tuple, read_delimited(spark, str(tmp_path / "out"), "b double, a string").collect()))) == sorted(map(repr, [(1.5, ' s "x"\t'), (None, None), (2.0, None)]))
    files = spark.createDataFrame([("k1/a_hisens.cncf.txt",), ("k1/refit_hisens.cncf.txt",), ("k1/z_hisens.cncf.txt",), ("k2/b_purity.txt",), (None,)], "path string")
    got = preferred_files(files, "path", F.substring_index("path", "/", 1)).select("key", "path", sibling(F.col("path"), ".cncf.txt", ".Rdata").alias("p")).collect()
    assert [tuple(r) for r in got] == [("k1", "k1/refit_hisens.cncf.txt", "k1/refit_hisens.Rdata")]


def test_tails(spark):
    from segscan.functions.tails import chi2_tail, t_tails

    rows = [(x, d) for x in (0.0, 0.3, 1.0, 3.841458820694124, 9.0, 80.0) for d in (1, 2, 3, 4, 40)] + [(None, 1), (1.0, None), (-1.0, 1), (1.0, 0)]
    got = spark.createDataFrame(rows, "x double, d int").select("x", "d", chi2_tail(F.col("x"), F.col("d")).alias("c"), t_tails(F.col("x"), F.col("d")).alias("t")).collect()
    for r in got:
        if r.x is None or r.d is None or r.d <= 0:
            assert r.c is None and r.t is None
            continue
        if r.x < 0:
            assert r.c is None and r.t == pytest.approx(0.5)
            continue
        h = r.x / 2
        exact = {1: math.erfc(math.sqrt(h)), 2: math.exp(-h), 4: math.exp(-h) * (1 + h)}
        if r.d in exact:
            assert r.c == pytest.approx(exact[r.d], rel=1e-10)
        if r.d == 1:
            assert r.t == pytest.approx(1 - 2 / math.pi * math.atan(r.x), rel=1e-10)
        if r.d == 2:
            assert r.t == pytest.approx(1 - r.x / math.sqrt(2 + r.x**2), rel=1e-9, abs=1e-13)
    by = {(r.x, r.d): r.c for r in got}
    assert by[80.0, 40] == pytest.approx(math.exp(-40) * sum(40.0**k / math.factorial(k) for k in range(20)), rel=1e-10)
    assert spark.createDataFrame([], "x double").select(chi2_tail(F.col("x"), 1)).count() == 0


def test_edge_ranks_and_firsts(spark):
    edges = spark.createDataFrame([("a", 5.0, "x"), ("a", 7.0, "y"), ("a", None, "z"), ("b", 1.0, "u")], "k string, e double, position string")
    points = spark.createDataFrame([("a", 1.0), ("a", 5.0), ("a", 6.0), ("a", None), ("c", 0.0)], "k string, p double")
    assert {r.position: r["rank"] for r in probes.edge_ranks(edges, points, ["k"], "e", "p").collect()} == {"x": 1, "y": 3, "z": None, "u": 0}
    df = spark.createDataFrame([("a", i) for i in range(9)] + [(None, 1), ("b", 2)], "g string, v int")
    assert sorted((r.g or "", r.v, r.place) for r in cohort.first_of_each(df, "g", [F.col("v").desc()], 2).collect()) == [("", 1, 1), ("a", 7, 2), ("a", 8, 1), ("b", 2, 1)]
