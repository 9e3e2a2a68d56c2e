"""Cohort statistics: survival, adjusted p values, confusion counts and threshold sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segscan.operators.running import cumulate


def kaplan_meier(df: DataFrame, time: str, event: str, group: str) -> DataFrame:
    """``group, time, n_risk, n_event, n_censored, survival`` per distinct time.

    Rows with a null time or event are left out; a null group is a group. Rows are counted per time before the
    windows, so these see only distinct times.
    """
    per = df.filter(F.col(time).isNotNull() & F.col(event).isNotNull()).groupBy(F.col(group).alias("group"), F.col(time).alias("time")).agg(F.sum(F.col(event).cast("long")).alias("n_event"), F.count("*").alias("_n"))
    later = Window.partitionBy("group").orderBy(F.col("time").desc())
    so_far = Window.partitionBy("group").orderBy("time").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per = per.withColumn("n_risk", F.sum("_n").over(later)).withColumn("n_censored", F.col("_n") - F.col("n_event"))
    log = F.sum(F.when(F.col("n_event") < F.col("n_risk"), F.log(1 - F.col("n_event") / F.col("n_risk"))).otherwise(0.0)).over(so_far)
    dead = F.max(F.col("n_event") == F.col("n_risk")).over(so_far)
    return per.select("group", "time", "n_risk", "n_event", "n_censored", F.when(dead, 0.0).otherwise(F.exp(log)).alias("survival"))


def step_up(df: DataFrame, p: str, out: str = "q") -> DataFrame:
    """Adds the false discovery rate by the step-up rule over all rows with a p value; null stays null.

    Equal p values share the highest rank. Distinct p values are counted first, then ranked by ranges.
    """
    counts = df.filter(F.col(p).isNotNull()).groupBy(p).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"))
    ranked = cumulate(counts, [], F.col(p), _rank=("sum", "_n")).crossJoin(F.broadcast(total)).withColumn("_q", F.col(p) * F.col("_total") / F.col("_rank"))  # total: one row
    adjusted = cumulate(ranked, [], -F.col(p), _least=("min", "_q")).select(p, F.least(F.lit(1.0), F.col("_least")).alias(out))
    return df.join(adjusted, p, "left")


def confusion(df: DataFrame, call: Column, truth: Column) -> DataFrame:
    """``tp, fp, fn, tn``; a null call is no call, a null truth is false."""
    c, t = F.coalesce(call, F.lit(False)), F.coalesce(truth, F.lit(False))
    return df.agg(F.count_if(c & t).alias("tp"), F.count_if(c & ~t).alias("fp"), F.count_if(~c & t).alias("fn"), F.count_if(~c & ~t).alias("tn"))


def sweep(df: DataFrame, score: str, truth: Column) -> DataFrame:
    """``threshold, tp, fp``, cumulated from the highest distinct score down; null scores are never called."""
    per = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("threshold")).agg(F.count_if(F.coalesce(truth, F.lit(False))).alias("_t"), F.count("*").alias("_n"))
    return cumulate(per, [], -F.col("threshold"), tp=("sum", "_t"), n=("sum", "_n")).select("threshold", "tp", (F.col("n") - F.col("tp")).alias("fp"))


def _log_rank(per: DataFrame, by: list[str]) -> DataFrame:
    """``by, group, n, observed, expected, chi2`` of each group against all others of its ``by``. ``per``: by, group, time, d (events), c (rows), all without nulls."""
    # Over all distinct times: hazard d / n and the two parts of the variance, summed from the start. A row of a group
    # brings all that was summed up to its own time, so no group is paired with all times.
    times = cumulate(per.groupBy(*by, "time").agg(F.sum("d").alias("_d"), F.sum("c").alias("_c")), by, -F.col("time"), _n=("sum", "_c"))
    w = F.when(F.col("_n") > 1, F.col("_d") * (F.col("_n") - F.col("_d")) / (F.col("_n") - 1)).otherwise(0.0)
    times = times.select(*by, "time", (F.col("_d") / F.col("_n")).alias("_h1"), (w / F.col("_n")).alias("_a1"), (w / F.col("_n") / F.col("_n")).alias("_b1"))
    times = cumulate(times, by, F.col("time"), _h=("sum", "_h1"), _a=("sum", "_a1"), _b=("sum", "_b1")).select(*by, "time", "_h", "_a", "_b")
    group = Window.partitionBy(*by, "group")
    own = per.join(times, [*by, "time"]).withColumns({"_g": F.sum("c").over(group.orderBy(F.col("time").desc())), "_step": F.col("_b") - F.coalesce(F.lag("_b").over(group.orderBy("time")), F.lit(0.0))})
    out = own.groupBy(*by, "group").agg(F.sum("c").alias("n"), F.sum("d").alias("observed"), F.sum(F.col("c") * F.col("_h")).alias("expected"), (F.sum(F.col("c") * F.col("_a")) - F.sum(F.col("_step") * F.col("_g") * F.col("_g"))).alias("_v"))
    return out.select(*by, "group", "n", "observed", "expected", F.when(F.col("_v") > 1e-9, F.pow(F.col("observed") - F.col("expected"), F.lit(2)) / F.col("_v")).alias("chi2"))


def _per_time(df: DataFrame, time: str, event: str, group: str) -> DataFrame:
    return df.select(F.col(group).alias("group"), F.col(time).alias("time"), F.col(event).cast("long").alias("e")).dropna().groupBy("group", "time").agg(F.sum("e").alias("d"), F.count("*").alias("c"))


def log_rank(df: DataFrame, time: str, event: str, group: str) -> DataFrame:
    """``group, n, observed, expected, chi2``: each group against all others, one degree of freedom.

    Rows are counted per group and time before any window. Rows with a null among the three are left out; ``chi2`` is
    null where the variance is 0.
    """
    return _log_rank(_per_time(df, time, event, group), [])


def pairwise_log_rank(df: DataFrame, time: str, event: str, group: str, most_groups: int = 100) -> DataFrame:
    """``group_1, group_2, n_1, observed_1, expected_1, chi2`` for every two groups, by name. More than ``most_groups`` raise ValueError."""
    per = _per_time(df, time, event, group)
    names = sorted(r[0] for r in per.select("group").distinct().limit(most_groups + 1).collect())
    if len(names) > most_groups:
        raise ValueError(f"more than {most_groups} groups")
    # Each count goes to the pairs of its group: one row per other group.
    others = F.explode(F.filter(F.lit(names) if names else F.array().cast("array<string>"), lambda g: g != F.col("group"))).alias("_o")
    paired = per.select("*", others).select(F.least("group", "_o").alias("group_1"), F.greatest("group", "_o").alias("group_2"), "group", "time", "d", "c")
    out = _log_rank(paired, ["group_1", "group_2"]).filter("group = group_1")
    return out.select("group_1", "group_2", F.col("n").alias("n_1"), F.col("observed").alias("observed_1"), F.col("expected").alias("expected_1"), "chi2")


def first_of_each(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group, with ``place`` from 1; where the order ties, which come first is arbitrary. Groups are cut to ``n`` rows before the shuffle."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("place") <= n)


def at_risk(df: DataFrame, time: str, group: str, marks: list[float]) -> DataFrame:
    """``group, time, n_risk`` for each of the given times: rows of the group with at least that time; 0 where there is none left."""
    counts = df.groupBy(F.col(group).alias("group")).agg(*[F.count_if(F.col(time) >= m).alias(f"_{i}") for i, m in enumerate(marks)])
    return counts.select("group", F.explode(F.array(*[F.struct(F.lit(float(m)).alias("time"), F.col(f"_{i}").alias("n_risk")) for i, m in enumerate(marks)])).alias("_r")).select("group", "_r.*")


def unequal_variance_t(df: DataFrame, value: str, group: Column) -> DataFrame:
    """One row: ``n_1, n_0, mean_1, mean_0, t, df`` of the two-sample test without equal variances; null values and groups are left out."""
    a = df.select(F.col(value).cast("double").alias("x"), group.alias("g")).dropna().agg(*[f.alias(f"{n}_{g}") for g in (1, 0) for n, f in (("n", F.count_if(F.col("g") == bool(g))), ("mean", F.avg(F.when(F.col("g") == bool(g), F.col("x")))), ("v", F.var_samp(F.when(F.col("g") == bool(g), F.col("x")))))])
    e1, e0 = F.try_divide(F.col("v_1"), F.col("n_1")), F.try_divide(F.col("v_0"), F.col("n_0"))
    return a.select("n_1", "n_0", "mean_1", "mean_0", F.try_divide(F.col("mean_1") - F.col("mean_0"), F.sqrt(e1 + e0)).alias("t"), F.try_divide((e1 + e0) * (e1 + e0), F.try_divide(e1 * e1, F.col("n_1") - 1) + F.try_divide(e0 * e0, F.col("n_0") - 1)).alias("df"))


def feature_screen(df: DataFrame, features: list[str], truth: Column, least: int = 20) -> DataFrame:
    """``feature, n, n_pos, direction, average_precision, auroc``: how well each feature alone ranks the true rows, in its better direction.

    Values are counted per feature and distinct value first; equal values share one step. Null, NaN and infinite values
    are left out; features with fewer than ``least`` values or one class only give no row.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features]))
    long = df.select(F.coalesce(truth, F.lit(False)).alias("_t"), pairs.alias("_p")).select("_t", "_p.*").filter("x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf')")
    per = long.groupBy("feature", "x").agg(F.count_if("_t").alias("p"), F.count("*").alias("c"))
    both = per.select("feature", "p", "c", F.explode(F.array(F.struct(F.lit("high").alias("direction"), (-F.col("x")).alias("o")), F.struct(F.lit("low").alias("direction"), F.col("x").alias("o")))).alias("_s")).select("feature", "p", "c", "_s.*")
    sizes = both.groupBy("feature", "direction").agg(F.sum("p").alias("np"), F.sum("c").alias("n")).filter(f"n >= {least} AND np > 0 AND np < n")  # two rows per feature
    r = cumulate(both, ["feature", "direction"], F.col("o"), tp=("sum", "p"), m=("sum", "c")).join(F.broadcast(sizes), ["feature", "direction"])
    per_way = r.groupBy("feature", "direction").agg(
        F.max("n").alias("n"), F.max("np").alias("n_pos"), F.sum(F.col("p") / F.col("np") * F.col("tp") / F.col("m")).alias("average_precision"),
        F.sum((F.col("c") - F.col("p")) * (F.col("tp") - F.col("p") / 2) / (F.col("np") * (F.col("n") - F.col("np")))).alias("auroc"),
    )
    best = per_way.groupBy("feature").agg(F.max_by(F.struct("n", "n_pos", "direction", "average_precision", "auroc"), F.struct(F.round("average_precision", 9), F.col("direction") == "high")).alias("_b"))
    return best.select("feature", "_b.*")


def entity_outcomes(df: DataFrame, entity: str, call: Column, truth: Column) -> DataFrame:
    """``entity, outcome``: recovered if a true row is called, missed if none of the true ones is, else false_positive or correct_negative."""
    c, t = F.coalesce(call, F.lit(False)), F.coalesce(truth, F.lit(False))
    flags = df.groupBy(entity).agg(F.bool_or(c & t).alias("hit"), F.bool_or(t).alias("true"), F.bool_or(c).alias("called"))
    return flags.select(entity, F.when(F.col("hit"), "recovered").when(F.col("true"), "missed").when(F.col("called"), "false_positive").otherwise("correct_negative").alias("outcome"))
