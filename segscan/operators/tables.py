"""Tables of a cohort: alterations per gene, contingency with empty cells, tests of gene pairs, box statistics, intervals."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segscan.operators.cohort import step_up
from segscan.operators.running import cumulate

#: Levels of a row or column up to which a contingency table is filled with its empty cells.
MOST_LEVELS = 1000


def alterations_long(wide: DataFrame, entity: str, genes: list[str], sep: str = ";") -> DataFrame:
    """``entity, gene, alteration``: the joined lists of the gene columns as one row per value; blanks and nulls give none."""
    cells = F.explode(F.array(*[F.struct(F.lit(g).alias("gene"), F.split(F.col(f"`{g}`"), F.lit(sep)).alias("_v")) for g in genes])).alias("_c")
    values = F.explode(F.filter(F.transform("_c._v", lambda v: F.trim(v)), lambda v: v != "")).alias("alteration")
    return wide.select(entity, cells).select(entity, F.col("_c.gene").alias("gene"), values)


def append_first(wide: DataFrame, looked_up: DataFrame, entity: str, gene: str, sample: Column, order: str, flag: Column, label: str, sep: str = ";") -> DataFrame:
    """``wide`` with ``label`` appended to its column ``gene`` where the first row of ``looked_up`` for the entity has ``flag``.

    ``sample``: the entity of a row of ``looked_up``, as an expression on it; the first row by ``order`` counts. An empty or
    missing cell becomes the label alone.
    """
    own = looked_up.select(sample.alias("_e"), F.struct(order, F.coalesce(flag, F.lit(False)).alias("f")).alias("_r")).groupBy("_e").agg(F.min("_r").alias("_r"))
    joined = wide.join(own, wide[entity] == own["_e"], "left")
    return joined.withColumn(gene, F.when(F.col("_r.f"), F.concat_ws(sep, F.nullif(F.col(gene), F.lit("")), F.lit(label))).otherwise(F.col(gene))).drop("_e", "_r")


def contingency(df: DataFrame, row: str, column: str) -> DataFrame:
    """``row, column, n`` for every pair of a value of ``row`` and one of ``column`` that occur, 0 where they don't occur together. Nulls are left out.

    Up to ``MOST_LEVELS`` values each; more raise ValueError, as the empty cells would outnumber the rows.
    """
    counts = df.filter(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(row, column).agg(F.count("*").alias("_n"))
    sides = [[r[0] for r in counts.select(c).distinct().limit(MOST_LEVELS + 1).collect()] for c in (row, column)]
    if any(len(s) > MOST_LEVELS for s in sides):
        raise ValueError(f"more than {MOST_LEVELS} values of {row} or {column}")
    kind = {c: df.schema[c].dataType for c in (row, column)}
    spark = df.sparkSession
    # The second side as one array beside each value of the first: as many cells as asked for, no join of all with all.
    cells = spark.createDataFrame([(x, sides[1]) for x in sides[0]], f"`{row}` {kind[row].simpleString()}, _c array<{kind[column].simpleString()}>").select(row, F.explode("_c").alias(column))
    return cells.join(counts, [row, column], "left").select(row, column, F.coalesce("_n", F.lit(0)).alias("n"))


def pair_counts(flags: DataFrame, columns: list[str]) -> DataFrame:
    """``g1, g2, n11, n10, n01, n00, odds_ratio`` for every ordered pair of the boolean ``columns``, also of one with itself; null is false.

    One aggregate over the rows, whose size is that of the column list squared; ``odds_ratio`` is the cross ratio of the counts, null where it has no value.
    """
    on = {c: F.coalesce(F.col(f"`{c}`"), F.lit(False)) for c in columns}
    one = flags.agg(F.count("*").alias("n"), *[F.count_if(on[a]).alias(f"m_{i}") for i, a in enumerate(columns)], *[F.count_if(on[a] & on[b]).alias(f"b_{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if j >= i])
    cells = [F.struct(F.lit(a).alias("g1"), F.lit(b).alias("g2"), F.col(f"b_{min(i, j)}_{max(i, j)}").alias("n11"), F.col(f"m_{i}").alias("a"), F.col(f"m_{j}").alias("b")) for i, a in enumerate(columns) for j, b in enumerate(columns)]
    rows = one.select("n", F.explode(F.array(*cells)).alias("_c")).select("n", "_c.*")
    out = rows.select("g1", "g2", "n11", (F.col("a") - F.col("n11")).alias("n10"), (F.col("b") - F.col("n11")).alias("n01"), (F.col("n") - F.col("a") - F.col("b") + F.col("n11")).alias("n00"))
    return out.withColumn("odds_ratio", F.try_divide(F.col("n11") * F.col("n00"), F.col("n10") * F.col("n01")))


def exact_test(n11: int, n10: int, n01: int, n00: int) -> tuple[float, float]:
    """Two-sided p value of the exact test of a 2 x 2 table, and the odds ratio of highest conditional likelihood (0 or infinite at the ends)."""
    rows, cols, n = n11 + n10, n11 + n01, n11 + n10 + n01 + n00
    lo, hi = max(0, rows + cols - n), min(rows, cols)
    k = np.arange(lo, hi + 1)
    choose = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    log = np.array([choose(rows, int(x)) + choose(n - rows, cols - int(x)) for x in k])
    p = np.exp(log - log.max())
    p /= p.sum()
    value = min(1.0, float(p[p <= p[n11 - lo] * (1 + 1e-7)].sum()))
    if lo == hi:
        return value, float("nan")
    if n11 in (lo, hi):
        return value, 0.0 if n11 == lo else float("inf")

    def mean(t: float) -> float:
        w = log + t * k
        w = np.exp(w - w.max())
        return float((w * k).sum() / w.sum())

    a, b = -40.0, 40.0
    for _ in range(200):
        t = (a + b) / 2
        a, b = (t, b) if mean(t) < n11 else (a, t)
    return value, math.exp((a + b) / 2)


def pair_tests(counts: DataFrame) -> DataFrame:
    """``counts`` (of ``pair_counts``) with ``p_value``, ``conditional_ratio``, ``q_value`` over all pairs, ``strength`` (signed log10 of q, 10 at most) and ``starred`` (q below 0.05, two genes)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [exact_test(*map(int, r)) for r in pdf[["n11", "n10", "n01", "n00"]].itertuples(index=False)]
            yield pdf.assign(p_value=[f[0] for f in found], conditional_ratio=[f[1] for f in found])

    tested = counts.mapInPandas(run, counts.schema.simpleString()[7:-1] + ",p_value:double,conditional_ratio:double")
    out = step_up(tested, "p_value", "q_value")
    strength = -F.log10(F.col("q_value")) * F.when(F.col("conditional_ratio") < 1, -1.0).otherwise(1.0)
    return out.withColumns({"strength": F.least(strength, F.lit(10.0)), "starred": (F.col("q_value") < 0.05) & (F.col("g1") != F.col("g2"))})


def box_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """``group, n, low, hinge_low, median, hinge_high, high``: hinges are medians of the halves, whiskers reach the last value within 1.5 hinge spreads.

    Missing values are left out, a null group is a group. Values are counted first and ranked by ranges, so that no task sorts a group.
    """
    x = F.col(value).cast("double")
    counts = df.filter(x.isNotNull() & ~F.isnan(x)).groupBy(F.col(group).alias("group"), x.alias("x")).agg(F.count("*").alias("c"))
    sizes = counts.groupBy("group").agg(F.sum("c").alias("n"))
    quarter = F.floor((F.col("n") + 3) / 2) / 2
    places = sizes.select(F.col("group").alias("_g"), "n", *[f(p).cast("long").alias(f"{k}_{i}") for k, p in (("a", quarter), ("m", (F.col("n") + 1) / 2), ("b", F.col("n") + 1 - quarter)) for i, f in ((0, F.floor), (1, F.ceil))])
    ranked = cumulate(counts, ["group"], F.col("x"), upto=("sum", "c"))
    with_places = ranked.join(F.broadcast(places), ranked["group"].eqNullSafe(places["_g"])).drop("_g")  # one row per group
    at = {f"{k}_{i}": F.min(F.when(F.col("upto") >= F.col(f"{k}_{i}"), F.col("x"))).alias(f"x_{k}_{i}") for k in "amb" for i in (0, 1)}
    five = with_places.groupBy("group").agg(F.max("n").alias("n"), *at.values()).select(F.col("group").alias("_g"), "n", *[((F.col(f"x_{k}_0") + F.col(f"x_{k}_1")) / 2).alias(name) for k, name in (("a", "hinge_low"), ("m", "median"), ("b", "hinge_high"))])
    reach = 1.5 * (F.col("hinge_high") - F.col("hinge_low"))
    near = counts.join(F.broadcast(five), counts["group"].eqNullSafe(five["_g"]))
    inside = F.when(F.col("x").between(F.col("hinge_low") - reach, F.col("hinge_high") + reach), F.col("x"))
    return near.groupBy("group").agg(F.max("n").alias("n"), F.min(inside).alias("low"), F.max("hinge_low").alias("hinge_low"), F.max("median").alias("median"), F.max("hinge_high").alias("hinge_high"), F.max(inside).alias("high"))


def months(begin: Column, end: Column) -> Column:
    """Months between two dates, as days times 12 over 365."""
    return F.datediff(end, begin) * F.lit(12.0) / F.lit(365.0)
