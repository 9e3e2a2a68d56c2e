"""Calls and scores against the truth: per chromosome, per sample, over thresholds, with intervals, and as registers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segscan.operators.running import cumulate

TALLIES = ("pos_recovered", "pos_missed", "neg_false_positive", "sample_errors")


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def chromosome_outcome(call: Column, truth: Column) -> Column:
    """caught, MISSED, false_positive or true_negative; a null call is no call, a null truth is false."""
    c, t = _true(call), _true(truth)
    return F.when(t & c, "caught").when(t, "MISSED").when(c, "false_positive").otherwise("true_negative")


def classifier_report(df: DataFrame, sample: str, call: Column, truth: Column) -> DataFrame:
    """One row: the four counts of chromosomes, and of samples ``n_positive, recovered, missed, sample_false_positive, errors``.

    A positive sample is recovered if a true chromosome of it is called, a negative one a false positive if any is. Rows
    without a sample are one sample. Counts are reduced per sample before the shuffle.
    """
    c, t = _true(call), _true(truth)
    per = df.groupBy(sample).agg(*[F.count_if(x).alias(n) for n, x in (("caught", t & c), ("missed_chrom", t & ~c), ("false_positive", c & ~t), ("true_negative", ~c & ~t))])
    pos, rec, any_ = F.col("caught") + F.col("missed_chrom") > 0, F.col("caught") > 0, F.col("caught") + F.col("false_positive") > 0
    out = per.agg(
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("caught", "missed_chrom", "false_positive", "true_negative")],
        F.count_if(pos).alias("n_positive"), F.count_if(pos & rec).alias("recovered"), F.count_if(pos & ~rec).alias("missed"), F.count_if(~pos & any_).alias("sample_false_positive"),
    )
    return out.withColumn("errors", F.col("missed") + F.col("sample_false_positive"))


def sample_extremes(df: DataFrame, sample: str, score: Column, truth: Column) -> DataFrame:
    """``sample, positive, best, best_true``: the highest score of a sample and that of its true chromosomes. Missing scores are never called."""
    x = F.when(~F.isnan(score.cast("double")), score.cast("double"))
    return df.groupBy(F.col(sample).alias("sample")).agg(F.bool_or(_true(truth)).alias("positive"), F.max(x).alias("best"), F.max(F.when(_true(truth), x)).alias("best_true"))


def sample_sweep(df: DataFrame, sample: str, score: Column, truth: Column, thresholds: list[float]) -> DataFrame:
    """One row per threshold: ``n_pos, n_neg, pos_recovered, pos_missed, neg_correct, neg_false_positive, sample_errors``.

    A sample's two highest scores tell all thresholds apart, so that one pass counts for all of them.
    """
    per = sample_extremes(df, sample, score, truth)
    pos = F.col("positive")
    counts = [e.alias(f"{n}_{i}") for i, t in enumerate(thresholds) for n, e in (("r", F.count_if(pos & (F.col("best_true") >= t))), ("f", F.count_if(~pos & (F.col("best") >= t))))]
    one = per.agg(F.count_if(pos).alias("p"), F.count_if(~pos).alias("n"), *counts)
    rows = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"r_{i}").alias("pos_recovered"), F.col(f"f_{i}").alias("neg_false_positive")) for i, t in enumerate(thresholds)])).alias("_t")
    out = one.select("p", "n", rows).select("_t.threshold", F.col("p").alias("n_pos"), F.col("n").alias("n_neg"), "_t.pos_recovered", "_t.neg_false_positive")
    return out.withColumns({"pos_missed": F.col("n_pos") - F.col("pos_recovered"), "neg_correct": F.col("n_neg") - F.col("neg_false_positive")}).withColumn("sample_errors", F.col("pos_missed") + F.col("neg_false_positive"))


def best_threshold(sweep: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per ``by`` (none: of all) the row of fewest ``sample_errors``, then most recovered, then the lowest threshold."""
    rest = [c for c in sweep.columns if c not in (by or [])]
    return sweep.groupBy(*(by or [])).agg(F.min_by(F.struct(*rest), F.struct("sample_errors", -F.col("pos_recovered"), "threshold")).alias("_b")).select(*(by or []), "_b.*")


def bootstrap(points: DataFrame, n_boot: int = 2000, seed: int = 0) -> DataFrame:
    """``points`` (rows of ``sample_sweep``) with ``_lo`` and ``_hi`` of each tally: 95 in 100 resamples of whole samples lie between.

    Drawing n samples with replacement and counting their outcomes is one draw of the multinomial distribution of the
    four outcomes, so resamples cost the same however many samples there are. The same seed gives the same rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, r in enumerate(pdf.to_dict("records")):
                counts = np.array([r["pos_recovered"], r["pos_missed"], r["neg_correct"], r["neg_false_positive"]], float)
                n = int(counts.sum())
                draws = np.random.default_rng([seed, int(round(r["threshold"] * 1e6)) & 0xFFFFFFFF]).multinomial(n, counts / n, n_boot) if n else np.zeros((n_boot, 4))
                for name, x in zip(TALLIES, (draws[:, 0], draws[:, 1], draws[:, 3], draws[:, 1] + draws[:, 3])):
                    pdf.loc[pdf.index[i], [f"{name}_lo", f"{name}_hi"]] = np.percentile(x, [2.5, 97.5])
            for name in TALLIES:
                if f"{name}_lo" not in pdf:
                    pdf[f"{name}_lo"] = pdf[f"{name}_hi"] = pd.Series(dtype=float)
            yield pdf

    schema = points.schema.simpleString()[7:-1]
    return points.mapInPandas(run, schema + "".join(f",{n}_{e}:double" for n in TALLIES for e in ("lo", "hi")))


def sample_codes(df: DataFrame, sample: str, truth: Column) -> DataFrame:
    """``sample, code``: C01, C02 and so on for the samples with a true row, by name; as wide as the number of samples needs, two digits at least."""
    named = df.filter(_true(truth) & F.col(sample).isNotNull()).select(F.col(sample).alias("sample")).distinct()
    size = named.agg(F.greatest(F.lit(2), F.length(F.count("*").cast("string"))).alias("_w"))  # one row
    return cumulate(named, [], F.col("sample"), _n=("count", "sample")).crossJoin(F.broadcast(size)).select("sample", F.concat(F.lit("C"), F.expr("lpad(cast(_n AS string), _w, '0')")).alias("code"))


def positive_register(df: DataFrame, sample: str, truth: Column, score: str, threshold: float, columns: list[str]) -> DataFrame:
    """The true rows: ``code``, ``columns``, the score, ``nominated`` and ``status`` (caught or MISSED); a missing score is not nominated."""
    true = df.filter(_true(truth))
    called = _true(F.col(score) >= threshold)
    codes = sample_codes(df, sample, truth).withColumnRenamed("sample", "_sample")
    return true.join(codes, true[sample] == codes["_sample"], "left").select("code", *columns, score, called.alias("nominated"), F.when(called, "caught").otherwise("MISSED").alias("status"))


def false_positive_register(df: DataFrame, sample: str, truth: Column, score: str, threshold: float, columns: list[str]) -> DataFrame:
    """The rows called but not true: ``sample``, ``columns``, the score and ``fp_type``: pos_sample_wrong_chrom where the sample has a true row, else neg_sample."""
    per = df.groupBy(F.col(sample).alias("_sample")).agg(F.bool_or(_true(truth)).alias("_positive"))
    wrong = df.filter(~_true(truth) & _true(F.col(score) >= threshold))
    return wrong.join(per, wrong[sample].eqNullSafe(per["_sample"]), "left").select(sample, *columns, score, F.when(F.col("_positive"), "pos_sample_wrong_chrom").otherwise("neg_sample").alias("fp_type"))


def residual(df: DataFrame, y: str, x: str, least: int = 11) -> DataFrame:
    """Adds ``{y}_residual``: ``y`` less its line over log(1 + x), fitted on all rows that have both; null below ``least`` of these."""
    both = df.select(F.col(y).cast("double").alias("_y"), F.log1p(F.col(x).cast("double")).alias("_x")).dropna()
    line = both.agg(F.count("*").alias("_n"), F.regr_slope("_y", "_x").alias("_b1"), F.regr_intercept("_y", "_x").alias("_b0"))  # one row
    value = F.when(F.col("_n") >= least, F.col(y) - (F.col("_b0") + F.col("_b1") * F.log1p(F.col(x).cast("double"))))
    return df.crossJoin(F.broadcast(line)).withColumn(f"{y}_residual", value).drop("_n", "_b0", "_b1")


def calibration(df: DataFrame, penalty: str, count: str, truth: Column) -> DataFrame:
    """Per penalty: median and mean of ``count`` on negative and positive rows, the 90th percentile on negative ones, and how many there are."""
    t = _true(truth)
    neg, pos = F.when(~t, F.col(count)), F.when(t, F.col(count))
    return df.filter(F.col(penalty).isNotNull() & F.col(count).isNotNull()).groupBy(penalty).agg(
        F.median(neg).alias("neg_median"), F.round(F.avg(neg), 2).alias("neg_mean"), F.percentile(neg, 0.9).alias("neg_p90"),
        F.median(pos).alias("pos_median"), F.round(F.avg(pos), 2).alias("pos_mean"), F.count(neg).alias("n_neg"), F.count(pos).alias("n_pos"),
    )
