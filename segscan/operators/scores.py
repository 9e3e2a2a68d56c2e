"""Scores of a chromosome from its features, as column expressions, and nominations from the scores."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ramps:
    """Where each ramp begins and ends, and what is left of a factor at its foot."""

    oscillation: tuple[float, float] = (2.0, 6.0)
    allelic: tuple[float, float] = (1.0, 6.0)
    allelic_floor: float = 0.25
    least_marks: int = 4
    weights: tuple[float, float] = (0.6, 0.4)
    purity: tuple[float, float, float] = (0.05, 0.35, 0.15)
    marks: tuple[float, float, float] = (4.0, 15.0, 0.15)
    noise: tuple[float, float, float] = (0.05, 0.30, 0.15)
    chain_first: float = 0.5
    loh_extent: tuple[float, float] = (0.30, 0.70)
    suppress: tuple[float, float, float] = (0.0, 3.0, 0.0)
    threshold: float = 0.35
    sum_threshold: float = 0.558
    noise_max: float = 1.135
    least_chain: int = 5
    least_span: float = 0.25
    least_union: float = 0.15
    most_islands: int = 3


def ramp(x: Column, lo: float, hi: float) -> Column:
    """0 up to ``lo``, 1 from ``hi``, linear between; a step at ``hi`` if that isn't above ``lo``. Null stays null."""
    inner = F.least(F.greatest((x - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0)) if hi > lo else (x >= hi).cast("double")
    return F.when(x.isNotNull(), inner)


def combine(how: str, o: Column, a: Column, r: Ramps = Ramps()) -> Column:
    """Oscillation and allelic factor as one: sum, product, min, geom, osc_primary or noisy_and; another name raises ValueError."""
    wo, wa = r.weights
    ways = {
        "sum": lambda: wo * o + wa * a,
        "product": lambda: o * a,
        "min": lambda: F.least(o, a),
        "geom": lambda: F.pow(o, F.lit(wo)) * F.pow(a, F.lit(wa)),
        "osc_primary": lambda: o * (r.chain_first + (1 - r.chain_first) * a),
        "noisy_and": lambda: 1 - (1 - o) * (1 - a) * (1 - F.least(o, a)),
    }
    if how not in ways:
        raise ValueError(f"unknown combination {how!r}; known: {', '.join(ways)}")
    return ways[how]()


@dataclass(frozen=True)
class Gates:
    """What weakens or adds evidence where it is switched on; all off by default.

    ``amplitude``: (copies, least) below which oscillation counts nothing. ``levels``: (levels, most, penalty), each level
    above ``most`` takes that part of the oscillation. ``loh``: share of the chromosome without the minor copy, as other
    evidence for the allelic factor. ``probe_chain``: a chain found in the probes, where it is longer.
    """

    amplitude: tuple[Column, float] | None = None
    levels: tuple[Column, int, float] | None = None
    loh: Column | None = None
    probe_chain: Column | None = None


def evidence(chain: Column, interleave: Column, marks: Column, how: str = "sum", r: Ramps = Ramps(), gates: Gates = Gates()) -> Column:
    """Evidence from 0 to 1; missing counts are 0. Too few marks leave the allelic factor at its floor."""
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    longest = zero(chain) if gates.probe_chain is None else F.greatest(zero(chain), zero(gates.probe_chain))
    o = ramp(longest, *r.oscillation)
    if gates.amplitude:
        o = F.when(zero(gates.amplitude[0]) >= gates.amplitude[1], o).otherwise(0.0)
    if gates.levels:
        levels, most, penalty = gates.levels
        o = o * F.pow(F.lit(1.0 - penalty), F.greatest(zero(levels) - most, F.lit(0.0)))
    allelic = ramp(zero(interleave), *r.allelic)
    if gates.loh is not None:
        allelic = F.greatest(allelic, ramp(zero(gates.loh), *r.loh_extent))
    raw = F.when(zero(marks) >= r.least_marks, allelic).otherwise(0.0)
    return combine(how, o, r.allelic_floor + (1 - r.allelic_floor) * raw, r)


def quality(purity: Column, marks: Column, noise: Column, r: Ramps = Ramps()) -> Column:
    """Weight from purity, marks and noise, each with a floor; null without purity, missing noise counts as high."""
    floored = lambda x, lo, hi, least: least + (1 - least) * ramp(x, lo, hi)
    lo, hi, least = r.noise
    calm = least + (1 - least) * (1 - ramp(F.coalesce(noise, F.lit(hi)), lo, hi))
    return floored(purity, *r.purity) * floored(F.coalesce(marks.cast("double"), F.lit(0.0)), *r.marks) * calm


def suppressed(score: Column, confidence: Column, r: Ramps = Ramps()) -> Column:
    """The score weakened where the confidence of the probes is low; missing ones count as 0."""
    begin, full, least = r.suppress
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return zero(score) * (least + (1 - least) * ramp(zero(confidence), begin, max(full, begin + 1e-9)))


def nominate(df: DataFrame, score: str, noise: str, by_span: bool = False, by_chain: bool = True, r: Ramps = Ramps()) -> DataFrame:
    """Adds ``score_pass, noise_veto, weak_footprint, nominated``.

    A footprint is weak if little is altered in few islands, or, ``by_span``, if its span is small; missing spans and
    unions are weak, missing noise is no veto, missing islands are 0. ``by_chain``: short chains aren't nominated.
    """
    below = lambda c, least: F.coalesce(F.col(c) < least, F.lit(True))
    weak = [below("altered_union_frac", r.least_union) & (F.coalesce("n_altered_islands", F.lit(0)) <= r.most_islands)]
    weak += [below("altered_span_frac", r.least_span)] if by_span else []
    out = df.withColumns({"score_pass": F.coalesce(F.col(score) >= r.threshold, F.lit(False)), "noise_veto": F.coalesce(F.col(noise) > r.noise_max, F.lit(False)), "weak_footprint": reduce(lambda a, b: a | b, weak)})
    chain = F.coalesce(F.col("osc_chain") >= r.least_chain, F.lit(False)) if by_chain else F.lit(True)
    return out.withColumn("nominated", F.col("score_pass") & chain & ~F.col("noise_veto") & ~F.col("weak_footprint"))


def nominate_by_noise(df: DataFrame, score: str, noise: str, truth: Column, noise_max: float | None = None, r: Ramps = Ramps()) -> DataFrame:
    """Adds ``score_pass, noise_max, noise_veto, nominated``: a threshold on the score and a veto on the noise.

    Without ``noise_max`` it is the highest noise of the true rows that pass, so that the veto loses none of them; none
    of these, no veto.
    """
    passed = df.withColumn("score_pass", F.coalesce(F.col(score) >= r.sum_threshold, F.lit(False)))
    known = F.when(~F.isnan(F.col(noise).cast("double")), F.col(noise).cast("double"))
    if noise_max is None:
        limit = passed.agg(F.max(F.when(F.col("score_pass") & F.coalesce(truth, F.lit(False)), known)).alias("noise_max"))  # one row
        passed = passed.crossJoin(F.broadcast(limit))
    else:
        passed = passed.withColumn("noise_max", F.lit(noise_max))
    out = passed.withColumn("noise_veto", F.coalesce(known > F.col("noise_max"), F.lit(False)))
    return out.withColumn("nominated", F.col("score_pass") & ~F.col("noise_veto"))


def flag_samples(df: DataFrame, sample: str, call: str) -> DataFrame:
    """``sample, flagged``: whether any chromosome of the sample is called; null calls are no calls."""
    return df.groupBy(sample).agg(F.coalesce(F.bool_or(call), F.lit(False)).alias("flagged"), F.count_if(F.col(call)).alias("n_nominated"))
