"""Changepoints of probe signals: penalised least squares per group, many groups to a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _live(starts: np.ndarray, cost: np.ndarray, s1: np.ndarray, s2: np.ndarray) -> np.ndarray:
    """Those of the rising ``starts`` that are best, or the earliest of the best, for some level of the segment they begin.

    For one level, a later start wins or loses against an earlier one by the same amount whatever follows: it loses in a
    range around the mean between the two. A start whose levels are all lost to others can never be needed again.
    """
    i, j = starts[:, None], starts[None, :]
    later, n = j > i, np.where(j > i, j - i, 1)
    mean = (s1[j] - s1[i]) / n
    room = cost[j] - cost[i] - (s2[j] - s2[i] - (s1[j] - s1[i]) ** 2 / n)
    wide = np.where(room >= -1e-9, np.sqrt(np.maximum(room + 1e-9, 0.0) / n), -np.inf)
    lo, hi = np.where(later, mean - wide, -np.inf).max(axis=1), np.where(later, mean + wide, np.inf).min(axis=1)
    radius = np.sqrt(np.maximum(room, 0.0) / n)
    lost = later & (room >= 0) & (lo[None, :] >= mean - radius) & (hi[None, :] <= mean + radius)
    return starts[(lo <= hi) & ~lost.any(axis=0)]


def breakpoints(x: np.ndarray, penalty: float, least: int = 5) -> list[int]:
    """Ends of the segments that minimise squared error plus ``penalty`` per boundary, each of ``least`` values or more.

    Starts that can't win any more are dropped, so the work grows almost in line with the number of values, with or without
    boundaries: a start that loses against the best way to end at b is dropped once a segment may begin at b, that is
    ``least`` values later; and when many are left, those that lose for every level of their segment. Of equal costs the
    earliest start counts. Fewer than ``2 * least`` values are one segment.
    """
    n = len(x)
    if n < 2 * least:
        return [n]
    s1, s2 = np.concatenate(([0.0], np.cumsum(x))), np.concatenate(([0.0], np.cumsum(x * x)))
    cost = np.full(n + 1, np.inf)
    cost[0] = -penalty
    came = np.zeros(n + 1, np.int64)
    # The starts in use, each with the first end for which it is not needed any more; ``soonest`` is the lowest of these.
    starts, until = np.zeros(n + 1, np.int64), np.full(n + 1, n + 1, np.int64)
    used, many, soonest = 1, 64, n + 1
    for b in range(least, n + 1):
        if b - least >= least:
            starts[used], until[used] = b - least, n + 1
            used += 1
        if soonest <= b:
            keep = np.flatnonzero(until[:used] > b)
            starts[: len(keep)], until[: len(keep)] = starts[keep], until[keep]
            used = len(keep)
            soonest = int(until[:used].min())
        mine = starts[:used]
        total = cost[mine] + (s2[b] - s2[mine] - (s1[b] - s1[mine]) ** 2 / (b - mine))
        i = int(total.argmin())
        cost[b], came[b] = total[i] + penalty, mine[i]
        lost = total > cost[b] + 1e-9
        if lost.any():
            own = until[:used]
            own[lost & (own > b + least)] = b + least
            soonest = min(soonest, b + least)
        if used > many:
            left = _live(mine.copy(), cost, s1, s2)
            until[: len(left)] = until[np.searchsorted(mine, left)]
            starts[: len(left)] = left
            used = len(left)
            many = max(64, 2 * used)
    ends, b = [], n
    while b > 0:
        ends.append(b)
        b = int(came[b])
    return ends[::-1]


def probe_segments(probes: DataFrame, key: list[str], position: str, value: str, penalty: float | str = 3.0, variance: str | None = None) -> DataFrame:
    """Key, ``seg, n_probes, first, last, level`` (median), ``mad`` (robust deviation), ``noise``, ``n_group``: one row per segment of each group.

    The boundary costs ``penalty`` (a number, or a column that is constant in a group) times the noise times the log of the
    count. The noise is a variance, from neighbouring differences or the median of the column ``variance`` over all rows
    of the group, whichever is larger. Null, NaN and infinite values and null positions are left out; ties in position are
    ordered by value.
    """
    schema = ", ".join(f"`{k}` {probes.schema[k].dataType.simpleString()}" for k in key) + ", seg int, n_probes long, first double, last double, level double, mad double, noise double, n_group long"

    def cut(x: np.ndarray, modelled: float, pen: float) -> tuple[list[int], float]:
        d = np.abs(np.diff(x))
        noise = max((1.4826 * float(np.median(d)) / 2**0.5) ** 2 if len(d) else 0.0, modelled if modelled > 0 else 0.0, 1e-4)
        return breakpoints(x, pen * noise * np.log(max(len(x), 2))), noise

    def whole(pdf: pd.DataFrame, begins: np.ndarray) -> pd.DataFrame:
        """The segments of the groups that begin at ``begins``, the last of which ends with the frame."""
        x, at, modelled, pen = (pdf[c].to_numpy() for c in ("_x", "_at", "_var", "_pen"))
        rows = []
        for b, e in zip(begins.tolist(), [*begins[1:].tolist(), len(x)]):
            ends, noise = cut(x[b:e], modelled[b], pen[b])
            for i, (lo, hi) in enumerate(zip([b, *(b + n for n in ends)], [b + n for n in ends])):
                level = float(np.median(x[lo:hi]))
                rows.append((b, i, hi - lo, at[lo], at[hi - 1], level, 1.4826 * float(np.median(np.abs(x[lo:hi] - level))), noise, e - b))
        out = pd.DataFrame(rows, columns=["_b", "seg", "n_probes", "first", "last", "level", "mad", "noise", "n_group"])
        return pd.concat([pdf[key].iloc[out["_b"]].reset_index(drop=True), out.drop(columns="_b")], axis=1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Many small groups share a batch; one that goes on in the next batch waits for its end, however many follow."""
        parts: list[pd.DataFrame] = []
        for pdf in batches:
            parts.append(pdf)
            if not pdf["_new"].any():
                continue
            pdf = pd.concat(parts, ignore_index=True)
            begins = np.flatnonzero(pdf["_new"].to_numpy())
            if len(begins) > 1:
                yield whole(pdf.iloc[: begins[-1]], begins[:-1])
            parts = [pdf.iloc[begins[-1] :]]
        if parts:
            yield whole(pd.concat(parts, ignore_index=True), np.array([0]))

    x = F.col(value).cast("double")
    group = Window.partitionBy(*key)
    modelled = F.lit(0.0) if variance is None else F.coalesce(F.median(F.when(~F.isnan(F.col(variance).cast("double")), F.col(variance).cast("double"))).over(group), F.lit(0.0))
    rows = probes.withColumn("_var", modelled).filter(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")) & F.col(position).isNotNull())
    rows = rows.select(*key, F.col(position).cast("double").alias("_at"), x.alias("_x"), "_var", (F.col(penalty).cast("double") if isinstance(penalty, str) else F.lit(float(penalty))).alias("_pen"))
    new = F.row_number().over(group.orderBy("_at", "_x")) == 1
    return rows.withColumn("_new", new).mapInPandas(run, schema)
