"""Repeated consecutive events: each run of identical or near-identical events becomes one, with count and duration.

Per entity the events are cut into runs by optimal segmentation: the sum of squared distances of the events from
their run's mean, plus a penalty for each boundary, is made as small as possible. Two prunings keep this exact and
fast: no boundary ever parts identical neighbours, so those are one weighted event; and a start of the last run that
can't become best any more is dropped (the rule of PELT). All entities of a batch advance in step, in numpy.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segscan.operators.joins import lookup
from segscan.sources.tables import checkpointed

#: An entity with more events than this is cut into ranges, whose ends are segmented together.
HOT_EVENTS = 200_000
#: Beyond so many distinct neighbours of one entity, those before a certain boundary are segmented at once.
MOST_TOKENS = 4096


def segment(values: np.ndarray, weights: np.ndarray, block: np.ndarray, penalty: float, ends: list | None = None) -> np.ndarray:
    """True at each event that begins a run; ``block`` numbers the sequences, which stand one after another.

    Of equally good segmentations the one whose last runs are longest is taken. ``ends`` is for one sequence of two events or
    more: it gets the starts of a last run that remain and, for each number of events, the best start of the last run.
    """
    n = len(block)
    if n == 0:
        return np.zeros(0, bool)
    begin = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    size = np.diff(np.concatenate((begin, [n])))
    starts = np.zeros(n, bool)
    starts[begin] = True
    long = size > 1
    if not long.any():
        return starts
    order = np.argsort(-size[long], kind="stable")
    begin, size = begin[long][order], size[long][order]
    w = np.concatenate(([0.0], np.cumsum(weights)))
    s = np.vstack((np.zeros(values.shape[1]), np.cumsum(values * weights[:, None], axis=0)))
    q = np.concatenate(([0.0], np.cumsum((values**2).sum(axis=1) * weights)))
    best = np.zeros(n + len(begin) + 1)  # best[at + j]: the cost of the first j events of the sequence
    at = begin + order  # one more cell than events for each sequence before this one
    came = np.zeros(n + len(begin) + 1, np.int64)
    best[at] = -penalty
    cand_seq = np.arange(len(begin))
    cand_pos = np.zeros(len(begin), np.int64)
    for j in range(1, int(size[0]) + 1):
        alive = int(np.searchsorted(-size, -j, side="right"))
        if alive < len(begin):
            keep = cand_seq < alive
            cand_seq, cand_pos = cand_seq[keep], cand_pos[keep]
        lo, hi = begin[cand_seq] + cand_pos, begin[cand_seq] + j
        cost = q[hi] - q[lo] - ((s[hi] - s[lo]) ** 2).sum(axis=1) / (w[hi] - w[lo])
        upto = best[at[cand_seq] + cand_pos] + np.where(cost > 1e-9, cost, 0.0)
        edge = np.flatnonzero(np.concatenate(([True], cand_seq[1:] != cand_seq[:-1])))
        least = np.minimum.reduceat(upto, edge)
        per = np.repeat(least, np.diff(np.concatenate((edge, [len(upto)]))))
        hit = np.flatnonzero(upto <= per + 1e-9)
        first = hit[np.concatenate(([True], cand_seq[hit][1:] != cand_seq[hit][:-1]))]
        spot = at[:alive] + j
        best[spot] = least + penalty
        came[spot] = cand_pos[first]
        keep = upto <= per + penalty + 1e-9
        cand_seq = np.concatenate((cand_seq[keep], np.arange(alive)))
        cand_pos = np.concatenate((cand_pos[keep], np.full(alive, j)))
        if alive > 1:
            order = np.lexsort((cand_pos, cand_seq))
            cand_seq, cand_pos = cand_seq[order], cand_pos[order]
    if ends is not None:
        ends += [cand_pos, came[at[0] :]]
    pos = size.copy()
    seq = np.arange(len(begin))
    while len(seq):
        pos[seq] = came[at[seq] + pos[seq]]
        starts[begin[seq] + pos[seq]] = True
        seq = seq[pos[seq] > 0]
    return starts


def _fresh(table: pa.Table, entity: list[str]) -> np.ndarray:
    """True at each row whose entity is not that of the row before."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for c in entity:
        x = table.column(c).combine_chunks()
        new[1:] |= pc.not_equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False)
    return new


def _values(table: pa.Table, features: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The features, and where one of them is missing."""
    values = np.column_stack([table.column(c).to_numpy(zero_copy_only=False).astype(float) for c in features])
    return values, np.isnan(values).any(axis=1)


def _tokens(table: pa.Table, entity: list[str], features: list[str]) -> pa.Table:
    """Identical neighbours of one entity as one row, with their number in ``_n``; missing ones stay apart."""
    values, void = _values(table, features)
    new = _fresh(table, entity) | void
    new[1:] |= void[:-1] | (values[1:] != values[:-1]).any(axis=1)
    first = np.flatnonzero(new)
    if len(first) == table.num_rows:
        return table
    last = np.concatenate((first[1:], [table.num_rows])) - 1
    changed = {"_end": table.column("_end").take(pa.array(last)), "_n": pa.array(np.add.reduceat(table.column("_n").to_numpy(), first))}
    head = table.take(pa.array(first))
    return pa.table([changed.get(c, head.column(c)) for c in table.schema.names], schema=table.schema)


def _runs(table: pa.Table, entity: list[str], features: list[str], penalty: float, apart: np.ndarray | None = None) -> pa.Table:
    """Runs of the tokens, which are sorted by entity and start; ``apart`` is true where a token is known to begin a run."""
    values, void = _values(table, features)
    forced = _fresh(table, entity) | void | np.concatenate(([False], void[:-1]))
    if apart is not None:
        forced |= apart
    values = np.where(void[:, None], 0.0, values)
    weight = table.column("_n").to_numpy()
    return _summed(table, entity, features, np.flatnonzero(segment(values, weight.astype(float), np.cumsum(forced), penalty)))


def _summed(table: pa.Table, entity: list[str], features: list[str], begins: np.ndarray) -> pa.Table:
    """Tokens taken together from each of ``begins`` to the next: count, sums and ends."""
    values, void = _values(table, features)
    values = np.where(void[:, None], 0.0, values)
    weight = table.column("_n").to_numpy()
    last = np.concatenate((begins[1:], [table.num_rows])) - 1
    sums = [np.add.reduceat(values[:, i] * weight, begins) for i in range(len(features))]
    square = np.add.reduceat((values**2).sum(axis=1) * weight, begins)
    head = table.take(pa.array(begins))
    out = {**{c: head.column(c) for c in entity}, "run_start": head.column("_start"), "run_end": table.column("_end").take(pa.array(last)), "n_events": pa.array(np.add.reduceat(weight, begins)), "missing": pa.array(void[begins])}
    out |= {f"sum_{c}": pa.array(x) for c, x in zip(features, sums)} | {"sum_squares": pa.array(square)}
    return pa.table(out)


def _certain(table: pa.Table, entity: list[str], features: list[str], penalty: float) -> np.ndarray:
    """The tokens, but the first, before which every optimal segmentation has a boundary, whatever stands around the table.

    Two neighbours, both taken out of a run that holds them, become runs of their own at three boundaries at most. Where
    the pair alone costs more than these, it is never in one run; more events in either token only add to that cost.
    """
    values, void = _values(table, features)
    w = table.column("_n").to_numpy().astype(float)
    far = w[1:] * w[:-1] / (w[1:] + w[:-1]) * ((values[1:] - values[:-1]) ** 2).sum(axis=1) > 3 * penalty
    return np.flatnonzero(far | void[1:] | void[:-1] | _fresh(table, entity)[1:]) + 1


def _settled_cut(table: pa.Table, features: list[str], penalty: float) -> int:
    """The last token before which there is a boundary whatever events follow the table, or 0 if there is none.

    Every start that can still become best leads back through the best starts before it; a start that all of them lead
    back to is settled. The last token may still grow and is left aside.
    """
    values, _ = _values(table.slice(0, table.num_rows - 1), features)
    weight = table.column("_n").to_numpy()[:-1].astype(float)
    ends: list = []
    segment(values, weight, np.zeros(len(weight), np.int64), penalty, ends)
    starts, came = ends
    open_ = {-int(x) for x in starts}
    heap = list(open_)
    heapq.heapify(heap)
    while len(heap) > 1:
        back = -int(came[-heapq.heappop(heap)])
        if back not in open_:
            open_.add(back)
            heapq.heappush(heap, back)
    return -heap[0]


def collapse_runs(events: DataFrame, entity: list[str], start: str, end: str, features: list[str], penalty: float, tie: list[str] | None = None, hot_events: int = HOT_EVENTS, most_tokens: int = MOST_TOKENS) -> DataFrame:
    """One row per run: the entity's columns, ``run_start``, ``run_end``, ``n_events``, ``duration``, ``missing`` and the means of the features.

    Events of an entity are ordered by ``start``; of several with one start the first by ``tie`` counts. An event
    with a null or NaN feature is a run by itself (``missing``) and ends the run before it. Events with a null
    start or a null in the entity belong to no sequence and are left out. ``run_end`` is the end of the run's last event.
    With whole-numbered features and a penalty below 1/4, exactly the maximal runs of equal events come out: a
    run that holds c changes costs at least c/4 more than its parts. Larger penalties join near-identical ones.

    Entities are hashed to tasks. One with more than ``hot_events`` events is cut into ranges of start. A range segments
    what lies between its first and its last certain boundary; the tokens outside, up to the certain boundary of the next
    range, are segmented together, so the result is the same, to the last boundary, as without ranges. Beyond ``most_tokens``
    distinct neighbours a task segments what lies before the last certain boundary; where there is none, it holds
    them until there is one.
    """
    number = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in features}
    tie = tie or []
    rows = events.filter(F.col(start).isNotNull()).select(*entity, F.col(start).cast("double").alias("_start"), F.col(end).cast("double").alias("_end"), *[e.alias(f"_f_{c}") for c, e in number.items()], *[F.col(c).alias(f"_t_{c}") for c in tie])
    for c in entity:
        rows = rows.filter(F.col(c).isNotNull())
    names = [f"_f_{c}" for c in features]
    schema = T.StructType([events.schema[c] for c in entity])
    for c, kind in (("run_start", "double"), ("run_end", "double"), ("n_events", "long"), ("missing", "boolean"), *((f"sum_{n}", "double") for n in names), ("sum_squares", "double"), ("edge", "integer")):
        schema = schema.add(c, kind)

    def run(batches: Iterator[pa.RecordBatch], ranges: bool = False) -> Iterator[pa.RecordBatch]:
        """``edge`` is -1 for runs; tokens before the first certain boundary of a range have an even number, those after the last the next odd one."""
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        keep = [*entity, "_start", "_end", *names]
        rest: pa.Table | None = None
        before: pa.Table | None = None  # the last event, as it may be delivered again
        patience = wait = 16 * most_tokens
        opened = not ranges  # whether the rest begins where a run begins

        def tell(runs: pa.Table, edge: int) -> Iterator[pa.RecordBatch]:
            yield from runs.append_column("edge", pa.array(np.full(runs.num_rows, edge, np.int32))).combine_chunks().to_batches()

        def tokens(table: pa.Table, edge: int) -> Iterator[pa.RecordBatch]:
            return tell(_summed(table, entity, names, np.arange(table.num_rows)), edge)

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]).select(keep)
            table = pa.concat_tables([before, table]) if before is not None else table
            at = table.column("_start").to_numpy()
            once = _fresh(table, entity) | np.concatenate(([True], at[1:] != at[:-1]))
            once[:1] = before is None
            before = table.slice(table.num_rows - 1)
            table = table.filter(pa.array(once))
            if not table.num_rows:
                continue
            table = table.append_column("_n", pa.array(np.ones(table.num_rows, np.int64)))
            rest = _tokens(pa.concat_tables([rest, table]) if rest is not None else table, entity, names)
            if not opened:
                if rest.num_rows < wait:
                    continue
                hits = _certain(rest, entity, names, penalty)
                wait = 2 * rest.num_rows
                if not len(hits):
                    continue
                yield from tokens(rest.slice(0, hits[0]), 2 * task)
                rest, opened = rest.slice(hits[0]), True
            cut = int(np.flatnonzero(_fresh(rest, entity))[-1])
            if rest.num_rows - cut > most_tokens:
                tail = rest.slice(cut)
                hits = _certain(tail, entity, names, penalty)
                found = int(hits[-1]) if len(hits) else 0
                if not found and tail.num_rows > patience:
                    found = _settled_cut(tail, names, penalty)
                    patience = 16 * most_tokens if found else 2 * tail.num_rows
                cut += found
            if cut:
                yield from tell(_runs(rest.slice(0, cut), entity, names, penalty), -1)
            rest = rest.slice(cut)
        if rest is None or not rest.num_rows:
            return
        if not ranges:
            yield from tell(_runs(rest, entity, names, penalty), -1)
            return
        hits = _certain(rest, entity, names, penalty)
        if not opened:
            yield from tokens(rest.slice(0, hits[0]) if len(hits) else rest, 2 * task)
            if not len(hits):
                return
            rest, hits = rest.slice(hits[0]), hits[1:] - hits[0]
        if len(hits):
            yield from tell(_runs(rest.slice(0, hits[-1]), entity, names, penalty), -1)
            rest = rest.slice(hits[-1])
        yield from tokens(rest, 2 * task + 1)

    order = [*entity, "_start", *[f"_t_{c}" for c in tie]]
    hot = checkpointed(rows.groupBy(entity[0]).count().filter(F.col("count") > hot_events).select(entity[0], F.lit(True).alias("_hot")))
    if hot.isEmpty():
        runs = rows.repartition(*entity).sortWithinPartitions(*order).mapInArrow(run, schema)
    else:
        marked = lookup(rows, hot, [entity[0]], F.col("_start"))
        cold = marked.filter(F.col("_hot").isNull()).drop("_hot").repartition(*entity).sortWithinPartitions(*order).mapInArrow(run, schema)
        split = marked.filter("_hot").drop("_hot").repartitionByRange(*entity, "_start").sortWithinPartitions(*order).mapInArrow(lambda b: run(b, True), schema)

        def joined(pdf: pd.DataFrame) -> pd.DataFrame:
            """The runs of one entity's tokens at the edges of ranges; what a range has between its two edges parts them."""
            pdf = pdf.sort_values("run_start", ignore_index=True)
            edge = pdf["edge"].to_numpy()
            apart = np.concatenate(([False], (edge[1:] % 2 == 1) & (edge[1:] == edge[:-1] + 1)))
            cells = {c: pdf[c] for c in entity} | {"_start": pdf["run_start"], "_end": pdf["run_end"], "_n": pdf["n_events"]} | {n: (pdf[f"sum_{n}"] / pdf["n_events"]).where(~pdf["missing"]) for n in names}
            out = _runs(pa.Table.from_pandas(pd.DataFrame(cells), preserve_index=False), entity, names, penalty, apart).to_pandas()
            return out.assign(edge=-1)[list(pdf.columns)]

        runs = cold.unionByName(split.filter("edge < 0")).unionByName(split.filter("edge >= 0").groupBy(*entity).applyInPandas(joined, schema))
    return runs.select(*entity, "run_start", "run_end", "n_events", (F.col("run_end") - F.col("run_start")).alias("duration"), "missing", *[F.when(~F.col("missing"), F.col(f"sum__f_{c}") / F.col("n_events")).alias(f"mean_{c}") for c in features])
