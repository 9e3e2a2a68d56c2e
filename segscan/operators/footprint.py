"""Where on a chromosome the copy number moves: oscillation chains with their bounds, altered islands, state changes.

Windows find runs and islands; the segments of one chromosome in one run of the segmentation, which are few by nature,
are then gathered as one sorted array on which the bounds are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MB = 1e6


def longest_window(states: Column, k: int) -> Column:
    """``n, lo, hi``: the first of the longest windows with at most ``k`` distinct values in an array without equal neighbours.

    A fold; places count from 1. An empty array gives 0, 1, 0.
    """
    zero = F.struct(F.array().cast("array<struct<p:int,v:int>>").alias("last"), F.lit(1).alias("left"), F.lit(0).alias("i"), F.lit(0).alias("n"), F.lit(1).alias("lo"))

    def step(s: Column, v: Column) -> Column:
        i = s["i"] + 1
        seen = F.concat(F.filter(s["last"], lambda x: x["v"] != v), F.array(F.struct(i.alias("p"), v.alias("v"))))
        over = F.size(seen) > k
        left = F.when(over, F.element_at(seen, 1)["p"] + 1).otherwise(s["left"])
        better = i - left + 1 > s["n"]
        return F.struct(F.when(over, F.slice(seen, 2, k)).otherwise(seen).alias("last"), left.alias("left"), i.alias("i"), F.when(better, i - left + 1).otherwise(s["n"]).alias("n"), F.when(better, left).otherwise(s["lo"]).alias("lo"))

    return F.aggregate(states, zero, step, lambda s: F.struct(s["n"].alias("n"), s["lo"].alias("lo"), (s["lo"] + s["n"] - 1).alias("hi")))


def footprint(segments: DataFrame, key: tuple[str, ...] = ("facets_id", "chrom"), k: int = 3, more: dict[str, Column] | None = None) -> DataFrame:
    """One row per chromosome: spans of the longest oscillation chain, of altered segments and of state changes, in Mb.

    The chain skips segments without tcn, but counts those inside its bounds; without any tcn its spans are null and its
    counts 0. A segment is altered if its whole copy number (half to even) isn't the most frequent one, the lowest of
    equally frequent; islands of no length aren't counted. State changes compare pairs of whole copies; pairs with a null are one state.
    ``more``: other aggregates of the same groups, so that they need no scan and no join of their own.
    """
    more = more or {}
    along = Window.partitionBy(*key).orderBy("loc_start", "loc_end")
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = segments.withColumns({"_i": F.row_number().over(along), "_v": F.rint("tcn").cast("int"), "_w": F.rint("lcn").cast("int"), "_len": F.greatest(F.col("loc_end") - F.col("loc_start"), F.lit(0.0))})
    rows = rows.withColumn("_altered", F.coalesce(F.col("_v") != F.mode("_v", True).over(Window.partitionBy(*key)), F.lit(False)))
    # The value of the last segment before that has one, and whether this one begins a run of it.
    before = F.last("_v", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_pair", F.when(F.col("_v").isNotNull() & F.col("_w").isNotNull(), F.struct("_v", "_w")))
    same = F.lag("_pair").over(along).eqNullSafe(F.col("_pair"))
    rows = rows.withColumns({
        "_begins": F.col("_v").isNotNull() & ~F.coalesce(before == F.col("_v"), F.lit(False)),
        "_edge": F.col("_altered") & ~F.coalesce(F.lag("_altered").over(along), F.lit(False)),
        "_changed": (F.col("_i") > 1) & ~same,
    })
    rows = rows.withColumn("_island", F.when(F.col("_altered"), F.sum(F.col("_edge").cast("int")).over(upto)))
    rows = rows.withColumn("_island_len", F.when(F.col("_edge"), F.sum("_len").over(Window.partitionBy(*key, "_island"))))
    some = F.array_sort(F.collect_list(F.struct("_i", "loc_start", "loc_end", "_len", "_v", "_begins")))
    change_span = F.max(F.when(F.col("_changed"), F.col("loc_start"))) - F.min(F.when(F.col("_changed"), F.col("loc_start")))
    out = rows.groupBy(*key).agg(
        F.count("*").alias("n_segments"), (F.max("loc_end") - F.min("loc_start")).alias("_span"), F.coalesce(F.sum("_len"), F.lit(0.0)).alias("_total"),
        F.coalesce(F.sum(F.when(F.col("_altered"), F.col("_len"))), F.lit(0.0)).alias("_union"),
        F.coalesce(F.max(F.when(F.col("_altered"), F.col("loc_end"))) - F.min(F.when(F.col("_altered"), F.col("loc_start"))), F.lit(0.0)).alias("_altered_span"),
        F.count_if(F.col("_island_len") > 0).alias("n_altered_islands"), F.coalesce(F.max("_island_len"), F.lit(0.0)).alias("_largest"), F.coalesce(change_span, F.lit(0.0)).alias("_change_span"), some.alias("_s"), *[e.alias(n) for n, e in more.items()],
    )
    out = out.withColumn("_runs", F.filter("_s", lambda x: x["_begins"])).withColumn("_c", longest_window(F.transform("_runs", lambda x: x["_v"]), k))
    first = F.try_element_at("_runs", F.col("_c.lo"))["_i"]
    # The chain ends with the last segment that has a value before the next run begins.
    following = F.get("_runs", F.col("_c.hi"))["_i"]
    valued = F.filter("_s", lambda x: x["_v"].isNotNull() & F.coalesce(x["_i"] < F.col("_next"), F.lit(True)))
    out = out.withColumns({"_first": first, "_next": following}).withColumn("_last", F.try_element_at(valued, F.lit(-1))["_i"])
    chain = F.filter("_s", lambda x: x["_i"].between(F.col("_first"), F.col("_last")))
    out = out.withColumns({"_chain": F.coalesce(chain, F.array().cast(dict(out.dtypes)["_s"]))})
    out = out.withColumns({
        "_chain_span": F.try_element_at("_chain", F.lit(-1))["loc_end"] - F.try_element_at("_chain", F.lit(1))["loc_start"],
        "_chain_len": F.when(F.size("_chain") > 0, F.aggregate("_chain", F.lit(0.0), lambda a, x: a + F.coalesce(x["_len"], F.lit(0.0)))),
    })
    part = lambda a, b: F.try_divide(F.col(a), F.col(b))
    moves = F.col("_c.n") - 1
    return out.select(
        *key, *more, "n_segments", F.try_element_at("_chain", F.lit(1))["loc_start"].alias("osc_chain_start"), F.try_element_at("_chain", F.lit(-1))["loc_end"].alias("osc_chain_end"), (F.col("_span") / MB).alias("chrom_span_mb"), (F.col("_total") / MB).alias("chrom_seg_len_mb"),
        F.col("_c.n").alias("osc_chain"), F.size("_chain").alias("osc_chain_n_segments"), (F.size("_chain") / F.col("n_segments")).alias("osc_chain_frac_segments"), F.try_divide(F.greatest(F.col("_c.n") - 1, F.lit(0)), F.col("_chain_span") / MB).alias("osc_transition_density_per_mb"), (F.col("_chain_span") / MB).alias("osc_chain_span_mb"), (F.col("_chain_len") / MB).alias("osc_chain_len_sum_mb"),
        part("_chain_span", "_span").alias("osc_chain_frac_chrom"), part("_chain_len", "_total").alias("osc_chain_len_frac_chrom"),
        F.try_divide(F.col("_c.n"), F.col("_chain_span") / MB).alias("osc_chain_density_per_mb"), F.when(moves > 0, F.col("_chain_span") / MB / moves).alias("bp_per_osc_transition_mb"),
        (F.col("_union") / MB).alias("altered_union_mb"), part("_union", "_total").alias("altered_union_frac"), (F.col("_altered_span") / MB).alias("altered_span_mb"), part("_altered_span", "_span").alias("altered_span_frac"),
        "n_altered_islands", (F.col("_largest") / MB).alias("largest_altered_island_mb"), part("_largest", "_total").alias("largest_altered_island_frac"),
        (F.col("_change_span") / MB).alias("state_change_span_mb"), part("_change_span", "_span").alias("state_change_span_frac"),
    )
