"""Copy-number segments: spellings, order, runs, oscillation chains, per-chromosome features and the merge screen.

All of it is column expressions and windows over one partitioning, ``key`` (one run of the segmentation and one
chromosome). Null and NaN copy numbers are one thing, null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segscan.functions.text import bare_chrom, strip


def number(c: str) -> Column:
    """A double, null where it is null, NaN or infinite."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def chrom_order(c: Column) -> Column:
    """1 to 22 as written, X or 23: 23, Y or 24: 24, M or MT: 25, anything else 99."""
    up = F.upper(strip(c))
    return F.when(up == "X", 23).when(up == "Y", 24).when(up.isin("M", "MT"), 25).otherwise(F.coalesce(up.try_cast("int"), F.lit(99)))


def tcn_estimate(cnlr: Column, purity: Column, ploidy: Column) -> Column:
    """Total copy number from a log ratio: the mixture of tumour and normal solved for the tumour. Null without purity above 0."""
    normal = (F.lit(1.0) - purity) * 2
    return F.when(purity > 0, ((purity * ploidy + normal) * F.power(F.lit(2.0), cnlr) - normal) / purity)


def clean_segments(cncf: DataFrame) -> DataFrame:
    """One row per (facets_id, chrom, loc_start), the first delivered; ``chrom`` without prefix, missing numbers null.

    Rows without run, chromosome or start belong to no sequence and are left out.
    """
    values = ("sample_id", "loc_end", "num_mark", "cnlr_median", "tcn", "lcn")
    rows = cncf.select("sample_id", "facets_id", bare_chrom("chrom").alias("chrom"), number("loc_start").alias("loc_start"), number("loc_end").alias("loc_end"), "num_mark", number("cnlr_median").alias("cnlr_median"), number("tcn").alias("tcn"), number("lcn").alias("lcn"), "loaded_at", "row_id").dropna(subset=["facets_id", "chrom", "loc_start"])
    # An aggregate, not a window: copies are reduced before the shuffle, however many there are of one segment.
    first = rows.groupBy("facets_id", "chrom", "loc_start").agg(F.min_by(F.struct(*values), F.struct("loaded_at", "row_id")).alias("_r"))
    return first.select("_r.sample_id", "facets_id", "chrom", "loc_start", *[f"_r.{v}" for v in values if v != "sample_id"])


def longest_run(states: Column, k: int) -> Column:
    """The longest stretch of neighbours with at most ``k`` distinct values; equal neighbours count once. 0 for an empty array.

    A fold over an array of ints: the values in the window with the place of their last visit, oldest first.
    """
    zero = F.struct(F.array().cast("array<struct<p:int,v:int>>").alias("last"), F.lit(0).alias("left"), F.lit(0).alias("best"), F.lit(-1).alias("i"))

    def step(s: Column, v: Column) -> Column:
        repeat = F.coalesce(F.try_element_at(s["last"], F.lit(-1))["v"] == v, F.lit(False))
        i = s["i"] + 1
        last = F.concat(F.filter(s["last"], lambda x: x["v"] != v), F.array(F.struct(i.alias("p"), v.alias("v"))))
        over = F.size(last) > k
        left = F.when(over, F.element_at(last, 1)["p"] + 1).otherwise(s["left"])
        kept = F.when(over, F.slice(last, 2, k)).otherwise(last)
        pick = lambda new, old: F.when(repeat, old).otherwise(new)
        return F.struct(pick(kept, s["last"]).alias("last"), pick(left, s["left"]).alias("left"), pick(F.greatest(s["best"], i - left + 1), s["best"]).alias("best"), pick(i, s["i"]).alias("i"))

    return F.aggregate(states, zero, step, lambda s: s["best"])


def segment_features(segments: DataFrame, key: tuple[str, ...] = ("facets_id", "chrom")) -> DataFrame:
    """One row per chromosome of a run: oscillation, allelic and footprint features of its ordered segments.

    A segment with only one of both copy numbers is a state of its own; one with none changes the state, but isn't
    counted as one. ``chain_k``: longest stretch of at most k distinct whole copy numbers (half to even, nulls left out).
    """
    along = Window.partitionBy(*key).orderBy("loc_start", "loc_end")
    place = F.row_number().over(along)
    token = F.when(F.col("tcn").isNotNull() & F.col("lcn").isNotNull(), F.concat_ws("|", "tcn", "lcn")).otherwise(F.concat(F.lit("row"), F.col("_i")))
    rows = segments.withColumn("_i", place).withColumn("_token", token).withColumn("_len", F.greatest(F.col("loc_end") - F.col("loc_start"), F.lit(0.0)))
    before = lambda c: F.lag(c).over(along)
    rows = rows.withColumns({"_change": (F.col("_i") > 1) & (before("_token") != F.col("_token")), "_allelic": (F.col("_i") > 1) & ~F.coalesce(before("lcn") == F.col("lcn"), F.lit(False)), "_loh": F.coalesce(F.col("lcn") == 0, F.lit(False))})
    rows = rows.withColumn("_interleave", (F.col("_i") > 1) & (before("_loh") != F.col("_loh")))
    some = F.col("tcn").isNotNull() | F.col("lcn").isNotNull()
    out = rows.groupBy(*key).agg(
        F.count("*").alias("n_segments"), F.count_if("_change").alias("n_changes"), F.count_distinct(F.when(some, F.col("_token"))).alias("n_states"),
        F.count_if("_allelic").alias("n_allelic_changes"), F.count_if("_interleave").alias("loh_het_interleave"), F.avg(F.col("_loh").cast("double")).alias("frac_loh"),
        F.coalesce(F.max(F.rint("tcn")) - F.min(F.rint("tcn")), F.lit(0.0)).cast("int").alias("chain_cn_amplitude"), ((F.max("loc_end") - F.min("loc_start")) / 1e6).alias("chrom_span_mb"), (F.coalesce(F.sum("_len"), F.lit(0.0)) / 1e6).alias("chrom_seg_len_mb"),
        F.sum(F.when(F.rint("tcn") != 2, F.col("_len"))).alias("_non_two"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("tcn").isNotNull(), F.struct("_i", F.rint("tcn").cast("int").alias("v"))))), lambda x: x["v"]).alias("_states"),
    )
    excess = F.when(F.col("n_changes") > 0, (F.col("n_changes") - F.greatest(F.col("n_states") - 1, F.lit(0))) / F.col("n_changes")).otherwise(0.0)
    return out.withColumns({"oscillation_excess": excess, **{f"chain_k{k}": longest_run(F.col("_states"), k) for k in (2, 3, 4, 5)}, "frac_not_two": F.coalesce(F.col("_non_two"), F.lit(0.0)) / F.nullif(F.col("chrom_seg_len_mb") * 1e6, F.lit(0.0))}).drop("_states", "_non_two")


def run_structure(segments: DataFrame, key: tuple[str, ...] = ("facets_id", "chrom")) -> DataFrame:
    """One row per chromosome: ``n_changes, two_state_dominance, median_run_length, n_singleton_runs`` of the states along it.

    A state is a pair of copy numbers; a segment that lacks one is a state of its own. ``two_state_dominance``: of all
    changes the share of those between the two states that change into each other most often, 0 without changes.
    """
    along = Window.partitionBy(*key).orderBy("loc_start", "loc_end")
    token = F.when(F.col("tcn").isNotNull() & F.col("lcn").isNotNull(), F.concat_ws("|", "tcn", "lcn")).otherwise(F.concat(F.lit("row"), F.col("_i")))
    rows = segments.withColumn("_i", F.row_number().over(along)).withColumn("_token", token).withColumn("_before", F.lag("_token").over(along))
    rows = rows.withColumn("_new", (~F.coalesce(F.col("_before") == F.col("_token"), F.lit(False))).cast("int")).withColumn("_run", F.sum("_new").over(along))
    runs = rows.groupBy(*key, "_run").agg(F.count("*").alias("_len"), F.min(F.when(F.col("_new") == 1, F.struct(F.least("_before", "_token").alias("a"), F.greatest("_before", "_token").alias("b"), F.col("_before").isNotNull().alias("c")))).alias("_pair"))
    # Counted per length before the last step, so that a group of any length is a few rows.
    counts = runs.groupBy(*key, "_pair", "_len").agg(F.count("*").alias("_c"), F.count_if("_pair.c").alias("_n")).withColumn("_both", F.sum("_n").over(Window.partitionBy(*key, "_pair")))
    out = counts.groupBy(*key).agg(F.sum("_n").alias("n_changes"), F.max("_both").alias("_top"), F.percentile("_len", 0.5, F.col("_c")).alias("median_run_length"), F.coalesce(F.sum(F.when(F.col("_len") == 1, F.col("_c"))), F.lit(0)).alias("n_singleton_runs"))
    return out.select(*key, "n_changes", F.coalesce(F.try_divide("_top", "n_changes"), F.lit(0.0)).alias("two_state_dominance"), "median_run_length", "n_singleton_runs")


def merge_screen(segments: DataFrame, key: tuple[str, ...] = ("facets_id", "chrom"), least_raw: int = 5, least_merged: int = 3) -> DataFrame:
    """One row per chromosome with at least ``least_raw`` segments: neighbours of equal state merged, oscillations counted.

    ``basecn`` is the lowest tcn that stands more than once after merging; segments at or below it are base segments, and
    ``n_oscil`` is one more than the number of steps from another segment to one of them. Fewer than ``least_merged``
    merged segments: nulls. A segment without tcn is no base segment, but where the comparison is unknown (no tcn, or no
    tcn that stands twice) ``n_seg_basecn`` counts it and ``length_seg_basecn`` is null.
    """
    group = Window.partitionBy(*key)
    along = group.orderBy("loc_start", "loc_end")
    same = F.coalesce((F.col("tcn") == F.lag("tcn").over(along)) & (F.col("lcn") == F.lag("lcn").over(along)), F.lit(False))
    rows = segments.withColumn("_raw", F.count("*").over(group)).filter(F.col("_raw") >= least_raw).withColumn("_new", (~same).cast("int")).withColumn("_run", F.sum("_new").over(along))
    runs = rows.groupBy(*key, "_run").agg(F.first("tcn").alias("tcn"), F.min("loc_start").alias("loc_start"), F.max_by("loc_end", F.struct("loc_start", "loc_end")).alias("loc_end"))
    runs = runs.withColumn("_copies", F.count("tcn").over(Window.partitionBy(*key, "tcn"))).withColumn("basecn", F.min(F.when(F.col("_copies") > 1, F.col("tcn"))).over(group))
    by_run = group.orderBy("_run")
    low = F.col("tcn") <= F.col("basecn")
    runs = runs.withColumns({"_low": F.coalesce(low, F.lit(True)), "_base": F.coalesce(low, F.lit(False)), "_open": low.isNull()}).withColumn("_back", F.col("_base") & ~F.lag("_base").over(by_run))
    length = F.col("loc_end") - F.col("loc_start")
    out = runs.groupBy(*key).agg(
        F.count("*").alias("n_seg"), (F.count_distinct("tcn") + F.max(F.col("tcn").isNull().cast("int"))).alias("n_tcn_state"), F.first("basecn").alias("basecn"), (F.count_if("_back") + 1).alias("n_oscil"),
        F.count_if("_low").alias("n_seg_basecn"), F.when(~F.bool_or("_open"), F.sum(F.when(F.col("_base"), length))).alias("length_seg_basecn"), F.sum(length).alias("length_seg_total"),
    )
    names = ("basecn", "n_oscil", "n_seg_basecn", "length_seg_basecn", "length_seg_total")
    return out.withColumns({c: F.when(F.col("n_seg") >= least_merged, F.col(c)) for c in names})


def within_sample(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Adds to each column its ratio to the median of its group (null where that is 0) and its falling rank; null stays null."""
    group = Window.partitionBy(by)
    new = {}
    for c in columns:
        new[f"{c}_ratio"] = F.col(c) / F.nullif(F.median(c).over(group), F.lit(0.0))
        new[f"{c}_rank"] = F.when(F.col(c).isNotNull(), F.rank().over(group.orderBy(F.col(c).desc_nulls_last())))
    return df.withColumns(new)
