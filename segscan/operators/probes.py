"""Probe signals of a chromosome: counts, dispersion, noise, states from a rolling median, and features of changepoints.

All of it is windows and aggregates over one partitioning; only the changepoints themselves are found in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segscan.operators.changepoints import probe_segments
from segscan.operators.segments import longest_run, number, tcn_estimate

# What turns a median of absolute distances into a standard deviation, and the least noise of a spike and of a signal.
MAD, LEAST_SPIKE, LEAST_NOISE = 1.4826, 1e-3, 1e-4
#: Half of the widest rolling window.
_HALF = 25


def copies_of_ratio(ratio: Column, purity: Column, ploidy: Column) -> Column:
    """Copy number from a log ratio; without purity above 0 twice the ratio itself, without ploidy that of two copies."""
    return F.coalesce(tcn_estimate(ratio, purity, F.coalesce(ploidy, F.lit(2.0))), F.lit(2.0) * F.power(F.lit(2.0), ratio))


def dispersion(df: DataFrame, key: list[str], order: list[str], value: str, prefix: str) -> DataFrame:
    """Key, ``{prefix}_sd_total, _mad_total, _sd_within, _mad_within``: spread of the values, and of the steps from one to the next.

    Missing values are left out before neighbours are taken. Fewer than two values: null; two have one step, so no ``sd_within``.
    """
    group = Window.partitionBy(*key)
    rows = df.select(*key, *order, number(value).alias("_x")).filter("_x IS NOT NULL").withColumn("_d", F.col("_x") - F.lag("_x").over(group.orderBy(*order)))
    rows = rows.withColumns({"_mx": F.median("_x").over(group), "_md": F.median("_d").over(group)})
    some = F.count("*") >= 2
    return rows.groupBy(*key).agg(
        F.when(some, F.stddev_samp("_x")).alias(f"{prefix}_sd_total"), F.when(some, MAD * F.median(F.abs(F.col("_x") - F.col("_mx")))).alias(f"{prefix}_mad_total"),
        F.when(some, F.stddev_samp("_d") / 2**0.5).alias(f"{prefix}_sd_within"), F.when(some, MAD * F.median(F.abs(F.col("_d") - F.col("_md"))) / 2**0.5).alias(f"{prefix}_mad_within"),
    )


def rolling_states(df: DataFrame, key: list[str], order: list[str], value: str, least: int = 5, k: int = 3) -> DataFrame:
    """Key, ``probe_osc_chain, probe_n_state_changes, probe_reseg_n_states, probe_amp_spike_frac``.

    The values are smoothed by a centred rolling median, whose odd width is a thirtieth of the chromosome's values, between 5 and
    51, rounded to whole copies (half to even, not below 0), and neighbours of one state taken together. Spikes are values
    above the median by four robust deviations. Fewer than ``least`` values: zeros.
    """
    group = Window.partitionBy(*key)
    along = group.orderBy(*order)
    rows = df.select(*key, *order, number(value).alias("_x")).filter("_x IS NOT NULL")
    rows = rows.withColumns({"_i": F.row_number().over(along), "_n": F.count("*").over(group), "_base": F.median("_x").over(group), "_near": F.collect_list("_x").over(along.rowsBetween(-_HALF, _HALF))})
    half = F.expr("cast(least(51, greatest(5, cast(_n div 30 as int) | 1)) div 2 as int)")
    middle = F.least(F.col("_i"), F.lit(_HALF + 1))  # the value's own place among its neighbours
    first = F.greatest(F.lit(1), middle - half)
    near = F.array_sort(F.slice("_near", first, F.least(middle + half, F.size("_near")) - first + 1))
    rows = rows.withColumn("_s", near).withColumn("_m", (F.element_at("_s", F.floor((F.size("_s") + 1) / 2).cast("int")) + F.element_at("_s", F.floor(F.size("_s") / 2 + 1).cast("int"))) / 2)
    rows = rows.withColumns({"_v": F.greatest(F.rint("_m"), F.lit(0.0)).cast("int"), "_away": F.abs(F.col("_x") - F.col("_base"))})
    rows = rows.withColumns({"_mad": F.median("_away").over(group), "_new": ~F.coalesce(F.lag("_v").over(along) == F.col("_v"), F.lit(False))})
    spike = F.avg((F.col("_x") > F.col("_base") + 4.0 * F.greatest(F.lit(MAD) * F.col("_mad"), F.lit(LEAST_SPIKE))).cast("double"))
    states = F.transform(F.array_sort(F.collect_list(F.when(F.col("_new"), F.struct("_i", "_v")))), lambda s: s["_v"])
    out = rows.groupBy(*key).agg(F.count("*").alias("_n"), F.count_if("_new").alias("_runs"), F.count_distinct("_v").alias("_states"), spike.alias("_spike"), states.alias("_seq"))
    some = lambda e, zero: F.when(F.col("_n") >= least, e).otherwise(zero)
    return out.select(*key, some(longest_run(F.col("_seq"), k), 0).alias("probe_osc_chain"), some(F.col("_runs") - 1, 0).alias("probe_n_state_changes"), some(F.col("_states"), 0).alias("probe_reseg_n_states"), some(F.col("_spike"), 0.0).alias("probe_amp_spike_frac"))


def probe_summary(df: DataFrame, key: list[str], vaf: str = "vaf_t", het: str = "het", variance: str = "lorvar") -> DataFrame:
    """Key, ``n_probes, n_het_probes, vaf_imbalance_sd, probe_noise``: a missing ``het`` counts as heterozygous for the imbalance only.

    ``vaf_imbalance_sd`` is null unless two heterozygous probes have a value; ``probe_noise`` is the median variance.
    """
    away = F.when(F.coalesce(F.col(het).cast("double") != 0, F.lit(True)), F.abs(number(vaf) - 0.5))
    out = df.groupBy(*key).agg(F.count("*").alias("n_probes"), F.coalesce(F.sum(F.col(het).cast("int")), F.lit(0)).cast("int").alias("n_het_probes"), F.when(F.count(away) >= 2, F.stddev_pop(away)).alias("_sd"), F.median(number(variance)).alias("probe_noise"))
    return out.select(*key, "n_probes", "n_het_probes", F.when(F.col("n_het_probes") > 0, F.col("_sd")).alias("vaf_imbalance_sd"), "probe_noise")


def edge_ranks(edges: DataFrame, probes: DataFrame, key: list[str], edge: str, position: str) -> DataFrame:
    """``edges`` with ``rank``: how many probes of the same key lie before the edge, null for a null edge.

    Both are one stream sorted by position, in which the probes are counted once, so no edge meets all probes of its key.
    """
    names = [c for c in edges.columns if c not in key]
    stream = edges.select(*key, F.col(edge).cast("double").alias("_at"), F.lit(0).alias("_probe"), F.struct(*names).alias("_e")).unionByName(probes.select(*key, F.col(position).cast("double").alias("_at"), F.lit(1).alias("_probe")).filter("_at IS NOT NULL"), allowMissingColumns=True)
    before = Window.partitionBy(*key).orderBy("_at", "_probe").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return stream.withColumn("_rank", F.sum("_probe").over(before)).filter("_probe = 0").select(*key, "_e.*", F.when(F.col("_at").isNotNull(), F.col("_rank")).alias("rank"))


def resolved_levels(levels: Column, noise: Column) -> Column:
    """How many of the sorted distinct ``levels`` (an array) stand apart by more than twice the noise; null without levels or noise above 0."""
    zero = F.struct(F.lit(None).cast("double").alias("last"), F.lit(0).alias("n"))
    step = lambda s, v: F.when(s["last"].isNull() | (v - s["last"] > 2 * noise), F.struct(v.alias("last"), (s["n"] + 1).alias("n"))).otherwise(s)
    return F.when((noise > 0) & (F.size(levels) > 0), F.aggregate(F.array_sort(F.array_distinct(levels)), zero, step, lambda s: s["n"]))


def changepoint_features(probes: DataFrame, key: list[str], position: str, value: str, penalties: list[float], variance: str | None = None, purity: str | None = None, ploidy: str | None = None, k: int = 3) -> DataFrame:
    """Key, ``pen_const`` and ``cp_n_changepoints, cp_osc_chain, cp_within_dispersion, cp_osc_confidence, cp_n_levels, cp_n_probes`` per penalty.

    Levels are medians of the segments, as whole copies not below 0. ``cp_within_dispersion``: the median of the segments'
    robust deviations over the noise; ``cp_osc_confidence``: the chain times the median step over three noises, 1 at most.
    ``cp_n_probes`` counts all rows; groups with fewer than ten values have zeros. Purity and ploidy are those of the group's first row.
    """
    own = [F.first(c, True).alias(f"_{n}") if c else F.lit(None).cast("double").alias(f"_{n}") for n, c in (("purity", purity), ("ploidy", ploidy))]
    groups = probes.groupBy(*key).agg(F.count("*").cast("int").alias("cp_n_probes"), *own)
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in penalties])).alias("pen_const")
    found = probe_segments(probes.select("*", wanted), [*key, "pen_const"], position, value, "pen_const", variance).filter("n_group >= 10")
    levels = found.join(groups, key).withColumn("_cn", F.greatest(F.rint(copies_of_ratio(F.col("level"), F.col("_purity"), F.col("_ploidy"))), F.lit(0.0)).cast("int"))
    along = Window.partitionBy(*key, "pen_const").orderBy("seg")
    levels = levels.withColumn("_step", F.abs(F.col("level") - F.lag("level").over(along)) / F.sqrt("noise"))
    seq = F.transform(F.array_sort(F.collect_list(F.struct("seg", "_cn"))), lambda s: s["_cn"])
    per = levels.groupBy(*key, "pen_const").agg(F.count("*").alias("_n"), F.count_distinct("_cn").alias("_l"), F.median(F.col("mad") / F.sqrt("noise")).alias("_w"), F.median("_step").alias("_m"), seq.alias("_seq")).withColumn("_chain", longest_run(F.col("_seq"), k))
    all_ = groups.select(*key, "cp_n_probes", wanted).join(per, [*key, "pen_const"], "left")
    zero = lambda e: F.coalesce(e, F.lit(0))
    return all_.select(
        *key, "pen_const", zero(F.col("_n") - 1).cast("int").alias("cp_n_changepoints"), zero(F.col("_chain")).cast("int").alias("cp_osc_chain"), F.coalesce("_w", F.lit(0.0)).alias("cp_within_dispersion"),
        F.coalesce(F.col("_chain") * F.least(F.col("_m") / 3, F.lit(1.0)), F.lit(0.0)).alias("cp_osc_confidence"), zero(F.col("_l")).cast("int").alias("cp_n_levels"), "cp_n_probes",
    )
