"""Positions along the genome: offsets of chromosomes, tracks, areas of listed chromosomes, arms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segscan.operators.running import cumulate
from segscan.operators.segments import chrom_order


def x_label(chrom: Column) -> Column:
    """The chromosome's name for a plot: 23 is X, 24 is Y."""
    return F.when(chrom == "23", "X").when(chrom == "24", "Y").otherwise(chrom)


def offsets(segments: DataFrame) -> DataFrame:
    """``label, length, offset``: each chromosome's last position, and the sum of those before it in their usual order (then by name)."""
    per = segments.filter(F.col("chrom").isNotNull() & F.col("loc_end").isNotNull()).groupBy(x_label(F.col("chrom")).alias("label")).agg(F.max("loc_end").alias("length"))
    place = F.struct(chrom_order(F.col("label")), F.col("label"))
    return cumulate(per, [], place, _upto=("sum", "length")).select("label", "length", (F.col("_upto") - F.col("length")).alias("offset"))


def track(segments: DataFrame, places: DataFrame, most: float = 11.0) -> DataFrame:
    """The segments with ``label, x_start, x_end`` on the whole genome, ``tcn_shown`` (``most`` at most) and ``lcn_shown`` (1 where it is missing)."""
    rows = segments.withColumn("label", x_label(F.col("chrom"))).join(F.broadcast(places), "label")  # one row per chromosome
    return rows.withColumns({"x_start": F.col("loc_start") + F.col("offset"), "x_end": F.col("loc_end") + F.col("offset"), "tcn_shown": F.when(F.col("tcn").isNotNull(), F.least(F.col("tcn"), F.lit(most))), "lcn_shown": F.coalesce("lcn", F.lit(1.0))})


def areas(listed: DataFrame, amplified: DataFrame, places: DataFrame, key: str) -> DataFrame:
    """``key, label, kind, x_start, x_end``: the whole of each listed chromosome; ``kind`` tells whether it is amplified too. Listed twice is listed once."""
    both = listed.select(key, x_label(F.col("chrom")).alias("label")).distinct().join(amplified.select(key, x_label(F.col("chrom")).alias("label"), F.lit(True).alias("_a")).distinct(), [key, "label"], "left")
    return both.join(F.broadcast(places), "label").select(key, "label", F.when(F.col("_a"), "listed and amplified").otherwise("listed").alias("kind"), F.col("offset").alias("x_start"), (F.col("offset") + F.col("length")).alias("x_end"))


def arms(segments: DataFrame, centromeres: DataFrame) -> DataFrame:
    """The segments with ``arm``: p, q, centromere where they reach into it, null where the chromosome has none listed.

    ``centromeres``: chrom, centro_start, centro_end, one row per chromosome; it is broadcast.
    """
    rows = segments.join(F.broadcast(centromeres), "chrom", "left")
    arm = F.when(F.col("loc_end") <= F.col("centro_start"), "p").when(F.col("loc_start") >= F.col("centro_end"), "q").when(F.col("centro_start").isNotNull() & F.col("loc_end").isNotNull(), "centromere")
    return rows.withColumn("arm", arm).drop("centro_start", "centro_end")
