"""Running totals over an order without one task that sees all rows: ranges, totals per range, totals carried on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segscan.sources.tables import checkpointed


def cumulate(df: DataFrame, by: list[str], order: Column, **totals: tuple[str, str]) -> DataFrame:
    """``df`` with a running total per entry of ``totals``: its name to (kind, column), ``kind`` sum, min or count.

    Rows of one group ``by`` (none: all rows are one) are added up in rising ``order``, which should have no ties within a group,
    or their sequence is arbitrary; nulls come first. Rows are written once, cut into ranges of group and order; per
    range one row of totals is added up in a window, which sees as many rows as there are ranges.
    """
    names = {k: f"_in_{i}" for i, k in enumerate(totals)}
    ranged = checkpointed(df.withColumns({"_o": order, "_all": F.lit(0)}).repartitionByRange(*by, "_o").withColumn("_range", F.spark_partition_id()))
    group = ["_all", *by]
    first = {"sum": F.sum, "min": F.min, "count": F.count}
    again = {"sum": F.sum, "min": F.min, "count": F.sum}
    per = ranged.groupBy(*group, "_range").agg(*[first[kind](c).alias(names[k]) for k, (kind, c) in totals.items()])
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = per.select(*[F.col(g).alias(f"_by_{g}") for g in group], F.col("_range").alias("_by_range"), *[again[kind](names[k]).over(earlier).alias(names[k]) for k, (kind, _) in totals.items()])
    within = Window.partitionBy(*group, "_range").orderBy("_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = F.lit(True)
    for g in group:
        both = both & ranged[g].eqNullSafe(F.col(f"_by_{g}"))
    out = ranged.join(carried, both & (ranged["_range"] == F.col("_by_range")), "left")
    plus = {"sum": lambda a, b: F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))), "min": F.least, "count": lambda a, b: F.coalesce(a, F.lit(0)) + b}
    found = {k: plus[kind](F.col(names[k]), first[kind](c).over(within)) for k, (kind, c) in totals.items()}
    return out.select(*df.columns, *[e.alias(k) for k, e in found.items()])
