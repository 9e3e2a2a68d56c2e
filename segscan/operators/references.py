"""References to records that do not exist: a merge of references with the validity intervals of their targets.

References and targets are put in one stream, partitioned alike by key and sorted by time. Going once along a
key, the latest end of validity of all targets met so far says whether a reference has a live target; the
targets met before and after it say whether the target is missing, was deleted or comes late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segscan.operators.joins import lookup
from segscan.sources.tables import checkpointed

#: A key with more references and targets than this is spread over several groups, by day and then by hash.
HOT_ROWS = 200_000
_FOREVER = "9999-12-31 00:00:00"
_NO_DAY = -(1 << 30)


def _hot_days(stream: DataFrame, hot_rows: int) -> DataFrame:
    """``target, key, _day, _subs, _carry, _ends``: the days of keys with more than ``hot_rows`` rows, from one pass of counts.

    ``_subs``: groups that the day's rows are spread over; ``_carry``: the latest end of validity of targets from
    earlier days; ``_ends``: that of any target, null for a key without targets.
    """
    per_day = stream.groupBy("target", "key", "_day").agg(F.count("*").alias("_n"), F.max("until").alias("_until"))
    along = Window.partitionBy("target", "key")
    earlier = along.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = per_day.select("target", "key", "_day", F.ceil(F.col("_n") / F.lit(max(1, hot_rows))).cast("int").alias("_subs"), F.max("_until").over(earlier).alias("_carry"), F.max("_until").over(along).alias("_ends"), F.sum("_n").over(along).alias("_all"))
    return days.filter(F.col("_all") > hot_rows).drop("_all")


def find_orphans(references: DataFrame, targets: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """References without a live target: the columns of ``references`` but key and target, and ``problem``.

    ``references``: src_table, row_id, target, key, at. ``targets``: target, key, since, until (null: still there).
    A target is live at ``at`` if ``since <= at`` and ``until`` is null or later. Null keys are no references.
    ``problem`` is ``missing`` (no target has the key), ``late`` (the first comes after the reference) or ``deleted``.
    A reference without time, or whose targets have none, has no live target; repeated rows are each reported.

    Targets of one key and moment are one (the longest). A key with more than ``hot_rows`` rows, references and
    targets together, is one group per day; a day with more is spread by hash, with that day's targets repeated. What
    earlier days leave valid enters each group as one row, so both sides of a hot key are split.
    """
    kind = dict(references.dtypes)["at"]
    refs = references.filter(F.col("key").isNotNull()).select("target", "key", "at", F.lit(None).cast(kind).alias("until"), F.lit(False).alias("is_target"), "src_table", "row_id")
    none = [F.lit(None).cast(dict(references.dtypes)[c]).alias(c) for c in ("src_table", "row_id")]
    goals = targets.filter(F.col("key").isNotNull() & F.col("since").isNotNull()).groupBy("target", "key", F.col("since").alias("at")).agg(F.max(F.coalesce("until", F.lit(_FOREVER).cast(kind))).alias("until")).select("target", "key", "at", "until", F.lit(True).alias("is_target"), *none)
    day = F.coalesce(F.unix_date(F.col("at").cast("date")), F.lit(_NO_DAY)).alias("_day")
    narrow = lambda df: df.select("target", "key", day, "until")
    days = checkpointed(_hot_days(narrow(refs).unionByName(narrow(goals)), hot_rows))
    if days.isEmpty():
        stream = refs.unionByName(goals).withColumns({"_day": F.lit(_NO_DAY), "_sub": F.lit(0)})
    else:
        plan = days.select("target", "key", "_day", "_subs")
        known = lambda df: lookup(df.withColumn("_day", day), plan, ["target", "key", "_day"], F.struct("src_table", "row_id"))
        cold = {"_day": F.when(F.col("_subs").isNull(), F.lit(_NO_DAY)).otherwise(F.col("_day")), "_subs": F.coalesce("_subs", F.lit(1))}
        mine = known(refs).withColumns(cold).withColumn("_sub", F.pmod(F.xxhash64("row_id"), F.col("_subs")).cast("int"))
        every = F.explode(F.sequence(F.lit(0), F.col("_subs") - 1)).alias("_sub")
        theirs = known(goals).withColumns(cold).select("*", every)
        # Two rows for each group of a hot key: what is still valid from earlier days, before all its rows, and, so that the key is known, one after them.
        edges = F.explode(F.array(F.struct(F.lit(None).cast(kind).alias("at"), F.col("_carry").alias("until")), F.struct(F.lit(_FOREVER).cast(kind).alias("at"), F.when(F.col("_ends").isNotNull(), F.lit(_FOREVER).cast(kind)).alias("until")))).alias("_e")
        carried = days.select("target", "key", "_day", edges, "_subs", "_carry", "_ends").filter("_e.until IS NOT NULL").select("target", "key", "_day", F.col("_e.at").alias("at"), F.col("_e.until").alias("until"), F.lit(True).alias("is_target"), *none, every)
        stream = mine.drop("_subs").unionByName(theirs.drop("_subs")).unionByName(carried)
    along = Window.partitionBy("target", "key", "_day", "_sub").orderBy(F.col("at").asc_nulls_first(), F.col("is_target").desc())
    so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    merged = stream.select("*", F.max("until").over(so_far).alias("_live_until"), F.max("is_target").over(whole).alias("_known"))
    lost = merged.filter(~F.col("is_target") & ~F.coalesce(F.col("_live_until") > F.col("at"), F.lit(False)))
    problem = F.when(~F.col("_known"), "missing").when(F.col("_live_until").isNull(), "late").otherwise("deleted")
    return lost.select("src_table", "row_id", "at", problem.alias("problem"))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans counted per table, month of ``at`` (null where there is none) and problem."""
    return orphans.groupBy("src_table", F.date_format("at", "yyyy-MM").alias("month"), "problem").agg(F.count("*").alias("n_rows"))
