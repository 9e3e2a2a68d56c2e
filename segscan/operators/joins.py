"""Left joins of many rows with a keyed table, without a hot task: broadcast where its size is checked, salted beyond it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows up to which the keyed table is broadcast, and parts into which each key is spread beyond that.
BROADCAST_ROWS = 200_000
SALTS = 32


def lookup(rows: DataFrame, keyed: DataFrame, on: list[str], spread: Column, how: str = "left", most: int = BROADCAST_ROWS, salts: int = SALTS) -> DataFrame:
    """``rows`` joined with ``keyed``, which should be cheap to read twice (a checkpoint or a small table), on equal columns ``on``.

    ``how``: left, left_semi, left_anti or inner. ``keyed`` is counted; up to ``most`` rows of it are broadcast. A larger one is
    joined by shuffle with each of its rows repeated ``salts`` times, and a row of ``rows`` meets the copy that ``spread``
    hashes to, so that no key is one task. Null keys find nothing.
    """
    if keyed.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(keyed), on, how)
    many = keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).join(many, [*on, "_salt"], how).drop("_salt")
