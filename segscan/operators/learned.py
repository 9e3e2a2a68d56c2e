"""A learned combination of features, judged on samples that it has not seen."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segscan.operators.segments import number
from segscan.sources.tables import checkpointed


def informative(df: DataFrame, features: list[str]) -> list[str]:
    """The features with more than one value, missing ones apart; one aggregate over the rows."""
    row = df.agg(*[F.min(number(f)).alias(f"lo_{i}") for i, f in enumerate(features)], *[F.max(number(f)).alias(f"hi_{i}") for i, f in enumerate(features)]).first()
    return [f for i, f in enumerate(features) if row[f"lo_{i}"] is not None and row[f"lo_{i}"] != row[f"hi_{i}"]]


def out_of_fold(df: DataFrame, keys: list[str], features: list[str], group: str, truth: Column, folds: int = 5, strength: float = 1.0) -> DataFrame:
    """``keys`` and ``p``: the probability of a logistic regression fitted on the other folds; all rows of one ``group`` are in one fold, by hash.

    Missing values are the median, values scaled to mean 0 and deviation 1, both of the rows fitted on; both classes weigh the
    same; the sum of absolute weights is penalised by 1 / ``strength``. A null truth is false. ``p`` is null where
    the other folds hold one class only, or no feature says anything.
    """
    used = informative(df, features)
    columns = [f"_f{i}" for i in range(len(used))]
    rows = checkpointed(df.select(*keys, F.pmod(F.xxhash64(group), F.lit(folds)).cast("int").alias("_fold"), F.coalesce(truth, F.lit(False)).cast("double").alias("_y"), *[number(f).alias(c) for f, c in zip(used, columns)]))
    out = None
    for k in range(folds):
        others, own = rows.filter(F.col("_fold") != k), rows.filter(F.col("_fold") == k)
        stats = others.agg(F.count("*").alias("n"), F.sum("_y").alias("pos"), *[F.median(c).alias(f"m{c}") for c in columns]).first()
        n, pos = stats["n"], stats["pos"] or 0.0
        if not used or not 0 < pos < n:
            part = own.select(*keys, F.lit(None).cast("double").alias("p"))
        else:
            filled = {c: F.coalesce(F.col(c), F.lit(stats[f"m{c}"] or 0.0)) for c in columns}
            spread = others.agg(*[f(filled[c]).alias(f"{s}{c}") for c in columns for s, f in (("a", F.avg), ("s", F.stddev_pop))]).first()
            scaled = [((filled[c] - spread[f"a{c}"]) / (spread[f"s{c}"] or 1.0)).alias(c) for c in columns]
            weight = F.when(F.col("_y") > 0, n / (2 * pos)).otherwise(n / (2 * (n - pos))).alias("_w")
            assembler = VectorAssembler(inputCols=columns, outputCol="_v")
            model = LogisticRegression(featuresCol="_v", labelCol="_y", weightCol="_w", elasticNetParam=1.0, regParam=1.0 / (strength * n), standardization=False, probabilityCol="_p", predictionCol="_c", rawPredictionCol="_r").fit(assembler.transform(others.select("_y", weight, *scaled)))
            part = model.transform(assembler.transform(own.select(*keys, *scaled))).select(*keys, vector_to_array("_p")[1].alias("p"))
        out = part if out is None else out.unionByName(part)
    return out
