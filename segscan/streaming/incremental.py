"""Aggregates kept up to date from a stream of files: each batch is reduced by itself, the parts are added where they are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1_000) -> DataFrame:
    """The parquet files that match ``path``, old and new, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def aggregate_available(stream: DataFrame, keys: dict[str, Column], sums: dict[str, Column], folder: str) -> DataFrame:
    """Sums per key over all that has arrived below the stream so far; called again, it reads only what is new.

    ``folder`` (shared by all executors) holds the stream's checkpoint and one part per batch. A batch that is run again
    after a loss overwrites its own part, so every row counts once. Null keys are keys; an empty stream gives no row.
    """
    names, values = [e.alias(k) for k, e in keys.items()], [F.sum(e).alias(s) for s, e in sums.items()]
    schema = stream.select(*names, *[e.alias(s) for s, e in sums.items()]).groupBy(*keys).agg(*[F.sum(s).alias(s) for s in sums]).schema

    def keep(batch: DataFrame, number: int) -> None:
        batch.groupBy(*names).agg(*values).write.mode("overwrite").parquet(f"{folder}/parts/batch={number}")

    spark = stream.sparkSession
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/parts/batch=-1")
    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/parts").groupBy(*keys).agg(*[F.sum(s).alias(s) for s in sums])
