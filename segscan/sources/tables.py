"""Reading the parquet tables, and the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a data folder; columns and filters reach the scan through Catalyst."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which every executor can read and write.

    Only where the session names none and runs on this machine alone, as in tests, a folder of this machine is used;
    on a cluster that is an error, for the executors could not read it. Who asks for a folder removes it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="segscan-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by files in the shared folder, so that it outlives lost executors."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession, "checkpoint"))
    return df.checkpoint()


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to the new folder ``path`` and read from there: as a checkpoint, in a fraction of its size.

    The shuffle files that led to it are given back at once. The caller removes ``path``.
    """
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            conf.unset(key)
        else:
            conf.set(key, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)
