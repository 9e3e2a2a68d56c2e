"""Tables as delimited text: reading with required columns and rows of the wrong width, choosing among files, writing."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_delimited(spark: SparkSession, path: str | list[str], schema: str, required: tuple[str, ...] = (), sep: str = "\t", absent: tuple[str, ...] = ("", "NA")) -> DataFrame:
    """The columns of ``schema`` from files with a header line (also compressed), by name in whatever order the header has them.

    A header without one of ``required`` raises KeyError; other columns that it lacks are null. Lines with more cells than
    the header are left out, missing cells at the end are null, and so are values in ``absent`` and those that can't be cast. All
    files have the header of the first.
    """
    first = spark.read.text(path).limit(1).collect()
    header = [h.strip().strip('"') for h in first[0][0].split(sep)] if first else []
    wanted = T.StructType.fromDDL(schema)
    missing = [c for c in required if c not in header]
    if missing:
        raise KeyError(f"{path} lacks {', '.join(missing)}")
    cells = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(len(header) + 1)])  # the last one: more than the header has
    raw = spark.read.schema(cells).options(sep=sep, header=True, quote='"', escape='"', nullValue="\u0000", emptyValue="", enforceSchema=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    raw = raw.filter(F.col(f"_{len(header)}").isNull())

    def value(f: T.StructField) -> Column:
        if f.name not in header:
            return F.lit(None).cast(f.dataType).alias(f.name)
        c = F.col(f"_{header.index(f.name)}")
        return F.when(~c.isin(*absent), c).try_cast(f.dataType).alias(f.name)

    return raw.select(*[value(f) for f in wanted])


def write_delimited(df: DataFrame, path: str, sep: str = "\t", mode: str = "errorifexists") -> None:
    """One header per file; nulls are NA. An existing path is an error, unless ``mode`` is overwrite, append or ignore (keeps what is there)."""
    df.write.mode(mode).options(sep=sep, header=True, quote='"', escape='"', nullValue="NA", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def preferred_files(files: DataFrame, path: str, key: Column, pattern: str = "_hisens", prefer: str = "refit") -> DataFrame:
    """``key`` and its file: of those whose path has ``pattern`` one with ``prefer``, then the last by name. Null paths and keys have none."""
    rows = files.select(key.alias("key"), F.col(path).alias("path")).filter(F.col("key").isNotNull() & F.contains("path", F.lit(pattern)))
    return rows.groupBy("key").agg(F.max_by("path", F.struct(F.contains("path", F.lit(prefer)), F.col("path"))).alias("path"))


def sibling(path: Column, ending: str, other: str) -> Column:
    """The file beside ``path`` that has ``other`` for ``ending``; null where the path doesn't end so."""
    return F.when(F.endswith(path, F.lit(ending)), F.regexp_replace(path, re.escape(ending) + "$", other))
