"""Column expressions for spellings: white space, chromosome prefixes, empty words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as outer white space.
WHITE = " \t\n\r\x0b\x0c\u00a0"


def strip(c: Column | str) -> Column:
    """Without outer white space of any kind (``trim`` alone takes spaces only)."""
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(WHITE))


def sample_key(c: Column | str) -> Column:
    """A sample id regardless of case and outer white space; null for null, blank and NA."""
    key = F.upper(strip(c))
    return F.when(key.isin("", "NA"), F.lit(None)).otherwise(key)


def path_key(c: Column | str) -> Column:
    """A file path without outer white space; null for null, blank and NA."""
    key = strip(c)
    return F.when(F.upper(key).isin("", "NA"), F.lit(None)).otherwise(key)


def bare_chrom(c: Column | str) -> Column:
    """A chromosome name without a leading chr in any case."""
    return F.regexp_replace(strip(c), "^(?i)chr", "")
