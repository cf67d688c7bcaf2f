"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docpipe.session import reliable

#: A word is a run of characters outside the ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text, in order; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def bounded(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``max_rows`` rows, else ``df`` as it is.

    The caller gives a frame that is cheap to count (a checkpoint or a small aggregate).
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the cluster's shared checkpoint folder, its lineage cut."""
    return reliable(df)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files and checkpoints that nothing refers to any more.

    The cleaner acts when the driver's JVM collects garbage, which a job that moves much
    and keeps little on the driver may not do for long.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def crc32_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n (null key: null)."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(n)
