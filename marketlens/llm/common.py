"""Helpers shared by the corpus operators."""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.sources import scratch

SPACES = r"[\x20\x09-\x0D]+"
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: computed once, safe from lost
    executors, and later reads fetch only the columns they need."""
    path = scratch.new_path(df.sparkSession, name)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[found] = path
    return found


def freed(*tables: DataFrame) -> None:
    """Deletes ``stored`` tables whose successors are written; they cannot be read after it."""
    for df in tables:
        scratch.drop(df.sparkSession, _PATHS.pop(df))


def text_of(column: str | Column) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only, the same in every engine and locale."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bounded(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """``df`` marked for broadcast if its counted rows are within ``limit``; else as it is."""
    return F.broadcast(df) if rows <= limit else df


#: Number of groups that keys are hashed into for ``in_buckets_of``: at most so many numbers are sent out.
BUCKETS = 1 << 20


def in_buckets_of(df: DataFrame, keys: DataFrame, key: str, keep: bool = True) -> DataFrame:
    """Rows of ``df`` whose key falls into a bucket of some key of ``keys``; with ``keep=False`` the others.

    A first, shuffle-free sieve before a join: all matching rows pass it. What is broadcast is
    bounded by the number of buckets, whatever the number of keys.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
    wanted = keys.select(bucket.alias("_bucket")).distinct()
    how = "left_semi" if keep else "left_anti"
    return df.withColumn("_bucket", bucket).join(F.broadcast(wanted), "_bucket", how).drop("_bucket")
