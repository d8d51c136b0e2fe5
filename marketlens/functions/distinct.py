"""Approximate distinct counts from sketches that are kept and merged.

A sketch per group, such as a month, is stored once and is small; the distinct count of any set of groups comes from merging
theirs, without the rows. Exact counts (``count_distinct``) stay the default everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Binary logarithm of the number of registers; the relative standard error is 1.04 / sqrt(2 ** it).
REGISTERS = 12


def standard_error(registers: int = REGISTERS) -> float:
    return 1.04 / 2 ** (registers / 2)


def distinct_sketches(df: DataFrame, group: str, col: str, registers: int = REGISTERS) -> DataFrame:
    """``<group>, sketch`` of the non-null values of ``col``; groups without any have none. Sketches of tasks are merged, so a hot
    group or value costs no more than others."""
    values = df.where(F.col(col).isNotNull() & F.col(group).isNotNull())
    return values.groupBy(group).agg(F.hll_sketch_agg(F.col(col).cast("string"), registers).alias("sketch"))


def merged_count(sketches: DataFrame) -> DataFrame:
    """``n_distinct`` over all given groups, 0 for none."""
    merged = sketches.agg(F.hll_union_agg("sketch").alias("sketch"), F.count("sketch").alias("groups"))
    return merged.select(F.when(F.col("groups") > 0, F.hll_sketch_estimate("sketch")).otherwise(F.lit(0)).cast("bigint").alias("n_distinct"))


def counts(sketches: DataFrame) -> DataFrame:
    """Each group with ``n_distinct`` instead of its sketch."""
    return sketches.select(*(c for c in sketches.columns if c != "sketch"), F.hll_sketch_estimate("sketch").alias("n_distinct"))
