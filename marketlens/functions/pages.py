"""Pages of a sorted table that is sorted once, in ranges.

The rows are range-partitioned by their order and every range is sorted and stored with the places of its rows, so a
page reads the ranges it lies in and nothing else, and no page sorts the table again.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.sources.scratch import materialize

ROW_BITS = 33  # of a monotonically increasing id: the place within its partition


@dataclass
class OrderedRows:
    """``stored`` has the rows with ``part`` and ``place`` in it; ``parts`` the ranges that have rows, in order, and
    ``before`` the number of rows ahead of each."""

    stored: DataFrame
    parts: list[int]
    before: list[int]
    total: int

    def page(self, first: int, size: int) -> DataFrame:
        """Rows ``first`` to ``first + size - 1`` of the order, from 0, in order, with their ``position``."""
        if first < 0 or size < 0:
            raise ValueError(f"no page of {size} rows from row {first}")
        last = min(first + size, self.total) - 1
        low, high = bisect_right(self.before, first) - 1, bisect_right(self.before, last)
        wanted = list(zip(self.parts, self.before))[max(low, 0) : high] if first <= last else []
        ahead = F.lit(None).cast("bigint")
        for part, before in wanted:
            ahead = F.when(F.col("part") == part, F.lit(before).cast("bigint")).otherwise(ahead)
        rows = self.stored.where(F.col("part").isin([p for p, _ in wanted])).withColumn("position", ahead + F.col("place"))
        return rows.where(F.col("position").between(first, last)).drop("part", "place").orderBy("position")


def ordered_rows(df: DataFrame, *order: Column) -> OrderedRows:
    """Sorts and stores ``df``, which is a job. The order should be total; of equal rows any may come first, but it
    stays first on every page."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = materialize(ranged.withColumns({"part": F.spark_partition_id(), "place": place}), "ordered", partition_by="part")
    sizes = stored.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()  # a row for each range
    before, total = [], 0
    for r in sizes:
        before.append(total)
        total += r["n"]
    return OrderedRows(stored, [r["part"] for r in sizes], before, total)
