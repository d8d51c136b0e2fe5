"""Shop tables laid out for periods and joins: a folder a month, buckets by order.

A period then reads its own folders alone, and tables that are bucketed alike are joined by order without a
shuffle. The month of an order is kept in its items, payments and reviews as well, so that they are pruned too.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.functions.columns import timestamp, within_days
from marketlens.operators.periods import PURCHASED

MONTH = "purchase_month"
#: Orders without a readable purchase time.
NO_MONTH = "none"


def with_month(orders: DataFrame) -> DataFrame:
    """Adds ``purchase_month``, such as '2017-08'."""
    return orders.withColumn(MONTH, F.coalesce(F.date_format(timestamp(PURCHASED), "yyyy-MM"), F.lit(NO_MONTH)))


def with_order_month(df: DataFrame, orders: DataFrame) -> DataFrame:
    """Adds the month of its order to every row; rows of unknown orders have none."""
    months = with_month(orders).select("order_id", MONTH)
    return df.join(months, "order_id", "left").fillna(NO_MONTH, [MONTH])


def write_by_month(df: DataFrame, path: str, buckets: int, key: str = "order_id") -> None:
    """Writes a table with ``purchase_month`` as Parquet, a folder a month, in ``buckets`` files each, sorted by ``key``.

    The rows are dealt by the key with the bucket function before they are written, so a task writes one file a month,
    and a month of any size is written by ``buckets`` tasks.
    """
    name = _name()
    dealt = df.repartition(buckets, key)
    dealt.write.partitionBy(MONTH).bucketBy(buckets, key).sortBy(key).format("parquet").option("path", path).saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")  # the files stay: the table has its own path


def read_by_month(spark: SparkSession, path: str, buckets: int, key: str = "order_id") -> DataFrame:
    """The table at ``path`` with its buckets, which the files do not name themselves."""
    name = _name()
    schema = spark.read.parquet(path).drop(MONTH).schema
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(
        f"CREATE TABLE {name} ({columns}, `{MONTH}` string) USING parquet PARTITIONED BY (`{MONTH}`)"
        f" CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    spark.sql(f"MSCK REPAIR TABLE {name}")
    return spark.table(name)


def in_months(df: DataFrame, start: dt.date | str, end: dt.date | str) -> DataFrame:
    """Rows of the months that the days from ``start`` to ``end`` touch: whole folders."""
    return df.where(F.col(MONTH).between(str(start)[:7], str(end)[:7]))


def period_orders(orders: DataFrame, start: dt.date | str, end: dt.date | str) -> DataFrame:
    """``periods.filter_period`` of a table by month."""
    return in_months(orders, start, end).where(within_days(F.col(PURCHASED), start, end))


def period_rows(df: DataFrame, orders: DataFrame, start: dt.date | str, end: dt.date | str) -> DataFrame:
    """The rows of ``df`` whose order was bought in the period: both tables by month, in equal buckets."""
    bought = period_orders(orders, start, end).select("order_id")
    return in_months(df, start, end).join(bought, "order_id", "left_semi")


def _name() -> str:
    return f"by_month_{uuid.uuid4().hex}"
