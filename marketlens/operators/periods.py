"""Period handling: month columns, date filters, order-level joins."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions.columns import timestamp, within_days, year_month
from marketlens.functions.tables import left_join_many

PURCHASED = "order_purchase_timestamp"


def with_period_columns(orders: DataFrame) -> DataFrame:
    """Adds ``month``, ``year``, ``year_month`` of the purchase; unreadable times become null."""
    ts = F.col(PURCHASED)
    return orders.withColumn(PURCHASED, timestamp(PURCHASED)).withColumns(
        {"month": year_month(ts), "year": F.year(ts), "year_month": year_month(ts)}
    )


def orders_with_payments(orders: DataFrame, payments: DataFrame) -> DataFrame:
    """Grain order x payment; unpaid orders stay with null payment columns."""
    return left_join_many(orders, payments, "order_id")


def orders_with_items(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Grain order x item; orders without items stay with null item columns."""
    return left_join_many(orders, items, "order_id")


def period_bounds(orders: DataFrame) -> DataFrame:
    """First and last purchase day: ``min_date, max_date``."""
    ts = timestamp(PURCHASED)
    return orders.agg(
        F.to_date(F.min(ts)).alias("min_date"), F.to_date(F.max(ts)).alias("max_date")
    )


def filter_period(orders: DataFrame, start: dt.date | str, end: dt.date | str) -> DataFrame:
    """Orders bought from ``start`` to ``end``, both days included."""
    start, end = _days(start, end)
    return orders.where(within_days(timestamp(PURCHASED), start, end))


def restrict_to_orders(child: DataFrame, orders: DataFrame) -> DataFrame:
    """Rows of items, payments or reviews whose order is in ``orders``."""
    return child.join(orders.select("order_id"), "order_id", "left_semi")


def previous_bounds(start: dt.date | str, end: dt.date | str) -> tuple[dt.date, dt.date]:
    """The period of equal length that ends the day before ``start``."""
    start, end = _days(start, end)
    one_day = dt.timedelta(days=1)
    return start - (end - start) - one_day, start - one_day


def previous_period(orders: DataFrame, start: dt.date | str, end: dt.date | str) -> DataFrame:
    """Orders of the preceding period; pass them to ``restrict_to_orders`` for payments."""
    return filter_period(orders, *previous_bounds(start, end))


def _days(start: dt.date | str, end: dt.date | str) -> tuple[dt.date, dt.date]:
    start, end = (dt.date.fromisoformat(d) if isinstance(d, str) else d for d in (start, end))
    if start > end:
        raise ValueError(f"the period starts on {start}, after its end on {end}")
    return start, end
