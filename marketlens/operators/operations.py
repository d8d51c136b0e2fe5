"""Operations: delivery times, freight, sellers, payments, order status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.columns import amount, mean, ratio, total, weighted_total, whole_days
from marketlens.functions.ranks import day_quantiles, quantile, quantiles
from marketlens.functions.tables import counted, histogram, ranked, with_share
from marketlens.sources.scratch import materialize


DELIVERED = "delivered"


def delivered_orders(orders: DataFrame) -> DataFrame:
    """Delivered orders with both dates, plus ``delivery_time`` in whole days.

    A date that cannot be read is an error here.
    """
    approved, received = _delivery_dates()
    return (
        orders.where(_delivered())
        .withColumns(
            {"order_approved_at": approved, "order_delivered_customer_date": received}
        )
        .withColumn("delivery_time", whole_days(approved, received))
    )


def delivery_kpis(orders: DataFrame) -> DataFrame:
    """``avg_delivery_time`` (0 if nothing was delivered), ``delivery_rate`` in percent."""
    days = F.when(_delivered(), whole_days(*_delivery_dates()))
    rate = ratio(F.count_if(F.col("order_status") == DELIVERED), F.count("*")) * 100
    return orders.agg(
        F.coalesce(mean(days), F.lit(0.0)).alias("avg_delivery_time"),
        rate.alias("delivery_rate"),
    )


def delivery_quartiles(delivered: DataFrame) -> DataFrame:
    """Quartiles of the delivery time: ``q25, q75``."""
    q = day_quantiles(delivered, "delivery_time", (0.25, 0.75))
    return q.select(F.get("q", F.lit(0)).alias("q25"), F.get("q", F.lit(1)).alias("q75"))


def freight_totals(items: DataFrame) -> DataFrame:
    """``total_freight_cost`` and ``avg_freight_per_order``, 0 without a freight column."""
    if "freight_value" not in items.columns:
        return items.agg(
            F.lit(0.0).alias("total_freight_cost"), F.lit(0.0).alias("avg_freight_per_order")
        )
    per_order = items.groupBy("order_id").agg(F.sum(amount(items, "freight_value")).alias("freight"))
    known = F.col("order_id").isNotNull()
    return per_order.agg(
        total(F.col("freight")).alias("total_freight_cost"),
        ratio(
            F.coalesce(F.sum(F.when(known, F.col("freight"))), F.lit(0)), F.count("order_id")
        ).alias("avg_freight_per_order"),
    )


def describe_numeric(df: DataFrame, col: str) -> DataFrame:
    """``count, mean, std, min, q25, q50, q75, max``, exact. Nulls and NaN do not count.

    Everything is derived from the stored (value, count) table, so the rows are read once.
    """
    present = df.where(~F.isnan(F.col(col).cast("double")))
    values = materialize(counted(present, col))
    x, n = F.col(col), F.col("n")
    q = quantiles(values, col, (0.25, 0.5, 0.75), weight="n").scalar()
    spread = values.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("count"),
        ratio(weighted_total(values, col, "n"), F.sum("n")).alias("mean"),
        F.min(x).cast("double").alias("min"),
        F.max(x).cast("double").alias("max"),
    )
    centre = spread.select("mean").scalar()
    squares = values.withColumn("m", centre).agg(
        F.sum(F.pow(x.cast("double") - F.col("m"), 2) * n).alias("s")
    )
    return spread.withColumns({"q": q, "s": squares.scalar()}).select(
        "count",
        "mean",
        F.sqrt(F.try_divide(F.col("s"), (F.col("count") - 1).cast("double"))).alias("std"),
        "min",
        *(F.get("q", F.lit(i)).alias(name) for i, name in enumerate(("q25", "q50", "q75"))),
        "max",
    )


def delivery_time_distribution(
    delivered: DataFrame, max_days: int = 100, bins: int = 30
) -> DataFrame:
    """Histogram of delivery times up to ``max_days``: ``bin, lo, hi, n, avg_delivery_time``."""
    kept = delivered.where(F.col("delivery_time") <= max_days)
    values = materialize(counted(kept, "delivery_time"))  # some thousand rows, read three times
    avg_time = values.agg(ratio(F.sum(F.col("delivery_time") * F.col("n")), F.sum("n")))
    return histogram(values, "delivery_time", bins, weight="n").withColumn(
        "avg_delivery_time", avg_time.scalar()
    )


def freight_distribution(items: DataFrame, q: float = 0.95, bins: int = 30) -> DataFrame:
    """Histogram of positive freight up to its ``q`` quantile.

    Output: ``bin, lo, hi, n, median_freight`` (median of the rows kept). The items are
    read once, for their (value, count) table. That table and its trimmed part are stored,
    as cut-off, median and bins each pass over them.
    """
    positive = items.select(amount(items, "freight_value").alias("freight")).where("freight > 0")
    values = materialize(counted(positive, "freight"))
    cutoff = quantile(values, "freight", q, weight="n")
    kept = materialize(values.where(F.col("freight").cast("double") <= cutoff))
    return histogram(kept, "freight", bins, weight="n").withColumn(
        "median_freight", quantile(kept, "freight", 0.5, weight="n")
    )


def seller_performance(
    delivered: DataFrame, items: DataFrame, min_orders: int = 5
) -> DataFrame:
    """Sellers with at least ``min_orders`` delivered orders.

    Output: ``seller_id, avg_delivery_time`` (per item row), ``order_volume`` (orders).
    """
    sold = items.where(F.col("seller_id").isNotNull()).select("order_id", "seller_id")
    # As a struct the order is a new key: the join can split a hot order, as nothing behind it
    # needs the rows of an order together, and few rows are left for the second shuffle.
    per_order = (
        sold.join(delivered.select("order_id", "delivery_time"), "order_id")
        .groupBy("seller_id", F.struct("order_id").alias("order"))
        .agg(F.count("*").alias("n"), F.sum("delivery_time").alias("time"))
    )
    return (
        per_order.groupBy("seller_id")
        .agg(
            ratio(F.sum("time"), F.sum("n")).alias("avg_delivery_time"),
            F.count("*").alias("order_volume"),
        )
        .where(F.col("order_volume") >= min_orders)
    )


def seller_sample(performance: DataFrame, k: int = 50) -> DataFrame:
    """The first sellers by id."""
    return ranked(performance, F.asc("seller_id"), k=k)


def rank_sellers(performance: DataFrame, k: int = 10, slowest: bool = False) -> DataFrame:
    """The fastest or slowest sellers, delivery time rounded half to even."""
    time = F.col("avg_delivery_time")
    best = ranked(performance, time.desc() if slowest else time.asc(), F.asc("seller_id"), k=k)
    return best.withColumn("avg_delivery_time", F.bround("avg_delivery_time", 1))


def payment_summary(payments: DataFrame) -> DataFrame:
    """``top_payment, payment_pct`` (of all rows), ``avg_payment_value, avg_installments``."""
    value, parts = amount(payments, "payment_value"), F.col("payment_installments")
    per_type = payments.groupBy("payment_type").agg(
        F.count("*").alias("n"),
        F.sum(value).alias("paid"),
        F.count(value).alias("paid_values"),
        F.sum(parts).alias("parts"),
        F.count(parts).alias("part_values"),
    )
    named = F.col("payment_type").isNotNull()
    top = F.min(F.when(named, F.struct((-F.col("n")).alias("n"), "payment_type")))
    return per_type.agg(
        top.alias("top"),
        F.sum("n").alias("rows"),
        ratio(F.sum("paid"), F.sum("paid_values")).alias("avg_payment_value"),
        ratio(F.sum("parts"), F.sum("part_values")).alias("avg_installments"),
    ).select(
        F.col("top.payment_type").alias("top_payment"),
        (ratio(-F.col("top.n"), F.col("rows")) * 100).alias("payment_pct"),
        "avg_payment_value",
        "avg_installments",
    )


def order_status_summary(orders: DataFrame) -> DataFrame:
    """``order_status, n, pct``, most frequent first, percent to one decimal."""
    shares = with_share(counted(orders, "order_status"))
    return ranked(
        shares.withColumn("pct", F.bround("pct", 1)), F.desc("n"), F.asc("order_status")
    )


def _delivered() -> Column:
    return (
        (F.col("order_status") == DELIVERED)
        & F.col("order_delivered_customer_date").isNotNull()
        & F.col("order_approved_at").isNotNull()
    )


def _delivery_dates() -> tuple[Column, Column]:
    """Approval and receipt, cast strictly."""
    return (
        F.col("order_approved_at").cast("timestamp_ntz"),
        F.col("order_delivered_customer_date").cast("timestamp_ntz"),
    )
