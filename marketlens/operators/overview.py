"""Executive overview: KPIs, monthly trend, new and returning customers, rankings."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketlens.functions.columns import amount, ratio, timestamp, total, within_days, year_month
from marketlens.functions.tables import ranked, with_growth
from marketlens.operators.periods import PURCHASED, previous_bounds, restrict_to_orders


def payments_per_order(payments: DataFrame) -> DataFrame:
    """One row per paid order: ``order_id, payment_rows, paid, paid_values``.

    Carries all that row-level sums, counts and means over order x payment need, so that
    an order with very many payments is added up before it reaches a join.
    """
    value = amount(payments, "payment_value")
    return payments.groupBy("order_id").agg(
        F.count("*").alias("payment_rows"),
        F.sum(value).alias("paid"),
        F.count(value).alias("paid_values"),
    )


def orders_with_totals(orders: DataFrame, payments: DataFrame) -> DataFrame:
    """Orders plus their payment totals, grain order; nulls for unpaid orders."""
    return orders.join(payments_per_order(payments), "order_id", "left")


def period_kpis(
    orders: DataFrame, payments: DataFrame, start: dt.date | str, end: dt.date | str
) -> DataFrame:
    """Revenue, orders, customers and mean payment against the preceding period.

    ``avg_order_value`` is the mean per payment row, not per order. Output: ``metric,
    current, previous, growth_pct, growth_label``.
    """
    before_start, _ = previous_bounds(start, end)
    ts = timestamp(PURCHASED)
    now = within_days(ts, start, end)
    both = orders.where(within_days(ts, before_start, end)).select(
        "order_id", "customer_id", now.alias("now")
    )
    per_customer = (
        orders_with_totals(both, payments)
        .groupBy("now", "customer_id")
        .agg(
            F.count("*").alias("orders"),
            F.sum("paid").alias("paid"),
            F.sum("paid_values").alias("paid_values"),
        )
    )
    now = F.col("now")

    def measures(side):
        return (
            total(F.when(side, F.col("paid"))),
            total(F.when(side, F.col("orders"))),
            F.count(F.when(side, F.col("customer_id"))).cast("double"),
            ratio(
                F.sum(F.when(side, F.col("paid"))), F.sum(F.when(side, F.col("paid_values")))
            ),
        )

    names = ("revenue", "orders", "customers", "avg_order_value")
    rows = F.array(
        *(
            F.struct(F.lit(n).alias("metric"), c.alias("current"), p.alias("previous"))
            for n, c, p in zip(names, measures(now), measures(~now))
        )
    )
    return with_growth(per_customer.agg(rows.alias("rows")).select(F.inline("rows")),
                       "current", "previous")


def monthly_orders_revenue(orders: DataFrame, payments: DataFrame) -> DataFrame:
    """Orders and revenue by purchase month: ``year_month, orders, revenue``."""
    return (
        orders_with_totals(
            orders.select("order_id", year_month(timestamp(PURCHASED)).alias("year_month")),
            payments,
        )
        .where(F.col("year_month").isNotNull())
        .groupBy("year_month")
        .agg(F.count("*").alias("orders"), total(F.col("paid")).alias("revenue"))
    )


def with_previous_year(monthly: DataFrame, measure: str) -> DataFrame:
    """Adds ``previous``: the measure of the same month one year earlier, if present.

    Looks back by month number, so that missing months do not shift the comparison. The
    input has one row per month.
    """
    number = F.substring("year_month", 1, 4).cast("int") * 12 + F.substring(
        "year_month", 6, 2
    ).cast("int")
    before = monthly.groupBy((number + 12).alias("_month")).agg(F.max(measure).alias("previous"))
    return monthly.withColumn("_month", number).join(before, "_month", "left").drop("_month")


def orders_per_customer_pct(orders: DataFrame) -> DataFrame:
    """Orders per customer times 100, 0 without customers: ``value``."""
    pct = ratio(F.count("order_id"), F.countDistinct("customer_id")) * 100
    return orders.agg(F.coalesce(pct, F.lit(0.0)).alias("value"))


def avg_items_per_order(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Mean items per order, orders without items counting as 0: ``value``."""
    sold = restrict_to_orders(items.select("order_id", "order_item_id"), orders)
    return sold.agg(F.count("order_item_id").alias("n")).select(
        ratio(F.col("n"), orders.agg(F.count("order_id")).scalar()).alias("value")
    )


def top_payment_method(payments: DataFrame) -> DataFrame:
    """Most frequent payment type: ``payment_type, n``; 'N/A' and 0 without any."""
    counts = (
        payments.where(F.col("payment_type").isNotNull())
        .groupBy("payment_type")
        .agg(F.count("*").alias("n"))
    )
    first = F.min(F.struct((-F.col("n")).alias("n"), "payment_type"))
    return counts.agg(first.alias("top")).select(
        F.coalesce(F.col("top.payment_type"), F.lit("N/A")).alias("payment_type"),
        F.coalesce(-F.col("top.n"), F.lit(0)).cast("bigint").alias("n"),
    )


def new_vs_returning(orders: DataFrame) -> DataFrame:
    """Orders by month and customer type: ``year_month, customer_type, n``.

    New: the month of the customer's first order within ``orders``. Orders are counted per
    customer and month first, so the window sees one row per month of a customer however
    many orders the customer has.
    """
    monthly = (
        orders.select("customer_id", year_month(timestamp(PURCHASED)).alias("year_month"))
        .where(F.col("customer_id").isNotNull() & F.col("year_month").isNotNull())
        .groupBy("customer_id", "year_month")
        .agg(F.count("*").alias("n"))
    )
    first = F.min("year_month").over(W.partitionBy("customer_id"))
    return (
        monthly.withColumn("first", first)
        .groupBy(
            "year_month",
            F.when(F.col("year_month") == F.col("first"), "New")
            .otherwise("Returning")
            .alias("customer_type"),
        )
        .agg(F.sum("n").alias("n"))
    )


def state_orders_revenue(
    orders: DataFrame, payments: DataFrame, customers: DataFrame, k: int | None = None
) -> DataFrame:
    """States by order x payment rows: ``customer_state, total_orders, total_revenue``.

    ``total_orders`` counts an order once per payment (once if unpaid).
    """
    per_customer = (
        orders_with_totals(orders.select("order_id", "customer_id"), payments)
        .groupBy("customer_id")
        .agg(
            F.sum(F.coalesce("payment_rows", F.lit(1))).alias("rows"),
            F.sum("paid").alias("paid"),
        )
    )
    states = (
        per_customer.join(customers.select("customer_id", "customer_state"), "customer_id")
        .where(F.col("customer_state").isNotNull())
        .groupBy("customer_state")
        .agg(F.sum("rows").alias("total_orders"), total(F.col("paid")).alias("total_revenue"))
    )
    return ranked(states, F.desc("total_orders"), F.asc("customer_state"), k=k)


def category_items_sold(
    items: DataFrame, products: DataFrame, k: int | None = None
) -> DataFrame:
    """Categories by items sold: ``Category, items_sold``."""
    per_product = items.groupBy("product_id").agg(F.count("order_item_id").alias("n"))
    categories = (
        per_product.join(products.select("product_id", "product_category_name"), "product_id")
        .where(F.col("product_category_name").isNotNull())
        .groupBy(F.col("product_category_name").alias("Category"))
        .agg(F.sum("n").alias("items_sold"))
    )
    return ranked(categories, F.desc("items_sold"), F.asc("Category"), k=k)
