"""Strategy: business summary, quadrant ranking, return on investment, report."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketlens.functions.columns import fixed, ratio, total
from marketlens.functions.tables import ranked
from marketlens.operators.overview import orders_with_totals
from marketlens.operators.products import category_performance

# Quadrants as (x above its cut, y above its cut).
QUADRANTS = {
    "Quick Wins": (False, True),
    "Strategic Projects": (True, True),
    "Fill-ins": (False, False),
    "Avoid": (True, False),
}

# Fixed value: monthly revenue assumed where there is none.
DEFAULT_MONTHLY_REVENUE = 1_000_000.0


def business_summary(
    orders: DataFrame, payments: DataFrame, items: DataFrame, products: DataFrame
) -> DataFrame:
    """The period in one row.

    Output: ``total_revenue, total_orders, total_customers, avg_order_value`` (per payment
    row), ``orders_per_customer, top_category`` (by items), ``category_revenue`` (largest).
    """
    per_customer = (
        orders_with_totals(orders.select("order_id", "customer_id"), payments)
        .groupBy("customer_id")
        .agg(
            F.count("*").alias("orders"),
            F.sum("paid").alias("paid"),
            F.sum("paid_values").alias("paid_values"),
        )
    )
    known = F.col("customer_id").isNotNull()
    top = F.min(F.struct((-F.col("total_items_sold")).alias("n"), "category"))
    categories = category_performance(items, products, orders).agg(
        F.struct(
            F.coalesce(top["category"], F.lit("N/A")).alias("top_category"),
            F.coalesce(F.max("total_revenue"), F.lit(0.0)).alias("category_revenue"),
        )
    )
    return (
        per_customer.agg(
            total(F.col("paid")).alias("total_revenue"),
            F.coalesce(F.sum("orders"), F.lit(0)).alias("total_orders"),
            F.count("customer_id").alias("total_customers"),
            ratio(F.sum("paid"), F.sum("paid_values")).alias("avg_order_value"),
            ratio(F.sum(F.when(known, F.col("orders"))), F.count("customer_id")).alias(
                "orders_per_customer"
            ),
        )
        .withColumn("c", categories.scalar())
        .select("*", "c.top_category", "c.category_revenue")
        .drop("c")
    )


def with_quadrant(
    df: DataFrame, x: str, y: str, x_cut: float | Column, y_cut: float | Column
) -> DataFrame:
    """Adds ``quadrant``. Values on a cut belong to the lower side."""
    right, high = F.col(x) > x_cut, F.col(y) > y_cut
    rules = [
        F.when((right == F.lit(r)) & (high == F.lit(h)), F.lit(name))
        for name, (r, h) in QUADRANTS.items()
    ]
    return df.withColumn("quadrant", F.coalesce(*rules))


def quadrant_topk(
    df: DataFrame,
    x: str,
    y: str,
    x_cut: float | Column,
    y_cut: float | Column,
    picks: Sequence[tuple[str, str, int]],
    key: str,
) -> DataFrame:
    """The best rows of chosen quadrants, plus ``quadrant, pick, rank``.

    ``picks`` lists (quadrant, column to rank by, number of rows); ``key`` breaks ties.
    ``pick`` numbers the entries of ``picks``, ``rank`` the rows of one entry; the ranks are
    given after the top-k, to at most that many rows.
    """
    labelled = with_quadrant(df, x, y, x_cut, y_cut)
    parts = []
    for i, (name, by, k) in enumerate(picks, start=1):
        order = F.desc_nulls_last(by), F.asc(key)
        best = ranked(labelled.where(F.col("quadrant") == name), *order, k=k)
        rank = F.row_number().over(W.partitionBy("quadrant").orderBy(*order))
        parts.append(best.withColumns({"pick": F.lit(i), "rank": rank}))
    return reduce(DataFrame.unionByName, parts)


def roi_projection(
    revenue: DataFrame,
    key: str,
    revenue_col: str,
    investment: float,
    increase_pct: float,
    months: int = 12,
    default_monthly: float = DEFAULT_MONTHLY_REVENUE,
) -> DataFrame:
    """Projected return of an investment for every key, month by month.

    A key without positive revenue counts with ``default_monthly`` a month; for a null revenue
    nothing is projected and all figures but the investment are null.

    ``revenue_col`` is a year of revenue in the unit of ``investment``. Output: ``key,
    month, monthly_increase, annual_increase, cumulative_revenue, investment, net_benefit,
    roi_pct, payback_months`` (infinite without an increase).
    """
    if months < 1:
        raise ValueError(f"months must be at least 1, not {months}")
    invested = F.lit(float(investment))
    yearly = F.col(revenue_col).cast("double")
    monthly = F.when(yearly > 0, yearly / 12).when(yearly.isNotNull(), default_monthly)
    gain, annual = F.col("monthly_increase"), F.col("annual_increase")
    return (
        revenue.select(key, (monthly * (increase_pct / 100)).alias("monthly_increase"))
        .withColumn("annual_increase", gain * 12)
        .withColumn("roi_pct", F.try_divide(annual - invested, invested) * 100)
        .withColumn(
            "payback_months",
            F.when(gain > 0, F.try_divide(invested, gain)).when(gain.isNotNull(), float("inf")),
        )
        .withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(months))))
        .select(
            key,
            "month",
            "monthly_increase",
            "annual_increase",
            (gain * F.col("month")).alias("cumulative_revenue"),
            invested.alias("investment"),
            (gain * F.col("month") - invested).alias("net_benefit"),
            "roi_pct",
            "payback_months",
        )
    )


def report(summary: DataFrame, picks: DataFrame, roi: DataFrame) -> DataFrame:
    """One JSON document: performance, picked rows, return on investment.

    ``summary`` is ``business_summary``, ``picks`` a top-k table (``quadrant_topk``), ``roi``
    the projection of one key. Only these few rows are gathered, in the order of the picks.
    """
    shown = F.struct(*(c for c in picks.columns if c not in ("pick", "rank")))
    rows = F.sort_array(F.collect_list(F.struct("pick", "rank", shown.alias("row"))))
    chosen = picks.agg(F.transform(rows, lambda r: r["row"])).scalar()
    outlook = roi.agg(
        F.struct(
            _euros(F.max("investment")).alias("Investment"),
            F.concat(fixed(F.max("roi_pct"), "0.0"), F.lit("%")).alias("Expected ROI"),
            F.concat(fixed(F.max("payback_months"), "0.0"), F.lit(" months")).alias(
                "Payback Period"
            ),
            _euros(F.max("annual_increase")).alias("Annual Revenue Increase"),
        )
    ).scalar()
    performance = F.struct(
        _euros(F.col("total_revenue")).alias("Total Revenue"),
        _count(F.col("total_orders")).alias("Total Orders"),
        _count(F.col("total_customers")).alias("Unique Customers"),
        _euros(F.col("avg_order_value")).alias("Average Order Value"),
    )
    return summary.select(
        F.to_json(
            F.struct(
                performance.alias("Current Performance"),
                chosen.alias("Top Recommendations"),
                outlook.alias("ROI Projections"),
            )
        ).alias("report")
    )


def _euros(amount: Column) -> Column:
    return F.concat(F.lit("€ "), fixed(amount, "#,##0"))


def _count(n: Column) -> Column:
    return fixed(n, "#,##0")
