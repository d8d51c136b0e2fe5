"""Every operator as a query over one data folder: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.functions import distinct
from marketlens.functions.columns import mean
from marketlens.functions.tables import histogram, with_growth
from marketlens.operators import (
    customers,
    operations,
    overview,
    periods,
    products,
    reviews,
    strategy,
)
from marketlens.plans.shop import PERIOD, Shop
from marketlens.sources import layout, reader, scratch, writer
from marketlens.sources.schemas import FILES

Query = Callable[[SparkSession, str], DataFrame]

FUNNEL = ("view", "click", "purchase")
CATEGORY = "large"
SEARCH_TERM = "licen[cs]e|un+g der"


def queries() -> dict[str, Query]:
    return {name: _over_shop(build) for name, build in BUILDERS.items()}


def _over_shop(build: Callable[[Shop], DataFrame]) -> Query:
    return lambda spark, folder: build(Shop(spark, folder))


def _orders(shop: Shop) -> DataFrame:
    """Orders of the standard period."""
    return periods.filter_period(shop.orders, *PERIOD)


# Sources ---------------------------------------------------------------------------


def load_tables(shop: Shop) -> DataFrame:
    """Writes the shop tables as CSV files and counts what loading them gives."""
    root = scratch.new_path(shop.spark, "tables")
    for table, df in shop.catalog.items():
        writer.write_reviews(df, f"{root}/{FILES[table]}.csv", "csv")
    return reader.row_counts(reader.load_tables(shop.spark, root, ".csv"))


def quarantined_rows(shop: Shop) -> DataFrame:
    """Writes items and payments as lines of which those of every hundredth order lack their last cell, and loads them."""
    root = scratch.new_path(shop.spark, "lines")
    tables = {"order_items": shop.items, "order_payments": shop.payments}
    for table, df in tables.items():
        cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
        line = F.when(F.col("order_id") % 100 == 0, F.concat_ws(",", *cells[:-1])).otherwise(F.concat_ws(",", *cells))
        lines = df.select(line.alias(",".join(df.columns)))
        lines.write.options(header=True, sep="\u0001").csv(f"{root}/{table}.csv")
    broken = f"{root}/broken"
    loaded = {t: reader.load_table(shop.spark, f"{root}/{t}.csv", t, quarantine=broken) for t in tables}
    return reader.row_counts(loaded, broken)


def _by_month(shop: Shop) -> tuple[DataFrame, DataFrame]:
    """Orders and items, written by month and in buckets, and read again."""
    root, buckets = scratch.new_path(shop.spark, "by-month"), 8
    layout.write_by_month(layout.with_month(shop.orders), f"{root}/orders", buckets)
    layout.write_by_month(layout.with_order_month(shop.items, shop.orders), f"{root}/items", buckets)
    return tuple(layout.read_by_month(shop.spark, f"{root}/{t}", buckets) for t in ("orders", "items"))


def month_folders(shop: Shop) -> DataFrame:
    orders, _ = _by_month(shop)
    return layout.period_orders(orders, *PERIOD).drop(layout.MONTH)


def bucketed_items(shop: Shop) -> DataFrame:
    orders, items = _by_month(shop)
    return layout.period_rows(items, orders, *PERIOD).drop(layout.MONTH)


def key_violations(shop: Shop) -> DataFrame:
    return reader.key_violations(shop.catalog)


def export_reviews(shop: Shop, fmt: str) -> DataFrame:
    """Writes the whole review table, compressed, and reads it back."""
    table = reviews.review_table(_enriched(shop))
    path = scratch.new_path(shop.spark, f"reviews-{fmt}")
    writer.write_reviews(table, path, fmt, "gzip")
    return writer.read_reviews(shop.spark, path, fmt, table.schema)


# Periods ---------------------------------------------------------------------------


def period_columns(shop: Shop) -> DataFrame:
    return periods.with_period_columns(shop.orders)


def previous_payments(shop: Shop) -> DataFrame:
    before = periods.previous_period(shop.orders, *PERIOD)
    return periods.restrict_to_orders(shop.payments, before)


# Overview --------------------------------------------------------------------------


def growth(shop: Shop) -> DataFrame:
    """Monthly revenue against the same month one year earlier."""
    monthly = overview.monthly_orders_revenue(shop.orders, shop.payments)
    yearly = overview.with_previous_year(monthly, "revenue")
    return with_growth(yearly, "revenue", "previous").drop("orders")


# Customers -------------------------------------------------------------------------


def _rfm(shop: Shop) -> DataFrame:
    """Stored, as scoring reads it once per score."""
    return scratch.materialize(customers.rfm_base(_orders(shop), shop.payments))


def _segments(shop: Shop) -> DataFrame:
    return customers.rfm_segments(customers.rfm_scores(_rfm(shop)))


def _ltv(shop: Shop) -> DataFrame:
    return customers.customer_ltv(_orders(shop), shop.payments)


# Products --------------------------------------------------------------------------


def _categories(shop: Shop, k: int | None = None) -> DataFrame:
    return products.category_performance(shop.items, shop.products, _orders(shop), k)


def _funnel(shop: Shop) -> DataFrame:
    """Users by day and stage."""
    events = shop.table("events").withColumn("day", F.to_date("ts"))
    return products.funnel_rates(events, "event_type", "user_id", FUNNEL, by="day")


def _funnel_summary(shop: Shop) -> DataFrame:
    """Means of doubles depend on the order of addition in the last digits: rounded."""
    summary = products.funnel_summary(_funnel(shop), FUNNEL)
    rates = [c for c in summary.columns if c.startswith("avg_")]
    return summary.withColumns({c: F.round(c, 9) for c in rates})


# Operations ------------------------------------------------------------------------


def _delivered(shop: Shop) -> DataFrame:
    return operations.delivered_orders(_orders(shop))


def _sellers(shop: Shop) -> DataFrame:
    return operations.seller_performance(_delivered(shop), shop.items)


# Reviews ---------------------------------------------------------------------------


def _enriched(shop: Shop) -> DataFrame:
    return reviews.reviews_enriched(shop.reviews, shop.items, shop.products, shop.translation)


def _category_reviews(shop: Shop) -> DataFrame:
    return reviews.filter_reviews(_enriched(shop), CATEGORY)


def review_page(shop: Shop) -> DataFrame:
    """The fifth page of twenty of all reviews, best first."""
    found = reviews.review_pages(_enriched(shop), "score_desc").page(80, 20)
    return found.select("position", "review_id", "order_id", "order_item_id", "review_score", "price")


def customers_by_month(shop: Shop) -> DataFrame:
    """Customers by month from sketches, and whether these are within four standard errors of the exact numbers."""
    months = shop.orders.select(F.date_format("order_purchase_timestamp", "yyyy-MM").alias("month"), "customer_id")
    exact = months.groupBy("month").agg(F.count_distinct("customer_id").alias("customers"))
    found = distinct.counts(distinct.distinct_sketches(months, "month", "customer_id")).join(exact, "month")
    apart = F.abs(F.col("n_distinct") - F.col("customers"))
    bound = F.greatest(4 * distinct.standard_error() * F.col("customers"), F.lit(1.0))
    return found.select("month", "customers", (apart <= bound).alias("is_close"))


def _by_category(shop: Shop) -> DataFrame:
    """The compact grain, for everything that counts or averages."""
    return reviews.reviews_by_category(
        shop.reviews, shop.items, shop.products, shop.translation
    )


def _category_scores(shop: Shop) -> DataFrame:
    return reviews.filter_reviews(_by_category(shop), CATEGORY)


def _rounded_describe(shop: Shop) -> DataFrame:
    stats = operations.describe_numeric(shop.items, "freight_value")
    return stats.withColumn("std", F.round("std", 9))


# Strategy --------------------------------------------------------------------------


def _summary(shop: Shop) -> DataFrame:
    return strategy.business_summary(_orders(shop), shop.payments, shop.items, shop.products)


def _quadrant_picks(shop: Shop) -> DataFrame:
    """Products that earn much with few sales, and with many, against the averages."""
    sales = products.product_sales(shop.items, _orders(shop)).select(
        "product_id",
        F.col("n").alias("sales_volume"),
        F.col("revenue").alias("total_revenue"),
    )
    averages = sales.agg(
        F.struct(mean(F.col("sales_volume")).alias("x"), mean(F.col("total_revenue")).alias("y"))
    ).scalar()
    return strategy.quadrant_topk(
        sales,
        "sales_volume",
        "total_revenue",
        averages["x"],
        averages["y"],
        picks=[("Quick Wins", "total_revenue", 3), ("Strategic Projects", "sales_volume", 2)],
        key="product_id",
    )


def _roi(shop: Shop) -> DataFrame:
    states = overview.state_orders_revenue(_orders(shop), shop.payments, shop.customers)
    return strategy.roi_projection(
        states, "customer_state", "total_revenue", investment=1_000_000, increase_pct=25
    )


def _report(shop: Shop) -> DataFrame:
    summary = _summary(shop)
    outlook = strategy.roi_projection(
        summary.withColumn("scope", F.lit("all")), "scope", "total_revenue",
        investment=1_000_000, increase_pct=25,
    )
    return strategy.report(summary, _quadrant_picks(shop), outlook)


BUILDERS: dict[str, Callable[[Shop], DataFrame]] = {
    # Sources and periods
    "q01_load_tables": load_tables,
    "q01_key_violations": key_violations,
    "q01_quarantined_rows": quarantined_rows,
    "q02_period_columns": period_columns,
    "q03_orders_with_payments": lambda s: periods.orders_with_payments(s.orders, s.payments),
    "q04_orders_with_items": lambda s: periods.orders_with_items(s.orders, s.items),
    "q05_period_bounds": lambda s: periods.period_bounds(s.orders),
    "q06_filter_period": _orders,
    "q06_month_folders": month_folders,
    "q07_bucketed_items": bucketed_items,
    "q07_restrict_to_orders": lambda s: periods.restrict_to_orders(s.items, _orders(s)),
    "q08_previous_period": lambda s: periods.previous_period(s.orders, *PERIOD),
    "q08_previous_payments": previous_payments,
    # Executive overview
    "q09_period_kpis": lambda s: overview.period_kpis(s.orders, s.payments, *PERIOD),
    "q10_growth": growth,
    "q11_monthly_orders_revenue": lambda s: overview.monthly_orders_revenue(
        _orders(s), s.payments
    ),
    "q12_orders_per_customer": lambda s: overview.orders_per_customer_pct(_orders(s)),
    "q13_avg_items_per_order": lambda s: overview.avg_items_per_order(_orders(s), s.items),
    "q14_top_payment_method": lambda s: overview.top_payment_method(s.payments),
    "q15_customers_by_month": customers_by_month,
    "q15_new_vs_returning": lambda s: overview.new_vs_returning(_orders(s)),
    "q16_state_orders_revenue": lambda s: overview.state_orders_revenue(
        _orders(s), s.payments, s.customers
    ),
    "q16_top_states": lambda s: overview.state_orders_revenue(
        _orders(s), s.payments, s.customers, k=5
    ),
    "q17_category_items_sold": lambda s: overview.category_items_sold(s.items, s.products),
    "q17_top_categories": lambda s: overview.category_items_sold(s.items, s.products, k=3),
    # Customers and market
    "q18_rfm_base": lambda s: customers.rfm_base(_orders(s), s.payments),
    "q19_rfm_scores": lambda s: customers.rfm_scores(_rfm(s)),
    "q20_rfm_segments": _segments,
    "q21_segment_mix": lambda s: customers.segment_mix(_segments(s)),
    "q21_segment_summary": lambda s: customers.segment_summary(
        customers.segment_mix(_segments(s))
    ),
    "q22_city_orders_geo": lambda s: customers.city_orders_geo(
        _orders(s), s.customers, s.geolocation
    ),
    "q22_top_cities": lambda s: customers.city_orders_geo(
        _orders(s), s.customers, s.geolocation, k=10
    ),
    "q23_state_orders_geo": lambda s: customers.state_orders_geo(
        _orders(s), s.customers, s.geolocation
    ),
    "q23_top_states_geo": lambda s: customers.state_orders_geo(
        _orders(s), s.customers, s.geolocation, k=5
    ),
    "q24_customer_ltv": _ltv,
    "q25_ltv_summary": lambda s: customers.ltv_summary(scratch.materialize(_ltv(s))),
    "q26_ltv_histogram": lambda s: histogram(_ltv(s), "total_spent", 50),
    "q26_order_count_histogram": lambda s: histogram(_ltv(s), "order_count", 20),
    "q27_payment_mix": lambda s: customers.payment_mix(s.payments),
    "q28_payment_trend": lambda s: customers.payment_trend(_orders(s), s.payments),
    "q29_top_state": lambda s: customers.top_state(_orders(s), s.customers),
    # Products and leads
    "q30_category_performance": _categories,
    "q30_top_categories": lambda s: _categories(s, k=3),
    "q30_category_summary": lambda s: products.category_summary(_categories(s)),
    "q31_product_rating_sales": lambda s: products.product_rating_sales(
        s.items, s.products, s.reviews, _orders(s)
    ),
    "q32_funnel_rates": _funnel,
    "q32_funnel_overall": lambda s: products.funnel_rates(
        s.table("events"), "event_type", "user_id", FUNNEL
    ),
    "q32_funnel_summary": _funnel_summary,
    "q33_top_funnel": lambda s: products.top_funnel(_funnel(s), "purchase_rate", "day", k=10),
    # Operations
    "q34_delivered_orders": _delivered,
    "q35_delivery_kpis": lambda s: operations.delivery_kpis(_orders(s)),
    "q36_delivery_quartiles": lambda s: operations.delivery_quartiles(_delivered(s)),
    "q37_freight_totals": lambda s: operations.freight_totals(s.items),
    "q38_describe_freight": _rounded_describe,
    "q39_delivery_time_distribution": lambda s: operations.delivery_time_distribution(
        _delivered(s)
    ),
    "q40_freight_distribution": lambda s: operations.freight_distribution(s.items),
    "q41_seller_performance": _sellers,
    "q42_seller_sample": lambda s: operations.seller_sample(_sellers(s)),
    "q43_fastest_sellers": lambda s: operations.rank_sellers(_sellers(s)),
    "q43_slowest_sellers": lambda s: operations.rank_sellers(_sellers(s), slowest=True),
    "q44_payment_summary": lambda s: operations.payment_summary(s.payments),
    "q45_order_status_summary": lambda s: operations.order_status_summary(_orders(s)),
    # Reviews
    "q46_reviews_enriched": _enriched,
    "q47_review_categories": lambda s: reviews.review_categories(_by_category(s)),
    "q48_filter_reviews": lambda s: reviews.filter_reviews(_enriched(s), CATEGORY, (4, 5)),
    "q49_review_kpis": lambda s: reviews.review_kpis(_category_scores(s)),
    "q49_review_kpis_by_category": lambda s: reviews.review_kpis(
        _by_category(s), by=reviews.CATEGORY
    ),
    "q50_rating_distribution": lambda s: reviews.rating_distribution(_category_scores(s)),
    "q51_sentiment_mix": lambda s: reviews.sentiment_mix(_category_scores(s)),
    "q52_review_trend": lambda s: reviews.review_trend(_category_scores(s)),
    "q53_rating_by_calendar_month": lambda s: reviews.rating_by_calendar_month(
        _category_scores(s)
    ),
    "q54_rating_by_weekday": lambda s: reviews.rating_by_weekday(_category_scores(s)),
    "q55_positive_comments": lambda s: reviews.sample_comments(
        _category_reviews(s), "positive"
    ),
    "q55_negative_comments": lambda s: reviews.sample_comments(
        _category_reviews(s), "negative"
    ),
    "q56_search_reviews": lambda s: reviews.search_reviews(_enriched(s), SEARCH_TERM),
    "q56_search_literal": lambda s: reviews.search_reviews(
        _enriched(s), "License", regex=False
    ),
    "q57_sort_by_date": lambda s: reviews.sort_reviews(_category_reviews(s), "date_desc"),
    "q57_sort_by_score": lambda s: reviews.sort_reviews(_category_reviews(s), "score_desc"),
    "q57_review_page": review_page,
    "q57_sort_by_score_asc": lambda s: reviews.sort_reviews(_category_reviews(s), "score_asc"),
    "q57_sort_by_price": lambda s: reviews.sort_reviews(_category_reviews(s), "price_desc"),
    "q57_sort_by_price_asc": lambda s: reviews.sort_reviews(_category_reviews(s), "price_asc"),
    "q58_review_display": lambda s: reviews.review_display(_enriched(s)),
    "q59_review_extremes": lambda s: reviews.review_extremes(_category_scores(s)),
    "q60_export_csv": lambda s: export_reviews(s, "csv"),
    "q60_export_json": lambda s: export_reviews(s, "json"),
    # Strategy
    "q61_business_summary": _summary,
    "q62_quadrant_topk": _quadrant_picks,
    "q63_roi_projection": _roi,
    "q64_report": _report,
}
