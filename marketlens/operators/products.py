"""Products and leads: category performance, ratings against sales, funnels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions.columns import amount, ratio, total
from marketlens.functions.tables import ranked
from marketlens.operators.periods import restrict_to_orders

# Attribute columns (two of them spelled as in the files) and their short names.
ATTRIBUTES = {
    "product_name_lenght": "name_length",
    "product_description_lenght": "description_length",
    "product_photos_qty": "photos_qty",
    "product_weight_g": "weight_g",
    "product_length_cm": "length_cm",
    "product_height_cm": "height_cm",
    "product_width_cm": "width_cm",
}


def product_sales(items: DataFrame, orders: DataFrame) -> DataFrame:
    """Items and revenue per product within ``orders``: ``product_id, n, revenue``."""
    sold = items.select("order_id", "product_id", "order_item_id", amount(items, "price").alias("price"))
    return (
        restrict_to_orders(sold, orders)
        .groupBy("product_id")
        .agg(F.count("order_item_id").alias("n"), F.sum("price").alias("revenue"))
    )


def category_performance(
    items: DataFrame, products: DataFrame, orders: DataFrame, k: int | None = None
) -> DataFrame:
    """Categories by revenue within ``orders``.

    Output: ``category, total_items_sold, total_revenue, unique_products``. Sales are added
    up per product before the category is looked up, which also makes the distinct product
    count a plain count.
    """
    categories = (
        product_sales(items, orders)
        .join(products.select("product_id", "product_category_name"), "product_id")
        .where(F.col("product_category_name").isNotNull())
        .groupBy(F.col("product_category_name").alias("category"))
        .agg(
            F.sum("n").alias("total_items_sold"),
            total(F.col("revenue")).alias("total_revenue"),
            F.count("*").alias("unique_products"),
        )
    )
    return ranked(categories, F.desc("total_revenue"), F.asc("category"), k=k)


def category_summary(performance: DataFrame) -> DataFrame:
    """``top_category, top_revenue, total_categories`` in one row."""
    top = F.min(F.struct((-F.col("total_revenue")).alias("r"), "category"))
    return performance.agg(top.alias("top"), F.count("*").alias("total_categories")).select(
        F.col("top.category").alias("top_category"),
        (-F.col("top.r")).alias("top_revenue"),
        "total_categories",
    )


def product_rating_sales(
    items: DataFrame, products: DataFrame, reviews: DataFrame, orders: DataFrame
) -> DataFrame:
    """Sales within ``orders`` against the mean review score over all orders, per product.

    Output: ``product_id, category, sales_volume, total_revenue``, the product attributes
    present in ``products`` and ``avg_rating``. The score is weighted by item x review
    rows. Reviews are added up per order before they meet items, so an order with many items
    and many reviews never turns into all its pairs, and items are shuffled once: each order
    carries its scores and whether it is one of ``orders``.
    """
    present = {c: name for c, name in ATTRIBUTES.items() if c in products.columns}
    scores = reviews.groupBy("order_id").agg(
        F.sum("review_score").alias("score"), F.count("review_score").alias("scored")
    )
    chosen = orders.select("order_id").distinct().withColumn("chosen", F.lit(True))
    per_order = scores.join(chosen, "order_id", "full")
    sold = items.select(
        "order_id", "product_id", "order_item_id", amount(items, "price").alias("price")
    )
    per_product = (
        sold.join(per_order, "order_id")
        .groupBy("product_id")
        .agg(
            F.max("chosen").alias("chosen"),
            F.count(F.when(F.col("chosen"), F.col("order_item_id"))).alias("n"),
            F.sum(F.when(F.col("chosen"), F.col("price"))).alias("revenue"),
            ratio(F.sum("score"), F.sum("scored")).alias("avg_rating"),
        )
        .where("chosen")
    )
    described = products.select(
        "product_id",
        F.col("product_category_name").alias("category"),
        *(F.col(c).alias(name) for c, name in present.items()),
    ).where(F.col("category").isNotNull())
    return (
        per_product.join(described, "product_id")
        .select(
            "product_id",
            "category",
            F.col("n").alias("sales_volume"),
            F.coalesce("revenue", F.lit(0)).cast("double").alias("total_revenue"),
            *present.values(),
            "avg_rating",
        )
    )


def funnel_rates(
    df: DataFrame,
    stage_col: str,
    entity_col: str,
    stages: Sequence[str],
    by: str | None = None,
) -> DataFrame:
    """Entities that reached each stage, and the rates from stage to stage.

    Output: ``by`` (if given), ``n_<stage>`` for each stage, ``<stage>_rate`` against the
    stage before, ``overall_conversion`` from first to last. One aggregation per entity
    notes the stages it reached; no distinct count per stage is needed.
    """
    keys = [by] if by else []
    events = df.where(F.col(stage_col).isin(list(stages)) & F.col(entity_col).isNotNull())
    if by:
        events = events.where(F.col(by).isNotNull())
    reached = events.groupBy(*keys, entity_col).agg(
        *(F.max((F.col(stage_col) == s).cast("int")).alias(f"n_{s}") for s in stages)
    )
    counts = reached.groupBy(*keys).agg(
        *(F.coalesce(F.sum(f"n_{s}"), F.lit(0)).cast("bigint").alias(f"n_{s}") for s in stages)
    )
    first, last = stages[0], stages[-1]
    return counts.select(
        "*",
        *(
            ratio(F.col(f"n_{b}"), F.col(f"n_{a}")).alias(f"{b}_rate")
            for a, b in zip(stages, stages[1:])
        ),
        ratio(F.col(f"n_{last}"), F.col(f"n_{first}")).alias("overall_conversion"),
    )


def funnel_summary(funnel: DataFrame, stages: Sequence[str]) -> DataFrame:
    """Totals per stage and mean rates of a funnel with groups, in one row."""
    rates = [*(f"{s}_rate" for s in stages[1:]), "overall_conversion"]
    return funnel.agg(
        *(F.coalesce(F.sum(f"n_{s}"), F.lit(0)).alias(f"total_{s}") for s in stages),
        *(F.avg(r).alias(f"avg_{r}") for r in rates),
    )


def top_funnel(funnel: DataFrame, rate_col: str, by: str, k: int = 10) -> DataFrame:
    """The groups with the highest rate."""
    return ranked(funnel, F.desc_nulls_last(rate_col), F.asc(by), k=k)
