"""What the plans must look like at scale."""

import re
from types import SimpleNamespace

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketlens.functions import ranks
from marketlens.functions.tables import left_join_many
from marketlens.operators import customers, operations, periods, products
from marketlens.plans import registry
from marketlens.plans.registry import queries
from marketlens.plans.shop import PERIOD, Shop
from marketlens.sources import layout, scratch

LAZY = [n for n in queries() if not n.startswith(("q01", "q60", "q06_month", "q07_bucketed"))]


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def shuffled_joins(spark):
    """No broadcast joins, as with tables beyond the size threshold."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for key in keys:
        spark.conf.set(key, "-1")
    yield
    for key in keys:
        spark.conf.unset(key)


def test_period_filter_reaches_the_scan(spark, folder):
    plan = executed(periods.filter_period(Shop(spark, folder).orders, *PERIOD))
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(o_orderdate", plan)
    assert "o_totalprice" not in plan


def test_both_sides_are_read_and_shuffled_once_without_hot_keys(spark, folder, shuffled_joins):
    shop = Shop(spark, folder)
    joined = periods.orders_with_items(shop.orders, shop.items)
    assert scans(joined, "l_orderkey") == (1, 2) and scans(joined, "o_orderkey")[0] == 1
    assert "LeftOuter" in executed(joined) and "LeftAnti" not in executed(joined)


def test_hot_key_on_the_right_is_split(spark, shuffled_joins):
    """A third of the right rows share a key; the result stays whole."""
    sizes = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for key, value in sizes.items():
        spark.conf.set(key, value)
    try:
        left = spark.range(1000).select(F.col("id").alias("order_id"), F.lit("x").alias("l"))
        right = spark.range(0, 300_000, 1, 8).select(
            F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 900).cast("bigint").alias("order_id"),
            F.col("id").alias("r"),
        )
        joined = left_join_many(left, right, "order_id")
        rows = joined.agg(F.count("*"), F.count("r"), F.sum("r")).first()
        keys = {7} | {i % 900 for i in range(300_000) if i % 3}
        assert tuple(rows) == (300_000 + 1000 - len(keys), 300_000, sum(range(300_000)))
        joined.write.format("noop").mode("overwrite").save()
        assert "skew=true" in executed(joined)
    finally:
        for key in sizes:
            spark.conf.unset(key)


@pytest.mark.parametrize("name", ["q16_top_states", "q22_top_cities", "q43_fastest_sellers", "q55_positive_comments"])
def test_top_k_does_not_sort_everything(spark, folder, name):
    plan = queries()[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


#: What may be gathered in one task: aggregates without groups, and groups of which there are few by nature.
FEW = {
    "year_month", "month", "weekday", "customer_state", "customer_city", "segment", "payment_type", "order_status", "part",
    "review_score", "sentiment", "category", "product_category_name_english", "bin", "table", "quadrant", "metric", "stage",
}


@pytest.fixture
def frames(monkeypatch):
    """Frames as they are before they are stored, which cuts their plans."""
    seen = []

    def recording(df, *args, **kwargs):
        seen.append(df)
        return scratch.materialize(df, *args, **kwargs)

    for module in (ranks, operations):
        monkeypatch.setattr(module, "materialize", recording)
    monkeypatch.setattr(registry, "scratch", SimpleNamespace(materialize=recording, new_path=scratch.new_path))
    return seen


def gathered(plan):
    """Exchanges into one task with neither an ungrouped aggregate nor few groups below."""
    lines = plan.splitlines()
    bad = []
    for line, below in zip(lines, lines[1:]):
        if "Exchange SinglePartition" in line:
            keys = re.search(r"Aggregate\(keys?=\[(.*?)\], functions", below)
            names = set(re.findall(r"(\w+)#\d+", keys[1])) if keys else None
            if names is None or not names <= FEW:
                bad.append(below)
        if re.search(r"Window|rangepartitioning", line) and re.search(r"Window \[.*\], \[\]", line):
            bad.append(line)
    return bad


@pytest.mark.parametrize("name", LAZY)
def test_no_python_no_cross_join_no_gathered_table(spark, folder, name, frames):
    """What is gathered in one task was aggregated before: groups, not rows."""
    for df in [queries()[name](spark, folder), *frames]:
        plan = df._jdf.queryExecution().executedPlan().treeString()
        assert not re.search(
            r"BatchEvalPython|ArrowEvalPython|MapInPandas|CartesianProduct|NestedLoop", plan
        )
        assert not gathered(plan)


def test_a_window_over_all_customers_is_noticed(spark, folder):
    everyone = W.partitionBy().orderBy("customer_id")
    df = Shop(spark, folder).customers.groupBy("customer_id").count().withColumn("n", F.row_number().over(everyone))
    assert gathered(df._jdf.queryExecution().executedPlan().treeString())


def scans(df, column):
    plan = executed(df)
    final = plan.split("+- == Initial Plan ==")[0]
    return len(re.findall(rf"Scan parquet [^\n]*{column}", final)), len(re.findall(r"Exchange hashpartitioning\(order_id", final))


def test_items_and_payments_are_shuffled_once(spark, folder, shuffled_joins):
    shop = Shop(spark, folder)
    orders = periods.filter_period(shop.orders, *PERIOD)
    rated = products.product_rating_sales(shop.items, shop.products, shop.reviews, orders)
    assert scans(rated, "l_orderkey")[0] == 1
    sellers = operations.seller_performance(operations.delivered_orders(orders), shop.items)
    assert scans(sellers, "l_orderkey") == (1, 2)  # items and orders, each once
    plain = shop.items.selectExpr("order_id", "CAST(product_id AS string) AS payment_type")
    assert scans(customers.payment_trend(orders, plain), "l_orderkey") == (1, 2)


def test_delivery_times_are_counted_once(spark, folder, frames):
    shop = Shop(spark, folder)
    found = operations.delivery_time_distribution(operations.delivered_orders(shop.orders))
    assert "o_orderdate" not in executed(found)
    assert len(frames) == 1 and scans(frames[0], "o_orderdate")[0] == 1


def test_periods_read_their_months_and_join_without_a_shuffle(spark, folder, shuffled_joins):
    shop = Shop(spark, folder)
    orders, items = registry._by_month(shop)
    plan = executed(layout.period_rows(items, orders, *PERIOD)).split("+- == Initial Plan ==")[0]
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    assert plan.count("PartitionFilters: [isnotnull(purchase_month") == 2
    months = orders.select(layout.MONTH).distinct().count()
    read = re.findall(r"SelectedBucketsCount: 8 out of 8", plan)
    assert len(read) == 2 and months > 13
    plan = executed(periods.orders_with_items(orders, items.drop(layout.MONTH)))
    assert "Exchange hashpartitioning(order_id" not in plan.split("+- == Initial Plan ==")[0]
