"""Relations that must hold between results."""

from decimal import Context, Decimal, localcontext

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marketlens.functions.columns import weighted_total
from marketlens.operators import overview, reviews
from marketlens.plans.registry import queries
from marketlens.plans.shop import Shop


@pytest.fixture
def run(spark, folder):
    built = queries()
    return lambda name: built[name](spark, folder)


@pytest.fixture(scope="module")
def shop(spark, folder):
    return Shop(spark, folder)


def total(df, col="n"):
    return df.agg(F.sum(col)).first()[0]


def test_segments_cover_all_customers(run):
    customers = run("q18_rfm_base").count()
    mix = run("q21_segment_mix")
    assert total(mix) == customers == run("q20_rfm_segments").count()
    assert total(mix, "pct") == pytest.approx(100)


def test_scores_rise_with_the_value(run):
    scored = run("q19_rfm_scores").toPandas()
    assert scored.sort_values("monetary").M_score.is_monotonic_increasing
    assert scored.sort_values("recency").R_score.is_monotonic_decreasing
    assert scored.sort_values(["frequency", "customer_id"]).F_score.is_monotonic_increasing


def test_histograms_count_every_row(run):
    assert total(run("q26_ltv_histogram")) == run("q24_customer_ltv").count()
    delivered = run("q34_delivered_orders").where("delivery_time <= 100").count()
    assert total(run("q39_delivery_time_distribution")) == delivered


def test_children_belong_to_the_period(run):
    ids = run("q06_filter_period").select("order_id")
    assert run("q07_restrict_to_orders").join(ids, "order_id", "left_anti").count() == 0


def test_payment_rows_are_at_least_orders(run):
    by_rows = {r.customer_state: r.total_orders for r in run("q16_state_orders_revenue").collect()}
    by_order = {r.customer_state: r.total_orders for r in run("q23_state_orders_geo").collect()}
    assert by_rows.keys() == by_order.keys()
    assert all(by_rows[s] >= by_order[s] for s in by_order)


def test_month_and_period_revenue_agree(run):
    kpis = {r.metric: r.current for r in run("q09_period_kpis").collect()}
    assert total(run("q11_monthly_orders_revenue"), "revenue") == pytest.approx(kpis["revenue"])
    assert run("q61_business_summary").first().total_revenue == kpis["revenue"]


def test_all_documents_are_review_messages(shop):
    texts = shop.reviews.where("review_comment_message IS NOT NULL").select("order_id").distinct()
    assert texts.count() == shop.table("documents").count()


@pytest.mark.parametrize(
    "operator",
    [
        reviews.review_kpis,
        lambda r: reviews.review_kpis(r, by=reviews.CATEGORY),
        reviews.rating_distribution,
        reviews.sentiment_mix,
        reviews.review_trend,
        reviews.rating_by_calendar_month,
        reviews.rating_by_weekday,
        reviews.review_extremes,
        reviews.review_categories,
    ],
)
def test_both_review_grains_agree(shop, operator):
    args = (shop.reviews, shop.items, shop.products, shop.translation)
    by_item = operator(reviews.reviews_enriched(*args)).collect()
    by_category = operator(reviews.reviews_by_category(*args)).collect()
    assert sorted(map(str, by_item)) == sorted(map(str, by_category))


def test_top_k_is_the_head_of_the_whole(shop):
    args = (shop.items, shop.products)
    assert overview.category_items_sold(*args, k=3).collect() == overview.category_items_sold(
        *args
    ).collect()[:3]


def test_hot_order_does_not_become_all_its_pairs(spark):
    """One order holds a third of all reviews and items: 10^9 pairs, never built."""
    hot = "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('o', id) END AS order_id"
    scores = spark.range(90_000).selectExpr(
        "concat('r', id) AS review_id", hot,
        "CAST(CASE WHEN id % 3 = 0 THEN 5 ELSE 2 END AS int) AS review_score",
        "CAST('2018-05-06' AS timestamp_ntz) AS review_creation_date",
    )
    items = spark.range(120_000).selectExpr(
        hot, "1 AS order_item_id", "concat('p', id % 2) AS product_id",
        "CAST(id % 2 AS decimal(18,2)) AS price",
    )
    goods = spark.createDataFrame(
        [("p0", "a"), ("p1", "b")], "product_id string, product_category_name string"
    )
    names = spark.createDataFrame(
        [("a", "one"), ("b", "two")],
        "product_category_name string, product_category_name_english string",
    )
    compact = reviews.reviews_by_category(scores, items, goods, names)
    kpis = reviews.review_kpis(reviews.filter_reviews(compact, "two")).first()
    # Category "two": 20,000 items of the hot order times its 30,000 reviews, and one item
    # for each of the other reviewed orders with an odd number.
    pairs, single = 20_000 * 30_000, 30_000
    assert kpis.total_reviews == 30_000 + single
    assert kpis.avg_rating == (5 * pairs + 2 * single) / (pairs + single)
    assert kpis.avg_price == 1.0
    assert kpis.positive_pct == pairs / (30_000 + single) * 100


@settings(max_examples=12, deadline=None)
@given(
    st.sampled_from([(28, 8), (18, 2), (12, 0), (20, 18), (10, 10)]),
    st.lists(st.tuples(st.integers(-(10**28), 10**28), st.integers(1, 10**9)), min_size=1, max_size=30),
)
def test_weighted_totals_keep_all_digits(spark, kind, rows):
    digits, places = kind
    rows = [(Decimal(x % 10**digits if x > 0 else -(-x % 10**digits)).scaleb(-places, Context(prec=60)), n) for x, n in rows]
    df = spark.createDataFrame(rows, f"x decimal({digits},{places}), n bigint")
    with localcontext(Context(prec=80)):
        exact = sum(x * n for x, n in rows)
    assert df.agg(weighted_total(df, "x", "n").alias("t")).first().t == float(exact)
