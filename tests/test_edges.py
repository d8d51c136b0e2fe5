"""Small frames for the rules a naive rewrite gets wrong."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from marketlens.functions.columns import shortened, whole_days
from marketlens.functions.tables import histogram, hot_keys, left_join_many, with_growth
from marketlens.operators import (
    customers,
    operations,
    overview,
    periods,
    products,
    reviews,
    strategy,
)

PAYMENT = "order_id string, payment_type string, payment_value decimal(18,2), payment_installments int"
CUSTOMER = "customer_id string, customer_city string, customer_state string"
ITEM = (
    "order_id string, order_item_id int, product_id string, seller_id string,"
    " price decimal(18,2), freight_value decimal(18,2)"
)
REVIEW = (
    "review_id string, order_id string, review_score int, review_comment_title string,"
    " review_comment_message string, review_creation_date timestamp_ntz, price decimal(18,2)"
)
YEAR = ("2018-01-01", "2018-12-31")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_null_group_keys_are_left_out(frame, orders):
    places = frame([("c1", "x", "a"), ("c2", "y", None)], CUSTOMER)
    bought = orders(("o1", "c1", "2018-01-01"), ("o2", "c2", "2018-01-01"), ("o3", None, "2018-01-01"))
    paid = frame([("o1", "card", Decimal(5), 1)], PAYMENT)
    assert rows(overview.state_orders_revenue(bought, paid, places)) == [("a", 1, 5.0)]
    assert rows(customers.top_state(bought, places)) == [("a", 1)]


def test_sum_of_nothing_is_zero_and_mean_is_null(frame, orders):
    bought = orders(("o1", "c1", "2018-03-01"))
    kpis = {
        r.metric: r
        for r in overview.period_kpis(bought, frame([], PAYMENT), *YEAR).collect()
    }
    assert kpis["revenue"].current == 0.0
    assert kpis["orders"].current == 1.0
    assert kpis["avg_order_value"].current is None
    assert {r.growth_label for r in kpis.values()} == {"N/A"}


def test_empty_period(frame, orders):
    none = periods.filter_period(orders(("o1", "c1", "2017-03-01")), *YEAR)
    paid = frame([("o1", "card", Decimal(5), 1)], PAYMENT)
    kpis = overview.period_kpis(none, paid, *YEAR).collect()
    assert [r.current for r in kpis] == [0.0, 0.0, 0.0, None]
    assert rows(overview.orders_per_customer_pct(none)) == [(0.0,)]
    assert rows(overview.monthly_orders_revenue(none, paid)) == []
    assert rows(operations.delivery_kpis(none)) == [(0.0, None)]
    ltv = customers.customer_ltv(none, paid)
    assert rows(customers.ltv_summary(ltv)) == [(None, None, None, 0, None)]
    assert [r.n for r in histogram(ltv, "total_spent", 4).collect()] == [0] * 4
    assert rows(customers.rfm_scores(customers.rfm_base(none, paid))) == []


def test_fan_out(frame, orders):
    bought = orders(("o1", "c1", "2018-01-01"))
    paid = frame([("o1", "card", Decimal(10), 1)] * 3, PAYMENT)
    places = frame([("c1", "x", "a")], CUSTOMER)
    assert rows(overview.state_orders_revenue(bought, paid, places)) == [("a", 3, 30.0)]
    assert periods.orders_with_payments(bought, paid).count() == 3
    kpis = {r.metric: r.current for r in overview.period_kpis(bought, paid, *YEAR).collect()}
    assert kpis == {"revenue": 30.0, "orders": 1.0, "customers": 1.0, "avg_order_value": 10.0}


def test_elapsed_days_are_floored(spark):
    spans = spark.sql(
        """SELECT CAST(a AS timestamp_ntz) a, CAST(b AS timestamp_ntz) b FROM VALUES
        (1, '2018-01-01 03:00:00', '2018-01-01 01:00:00'),
        (2, '2018-01-01 01:00:00', '2018-01-02 00:00:00'),
        (3, '2018-01-01 01:00:00', '2018-01-02 01:00:00'),
        (4, '2018-01-01 00:00:00.5', '2018-01-01 00:00:00') AS t(i, a, b) ORDER BY i"""
    )
    assert [r[0] for r in spans.select(whole_days(F.col("a"), F.col("b"))).collect()] == [
        -1, 0, 1, -1,
    ]


def test_growth_labels(frame):
    pairs = [(110.0, 100.0), (5.0, 0.0), (1100.0, 100.0), (50.0, 100.0), (1.0, None)]
    labels = with_growth(frame(pairs, "cur double, prev double"), "cur", "prev")
    assert [r.growth_label for r in labels.collect()] == ["10.0%", "N/A", "999%+", "-50.0%", "N/A"]


def test_previous_period(orders):
    assert periods.previous_bounds("2018-01-11", "2018-01-20") == (
        dt.date(2018, 1, 1), dt.date(2018, 1, 10),
    )
    table = orders(
        ("a", "c", "2018-01-01 00:00:00"), ("b", "c", "2018-01-10 23:59:59"),
        ("c", "c", "2018-01-11 00:00:00"), ("d", "c", "2017-12-31 23:59:59"),
    )
    before = periods.previous_period(table, "2018-01-11", "2018-01-20")
    assert sorted(r.order_id for r in before.collect()) == ["a", "b"]


def test_period_bounds_are_inclusive(orders):
    table = orders(("a", "c", "2018-12-31 23:59:59"), ("b", "c", None), ("c", "c", "2019-01-01"))
    assert [r.order_id for r in periods.filter_period(table, *YEAR).collect()] == ["a"]
    with pytest.raises(ValueError):
        periods.filter_period(table, "2018-02-01", "2018-01-01")


def test_unreadable_times_become_null(frame):
    raw = frame([("a", "2018-05-06 07:08:09"), ("b", "soon")], "order_id string, order_purchase_timestamp string")
    got = rows(periods.with_period_columns(raw).select("order_id", "month", "year", "year_month"))
    assert got == [("a", "2018-05", 2018, "2018-05"), ("b", None, None, None)]


def test_new_and_returning(orders):
    table = orders(
        ("1", "c", "2018-01-05"), ("2", "c", "2018-01-09"), ("3", "c", "2018-03-01"),
        ("4", "d", "2018-03-02"), ("5", None, "2018-03-02"),
    )
    assert sorted(rows(overview.new_vs_returning(table))) == [
        ("2018-01", "New", 2), ("2018-03", "New", 1), ("2018-03", "Returning", 1),
    ]


def test_growth_looks_back_by_calendar(frame):
    monthly = frame([("2017-01", 1.0), ("2017-12", 2.0), ("2018-01", 3.0)], "year_month string, revenue double")
    back = overview.with_previous_year(monthly, "revenue")
    assert {r.year_month: r.previous for r in back.collect()} == {
        "2017-01": None, "2017-12": None, "2018-01": 1.0,
    }


def test_payment_ties_and_missing(frame):
    tied = frame([("1", "b", None, 1), ("2", "a", Decimal(2), 3), ("3", None, Decimal(4), None)], PAYMENT)
    assert rows(overview.top_payment_method(tied)) == [("a", 1)]
    assert rows(overview.top_payment_method(tied.limit(0))) == [("N/A", 0)]
    top, share, value, parts = rows(operations.payment_summary(tied))[0]
    assert (top, value, parts) == ("a", 3.0, 2.0)
    assert share == pytest.approx(100 / 3)


def test_segments(frame):
    codes = frame([("555",), ("155",), ("311",), ("999",)], "RFM_Score string")
    assert [r.segment for r in customers.rfm_segments(codes).collect()] == [
        "Champions", "At Risk", "New Customers", "Others",
    ]


def test_repeated_quintile_edges_fail(frame):
    same = frame(
        [(f"c{i}", i, 1, v) for i, v in enumerate([1.0, 1.0, 1.0, 1.0, 1.0, 2.0])],
        "customer_id string, recency bigint, frequency bigint, monetary double",
    )
    with pytest.raises(Exception, match="quintile edges must be unique"):
        customers.rfm_scores(same).collect()


def test_rounding_is_half_to_even(frame):
    sellers = frame([("a", 0.25, 5), ("b", 0.35, 5), ("c", 0.45, 5)],
                    "seller_id string, avg_delivery_time double, order_volume bigint")
    assert [r.avg_delivery_time for r in operations.rank_sellers(sellers).collect()] == [0.2, 0.4, 0.4]
    assert [r.seller_id for r in operations.rank_sellers(sellers, 2, slowest=True).collect()] == ["c", "b"]


def test_sorting_puts_nulls_last(frame):
    table = frame(
        [(str(i), "o", s, None, None, None, p) for i, (s, p) in enumerate([(3, None), (None, Decimal(1)), (1, Decimal(2))])],
        REVIEW,
    )
    by = lambda how, col: [r[col] for r in reviews.sort_reviews(table, how).collect()]
    assert by("score_desc", "review_score") == [3, 1, None]
    assert by("score_asc", "review_score") == [1, 3, None]
    assert by("price_desc", "price") == [Decimal("2.00"), Decimal("1.00"), None]
    assert by("price_asc", "price") == [Decimal("1.00"), Decimal("2.00"), None]
    with pytest.raises(ValueError):
        reviews.sort_reviews(table, "name")


def test_search(frame):
    table = frame(
        [(str(i), "o", 1, None, m, None, None) for i, m in enumerate(["a+b", "aab", None, "ÄAB"])], REVIEW
    )
    found = lambda term, **kw: [r.review_id for r in reviews.search_reviews(table, term, **kw).collect()]
    assert found("a+b") == ["1", "3"]
    assert found("A+B", regex=False) == ["0"]
    assert found("äa") == ["3"]


def test_truncation_and_fillers(frame):
    texts = frame([("x" * 150,), ("x" * 151,), (None,)], "t string")
    assert [r[0] for r in texts.select(shortened(F.col("t"), 150)).collect()] == [
        "x" * 150, "x" * 150 + "...", None,
    ]
    table = frame([("1", "o", 4, None, None, None, Decimal("1234.5")), ("2", "o", None, "t", "m", None, None)], REVIEW)
    shown = [tuple(r)[:3] + (r[4],) for r in reviews.review_display(table).collect()]
    assert shown == [
        ("⭐ 4/5", "(Tanpa Judul)", "(Tidak ada komentar)", "€ 1,234.50"), ("-", "t", "m", "-"),
    ]


def test_sentiment_keeps_empty_classes(frame):
    table = frame([("1", "o", 5, None, None, None, None), ("2", "o", 4, None, None, None, None)], REVIEW)
    assert rows(reviews.sentiment_mix(table)) == [("positive", 2), ("neutral", 0), ("negative", 0)]
    assert rows(reviews.review_extremes(table.limit(0))) == [(0, 0)]


def test_comment_samples(frame):
    table = frame(
        [(f"{i}", "o", s, t, m, None, None) for i, (s, t, m) in enumerate(
            [(5, None, "y" * 201), (4, "t", "fine"), (5, "t", None), (1, "t", "bad")])],
        REVIEW,
    )
    assert rows(reviews.sample_comments(table, "positive")) == [
        ("5/5", "-", "y" * 200 + "...", None), ("4/5", "t", "fine", None),
    ]
    assert rows(reviews.sample_comments(table, "negative", k=1)) == [("1/5", "t", "bad", None)]


def test_positive_share_may_exceed_hundred(frame):
    table = frame([("1", "o", 5, None, None, None, Decimal(3))] * 3, REVIEW)
    assert rows(reviews.review_kpis(table)) == [(5.0, 1, 300.0, 3.0)]
    assert rows(reviews.review_kpis(table.limit(0))) == [(None, 0, 0.0, None)]


def test_delivery_needs_status_and_both_dates(orders):
    table = orders(
        ("1", "c", "2018-01-01", "delivered", "2018-01-01", "2018-01-04"),
        ("2", "c", "2018-01-01", "delivered", None, "2018-01-04"),
        ("3", "c", "2018-01-01", "shipped", "2018-01-01", "2018-01-04"),
        ("4", "c", "2018-01-01", None, "2018-01-01", "2018-01-04"),
    )
    assert [(r.order_id, r.delivery_time) for r in operations.delivered_orders(table).collect()] == [("1", 3)]
    assert rows(operations.delivery_kpis(table)) == [(3.0, 50.0)]


def test_strict_delivery_dates(frame):
    table = frame([("delivered", "2018-01-01", "never")],
                  "order_status string, order_approved_at string, order_delivered_customer_date string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cannot be cast"):
        operations.delivered_orders(table).collect()


def test_seller_mean_weighs_items_but_counts_orders(frame):
    delivered = frame([(f"o{i}", i) for i in range(1, 6)], "order_id string, delivery_time bigint")
    items = frame(
        [("o1", 1, "p", "s", None, None), ("o1", 2, "p", "s", None, None)]
        + [(f"o{i}", 1, "p", "s", None, None) for i in range(2, 6)] + [("o1", 3, "p", "t", None, None)],
        ITEM,
    )
    assert rows(operations.seller_performance(delivered, items)) == [("s", 16 / 6, 5)]


def test_freight_column_may_be_absent(frame):
    items = frame([("o1",)], "order_id string")
    assert rows(operations.freight_totals(items)) == [(0.0, 0.0)]


def test_freight_distribution_trims_the_tail(frame):
    items = frame([(f"o{i}", Decimal(i)) for i in range(0, 101)], "order_id string, freight_value decimal(18,2)")
    bins = operations.freight_distribution(items, bins=5).orderBy("bin").collect()
    assert sum(r.n for r in bins) == 95
    assert bins[0].lo == 1.0 and bins[-1].hi == 95.0
    assert bins[0].median_freight == 48.0


def test_histogram_edges(frame):
    table = frame([(0.0,), (1.0,), (2.0,), (10.0,), (None,)], "x double")
    assert [(r.bin, r.n) for r in histogram(table, "x", 5).orderBy("bin").collect()] == [
        (1, 2), (2, 1), (3, 0), (4, 0), (5, 1),
    ]
    one = frame([(7.0,), (7.0,)], "x double")
    assert [r.n for r in histogram(one, "x", 3).orderBy("bin").collect()] == [2, 0, 0]


def test_describe(frame):
    table = frame([(Decimal(v),) for v in (1, 2, 3, 4)] + [(None,)], "x decimal(18,2)")
    r = operations.describe_numeric(table, "x").first()
    assert (r["count"], r["mean"], r["min"], r["q25"], r["q50"], r["q75"], r["max"]) == (4, 2.5, 1.0, 1.75, 2.5, 3.25, 4.0)
    assert r["std"] == pytest.approx(1.2909944487358056)


def test_left_join_keeps_everything(frame):
    left = frame([("a", 1), ("b", 2), (None, 3)], "k string, l int")
    right = frame([("a", 10), ("a", 11), (None, 12), ("z", 13)], "k string, r int")
    got = sorted(rows(left_join_many(left, right, "k")), key=str)
    assert got == sorted([("a", 1, 10), ("a", 1, 11), ("b", 2, None), (None, 3, None)], key=str)


@pytest.mark.parametrize("kind", ["bigint", "string", "decimal(10,0)"])
def test_left_join_with_hot_keys_keeps_everything(spark, kind):
    left = spark.sql(f"SELECT CAST(id % 7 AS {kind}) AS k, id AS l FROM range(20) UNION ALL SELECT NULL, 99")
    hot = f"SELECT CAST(if(id % 10 < 8, id % 2, id % 11) AS {kind}) AS k, id AS r FROM range(4000) UNION ALL SELECT NULL, -1"
    right = spark.sql(hot).repartition(6)
    assert sorted(map(str, hot_keys(right, "k", partitions=6))) == ["0", "1"]
    assert hot_keys(right.limit(0), "k") == [] and hot_keys(right, "k", partitions=1) == []
    plain = sorted(rows(left.join(right, "k", "left")), key=str)
    assert sorted(rows(left_join_many(left, right, "k", partitions=6)), key=str) == plain
    name = "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes"
    spark.conf.set(name, "16b")
    try:
        joined = left_join_many(left, right, "k", partitions=6)
        assert "Union" in joined._jdf.queryExecution().analyzed().toString().splitlines()[0]
        assert sorted(rows(joined), key=str) == plain
        assert sorted(rows(left_join_many(left, right, "k")), key=str) == plain
    finally:
        spark.conf.unset(name)


def test_map_point_is_the_smallest_complete_pair(frame, orders):
    places = frame([("c1", "x", "a"), ("c2", "y", "a")], CUSTOMER)
    points = frame(
        [("x", "a", None, 0.0), ("x", "a", 5.0, 2.0), ("x", "a", 5.0, 1.0)],
        "geolocation_city string, geolocation_state string, geolocation_lat double, geolocation_lng double",
    )
    bought = orders(("1", "c1", "2018-01-01"), ("2", "c1", "2018-01-01"), ("3", "c2", "2018-01-01"))
    assert rows(customers.city_orders_geo(bought, places, points)) == [
        ("x", "a", 2, 1, 5.0, 1.0), ("y", "a", 1, 1, None, None),
    ]
    assert rows(customers.state_orders_geo(bought, places, points, k=1)) == [("a", 3, 5.0, 1.0)]


def test_funnel(frame):
    events = frame(
        [("d", "u1", "view"), ("d", "u1", "view"), ("d", "u2", "view"), ("d", "u1", "click"),
         ("e", "u1", "click"), (None, "u9", "view"), ("d", "u3", "error")],
        "day string, user string, stage string",
    )
    by_day = products.funnel_rates(events, "stage", "user", ("view", "click"), by="day")
    assert sorted(rows(by_day)) == [("d", 2, 1, 0.5, 0.5), ("e", 0, 1, None, None)]
    assert rows(products.top_funnel(by_day, "click_rate", "day"))[0][0] == "d"
    assert rows(products.funnel_summary(by_day, ("view", "click"))) == [(2, 2, 0.5, 0.5)]


def test_quadrants(frame):
    table = frame(
        [("a", 5.5, 9.0), ("b", 6.0, 8.0), ("c", 1.0, 5.5), ("d", 9.0, 1.0), ("e", 2.0, 7.0)],
        "id string, effort double, impact double",
    )
    picks = [("Quick Wins", "impact", 1), ("Strategic Projects", "impact", 2), ("Avoid", "impact", 1)]
    got = strategy.quadrant_topk(table, "effort", "impact", 5.5, 5.5, picks, "id")
    assert sorted((r.pick, r["rank"], r.id, r.quadrant) for r in got.collect()) == [
        (1, 1, "a", "Quick Wins"), (2, 1, "b", "Strategic Projects"), (3, 1, "d", "Avoid"),
    ]


def test_roi(frame):
    revenue = frame([("a", 1200.0), ("b", 0.0)], "state string, revenue double")
    got = {(r.state, r.month): r for r in strategy.roi_projection(revenue, "state", "revenue", 100, 10).collect()}
    assert len(got) == 24
    a = got["a", 12]
    assert (a.monthly_increase, a.cumulative_revenue, a.net_benefit, a.roi_pct, a.payback_months) == (10.0, 120.0, 20.0, 20.0, 10.0)
    assert got["b", 1].monthly_increase == 100_000.0
    none = strategy.roi_projection(revenue, "state", "revenue", 100, 0, months=1).first()
    assert none.payback_months == float("inf")
    with pytest.raises(ValueError):
        strategy.roi_projection(revenue, "state", "revenue", 100, 10, months=0)


def test_top_k_has_no_random_ties(frame):
    items = frame([("o", i, f"p{i}", "s", None, None) for i in range(4)], ITEM)
    goods = frame([(f"p{i}", c) for i, c in enumerate("dcba")], "product_id string, product_category_name string")
    assert rows(overview.category_items_sold(items, goods, k=2)) == [("a", 1), ("b", 1)]


def test_amounts_keep_their_digits(spark):
    orders = spark.createDataFrame([("o", "c")], "order_id string, customer_id string")
    for kind in ("string", "double", "decimal(10,3)"):
        payments = spark.createDataFrame([("o", "0.004")] * 3, "order_id string, payment_value string")
        payments = payments.withColumn("payment_value", F.col("payment_value").cast(kind))
        assert customers.customer_ltv(orders, payments).first().total_spent == 0.012


def test_an_amount_too_large_is_an_error(spark):
    orders = spark.createDataFrame([("o", "c")], "order_id string, customer_id string")
    payments = spark.createDataFrame([("o", "1e30")], "order_id string, payment_value string")
    with pytest.raises(Exception, match="does not fit"):
        customers.customer_ltv(orders, payments).collect()
    missing = spark.createDataFrame([("o", "much"), ("o", "NaN")], "order_id string, payment_value string")
    assert customers.customer_ltv(orders, missing).first().total_spent == 0


def test_mean_and_median_of_large_totals_agree(spark):
    ltv = spark.createDataFrame([("a", 2e16, 1), ("b", 10.0, 1)], "customer_id string, total_spent double, order_count long")
    row = customers.ltv_summary(ltv).first()
    assert row.avg_clv == row.median_clv == 1e16 + 5


def test_nan_is_missing_in_descriptions_and_beyond_all_growth(spark):
    row = operations.describe_numeric(spark.createDataFrame([(1.0,), (3.0,), (float("nan"),), (None,)], "x double"), "x").first()
    assert (row["count"], row["mean"], row["max"]) == (2, 2.0, 3.0)
    grown = spark.createDataFrame([(float("nan"), 1.0), (1.0, None)], "now double, before double")
    assert [r.growth_label for r in with_growth(grown, "now", "before").collect()] == ["999%+", "N/A"]


def test_limits_and_defaults_are_parameters(spark):
    revenue = spark.createDataFrame([("a", 0.0), ("b", None)], "state string, revenue double")
    rows = strategy.roi_projection(revenue, "state", "revenue", 100, 10, months=1, default_monthly=50.0).orderBy("state").collect()
    assert rows[0].monthly_increase == 5.0 and rows[1].monthly_increase is None and rows[1].payback_months is None


def test_hot_order_in_ratings_and_sellers(spark):
    """One order holds a third of the items."""
    items = spark.range(3000).selectExpr(
        "CAST(CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS string) AS order_id", "CAST(id % 5 AS string) AS product_id",
        "CAST(1 AS int) AS order_item_id", "CAST(id % 4 AS string) AS seller_id", "CAST(1 AS decimal(18,2)) AS price",
    )
    orders = items.select("order_id").distinct()
    given = spark.createDataFrame([("7", 1, "r1"), ("7", 3, "r2"), ("1", 5, "r3")], "order_id string, review_score int, review_id string")
    goods = spark.createDataFrame([(str(i), "c") for i in range(5)], "product_id string, product_category_name string")
    rows = products.product_rating_sales(items, goods, given, orders).collect()
    assert sum(r.sales_volume for r in rows) == 3000 == sum(r.total_revenue for r in rows)
    assert {r.product_id: r.avg_rating for r in rows}["0"] == 2.0
    delivered = orders.selectExpr("order_id", "CASE WHEN order_id = '7' THEN 4 ELSE 1 END AS delivery_time")
    sellers = operations.seller_performance(delivered, items, min_orders=1).collect()
    assert len(sellers) == 4 and sum(r.order_volume for r in sellers) == 2000 + 4 - 1


def test_newest_reviews_come_first(spark):
    rows = [("a", dt.datetime(2018, 1, 2)), ("b", None), ("c", dt.datetime(2018, 3, 1)), ("d", dt.datetime(2018, 1, 2))]
    table = spark.createDataFrame(rows, "review_id string, review_creation_date timestamp_ntz")
    assert [r.review_id for r in reviews.sort_reviews(table).collect()] == ["c", "a", "d", "b"]


def test_description_of_amounts_with_eight_decimals(spark):
    small = spark.sql("SELECT CAST(0.00000004 AS decimal(28,8)) AS x FROM range(3)")
    got = operations.describe_numeric(small, "x").first()
    assert got["mean"] == pytest.approx(4e-08, rel=1e-15) and got["min"] == 4e-08 and got["std"] == pytest.approx(0, abs=1e-20)
    large = spark.sql("SELECT CAST(12345678901234567890.00000001 AS decimal(28,8)) AS x FROM range(1000)")
    assert operations.describe_numeric(large, "x").first()["mean"] == 12345678901234567890.00000001
    mixed = spark.sql("SELECT CAST(v AS decimal(28,8)) AS x FROM VALUES ('-0.00000001'), ('0.00000003'), ('-2.5'), (NULL) AS t(v)")
    assert operations.describe_numeric(mixed, "x").first()["mean"] == pytest.approx(-2.49999998 / 3, rel=1e-15)
