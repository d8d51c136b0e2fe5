"""Customers and market: RFM segments, places, lifetime value, payment habits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.columns import (
    amount,
    mean,
    ratio,
    timestamp,
    total,
    whole_days,
    year_month,
)
from marketlens.functions.ranks import day_quantiles, keys_at_ranks, quantile, quantiles
from marketlens.functions.tables import counted, ranked, with_share
from marketlens.operators.overview import orders_with_totals
from marketlens.operators.periods import PURCHASED

# Segment of each score code. Codes in none of the lists are "Others".
SEGMENTS = {
    "Champions": ["555", "554", "544", "545", "454", "455", "445"],
    "Loyal Customers": ["543", "444", "435", "355", "354", "345", "344", "335"],
    "Potential Loyalists": [
        "553", "551", "552", "541", "542", "533", "532", "531", "452", "451",
    ],
    "New Customers": ["512", "511", "422", "421", "412", "411", "311"],
    "At Risk": ["155", "154", "144", "214", "215", "115", "114"],
}


def rfm_base(orders: DataFrame, payments: DataFrame) -> DataFrame:
    """Per customer: ``customer_id, recency, frequency, monetary``.

    Recency is the number of whole days from the customer's last purchase to the last
    purchase of all ``orders``; frequency counts orders; monetary adds up payments.
    """
    bought = orders.select("order_id", "customer_id", timestamp(PURCHASED).alias("ts"))
    newest = bought.agg(F.max("ts")).scalar()
    return (
        orders_with_totals(bought, payments)
        .where(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(
            F.max("ts").alias("last"),
            F.count("*").alias("frequency"),
            total(F.col("paid")).alias("monetary"),
        )
        .select(
            "customer_id",
            whole_days(F.col("last"), newest).alias("recency"),
            "frequency",
            "monetary",
        )
    )


def rfm_scores(rfm: DataFrame) -> DataFrame:
    """Adds ``R_score, F_score, M_score`` (1 to 5) and the code ``RFM_Score``.

    Recency and money are cut at their quintiles, right-closed; recent customers score
    high. If an edge repeats, the quintiles do not exist and the query fails. Frequency is
    cut at the quintiles of its unique rank, where ties rank by ``customer_id``: the score
    compares (frequency, id) with the four pairs at the border ranks, so nothing has to be
    numbered from 1 to n.

    Reads ``rfm`` once per score and once for the result: pass a table that is stored
    (``scratch.materialize``).
    """
    steps = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)
    recency = _inner_edges(day_quantiles(rfm, "recency", steps))
    monetary = _inner_edges(quantiles(rfm, "monetary", steps))

    pair = F.struct("frequency", "customer_id")
    border_ranks = "transform(array(0.2D, 0.4D, 0.6D, 0.8D), p -> floor(1 + (total - 1) * p))"
    pairs = keys_at_ranks(rfm, ["frequency", "customer_id"], border_ranks)
    borders = pairs.agg(F.collect_list("key"))
    return (
        rfm.select(
            "*",
            recency.scalar().alias("r"),
            borders.scalar().alias("f"),
            monetary.scalar().alias("m"),
        )
        .select(
            *rfm.columns,
            (5 - _passed("r", F.col("recency"))).alias("R_score"),
            (1 + _passed("f", pair)).alias("F_score"),
            (1 + _passed("m", F.col("monetary"))).alias("M_score"),
        )
        .withColumn("RFM_Score", F.concat("R_score", "F_score", "M_score"))
    )


def rfm_segments(scores: DataFrame) -> DataFrame:
    """Adds ``segment`` by score code."""
    code = F.col("RFM_Score")
    rules = [F.when(code.isin(codes), F.lit(segment)) for segment, codes in SEGMENTS.items()]
    return scores.withColumn("segment", F.coalesce(*rules, F.lit("Others")))


def segment_mix(segmented: DataFrame) -> DataFrame:
    """Segment sizes: ``segment, n, pct``, largest first."""
    return ranked(
        with_share(counted(segmented, "segment")), F.desc("n"), F.asc("segment")
    )


def segment_summary(mix: DataFrame) -> DataFrame:
    """Largest segment, its share, number of segments."""
    top = F.min(F.struct((-F.col("n")).alias("n"), "segment", "pct"))
    return mix.agg(top.alias("top"), F.count("*").alias("total_segments")).select(
        F.col("top.segment").alias("top_segment"),
        F.col("top.pct").alias("segment_pct"),
        "total_segments",
    )


def city_orders_geo(
    orders: DataFrame, customers: DataFrame, geolocation: DataFrame, k: int | None = None
) -> DataFrame:
    """Cities by orders, with a map point where one is known.

    Output: ``customer_city, customer_state, total_orders, unique_customers,
    geolocation_lat, geolocation_lng``. The point is the smallest (lat, lng) of the city.
    """
    keys = ["customer_city", "customer_state"]
    cities = (
        _orders_per_customer(orders, customers, keys)
        .groupBy(*keys)
        .agg(F.sum("n").alias("total_orders"), F.count("*").alias("unique_customers"))
    )
    points = _map_points(geolocation, ["geolocation_city", "geolocation_state"]).toDF(
        *keys, "geolocation_lat", "geolocation_lng"
    )
    return ranked(
        cities.join(points, keys, "left"),
        F.desc("total_orders"), F.asc("customer_city"), F.asc("customer_state"),
        k=k,
    )


def state_orders_geo(
    orders: DataFrame, customers: DataFrame, geolocation: DataFrame, k: int | None = None
) -> DataFrame:
    """States by distinct orders, with a map point where one is known.

    Output: ``customer_state, total_orders, geolocation_lat, geolocation_lng``.
    """
    states = (
        _orders_per_customer(orders, customers, ["customer_state"])
        .groupBy("customer_state")
        .agg(F.sum("n").alias("total_orders"))
    )
    points = _map_points(geolocation, ["geolocation_state"]).toDF(
        "customer_state", "geolocation_lat", "geolocation_lng"
    )
    return ranked(
        states.join(points, "customer_state", "left"),
        F.desc("total_orders"), F.asc("customer_state"),
        k=k,
    )


def customer_ltv(orders: DataFrame, payments: DataFrame) -> DataFrame:
    """Lifetime value: ``customer_id, total_spent, order_count``."""
    return (
        orders_with_totals(orders.select("order_id", "customer_id"), payments)
        .where(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(total(F.col("paid")).alias("total_spent"), F.count("*").alias("order_count"))
    )


def ltv_summary(ltv: DataFrame) -> DataFrame:
    """``avg_clv, median_clv, avg_freq, repeat_customers, repeat_rate`` in one row.

    Reads ``ltv`` twice: pass a table that is stored.
    """
    repeats = F.count_if(F.col("order_count") > 1)
    return ltv.agg(
        mean(amount(ltv, "total_spent")).alias("avg_clv"),
        mean(F.col("order_count")).alias("avg_freq"),
        repeats.alias("repeat_customers"),
        (ratio(repeats, F.count("*")) * 100).alias("repeat_rate"),
    ).select(
        "avg_clv",
        quantile(ltv, "total_spent", 0.5).alias("median_clv"),
        "avg_freq",
        "repeat_customers",
        "repeat_rate",
    )


def payment_mix(payments: DataFrame) -> DataFrame:
    """Payment types: ``payment_type, n, pct``, most frequent first."""
    return ranked(
        with_share(counted(payments, "payment_type")), F.desc("n"), F.asc("payment_type")
    )


def payment_trend(orders: DataFrame, payments: DataFrame) -> DataFrame:
    """Payment rows by month and type: ``year_month, payment_type, n``."""
    paid = payments.where(F.col("payment_type").isNotNull()).select("order_id", "payment_type")
    months = orders.select("order_id", year_month(timestamp(PURCHASED)).alias("year_month"))
    return (
        paid.join(months.where(F.col("year_month").isNotNull()), "order_id")
        .groupBy("year_month", "payment_type")
        .agg(F.count("*").alias("n"))
    )


def top_state(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """State with most orders, the first by name among equals: ``customer_state, n``."""
    states = (
        _orders_per_customer(orders, customers, ["customer_state"])
        .groupBy("customer_state")
        .agg(F.sum("n").alias("n"))
    )
    return ranked(states, F.desc("n"), F.asc("customer_state"), k=1)


def _orders_per_customer(orders: DataFrame, customers: DataFrame, place: list[str]) -> DataFrame:
    """Order count of each customer with a known place. Grain customer."""
    located = customers.select("customer_id", *place)
    for c in place:
        located = located.where(F.col(c).isNotNull())
    return (
        orders.groupBy("customer_id")
        .agg(F.count("order_id").alias("n"))
        .join(located, "customer_id")
    )


def _map_points(geolocation: DataFrame, place: list[str]) -> DataFrame:
    """One point per place: the smallest complete coordinate pair."""
    lat, lng = F.col("geolocation_lat"), F.col("geolocation_lng")
    return (
        geolocation.where(lat.isNotNull() & lng.isNotNull())
        .groupBy(*place)
        .agg(F.min(F.struct(lat, lng)).alias("p"))
        .select(*place, "p.geolocation_lat", "p.geolocation_lng")
    )


def _inner_edges(steps: DataFrame) -> DataFrame:
    """The four inner edges out of minimum, inner edges and maximum, which must all differ."""
    return steps.selectExpr(
        """CASE WHEN size(array_distinct(q)) = 6 OR get(q, 0) IS NULL THEN slice(q, 2, 4)
           ELSE raise_error('quintile edges must be unique') END"""
    )


def _passed(edges: str, value: Column) -> Column:
    """How many edges lie below the value."""
    return F.size(F.filter(edges, lambda edge: edge < value))
