"""The shop tables, derived from the given star-schema tables.

Each view renames and combines whole tables; none leaves out rows by key. Rules on keys
only place nulls, late deliveries and the like, so that edge cases occur.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PERIOD = ("1998-01-01", "1998-12-31")

#: The given prices have two decimals.
CENTS = "decimal(18,2)"


class Shop:
    """Lazy shop tables over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def orders(self) -> DataFrame:
        key, status = F.col("o_orderkey"), F.col("o_orderstatus")
        date = F.col("o_orderdate")
        return self.table("orders").select(
            key.alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            F.when(status == "F", "delivered")
            .when(status == "O", "shipped")
            .otherwise("canceled")
            .alias("order_status"),
            date.alias("order_purchase_timestamp"),
            F.when(key % 50 != 0, _plus(date, F.lit(0), key % 31)).alias("order_approved_at"),
            F.when((status == "F") & (key % 41 != 0), _plus(date, key % 120, key % 24)).alias(
                "order_delivered_customer_date"
            ),
        )

    @cached_property
    def items(self) -> DataFrame:
        exact = "decimal(10,2)"
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("order_item_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("seller_id"),
            F.col("l_extendedprice").cast(CENTS).alias("price"),
            (F.col("l_quantity").cast(exact) * F.col("l_tax").cast(exact))
            .cast(CENTS)
            .alias("freight_value"),
        )

    @cached_property
    def payments(self) -> DataFrame:
        """One to three payments per order with items: one per return flag."""
        return (
            self.table("lineitem")
            .groupBy(
                F.col("l_orderkey").alias("order_id"),
                F.col("l_returnflag").alias("payment_type"),
            )
            .agg(
                F.sum(F.col("l_extendedprice").cast(CENTS)).alias("payment_value"),
                F.count("*").alias("payment_installments"),
            )
        )

    @cached_property
    def customers(self) -> DataFrame:
        key = F.col("c_custkey")
        return self._with_nation().select(
            key.alias("customer_id"),
            F.when(key % 97 != 0, F.col("c_mktsegment")).alias("customer_city"),
            F.col("n_name").alias("customer_state"),
        )

    @cached_property
    def geolocation(self) -> DataFrame:
        """A point per customer; the last five nations have no coordinates."""
        key, known = F.col("c_custkey"), F.col("n_nationkey") < 20
        return self._with_nation().select(
            F.col("c_mktsegment").alias("geolocation_city"),
            F.col("n_name").alias("geolocation_state"),
            F.when(known, (key % 180).cast("double") - 90).alias("geolocation_lat"),
            F.when(known, ((key * 7) % 360).cast("double") - 180).alias("geolocation_lng"),
        )

    @cached_property
    def products(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.table("part").select(
            key.alias("product_id"),
            F.when(key % 25 != 0, F.col("p_type")).alias("product_category_name"),
            F.length("p_name").cast("bigint").alias("product_name_lenght"),
            F.col("p_size").alias("product_photos_qty"),
            F.col("p_retailprice").alias("product_weight_g"),
        )

    @cached_property
    def translation(self) -> DataFrame:
        """English category names; one category has none."""
        kind = F.col("p_type")
        return (
            self.table("part")
            .where(kind != "PROMO")
            .select(
                kind.alias("product_category_name"),
                F.lower(kind).alias("product_category_name_english"),
            )
            .distinct()
        )

    @cached_property
    def reviews(self) -> DataFrame:
        """Reviews of orders, with every document as the message of the order of its number.

        Delivered urgent orders have one review more than others, canceled orders one less
        unless they have a message.
        """
        status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
        score = F.substring(priority, 1, 1).cast("int")
        silent = (status == "P") & F.col("doc_id").isNull()
        second = (status == "F") & (priority == "1-URGENT")
        copies = F.when(silent, 0).otherwise(1) + F.when(second, 1).otherwise(0)
        documents = self.table("documents").select("doc_id", "text", "source")
        key, k = F.col("o_orderkey"), F.col("k")
        return (
            self.table("orders")
            .join(documents, key == F.col("doc_id"), "left")
            .select("*", F.posexplode(F.array_repeat(F.lit(0), copies)).alias("k", "_"))
            .select(
                (key * 2 + k).alias("review_id"),
                key.alias("order_id"),
                F.when(k == 0, score).otherwise(6 - score).alias("review_score"),
                F.when(key % 4 != 0, F.col("source")).alias("review_comment_title"),
                F.col("text").alias("review_comment_message"),
                _plus(F.col("o_orderdate"), F.lit(14) + k, F.lit(0)).alias(
                    "review_creation_date"
                ),
            )
        )

    @cached_property
    def catalog(self) -> dict[str, DataFrame]:
        """All eleven tables by name."""
        return {
            "orders": self.orders,
            "order_items": self.items,
            "order_payments": self.payments,
            "order_reviews": self.reviews,
            "products": self.products,
            "product_cat": self.translation,
            "customers": self.customers,
            "sellers": self.table("supplier"),
            "geolocation": self.geolocation,
            "leads_qualified": self.table("events"),
            "leads_closed": self.table("labels"),
        }

    def _with_nation(self) -> DataFrame:
        return self.table("customer").join(
            self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")
        )


def _plus(ts: Column, days: Column, hours: Column) -> Column:
    return ts + F.make_dt_interval(days.cast("int"), hours.cast("int"))
