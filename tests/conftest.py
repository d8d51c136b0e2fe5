import os

import pytest
from pyspark.sql import SparkSession

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return DATA


@pytest.fixture
def frame(spark):
    """Small frames from rows and a DDL schema; times are given as text."""

    def make(rows, schema):
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture
def orders(spark):
    """Orders from (order, customer, purchase time[, status, approved, delivered])."""

    def make(*rows):
        full = [tuple(r) + (None,) * (6 - len(r)) for r in rows]
        raw = spark.createDataFrame(
            full,
            "order_id string, customer_id string, order_purchase_timestamp string,"
            " order_status string, order_approved_at string,"
            " order_delivered_customer_date string",
        )
        times = [c for c in raw.columns if c.endswith(("timestamp", "_at", "_date"))]
        return raw.selectExpr(
            *(c for c in raw.columns if c not in times),
            *(f"CAST({c} AS timestamp_ntz) AS {c}" for c in times),
        )

    return make
