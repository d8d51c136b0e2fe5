"""Times two parts of the library against what Spark offers as is, and prints one JSON line.

* ``left_join_many`` (splits a hot key on either side) against a plain left join, on orders and items;
* exact quartiles by range partitions against the built-in exact percentile, on distinct values.

Broadcast joins are off, as with tables beyond the size threshold. Environment: ``BENCH_SF_DIR``, ``BENCH_CPUS``,
``BENCH_ROWS`` (values for the quartiles). Each part runs once to warm up and once for the time.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.functions.ranks import quantiles
from marketlens.functions.tables import left_join_many
from marketlens.plans.shop import Shop
from marketlens.sources import scratch

QUARTILES = (0.25, 0.5, 0.75)


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.autoBroadcastJoinThreshold", "-1")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", os.environ.get("BENCH_SCRATCH", os.path.abspath("spark-warehouse")))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    shop = Shop(spark, os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"))
    rows = int(os.environ.get("BENCH_ROWS", 5_000_000))
    values = spark.range(0, rows, 1, int(cpus)).select((F.xxhash64("id") / 1e9).alias("x"))
    parts = {
        "left_join_many": lambda: left_join_many(shop.orders, shop.items, "order_id"),
        "plain left join": lambda: shop.orders.join(shop.items, "order_id", "left"),
        "quartiles by range partitions": lambda: quantiles(values, "x", QUARTILES),
        "quartiles by percentile": lambda: values.agg(F.percentile("x", F.array(*map(F.lit, QUARTILES)))),
    }
    print(json.dumps({name: _seconds(build) for name, build in parts.items()}))
    scratch.clean(spark)
    spark.stop()


def _seconds(build) -> float:
    for _ in range(2):
        started = time.perf_counter()
        df: DataFrame = build()
        df.write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - started, 2)


if __name__ == "__main__":
    main()
