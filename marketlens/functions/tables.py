"""Table helpers: top-k, shares, histograms, growth columns, joins that fan out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.functions.columns import growth_label, growth_pct, ratio


def ranked(df: DataFrame, *order: Column, k: int | None = None) -> DataFrame:
    """Rows in a stated total order; with ``k`` a distributed top-k instead of a full sort."""
    df = df.orderBy(*order)
    return df if k is None else df.limit(k)


def counted(df: DataFrame, key: str) -> DataFrame:
    """Rows per non-null value of ``key``."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))


def with_share(df: DataFrame, n: str = "n", share: str = "pct") -> DataFrame:
    """Percent of the column total, which comes in as a scalar: no row leaves its task."""
    return df.withColumn(share, ratio(F.col(n), df.agg(F.sum(n)).scalar()) * 100)


def with_growth(df: DataFrame, current: str, previous: str, cap: int = 999) -> DataFrame:
    """Adds ``growth_pct`` and ``growth_label`` for a current and a previous measure."""
    pct = growth_pct(F.col(current), F.col(previous))
    return df.withColumn("growth_pct", pct).withColumn(
        "growth_label", growth_label(F.col("growth_pct"), cap)
    )


def histogram(df: DataFrame, col: str, bins: int, weight: str | None = None) -> DataFrame:
    """Equal-width bins over [min, max], the top edge closed, empty bins included.

    Output: ``bin, lo, hi, n``. ``weight`` counts a row that often, so that a table of
    (value, count) gives the histogram of the values. The empty bins come in as zero
    counts ahead of the one aggregation, which needs no join.
    """
    rows = df.where(F.col(col).isNotNull()).select(
        F.col(col).cast("double").alias("x"),
        (F.col(weight) if weight else F.lit(1)).cast("bigint").alias("w"),
    )
    extent = rows.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi")).alias("e"))
    lo, hi = F.col("e.lo"), F.col("e.hi")
    step = F.floor((F.col("x") - lo) * bins / (hi - lo)).cast("bigint")
    binned = rows.withColumn("e", extent.scalar()).select(
        F.when(hi > lo, F.least(F.lit(bins).cast("bigint"), 1 + step))
        .otherwise(F.lit(1).cast("bigint"))
        .alias("bin"),
        "w",
    )
    empty = df.sparkSession.range(1, bins + 1).select(
        F.col("id").alias("bin"), F.lit(0).cast("bigint").alias("w")
    )
    width = (hi - lo) / bins
    return (
        binned.unionByName(empty)
        .groupBy("bin")
        .agg(F.sum("w").alias("n"))
        .withColumn("e", extent.scalar())
        .select(
            "bin",
            (lo + (F.col("bin") - 1) * width).alias("lo"),
            (lo + F.col("bin") * width).alias("hi"),
            "n",
        )
    )


#: Keys that a frequent-items sketch tracks, how many sketches are merged before the last merge, and the share
#: of the rows that the sketches see.
TRACKED = 1 << 14
MERGES = 64
SEEN = 1 / 8


def hot_keys(df: DataFrame, key: str, partitions: int | None = None) -> list:
    """Keys that may hold more rows than half a shuffle partition would get of evenly spread ones.

    From one pass over the key column with mergeable sketches of bounded size, merged in two steps, over a random share of
    the rows: what they find decides how rows are joined, never which. At most ``TRACKED`` / 4 keys come back.
    """
    partitions = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(1 / (2 * partitions), 4 / TRACKED)
    tracked = F.lit(TRACKED)
    sketches = (
        df.select(key)
        .where(F.col(key).isNotNull() & (F.rand(11) < SEEN))
        .groupBy((F.spark_partition_id() % MERGES).alias("merge"))
        .agg(F.count("*").alias("n"), F.call_function("approx_top_k_accumulate", key, tracked).alias("sketch"))
    )
    # Grouped, so that tasks without rows add no empty sketch, which could not be merged.
    found = sketches.groupBy(F.lit("all")).agg(F.sum("n").alias("n"), F.call_function("approx_top_k_combine", "sketch", tracked).alias("sketch"))
    top = F.call_function("approx_top_k_estimate", "sketch", F.lit(TRACKED // 4))
    hot = F.filter(top, lambda t: t["count"] > F.col("n") * share)
    row = found.select(F.transform(hot, lambda t: t["item"]).alias("keys")).first()
    return row["keys"] if row else []


def _may_be_skewed(df: DataFrame) -> bool:
    """Whether all rows together exceed the size from which Spark splits a partition, by Spark's own estimate, which costs no job."""
    session, plan = df.sparkSession._jsparkSession, df._jdf.queryExecution().optimizedPlan()
    least = session.sessionState().conf().getConfString("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes")
    utils = df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils
    return int(plan.stats().sizeInBytes()) > utils.byteStringAsBytes(least)


def left_join_many(left: DataFrame, right: DataFrame, key: str, counted: DataFrame | None = None, partitions: int | None = None) -> DataFrame:
    """Left join on a key that may repeat on the right, however unevenly.

    Spark can split a skewed partition of an outer join on its outer side only, so a hot
    key on the right would stay in one task. Hot keys are looked for first (``hot_keys``, a job over the key column of the right
    side, or of ``counted`` if that has the same keys and is cheaper to read). All other keys take one
    ordinary left join. A hot key has a match, so its rows are an inner join, which splits on both
    sides. Rows without a key go the ordinary way, where they are on the side that can be split.
    """
    keyed = right if counted is None else counted
    hot = hot_keys(keyed, key, partitions) if _may_be_skewed(keyed) else []
    if not hot:
        return left.join(right, key, "left")
    kind = right.schema[key].dataType
    keys = F.broadcast(left.sparkSession.createDataFrame([(k,) for k in hot], T.StructType([T.StructField(key, kind)])))
    rest = left.join(keys, key, "left_anti").join(right.join(keys, key, "left_anti"), key, "left")
    return rest.unionByName(left.join(keys, key, "left_semi").join(right.join(keys, key, "left_semi"), key))
