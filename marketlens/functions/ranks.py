"""Exact order statistics without sorting a table in one task.

``percentile`` and ``median`` keep every distinct value in one aggregation buffer, and a
window without a partition moves the table to one task. Here the rows are range-partitioned
instead: the partition sizes tell which partitions hold the wanted ranks, and only those are
sorted, each in its own task.

Spark samples the rows to choose the ranges and may choose others when it plans again, so
the partitioned rows are stored once (``scratch.materialize``), in a folder per partition, before
they are read twice. Building one of these tables therefore runs jobs. A wanted partition of more than
``MOST_ROWS`` rows is not sorted as it is: its rows are divided into narrower ranges, and the wanted ones of those again
if need be, so that no task sorts more rows whatever the table and ``spark.sql.shuffle.partitions``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from marketlens.sources.scratch import materialize

#: Rows that one task sorts.
MOST_ROWS = 1_000_000

_WANTED = "part bigint, before bigint, total bigint, wanted array<struct<pos: int, rank: bigint>>, n bigint"


def keys_at_ranks(
    df: DataFrame, keys: Sequence[str], ranks: str, weight: str | None = None, most_rows: int = MOST_ROWS
) -> DataFrame:
    """The keys at given 1-based ranks of the order by ``keys``.

    ``ranks`` is a SQL array of ranks in terms of ``total``, the number of rows. A
    ``weight`` counts a row that often; rows should be distinct in ``keys``, so
    pre-aggregate repeated values into one weighted row. Rows with equal keys cannot be divided and are
    sorted together, even if they are more than ``most_rows``. Output: ``pos`` (position in
    ``ranks``), ``key`` (struct), ``total``.
    """
    names = [f"`{k}`" for k in keys]
    times = f"`{weight}`" if weight else "1"
    ranges = materialize(
        df.selectExpr(*names, f"CAST({times} AS bigint) AS w")
        .repartitionByRange(*keys)
        .selectExpr(f"struct({', '.join(names)}) AS key", "w", "CAST(spark_partition_id() AS bigint) AS part"),
        "ranks",
        partition_by="part",
    )

    # One row per range, from the weights alone. At most one per wanted rank is left: few enough for the driver
    # whatever the table.
    wanted = (
        ranges.groupBy("part")
        .agg(F.expr("sum(w) AS size"), F.expr("count(*) AS n"))
        .selectExpr(
            "part", "n",
            "sum(size) OVER (ORDER BY part) AS upto",
            "sum(size) OVER (ORDER BY part) - size AS before",
            "sum(size) OVER () AS total",
        )
        .selectExpr("*", f"transform({ranks}, (r, i) -> struct(i AS pos, CAST(r AS bigint) AS rank)) AS ranks")
        .selectExpr("part", "before", "total", _within("ranks"), "n")
        .where("size(wanted) > 0")
        .collect()
    )
    largest = max((r.n for r in wanted), default=0)
    while largest > most_rows:
        ranges, wanted = _narrowed(ranges, wanted, most_rows)
        before, largest = largest, max(r.n for r in wanted)
        if largest == before:
            break

    return (
        _rows_of(ranges, wanted)
        .selectExpr(
            "key", "w", "total", "wanted",
            "before + sum(w) OVER (PARTITION BY part ORDER BY key"
            " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto",
        )
        .selectExpr("key", "w", "total", "upto", "inline(wanted) AS (pos, rank)")
        .where("rank <= upto AND rank > upto - w")
        .select("pos", "key", "total")
    )


def _within(ranks: str) -> str:
    return f"filter({ranks}, r -> r.rank > before AND r.rank <= upto) AS wanted"


def _rows_of(ranges: DataFrame, wanted: Sequence[Row]) -> DataFrame:
    """The rows of the wanted ranges, with what is known of these; only their folders are read."""
    known = ranges.sparkSession.createDataFrame(wanted, _WANTED)
    return ranges.where(F.col("part").isin([r.part for r in wanted])).join(F.broadcast(known.drop("n")), "part")


def _narrowed(ranges: DataFrame, wanted: Sequence[Row], most_rows: int) -> tuple[DataFrame, list[Row]]:
    """The rows of the wanted ranges in narrower ones, and the wanted ones of those."""
    pieces = 2 * -(-sum(r.n for r in wanted) // most_rows) + 1
    numbered = [Row(**{**r.asDict(), "part": k}) for k, r in enumerate(sorted(wanted, key=lambda r: r.part))]
    number = F.array_position(F.array(*(F.lit(p).cast("bigint") for p in sorted(r.part for r in wanted))), F.col("part")) - 1
    # A new range may take the end of one old range and the start of the next; its number tells them apart.
    narrower = materialize(
        ranges.where(F.col("part").isin([r.part for r in wanted]))
        .select("key", "w", number.alias("old"))
        .repartitionByRange(pieces, "old", "key")
        .selectExpr("key", "w", f"old * {pieces} + spark_partition_id() AS part"),
        "ranks",
        partition_by="part",
    )
    known = ranges.sparkSession.createDataFrame(numbered, _WANTED)
    sizes = narrower.groupBy("part").agg(F.expr("sum(w) AS size"), F.expr("count(*) AS pieces"))
    found = (
        sizes.withColumn("old", F.expr(f"part DIV {pieces}"))
        .join(F.broadcast(known.select(F.col("part").alias("old"), F.col("before").alias("start"), "total", F.col("wanted").alias("ranks"))), "old")
        .selectExpr("*", "start + sum(size) OVER (PARTITION BY old ORDER BY part) AS upto")
        .selectExpr("*", "upto - size AS before")
        .selectExpr("part", "before", "total", _within("ranks"), "pieces AS n")
        .where("size(wanted) > 0")
    )
    return narrower, found.collect()


def quantiles(
    df: DataFrame, col: str, probs: Sequence[float], weight: str | None = None
) -> DataFrame:
    """One row with ``q array<double>``: exact quantiles, linearly interpolated.

    Nulls do not count; without values the entries are null. Equal values meet in one
    weighted row before anything else happens, so a value that fills a third of the table
    costs no more than a rare one.
    """
    p = _sql_array(probs)
    neighbours = (
        f"flatten(transform({p},"
        " p -> array(floor((total - 1) * p) + 1, ceil((total - 1) * p) + 1)))"
    )
    # Measured from the nearer neighbour, which keeps both ends exact.
    return (
        keys_at_ranks(_value_counts(df, col, weight), ["value"], neighbours, weight="n")
        .selectExpr(
            "max(total) AS total", "sort_array(collect_list(struct(pos, key.value AS x))) AS hits"
        )
        .selectExpr(
            f"""transform({p}, (p, i) -> struct(
                CAST(get(hits, 2 * i).x AS double) AS low,
                CAST(get(hits, 2 * i + 1).x AS double) AS high,
                (total - 1) * p - floor((total - 1) * p) AS part)) AS spans"""
        )
        .selectExpr(
            """transform(spans, s -> CASE WHEN s.part < 0.5
                THEN s.low + (s.high - s.low) * s.part
                ELSE s.high - (s.high - s.low) * (1 - s.part) END) AS q"""
        )
    )


def day_quantiles(
    df: DataFrame, col: str, probs: Sequence[float], weight: str | None = None
) -> DataFrame:
    """``quantiles`` of a whole number of days.

    Such a column has no more distinct values than there are days between the first and
    the last date, some thousands, so the built-in aggregate over (value, count) is safe.
    """
    return _value_counts(df, col, weight).selectExpr(
        f"percentile(value, {_sql_array(probs)}, n) AS q"
    )


def quantile(df: DataFrame, col: str, prob: float, weight: str | None = None) -> Column:
    """One quantile as a scalar column."""
    return quantiles(df, col, [prob], weight).select(F.get("q", F.lit(0))).scalar()


def _value_counts(df: DataFrame, col: str, weight: str | None) -> DataFrame:
    n = F.sum(weight) if weight else F.count("*")
    return df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(n.alias("n"))


def _sql_array(numbers: Sequence[float]) -> str:
    return "array(" + ", ".join(f"{float(x)!r}D" for x in numbers) + ")"
