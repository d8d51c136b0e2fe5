"""Pages against slices of the full sort, and merged sketches against exact counts."""

import re

import pytest
from pyspark.sql import functions as F

from marketlens.functions import distinct
from marketlens.functions.pages import ordered_rows


@pytest.fixture(autouse=True)
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture
def table(spark):
    """Ties, nulls, and a value that a third of the rows share."""
    score = F.when(F.col("id") % 3 == 0, 5).when(F.col("id") % 7 != 0, F.col("id") % 5).cast("int")
    return spark.range(0, 5000, 1, 6).select(score.alias("score"), ((F.col("id") * 7919) % 5003).alias("id"))


def test_pages_are_slices_of_the_sort(table):
    order = (F.desc_nulls_last("score"), F.asc("id"))
    full = [tuple(r) for r in table.orderBy(*order).collect()]
    rows = ordered_rows(table, *order)
    assert rows.total == 5000 and len(rows.parts) > 1
    for first, size in [(0, 10), (1660, 40), (4990, 50), (0, 5000), (2500, 0), (5000, 10), (7000, 1), (4999, 1)]:
        page = rows.page(first, size).collect()
        assert [(r.score, r.id) for r in page] == full[first : first + size]
        assert [r.position for r in page] == list(range(first, min(first + size, 5000)))[: len(page)]
    with pytest.raises(ValueError, match="no page"):
        rows.page(-1, 5)


def test_a_page_reads_its_ranges_only(table):
    rows = ordered_rows(table, F.asc("score"), F.asc("id"))
    page = rows.page(100, 10)
    page.collect()
    plan = page._jdf.queryExecution().executedPlan().toString()
    filters = re.search(r"PartitionFilters: \[([^\]]*)\]", plan)[1]
    assert re.search(r"part#\d+ (=|IN)", filters) and len(rows.parts) > 1


def test_no_rows(table):
    empty = ordered_rows(table.limit(0), F.asc("id"))
    assert (empty.total, empty.page(0, 10).collect()) == (0, [])


def test_sketches_merge_within_their_error(spark):
    visits = spark.range(0, 200_000, 1, 8).select((F.col("id") % 12).alias("month"), F.when(F.col("id") % 50 != 0, (F.col("id") * 31) % 30_011).alias("customer"))
    visits = visits.unionByName(spark.sql("SELECT CAST(NULL AS bigint) AS month, 1L AS customer UNION ALL SELECT 99L, NULL"))
    sketches = distinct.distinct_sketches(visits, "month", "customer").cache()
    assert sketches.count() == 12
    exact = {r.month: r.n for r in visits.groupBy("month").agg(F.count_distinct("customer").alias("n")).collect()}
    for r in distinct.counts(sketches).collect():
        assert abs(r.n_distinct - exact[r.month]) <= 4 * distinct.standard_error() * exact[r.month]
    some = visits.where("month BETWEEN 3 AND 8").agg(F.count_distinct("customer")).first()[0]
    merged = distinct.merged_count(sketches.where("month BETWEEN 3 AND 8")).first().n_distinct
    assert abs(merged - some) <= 4 * distinct.standard_error() * some
    assert distinct.merged_count(sketches.where("month = 77")).first().n_distinct == 0
