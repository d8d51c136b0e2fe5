"""Distributed order statistics against numpy and pandas on whole small samples."""

import re

import numpy as np
import pandas as pd
import pytest

from marketlens.functions import ranks
from marketlens.functions.ranks import day_quantiles, keys_at_ranks, quantiles
from marketlens.operators.customers import rfm_scores

PROBS = (0.0, 0.05, 0.2, 0.25, 0.5, 0.75, 0.8, 0.95, 1.0)


@pytest.mark.parametrize("n", [1, 2, 5, 7, 100, 5001])
@pytest.mark.parametrize("shape", ["even", "hot", "lognormal"])
def test_quantiles(spark, n, shape):
    random = np.random.default_rng(n)
    values = {
        "even": random.integers(0, 10 * n, n) / 100,
        "hot": np.where(random.random(n) < 0.4, 7.0, random.integers(0, 1000, n) / 10),
        "lognormal": np.round(random.lognormal(3, 2, n), 2),
    }[shape]
    df = spark.createDataFrame(pd.DataFrame({"x": values})).repartition(5)
    got = quantiles(df, "x", PROBS).first().q
    assert got == list(np.quantile(values, PROBS))


def test_quantiles_of_weights_and_nulls(spark):
    df = spark.createDataFrame([(1, 3), (2, 1), (None, 50), (10, 1)], "x int, n int")
    assert quantiles(df, "x", (0.5, 1.0), weight="n").first().q == [1.0, 10.0]
    assert quantiles(df.limit(0), "x", (0.5,)).first().q == [None]
    assert day_quantiles(df, "x", (0.5, 0.75), weight="n").first().q == [1.0, 2.0]


def test_keys_at_ranks_of_pairs(spark):
    df = spark.range(1000).selectExpr("CAST(id % 3 AS int) AS a", "concat('u', id) AS b")
    ordered = sorted((r.a, r.b) for r in df.collect())
    hits = keys_at_ranks(df.repartition(7), ["a", "b"], "array(1L, 500L, total)").collect()
    assert {(r.pos, r.total): (r.key.a, r.key.b) for r in hits} == {
        (0, 1000): ordered[0], (1, 1000): ordered[499], (2, 1000): ordered[-1],
    }


@pytest.mark.parametrize("n", [5, 7, 23, 1500, 1501])
def test_scores_equal_pandas(spark, n):
    random = np.random.default_rng(n)
    rfm = pd.DataFrame(
        {
            "customer_id": [f"{v:08x}" for v in random.permutation(10 * n)[:n]],
            "recency": random.permutation(n),
            # One frequency holds most customers.
            "frequency": np.where(random.random(n) < 0.8, 1, random.integers(1, 9, n)),
            "monetary": random.permutation(n) * 1.37,
        }
    ).sort_values("customer_id")

    def fifth(values):
        """1 to 5 by the quintile edges, an edge belongs to the fifth below it."""
        edges = np.quantile(values, [0.2, 0.4, 0.6, 0.8])
        return 1 + np.searchsorted(edges, values, side="left")

    order = np.lexsort((rfm.customer_id, rfm.frequency))
    place = np.empty(n)
    place[order] = np.arange(1, n + 1)
    expected = {"R_score": 6 - fifth(rfm.recency), "F_score": fifth(place), "M_score": fifth(rfm.monetary)}
    got = rfm_scores(spark.createDataFrame(rfm).repartition(6)).toPandas().sort_values("customer_id")
    for score in ("R_score", "F_score", "M_score"):
        assert list(got[score]) == list(expected[score]), score
    assert list(got.RFM_Score) == [
        f"{r}{f}{m}" for r, f, m in zip(got.R_score, got.F_score, got.M_score)
    ]


def test_seven_values_score_like_quintiles(spark):
    rfm = spark.createDataFrame(
        [(str(i), 8 - i, i, float(i)) for i in range(1, 8)],
        "customer_id string, recency int, frequency int, monetary double",
    )
    scored = rfm_scores(rfm).orderBy("customer_id").collect()
    assert [r.M_score for r in scored] == [1, 1, 2, 3, 4, 5, 5]
    assert [r.F_score for r in scored] == [1, 1, 2, 3, 4, 5, 5]
    assert [r.R_score for r in scored] == [1, 1, 2, 3, 4, 5, 5]


def test_second_read_touches_wanted_partitions_only(spark):
    df = spark.range(100_000).selectExpr("id AS value", "CAST(1 AS bigint) AS n")
    found = keys_at_ranks(df, ["value"], "array(10)", weight="n")
    assert found.first().key.value == 9
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = re.findall(r"PartitionFilters: \[(.*?)\], ", plan)
    assert filters and all(re.search(r"part#\d+L? (= 0|IN \(0\))", f) for f in filters)


@pytest.mark.parametrize("most_rows", [10, 100, 10_000])
def test_narrow_ranges_give_the_same_keys(spark, monkeypatch, most_rows):
    random = np.random.default_rng(4)
    # Nearly all keys lie close together, and one has a third of the weight.
    values = np.unique(np.concatenate([random.integers(0, 10**9, 50), 5 * 10**8 + random.integers(0, 9000, 6000)]))
    weights = random.integers(1, 4, len(values))
    weights[len(values) // 3] = weights.sum() // 2
    df = spark.createDataFrame(pd.DataFrame({"value": values, "n": weights})).repartition(5)
    rounds, sizes = [], []
    narrowed = ranks._narrowed

    def counted(*args):
        found = narrowed(*args)
        rounds.append(len(found[1]))
        sizes.append(max(r.n for r in found[1]))
        return found

    monkeypatch.setattr(ranks, "_narrowed", counted)
    wanted = "transform(sequence(0, 40), k -> CAST(1 + k * (total - 1) DIV 40 AS bigint))"
    hits = keys_at_ranks(df, ["value"], wanted, weight="n", most_rows=most_rows).collect()
    expanded = np.repeat(values, weights)
    assert sorted((r.pos, r.key.value) for r in hits) == [(k, expanded[k * (len(expanded) - 1) // 40]) for k in range(41)]
    assert {r.total for r in hits} == {len(expanded)}
    if most_rows < 10_000:
        # All rows are in few ranges at first; no wanted range holds more than the bound at last.
        assert rounds and sizes[-1] <= most_rows and max(rounds) <= 41
    else:
        assert not rounds


def test_equal_keys_end_the_narrowing(spark):
    df = spark.range(500).selectExpr("1 AS value")
    hits = keys_at_ranks(df, ["value"], "array(1L, 250L, total)", most_rows=10).collect()
    assert sorted((r.pos, r.key.value, r.total) for r in hits) == [(k, 1, 500) for k in range(3)]


def test_narrowing_keeps_quantiles(spark, monkeypatch):
    monkeypatch.setattr(keys_at_ranks, "__defaults__", (None, 20))
    values = np.round(np.random.default_rng(8).lognormal(3, 2, 4001), 2)
    df = spark.createDataFrame(pd.DataFrame({"x": values})).repartition(5)
    assert quantiles(df, "x", PROBS).first().q == list(np.quantile(values, PROBS))
    assert quantiles(df.limit(0), "x", (0.5,)).first().q == [None]
