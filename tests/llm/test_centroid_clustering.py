"""Centroid clustering against plain distances in Python numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from marketlens.llm import centroid_clustering as cc


def brute(rows, size=64, k=8, rounds=10, scale=1024):
    kept = []
    for i, x in rows:
        if x is not None and len(x) == size and all(v is not None and math.isfinite(v) for v in x):
            kept.append((i, [math.floor(scale * float(np.float32(v))) for v in x]))
    by_hash = sorted(kept, key=lambda r: hashlib.sha256(f"3:{r[0]}".encode()).hexdigest())
    centroids = [list(v) for _, v in by_hash[:k]]

    def assigned():
        found = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
            found.append((d.index(min(d)), min(d)))
        return found

    for _ in range(rounds):
        found = assigned()
        for c in range(len(centroids)):
            own = [v for (_, v), (n, _) in zip(kept, found) if n == c]
            if own:
                centroids[c] = [sum(col) // len(own) for col in zip(*own)]
    return sorted((i, c, d) for (i, _), (c, d) in zip(kept, assigned())), centroids


def vectors(seed, n, size=64, centres=5):
    rng = random.Random(seed)
    middle = [[rng.uniform(-0.5, 0.5) for _ in range(size)] for _ in range(centres)]
    return [(i, [v + rng.gauss(0, 0.2) for v in rng.choice(middle)]) for i in range(n)]


SCHEMA = "vec_id bigint, embedding array<float>"


@pytest.mark.parametrize("seed", [1, 2])
def test_like_brute_force(frame, seed):
    rows = vectors(seed, 300)
    found, centroids = cc.centroid_clusters(frame(rows, SCHEMA))
    expected, middle = brute(rows)
    assert sorted(tuple(r) for r in found.collect()) == expected
    assert centroids == middle


def test_ties_and_empty_centroids(frame):
    rows = [(i, [float(i % 2)] * 64) for i in range(40)]  # two places, eight centroids
    found, centroids = cc.centroid_clusters(frame(rows, SCHEMA))
    assert sorted(tuple(r) for r in found.collect()) == brute(rows)[0]
    assert {r["distance"] for r in found.collect()} == {0} and len(centroids) == 8


def test_odd_rows(frame):
    good = vectors(3, 12)
    nan, inf = [0.0] * 63 + [math.nan], [math.inf] + [0.0] * 63
    odd = [(100, None), (101, []), (102, [0.0] * 63), (103, [0.0] * 65), (104, [None] + [0.0] * 63), (105, nan), (106, inf)]
    df = frame([(*r, "x") for r in good + odd], SCHEMA + ", cluster string")
    found = cc.with_inertia(*cc.centroid_clusters(df)).collect()
    expected, _ = brute(good)
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in found) == expected
    assert {r["inertia"] for r in found} == {sum(d for *_, d in expected)}
    for r in found:
        assert r["cluster_inertia"] == sum(d for _, c, d in expected if c == r["cluster"])


def test_null_and_repeated_ids_few_vectors_and_none(frame):
    rows = vectors(4, 3)
    rows = rows + [(None, rows[0][1]), (1, rows[2][1]), (1, rows[2][1])]
    found, centroids = cc.centroid_clusters(frame(rows, SCHEMA))
    assert sorted(str(r["vec_id"]) for r in found.collect()) == sorted(str(i) for i, _ in rows) and len(centroids) == 6
    empty = cc.with_inertia(*cc.centroid_clusters(frame([], SCHEMA)))
    assert empty.collect() == []
    with pytest.raises(Exception, match="or more"):
        cc.centroid_clusters(frame([(1, [1e9] * 64)], SCHEMA))


def test_search_is_exact_and_transform_too():
    rng = np.random.default_rng(5)
    v, c = rng.integers(-5000, 5000, (500, 64)), rng.integers(-5000, 5000, (8, 64))
    c[5] = c[2]  # equal centroids: the smaller number
    order = cc.by_sign_changes(64)
    assert sorted(order) == list(range(64)) and order[0] == 0
    assert (cc.transformed(cc.transformed(v)) == 64 * v).all()
    number, distance = cc.nearest(cc.transformed(v)[:, order], cc.transformed(c)[:, order])
    plain = ((v[:, None] - c[None]) ** 2).sum(axis=2)
    assert (number == plain.argmin(axis=1)).all() and (distance == 64 * plain.min(axis=1)).all()
