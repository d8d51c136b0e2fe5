"""Clustering of vectors around centroids, in whole numbers, with a progressive Walsh-Hadamard search.

Vectors become whole numbers, ``floor(scale * x)``, and are transformed by the Walsh-Hadamard matrix, which
only adds and subtracts: sums of squared differences of the coefficients are exactly ``size`` times those
of the components. The first ``k`` vectors in the order of ``sha256(seed:id)`` are the centroids to begin with. In every
round each vector goes to its nearest centroid (ties: the smaller number), and each centroid that has vectors
moves to the floor of their mean, component by component.

The search adds up squared differences level by level, from few sign changes (coarse) to many (fine). After the first
level the centroid that leads is measured in full. Its distance is the bar: whatever has passed it in part is strictly
worse and is left, the others go on, and what is left at the end has all coefficients in its sum. Nothing is estimated.

Vectors are transformed once and stored in 4 bytes a coefficient. Each round is one pass over them: a task adds
its vectors up by centroid first, so ``k`` rows a task are shuffled and ``k`` rows come to the driver, whatever
the number of vectors. A hot cluster or very many copies of a vector change nothing in that.

Defined results: vectors of another length, with null or non-finite components, and null vectors are left out; so is
nothing else. A null identifier hashes like none and comes last among the first centroids; equal hashes (repeated identifiers)
are ordered by the vectors. With fewer vectors than ``k`` there are fewer centroids; an empty table gives an
empty result. Components of ``LARGEST`` or more after scaling are an error, as distances would not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from marketlens.llm.common import stored

SIZE = 64
CENTROIDS = 8
ROUNDS = 10
SEED = 3
SCALE = 1024
LARGEST = 1 << 24
#: Coefficients that have been added up after each level.
LEVELS = (8, 16, 32, 64)
BATCH = 4096


def by_sign_changes(size: int) -> np.ndarray:
    """Rows of the Hadamard matrix in the order of their sign changes: coarse ones first."""
    matrix = transformed(np.eye(size, dtype=np.int64))
    return np.argsort(np.count_nonzero(np.diff(matrix, axis=0), axis=0), kind="stable")


def transformed(vectors: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, in whole numbers; twice gives ``size`` times the row."""
    size = vectors.shape[1]
    found, half = vectors.copy(), 1
    while half < size:
        pairs = found.reshape(len(found), size // (2 * half), 2, half)
        found = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2).reshape(len(found), size)
        half *= 2
    return found


def nearest(coefficients: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By row the number of its nearest centroid and ``size`` times the squared distance, from transforms of both
    in the order of sign changes."""
    size = coefficients.shape[1]
    levels = [level for level in LEVELS if level < size] + [size]
    rows = np.arange(len(coefficients))

    def part(which: np.ndarray, k, low: int, high: int) -> np.ndarray:
        apart = coefficients[which, low:high] - centroids[k, low:high]
        return np.einsum("ij,ij->i", apart, apart)

    sums = np.stack([part(rows, k, 0, levels[0]) for k in range(len(centroids))], axis=1)
    lead = np.argmin(sums, axis=1)
    bar = sums[rows, lead] + part(rows, lead, levels[0], size)
    for low, high in zip(levels, levels[1:]):
        for k in range(len(centroids)):
            open_ = np.flatnonzero(sums[:, k] <= bar)  # strictly worse ones stay as they are, above the bar
            sums[open_, k] += part(open_, k, low, high)
    return np.argmin(sums, axis=1), sums.min(axis=1)


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, size: int, scale: int) -> DataFrame:
    """``id, w``: the transforms of the vectors that count, as 4-byte whole numbers."""
    source = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    source = source.filter((F.size("x") == size) & ~F.exists("x", lambda v: v.isNull()))
    kind = source.schema["id"].dataType
    id_type = to_arrow_type(kind)
    order = by_sign_changes(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            finite = np.isfinite(x).all(axis=1)
            x = np.floor(x[finite] * float(scale))  # a power of two: exact
            if x.size and np.abs(x).max() >= LARGEST:
                raise ValueError(f"vector components of {LARGEST} / {scale} or more")
            w = transformed(x.astype(np.int64))[:, order].astype(np.int32)
            yield pa.record_batch(
                [batch.column("id").filter(pa.array(finite)).cast(id_type), pa.array([r.tobytes() for r in w], pa.binary())], ["id", "w"]
            )

    return source.mapInArrow(run, f"id {kind.simpleString()}, w binary")


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.int32).reshape(-1, size).astype(np.int64)


def _searched(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[tuple]:
    for batch in batches:
        for low in range(0, batch.num_rows, BATCH):
            some = batch.slice(low, BATCH)
            w = _matrix(some.column("w"), centroids.shape[1])
            cluster, distance = nearest(w, centroids)
            yield some, w, cluster, distance // centroids.shape[1]


def _sums(whole: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``cluster, place, total, n``: sums of the transforms by centroid and coefficient."""
    k, size = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, size), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for _, w, cluster, _ in _searched(batches, centroids):
            np.add.at(total, cluster, w)
            n += np.bincount(cluster, minlength=k)
        columns = [np.repeat(np.arange(k), size), np.tile(np.arange(size), k), total.ravel(), np.repeat(n, size)]
        yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["cluster", "place", "total", "n"])

    found = whole.select("w").mapInArrow(run, "cluster bigint, place bigint, total bigint, n bigint")
    return found.groupBy("cluster", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def _moved(whole: DataFrame, centroids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The centroids after a round."""
    k, size = centroids.shape
    total, n = np.zeros((k, size), dtype=object), [0] * k
    for r in _sums(whole, centroids).collect():  # k x size rows
        total[r["cluster"], order[r["place"]]] = int(r["total"])
        n[r["cluster"]] = int(r["n"])
    moved = centroids.copy()
    for c in range(k):
        if n[c]:
            sums = transformed(total[c : c + 1])[0] // size  # exact: the transform of a transform
            mean = np.array([s // n[c] for s in sums], dtype=np.int64)
            moved[c] = transformed(mean[None])[0][order]
    return moved


def centroid_clusters(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    size: int = SIZE,
    k: int = CENTROIDS,
    rounds: int = ROUNDS,
    seed: int = SEED,
    scale: int = SCALE,
) -> tuple[DataFrame, list[list[int]]]:
    """``<id_col>, cluster, distance`` (squared, in scaled units) of every vector, and the final centroids.

    ``size`` and ``scale`` are powers of two.
    """
    order = by_sign_changes(size)
    whole = stored(whole_vectors(vectors, id_col, vector_col, size, scale), "whole-vectors")
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    first = whole.select(rank.alias("rank"), "w").orderBy(F.asc_nulls_last("rank"), "w").limit(k).collect()
    centroids = _matrix(pa.array([r["w"] for r in first], pa.binary()), size)
    if len(centroids):
        for _ in range(rounds):
            centroids = _moved(whole, centroids, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, _, cluster, distance in _searched(batches, centroids):
            yield pa.record_batch(
                [some.column("id"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], [id_col, "cluster", "distance"]
            )

    kind = whole.schema["id"].dataType.simpleString()
    found = whole.mapInArrow(run, f"`{id_col}` {kind}, cluster int, distance bigint")
    plain = np.empty_like(centroids)
    plain[:, order] = centroids
    return found, (transformed(plain) // size).tolist()


def with_inertia(found: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Adds ``cluster_inertia, inertia, centroid_sha256``; ``found`` is read twice.

    One row for each centroid is joined: no vector leaves its task.
    """
    found = stored(found, "clustered")
    spark = found.sparkSession
    names = [(c, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids)]
    digests = spark.createDataFrame(names, "cluster int, centroid_sha256 string")
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    per_cluster = digests.join(sums, "cluster").withColumn("inertia", found.agg(F.sum("distance")).scalar())
    return found.join(F.broadcast(per_cluster), "cluster")  # at most one row for each centroid
