"""Best-fit-decreasing packing of token ids, written as rows of an id matrix.

Each task takes blocks of the documents it scans. A document longer than a row is split into
full rows and a rest, losing nothing. The pieces of a block are placed by falling length into
the row with the least free space that still holds them; a segment tree over the free spaces
finds it in a logarithm of the row length. Tasks need no shuffle and no key; a task that runs
again writes the same rows. Memory holds one block of ids and the longest document.

A written row holds: ``sequence_id``; ``ids``, one row of the matrix, little-endian unsigned and
padded to ``window`` (two bytes an id if the vocabulary allows, else four); ``used`` ids;
``cu_seqlens``, the cumulative segment lengths from 0 to ``used``; ``position_resets``, where
position numbers start again at 0; and, by segment, the document, its first id there and its
number of ids.

Defined results: null and empty texts are a single end id; repeated rows are written each; an
empty table gives an empty matrix; a null identifier stays null; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm.common import text_of
from marketlens.llm.tokens import encoder as encoder_of

WINDOW = 1024
END_ID = 0
PAD_ID = 0
BLOCK = 1 << 22
BATCH_TEXTS = 256


class CapacityTree:
    """Rows by free space: the least space of at least a given size that some row has."""

    def __init__(self, window: int):
        self.leaves = 1
        while self.leaves <= window:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, space: int, row: int) -> None:
        self.rows[space].append(row)
        self._change(space, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes and returns (row, its space) for the tightest fit; None if no row fits."""
        node = size + self.leaves
        if not self.count[node]:
            # Up to the first ancestor with a right neighbour that has rows, then down its left.
            while node > 1 and not (node % 2 == 0 and self.count[node + 1]):
                node //= 2
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        space = node - self.leaves
        self._change(space, -1)
        return self.rows[space].pop(), space

    def _change(self, space: int, by: int) -> None:
        node = space + self.leaves
        while node:
            self.count[node] += by
            node //= 2


def best_fit_decreasing(lengths: list[int], window: int) -> list[list[int]]:
    """Rows as lists of piece numbers. Lengths are between 1 and ``window``."""
    tree, rows = CapacityTree(window), []
    for piece in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.take(lengths[piece])
        if found is None:
            rows.append([])
            found = len(rows) - 1, window
        row, space = found
        rows[row].append(piece)
        if space > lengths[piece]:
            tree.add(space - lengths[piece], row)
    return rows


def _matrix_rows(held: list[tuple], window: int, pad_id: int, first: int, dtype: str) -> Iterator[tuple]:
    """Rows of one block; ``held`` has (identifier, ids) by document."""
    pieces = [(k, a) for k, (_, ids) in enumerate(held) for a in range(0, len(ids), window)]
    lengths = [min(window, len(held[k][1]) - a) for k, a in pieces]
    for number, row in enumerate(best_fit_decreasing(lengths, window)):
        ids = np.full(window, pad_id, dtype=dtype)
        ends = [0]
        for p in row:
            k, a = pieces[p]
            ids[ends[-1] : ends[-1] + lengths[p]] = held[k][1][a : a + lengths[p]]
            ends.append(ends[-1] + lengths[p])
        yield (
            first + number, ids.tobytes(), ends[-1], ends, ends[:-1],
            [held[pieces[p][0]][0] for p in row], [pieces[p][1] for p in row],
            [len(held[pieces[p][0]][1]) for p in row],
        )


def write_packed(
    docs: DataFrame,
    tokenizer: str,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    end_id: int = END_ID,
    pad_id: int = PAD_ID,
    block: int = BLOCK,
) -> DataFrame:
    """Writes the packed id matrix of all documents to ``path`` and returns it as read back."""
    source = docs.select(F.col(id_col).alias("key"), text_of(text_col).alias("text"))
    kind = source.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        dtype = id_type(encoder.tokenizer.get_vocab_size())
        end = np.array([end_id], dtype="<u4")
        following, held, size, schema = TaskContext.get().partitionId() << 40, [], 0, None
        for batch in batches:
            key = batch.schema.field("key").type
            schema = pa.schema([
                ("sequence_id", pa.int64()), ("ids", pa.binary()), ("used", pa.int32()),
                ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())),
                ("documents", pa.list_(key)), ("starts", pa.list_(pa.int64())),
                ("doc_tokens", pa.list_(pa.int64())),
            ])
            for low in range(0, batch.num_rows, BATCH_TEXTS):
                some = batch.slice(low, BATCH_TEXTS)
                found = encoder.encode(some.column("text").to_pylist())
                for name, ids in zip(some.column("key").to_pylist(), found):
                    held.append((name, np.concatenate([np.frombuffer(ids, dtype="<u4"), end])))
                    size += len(held[-1][1])
                    if size >= block:
                        rows = list(_matrix_rows(held, window, pad_id, following, dtype))
                        following, held, size = following + len(rows), [], 0
                        yield _batch(rows, schema)
        if held:
            yield _batch(list(_matrix_rows(held, window, pad_id, following, dtype)), schema)

    rows = source.mapInArrow(
        run,
        f"sequence_id bigint, ids binary, used int, cu_seqlens array<int>, position_resets array<int>,"
        f" documents array<{kind}>, starts array<bigint>, doc_tokens array<bigint>",
    )
    rows.write.parquet(path)
    return read_packed(docs.sparkSession, path)


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema
    )


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def segments(packed: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per segment of a written matrix, with its ids cut out of the row."""
    width = F.length("ids") / window
    parts = packed.select(
        "sequence_id", "ids", width.cast("int").alias("width"), "cu_seqlens",
        F.posexplode(F.arrays_zip("documents", "starts", "doc_tokens")).alias("segment", "part"),
    )
    offset = F.col("cu_seqlens")[F.col("segment")]
    length = F.col("cu_seqlens")[F.col("segment") + 1] - offset
    return parts.select(
        F.col("part.documents").alias("document"),
        F.col("part.starts").alias("start"),
        length.cast("bigint").alias("length"),
        F.substring("ids", offset * F.col("width") + 1, length * F.col("width")).alias("ids"),
        F.col("part.doc_tokens").alias("doc_tokens"),
        "sequence_id",
        "segment",
        offset.cast("bigint").alias("offset"),
    )
