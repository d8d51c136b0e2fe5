"""Order-preserving packing by dynamic programming.

The token ids of all documents, each followed by an end id, form one row of ids per task, in the
order of the table. It is cut into windows at document or sentence boundaries so that the sum of
padding and cut penalties is smallest:

    cost(j) = min over i, 0 < b(j) - b(i) <= window, of
              cost(i) + padding(b(j) - b(i)) + penalty(j) + sequence_cost

where b are the boundaries. Padding fills a window up, except windows whose length is a power of
two, which stay as they are. The minimum over the ordinary windows slides along with j; a
monotone queue holds its candidates, so the work is linear in the number of boundaries.

Tasks pack the rows they scan: no shuffle, no key that could be hot, and a task that is run again
gives the same sequences. Memory holds one block of documents and the longest document at hand.

Defined results: null and empty texts are a single end id; a sentence longer than the window is
cut every ``window`` ids; repeated rows are packed each; an empty table gives no pieces; columns
other than identifier and text are not read; a null identifier stays null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import text_of
from marketlens.llm.tokens import encoder as encoder_of

WINDOW = 1024
END_ID = 0
SENTENCE_PENALTY = 1
INNER_PENALTY = 64
SEQUENCE_COST = 64
BLOCK = 1 << 17
BATCH_TEXTS = 256


def choose_cuts(
    bounds: np.ndarray, penalty: np.ndarray, window: int, sequence_cost: int = SEQUENCE_COST
) -> list[int]:
    """Indices into ``bounds`` of the cheapest cuts, first and last boundary included.

    ``bounds`` rise from 0 in steps of at most ``window``; ``penalty[j]`` is due if j is a cut.
    """
    n = len(bounds)
    # Windows of a power of two in length: pairs (i, j) of boundaries that far apart.
    exact: dict[int, list[int]] = {}
    size = 1
    while size <= window:
        i = np.searchsorted(bounds, bounds - size)
        for j in np.flatnonzero((bounds >= size) & (bounds[np.minimum(i, n - 1)] == bounds - size)).tolist():
            exact.setdefault(j, []).append(int(i[j]))
        size *= 2
    at, due = bounds.tolist(), (penalty + sequence_cost).tolist()
    cost, came = [0] * n, [0] * n
    queue, values, head = [0], [0], 0  # values: cost(i) + b(i), rising
    for j in range(1, n):
        b = at[j]
        low = b - window
        while at[queue[head]] < low:
            head += 1
        i = queue[head]
        best = values[head] + window - b
        for k in exact.get(j, ()):
            if cost[k] < best:
                best, i = cost[k], k
        best += due[j]
        cost[j], came[j] = best, i
        value = best + b
        while len(queue) > head and values[-1] >= value:
            queue.pop()
            values.pop()
        queue.append(j)
        values.append(value)
    cuts, j = [n - 1], n - 1
    while j:
        j = came[j]
        cuts.append(j)
    return cuts[::-1]


def boundaries(
    ids: np.ndarray, ends: np.ndarray, is_end: np.ndarray, window: int, sentence: int, inner: int
) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions and penalties: document ends (free), sentence ends, and places inside
    sentences that are longer than the window. ``ends`` are the positions of document ends."""
    sentences = np.flatnonzero(is_end[ids]) + 1
    bounds = np.union1d(np.union1d(sentences, ends), [0])
    kind = np.where(np.isin(bounds, ends) | (bounds == 0), 0, sentence)
    gaps = np.diff(bounds)
    long = np.flatnonzero(gaps > window)
    if len(long):
        more = np.concatenate([np.arange(bounds[g] + window, bounds[g + 1], window) for g in long])
        order = np.argsort(np.concatenate([bounds, more]), kind="stable")
        kind = np.concatenate([kind, np.full(len(more), inner)])[order]
        bounds = np.concatenate([bounds, more])[order]
    return bounds, kind


class _Packer:
    """Cuts the rows of one task into sequences."""

    def __init__(self, first: int, window: int, sentence: int, inner: int, cost: int, is_end):
        self.next, self.window, self.is_end = first, window, is_end
        self.penalties, self.cost = (sentence, inner), cost
        self.parts: list[tuple] = []  # (identifier, ids, first position, ids of the document)
        self.held = 0

    def add(self, key, ids: np.ndarray) -> None:
        self.parts.append((key, ids, 0, len(ids)))
        self.held += len(ids)

    def cut(self, last: bool) -> Iterator[tuple]:
        """Pieces of the sequences found; what the last one holds waits for more, until the end."""
        if not self.parts:
            return
        ids = np.concatenate([p[1] for p in self.parts])
        ends = np.cumsum([len(p[1]) for p in self.parts])
        bounds, penalty = boundaries(ids, ends, self.is_end, self.window, *self.penalties)
        cuts = bounds[choose_cuts(bounds, penalty, self.window, self.cost)]
        if not last:
            cuts = cuts[:-1]
        part, starts = 0, ends - [len(p[1]) for p in self.parts]
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            offset = 0
            while part < len(self.parts) and starts[part] < high:
                key, own, first, total = self.parts[part]
                a, b = max(low - starts[part], 0), min(high - starts[part], len(own))
                yield key, first + a, b - a, own[a:b].tobytes(), total, self.next, offset, high - low
                offset += b - a
                if starts[part] + len(own) > high:
                    break
                part += 1
            self.next += 1
        done = int(cuts[-1])
        rest = []
        for (key, own, first, total), start in zip(self.parts[part:], starts[part:].tolist()):
            skip = max(done - start, 0)
            if skip < len(own):
                rest.append((key, own[skip:], first + skip, total))
        self.parts, self.held = rest, sum(len(p[1]) for p in rest)


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    end_id: int = END_ID,
    sentence_penalty: int = SENTENCE_PENALTY,
    inner_penalty: int = INNER_PENALTY,
    sequence_cost: int = SEQUENCE_COST,
    block: int = BLOCK,
) -> DataFrame:
    """Pieces of documents and their places in sequences of at most ``window`` ids.

    Returns ``<id_col>, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset, sequence_length``. ``tokenizer`` is the path of a tokenizer file on the
    executors; ``block`` is the number of ids that are cut together.
    """
    source = docs.select(F.col(id_col).alias("key"), text_of(text_col).alias("text"))
    kind = source.schema["key"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        packer = _Packer(
            TaskContext.get().partitionId() << 40, window, sentence_penalty, inner_penalty,
            sequence_cost, encoder.sentence_ends,
        )
        end = np.array([end_id], dtype="<u4")
        schema = None
        for batch in batches:
            schema = pa.schema([
                ("key", batch.schema.field("key").type), ("start", pa.int64()), ("length", pa.int64()),
                ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()),
                ("offset", pa.int64()), ("sequence_length", pa.int64()),
            ])
            for low in range(0, batch.num_rows, BATCH_TEXTS):
                some = batch.slice(low, BATCH_TEXTS)
                keys = some.column("key").to_pylist()
                for key, ids in zip(keys, encoder.encode(some.column("text").to_pylist())):
                    packer.add(key, np.concatenate([np.frombuffer(ids, dtype="<u4"), end]))
                    if packer.held >= block:
                        yield from _batches(packer.cut(last=False), schema)
        if schema is not None:
            yield from _batches(packer.cut(last=True), schema)

    from pyspark.sql import types as T

    schema = T.StructType([
        T.StructField("key", kind), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
        T.StructField("sequence_length", T.LongType()),
    ])
    return source.mapInArrow(run, schema).withColumnRenamed("key", id_col)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    columns = list(zip(*rows))
    if columns:
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema
        )
