"""Jaccard join of documents on word shingles, and the groups its links make.

Two documents link if their sets of 5-word shingles have a Jaccard similarity of 0.8 or more. All links
count; none is approximated. The steps:

1. Every text becomes a sorted array of shingle hashes. Documents with equal sets are one node.
2. Two sets that link must share a shingle among the first n - ceil(0.8 n) + 1 of each, in any
   order that is the same for all. Shingles that a bounded sample of documents shows to be
   frequent come last in this order, so that common passages propose few pairs. The sample
   affects the amount of work only.
3. Nodes that share such a shingle are compared with the smallest node of that shingle first: one
   pair per node, not all pairs. Groups of near copies come together here, however large.
4. Where a shingle still joins nodes of different components, its nodes are dealt into tiles: bands of
   similar size, split into blocks of bounded size, each block against each. Within a tile all pairs
   of different components are compared and one link per join of components is kept.
5. Every comparison counts bits of hashed bitmaps first: the bits that only one bitmap has bound
   the overlap from above. Pairs that pass are settled by intersecting the sorted arrays, which are
   made again from the texts for these nodes only.

Nothing grows in one task or on the driver: tiles are bounded, and the driver holds at most
``FREQUENT`` shingles. The shuffles carry prefixes (a fifth of the shingles), bitmaps of nodes that
share some, and arrays of nodes whose bitmaps allow a link.

Defined results: null texts and texts without words have an empty set and link with nothing; texts
of fewer than five words are one shingle; a document's component is the smallest identifier
that links reach; null identifiers are ignored there, and a component of them alone has none;
rows that repeat an identifier are documents of their own; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from marketlens.llm import shingles
from marketlens.llm.common import in_buckets_of, stored, text_of
from marketlens.llm.components import connected_components

PERCENT = 80
SAMPLE = 20_000
FREQUENT = 400_000
BLOCK = 256
PAIRS_PER_ROW = 4
BATCH_TEXTS = 500
BATCH_CHARACTERS = 1 << 20
BAND = 1.26
BANDS = 64


def links(n, m, overlap, percent: int):
    return 100 * overlap >= percent * (n + m - overlap)


def size_band(n: Column) -> Column:
    """Sets that link are in the same band or in neighbouring ones."""
    return F.least(F.floor(F.log(n) / F.log(F.lit(BAND))), F.lit(BANDS - 1)).cast("int")


def band_of(nid: Column) -> Column:
    """Node numbers end with the band, so that postings need not carry sizes."""
    return F.pmod(nid, F.lit(BANDS)).cast("int")


# Bitmaps ------------------------------------------------------------------------------


def bitmap(hashes: np.ndarray) -> bytes:
    """A bit for each shingle, in a width that grows with the set."""
    width = 64
    while width < 2 * len(hashes):
        width *= 2
    bits = np.zeros(width, dtype=np.uint8)
    bits[(hashes >> np.uint64(20)) & np.uint64(width - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    while bits.shape[-1] > width:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


def overlap_bound(n, m, a: np.ndarray, b: np.ndarray):
    """Upper bound of the overlap; ``a`` may be many bitmaps, as rows of 64-bit words."""
    width = min(a.shape[-1], b.shape[-1])
    a, b = _folded(a, width), _folded(b, width)
    only_a = np.bitwise_count(a & ~b).sum(axis=-1, dtype=np.int64)
    only_b = np.bitwise_count(b & ~a).sum(axis=-1, dtype=np.int64)
    return np.minimum(n - only_a, m - only_b)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))


# Steps --------------------------------------------------------------------------------


def frequent_shingles(docs: DataFrame, text_col: str, words: int, sample: int) -> np.ndarray:
    """Sorted shingles that several documents of a bounded random sample hold."""
    total = docs.count()
    if not total:
        return np.zeros(0, dtype=np.uint64)
    some = docs.select(text_of(text_col).alias("text")).filter(F.rand(7) < min(1.0, sample / total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in text_batches(batches):
            sets = shingles.shingle_sets([t for t, in texts], words)
            yield pa.record_batch([pa.array(np.concatenate(sets).view(np.int64))], ["shingle"])

    counted = some.mapInArrow(run, "shingle bigint").groupBy("shingle").count().filter("count > 2")
    rows = counted.orderBy(F.desc("count"), "shingle").limit(FREQUENT).select("shingle").collect()
    return np.sort(np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64))


def text_batches(batches: Iterator[pa.RecordBatch], texts: int = BATCH_TEXTS, characters: int = BATCH_CHARACTERS) -> Iterator[list[tuple]]:
    """Rows, the text last, in lists of bounded length and text, so that arrays stay small whatever the batch."""
    held, size = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            held.append(row)
            size += len(row[-1])
            if len(held) >= texts or size >= characters:
                yield held
                held, size = [], 0
    if held:
        yield held


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, BATCH_TEXTS):
            yield batch.slice(low, BATCH_TEXTS)


def prefix(hashes: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """The shingles of which linked sets must share one: rare ones first."""
    n = len(hashes)
    size = n - -(-percent * n // 100) + 1 if n else 0
    if not len(frequent):
        return hashes[:size]
    at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
    common = frequent[at] == hashes
    return np.concatenate([hashes[~common], hashes[common]])[:size]


def node_of(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def shingled(docs: DataFrame, id_col: str, text_col: str, frequent: np.ndarray, words: int, percent: int) -> DataFrame:
    """``id, n, node, prefix, bits`` by document; of equal sets in a task only the first has the last two."""
    source = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for rows in text_batches(batches):
            sets = shingles.shingle_sets([t for _, t in rows], words)
            nodes = [node_of(s) for s in sets]
            prefixes, bits = [], []
            for node, found in zip(nodes, sets):
                new = node not in seen
                prefixes.append(prefix(found, shared.value, percent).view(np.int64) if new else None)
                bits.append(bitmap(found) if new else None)
                seen.add(node)
            yield pa.record_batch(
                [
                    pa.array([i for i, _ in rows], type=id_type), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(nodes, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())),
                    pa.array(bits, pa.binary()),
                ],
                ["id", "n", "node", "prefix", "bits"],
            )

    kind = source.schema["id"].dataType
    id_type = to_arrow_type(kind)
    return source.mapInArrow(run, f"id {kind.simpleString()}, n bigint, node binary, prefix array<bigint>, bits binary")


def arrays_of(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame, words: int) -> DataFrame:
    """``nid, n, hashes`` of the wanted ``id, node, nid``; only these texts are shingled again.

    A node may come several times where rows repeat an identifier.
    """
    source = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    some = in_buckets_of(source, wanted, "id")
    kind = source.schema["id"].dataType
    id_type = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_batches(batches):
            sets = shingles.shingle_sets([t for _, t in rows], words)
            yield pa.record_batch(
                [
                    pa.array([i for i, _ in rows], type=id_type), pa.array([node_of(s) for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()),
                ],
                ["id", "node", "n", "hashes"],
            )

    found = some.select("id", "text").mapInArrow(run, f"id {kind.simpleString()}, node binary, n bigint, hashes binary")
    found = in_buckets_of(found, wanted, "node")
    named = wanted.select("nid", F.col("node").alias("own_node"), F.col("id").alias("own_id"))
    same = (F.col("node") == F.col("own_node")) & F.col("id").eqNullSafe(F.col("own_id"))
    return found.join(named, same).select("nid", "n", "hashes")


def _words64(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.uint64)


def _side(nodes: DataFrame, name: str, column: str) -> DataFrame:
    return nodes.select(F.col("nid").alias(name), F.col("n").alias(f"n_{name}"), F.col(column).alias(f"{column}_{name}"))


def possible(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose bitmaps allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            keep = [
                bool(links(n, m, overlap_bound(n, m, _words64(x), _words64(y)), percent))
                for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "bits_a", "bits_b")))
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(_side(bits, "a", "bits"), "a").join(_side(bits, "b", "bits"), "b")
    return both.mapInArrow(run, "a bigint, b bigint")


def verified(pairs: DataFrame, arrays: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` that link, by their sorted arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            keep = []
            for x, y in zip(batch.column("hashes_a").to_pylist(), batch.column("hashes_b").to_pylist()):
                s, t = _words64(x), _words64(y)
                keep.append(bool(links(len(s), len(t), overlap(s, t), percent)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(_side(arrays, "a", "hashes"), "a").join(_side(arrays, "b", "hashes"), "b")
    return both.mapInArrow(run, "a bigint, b bigint")


def tiles(members: DataFrame, block: int) -> DataFrame:
    """Deals ``h, nid, comp`` into tiles ``h, low, i, j``: band ``low`` with itself or with the
    next one (negative j), block i against block j."""
    members = members.withColumn("band", band_of(F.col("nid")))
    blocks = members.groupBy("h", "band").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    sized = members.join(blocks, ["h", "band"]).withColumn("own", F.pmod(F.xxhash64("nid"), F.col("blocks")).cast("int"))
    below = blocks.select("h", (F.col("band") + 1).alias("band"), F.col("blocks").alias("blocks_below"))
    above = blocks.select("h", (F.col("band") - 1).alias("band"), F.col("blocks").alias("blocks_above"))
    sized = sized.join(below, ["h", "band"], "left").join(above, ["h", "band"], "left")
    others = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    none = F.array().cast("array<struct<low:int,i:int,j:int>>")

    def place(low: Column, i: Column, j: Column) -> Column:
        return F.struct(low.alias("low"), i.alias("i"), j.alias("j"))

    own = F.col("own")
    same = F.transform(others("blocks"), lambda k: place(F.col("band"), F.least(own, k), F.greatest(own, k)))
    up = F.coalesce(F.transform(others("blocks_above"), lambda k: place(F.col("band"), own, -1 - k)), none)
    down = F.coalesce(F.transform(others("blocks_below"), lambda k: place(F.col("band") - 1, k, -1 - own)), none)
    return sized.select("h", "nid", "comp", F.explode(F.concat(same, up, down)).alias("tile")).select(
        "h", "nid", "comp", "tile.low", "tile.i", "tile.j"
    )


TILE = ["h", "low", "i", "j"]


def _by_tile(rows: DataFrame, extra: DataFrame, judge, schema: str) -> DataFrame:
    """Runs ``judge`` over the rows of each tile, dealt and sorted by tile. Tiles are bounded."""
    dealt = rows.join(extra, "nid")
    count = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(count, *TILE).sortWithinPartitions(*TILE, "n", "nid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in _slices(batches):
            for row in batch.to_pylist():
                own = tuple(row[c] for c in TILE)
                if own != key:
                    if len(held) > 1:
                        yield from judge(held)
                    key, held = own, []
                held.append(row)
        if len(held) > 1:
            yield from judge(held)

    return dealt.mapInArrow(run, schema)


def _possible_pairs(rows: list[dict], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """By row, the earlier rows (smaller sets) of another component that the bitmaps allow."""
    n = np.array([r["n"] for r in rows])
    comp = np.array([r["comp"] for r in rows])
    bits = [_words64(r["bits"]) for r in rows]
    widths = np.array([len(b) for b in bits])
    start = 0
    for b in range(1, len(rows)):
        while 100 * n[start] < percent * n[b]:
            start += 1
        open_ = np.arange(start, b)[comp[start:b] != comp[b]]
        passed = []
        for width in np.unique(widths[open_]):
            same = open_[widths[open_] == width]
            bound = overlap_bound(n[same], n[b], np.stack([bits[k] for k in same]), bits[b])
            passed.append(same[links(n[same], n[b], bound, percent)])
        if passed:
            yield b, np.concatenate(passed)


def _suspects(percent: int):
    """Per tile the possible pairs, or, where these are many, the rows that have some.

    Either way the output is linear in the size of the tile. Of all the shingles that a pair shares
    only the tiles of the smallest propose it.
    """

    def judge(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        h, shared = rows[0]["h"], [frozenset(r["shared"]) for r in rows]
        possible = ((int(a), b) for b, others in _possible_pairs(rows, percent) for a in others)
        pairs = [(a, b) for a, b in possible if min(shared[a] & shared[b]) == h]
        if not pairs:
            return
        if len(pairs) <= PAIRS_PER_ROW * len(rows):
            left, right = [rows[a] for a, _ in pairs], [rows[b]["nid"] for _, b in pairs]
        else:
            left = [rows[k] for k in sorted({k for p in pairs for k in p})]
            right = [None] * len(left)
        names = [*TILE, "nid", "comp"]
        columns = [pa.array([r[c] for r in left], pa.int64()) for c in names]
        yield pa.record_batch([*columns, pa.array(right, pa.int64())], [*names, "other"])

    return judge


def _tile_links(percent: int):
    def judge(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        group = {r["comp"]: r["comp"] for r in rows}

        def root(x: int) -> int:
            while group[x] != x:
                x = group[x] = group[group[x]]
            return x

        sets = [_words64(r["hashes"]) for r in rows]
        made = []
        for b, others in _possible_pairs(rows, percent):
            for a in others.tolist():
                x, y = root(rows[a]["comp"]), root(rows[b]["comp"])
                if x != y and links(len(sets[a]), len(sets[b]), overlap(sets[a], sets[b]), percent):
                    made.append((rows[a]["comp"], rows[b]["comp"]))
                    group[max(x, y)] = min(x, y)
        if made:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*made)], ["a", "b"])

    return judge


def jaccard_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = shingles.WORDS,
    percent: int = PERCENT,
    sample: int = SAMPLE,
    block: int = BLOCK,
) -> DataFrame:
    """One row per document: ``<id_col>, n_shingles, component_id``."""
    frequent = frequent_shingles(docs, text_col, words, sample)
    sets = shingled(docs, id_col, text_col, frequent, words, percent)
    number = F.monotonically_increasing_id() * BANDS + F.coalesce(size_band(F.col("n")), F.lit(0))
    sets = stored(sets.withColumn("nid", number), "shingles")
    filled = sets.filter("n > 0")
    nodes = stored(
        filled.groupBy("node").agg(F.min("nid").alias("cid"), F.min("id").alias("least_id")), "nodes"
    )
    members = stored(_members(filled), "members")
    copies = filled.filter("prefix IS NOT NULL").select("node", "nid").join(nodes.select("node", "cid"), "node")
    copies = copies.filter("nid != cid").select(F.col("nid").alias("a"), F.col("cid").alias("b"))

    bits = filled.filter("bits IS NOT NULL").select("nid", "n", "bits")

    def settled(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.explode(F.array("a", "b")).alias("nid")).distinct()
        arrays = arrays_of(docs, id_col, text_col, filled.join(ends, "nid").select("id", "node", "nid"), words)
        return verified(pairs, stored(arrays, "arrays"), percent)

    near = F.abs(band_of(F.col("nid")) - band_of(F.col("leader"))) <= 1
    pairs = members.filter((F.col("nid") != F.col("leader")) & near).select(F.col("leader").alias("a"), F.col("nid").alias("b")).distinct()
    first = settled(stored(possible(pairs, bits, percent), "possible")).unionByName(copies)
    comps = stored(connected_components(first), "components")

    rest = stored(_unsettled(members, comps), "unsettled")
    shared = rest.groupBy("nid").agg(F.collect_list("h").alias("shared"))  # at most a prefix
    found = _by_tile(
        tiles(rest, block), bits.join(shared, "nid"), _suspects(percent),
        "h bigint, low bigint, i bigint, j bigint, nid bigint, comp bigint, other bigint",
    )
    found = stored(found, "suspects")
    pairs = found.filter("other IS NOT NULL").select(F.col("nid").alias("a"), F.col("other").alias("b")).distinct()
    by_comp = settled(stored(pairs, "pairs"))
    for end in ("a", "b"):
        own = comps.select(F.col("node").alias(end), "component")
        by_comp = by_comp.join(own, end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
    crowded = found.filter("other IS NULL").drop("other")
    held = filled.join(crowded.select("nid").distinct(), "nid").select("id", "node", "nid")
    arrays = arrays_of(docs, id_col, text_col, held, words).dropDuplicates(["nid"])
    arrays = arrays.join(bits.select("nid", "bits"), "nid")
    more = by_comp.unionByName(_by_tile(crowded, stored(arrays, "arrays"), _tile_links(percent), "a bigint, b bigint"))
    joined = stored(connected_components(more), "joined")
    joined = joined.select(F.col("node").alias("component"), F.col("component").alias("joined"))
    final = comps.join(joined, "component", "left").select("node", F.coalesce("joined", "component").alias("component"))
    lone = joined.join(comps, joined["component"] == comps["node"], "left_anti")
    final = final.unionByName(lone.select(F.col("component").alias("node"), F.col("joined").alias("component")))

    grouped = nodes.join(final.withColumnRenamed("node", "cid"), "cid", "left").select(
        "node", "least_id", F.coalesce("component", "cid").alias("component")
    )
    named = grouped.groupBy("component").agg(F.min("least_id").alias("component_id"))
    by_node = grouped.join(named, "component").select("node", "component_id")
    rows = sets.select("id", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")).join(by_node, "node", "left")
    return rows.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
    )


def _members(filled: DataFrame) -> DataFrame:
    """``h, nid, leader, size``: nodes by prefix shingle, where several share it."""
    postings = filled.select(F.explode("prefix").alias("h"), "nid")
    groups = postings.groupBy("h").agg(F.count(F.lit(1)).alias("size"), F.min("nid").alias("leader"))
    return postings.join(groups.filter("size > 1"), "h")


def _unsettled(members: DataFrame, comps: DataFrame) -> DataFrame:
    """Members of shingles that more than two nodes share and that join different components.

    Of two nodes one is the leader, so their pair is settled. The shingles of a passage are mostly
    shared by the same nodes; of shingles with equal members one is enough.
    """
    placed = members.filter("size > 2").join(comps.withColumnRenamed("node", "nid"), "nid", "left")
    placed = stored(placed.select("h", "nid", F.coalesce("component", "nid").alias("comp")), "placed")
    low = F.xxhash64("nid") % (1 << 31)
    mixed = placed.groupBy("h").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("nid").alias("first"), F.max("nid").alias("last"),
        F.count(F.lit(1)).alias("size"), F.sum(low).alias("sum"), F.sum(F.xxhash64("nid", F.lit(1)) % (1 << 31)).alias("sum2"),
    )
    one = mixed.filter("low < high").groupBy("first", "last", "size", "sum", "sum2").agg(F.min("h").alias("h"))
    return placed.join(one.select("h"), "h")


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents whose identifier is the smallest of their group, unchanged.

    Rows without an identifier stay; rows that repeat an identifier are one document and share its fate.
    """
    groups = jaccard_groups(docs, id_col, text_col, **options)
    gone = groups.filter(F.col("component_id") < F.col(id_col)).select(F.col(id_col).alias("_gone")).distinct()
    gone = stored(gone, "near-copies")
    keyed = docs.withColumn("_gone", F.col(id_col))
    clear = in_buckets_of(keyed, gone, "_gone", keep=False)
    doubtful = in_buckets_of(keyed, gone, "_gone").join(gone, "_gone", "left_anti")
    return clear.drop("_gone").unionByName(doubtful.drop("_gone"))
