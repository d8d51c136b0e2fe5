"""Near-duplicate documents by one-permutation MinHash with optimal densification.

Two documents link if their sets of 5-word shingles have a Jaccard similarity of 0.85 or more. The steps:

1. One hash of each shingle gives its bin (of ``BANDS * ROWS``) and its value; a bin keeps its least value. An empty bin takes
   the value of a bin that a hash of its number and the attempt picks, trying until that one is not empty, so the
   densified signature has independent sources. Documents with equal sets are one node.
2. Bands of ``ROWS`` bins are buckets. At similarity 0.85 a band agrees with probability 0.52, so a pair shares none of 32
   bands with probability 6e-11.
3. Each bucket proposes a star: its members with its smallest node, one pair a member. Pairs of which
   three fifths of the bins agree (0.85 of them are expected, so a link falls below with probability 2e-11) are confirmed on
   the full sets. ``STAR_ROUNDS`` more stars follow in buckets that still join nodes of different components, each around
   another node of the bucket, for the nodes of other components than its own.
4. A star finds no links among members that are unlike its centre. Buckets that are open after the stars
   are therefore worked through whole: dealt into tiles of bounded size, in which all pairs of different
   components are compared by signature, and those that may link are confirmed on the full sets. Of buckets with the same members
   one is enough, and a pair is proposed by the smallest bucket it shares.

A star round makes at most 32 pairs a node; tiles give out at most ``PAIRS_PER_ROW`` pairs a row, and beyond that their rows, whose
sets are then compared within the tile, where joins of components come out. So no step gives out the square of a group; the
comparisons in tiles are quadratic in a group that shares a band without being linked, by nature, and are dealt over tasks.

Defined results: null texts and texts without words have an empty set and link with nothing; texts of fewer than five words
are one shingle; a component is named by the smallest identifier in it, and ``kept`` says whether that is the row's own;
null identifiers name none: a row without one is kept, and a component of them alone has no name; rows that repeat an
identifier are documents of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from marketlens.llm import shingles
from marketlens.llm.common import freed, in_buckets_of, stored, text_of
from marketlens.llm.components import connected_components, merged_components
from marketlens.llm.jaccard_join import BANDS as SIZE_BANDS
from marketlens.llm.jaccard_join import arrays_of, links, node_of, size_band, text_batches, tiles, verified

PERCENT = 85
BANDS, ROWS = 32, 4
BINS = BANDS * ROWS
AGREE = 3 * BINS // 5
STAR_ROUNDS = 2
#: Bounds of what a tile holds: signatures, which are short, and full sets, which are not.
BLOCK = 2048
SET_BYTES = 32 << 20
PAIRS_PER_ROW = 4
BATCH_TEXTS, BATCH_CHARACTERS = 250, 1 << 19
_SEED = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64((1 << 64) - 1)


def _picks(attempts: int) -> np.ndarray:
    """By attempt and bin, the bin to take a value from."""
    at = np.arange(attempts, dtype=np.uint64)[:, None] * np.uint64(BINS) + np.arange(BINS, dtype=np.uint64)[None]
    return (shingles.mix(at * np.uint64(2) + np.uint64(1)) % np.uint64(BINS)).astype(np.int64)


def densified(bins: np.ndarray, attempts: int = 64) -> np.ndarray:
    """Rows of bins with the empty ones filled; a row has at least one that is not empty."""
    filled, empty = bins.copy(), bins == _NONE
    row, place = np.nonzero(empty)
    attempt, picks = 0, _picks(attempts)
    while len(row):
        if attempt == len(picks):
            picks = _picks(2 * attempt)
        source = picks[attempt][place]
        found = ~empty[row, source]
        filled[row[found], place[found]] = bins[row[found], source[found]]
        row, place = row[~found], place[~found]
        attempt += 1
    return filled


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """By set, which is not empty, its densified bins."""
    sizes = [len(s) for s in sets]
    values = shingles.mix(np.concatenate(sets) ^ _SEED)
    row = np.repeat(np.arange(len(sets)), sizes)
    place = row * BINS + (values % np.uint64(BINS)).astype(np.int64)
    bins = np.full(len(sets) * BINS, _NONE)
    order = np.argsort(place, kind="stable")
    starts = np.flatnonzero(np.diff(place[order], prepend=-1))
    bins[place[order][starts]] = np.minimum.reduceat(values[order], starts)
    return densified(bins.reshape(len(sets), BINS))


def band_keys(bins: np.ndarray) -> np.ndarray:
    """By row of bins, a key for each band."""
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)[None] * np.ones((len(bins), 1), dtype=np.uint64)
    for k in range(ROWS):
        keys = shingles.mix(keys ^ bins[:, k::ROWS])
    return keys


def signed(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``id, n, node, sig, bands`` by document: a byte of each bin, and the keys of the bands."""
    source = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = source.schema["id"].dataType
    id_type = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_batches(batches, BATCH_TEXTS, BATCH_CHARACTERS):
            sets = shingles.shingle_sets([t for _, t in rows], words)
            filled = [k for k, s in enumerate(sets) if len(s)]
            sig, bands = [None] * len(sets), [None] * len(sets)
            if filled:
                bins = signatures([sets[k] for k in filled])
                for k, own, keys in zip(filled, (bins >> np.uint64(32)).astype(np.uint8), band_keys(bins).view(np.int64)):
                    sig[k], bands[k] = own.tobytes(), keys
            yield pa.record_batch(
                [
                    pa.array([i for i, _ in rows], type=id_type), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([node_of(s) for s in sets], pa.binary()), pa.array(sig, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                ["id", "n", "node", "sig", "bands"],
            )

    return source.mapInArrow(run, f"id {kind.simpleString()}, n bigint, node binary, sig binary, bands array<bigint>")


def _sigs(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), dtype=np.uint8).reshape(len(raw), BINS)


def alike(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose sizes allow a link and of which enough bins agree."""
    side = {x: nodes.select(F.col("nid").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}")) for x in "ab"}
    both = pairs.join(side["a"], "a").join(side["b"], "b")
    both = both.filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (_sigs(batch.column(c).to_pylist()) for c in ("sig_a", "sig_b"))
                yield batch.select(["a", "b"]).filter(pa.array((a == b).sum(axis=1) >= AGREE))

    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a bigint, b bigint")


TILE = ["h", "low", "i", "j"]


def smaller_tiles(rows: DataFrame, nodes: DataFrame, limit: int) -> DataFrame:
    """Deals the rows of a tile whose sets take more than ``limit`` bytes into tiles of two parts each, ``p`` and ``q``."""
    sizes = rows.join(nodes.select("nid", "n"), "nid").groupBy(*TILE).agg(F.ceil(16 * F.sum("n") / limit).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("nid", F.lit(1)), F.col("parts")).cast("int")
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    places = F.transform(others, lambda k: F.struct(F.least(own, k).alias("p"), F.greatest(own, k).alias("q")))
    return rows.join(sizes, TILE).withColumn("place", F.explode(places)).select(*rows.columns, "place.p", "place.q")


def per_tile(rows: DataFrame, extra: DataFrame, judge, schema: str, tile: list[str] = TILE) -> DataFrame:
    """Runs ``judge`` over the rows of each tile, which are at most two blocks."""
    dealt = rows.join(extra, "nid").repartition(*tile).sortWithinPartitions(*tile, "n", "nid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for low in range(0, batch.num_rows, BATCH_TEXTS):
                for row in batch.slice(low, BATCH_TEXTS).to_pylist():
                    own = tuple(row[c] for c in tile)
                    if own != key:
                        yield from judge(held)
                        key, held = own, []
                    held.append(row)
        yield from judge(held)

    return dealt.mapInArrow(run, schema)


def _candidates(rows: list[dict], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """By row, the earlier rows (smaller sets) of another component whose signature is alike."""
    n, comp = np.array([r["n"] for r in rows]), np.array([r["comp"] for r in rows])
    sigs = _sigs([r["sig"] for r in rows])
    start = 0
    for b in range(1, len(rows)):
        while 100 * n[start] < percent * n[b]:
            start += 1
        found = (comp[start:b] != comp[b]) & ((sigs[start:b] == sigs[b]).sum(axis=1) >= AGREE)
        if found.any():
            yield b, np.flatnonzero(found) + start


def _suspects(percent: int):
    """Per tile the candidate pairs, or, where these are many, its rows."""

    def judge(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        if len(rows) < 2:
            return
        h, shared = rows[0]["h"], [frozenset(r["shared"]) for r in rows]
        found = list(_candidates(rows, percent))
        many = sum(len(others) for _, others in found) > BANDS * PAIRS_PER_ROW * len(rows)
        pairs = [] if many else [(a, b) for b, others in found for a in others.tolist() if min(shared[a] & shared[b]) == h]
        if not many and not pairs:
            return
        if not many and len(pairs) <= PAIRS_PER_ROW * len(rows):
            left, right = [rows[a] for a, _ in pairs], [rows[b]["nid"] for _, b in pairs]
        else:
            left = [rows[k] for k in sorted({b for b, _ in found}.union(*(others.tolist() for _, others in found)))]
            right = [None] * len(left)
        names = [*TILE, "nid", "comp"]
        yield pa.record_batch([*(pa.array([r[c] for r in left], pa.int64()) for c in names), pa.array(right, pa.int64())], [*names, "other"])

    return judge


def _overlaps(sets: list[np.ndarray]) -> Iterator[np.ndarray]:
    """By set, the sizes of its intersections with all sets, from lists of the sets that hold each shingle."""
    sizes = np.array([len(x) for x in sets])
    _, place, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    holders = np.repeat(np.arange(len(sets)), sizes)[np.argsort(place, kind="stable")]
    starts, ends = np.cumsum(held) - held, np.cumsum(sizes)
    for end, size in zip(ends, sizes):
        own = place[end - size : end]
        counts = held[own]
        at = np.arange(counts.sum()) + np.repeat(starts[own] - (np.cumsum(counts) - counts), counts)
        yield np.bincount(holders[at], minlength=len(sets))


def _joins(percent: int):
    """Per tile the joins of components that full sets confirm, at most one a component."""

    def judge(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        if len({r["comp"] for r in rows}) < 2:
            return
        _, group = np.unique([r["comp"] for r in rows], return_inverse=True)
        n = np.array([r["n"] for r in rows])
        made = []
        for b, common in enumerate(_overlaps([np.frombuffer(r["hashes"], dtype=np.uint64) for r in rows])):
            linked = np.flatnonzero(links(n, n[b], common, percent) & (group != group[b]))
            while len(linked):
                made.append((rows[linked[0]]["nid"], rows[b]["nid"]))
                group[group == group[linked[0]]] = group[b]
                linked = linked[group[linked] != group[b]]
        if made:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*made)], ["a", "b"])

    return judge


def _open_buckets(members: DataFrame, comps: DataFrame) -> DataFrame:
    """``h, nid, comp`` of buckets that join different components; of buckets with equal members one."""
    placed = members.join(comps.withColumnRenamed("node", "nid"), "nid", "left")
    placed = stored(placed.select("h", "nid", F.coalesce("component", "nid").alias("comp")), "bucket-members")
    low = F.xxhash64("nid") % (1 << 31)
    mixed = placed.groupBy("h").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("nid").alias("first"), F.max("nid").alias("last"),
        F.count(F.lit(1)).alias("size"), F.sum(low).alias("sum"), F.sum(F.xxhash64("nid", F.lit(1)) % (1 << 31)).alias("sum2"),
    )
    one = mixed.filter("low < high").groupBy("first", "last", "size", "sum", "sum2").agg(F.min("h").alias("h"))
    rest = stored(placed.join(one.select("h"), "h"), "open-buckets")
    freed(placed)
    return rest


def minhash_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = shingles.WORDS,
    percent: int = PERCENT,
    block: int = BLOCK,
    set_bytes: int = SET_BYTES,
) -> DataFrame:
    """One row per document: ``<id_col>, n_shingles, component_id, kept``."""
    sets = stored(signed(docs, id_col, text_col, words), "signatures")
    nodes = sets.filter("n > 0").groupBy("node").agg(
        F.min("id").alias("least_id"), F.first("id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands")
    )
    number = F.monotonically_increasing_id() * SIZE_BANDS + size_band(F.col("n"))
    nodes = stored(nodes.withColumn("nid", number), "nodes")
    postings = nodes.select(F.explode("bands").alias("h"), "nid")
    buckets = postings.groupBy("h").agg(F.count(F.lit(1)).alias("size"), F.min("nid").alias("leader")).filter("size > 1")
    buckets = stored(buckets, "buckets")
    members = stored(in_buckets_of(postings, buckets, "h").join(buckets, "h"), "members")

    def confirmed(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.explode(F.array("a", "b")).alias("nid")).distinct()
        arrays = stored(_arrays(docs, id_col, text_col, nodes.join(ends, "nid"), words), "arrays")
        found = stored(verified(pairs, arrays, percent), "links")
        freed(arrays)
        return found

    star = members.filter(F.col("nid") != F.col("leader")).select(F.col("leader").alias("a"), F.col("nid").alias("b")).distinct()
    comps = stored(connected_components(confirmed(stored(alike(star, nodes, percent), "star"))), "components")

    rest = _open_buckets(members.filter("size > 2").select("h", "nid"), comps)
    freed(members, buckets)
    for turn in range(STAR_ROUNDS):
        centre = rest.groupBy("h").agg(F.min(F.struct(F.xxhash64("h", "nid", F.lit(turn)), "nid", "comp")).alias("centre"))
        apart = rest.join(centre, "h").filter("comp != centre.comp").select(F.least("nid", "centre.nid").alias("a"), F.greatest("nid", "centre.nid").alias("b"))
        comps = merged_components(comps, confirmed(stored(alike(apart.distinct(), nodes, percent), "star")))
        old, rest = rest, _open_buckets(rest.select("h", "nid"), comps)
        freed(old)
    shared = rest.groupBy("nid").agg(F.collect_list("h").alias("shared"))  # at most one a band
    found = per_tile(
        tiles(rest, block), nodes.select("nid", "n", "sig").join(shared, "nid"), _suspects(percent),
        "h bigint, low bigint, i bigint, j bigint, nid bigint, comp bigint, other bigint",
    )
    found = stored(found, "suspects")
    more = confirmed(stored(found.filter("other IS NOT NULL").select(F.col("nid").alias("a"), F.col("other").alias("b")).distinct(), "pairs"))
    crowded = found.filter("other IS NULL").drop("other")
    if not crowded.isEmpty():
        held = nodes.join(crowded.select("nid").distinct(), "nid")
        arrays = _arrays(docs, id_col, text_col, held, words).dropDuplicates(["nid"]).join(nodes.select("nid", "sig"), "nid")
        small = smaller_tiles(crowded, nodes, set_bytes)
        joins = per_tile(small, stored(arrays, "arrays"), _joins(percent), "a bigint, b bigint", [*TILE, "p", "q"])
        more = more.unionByName(stored(joins, "tile-links"))
    comps = merged_components(comps, more)

    grouped = nodes.select("node", "nid", "least_id").join(comps.withColumnRenamed("node", "nid"), "nid", "left")
    grouped = stored(grouped.select("node", "least_id", F.coalesce("component", "nid").alias("component")), "grouped")
    named = grouped.groupBy("component").agg(F.min("least_id").alias("component_id"))
    by_node = grouped.join(named, "component").select("node", "component_id")
    rows = sets.select("id", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")).join(by_node, "node", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return rows.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def _arrays(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame, words: int) -> DataFrame:
    """``nid, n, hashes`` of the wanted nodes, shingled again from the text of one of their documents."""
    return arrays_of(docs, id_col, text_col, wanted.select("id", "node", "nid"), words)


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that are kept, unchanged. Rows that repeat an identifier share its fate."""
    gone = minhash_groups(docs, id_col, text_col, **options).filter("NOT kept").select(F.col(id_col).alias("_gone")).distinct()
    gone = stored(gone, "near-copies")
    keyed = docs.withColumn("_gone", F.col(id_col))
    clear = in_buckets_of(keyed, gone, "_gone", keep=False)
    doubtful = in_buckets_of(keyed, gone, "_gone").join(gone, "_gone", "left_anti")
    return clear.drop("_gone").unionByName(doubtful.drop("_gone"))
