"""Main text of web pages by wrapper induction.

The pages of a host share a layout. One page of each host serves as wrapper; every page of the host is
aligned with it by simple tree matching, which gives its text blocks slots of the wrapper. Counting the texts
per slot over all pages tells constant slots, the template, from varying ones, the content. Elements whose
name, class or role says that they are menus, headers, footers, sidebars, notices, adverts, forms or comments are
left out, too, because on many sites these vary from page to page.

The counts are added up per task and shuffled as numbers, whatever the size of a host. Pages are parsed a
second time for their text rather than kept. Wrappers and templates are
broadcast if their counted size is small, and joined by host otherwise, where adaptive execution
splits large hosts.

Defined results: null and empty pages give an empty text; without a host or with few different pages of the host there
is no template and only the element rules hold; repeated rows give a text each and count once for the template, so copies
of an article do not make it one; a page is never emptied by the template; an empty table gives an empty result; broken markup is read as far as it goes; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from marketlens.llm import dom
from marketlens.llm.common import in_buckets_of, stored, text_of

MIN_PAGES = 5
CONSTANT = 0.8
BROADCAST_BYTES = 16 << 20
BATCH_PAGES = 200


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def _sized(df: DataFrame, column: str) -> DataFrame:
    """Marked for broadcast if its counted bytes are few."""
    size = df.agg(F.sum(F.length(column).cast("bigint") + 64)).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def wrappers(pages: DataFrame, id_col: str, min_pages: int) -> DataFrame:
    """``host, pages, wrapper``: the page with the smallest identifier of each host with enough different pages."""
    hosts = pages.filter("host IS NOT NULL").groupBy("host", F.xxhash64("html").alias("page")).agg(F.min(id_col).alias("first"))
    hosts = hosts.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.min("first").alias("first"))
    hosts = stored(hosts.filter((F.col("pages") >= min_pages) & F.col("first").isNotNull()), "hosts")
    some = in_buckets_of(pages, hosts.select(F.col("first").alias(id_col)), id_col)
    found = some.select(F.col("host").alias("own"), F.col(id_col).alias("id"), "html").join(
        hosts, (F.col("own") == F.col("host")) & (F.col("id") == F.col("first"))
    )
    return found.groupBy("host", "pages").agg(F.max("html").alias("wrapper"))


@lru_cache(maxsize=256)
def _wrapper(html: str) -> dom.Node:
    root = dom.parse(html)
    dom.number(root)
    return root


def _text_hash(words: list[str]) -> int:
    return xxhash.xxh64_intdigest(" ".join(words).encode("utf-8", "surrogatepass")) - (1 << 63)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    for batch in batches:
        for low in range(0, batch.num_rows, BATCH_PAGES):
            yield list(zip(*(c.to_pylist() for c in batch.slice(low, BATCH_PAGES).columns)))


def different(pages: DataFrame) -> DataFrame:
    """``host, html`` of every page once. Only pages that may be repeated are shuffled."""
    keyed = pages.filter("host IS NOT NULL").select("host", "html", F.xxhash64("host", "html").alias("page"))
    repeated = stored(keyed.groupBy("page").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("page"), "repeated-pages")
    alone = in_buckets_of(keyed, repeated, "page", keep=False)
    return alone.unionByName(in_buckets_of(keyed, repeated, "page").dropDuplicates(["page"])).drop("page")


def slot_counts(pages: DataFrame, wrapped: DataFrame) -> DataFrame:
    """``host, slot, hash, n``: how often a slot of a host has a text, added up in the tasks first."""
    source = pages.select("host", "html").join(_sized(wrapped.select("host", "wrapper"), "wrapper"), "host")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def batch_of() -> pa.RecordBatch:
            rows = [(*key, n) for key, n in counts.items()]
            counts.clear()
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64())
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["host", "slot", "hash", "n"])

        for rows in _rows(batches):
            for host, html, wrapper in rows:
                root = dom.parse(html)
                dom.align(root, _wrapper(wrapper))
                counts.update((host, n.slot, _text_hash(n.text)) for n in dom.leaves(root) if n.slot >= 0)
            if len(counts) > 100_000:
                yield batch_of()
        if counts:
            yield batch_of()

    found = source.select("host", "html", "wrapper").mapInArrow(run, "host string, slot int, hash bigint, n bigint")
    return found.groupBy("host", "slot", "hash").agg(F.sum("n").alias("n"))


def extracted(pages: DataFrame, layouts: DataFrame) -> DataFrame:
    """``id, url, blocks``: the texts of the main blocks that are not template."""
    source = pages.select(F.col("_id").alias("id"), "url", "host", "html").join(_sized(layouts, "wrapper"), "host", "left")
    kind = source.schema["id"].dataType
    id_type = to_arrow_type(kind)

    def blocks(html: str, wrapper: str | None, slots: list | None, hashes: list | None) -> list[str]:
        root = dom.parse(html)
        template = set()
        if wrapper is not None:
            dom.align(root, _wrapper(wrapper))
            template = set(zip(slots, hashes))
        main = dom.main_blocks(root)
        if not main:  # all was left out: then not by class or id
            root = dom.parse(html, names=False)
            if wrapper is not None:
                dom.align(root, _wrapper(wrapper))
            main = dom.main_blocks(root)
        varying = [n for n in main if not template or (n.slot, _text_hash(n.text)) not in template]
        return [" ".join(n.text) for n in varying or main]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _rows(batches):
            found = [blocks(*row[2:]) for row in rows]
            columns = (pa.array([r[0] for r in rows], id_type), pa.array([r[1] for r in rows], pa.string()))
            yield pa.record_batch([*columns, pa.array(found, pa.list_(pa.string()))], ["id", "url", "blocks"])

    return source.select("id", "url", "html", "wrapper", "slots", "hashes").mapInArrow(
        run, f"id {kind.simpleString()}, url string, blocks array<string>"
    )


def templates(counts: DataFrame, wrapped: DataFrame, constant: float) -> DataFrame:
    """``host, wrapper, slots, hashes``: the blocks that most pages of the host have in the same slot, at most as
    many as the wrapper has nodes. Hosts without any are left out."""
    sizes = wrapped.select("host", "pages")
    fixed = counts.join(_sized(sizes, "host"), "host").filter(F.col("n") >= constant * F.col("pages"))
    listed = stored(fixed.select("host", "slot", "hash"), "constants").groupBy("host")
    found = listed.agg(F.collect_list(F.struct("slot", "hash")).alias("found"))
    return found.select("host", "found.slot", "found.hash").toDF("host", "slots", "hashes").join(wrapped.select("host", "wrapper"), "host")


def main_text(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_pages: int = MIN_PAGES,
    constant: float = CONSTANT,
) -> DataFrame:
    """``<id_col>, <url_col>, text, blocks``: the main text by page, and its blocks in page order."""
    source = pages.select(
        F.col(id_col).alias("_id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), text_of(html_col).alias("html")
    )
    wrapped = stored(wrappers(source, "_id", min_pages), "wrappers")
    layouts = stored(templates(slot_counts(different(source), wrapped), wrapped, constant), "templates")
    found = extracted(source, layouts)
    return found.select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), F.array_join("blocks", " ").alias("text"), "blocks"
    )
