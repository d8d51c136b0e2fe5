"""Exact deduplication with a keyed state that lives on disk and never expires.

A stream over the files of a table keeps one state entry per text digest: the digest, the
smallest identifier seen, the locator of that content (file and row within it) and the number
of rows. The state is held by RocksDB and saved in the shared folder, so a restarted run goes on
where it stopped and reads only new files. Rows are pre-aggregated per digest before they are
shuffled, so a text with very many copies is one state update per input task. Every hit is
then compared byte by byte with the content its state entry points to.

Defined results: null text counts as empty; equal texts are compared after white space runs
became one space; rows that repeat an identifier are separate rows, told apart by their place in
the files; among equal identifiers the first place stays; a null identifier ranks behind all
others; an empty table gives an empty result; other columns are carried along, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm.common import SPACES, stored, text_of
from marketlens.sources import scratch

STATE_ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    # Else each of many small stores reserves megabytes of empty disk.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def normalised(text: Column) -> Column:
    return F.regexp_replace(text_of(text), SPACES, " ")


def _keyed(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]):
    """Digest, normalised text and locator; the locator orders by identifier, then place."""
    text = normalised(F.col(text_col))
    locator = F.struct(
        F.col(id_col).isNull().alias("no_id"),
        F.col(id_col).alias("id"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    )
    return text.alias("_text"), digest(text).alias("_digest"), locator.alias("_at")


def update_state(
    spark: SparkSession,
    path: str,
    state: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    files_per_batch: int | None = None,
) -> DataFrame:
    """Takes the files of the Parquet table ``path`` that ``state`` has not seen into the state.

    Returns the state: ``digest, kept (locator), group_size``. Call it again with the same
    ``state`` folder after files were added; entries never expire.
    """
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # As a pattern the path may name a single file as well as a folder.
    stream = reader.parquet(f"{path.rstrip('/')[:-1]}[{path.rstrip('/')[-1]}]")
    _, key, at = _keyed(stream, id_col, text_col, digest)
    before = {name: spark.conf.get(name, None) for name in STATE_ON_DISK}
    for name, value in STATE_ON_DISK.items():
        spark.conf.set(name, value)
    try:
        (
            stream.select(key, at)
            .groupBy("_digest")
            .agg(F.min("_at").alias("kept"), F.count(F.lit(1)).alias("group_size"))
            .writeStream.format("noop")
            .outputMode("update")
            .option("checkpointLocation", state)
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    return read_state(spark, state)


def read_state(spark: SparkSession, state: str) -> DataFrame:
    entries = spark.read.format("statestore").load(state)
    return entries.select(
        F.col("key._digest").alias("_digest"),
        F.col("value.min").alias("kept"),
        F.col("value.count").alias("group_size"),
    )


def exact_dedup(
    spark: SparkSession,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    state: str | None = None,
    files_per_batch: int | None = None,
) -> DataFrame:
    """Every row of the table with its verdict.

    Returns the table's columns as struct ``document`` and ``digest, keep_id, group_size, kept``. Of equal
    texts the row with the smallest identifier stays. ``state`` names the folder of the state;
    without it a new one in the shared folder is used.
    """
    docs = spark.read.parquet(path)
    folder = state or scratch.new_path(spark, "dedup-state")
    if docs.isEmpty():
        entries = None
    else:
        entries = update_state(spark, path, folder, id_col, text_col, digest, files_per_batch)
    text, key, at = _keyed(docs, id_col, text_col, digest)
    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("document"), text, key, at)
    if entries is None:
        return _verdicts(rows.withColumns({"kept": F.col("_at"), "group_size": F.lit(0)}))
    # Texts are kept only where something has to be compared.
    copy = F.col("group_size") > 1
    joined = rows.join(entries, "_digest")
    joined = stored(joined.withColumn("_text", F.when(copy, F.col("_text"))), "dedup")
    differing = _collisions(joined)
    in_doubt = joined.join(differing, "_digest", "left_semi").drop("kept", "group_size")
    exact = in_doubt.groupBy("_digest", "_text").agg(
        F.min("_at").alias("kept"), F.count(F.lit(1)).alias("group_size")
    )
    settled = in_doubt.join(exact, ["_digest", "_text"])
    clear = joined.join(differing, "_digest", "left_anti")
    return _verdicts(clear.unionByName(settled))


def _collisions(joined: DataFrame) -> DataFrame:
    """Digests under which different bytes were found."""
    copies = joined.filter(F.col("group_size") > 1)
    first = copies.filter(F.col("_at") == F.col("kept")).select("_digest", F.col("_text").alias("_first"))
    hits = copies.filter(F.col("_at") != F.col("kept")).select("_digest", "_text")
    different = F.col("_text").cast("binary") != F.col("_first").cast("binary")
    # Stored, as a distinct right behind the join would keep adaptive execution from splitting a
    # text with very many copies.
    return stored(hits.join(first, "_digest").filter(different).select("_digest"), "collisions").distinct()


def _verdicts(rows: DataFrame) -> DataFrame:
    return rows.select(
        "document",
        F.col("_digest").alias("digest"),
        F.col("kept.id").alias("keep_id"),
        F.col("group_size").cast("bigint").alias("group_size"),
        (F.col("_at") == F.col("kept")).alias("kept"),
    )
