"""Benchmark passages in a corpus, found through a positional inverted index.

The benchmark is cut into phrases of ``width`` consecutive words. Counting their terms over the
whole corpus tells the rarest terms of each phrase; the index stores the postings (text, position)
of these terms. A posting at position p of a term at offset o of a phrase proposes that the
phrase starts at p - o. Where the lists of the rarest terms agree on a start, the phrase is
compared word by word with the text. Starts that differ by at most ``slack`` words are proximity
matches.

Only DataFrame functions are used. Texts are known by their SHA-256, so copies are looked up once.
Texts are shuffled only if their hash falls into a bucket of some candidate. Terms and phrases of
the benchmark are broadcast up to ``BROADCAST_ROWS`` counted rows, and joined by shuffle beyond.

Defined results: null and empty texts have no words and are clean; items without words match
nothing; items shorter than the width are one phrase; a null item id counts as the id ''; items
that repeat an id are one item; repeated rows are judged each; empty tables give no matches;
further columns of either table are ignored by the search.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from marketlens.llm.common import bounded, in_buckets_of, lower_ascii, stored, text_of

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WIDTH = 13
PROBES = 2
SHARE = 20
BROADCAST_ROWS = 500_000


def split_words(text: Column) -> Column:
    """Words in order; the first and last entry are empty where the text starts or ends with a
    separator, which moves all positions alike."""
    return F.split(lower_ascii(text), SEPARATORS)


def word_count(words: Column) -> Column:
    blank = [(F.element_at(words, i) == "").cast("int") for i in (1, -1)]
    return F.when(F.size(words) == 1, 1 - blank[0]).otherwise(F.size(words) - blank[0] - blank[1]).cast("bigint")


def text_key(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def benchmark_phrases(items: DataFrame, item_col: str, text_col: str, width: int) -> DataFrame:
    """``item, phrase`` (words): all windows of all items, each once."""
    words = items.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"),
        F.filter(split_words(text_of(text_col)), lambda w: w != "").alias("words"),
    ).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - width + 1, F.lit(1)))
    return (
        words.select("item", "words", F.explode(starts).alias("at"))
        .select("item", F.slice("words", F.col("at"), width).alias("phrase"))
        .distinct()
    )


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    text = text_of(text_col)
    return docs.select(text_key(text).alias("key"), split_words(text).alias("words"))


def rarest_terms(docs: DataFrame, text_col: str, phrases: DataFrame, probes: int) -> DataFrame:
    """``term, phrase_id, offset, rank, probes``: the rarest places of each phrase.

    Phrases with a term that the corpus lacks are left out.
    """
    places = phrases.select("phrase_id", F.size("phrase").alias("size"), F.posexplode("phrase").alias("offset", "term"))
    terms = stored(places.select("term").distinct(), "terms")
    words = docs.select(F.explode(split_words(text_of(text_col))).alias("term"))
    counts = words.join(bounded(terms, terms.count(), BROADCAST_ROWS), "term").groupBy("term").count()
    order = Window.partitionBy("phrase_id").orderBy("count", "offset")
    ranked = places.join(counts, "term").select(
        "term", "phrase_id", "offset", "size",
        F.row_number().over(order).alias("rank"),
        F.count(F.lit(1)).over(Window.partitionBy("phrase_id")).alias("present"),
    )
    return ranked.filter((F.col("present") == F.col("size")) & (F.col("rank") <= probes)).select(
        "term", "phrase_id", "offset", "rank", F.least("size", F.lit(probes)).alias("probes")
    )


def build_index(docs: DataFrame, text_col: str, terms: DataFrame) -> DataFrame:
    """Postings ``term, key, position`` of the given terms, written to the shared folder."""
    words = _keyed(docs, text_col).select("key", F.posexplode("words").alias("position", "term"))
    found = words.join(bounded(terms, terms.count(), BROADCAST_ROWS), "term")
    return stored(found.select("term", "key", "position"), "postings")


def search(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WIDTH,
    probes: int = PROBES,
    slack: int | None = None,
) -> DataFrame:
    """Matches ``key`` (SHA-256 of the text), ``item, start, length, kind``.

    ``kind`` is 'exact' for phrases that occur word by word, starting at position ``start``, and, if
    ``slack`` is given, 'near' for phrases whose rarest terms occur in places that fit the
    phrase up to ``slack`` words but whose words are not all there.
    """
    windows = stored(
        benchmark_phrases(items, item_col, item_text_col, width).withColumn("phrase_id", F.xxhash64("phrase")), "windows"
    )
    phrases = windows.select("phrase_id", "phrase").distinct()
    rare = stored(rarest_terms(docs, text_col, phrases, probes), "probes")
    index = build_index(docs, text_col, rare.select("term").distinct())
    proposed = index.join(bounded(rare, rare.count(), BROADCAST_ROWS), "term").select(
        "key", "phrase_id", "rank", "probes", (F.col("position") - F.col("offset")).alias("start")
    )
    agreed = (
        proposed.groupBy("key", "phrase_id", "start")
        .agg(F.countDistinct("rank").alias("ranks"), F.max("probes").alias("probes"))
        .filter((F.col("ranks") == F.col("probes")) & (F.col("start") >= 0))
        .select("key", "phrase_id", "start")
    )
    agreed = stored(agreed, "candidates")
    texts = in_buckets_of(_texts(docs, text_col), agreed, "key").dropDuplicates(["key"])
    texts = texts.select("key", split_words(F.col("text")).alias("words"))
    exact = (
        agreed.join(bounded(phrases, windows.count(), BROADCAST_ROWS), "phrase_id")
        .join(texts, "key")
        .filter(F.slice("words", F.col("start") + 1, F.size("phrase")) == F.col("phrase"))
        .select("key", "phrase_id", "phrase", "start")
    )
    length = F.size("phrase").alias("length")
    by_item = bounded(windows, windows.count(), BROADCAST_ROWS)
    if slack is None:
        return exact.join(by_item, ["phrase_id", "phrase"]).select(
            "key", "item", "start", length, F.lit("exact").alias("kind")
        )
    exact = stored(exact, "exact")
    near = _near(proposed, slack).join(exact.select("key", "phrase_id", "start"), ["key", "phrase_id", "start"], "left_anti")
    near = near.join(bounded(phrases, windows.count(), BROADCAST_ROWS), "phrase_id")
    matches = exact.withColumn("kind", F.lit("exact")).unionByName(
        near.select("key", "phrase_id", "phrase", "start", F.lit("near").alias("kind"))
    )
    return matches.join(by_item, ["phrase_id", "phrase"]).select("key", "item", "start", length, "kind")


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    text = text_of(text_col)
    return docs.select(text_key(text).alias("key"), text.alias("text"))


def _near(proposed: DataFrame, slack: int) -> DataFrame:
    """Starts by the rarest term with a start of every other probe within ``slack`` words."""
    bucket = F.floor(F.col("start") / (slack + 1))
    first = proposed.filter("rank = 1").select(
        "key", "phrase_id", "start", "probes",
        F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"),
    )
    others = proposed.filter("rank > 1").select(
        "key", "phrase_id", "rank", F.col("start").alias("other"), bucket.alias("bucket")
    )
    near = first.join(others, ["key", "phrase_id", "bucket"]).filter(F.abs(F.col("start") - F.col("other")) <= slack)
    return (
        near.groupBy("key", "phrase_id", "start")
        .agg(F.countDistinct("rank").alias("ranks"), F.max("probes").alias("probes"))
        .filter(F.col("ranks") == F.col("probes") - 1)
        .select("key", "phrase_id", "start")
    )


def covered_words(matches: DataFrame) -> DataFrame:
    """``key, n_hit``: words inside any exact match. Matches overlap, so ends are kept running."""
    spans = matches.filter("kind = 'exact'").select("key", "start", (F.col("start") + F.col("length")).alias("end"))
    order = Window.partitionBy("key").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.col("end") - F.greatest("start", F.coalesce(before, F.col("start"))), F.lit(0))
    return (
        spans.distinct()
        .withColumn("fresh", fresh)
        .groupBy("key")
        .agg(F.sum("fresh").cast("bigint").alias("n_hit"))
    )


def item_lists(matches: DataFrame) -> DataFrame:
    found = matches.filter("kind = 'exact'").select("key", "item").distinct()
    return found.groupBy("key").agg(F.sort_array(F.collect_list("item")).alias("items"))


def is_contaminated(share: int) -> Column:
    return (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))


def judged(docs: DataFrame, items: DataFrame, text_col: str = "text", share: int = SHARE, **search_options) -> DataFrame:
    """One row per document: its other columns as struct ``document``, ``n_words, n_hit, items,
    contaminated``. A document is contaminated if one of ``share`` words or more is hit."""
    matches = stored(search(docs, items, text_col, **search_options), "matches")
    found = covered_words(matches).join(item_lists(matches), "key")
    text = text_of(text_col)
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows = docs.select(
        F.struct(*others).alias("document"), text_key(text).alias("key"), word_count(split_words(text)).alias("n_words")
    )
    return rows.join(found, "key", "left").select(
        "document",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    ).withColumn("contaminated", is_contaminated(share))


def decontaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", share: int = SHARE, **search_options) -> DataFrame:
    """The documents that are not contaminated, unchanged.

    Only documents whose hash shares a bucket with a contaminated text are shuffled.
    """
    matches = stored(search(docs, items, text_col, **search_options), "matches")
    hits = covered_words(matches)
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("document"), text_key(text_of(text_col)).alias("key"))
    texts = in_buckets_of(_texts(docs, text_col), hits, "key").dropDuplicates(["key"])
    counted = texts.select("key", word_count(split_words(F.col("text"))).alias("n_words"))
    guilty = stored(hits.join(counted, "key").filter(is_contaminated(share)).select("key"), "contaminated")
    clean = in_buckets_of(keyed, guilty, "key", keep=False)
    doubtful = in_buckets_of(keyed, guilty, "key").join(guilty, "key", "left_anti")
    return clean.select("document.*").unionByName(doubtful.select("document.*"))
