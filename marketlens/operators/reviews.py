"""Customer reviews: scores, trends, comments, search, display."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.columns import amount, ratio, shortened, timestamp, year_month
from marketlens.functions.pages import OrderedRows, ordered_rows
from marketlens.functions.tables import left_join_many, ranked

CATEGORY = "product_category_name_english"

# Texts and column names of the review table as users see it.
NO_TITLE = "(Tanpa Judul)"
NO_MESSAGE = "(Tidak ada komentar)"
DISPLAY_NAMES = {
    "review_score": "Rating",
    "review_comment_title": "Judul Ulasan",
    "review_comment_message": "Isi Ulasan",
    "review_creation_date": "Tanggal",
    "price": "Harga (€)",
}
DISPLAY_LIMIT = 150
SAMPLE_LIMIT = 200

SENTIMENTS = ("positive", "neutral", "negative")


def reviews_enriched(
    reviews: DataFrame, items: DataFrame, products: DataFrame, translation: DataFrame
) -> DataFrame:
    """Reviews with items, products and English category. Grain review x item.

    Reviews of orders without items stay. Products get their category and items their
    product first, so that the review texts are shuffled once, for the join by order.
    """
    described = items.join(_with_category(products, translation), "product_id", "left")
    return left_join_many(reviews, described, "order_id", counted=items)


def reviews_by_category(
    reviews: DataFrame, items: DataFrame, products: DataFrame, translation: DataFrame
) -> DataFrame:
    """Reviews with the categories of their orders. Grain review x category.

    Stands in for ``reviews_enriched`` in all operators that count or average: ``item_rows``
    tells how many rows a row stands for, ``price`` is their total over ``price_rows``
    prices. An order with very many items adds a row per category to each of its reviews
    instead of a row per item.
    """
    categories = _with_category(products, translation).select("product_id", CATEGORY)
    price = amount(items, "price")
    per_category = (
        items.join(categories, "product_id", "left")
        .groupBy("order_id", CATEGORY)
        .agg(
            F.count("*").alias("item_rows"),
            F.sum(price).alias("price"),
            F.count(price).alias("price_rows"),
        )
    )
    # An order has at most a row per category, so no order is hot on this side.
    return reviews.join(per_category, "order_id", "left").withColumn(
        "item_rows", F.coalesce("item_rows", F.lit(1))
    )


def review_categories(enriched: DataFrame) -> DataFrame:
    """English categories that occur, by name: ``product_category_name_english``."""
    categories = enriched.where(F.col(CATEGORY).isNotNull()).select(CATEGORY).distinct()
    return ranked(categories, F.asc(CATEGORY))


def filter_reviews(
    enriched: DataFrame, category: str, scores: Sequence[int] = (1, 2, 3, 4, 5)
) -> DataFrame:
    """Reviews of one category with one of the given scores."""
    return enriched.where(
        (F.col(CATEGORY) == category) & F.col("review_score").isin(list(scores))
    )


def review_kpis(reviews: DataFrame, by: str | None = None) -> DataFrame:
    """``avg_rating, total_reviews, positive_pct, avg_price``, in one row or per ``by``.

    Mean score and price weigh every row; ``positive_pct`` is rows with a score of 4 or 5
    per distinct review, so reviews of several items can lift it above 100.
    """
    if by:
        reviews = reviews.where(F.col(by).isNotNull())
    distinct = F.countDistinct("review_id")
    positive = ratio(_rows(reviews, F.col("review_score") >= 4), distinct) * 100
    prices = F.sum("price_rows") if "price_rows" in reviews.columns else F.count(amount(reviews, "price"))
    return reviews.groupBy(*([by] if by else [])).agg(
        _mean_score(reviews).alias("avg_rating"),
        distinct.alias("total_reviews"),
        F.coalesce(positive, F.lit(0.0)).alias("positive_pct"),
        ratio(F.sum(amount(reviews, "price")), prices).alias("avg_price"),
    )


def rating_distribution(reviews: DataFrame) -> DataFrame:
    """Rows per score, by score: ``review_score, n``."""
    known = F.col("review_score").isNotNull()
    counts = reviews.where(known).groupBy("review_score").agg(_rows(reviews).alias("n"))
    return ranked(counts, F.asc("review_score"))


def sentiment(score: Column) -> Column:
    """``positive`` from 4 on, ``neutral`` for 3, ``negative`` up to 2."""
    return (
        F.when(score >= 4, "positive").when(score == 3, "neutral").when(score <= 2, "negative")
    )


def sentiment_mix(reviews: DataFrame) -> DataFrame:
    """Rows per sentiment, absent ones with 0: ``sentiment, n``."""
    mood = sentiment(F.col("review_score"))
    rows = F.array(
        *(
            F.struct(F.lit(s).alias("sentiment"), _rows(reviews, mood == s).alias("n"))
            for s in SENTIMENTS
        )
    )
    return reviews.agg(rows.alias("rows")).select(F.inline("rows"))


def review_trend(reviews: DataFrame) -> DataFrame:
    """By review month: ``year_month, n_reviews, avg_score, avg_score_x10``."""
    month = year_month(timestamp("review_creation_date"))
    avg = _mean_score(reviews)
    return (
        reviews.withColumn("year_month", month)
        .where(F.col("year_month").isNotNull())
        .groupBy("year_month")
        .agg(
            _rows(reviews, F.col("review_id").isNotNull()).alias("n_reviews"),
            avg.alias("avg_score"),
            (avg * 10).alias("avg_score_x10"),
        )
    )


def rating_by_calendar_month(reviews: DataFrame) -> DataFrame:
    """Seasonality: ``month, month_name, avg_score``."""
    ts = timestamp("review_creation_date")
    return (
        reviews.where(ts.isNotNull())
        .groupBy(F.month(ts).alias("month"), F.date_format(ts, "MMM").alias("month_name"))
        .agg(_mean_score(reviews).alias("avg_score"))
    )


def rating_by_weekday(reviews: DataFrame) -> DataFrame:
    """``weekday, avg_score``."""
    ts = timestamp("review_creation_date")
    return (
        reviews.where(ts.isNotNull())
        .groupBy(F.date_format(ts, "EEEE").alias("weekday"))
        .agg(_mean_score(reviews).alias("avg_score"))
    )


def sample_comments(
    reviews: DataFrame, mood: str, k: int = 5, limit: int = SAMPLE_LIMIT
) -> DataFrame:
    """The first comments of a sentiment by review id: ``rating, title, comment, date``."""
    commented = reviews.where(
        F.col("review_comment_message").isNotNull() & (sentiment(F.col("review_score")) == mood)
    )
    return ranked(
        commented.select(
            "review_id",
            "order_id",
            F.concat(F.col("review_score").cast("string"), F.lit("/5")).alias("rating"),
            F.coalesce("review_comment_title", F.lit("-")).alias("title"),
            shortened(F.col("review_comment_message"), limit).alias("comment"),
            timestamp("review_creation_date").alias("date"),
        ),
        F.asc("review_id"), F.asc("order_id"), F.asc("comment"), F.asc("title"),
        k=k,
    ).select("rating", "title", "comment", "date")


def search_reviews(reviews: DataFrame, term: str, regex: bool = True) -> DataFrame:
    """Reviews with ``term`` in title or message, in any letter case.

    The term is a Java regular expression, or literal text with ``regex=False``. A missing
    title or message does not match.
    """

    def found(text: Column) -> Column:
        if regex:
            return text.rlike(f"(?iu){term}")
        return F.contains(F.lower(text), F.lit(term.lower()))

    return reviews.where(
        found(F.col("review_comment_title")) | found(F.col("review_comment_message"))
    )


def review_order(reviews: DataFrame, by: str = "date_desc") -> list[Column]:
    """What ``sort_reviews`` sorts by."""
    orders = {
        "date_desc": F.desc_nulls_last("review_creation_date"),
        "score_desc": F.desc_nulls_last("review_score"),
        "score_asc": F.asc_nulls_last("review_score"),
        "price_desc": F.desc_nulls_last("price"),
        "price_asc": F.asc_nulls_last("price"),
    }
    if by not in orders:
        raise ValueError(f"by must be one of {sorted(orders)}, not {by!r}")
    ids = ("review_id", "order_id", "order_item_id", "product_id", "seller_id")
    return [orders[by], *(F.asc(c) for c in ids if c in reviews.columns)]


def sort_reviews(reviews: DataFrame, by: str = "date_desc") -> DataFrame:
    """Sorted reviews, nulls last. ``by``: date_desc, score_desc, score_asc, price_desc, price_asc.

    Ids break ties. They also let the sort divide the many reviews that share a score. To show page after page,
    sort once with ``review_pages``.
    """
    return reviews.orderBy(*review_order(reviews, by))


def review_pages(reviews: DataFrame, by: str = "date_desc") -> OrderedRows:
    """The sorted reviews, stored, for ``page(first, size)``."""
    return ordered_rows(reviews, *review_order(reviews, by))


def review_table(reviews: DataFrame) -> DataFrame:
    """The five columns that are shown and exported, unformatted."""
    return reviews.select(*DISPLAY_NAMES)


def review_display(reviews: DataFrame, limit: int = DISPLAY_LIMIT) -> DataFrame:
    """The review table as users see it: labels, prices, fillers, shortened messages."""
    score, price = F.col("review_score"), F.col("price")
    shown = {
        "review_score": F.concat(F.lit("⭐ "), score.cast("string"), F.lit("/5")),
        "review_comment_title": F.coalesce("review_comment_title", F.lit(NO_TITLE)),
        "review_comment_message": F.coalesce(
            shortened(F.col("review_comment_message"), limit), F.lit(NO_MESSAGE)
        ),
        "review_creation_date": F.col("review_creation_date"),
        "price": F.concat(F.lit("€ "), F.format_number(price, 2)),
    }
    for c in ("review_score", "price"):
        shown[c] = F.coalesce(shown[c], F.lit("-"))
    return reviews.select(*(shown[c].alias(name) for c, name in DISPLAY_NAMES.items()))


def review_extremes(reviews: DataFrame) -> DataFrame:
    """Perfect (5) and poor (2 or less) rows: ``excellent, poor``."""
    score = F.col("review_score")
    return reviews.agg(
        _rows(reviews, score == 5).alias("excellent"), _rows(reviews, score <= 2).alias("poor")
    )


def _with_category(products: DataFrame, translation: DataFrame) -> DataFrame:
    return products.join(translation, "product_category_name", "left")


def _weight(reviews: DataFrame) -> Column:
    """Rows of review x item that a row stands for."""
    return F.col("item_rows") if "item_rows" in reviews.columns else F.lit(1).cast("bigint")


def _rows(reviews: DataFrame, condition: Column | None = None) -> Column:
    """Aggregate: review x item rows that meet the condition."""
    weight = _weight(reviews)
    counted_rows = weight if condition is None else F.when(condition, weight)
    return F.coalesce(F.sum(counted_rows), F.lit(0))


def _mean_score(reviews: DataFrame) -> Column:
    """Aggregate: mean score over review x item rows."""
    score = F.col("review_score")
    return ratio(F.sum(score * _weight(reviews)), _rows(reviews, score.isNotNull()))
