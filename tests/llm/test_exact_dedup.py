import hashlib
import re

from pyspark.sql import functions as F

from marketlens.llm import exact_dedup

SCHEMA = "doc_id long, text string, _text string, kept string"
ROWS = [
    (5, "a  b", "x", None),
    (3, "a\tb", None, "y"),
    (4, "a b", None, None),
    (9, None, None, None),
    (8, "", None, None),
    (None, "a b", None, None),
    (7, "long " * 50_000, None, None),
    (1, "a b ", None, None),
    (3, "a b", "again", None),
]


def expected(rows):
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows]
    found = []
    for row, text in zip(rows, texts):
        same = [r[0] for r, t in zip(rows, texts) if t == text]
        keep = min((x for x in same if x is not None), default=None)
        found.append((str(row[0]), str(keep), len(same), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(found)


def results(df):
    return sorted(
        (str(r["document"]["doc_id"]), str(r["keep_id"]), r["group_size"], r["digest"]) for r in df.collect()
    )


def test_edge_rows(spark, tmp_path):
    path = str(tmp_path / "docs.parquet")
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.parquet(path)
    found = exact_dedup.exact_dedup(spark, path)
    assert results(found) == expected(ROWS)
    assert found.filter("kept").count() == len({r[3] for r in expected(ROWS)})


def test_colliding_digests_are_told_apart(spark, tmp_path):
    path = str(tmp_path / "docs.parquet")
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(path)
    found = exact_dedup.exact_dedup(spark, path, digest=lambda text: F.lit("same"))
    assert [r[:3] for r in results(found)] == [r[:3] for r in expected(ROWS)]


def test_state_goes_on_with_new_files(spark, tmp_path):
    path, state = str(tmp_path / "docs.parquet"), str(tmp_path / "state")
    spark.createDataFrame(ROWS[:4], SCHEMA).coalesce(1).write.parquet(path)
    first = exact_dedup.exact_dedup(spark, path, state=state)
    assert results(first) == expected(ROWS[:4])
    spark.createDataFrame(ROWS[4:], SCHEMA).repartition(2).write.mode("append").parquet(path)
    found = exact_dedup.exact_dedup(spark, path, state=state, files_per_batch=1)
    assert results(found) == expected(ROWS)


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "docs.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    assert exact_dedup.exact_dedup(spark, path).collect() == []
