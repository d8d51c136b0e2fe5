"""Loading and exporting files."""

import datetime as dt
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from marketlens.operators.reviews import review_table
from marketlens.plans.registry import _enriched, export_reviews
from marketlens.plans.shop import Shop
from marketlens.sources import layout
from marketlens.sources.reader import has_broken_quotes, key_violations, load_table, load_tables, row_counts, typed
from marketlens.sources.schemas import COLUMNS, FILES
from marketlens.sources.scratch import clean, drop, materialize, new_path, scratch_dir
from marketlens.sources.writer import read_reviews, write_reviews


def test_csv_quirks(spark, tmp_path):
    path = tmp_path / "order_reviews_dataset.csv"
    path.write_text(
        "﻿review_id,order_id,review_score,review_comment_title,review_comment_message,"
        "review_creation_date,review_answer_timestamp\n"
        'r1,o1,5,NA,"first line\nsecond ""line"", with comma",2018-01-02 03:04:05,x\n'
        "r2,o2,4.0,null,,soon,y\n",
        encoding="utf-8",
    )
    rows = load_table(spark, str(path), "order_reviews").orderBy("review_id").collect()
    assert [tuple(r) for r in rows] == [
        ("r1", "o1", 5, None, 'first line\nsecond "line", with comma', dt.datetime(2018, 1, 2, 3, 4, 5), "x"),
        ("r2", "o2", 4, None, None, None, "y"),
    ]


def test_optional_and_missing_columns(spark):
    goods = spark.createDataFrame([("p", "c")], "product_id string, product_category_name string")
    loaded = typed(goods, "products")
    assert loaded.schema["product_weight_g"].dataType.simpleString() == "double"
    assert loaded.first().product_weight_g is None
    with pytest.raises(ValueError, match="customer_id"):
        typed(goods, "customers")
    with pytest.raises(ValueError, match="suffix"):
        load_tables(spark, "/nowhere", ".txt")


@pytest.mark.parametrize("table", FILES)
def test_line_breaks_in_any_table(spark, tmp_path, table):
    columns = [*(COLUMNS.get(table) or ["id"]), "note"]
    path = tmp_path / f"{table}.csv"
    cells = ",".join("" for _ in columns[1:])
    path.write_text(f'{",".join(columns)}\n"k1",{cells}"two\nlines"\n"k2",{cells}"one"\n')
    rows = load_table(spark, str(path), table).orderBy("note").collect()
    assert [r.note for r in rows] == ["one", "two\nlines"]
    with pytest.raises(Exception, match="(?i)malformed"):
        load_table(spark, str(path), table, single_line=True).select("note").count()
        load_table(spark, str(path), table, single_line=True).select(columns[0]).collect()
    path.write_text(f'{",".join(columns)}\n"k1",{cells}"one"\n')
    assert load_table(spark, str(path), table, single_line=True).count() == 1


def test_bad_numbers_become_null(spark, tmp_path):
    path = tmp_path / "order_payments_dataset.csv"
    path.write_text("order_id,payment_type,payment_value,payment_installments\no1,card,10.005,2\no2,card,much,n/a\no3,card,7,3.7\no4,card,1e3,4.0\n")
    rows = load_table(spark, str(path), "order_payments").orderBy("order_id").collect()
    assert [tuple(r) for r in rows] == [
        ("o1", "card", Decimal("10.005"), 2), ("o2", "card", None, None), ("o3", "card", 7, None), ("o4", "card", 1000, 4),
    ]


def test_parquet_and_csv_load_alike(spark, folder, tmp_path):
    shop = Shop(spark, folder)
    for suffix, write in ((".csv", lambda d, p: write_reviews(d, p)), (".parquet", lambda d, p: d.write.parquet(p))):
        for table, df in shop.catalog.items():
            write(df, f"{tmp_path}/{FILES[table]}{suffix}")
    csv, parquet = (load_tables(spark, str(tmp_path), s) for s in (".csv", ".parquet"))
    assert list(csv) == list(FILES)
    for table in ("orders", "order_items", "order_payments", "order_reviews", "products", "customers"):
        assert csv[table].schema.simpleString() == parquet[table].schema.simpleString()
        assert csv[table].exceptAll(parquet[table]).count() == 0
        assert csv[table].count() == parquet[table].count() > 0
    assert [tuple(r)[1:] for r in key_violations(csv).collect()] == [(0, 0)] * 4


def test_key_violations_are_found(spark):
    tables = {
        "orders": spark.createDataFrame([("a",), ("a",), (None,), (None,)], "order_id string"),
        "customers": spark.createDataFrame([("a",)], "customer_id string"),
        "products": spark.createDataFrame([("a",)], "product_id string"),
        "product_cat": spark.createDataFrame([("a",)], "product_category_name string"),
    }
    assert [tuple(r) for r in key_violations(tables).collect()] == [
        ("orders", 2, 1), ("customers", 0, 0), ("products", 0, 0), ("product_cat", 0, 0),
    ]


def test_a_repeated_order_is_refused(spark, folder, tmp_path):
    for table, df in Shop(spark, folder).catalog.items():
        if table == "orders":
            df = df.union(df.limit(1))
        df.write.parquet(f"{tmp_path}/{FILES[table]}.parquet")
    with pytest.raises(ValueError, match="orders \\(1\\)"):
        load_tables(spark, str(tmp_path), ".parquet")
    assert set(load_tables(spark, str(tmp_path), ".parquet", check_keys=False)) == set(FILES)


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_export_round_trip(spark, tmp_path, fmt):
    table = spark.createDataFrame(
        [(1, " padded ", 'quote " comma , back\\slash\nline\ttab', dt.datetime(2018, 1, 1, 0, 0, 1), Decimal("1.50")),
         (None, None, None, None, None)],
        "review_score int, review_comment_title string, review_comment_message string,"
        " review_creation_date timestamp_ntz, price decimal(18,2)",
    )
    path = str(tmp_path / fmt)
    write_reviews(table, path, fmt)
    back = read_reviews(spark, path, fmt, table.schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, table.collect()))


def test_unknown_format(spark, tmp_path):
    with pytest.raises(ValueError):
        write_reviews(spark.range(1), str(tmp_path / "x"), "xml")


def test_shared_folder_comes_from_the_session(spark):
    assert scratch_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert materialize(spark.range(3)).count() == 3


def test_partitions_are_folders_and_go_with_the_clean_up(spark, tmp_path):
    folder = str(tmp_path / "scratch")
    df = spark.range(100).selectExpr("id", "CAST(id % 4 AS int) AS part", "id * 2 AS twice")
    stored = materialize(df, "x", "part", folder)
    assert stored.columns == df.columns and stored.exceptAll(df).count() == 0 and stored.count() == 100
    plan = stored.where("part = 3").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "twice" not in plan
    own = new_path(spark, "y")
    spark.range(2).write.parquet(own)
    clean(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(own)
    assert stored.count() == 100


def test_scratch_tables_can_be_dropped_and_nothing_else(spark, tmp_path):
    path = new_path(spark, "kept")
    spark.range(3).write.parquet(path)
    drop(spark, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
    with pytest.raises(ValueError, match="not written by this application"):
        drop(spark, str(tmp_path))
    assert tmp_path.exists()


def test_files_are_split_only_where_no_cell_is(spark, tmp_path):
    header = "order_id,payment_type,payment_value,payment_installments\n"
    whole, broken = tmp_path / "a.csv", tmp_path / "b.csv"
    whole.write_text(header + "".join(f'o{i},"ca""rd, {i}",{i}.5,1\n' for i in range(20_000)))
    broken.write_text(header + 'o1,"ca\nrd",1.5,1\no2,"x",2,1\n')
    assert (has_broken_quotes(spark, str(whole)), has_broken_quotes(spark, str(broken))) == (False, True)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64KB")
    try:
        loaded = load_table(spark, str(whole), "order_payments")
        assert loaded.rdd.getNumPartitions() > 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert loaded.count() == 20_000 and loaded.where("order_id = 'o7'").first().payment_type == 'ca"rd, 7'
    assert load_table(spark, str(broken), "order_payments").orderBy("order_id").first().payment_type == "ca\nrd"


@pytest.mark.parametrize("breaks", [False, True])
def test_broken_rows_go_to_quarantine(spark, tmp_path, breaks):
    rows = ["o1,card,1.5,1", "o2,card", "o3,card,2,1,more", 'o4,"a, b",3,2', ",,,", *(['o5,"a\nb",4,1'] if breaks else [])]
    (tmp_path / "p.csv").write_text("order_id,payment_type,payment_value,payment_installments\n" + "\n".join(rows) + "\n")
    folder = str(tmp_path / "broken")
    loaded = load_table(spark, str(tmp_path / "p.csv"), "order_payments", quarantine=folder)
    assert sorted(str(r.order_id) for r in loaded.collect()) == sorted(["o1", "o4", "None", *(["o5"] if breaks else [])])
    refused = spark.read.parquet(folder).collect()
    assert sorted((r.table, r.broken_row.strip()) for r in refused) == [("order_payments", "o2,card"), ("order_payments", "o3,card,2,1,more")]
    counts = row_counts({"order_payments": loaded, "none": spark.range(0)}, folder)
    assert {r["table"]: (r.n_rows, r.n_quarantined) for r in counts.collect()} == {"order_payments": (3 + breaks, 2), "none": (0, 0)}


def test_other_headers_in_one_table_are_refused(spark, tmp_path):
    (tmp_path / "p.csv").mkdir()
    (tmp_path / "p.csv" / "a.csv").write_text("order_id,payment_type,payment_value,payment_installments\no1,card,1,1\n")
    (tmp_path / "p.csv" / "b.csv").write_text("payment_type,order_id,payment_value,payment_installments\ncard,o2,1,1\n")
    with pytest.raises(Exception, match="(?i)header"):
        load_table(spark, str(tmp_path / "p.csv"), "order_payments", quarantine=str(tmp_path / "q")).collect()


def test_tables_by_month(spark, orders, tmp_path):
    table = orders(("o1", "c", "2017-12-31 23:59:59"), ("o2", "c", "2018-01-01 00:00:00"), ("o3", "c", None), ("o4", "c", "2018-02-10 00:00:00"))
    items = spark.createDataFrame([("o1", 1), ("o2", 2), ("o2", 3), ("o3", 4), ("zz", 5), (None, 6)], "order_id string, n int")
    layout.write_by_month(layout.with_month(table), str(tmp_path / "orders"), 4)
    layout.write_by_month(layout.with_order_month(items, table), str(tmp_path / "items"), 4)
    assert {p.name for p in (tmp_path / "items").glob(f"{layout.MONTH}=*")} == {f"{layout.MONTH}={m}" for m in ("2017-12", "2018-01", "none")}
    stored, sold = (layout.read_by_month(spark, str(tmp_path / t), 4) for t in ("orders", "items"))
    assert stored.count() == 4 and sold.count() == 6
    assert [r.order_id for r in layout.period_orders(stored, "2018-01-01", "2018-02-09").collect()] == ["o2"]
    assert sorted(r.n for r in layout.period_rows(sold, stored, "2018-01-01", "2018-01-31").collect()) == [2, 3]


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_export_of_repeated_messages_is_compressed(spark, tmp_path, fmt):
    """A message is exported with each item of its order, so the files hold it many times over."""
    days = "timestamp_ntz'1998-01-01 00:00:00'"
    make = lambda name, sql: spark.sql(sql).write.parquet(f"{tmp_path}/{name}.parquet")
    make("orders", f"SELECT id AS o_orderkey, id AS o_custkey, 'F' AS o_orderstatus, 1.0D AS o_totalprice, {days} AS o_orderdate, '5-LOW' AS o_orderpriority FROM range(20)")
    make("lineitem", f"SELECT id % 20 AS l_orderkey, id % 3 AS l_partkey, 0L AS l_suppkey, CAST(id AS int) AS l_linenumber, 1.0D AS l_quantity, 2.5D AS l_extendedprice, 0.0D AS l_discount, 0.1D AS l_tax, 'N' AS l_returnflag, 'O' AS l_linestatus, {days} AS l_shipdate FROM range(2000)")
    make("part", "SELECT id AS p_partkey, 'a' AS p_name, 'SMALL' AS p_type, 1 AS p_size, 1.0D AS p_retailprice FROM range(3)")
    make("documents", "SELECT id AS doc_id, concat('line, \"', repeat(uuid(), 50), '\\n', 'end') AS text, 'web' AS source FROM range(20)")
    shop = Shop(spark, str(tmp_path))
    back = export_reviews(shop, fmt)
    texts = shop.table("documents").agg(F.sum(F.length("text"))).first()[0]
    written = sum(os.path.getsize(f.removeprefix("file://")) for f in back.inputFiles())
    assert written < 3 * texts  # each text is in a hundred rows
    table = review_table(_enriched(shop))
    assert back.count() == 2000 and back.exceptAll(table).isEmpty() and table.exceptAll(back).isEmpty()
