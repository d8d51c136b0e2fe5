"""Loading the eleven shop tables."""

from __future__ import annotations

from collections.abc import Collection
from functools import reduce

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.functions.columns import MONEY, money
from marketlens.sources.schemas import (
    COLUMNS,
    FILES,
    NULL_TOKENS,
    OPTIONAL,
    UNIQUE_KEYS,
)


#: Column of a row's text where it does not have the cells that the header asks for.
BROKEN = "broken_row"


def load_tables(
    spark: SparkSession,
    path: str,
    suffix: str = ".csv",
    single_line: Collection[str] = (),
    check_keys: bool = True,
    quarantine: str | None = None,
) -> dict[str, DataFrame]:
    """All shop tables below ``path`` by name; ``suffix`` is '.csv' or '.parquet'.

    A table may be one file or a folder of part files of that name. Columns are found by
    name, so their order does not matter and further columns stay as text.

    Cells of any table may hold line breaks inside quotes. Every CSV table is looked through for them, in parallel
    (``has_broken_quotes``): without any, its files are split and read by many tasks, otherwise each file
    is read by one. A table named in ``single_line`` is split unseen, and a row that does not have all its
    cells on one line is an error there.

    With a folder for ``quarantine``, rows that have too few or too many cells are written there, as ``table`` and
    ``broken_row`` (the line), and are left out of the table; ``row_counts`` counts them. Without one they are
    filled up with nulls. All files of a table must have the same header.

    The operators count rows of the tables in ``UNIQUE_KEYS``, so a repeated key there is an error,
    found by one aggregation per table. Pass ``check_keys=False`` if the keys are known to be unique.
    """
    if suffix not in (".csv", ".parquet"):
        raise ValueError(f"suffix must be '.csv' or '.parquet', not {suffix!r}")
    root = path.rstrip("/")
    tables = {
        table: load_table(spark, f"{root}/{stem}{suffix}", table, suffix, True if table in single_line else None, quarantine)
        for table, stem in FILES.items()
    }
    if check_keys:
        repeated = key_violations(tables).where("repeated_keys > 0").collect()
        if repeated:
            counts = ", ".join(f"{r['table']} ({r['repeated_keys']})" for r in repeated)
            raise ValueError(f"tables with repeated keys: {counts}")
    return tables


def load_table(
    spark: SparkSession,
    path: str,
    table: str,
    suffix: str = ".csv",
    single_line: bool | None = None,
    quarantine: str | None = None,
) -> DataFrame:
    """One shop table; see ``load_tables``. ``single_line`` is looked up if it is not given."""
    if suffix == ".parquet":
        return typed(spark.read.parquet(path), table)
    split = not has_broken_quotes(spark, path) if single_line is None else single_line
    reader = spark.read.options(header=True, quote='"', escape='"', multiLine=not split)
    if quarantine:
        raw = _without_broken_rows(reader, path, table, quarantine)
    else:
        if single_line:  # all cells of a row are looked at, or a broken row could pass
            reader = reader.options(mode="FAILFAST", columnPruning=False)
        raw = reader.csv(path)
    tokens = ", ".join(f"'{t}'" for t in NULL_TOKENS)
    present = (f"CASE WHEN `{c}` NOT IN ({tokens}) THEN `{c}` END AS `{c}`" for c in raw.columns)
    return typed(raw.selectExpr(*present), table)


def has_broken_quotes(spark: SparkSession, path: str) -> bool:
    """Whether a line has an odd number of quotes. A row with a line break in a cell makes two of them, and where there is none
    every row is on one line, as quotes within cells are doubled."""
    lines = spark.read.text(path)
    return not lines.where((F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1).isEmpty()


def _without_broken_rows(reader: DataFrameReader, path: str, table: str, quarantine: str) -> DataFrame:
    columns = reader.csv(path).columns
    kinds = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, BROKEN]])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN, "columnPruning": False, "enforceSchema": False}
    raw = reader.schema(kinds).options(**options).csv(path)
    # Spark does not answer what reads the broken row alone, so both sides look at the first cell as well.
    read = F.length(F.coalesce(F.col(f"`{columns[0]}`"), F.lit(""))) >= 0
    broken = F.col(BROKEN).isNotNull()
    raw.where(broken & read).select(F.lit(table).alias("table"), BROKEN).write.mode("append").parquet(quarantine)
    return raw.where(~broken & read).drop(BROKEN)


def typed(raw: DataFrame, table: str) -> DataFrame:
    """Declared columns in their types; other columns unchanged.

    What is no number, no date or, in a column of whole numbers, not whole becomes null. Amounts keep up to
    eight decimals, and one that is too large is an error.
    """
    declared = COLUMNS.get(table, {})
    given = dict(raw.dtypes)
    required = declared.keys() - OPTIONAL.get(table, set()) - given.keys()
    if required:
        raise ValueError(f"{table} lacks the columns {sorted(required)}")

    def column(name: str, to: str) -> Column:
        if name not in given:
            return F.lit(None).cast(to).alias(name)
        if to == MONEY:
            return money(name).alias(name)
        value = f"`{name}`"
        if to == "int":  # "3.0" is a whole number, "3.7" is none
            number = f"try_cast({value} AS double)"
            value = f"CASE WHEN {number} = floor({number}) THEN {number} END"
        return F.expr(f"try_cast({value} AS {to})").alias(name)

    return raw.select(
        *(column(name, to) for name, to in declared.items()),
        *(F.col(f"`{c}`") for c in given if c not in declared),
    )


def row_counts(tables: dict[str, DataFrame], quarantine: str | None = None) -> DataFrame:
    """``table, n_rows, n_values`` (cells that are not null) of every table, and with the folder of refused rows
    their number, ``n_quarantined``."""
    counts = [
        df.agg(
            F.lit(name).alias("table"),
            F.count("*").alias("n_rows"),
            reduce(Column.__add__, [F.count(F.col(c)) for c in df.columns]).alias("n_values"),
        )
        for name, df in tables.items()
    ]
    found = reduce(DataFrame.unionByName, counts)
    if quarantine is None:
        return found
    refused = found.sparkSession.read.parquet(quarantine).groupBy("table").agg(F.count("*").alias("n_quarantined"))
    return found.join(refused, "table", "left").fillna(0, ["n_quarantined"])


def key_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """``table, null_keys, repeated_keys``: both must be 0 for the operators to be exact."""
    checks = []
    for name, key in UNIQUE_KEYS.items():
        per_key = tables[name].groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"))
        present = F.col("key").isNotNull()
        checks.append(
            per_key.agg(
                F.lit(name).alias("table"),
                F.coalesce(F.sum(F.when(~present, F.col("n"))), F.lit(0)).alias("null_keys"),
                F.count_if(present & (F.col("n") > 1)).alias("repeated_keys"),
            )
        )
    return reduce(DataFrame.unionByName, checks)
