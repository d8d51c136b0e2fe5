"""Intermediate results in the shared folder of the cluster.

Results that are read repeatedly are written there as Parquet: computed once, safe from lost executors,
and later reads fetch only the columns and partitions they need. Everything an application writes lies in
one folder of its own, which ``clean`` removes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, else the session's warehouse, which executors share as well."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (folder or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def _own(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/marketlens/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str, folder: str | None = None) -> str:
    """A path of its own in ``folder``, or in the folder of this application."""
    return f"{(folder or _own(spark)).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table", partition_by: str | None = None, folder: str | None = None) -> DataFrame:
    """Writes ``df`` and reads it back; ``partition_by`` is a column to make a folder of each value."""
    path = new_path(df.sparkSession, name, folder)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(df.columns)


def drop(spark: SparkSession, path: str) -> None:
    """Deletes what was written to a path of ``new_path``, as soon as nothing reads it any more."""
    if not path.startswith(f"{_own(spark)}/"):
        raise ValueError(f"not written by this application: {path}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clean(spark: SparkSession) -> None:
    """Removes what this application has written. Tables that were materialized cannot be read after it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
