"""Named parquet tables of one folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def subset(spark: SparkSession, folder: str, name: str, **parts: str) -> DataFrame:
    """A table's rows of the given parts (column = value), which reach the scan: as folders where the table is partitioned by them.

    A value that occurs nowhere gives no rows; an unknown column is an error.
    """
    df = table(spark, folder, name)
    for column, value in parts.items():
        if column not in df.columns:
            raise ValueError(f"{name} has no column {column}")
        df = df.where(F.col(column) == value)
    return df


def configured(spark: SparkSession, folder: str, name: str, config: str | None = None) -> DataFrame:
    """A table that comes in configurations, each a folder ``name/config``; the one that is there if none is named."""
    path = f"{folder}/{name}"
    if config is None:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        have = [f.getPath().getName() for f in hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(hadoop) if f.isDirectory()]
        if len(have) != 1:
            raise ValueError(f"{name} has the configurations {sorted(have)}; name one")
        config = have[0]
    return spark.read.parquet(f"{path}/{config}")


def canonical(c: Column) -> Column:
    """One spelling of a source or language name: trimmed, lower case; blank becomes null."""
    t = F.lower(F.trim(c))
    return F.when(t != "", t)
