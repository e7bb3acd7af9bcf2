"""A library's tables as Parquet directories."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from ..schema import TABLES

Tables = Mapping[str, DataFrame]


def load(spark: SparkSession, path: str) -> Tables:
    """Every table; one that isn't there is empty."""
    found: dict[str, DataFrame] = {}
    jvm = spark.sparkContext._jvm
    for name, schema in TABLES.items():
        where = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
        found[name] = spark.read.schema(schema).parquet(f"{path}/{name}") if there else spark.createDataFrame([], schema)
    return found


def save(df: DataFrame, path: str, name: str) -> None:
    """A new version of a table in the columns of its schema, beside what is there: readers of the old one finish."""
    columns = [x.strip().split()[0] for x in TABLES[name].split(", ")]
    df.select(*columns).write.mode("overwrite").parquet(f"{path}/{name}")


def views(tables: Tables) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
