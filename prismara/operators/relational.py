"""Relational patterns that the plans share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_n_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first n rows of each key by order. As row_number <= n, so that Spark cuts groups before it shuffles them."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def latest_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by order."""
    return top_n_per(df, keys, order, 1)


def after(columns: Sequence[tuple[Column, object, bool]]) -> Column:
    """Rows past a position in an order: for each column (expression, its value there, whether it falls). Nulls are the
    least value: last where it falls and first where it rises."""
    out = F.lit(False)
    for column, value, falls in reversed(columns):
        if value is None:
            past = F.lit(False) if falls else column.isNotNull()
        else:
            past = F.coalesce(column < F.lit(value), F.lit(True)) if falls else F.coalesce(column > F.lit(value), F.lit(False))
        out = past | (column.eqNullSafe(F.lit(value)) & out)
    return out


def values(spark: SparkSession, schema: str, rows: Sequence[tuple]) -> DataFrame:
    """Inline rows as a relation, such as a list of vectors or of ranks to join with."""
    return spark.createDataFrame(list(rows), schema)


def changed(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """Any pair that differs, null being a value of its own."""
    out = F.lit(False)
    for a, b in zip(left, right, strict=True):
        out = out | ~a.eqNullSafe(b)
    return out


def replace_slice(df: DataFrame, fresh: DataFrame, old: Column) -> DataFrame:
    """df without the rows that `old` is true of, and with the rows of fresh."""
    return df.where(~F.coalesce(old, F.lit(False))).unionByName(fresh)
