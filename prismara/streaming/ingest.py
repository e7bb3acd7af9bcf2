"""Scans and job events as streams (an extension: the same relations over micro-batches)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.catalog import Tables, load, save


def scan_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Scan rows as they arrive as Parquet files under path."""
    return spark.readStream.schema(schema).parquet(path)


def merge_batches(stream: DataFrame, merge: Callable[[Tables, DataFrame], tuple[DataFrame, DataFrame]], library: str, checkpoint: str, names: tuple[str, str] = ("files", "file_path_history")) -> StreamingQuery:
    """Every micro-batch merged into the library's tables, each batch into a version of its own and then made current."""

    def apply(batch: DataFrame, turn: int) -> None:
        made = merge(load(batch.sparkSession, library), batch)
        for name, df in zip(names, made, strict=True):
            save(df, f"{library}/_versions/{turn}", name)
        for name in names:
            save(batch.sparkSession.read.parquet(f"{library}/_versions/{turn}/{name}"), library, name)

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(apply).start()


def activity(events: DataFrame, at: str, kind: str, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(since, kind, events) in windows of event time; rows later than `late` are dropped in a stream."""
    windows = events.withWatermark(at, late).groupBy(F.window(at, every).alias("w"), F.col(kind).alias("kind"))
    return windows.agg(F.count("*").alias("events")).select(F.col("w.start").alias("since"), "kind", "events")
