"""Directory scans: which media files a volume holds."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import media
from ..functions.hashing import QUICK_BYTES
from ..operators.lineage import settled

_FOUND = "path string, is_dir boolean, size_bytes long, mtime timestamp"


class VolumeOffline(Exception):
    """The mount isn't there, so nothing may be marked missing."""


def _list(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What lies in each directory, links left out; a directory that is gone meanwhile is empty."""
    for batch in batches:
        for path in batch["path"]:
            rows = []
            try:
                with os.scandir(path) as entries:
                    for x in entries:
                        if x.is_dir(follow_symlinks=False) or x.is_file(follow_symlinks=False):
                            at = x.stat(follow_symlinks=False)
                            rows.append((x.path, x.is_dir(follow_symlinks=False), at.st_size, pd.Timestamp(at.st_mtime_ns // 1000, unit="us")))
            except FileNotFoundError:
                pass
            for i in range(0, len(rows), 50_000):
                yield pd.DataFrame(rows[i : i + 50_000], columns=["path", "is_dir", "size_bytes", "mtime"])


def _hashes(path: str) -> tuple[str, str]:
    """(sha256, quick_hash) of a file, read in pieces."""
    whole, size = hashlib.sha256(), os.stat(path).st_size
    quick = hashlib.sha256(size.to_bytes(8, "little"))
    with open(path, "rb") as file:
        quick.update(file.read(QUICK_BYTES))
        if size > QUICK_BYTES:
            file.seek(-QUICK_BYTES, os.SEEK_END)
            quick.update(file.read(QUICK_BYTES))
        file.seek(0)
        while piece := file.read(1 << 20):
            whole.update(piece)
    return whole.hexdigest(), quick.hexdigest()


def with_hashes(df: DataFrame, path: str = "abs_path") -> DataFrame:
    """df with sha256 and quick_hash of the files at `path`, which tasks read in pieces; null for a file that is gone."""
    schema = df.select("*").schema.add("sha256", "string").add("quick_hash", "string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for x in batch[path]:
                try:
                    made.append(_hashes(x))
                except FileNotFoundError:
                    made.append((None, None))
            batch[["sha256", "quick_hash"]] = pd.DataFrame(made, columns=["sha256", "quick_hash"], index=batch.index, dtype=object)
            yield batch

    return df.mapInPandas(run, schema)


def scan_volume(spark: SparkSession, mount: str, volume_id: int, hashes: bool = False) -> DataFrame:
    """The media files under mount: volume_id, abs_path, parent_path, file_name, extension, media_type, size_bytes, mtime.

    Tasks list directories, a level of the tree at a time, so the driver holds no paths; the mount has to be there
    on every executor. Content is read only for hashes (sha256, quick_hash). Raises VolumeOffline before any row
    if mount is no directory.
    """
    root = unquote(mount.removeprefix("file://")).rstrip("/") or "/"
    if not os.path.isdir(root):
        raise VolumeOffline(mount)
    level, found = spark.createDataFrame([(root,)], "path string"), None
    while True:
        listed = settled(level.repartition(spark.sparkContext.defaultParallelism, "path").mapInPandas(_list, _FOUND))
        files = listed.where("NOT is_dir")
        found = files if found is None else found.unionByName(files)
        level = listed.where("is_dir").select("path")
        if level.isEmpty():
            break
    name = F.element_at(F.split("path", "/"), -1)
    found = found.select(
        F.lit(volume_id).cast("long").alias("volume_id"), F.col("path").alias("abs_path"), F.regexp_replace("path", r"/[^/]*$", "").alias("parent_path"), name.alias("file_name"),
        F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("extension"), "size_bytes", "mtime",
    )
    found = found.withColumn("media_type", media.media_type(F.col("extension"))).where("media_type IS NOT NULL")
    return with_hashes(found) if hashes else found
