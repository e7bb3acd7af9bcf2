"""What the operators share: tables in the shared folder, word positions in UTF-8 text."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import checkpoint_dir, sized, swept

#: Bytes that part words: space, tab, line feed, vertical tab, form feed, carriage return.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: The same as a Java and Python regular expression of one word.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that the array code takes at once, whatever a batch of rows holds.
CHUNK_BYTES = 1 << 19

_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SEPARATORS)] = False


def cut(df: DataFrame) -> DataFrame:
    """df by way of a checkpoint in the shared folder, so that no executor's loss undoes it."""
    checkpoint_dir(df.sparkSession)
    with swept(df.sparkSession):
        return sized(df.select("*").checkpoint(eager=True))  # a plan of its own: df's was made with the setting as it was then


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again; it goes with done(), or when the session ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/prismara-{name}-{uuid.uuid4().hex}"
    where, system = _place(df, path)
    system.deleteOnExit(where)
    with swept(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def _place(df: DataFrame, path: str) -> tuple:
    context = df.sparkSession.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(context._jsc.hadoopConfiguration())


def done(*tables: DataFrame) -> None:
    """Deletes shared tables that nothing will read again."""
    for df in tables:
        if path := vars(df).pop("_shared_path", None):
            where, system = _place(df, path)
            system.delete(where, True)


def kept(keep: Iterable[str], *made: str) -> list[str]:
    """The columns to keep but for those that new ones of the same name replace."""
    taken = {x.lower() for x in made}
    return [x for x in keep if x.lower() not in taken]


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for columns that df hasn't, whatever it has."""
    there = {x.lower() for x in df.columns}
    mark = "_"
    while any(f"{mark}{x}".lower() in there for x in names):
        mark += "_"
    return [f"{mark}{x}" for x in names]


#: A key with this share of a table's rows, or more, is hot.
HOT = 1 << 11


def join_hot(rows: DataFrame, facts: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined with facts, which has a row for each key at most, where a few keys may hold many of the rows.

    Keys with one row in HOT or more, HOT at the most, meet their facts by broadcast; the rest by a join that
    deals rows by key. Pass settled rows and facts: both are read twice.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    least = max(1000, rows.count() // HOT)
    hot = cut(counts.where(F.col("_n") >= least).select(key))
    calm = rows.join(F.broadcast(hot), key, "left_anti").join(facts, key, how)
    warm = rows.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(facts.join(F.broadcast(hot), key, "left_semi")), key, how)
    return calm.unionByName(warm)


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """The texts as UTF-8 (null: empty) in runs of about limit bytes, each with its first row's number."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    raw = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()).to_pylist()
    first, held, run = 0, 0, []
    for i, x in enumerate(raw):
        if run and held + len(x or b"") > limit:
            yield first, run
            first, held, run = i, 0, []
        run.append(x or b"")
        held += len(run[-1])
    if run:
        yield first, run


class Words:
    """The words of a run of texts by position in one buffer, where a space follows every text.

    start, end: of each word in data; first: number of each text's first word, with the total at its end.
    """

    def __init__(self, texts: list[bytes]):
        self.raw = b" ".join(texts) + b" "
        self.data = np.frombuffer(self.raw, np.uint8)
        inside = _IS_WORD[self.data]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[::2], edge[1::2]
        ends = np.cumsum(np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts)))
        self.first = np.concatenate(([0], np.searchsorted(self.start, ends)))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes; equal words have equal hashes."""
        return mix(_poly(self.data, self.start, self.end))


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(kind: str, n: int) -> np.ndarray:
    """The first n powers of the base, or of its inverse modulo 2**64."""
    if len(_POWERS[kind]) < n:
        size = max(n, CHUNK_BYTES + (1 << 16))
        base = np.uint64(_BASE if kind == "up" else pow(_BASE, -1, 1 << 64))
        _POWERS[kind] = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, base))))
        if size > 8 * CHUNK_BYTES:  # don't keep what one very long text needed
            return _POWERS.update({kind: _POWERS[kind][:CHUNK_BYTES].copy()}) or np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, base))))
    return _POWERS[kind][:n]


def _poly(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers("up", len(data)), out=sums[1:])
    return (sums[end] - sums[start]) * _powers("down", len(data) + 1)[start]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values: the finishing steps of the splitmix64 generator."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The positions start[0], start[0]+1, ... of every run, one run after the other."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = start - np.concatenate(([0], np.cumsum(length)[:-1]))
    return np.arange(total) + np.repeat(shift, length)
