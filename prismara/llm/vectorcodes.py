"""Compression of vectors to codes: a codebook for each part of a vector, the nearest entry found by annular norm pruning."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import cut, ragged, shared_table

#: Largest whole component; squared distances of vectors of up to 8,192 of them then fit a long.
MOST = 1 << 24
#: Labels whose sums are broadcast: up to 65,536 rows of two numbers.
FEW = 1 << 16


class Codebook:
    """The entries of one part, sorted by norm."""

    def __init__(self, entries: np.ndarray):
        """entries: a row of whole components each, by index."""
        self.entries = entries
        norms = np.sqrt((entries * entries).sum(axis=1).astype(np.float64))
        self.order = np.argsort(norms, kind="stable")
        self.norms = norms[self.order]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each row, the least index where several are.

        |x| and |e| differ by no more than the distance of x and e. So the entries on either side of |x| give a first
        distance, and only those in the annulus it allows, its edges included, are measured; distances are whole
        numbers, and the edges are moved out by more than the rounding of a norm.
        """
        if not len(x):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        last = len(self.order) - 1
        norm = np.sqrt((x * x).sum(axis=1).astype(np.float64))
        at = np.searchsorted(self.norms, norm)
        best = np.minimum(*(self._squared(x, self.order[np.clip(at + i, 0, last)]) for i in (-1, 0)))
        reach = np.sqrt(best.astype(np.float64))
        slack = 1e-6 + 1e-9 * (norm + reach)
        first, end = np.searchsorted(self.norms, norm - reach - slack), np.searchsorted(self.norms, norm + reach + slack, "right")
        size = end - first
        entry = self.order[ragged(first, size)]
        squared = self._squared(np.repeat(x, size, axis=0), entry)
        begin = np.cumsum(size) - size
        least = np.minimum.reduceat(squared, begin)
        return np.minimum.reduceat(np.where(squared == np.repeat(least, size), entry, len(self.entries)), begin), least

    def _squared(self, x: np.ndarray, entry: np.ndarray) -> np.ndarray:
        away = x - self.entries[entry]
        return (away * away).sum(axis=1)


def _matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that aren't null, their components)."""
    some = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    return some, column.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).reshape(len(some), size)


def _seeds(vectors: DataFrame, entries: int) -> list[list[int]]:
    """The vectors of the least ids, ascending; of an id with several the least vector."""
    ids = vectors.where("_id IS NOT NULL AND _v IS NOT NULL").select("_id").distinct().orderBy("_id").limit(entries)
    few = F.broadcast(ids)  # `entries` rows at most
    return [r["v"] for r in vectors.where("_v IS NOT NULL").join(few, "_id", "left_semi").groupBy("_id").agg(F.min("_v").alias("v")).orderBy("_id").collect()]


def _moved(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """books after each entry with parts is replaced by their componentwise floored mean.

    Each task hands on one row of sums for each component of an entry, so what is shuffled, and what the driver gets,
    is bounded by the codebooks' size and not by the vectors'.
    """
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Codebook(b) for b in books]
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            _, x = _matrix(batch.column("_v"), parts * width)
            for p in range(parts):
                part = x[:, p * width : (p + 1) * width]
                at, _ = own[p].nearest(part)
                count[p] += np.bincount(at, minlength=entries)
                np.add.at(total[p], at, part)
        used = np.repeat(count.ravel() > 0, width)
        columns = (np.flatnonzero(used), np.repeat(count.ravel(), width)[used], total.ravel()[used])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["place", "n", "total"])

    sums = vectors.where("_v IS NOT NULL").select("_v").mapInArrow(run, "place long, n long, total long")
    out = books.copy().ravel()
    for r in sums.groupBy("place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        out[r["place"]] = r["total"] // r["n"]
    return out.reshape(books.shape)


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def train(vectors: DataFrame, parts: int, entries: int, rounds: int) -> np.ndarray:
    """The codebooks (part, entry, position) of vectors(_id, _v) after the rounds; a part of the given size of each vector."""
    seeds = np.array(_seeds(vectors, entries), np.int64)
    width = seeds.shape[1] // parts if len(seeds) else 0
    books = seeds.reshape(len(seeds), parts, width).transpose(1, 0, 2).copy()
    for _ in range(rounds if len(seeds) else 0):
        books = _moved(vectors, books)
    return books


def compress(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each vector that is neither null nor holds a component that is
    null or isn't finite; such rows go. Components become floor(scale * x).

    Codebooks start from the vectors of the `entries` least ids (of an id with several rows its least vector; a null id
    starts none; fewer ids make smaller codebooks), take `rounds` rounds over all vectors, and then code them all. The
    size of a vector is that of the least id's one; a vector of another size, one that doesn't fall into equal parts, or
    one with a whole component over MOST has no code: it stays, with null code and error, and moves no entry. label_error
    is the error of all rows of an equal label, null being one. Repeated rows count, and come out, as often as they are
    there. An empty table gives an empty one. Other columns aren't looked at, whatever they are called.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hexadecimal digits for each part")
    whole = lambda x: F.floor(x.cast("double") * scale)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    named = df.where(finite).select(F.col(vec_id).alias("_id"), F.col(label).alias("_label"), F.transform(vector, whole).alias("_v"))
    fit = (F.size("_v") > 0) & (F.size("_v") % parts == 0) & F.forall("_v", lambda x: F.abs(x) <= MOST)
    vectors = named.withColumn("_v", F.when(fit, F.col("_v")))
    first = vectors.where("_id IS NOT NULL AND _v IS NOT NULL").agg(F.min(F.struct("_id", "_v")).alias("m")).select(F.size("m._v")).first()[0]
    size = first if first and first > 0 else parts
    vectors = vectors.withColumn("_v", F.when(F.size("_v") == size, F.col("_v")))
    books = train(vectors, parts, entries, rounds)
    width = books.shape[2]
    kind = vectors.schema["_id"].dataType.simpleString(), vectors.schema["_label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Codebook(b) for b in books]
        for batch in batches:
            some, x = _matrix(batch.column("_v"), parts * width) if books.size else (np.zeros(0, np.int64), None)
            codes, error = np.empty((len(some), parts), np.uint8), np.zeros(len(some), np.int64)
            for p in range(parts if len(some) else 0):
                codes[:, p], squared = own[p].nearest(x[:, p * width : (p + 1) * width])
                error += squared
            text: list = [None] * batch.num_rows
            lost: list = [None] * batch.num_rows
            for i, code, e in zip(some.tolist(), codes, error.tolist(), strict=True):
                text[i], lost[i] = code.tobytes().hex(), e
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_label"), pa.array(text, pa.string()), pa.array(lost, pa.int64())], ["vec_id", "label", "code", "error"])

    coded = shared_table(vectors.mapInArrow(run, f"vec_id {kind[0]}, label {kind[1]}, code string, error long"), "codes")
    sums = cut(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"))
    sums = F.broadcast(sums) if sums.count() <= FEW else sums
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql(parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> str:
    nearest = lambda c: f"SELECT vec_id, label, part, x, min(d) AS d, arg_min(e, d * {entries} + e) AS e FROM (SELECT p.vec_id, p.label, p.part, p.x, c.e, list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN {c} c USING (part)) GROUP BY ALL"
    out = f"""WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {scale}) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, label, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS x FROM k, (SELECT unnest(range({parts})) AS part)),
c0 AS (SELECT part, e, x FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM (SELECT vec_id FROM k ORDER BY vec_id LIMIT {entries})) USING (vec_id))"""
    for i in range(rounds):
        out += f""",
a{i} AS ({nearest(f"c{i}")}),
m{i} AS (SELECT part, e, list(y ORDER BY pos) AS y FROM (SELECT part, e, pos, CAST(floor(sum(v) / count(*)) AS BIGINT) AS y FROM (SELECT part, e, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM a{i}) GROUP BY part, e, pos) GROUP BY part, e),
c{i + 1} AS (SELECT c.part, c.e, coalesce(m.y, c.x) AS x FROM c{i} c LEFT JOIN m{i} m ON m.part = c.part AND m.e = c.e)"""
    return out + f""",
f AS ({nearest(f"c{rounds}")}),
g AS (SELECT vec_id, label, string_agg(lower(printf('%02x', CAST(e AS INT))), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM f GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, e)) FROM c{rounds}) AS codebooks_sha256 FROM g"""


ORACLE = _sql()
