"""Exact top-k inner products by the threshold algorithm over sorted lists, one for each dimension and end."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import cut

#: Candidates of a cell, whose lists a task holds and all queries pass by: at most, and at least while tasks are to spare.
CELL_ROWS, LEAST_ROWS = 1 << 17, 1 << 12
#: The share of a cell's rows after which a query that can't stop yet reads the rest at once, as they come.
REST_AFTER = 1 / 2
#: Depth of the lists that is read first; it doubles each round.
FIRST_DEPTH = 8


def finite(vector: Column) -> Column:
    """True for a vector that is neither null nor holds nulls, NaNs or infinities."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def _better(score: np.ndarray, number: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores, ties to the smaller number."""
    if len(score) > 4 * k:
        some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        some = np.arange(len(score))
    return some[np.lexsort((number[some], -score[some]))[:k]]


class Lists:
    """A cell's rows by number, and for each dimension the list of them by rising component."""

    def __init__(self, rows: np.ndarray, row_id: np.ndarray):
        small = np.abs(rows).max(initial=0) ** 2 * rows.shape[1] < 2**22  # sums of products of whole numbers, exact in 32 bits
        rows = rows.astype(np.float32) if small else rows
        self.rows, self.row_id = rows, row_id
        self.order = np.argsort(rows, axis=0, kind="stable").T.astype(np.int32).copy()
        self.value = np.take_along_axis(rows.T, self.order, axis=1)
        self.seen = np.zeros(len(rows), np.int64)  # the last query that scored each row
        self.turn = 0

    def top_k(self, query: np.ndarray, query_id: int, k: int, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray, int]:
        """(row numbers, scores, rows read) of the k best rows for a query other than itself, ties to the smaller id;
        rows under `floor`, the kth score of other cells, may be left out.

        Where the query's weight is positive it reads a dimension's list from the greatest component down, where it is
        negative from the least up, and lists of weight 0 not at all. All its lists are read in step, to a depth that
        doubles; a row is scored in full when it is first seen. A row not yet seen can score no more than the sum of
        the weights times the components at that depth. Once that is less than the kth score, or than `floor`, the
        query stops; an equal bound goes on, as ties may be due. A query that has read REST_AFTER of the rows and may
        not stop scores all that are left in one pass, which costs less than more rounds.
        """
        if np.abs(query).max(initial=0) * np.abs(self.value).max(initial=0) * len(query) < 2**22:
            query = query.astype(self.rows.dtype)
        n, read, depth, begin = len(self.rows), 0, FIRST_DEPTH, 0
        self.turn += 1
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        best, score = np.zeros(0, np.int64), np.zeros(0)
        if not len(up) and not len(down):  # every row scores 0
            best = np.lexsort((self.row_id,))[: k + 1]
            best = best[self.row_id[best] != query_id][:k]
            return best, np.zeros(len(best)), len(best)
        while begin < n:
            end = min(depth, n)
            if read > n * REST_AFTER:
                found, end = np.flatnonzero(self.seen != self.turn), n
            else:
                found = np.concatenate((self.order[up, n - end : n - begin].ravel(), self.order[down, begin:end].ravel()))
                found = np.unique(found[self.seen[found] != self.turn])
            self.seen[found] = self.turn
            read += len(found)
            got = (self.rows[found] @ query).astype(np.float64)
            some = (got >= max(floor, score[-1] if len(score) == k else -np.inf)) & (self.row_id[found] != query_id)
            best, score = np.concatenate((best, found[some])), np.concatenate((score, got[some]))
            keep = _better(score, self.row_id[best], k)
            best, score = best[keep], score[keep]
            bound = float(query[up] @ self.value[up, n - end] + query[down] @ self.value[down, end - 1])
            if bound < max(floor, score[-1] if len(score) == k else -np.inf) or read == n:
                break
            begin, depth = end, depth * 2
        return best, score, read


def _vectors(ids: pa.Array, column: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray]:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors differ in length")
    return ids.to_numpy(), np.floor(scale * flat.reshape(len(ids), -1))


def _passed(dealt: DataFrame, k: int, scale: float) -> DataFrame:
    """dealt(cell, asks, id, floor, v), by cell with its candidates first -> (query_id, vec_id, score, read).

    A task builds a cell's lists once and then lets the queries pass by, a batch at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, lists, most = None, [], None, 0.0
        for batch in batches:
            cells, asks = batch.column("cell").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((cells[1:] != cells[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), batch.num_rows]
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                if begin == end:
                    continue
                part = batch.slice(begin, end - begin)
                if cells[begin] != cell:
                    cell, held, lists = cells[begin], [], None
                ids, x = _vectors(part.column("id"), part.column("v"), scale)
                if not asks[begin]:
                    held.append((ids, x))
                    continue
                if not held:
                    continue
                if lists is None:
                    rows = np.concatenate([r for _, r in held])
                    lists, most, held = Lists(rows, np.concatenate([i for i, _ in held])), np.abs(rows).max(), [None]
                if lists.rows.shape[1] != x.shape[1]:
                    raise ValueError("vectors differ in length")
                if most * np.abs(x).max() * x.shape[1] >= 2**53:
                    raise ValueError("inner products are too large to be exact")
                floor = part.column("floor").to_numpy()
                found = [lists.top_k(x[i], ids[i], k, floor[i]) for i in range(len(ids))]
                size = [len(f[0]) for f in found]
                columns = (np.repeat(ids, size), np.concatenate([lists.row_id[f[0]] for f in found]), np.concatenate([f[1] for f in found]).astype(np.int64), np.repeat([f[2] for f in found], size))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score", "read"])

    spread = dealt.repartition("cell").sortWithinPartitions("cell", "asks")
    return spread.mapInArrow(run, "query_id long, vec_id long, score long, read long")


def _ranked(met: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k(df: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 64.0, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where is_query, the k rows (all, if fewer) of highest inner
    product of components floor(scale * x), ties to the smaller vec_id; the row's own id is left out.

    Candidates are dealt to cells by a hash of their id, each once; a cell's lists are sorted once and all queries pass
    by them. First each query passes by one cell, and its kth score there is the floor that it carries to the others,
    which then stop as soon as nothing above it can come. The cells' results, k for each query and cell at the most,
    are ranked again. Vectors that are null, empty or hold nulls, NaNs or infinities take no part, nor do rows with
    a null id. Vectors must be of one length, and sums of products below 2**53, which is checked. Rows that
    repeat an id are candidates each, and as queries give their results once. Extra columns aren't looked at.
    An empty table gives an empty one.
    """
    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v"), is_query.alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & finite(F.col("v")))
    n = rows.count()
    cells = max(1, -(-n // cell_rows), min(df.sparkSession.sparkContext.defaultParallelism, -(-n // LEAST_ROWS)))
    cell = lambda seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(cells)).cast("int")
    candidates = rows.select(cell(0).alias("cell"), F.lit(False).alias("asks"), "id", F.lit(float("-inf")).alias("floor"), "v")
    asked = rows.where("asks").dropDuplicates(["id"]).select("id", "v", cell(1).alias("first"))
    begun = asked.select(F.col("first").alias("cell"), F.lit(True).alias("asks"), "id", F.lit(float("-inf")).alias("floor"), "v")
    met = _passed(candidates.union(begun), k, scale)
    if cells > 1:
        met = cut(met)
        floor = _ranked(met, k).groupBy(F.col("query_id").alias("id")).agg(F.max(F.when(F.col("rank") == k, F.col("score").cast("double"))).alias("floor"))
        carried = asked.join(floor, "id", "left").withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))).where("cell <> first")
        met = met.union(_passed(candidates.union(carried.select("cell", F.lit(True).alias("asks"), "id", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"), "v")), k, scale))
    return _ranked(met, k).select("query_id", "rank", "vec_id", "score")


#: The same result in DuckDB SQL.
ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
           FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
