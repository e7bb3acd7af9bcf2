"""Pages of the file list from storage that is kept in the list's order: a cursor reads the rows around it, not the library."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import after
from .files import SORTS, _order, decode_cursor

#: Rows between two fences, and bytes of a row group, about; rows of a file.
FENCE, GROUP_BYTES, FILE = 1 << 10, 1 << 18, 1 << 20


@dataclass
class SortedFiles:
    """The files in the order of one sort: rows at path/rows, and at path/fences the key of every FENCE-th row of a file."""

    spark: SparkSession
    path: str
    sort: str

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def _within(self, low: list | None, high: list | None) -> DataFrame:
        """The rows past the position `low` and not past `high`; both reach the scan, which leaves out the row groups that
        lie elsewhere by the statistics of the first column."""
        keys, df = SORTS[self.sort], self.rows
        first, falls = keys[0]
        for at, past in ((low, True), (high, False)):
            if at is not None:
                test = after([(F.col(c), v, f) for (c, f), v in zip(keys, at, strict=True)])
                df = df.where(test if past else ~test)
                if at[0] is not None:  # the same for the first column alone, as a plain comparison
                    c, v = F.col(first), F.lit(at[0])
                    edge = (c <= v if falls else c >= v) if past else (c >= v if falls else c <= v)
                    # Nulls come last where a sort falls and first where it rises.
                    df = df.where(edge | c.isNull() if past == falls else edge)
        return df

    def page(self, cursor: str = "", limit: int = 20, where: Column | None = None) -> DataFrame:
        """The first `limit` rows past a cursor, in order; of those that `where` is true of.

        The fences past the cursor say how far to read for as many rows; where a filter leaves too few of these, twice as
        many fences are read the next time, and so on.
        """
        names = [c for c, _ in SORTS[self.sort]]
        at = [v for _, v, _ in decode_cursor(cursor, self.sort)] if cursor else None
        fences = self.spark.read.parquet(f"{self.path}/fences")
        if at is not None:
            fences = fences.where(after([(F.col(c), v, f) for (c, f), v in zip(SORTS[self.sort], at, strict=True)]))
        fences, wanted = fences.orderBy(*_order(self.sort)), 2 + limit // FENCE
        while True:
            next_ones = fences.limit(wanted).collect()  # a few keys
            high = [next_ones[-1][c] for c in names] if len(next_ones) == wanted else None
            found = self._within(at, high)
            found = (found.where(where) if where is not None else found).orderBy(*_order(self.sort)).limit(limit)
            if high is None or found.count() == limit:
                return found
            wanted *= 2


def build(files: DataFrame, path: str, sort: str = "updated_desc") -> SortedFiles:
    """Writes the files, with whatever columns they have, by ranges of a sort's key, sorted, in files of about FILE rows and
    small row groups. A sort by quality needs its `quality_key`."""
    order, names = _order(sort), [c for c, _ in SORTS[sort]]
    parts = max(1, -(-files.count() // FILE))
    ranged = files.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged.write.mode("overwrite").option("parquet.block.size", str(GROUP_BYTES)).option("parquet.page.size", str(GROUP_BYTES // 4)).parquet(f"{path}/rows")
    kinds = files.select(*names)

    def fence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            at = [i for i in range(batch.num_rows) if (seen + i) % FENCE == FENCE - 1]
            seen += batch.num_rows
            yield batch.take(pa.array(at, pa.int64()))

    ranged.select(*names).mapInArrow(fence, kinds.schema).write.mode("overwrite").parquet(f"{path}/fences")
    return SortedFiles(files.sparkSession, path, sort)


def scanned(df: DataFrame) -> int:
    """Rows that a query's scans of rows have put out when it ran, by Spark's own metrics."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found, stack = 0, [plan]
    while stack:
        node = stack.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            stack.append(node.executedPlan())
            continue
        if kind.endswith("QueryStageExec"):
            stack.append(node.plan())
            continue
        if kind == "FileSourceScanExec":
            found += node.metrics().apply("numOutputRows").value()
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
    return found
