"""An index of search documents and file names: postings with positions for full-text search, trigrams for substrings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import search
from ..sources.catalog import Tables

#: Buckets of tokens or trigrams, rows of a bucket's file at most, and characters of the texts that one task indexes, about.
BUCKETS, ROWS, CHARS = 16, 1 << 24, 1 << 24
#: The rarest trigrams of a search that candidates must have.
RAREST = 4
#: The columns that substrings are looked for in.
FIELDS = ("file_name", "abs_path", "document_text")
POSTINGS, TRIGRAMS = "token string, file_id long, positions array<int>", "field int, trigram long, files array<long>"


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file_id, text) in lower case to a row for each file and token."""
    for batch in batches:
        tokens, files, lists, size = [], [], [], [0]
        for file_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for token, at in search.positions(text or "").items():
                tokens.append(token)
                files.append(file_id)
                lists += at
                size.append(len(lists))
            if len(lists) >= 1 << 20:
                yield _posting_batch(tokens, files, lists, size)
                tokens, files, lists, size = [], [], [], [0]
        yield _posting_batch(tokens, files, lists, size)


def _posting_batch(tokens: list, files: list, lists: list, size: list) -> pa.RecordBatch:
    at = pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.array(lists, pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), pa.array(files, pa.int64()), at], ["token", "file_id", "positions"])


def trigrams_of(text: str) -> np.ndarray:
    """The distinct trigrams of a text as numbers: 21 bits for each character."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.unique(x[:-2] << 42 | x[1:-1] << 21 | x[2:]) if len(x) > 2 else np.zeros(0, np.int64)


def _trigrams(first: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(file_id, fields in lower case, from the first one on) to rows for each field and trigram, with a run of files each."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for field in range(first, first + batch.num_columns - 1):
                found, files, held = [], [], 0
                for file_id, text in zip(batch.column(0).to_pylist(), batch.column(1 + field - first).to_pylist(), strict=True):
                    found.append(trigrams_of(text or ""))
                    files.append((file_id, len(found[-1])))
                    held += len(found[-1])
                    if held >= 1 << 20:
                        yield _trigram_batch(field, found, files)
                        found, files, held = [], [], 0
                if held:
                    yield _trigram_batch(field, found, files)

    return rows


def _trigram_batch(field: int, found: list, files: list) -> pa.RecordBatch:
    keys = np.concatenate(found)
    ids = np.repeat(np.array([i for i, _ in files], np.int64), [n for _, n in files])
    order = np.argsort(keys, kind="stable")
    each, starts = np.unique(keys[order], return_index=True)
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(keys)).astype(np.int32)), pa.array(ids[order]))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(each), field, np.int32)), pa.array(each), lists], ["field", "trigram", "files"])


def _bucket(*key: str | Column) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int")


def _dealt(texts: DataFrame, *columns: str) -> DataFrame:
    """(file_id, columns in lower case), in tasks of about CHARS characters."""
    texts = texts.select("file_id", *(F.lower(F.coalesce(c, F.lit(""))).alias(c) for c in columns))
    size = texts.agg(F.sum(sum((F.length(c) for c in columns), F.lit(0).cast("long"))).alias("n")).first()["n"] or 0
    return texts.repartition(max(1, -(-size // CHARS)), "file_id")


def _save(rows: DataFrame, key: list[str], path: str) -> None:
    """Each task's rows by bucket of their key, sorted by it. An index is parted by texts, so its rows aren't shuffled, and a
    word that most texts have is a little of every task's work."""
    dealt = rows.withColumn("bucket", _bucket(*key)).sortWithinPartitions("bucket", *key)
    dealt.write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").option("maxRecordsPerFile", ROWS).parquet(path)


def build(t: Tables, path: str, postings: bool = True, trigrams: bool = True) -> SearchIndex:
    """Writes the index of all files, texts and names under a folder that executors share.

    Texts are read twice for each part, once for their size. Null texts are as empty; a file without a search document has
    names only; a null id is indexed like others and found as null.
    """
    spark = t["files"].sparkSession
    texts = t["search_documents"].select("file_id", "document_text")
    if postings:
        _save(_dealt(texts, "document_text").mapInArrow(_postings, POSTINGS), ["token"], f"{path}/postings")
        texts.select("file_id").write.mode("overwrite").parquet(f"{path}/documents")
    if trigrams:
        names = _dealt(t["files"].select(F.col("id").alias("file_id"), *FIELDS[:2]), *FIELDS[:2]).mapInArrow(_trigrams(0), TRIGRAMS)
        rows = names.union(_dealt(texts.where("file_id IS NOT NULL"), FIELDS[2]).mapInArrow(_trigrams(2), TRIGRAMS))
        _save(rows, ["field", "trigram"], f"{path}/trigrams")
    return SearchIndex(spark, path)


def _named(t: Tables) -> DataFrame:
    """(file_id, file_name, abs_path, document_text) of every file."""
    texts = t["search_documents"].select(F.col("file_id").alias("id"), "document_text")
    return t["files"].select("id", "file_name", "abs_path").join(texts, "id", "left").withColumnRenamed("id", "file_id")


def grams_of(part: str) -> list[int]:
    """The trigrams that what holds a part must have; none if it has no three plain characters in a row."""
    return sorted({int(x) for run in search.literals(part) for x in trigrams_of(run)})


def _holds(part: str) -> Column:
    return reduce(Column.__or__, (search.contains(F.col(c), part) for c in FIELDS))


def looked_at(t: Tables, part: str) -> DataFrame:
    """(file_id), once each, of files whose name, path or text holds a part, by looking at all; needs no index."""
    return _named(t).where(_holds(part)).select("file_id").distinct()


@dataclass
class SearchIndex:
    """An index that was built at a path."""

    spark: SparkSession
    path: str

    def _rows(self, name: str, schema: str, keys: list[tuple]) -> DataFrame:
        """The rows of some keys (name, value, ...): their buckets' folders, and of these the row groups that may have them."""
        df = self.spark.read.schema(f"{schema}, bucket int").parquet(f"{self.path}/{name}")
        columns = [x.split()[0] for x in schema.split(", ")][: len(keys[0])]
        buckets = {r[0] for r in self.spark.createDataFrame(keys, ", ".join(schema.split(", ")[: len(keys[0])])).select(_bucket(*columns)).collect()}  # of a query's words
        test = reduce(Column.__or__, (reduce(Column.__and__, (F.col(c) == v for c, v in zip(columns, key, strict=True))) for key in keys))
        if len(columns) == 1:
            test = F.col(columns[0]).isin(*(k[0] for k in keys))
        return df.where(F.col("bucket").isin(*buckets)).where(test).drop("bucket")

    def _counts(self, name: str, schema: str, keys: list[tuple], of: Column) -> dict[tuple, int]:
        """How many files each key has, by the sum of what its rows have; a key that isn't indexed isn't there."""
        kinds = [x.split()[0] for x in schema.split(", ")][: len(keys[0])]
        rows = self._rows(name, schema, keys).groupBy(*kinds).agg(F.sum(of).alias("n")).collect()  # a row for each word of a query
        return {tuple(r[: len(kinds)]): r["n"] for r in rows}

    def search(self, query: str) -> DataFrame:
        """(file_id), once each, of the documents that answer a web-style query; see functions.search.parse.

        Of each part the postings of the rarest needed term are read first and meet the next ones; a row of words holds
        where the positions of each, less its place, have one in common; what is ruled out leaves by an anti-join. A part
        that only rules out begins with all documents.
        """
        parts = search.parse(query)
        words = sorted({(w,) for part in parts for x in part for w in x.words})
        none = self.spark.createDataFrame([], "file_id long")
        if not words:
            return none
        files = self._counts("postings", POSTINGS, words, F.lit(1))
        found = [self._part(part, files) for part in parts]
        return reduce(DataFrame.union, [x for x in found if x is not None] or [none]).distinct()

    def _part(self, part: list[search.Term], files: dict[tuple, int]) -> DataFrame | None:
        least = lambda x: min(files.get((w,), 0) for w in x.words)
        needed = sorted((x for x in part if not x.minus), key=least)
        if any(least(x) == 0 for x in needed):
            return None
        if needed:
            out = self._term(needed[0], files)
            for x in needed[1:]:
                out = out.join(self._term(x, files), "file_id", "left_semi")
        else:
            out = self._documents()
        for x in part:
            if x.minus and least(x):
                out = out.join(self._term(x, files), "file_id", "left_anti")
        return out

    def _term(self, term: search.Term, files: dict[tuple, int]) -> DataFrame:
        places = sorted(enumerate(term.words), key=lambda x: files[x[1],])
        out = None
        for i, word in places:
            rows = self._rows("postings", POSTINGS, [(word,)])
            if len(places) == 1:
                return rows.select("file_id")
            own = rows.select("file_id", F.transform("positions", lambda p: p - i).alias("own"))
            out = own.withColumnRenamed("own", "at") if out is None else out.join(own, "file_id").select("file_id", F.array_intersect("at", "own").alias("at")).where(F.size("at") > 0)
        return out.select("file_id")

    def _documents(self) -> DataFrame:
        return self.spark.read.schema("file_id long").parquet(f"{self.path}/documents")

    def containing(self, t: Tables, part: str) -> DataFrame:
        """(file_id), once each, of files whose name, path or text holds a part, as ILIKE has it.

        Candidates of each field have the part's rarest trigrams; they are then looked at. A part without three plain
        characters in a row can't be narrowed, and all files are looked at.
        """
        grams = grams_of(part)
        if not grams:
            return looked_at(t, part)
        files = self._counts("trigrams", TRIGRAMS, [(f, g) for f in range(len(FIELDS)) for g in grams], F.size("files"))
        found = []
        for f in range(len(FIELDS)):
            if all((f, g) in files for g in grams):
                rarest = sorted(grams, key=lambda g: files[f, g])[:RAREST]
                own = self._rows("trigrams", TRIGRAMS, [(f, g) for g in rarest]).select(F.explode("files").alias("file_id"))
                found.append(own.groupBy("file_id").agg(F.count("*").alias("n")).where(F.col("n") == len(rarest)).select("file_id") if len(rarest) > 1 else own.select("file_id"))
        if not found:
            return self.spark.createDataFrame([], "file_id long")
        ids = reduce(DataFrame.union, found).distinct()
        # Texts are looked at by themselves, so they go no further.
        of = t["files"].select(F.col("id").alias("file_id"), *FIELDS[:2]).join(ids, "file_id", "left_semi")
        texts = t["search_documents"].select("file_id", FIELDS[2]).join(ids, "file_id", "left_semi").where(search.contains(F.col(FIELDS[2]), part))
        hits = of.where(reduce(Column.__or__, (search.contains(F.col(c), part) for c in FIELDS[:2]))).select("file_id")
        return hits.union(of.select("file_id").join(texts, "file_id", "left_semi")).distinct()

    def matching(self, t: Tables, query: str) -> DataFrame:
        """(file_id), once each, of what the list's search finds: by words, or by any of the three substrings."""
        known = t["files"].select(F.col("id").alias("file_id"))
        return known.join(self.search(query).union(self.containing(t, query)), "file_id", "left_semi")
