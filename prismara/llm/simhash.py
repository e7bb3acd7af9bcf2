"""SimHash fingerprints of documents and the components of fingerprints that differ in few bits."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import Words, chunks, cut, kept, unused
from .components import connected_components

BITS = 64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER = _LOWER.tobytes()


def fingerprints(texts: list[bytes], shingle: int) -> np.ndarray:
    """The SimHash of each UTF-8 text: A-Z in lower case, words joined by one space, XXH64 (seed 42) of each
    run of `shingle` words (fewer words: of the whole sequence), a bit set where over half the hashes have it.
    """
    words = Words([x.translate(_LOWER) for x in texts])
    out = np.zeros(len(texts), np.uint64)
    if not len(words):
        return out
    # One space after each word, and nothing else between words.
    size = words.end - words.start
    at = np.concatenate(([0], np.cumsum(size + 1)))
    inside = np.zeros(len(words.data) + 1, np.int8)
    inside[words.start] = 1
    inside[words.end + 1] -= 1
    flat = np.where(np.cumsum(inside[:-1], dtype=np.int8) > 0, words.data, 0)
    joined = flat[flat != 0] if words.data.min() else _join(words)
    joined = joined.copy()
    joined[at[1:] - 1] = 32
    raw = joined.tobytes()
    number = np.diff(words.first)
    count = np.where(number >= shingle, number - shingle + 1, np.minimum(number, 1))
    has = np.flatnonzero(count)
    begin = np.concatenate([[0], np.cumsum(count[has])])
    w0 = np.repeat(words.first[:-1][has], count[has]) + np.arange(begin[-1]) - np.repeat(begin[:-1], count[has])
    w1 = np.minimum(w0 + shingle, np.repeat(words.first[1:][has], count[has]))
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(raw[s:e], 42) for s, e in zip(at[w0].tolist(), (at[w1] - 1).tolist(), strict=True)])
    bits = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    step = 1 << 17
    votes = np.zeros((len(has), BITS), np.int64)
    owner = np.repeat(np.arange(len(has)), count[has])
    for i in range(0, len(bits), step):
        block, own = np.unpackbits(bits[i : i + step], axis=1), owner[i : i + step]
        cuts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        votes[own[cuts]] += np.add.reduceat(block, cuts, axis=0, dtype=np.int32)
    on = 2 * votes > count[has][:, None]
    out[has] = np.packbits(on, axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def _join(words: Words) -> np.ndarray:
    """As the masked copy, for texts that hold the byte 0."""
    return np.frombuffer(b" ".join(words.raw[s:e] for s, e in zip(words.start, words.end, strict=True)) + b" ", np.uint8)


def with_fingerprint(df: DataFrame, text: str = "text", shingle: int = 4, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of every row, and `fp`: the signed long of its fingerprint. Null text: no words."""
    names = kept(keep, "fp")
    source = df.select(*names, F.col(text).alias(unused(df, "text")[0]))
    schema = df.select(*names).schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [fingerprints(x, shingle) for _, x in chunks(batch.column(len(names)))]
            fp = np.concatenate(got).view(np.int64) if got else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(fp)], [*names, "fp"])

    return source.mapInArrow(run, schema)


def _blocks(bits: list[int], parts: int, equal: int) -> list[int]:
    """Masks: the bits cut into parts, and every choice of `equal` of them."""
    cuts = [sum(1 << b for b in bits[len(bits) * i // parts : len(bits) * (i + 1) // parts]) for i in range(parts)]
    return [sum(x) for x in combinations(cuts, equal)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keys(fp: Column, masks: list[int]) -> Column:
    """A struct (mask, masked fingerprint) for each mask."""
    return F.array(*(F.struct(F.lit(_signed(m)).alias("mask"), fp.bitwiseAND(F.lit(_signed(m))).alias("part")) for m in masks))


def _local_links(fp: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links among fp: breadth-first, each step against those not yet reached."""
    rest = fp
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            x = frontier.pop()
            near = np.bitwise_count(rest ^ x) <= limit
            if near.any():
                found = rest[near]
                yield np.full(len(found), x), found
                frontier += list(found)
                rest = rest[~near]


def _links(keyed: DataFrame, limit: int) -> DataFrame:
    """(a, b) links that join what is within limit bits of one another among the rows (mask, part, fp) of a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        last = None

        def flush(group: list[np.ndarray], a: list, b: list) -> None:
            fp = np.concatenate(group)
            if len(fp) > 1:
                for x, y in _local_links(fp, limit):
                    a.append(x)
                    b.append(y)

        def made(a: list, b: list) -> Iterator[pa.RecordBatch]:
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            mask, part, fp = (batch.column(c).to_numpy() for c in ("mask", "part", "fp"))
            fp = fp.view(np.uint64)
            cuts = np.concatenate(([0], np.flatnonzero((mask[1:] != mask[:-1]) | (part[1:] != part[:-1])) + 1, [len(fp)]))
            a, b = [], []
            if last is not None and (mask[0], part[0]) != last:
                flush(held, a, b)
                held = []
            held.append(fp[: cuts[1]])
            if len(cuts) > 2:
                flush(held, a, b)
                many = np.flatnonzero(np.diff(cuts[1:-1]) > 1) + 1
                for i in many:
                    flush([fp[cuts[i] : cuts[i + 1]]], a, b)
                held = [fp[cuts[-2] :]]
            last = (mask[-1], part[-1])
            yield from made(a, b)
        if held:
            a, b = [], []
            flush(held, a, b)
            yield from made(a, b)

    dealt = keyed.repartition("mask", "part").sortWithinPartitions("mask", "part")
    return dealt.select("mask", "part", "fp").mapInArrow(run, "a long, b long")


def links(distinct: DataFrame, limit: int = 4, parts: int = 6, most: int = 50_000) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` that connect all pairs at most `limit` bits apart.

    Of `parts` blocks, such a pair has at least parts - limit in common (pigeonhole), so it meets under one
    choice of that many blocks. A block key with over `most` fingerprints isn't searched as it is: its
    members meet again under finer keys, by the same rule on the bits that the key leaves open, and once more;
    a key then leaves under 20 of 64 bits open. Within a key a spanning forest of the links is made and
    no pair is listed that it doesn't need, so a large group of near copies makes as many rows as it has members.
    """
    equal, spark = parts - limit, distinct.sparkSession
    masks = _blocks(list(range(BITS)), parts, equal)
    # A fingerprint is a few bytes and its keys are many: spread before they are made, or a few tasks hold them all.
    spread = distinct.select("fp").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = spread.select("fp", F.explode(_keys(F.col("fp"), masks)).alias("k")).select("k.mask", "k.part", "fp")
    out = None
    for _ in range(2):
        hot = cut(keyed.groupBy("mask", "part").count().where(F.col("count") > most).select("mask", "part"))
        found = [r["mask"] for r in hot.select("mask").distinct().collect()]  # some of the masks of this level, whose number is fixed
        if not found:
            break
        calm = _links(keyed.join(hot, ["mask", "part"], "left_anti"), limit)
        out = calm if out is None else out.union(calm)
        finer = [(m, _signed(m % (1 << 64) | x)) for m in found for x in _blocks([b for b in range(BITS) if not m >> b & 1], parts, equal)]
        finer = spark.createDataFrame(finer, "mask long, finer long")
        keyed = keyed.join(hot, ["mask", "part"], "left_semi").join(F.broadcast(finer), "mask")
        keyed = keyed.select(F.col("finer").alias("mask"), F.col("fp").bitwiseAND(F.col("finer")).alias("part"), "fp").distinct()
    last = _links(keyed, limit)
    return last if out is None else out.union(last)


def rows_of(df: DataFrame, stays: DataFrame, one: Column, two: Column) -> DataFrame:
    """A row of df for each of stays(k1, k2), the hashes `one` and `two` of a row; of several rows any one."""
    k1, k2, n = unused(df, "k1", "k2", "n")
    met = df.withColumn(k1, one).withColumn(k2, two).join(stays.select(F.col("k1").alias(k1), F.col("k2").alias(k2)), [k1, k2])
    return met.withColumn(n, F.row_number().over(W.partitionBy(k1, k2).orderBy(k1))).where(F.col(n) == 1).select(*df.columns)


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 4, limit: int = 4, parts: int = 6) -> DataFrame:
    """(doc_id, fp, component_id) for every row: component_id is the least doc_id that can be reached by links
    of at most `limit` differing bits between fingerprints, the row's own included.

    Null and empty texts have fingerprint zero and link like any other. Rows are taken as they are: repeated
    rows come out as often, a null doc_id stays null and is never a component's least id unless all are null.
    Other columns of df are not looked at. An empty table gives an empty one. Equal fingerprints count once in
    the search, so copies cost nothing there; what is dealt by fingerprint at the end is a plain join, whose
    large partitions Spark splits. Texts are read in runs of bounded size, a very long one by itself.
    """
    rows = cut(with_fingerprint(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", shingle))
    each = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    nodes = connected_components(links(each, limit, parts))
    named = each.join(nodes, each["fp"] == nodes["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = cut(named.join(least, "root").select("fp", "component_id"))
    return rows.join(of, "fp").select("doc_id", "fp", "component_id")
