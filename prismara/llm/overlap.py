"""Near duplicates by the Jaccard similarity of word shingles: SimHash blocks give the first candidates and a prefix
filter those that 64 bits can't tell; each link is verified."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from ._shared import _BASE, Words, chunks, cut, done, mix, ragged, shared_table
from .components import connected_components, extended

#: How many frequent shingles are put last, from one document in how many they are counted, and how often they occur there at least.
FREQUENT, ONE_IN, OFTEN = 200_000, 16, 3
#: Sets of a key that are held against one another, or against as many others, in one task.
BLOCK = 1 << 10
#: Sets of a key up to which it makes no star, as there are few pairs of them.
STARS = 1 << 3
#: Sets of a key up to which they meet by a join.
FEW = 1 << 5
#: Open keys of a set that are listed beside each of them, at most.
LISTED = 1 << 8


def shingle_sets(texts: list[bytes], shingle: int) -> list[np.ndarray]:
    """The sorted 64-bit hashes of each UTF-8 text's distinct runs of `shingle` words (fewer words: of the whole
    sequence), A-Z in lower case.
    """
    words = Words([x.translate(simhash._LOWER) for x in texts])
    hashes, base = words.hashes(), np.uint64(_BASE)
    runs = np.zeros(max(len(hashes) - shingle + 1, 0), np.uint64)
    for j in range(shingle if len(runs) else 0):
        runs = runs * base + hashes[j : j + len(runs)]
    runs, out = mix(runs), []
    for first, last in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if last - first >= shingle:
            out.append(np.unique(runs[first : last - shingle + 1]))
        else:
            whole = np.full(min(last - first, 1), last - first, np.uint64)
            for x in hashes[first:last]:
                whole = whole * base + x
            out.append(mix(whole))
    return out


def _name(hashes: np.ndarray) -> int:
    """One signed long for a set of hashes."""
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def _prefix(hashes: np.ndarray, frequent: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    """The first of a set's hashes, frequent ones last, of which any set as similar must hold one among its own first."""
    at = np.minimum(np.searchsorted(frequent["key"], hashes), max(len(frequent) - 1, 0))
    count = np.where(frequent["key"][at] == hashes, frequent["n"][at], 0) if len(frequent) else np.zeros(len(hashes), np.int64)
    least = -(-len(hashes) * similarity[0] // similarity[1])
    return hashes[np.lexsort((hashes, count))][: len(hashes) - least + 1]


def _frequent(texts: DataFrame, shingle: int) -> np.ndarray:
    """Shingles that are frequent in a part of the texts, sorted. They only set the order in which a set's shingles
    are taken, which the result doesn't depend on, as any order that all sets share finds the same pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in chunks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shingle_sets(x, shingle)).view(np.int64))], ["key"])

    part = texts.where(F.pmod(F.xxhash64("text"), F.lit(ONE_IN)) == 0).select("text").mapInArrow(run, "key long")
    # Settled first: of rows that are collected in an order, the driver would get as many from each partition.
    found = cut(part.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "key").limit(FREQUENT)).toArrow()
    out = np.zeros(len(found), [("key", np.uint64), ("n", np.int64)])
    out["key"] = found.column("key").to_numpy().view(np.uint64)
    out["n"] = found.column("n").to_numpy()
    return np.sort(out, order="key")


def _shared_keys(texts: DataFrame, shingle: int, similarity: tuple[int, int]) -> DataFrame:
    """(key, fp, n): the prefixes of the distinct sets, where two sets at least have the key; n is the set's size."""
    frequent = _frequent(texts, shingle)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = set()
            for _, x in chunks(batch.column("text")):
                keys, names, sizes = [np.zeros(0, np.uint64)], [], []
                for s in shingle_sets(x, shingle):
                    name = _name(s)
                    if len(s) and name not in seen:
                        seen.add(name)
                        keys.append(_prefix(s, frequent, similarity))
                        names.append(name)
                        sizes.append(len(s))
                times = [len(k) for k in keys[1:]]
                columns = (np.concatenate(keys).view(np.int64), np.repeat(np.array(names, np.int64), times), np.repeat(np.array(sizes, np.int64), times))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "fp", "n"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = np.stack([batch.column(c).to_numpy() for c in ("key", "fp", "n")])
            held = now if held is None else np.concatenate((held, now), axis=1)
            done = np.searchsorted(held[0], held[0, -1]) if held.shape[1] else 0  # the last key may go on
            yield _met(held[:, :done])
            held = held[:, done:]
        if held is not None:
            yield _met(held)

    dealt = texts.select("text").mapInArrow(spread, "key long, fp long, n long").repartition("key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(shared, "key long, fp long, n long")


def _met(rows: np.ndarray) -> pa.RecordBatch:
    """Of rows (key, fp, n) sorted by key and fp, each once, those whose key has several."""
    if rows.shape[1]:
        rows = rows[:, np.concatenate(([True], (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)))]
        same = rows[0, 1:] == rows[0, :-1]
        rows = rows[:, np.concatenate(([False], same)) | np.concatenate((same, [False]))]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in rows], ["key", "fp", "n"])


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(fp, hashes) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in chunks(batch.column("text")):
                found = shingle_sets(x, shingle)
                hashes = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(s) for s in found]))), pa.int32()), pa.array(np.concatenate(found).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([_name(s) for s in found], pa.int64()), hashes], ["fp", "hashes"])

    return texts.select("text").mapInArrow(run, "fp long, hashes array<long>")


def _named(texts: DataFrame, shingle: int, keep: list[str]) -> DataFrame:
    """The columns `keep` of every row, `fp`: the name of its set, and `sh`: its SimHash, both signed longs."""
    schema = texts.select(*keep).schema.add("fp", "long").add("sh", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, prints = [], [np.zeros(0, np.uint64)]
            for _, x in chunks(batch.column("text")):
                names += [_name(s) for s in shingle_sets(x, shingle)]
                prints.append(simhash.fingerprints(x, shingle))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(names, pa.int64()), pa.array(np.concatenate(prints).view(np.int64))], [*keep, "fp", "sh"])

    return texts.select(*keep, "text").mapInArrow(run, schema)


def simhash_pairs(each: DataFrame, limit: int, parts: int) -> DataFrame:
    """Pairs (a, b) of each(fp, sh), one row for each set, that SimHash brings together: sets of one fingerprint with one
    of them, and one of each of two fingerprints that its pigeonhole blocks link."""
    reps = cut(each.groupBy("sh").agg(F.min("fp").alias("rep")))
    same = each.join(reps, "sh").where("fp <> rep").select(F.least("fp", "rep").alias("a"), F.greatest("fp", "rep").alias("b"))
    met = simhash.links(reps.select(F.col("sh").alias("fp")), limit, parts)
    for x in "ab":
        met = met.join(reps.select(F.col("sh").alias(x), F.col("rep").alias(f"{x}_rep")), x)
    return same.union(met.select(F.least("a_rep", "b_rep").alias("a"), F.greatest("a_rep", "b_rep").alias("b"))).distinct()


def _possible(pairs: DataFrame, firsts: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) that may be as similar by what their prefixes (fp, n, keys) have in common: up to where the
    prefix that ends first ends, all that both sets share is in both, so only that set's other hashes can add to it.
    """
    one, two = (firsts.select(F.col("fp").alias(x), F.col("n").alias(f"{x}n"), F.col("keys").alias(f"{x}k")) for x in "ab")
    after = (F.expr(f"({x}n * {similarity[0]} + {similarity[1] - 1}) div {similarity[1]} - 1") for x in "ab")
    most = F.size(F.array_intersect("ak", "bk")) + F.greatest(*after)
    return pairs.join(one, "a").join(two, "b").where(most * sum(similarity) >= (F.col("an") + F.col("bn")) * similarity[0]).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose sets are as similar."""
    met = pairs.join(sets.select(F.col("fp").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("fp").alias("b"), F.col("hashes").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    return met.where(both * sum(similarity) >= (F.size("x") + F.size("y")) * similarity[0]).select("a", "b")


def _cell(table: pa.Table, key: int, similarity: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (fp, root, n, i, keys, more) of a key's cell that may be as similar and that no lesser key brings together;
    of a cell of two blocks i only what is between them. Equal roots are connected already.

    Two sets of unlike roots share open keys only, so `keys` says how much their prefixes have in common, up to `more`
    that isn't listed; by that, and by their sizes, most pairs are ruled out for sure.
    """
    fp, root, n, part, more = (table.column(c).to_numpy() for c in ("fp", "root", "n", "i", "more"))
    lists = table.column("keys").combine_chunks()
    at, size = lists.offsets.to_numpy() - lists.offsets.to_numpy()[0], np.diff(lists.offsets.to_numpy())
    known, number = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    owner = np.repeat(np.arange(len(fp)), size)[np.argsort(number, kind="stable")]  # who has each key, by key
    times = np.bincount(number, minlength=len(known))
    begin = np.cumsum(times) - times
    here, after = int(np.searchsorted(known, key)), -(-n * similarity[0] // similarity[1]) - 1
    across = len(np.unique(part)) > 1
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for x in range(len(fp) - 1):
        own = number[at[x] : at[x + 1]]
        who, which = owner[ragged(begin[own], times[own])], np.repeat(own, times[own])
        both, least = np.bincount(who, minlength=len(fp)), np.full(len(fp), len(known))
        least[who[::-1]] = which[::-1]  # the least of a row's keys is put there last
        y = slice(x + 1, None)
        test = (root[y] != root[x]) & ((least[y] == here) | (least[y] == len(known)))  # no listed key in common: of a list that was cut
        test &= np.minimum(n[y], n[x]) * similarity[1] >= np.maximum(n[y], n[x]) * similarity[0]
        test &= (both[y] + more[y] + more[x] + np.maximum(after[y], after[x])) * sum(similarity) >= (n[y] + n[x]) * similarity[0]
        if across:
            test &= part[y] != part[x]
        near = np.flatnonzero(test) + x + 1
        found_a.append(np.full(len(near), fp[x]))
        found_b.append(fp[near])
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    return np.minimum(a, b), np.maximum(a, b)


def _candidates(rows: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of unlike roots that share a key of rows(key, fp, n, root) and that their prefixes don't rule out.

    Sets of a key that FEW have or less meet by a join, and of two such sets the keys that they share are counted: with those of
    the keys that more have, as many as the one that has fewer of these, that must do for the prefixes (see _possible). So
    no list of keys goes through this join. Sets of other keys are held against one another in tasks, BLOCK and BLOCK of them
    at a time, with each set's name, size and open keys, LISTED of them at most; a set with more is compared as if it
    shared what isn't listed.
    """
    counted = rows.join(rows.groupBy("key").agg(F.count("*").alias("many")), "key")
    c, (over, under) = F.col, similarity
    own = counted.groupBy("fp").agg(F.count_if(c("many") <= FEW).alias("few"), F.count_if(c("many") > FEW).alias("hot"))
    few = counted.where(c("many") <= FEW).join(own, "fp")
    one, two = (few.select(c("key").alias(f"{x}_key"), *(c(y).alias(f"{x}_{y}") for y in ("fp", "root", "n", "few", "hot"))) for x in "ab")
    after = F.expr(f"(greatest(a_n, b_n) * {over} + {under - 1}) div {under} - 1")
    least = F.expr(f"((a_n + b_n) * {over} + {over + under - 1}) div {over + under}") - after - F.least("a_hot", "b_hot")
    test = (c("a_fp") < c("b_fp")) & (c("a_root") != c("b_root")) & (F.least("a_n", "b_n") * under >= F.greatest("a_n", "b_n") * over)
    met = one.join(two, (c("a_key") == c("b_key")) & test & (least <= F.least("a_few", "b_few")))
    met = met.groupBy(c("a_fp").alias("a"), c("b_fp").alias("b"), least.alias("least")).agg(F.count("*").alias("both")).where(c("both") >= c("least")).select("a", "b")

    open_ = rows.groupBy("fp").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    open_ = open_.select("fp", F.slice("keys", 1, LISTED).alias("keys"), F.greatest(F.size("keys") - LISTED, F.lit(0)).cast("long").alias("more"))
    dealt = counted.where(c("many") > FEW).join(open_, "fp").withColumn("blocks", F.ceil(c("many") / BLOCK).cast("int")).withColumn("i", F.pmod(F.xxhash64("fp"), c("blocks")).cast("int"))
    dealt = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), c("blocks") - 1)))
    dealt = dealt.select("key", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "i", "fp", "n", "root", "keys", "more")

    def run(table: pa.Table) -> pa.Table:
        return pa.table(list(_cell(table, table.column("key")[0].as_py(), similarity)), names=["a", "b"])

    return met.union(dealt.groupBy("key", "lo", "hi").applyInArrow(run, "a long, b long")).distinct()


def components(shared: DataFrame, first: DataFrame, sets: Callable[[DataFrame], DataFrame], similarity: tuple[int, int]) -> DataFrame:
    """(node, root) of the sets that links between as similar ones connect, among the rows (key, fp, n), settled;
    first: pairs (a, b) to begin with, those of SimHash; sets gives (fp, hashes) for a column fp.

    After these, the sets of a key that more than STARS have meet one of them, the least by a hash of its name: near copies
    that share many keys so meet the same ones by most of them, and a large group makes few pairs for each of its rows. Of the sets that share a key and aren't connected yet,
    those pairs are verified that their prefixes don't rule out (see _candidates; these aren't held against the prefixes again).
    Links found later only join components: the links before them aren't walked again.
    """
    # Tables and not checkpoints, which hand on estimates of size that are multiplied in every join.
    firsts = shared_table(shared.groupBy("fp").agg(F.first("n").alias("n"), F.collect_list("key").alias("keys")), "firsts")
    made = [firsts]

    def table(df: DataFrame, name: str) -> DataFrame:
        made.append(shared_table(df, name))
        return made[-1]

    def fits(a: str, b: str) -> Column:
        return F.least(a, b) * similarity[1] >= F.greatest(a, b) * similarity[0]

    def near(pairs: DataFrame) -> DataFrame:
        return table(_verified(pairs, cut(sets(pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct())), similarity), "links")

    def open_keys(nodes: DataFrame) -> DataFrame:
        """(key, fp, n, root) of the keys whose sets aren't all connected."""
        placed = table(shared.join(nodes, shared["fp"] == nodes["node"], "left").select("key", "fp", "n", F.coalesce("root", "fp").alias("root")), "placed")
        parted = placed.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key")
        return placed.join(parted, "key", "left_semi")

    tried = table(first, "first")
    nodes = connected_components(near(table(_possible(tried, firsts, similarity), "pairs")))
    left = open_keys(nodes)
    middle = left.groupBy("key").agg(F.min(F.struct(F.xxhash64("fp").alias("h"), F.col("fp").alias("c"), F.col("n").alias("m"), F.col("root").alias("r"))).alias("o"), F.count("*").alias("many")).where(F.col("many") > STARS).select("key", "o.c", "o.m", "o.r")
    stars = left.join(middle, "key").where((F.col("root") != F.col("r")) & fits("n", "m")).select(F.least("fp", "c").alias("a"), F.greatest("fp", "c").alias("b"))
    stars = table(stars.distinct().join(tried, ["a", "b"], "left_anti"), "stars")
    nodes = extended(nodes, near(table(_possible(stars, firsts, similarity), "pairs")))
    left = table(open_keys(nodes).select("key", "fp", "n", "root"), "open")
    more = table(_candidates(left, similarity).join(tried.union(stars), ["a", "b"], "left_anti"), "more")
    nodes = extended(nodes, near(more))
    done(*made)
    return nodes


def deduplicate(df: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, similarity: tuple[int, int] = (4, 5), limit: int = 4, parts: int = 6) -> DataFrame:
    """One row of each component of near duplicates, with all its columns: the one with the least doc_id (null last),
    then the least hash of both. Two texts are linked if, and only if, their sets of shingles have the Jaccard
    similarity (numerator, denominator) or more.

    SimHash (see simhash.links) finds the close ones and holds large groups together. As 64 bits don't tell a similarity
    of 0.8 from 0.7, it is followed by a prefix filter: two sets as similar have a shingle in common among the first
    of each in any order, so no such pair is missed. Shingles and sets are compared by hashes of 64 bits.

    Null is as an empty text; texts without words are alike. Of rows alike in id and text any one stays. Texts are read
    in runs of bounded size, a very long one by itself. Other columns aren't looked at, whatever they are called. An
    empty table gives an empty one.
    """
    one, two = F.xxhash64(doc_id, text), F.xxhash64(F.lit(7), text, doc_id)
    texts = df.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), one.alias("k1"), two.alias("k2"))
    rows = _named(texts, shingle, ["id", "k1", "k2"])
    order = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2")).alias("m")
    each = shared_table(rows.groupBy("fp").agg(order, F.first("sh").alias("sh")), "sets")  # one row for each set: copies end here
    shared = shared_table(_shared_keys(texts, shingle, similarity), "prefixes")

    def sets(of: DataFrame) -> DataFrame:
        wanted = each.join(of, "fp", "left_semi").select("m.k1", "m.k2")
        return _sets(texts.join(wanted, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]), shingle)

    nodes = components(shared, simhash_pairs(each.select("fp", "sh"), limit, parts), sets, similarity)
    named = each.join(nodes, each["fp"] == nodes["node"], "left").select("m", F.coalesce("root", "fp").alias("root"))
    stays = cut(named.groupBy("root").agg(F.min("m").alias("m")).select("m.k1", "m.k2"))
    done(each, shared)
    return simhash.rows_of(df, stays, one, two)
