"""Removal of long word sequences that occur more than once, by FM-indexes over shards of candidate segments."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import HOT, Words, _powers, chunks, cut, done, mix, ragged, shared_table, unused
from .fmindex import FMIndex

#: Words of the sequence that chooses a window's shard.
ANCHOR = 8
#: Occurrences of an anchor above which its windows are dealt by more of their words: (occurrences, offsets that stay together).
FINER = ((256, 7), (65_536, 1))
#: Words in one index.
SHARD_WORDS = 1 << 19

_SPREAD = mix(np.arange(1, ANCHOR + 1, dtype=np.uint64)) | np.uint64(1)


def _anchors(hashes: np.ndarray) -> np.ndarray:
    """A hash of the ANCHOR words that begin at each word."""
    n = len(hashes) - ANCHOR + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(ANCHOR if n > 0 else 0):
        out += hashes[j : j + n] * _SPREAD[j]
    return mix(out)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while 2 * step <= width:
        x, step = np.minimum(x[:-step], x[step:]), 2 * step
    return np.minimum(x[: len(x) - (width - step)], x[width - step :]) if width > step else x


def _runs(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of successive windows of a text with the same least anchor: (text, first window's first word in the
    text, number of windows, anchor, 1 if the run holds the anchor more than once). A run has at most as many
    windows as a window has anchors."""
    offsets = window - ANCHOR + 1
    none = np.zeros(0, np.int64)
    if len(words) < window:
        return none, none, none, none, none
    anchors = _anchors(words.hashes())
    least = _sliding_min(anchors, offsets)
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    at = np.flatnonzero(text[: len(least)] == text[window - 1 :])
    if not len(at):
        return none, none, none, none, none
    least, text = least[at], text[at]
    new = np.concatenate(([True], (least[1:] != least[:-1]) | (text[1:] != text[:-1])))
    head = np.flatnonzero(new)
    place = np.arange(len(at)) - np.repeat(head, np.diff([*head, len(at)]))
    head = np.flatnonzero(place % offsets == 0)
    size = np.diff([*head, len(at)])
    held = size + offsets - 1
    same = anchors[ragged(at[head], held)] == np.repeat(least[head], held)
    twice = np.add.reduceat(same, np.cumsum(held) - held, dtype=np.int64) > 1
    return text[head], at[head] - words.first[text[head]], size, least[head].view(np.int64), twice.astype(np.int64)


def _profile(docs: DataFrame, window: int) -> DataFrame:
    """docs(doc_id, key, text) -> doc_id, key, n_words, sha (of all words), anchors, runs (first word * 64 + 32 if it holds its anchor again + windows - 1)."""
    schema = "doc_id long, key binary, n_words long, sha string, anchors array<long>, runs array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, sha, count, anchors, runs = [], [], [], [], []
            for _, texts in chunks(batch.column("text")):
                words = Words(texts)
                n_words.append(np.diff(words.first))
                sha += [hashlib.sha256(b" ".join(x.translate(_TO_SPACE).split())).hexdigest() for x in texts]
                text, first, size, anchor, twice = _runs(words, window)
                count.append(np.bincount(text, minlength=len(texts)))
                anchors.append(anchor)
                runs.append(first << 6 | twice << 5 | size - 1)
            at = pa.array(np.cumsum(np.concatenate([[0], *count])).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(x).astype(np.int64))) if x else pa.array([], pa.list_(pa.int64())) for x in (anchors, runs)]
            made = [pa.array(np.concatenate(n_words) if n_words else [], pa.int64()), pa.array(sha, pa.string()), *lists]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), *made], ["doc_id", "key", "n_words", "sha", "anchors", "runs"])

    return docs.select("doc_id", "key", "text").mapInArrow(run, schema)


#: Separators become spaces; bytes.split() alone would also part words at no other byte than these.
_TO_SPACE = bytes(0x20 if b in (9, 10, 11, 12, 13) else b for b in range(256))


def _segments(found: DataFrame, window: int) -> DataFrame:
    """found(key, n, text, hits) -> one row for each segment: key, n, first, route, cid and the segment's words.

    A segment is the words of successive windows that are dealt alike. Those of a frequent anchor are parted
    further by the anchor's offset in the window, and dealt by all the words that such windows share.
    """
    schema = "key binary, n long, first long, route long, cid binary, content binary"

    def parts(words: Words, hashes: np.ndarray, sums: np.ndarray, anchors: np.ndarray, base: int, first: int, size: int, anchor: int, width: int) -> Iterator[tuple[int, int, int]]:
        """(first window, windows, route) of the parts of a run."""
        if not width:
            yield first, size, anchor
            return
        begin = base + first
        where = np.flatnonzero(anchors[begin : begin + size + window - ANCHOR].view(np.int64) == anchor)
        k = np.arange(size)
        place = where[np.searchsorted(where, k)]  # of the leftmost anchor in each window
        share = (place - k) // width
        cuts = np.flatnonzero(np.concatenate(([True], (share[1:] != share[:-1]) | (place[1:] != place[:-1]))))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), size], strict=True):
            s = begin + int(place[a]) - int(share[a]) * width
            e = s + window - width + 1
            with np.errstate(over="ignore"):
                route = mix(np.array([(sums[e] - sums[s]) * _powers("down", s + 1)[s] + np.uint64(share[a])]))
            yield first + a, b - a, int(route.view(np.int64)[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, n, hits = batch.column("key").to_pylist(), batch.column("n").to_pylist(), batch.column("hits").to_pylist()
            for row, texts in chunks(batch.column("text")):
                words = Words(texts)
                hashes = words.hashes()
                anchors = _anchors(hashes)
                sums = np.zeros(len(hashes) + 1, np.uint64)
                np.cumsum(hashes * _powers("up", len(hashes)), out=sums[1:])
                start, end, raw = words.start, words.end, words.raw
                out: list[list] = [[], [], [], [], [], []]
                for i in range(len(texts)):
                    base = int(words.first[i])
                    for hit in hits[row + i]:
                        for first, size, route in parts(words, hashes, sums, anchors, base, hit["run"] >> 6, (hit["run"] & 31) + 1, hit["anchor"], hit["width"]):
                            a, b = base + first, base + first + size + window - 1
                            content = raw[start[a] : end[b - 1]].translate(_TO_SPACE)
                            if end[b - 1] - start[a] > (end[a:b] - start[a:b]).sum() + b - a - 1:
                                content = b" ".join(content.split())
                            cid = hashlib.blake2b(content, digest_size=16).digest()
                            for x, y in zip(out, (keys[row + i], n[row + i], first, route, cid, content), strict=True):
                                x.append(y)
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["key", "n", "first", "route", "cid", "content"])

    return found.mapInArrow(run, schema)


def _index(contents: list[bytes], weights: list[int], window: int) -> np.ndarray:
    """The mask of repeated windows of each content, by an FM-index over all of them."""
    number: dict[bytes, int] = {}
    lists = [x.split(b" ") for x in contents]
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    known = number.setdefault
    symbols = np.fromiter((known(w, len(number) + 1) for x in lists for w in x), np.int64, int(lengths.sum()))
    index = FMIndex(symbols, lengths, np.array(weights, np.int64), int(lengths.max()))
    return index.repeated(lengths, window)


def _masks(contents: DataFrame, window: int) -> DataFrame:
    """contents(route, cid, content, weight) -> (cid, mask) of those with repeated windows.

    Rows of a route lie in one partition, next to one another; an index takes as many whole routes as
    SHARD_WORDS allow, so that a task holds one small index at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list] = ([], [], [])
        words, last = 0, None

        def flush() -> pa.RecordBatch:
            mask = _index(held[1], held[2], window)
            some = np.flatnonzero(mask)
            made = pa.RecordBatch.from_arrays([pa.array([held[0][i] for i in some], pa.binary()), pa.array(mask[some])], ["cid", "mask"])
            for x in held:
                x.clear()
            return made

        for batch in batches:
            for route, *row in zip(*(batch.column(c).to_pylist() for c in ("route", "cid", "content", "weight")), strict=True):
                if route != last and words >= SHARD_WORDS:
                    yield flush()
                    words = 0
                last = route
                for x, y in zip(held, row, strict=True):
                    x.append(y)
                words += row[1].count(b" ") + 2
        if held[0]:
            yield flush()

    dealt = contents.repartition("route").sortWithinPartitions("route")
    return dealt.select("route", "cid", "content", "weight").mapInArrow(run, "cid binary, mask long")


def _removed(found: DataFrame, window: int, with_text: bool) -> DataFrame:
    """found(key, text, marks) -> key, n_removed, kept_sha256, and the kept words as text if asked for."""
    schema = "key binary, n_removed long, kept_sha256 string" + ", kept string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, sha, kept = [], [], []
            marks = batch.column("marks").to_pylist()
            for row, texts in chunks(batch.column("text")):
                words = Words(texts)
                cover = np.zeros(len(words) + 1, np.int64)
                for i in range(len(texts)):
                    mark = marks[row + i]
                    first = np.array([m["first"] for m in mark], np.int64) + words.first[i]
                    bits = (np.array([m["mask"] for m in mark], np.int64)[:, None] >> np.arange(32)) & 1
                    at = (first[:, None] + np.arange(32))[bits == 1]
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + window, -1)
                gone = np.cumsum(cover[:-1]) > 0
                for i in range(len(texts)):
                    a, b = words.first[i], words.first[i + 1]
                    stay = np.flatnonzero(~gone[a:b]) + a
                    left = b" ".join([words.raw[s:e] for s, e in zip(words.start[stay].tolist(), words.end[stay].tolist(), strict=True)])
                    count.append(int(b - a - len(stay)))
                    sha.append(hashlib.sha256(left).hexdigest())
                    if with_text:
                        kept.append(left.decode("utf-8", "replace"))
            made = [batch.column("key"), pa.array(count, pa.int64()), pa.array(sha, pa.string()), *([pa.array(kept, pa.string())] * with_text)]
            yield pa.RecordBatch.from_arrays(made, ["key", "n_removed", "kept_sha256", *["kept"] * with_text])

    return found.select("key", "text", "marks").mapInArrow(run, schema)


def _key(text: str) -> Column:
    """128 bits of the SHA-256 of a text, null as empty."""
    return F.substring(F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)), 1, 16)


def _search(docs: DataFrame, profile: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """docs(key, text), profile -> (the texts with candidate windows, the marks (key, first, mask) of repeated ones)."""
    each = shared_table(profile.where(F.size("runs") > 0).groupBy("key").agg(F.first("anchors").alias("anchors"), F.first("runs").alias("runs"), F.count("*").alias("n")), "each")
    runs = each.select("key", "n", F.inline(F.arrays_zip("anchors", "runs"))).withColumnsRenamed({"anchors": "anchor", "runs": "run"})
    width = F.lit(0)
    for least, to in FINER:
        width = F.when(F.col("uses") >= least, to).otherwise(width)
    uses = F.sum(F.col("n") * F.when(F.col("run").bitwiseAND(32) > 0, 2).otherwise(1)).alias("uses")
    again = cut(runs.groupBy("anchor").agg(uses, F.count("*").alias("rows")).where("uses >= 2").select("anchor", "rows", width.alias("width")))
    # An anchor that holds one run in HOT of those that are left, or more, meets them by broadcast: HOT anchors at the most.
    least = max(1000, (again.agg(F.sum("rows")).first()[0] or 0) // HOT)
    hot = again.where(F.col("rows") >= least).select("anchor", "width")
    met = runs.join(F.broadcast(hot.select("anchor")), "anchor", "left_anti").join(again.select("anchor", "width"), "anchor").unionByName(runs.join(F.broadcast(hot), "anchor"))
    hits = met.groupBy("key").agg(F.first("n").alias("n"), F.collect_list(F.struct("run", "anchor", "width")).alias("hits"))
    texts = docs.groupBy("key").agg(F.first("text").alias("text"))
    found = shared_table(texts.join(hits, "key"), "found")
    done(each)
    segments = _segments(found.select("key", "n", "text", "hits"), window)
    contents = segments.groupBy("route", "cid").agg(F.first("content").alias("content"), F.sum("n").alias("weight"))
    masks = _masks(contents, window)
    marks = segments.select("key", "first", "cid").join(masks, "cid").groupBy("key").agg(F.collect_list(F.struct("first", "mask")).alias("marks"))
    return found.select("key", "text"), marks


def _profiled(df: DataFrame, doc_id: str, text: str, window: int) -> tuple[DataFrame, DataFrame]:
    if not ANCHOR < window <= ANCHOR + 31:
        raise ValueError(f"window must be over {ANCHOR} and at most {ANCHOR + 31} words")
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), _key(text).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return docs, shared_table(_profile(docs, window), "profile")


def remove_repeated(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 35) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row.

    A word goes if a window of `window` words that covers it starts anywhere else too, the same document
    included. Windows are judged on the input.

    Each window is dealt by the least hash among its runs of 8 words, which equal windows share. Windows of
    an anchor that the corpus has once can't repeat and go no further. The rest, as segments of successive
    windows, are deduplicated with their number and indexed: an FM-index for each shard of whole routes, in
    which backward search finds the windows with two occurrences or more. Nothing is held to be repeated on a
    hash alone; the index compares words. Segments of frequent anchors are dealt by 29 and then all 35 of
    their words, so that no route grows with the corpus but by different windows. An anchor with a large share of
    all runs meets them by broadcast, so no task holds it alone.

    Equal texts are handled once, with their number. Null and empty texts have no words; texts under `window`
    words keep all; a very long one is read by itself. Repeated rows come out as often as they come in, a null doc_id
    stays null, and columns other than the two aren't looked at. An empty table gives an empty one.
    """
    docs, profile = _profiled(df, doc_id, text, window)
    found, marks = _search(docs, profile, window)
    removed = _removed(found.join(marks, "key"), window, False)
    out = profile.select("doc_id", "key", "n_words", "sha").join(removed, "key", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


def without_repeated(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 35) -> DataFrame:
    """df with repeated windows taken out of its texts (see remove_repeated): such a text is its words left, by
    one space each, and may be empty; others stay to the letter. All rows and columns stay, whatever their names.
    """
    of, key, kept_ = unused(df, "of", "key", "kept")
    docs, profile = _profiled(df, doc_id, text, window)
    found, marks = _search(docs, profile, window)
    done(profile)
    marks = shared_table(marks, "marks")  # so that what segments were dealt by goes before whole texts are dealt
    removed = _removed(found.join(marks, "key"), window, True).select(F.col("key").alias(key), F.col("kept").alias(kept_))
    out = df.withColumn(of, _key(text)).join(removed, F.col(of) == F.col(key), "left")
    return out.withColumn(text, F.coalesce(kept_, text)).select(*df.columns)
