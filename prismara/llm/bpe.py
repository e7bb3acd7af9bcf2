"""Byte-level BPE by a rank queue: encoding and decoding of whole texts."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from ._shared import chunks, kept, ragged, unused


#: Bytes of text whose pre-tokens share a queue: each rank costs a step for a run, however long the run is.
RUN_BYTES = 1 << 22


class RankQueue:
    """Positions by merge rank. Each rank has a bucket; two levels of bitmap say which buckets hold any.

    A bit of `top` stands for 64 ranks, the 64 bits of a word of `low` for one each. Find-first-set on both
    gives the least rank. Nothing is ever removed from a bucket but all of it: the caller skips stale entries.
    """

    def __init__(self):
        self.buckets: dict[int, list[np.ndarray]] = {}
        self.low: dict[int, int] = {}
        self.top = 0

    def push(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(np.concatenate(([True], ranks[1:] != ranks[:-1])))
        for rank, begin, end in zip(ranks[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(ranks)], strict=True):
            bucket = self.buckets.get(rank)
            if bucket:
                bucket.append(positions[begin:end])
            else:
                self.buckets[rank] = [positions[begin:end]]
                word = rank >> 6
                self.low[word] = self.low.get(word, 0) | 1 << (rank & 63)
                self.top |= 1 << word

    def pop(self) -> tuple[int, np.ndarray]:
        """The least rank and what its bucket holds."""
        word = (self.top & -self.top).bit_length() - 1
        bits = self.low[word]
        rank = word << 6 | (bits & -bits).bit_length() - 1
        self.low[word] = bits & (bits - 1)
        if not self.low[word]:
            self.top &= self.top - 1
        held = self.buckets.pop(rank)
        return rank, held[0] if len(held) == 1 else np.unique(np.concatenate(held))


class Codec:
    """A vocabulary of byte strings by rank, and the pattern that parts a text before the merges."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern)
        size = max(ranks.values()) + 1
        pieces = [b""] * size
        for piece, rank in ranks.items():
            pieces[rank] = piece
        self.length = np.fromiter(map(len, pieces), np.int64, size)
        self.offset = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        # Every pair of tokens whose bytes make a token: its key and the rank, by key. The last one is never met.
        get = ranks.get
        made = [(x << 32 | y, r) for piece, r in ranks.items() for i in range(1, len(piece)) if (x := get(piece[:i])) is not None and (y := get(piece[i:])) is not None]
        table = np.array([*made, (1 << 62, -1)], np.int64)
        table = table[np.argsort(table[:, 0])]
        self.pair_key, self.pair_rank = table[:, 0].copy(), table[:, 1].copy()
        # Tokens that are part of a token of a lower rank, which may then be due at once.
        key, rank = self.pair_key[:-1], self.pair_rank[:-1]
        self.hasty = set(np.concatenate(((x := key >> 32)[rank < x], (y := key & 0xFFFFFFFF)[rank < y])).tolist())

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of tokens, -1 where it has none."""
        key = left << 32 | right
        at = np.searchsorted(self.pair_key, key)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], -1)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after the other, and how many each has.

        In each piece the pair of least rank is merged, leftmost first, until no pair has a rank. All pieces
        lie in one linked list with a gap after each, and share one rank queue: pieces don't touch, so the
        least rank of all is the least of each piece that holds it. A bucket is merged in one step: entries
        whose pair has changed since are stale and skipped, and of overlapping pairs the left one is taken,
        then every second. Where a merge makes a pair of lower rank, the pairs to its right in the same piece wait
        in the queue, so that the result is the same as one by one.
        """
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        owner = np.repeat(np.arange(len(pieces)), size)
        n = len(owner)
        token = self.single[np.frombuffer(b"".join(pieces), np.uint8)] if n else np.zeros(0, np.int64)
        ends = np.cumsum(size)
        follow, before = np.arange(1, n + 2), np.arange(-1, n)  # n: none, with a place for what is written there
        follow[ends[size > 0] - 1] = n
        before[(ends - size)[size > 0]] = n
        pair = np.full(n + 1, -1)
        alive = np.ones(n, bool)
        at = np.flatnonzero(follow[:n] < n)
        pair[at] = self._ranks(token[at], token[at + 1])
        queue = RankQueue()
        at = at[pair[at] >= 0]
        queue.push(pair[at], at)
        while queue.top:
            rank, at = queue.pop()
            at = at[pair[at] == rank]
            every = at
            if len(at) > 1:
                run = np.concatenate(([True], follow[at[:-1]] != at[1:]))
                if not run.all():
                    head = np.flatnonzero(run)
                    place = np.arange(len(at)) - np.repeat(head, np.diff([*head, len(at)]))
                    at = at[place % 2 == 0]
                if rank in self.hasty and len(at) > 1:
                    wait = self._waiting(rank, at, token, follow, before, owner)
                    if wait.any():
                        again = every[np.isin(owner[every], owner[at[wait]])]  # with those that were passed over
                        queue.push(np.full(len(again), rank), again)
                        at = at[~wait]
            if not len(at):
                continue
            gone = follow[at]
            end = follow[gone]
            follow[at], before[end] = end, at
            token[at], alive[gone] = rank, False
            pair[gone] = -1
            left = before[at]
            touched = np.concatenate((at, left[left < n]))
            if len(at) > 1:
                touched = np.unique(touched)
            right = follow[touched]
            pair[touched] = -1
            whole = right < n
            touched, right = touched[whole], right[whole]
            got = self._ranks(token[touched], token[right])
            pair[touched] = got
            some = got >= 0
            if some.any():
                queue.push(got[some], touched[some])
        return token[alive], np.bincount(owner[alive], minlength=len(pieces))

    def _waiting(self, rank: int, at: np.ndarray, token: np.ndarray, follow: np.ndarray, before: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Which of the pairs at `at` come after one, in the same piece, whose merge makes a pair of lower rank."""
        n = len(token)
        gone = follow[at]
        left, right = before[at], follow[gone]
        beside = np.where(left < n, token[np.minimum(left, n - 1)], -1)
        beside[1:][left[1:] == gone[:-1]] = rank  # merged just before
        lower = np.zeros(len(at), bool)
        for some, pairs in ((left < n, (beside, rank)), (right < n, (rank, token[np.minimum(right, n - 1)]))):
            got = self._ranks(*(x[some] if isinstance(x, np.ndarray) else np.full(int(some.sum()), x) for x in pairs))
            lower[some] |= (got >= 0) & (got < rank)
        earlier = np.cumsum(lower) - lower
        head = np.flatnonzero(np.concatenate(([True], owner[at[1:]] != owner[at[:-1]])))
        return earlier > np.repeat(earlier[head], np.diff([*head, len(at)]))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text as little-endian unsigned 32-bit integers. Equal pre-tokens are merged once."""
        known: dict[str, int] = {}
        number = known.setdefault
        codes, count = [], []
        for text in texts:
            found = self.split.findall(text)
            codes.append(np.fromiter([number(x, len(known)) for x in found], np.int64, len(found)))
        pieces = [x.encode() for x in known]
        whole = np.fromiter(map(self.ranks.get, pieces, [-1] * len(pieces)), np.int64, len(pieces))
        hard = np.flatnonzero(whole < 0)
        ids, number_of = self.merge([pieces[i] for i in hard])
        count = np.ones(len(pieces), np.int64)
        count[hard] = number_of
        start = np.cumsum(count) - count
        flat = np.empty(int(count.sum()), "<u4")
        flat[start[whole >= 0]] = whole[whole >= 0]
        flat[ragged(start[hard], number_of)] = ids
        return [flat[ragged(start[x], count[x])] for x in codes]

    def decode(self, ids: np.ndarray, step: int = 1 << 18) -> bytes:
        """The bytes of ids; an id that the vocabulary lacks is an error."""
        out = []
        for i in range(0, len(ids), step):
            part = ids[i : i + step].astype(np.int64)
            out.append(self.bytes[ragged(self.offset[part], self.length[part])].tobytes())
        return b"".join(out)


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> Codec:
    """From a file of lines `base64 rank`. Every single byte must have a rank."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"{path} has no rank for the bytes {missing[:5]}")
    return Codec(ranks, pattern)


def _encoded(codec: Codec, batch: pa.RecordBatch, name: str | int) -> Iterator[np.ndarray]:
    for _, run in chunks(batch.column(name), RUN_BYTES):
        yield from codec.encode([x.decode("utf-8", "replace") for x in run])


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the column `ids`, array of int: the ids of the whole text (null: none), without special tokens.

    path: vocabulary file, which every executor must be able to open. pattern: parts the text; each match is
    merged by itself. Other columns, repeated rows and their order within a partition stay as they are; an
    existing column of the name `ids` is replaced.
    """
    kept = [c for c in df.columns if c != ids]
    source = df.select(*kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(path, pattern)
        for batch in batches:
            lists = [x.astype(np.int32) for x in _encoded(codec, batch, text)]
            at = np.cumsum([0, *map(len, lists)]).astype(np.int32)
            flat = np.concatenate(lists) if lists else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], [*kept, ids])

    return source.mapInArrow(run, StructType([*source.schema, StructField(ids, ArrayType(IntegerType()))]))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the binary column `out`: the bytes of the ids (null or empty: no bytes)."""
    kept = [c for c in df.columns if c != out]
    source = df.select(*kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(path, pattern)
        for batch in batches:
            texts = [codec.decode(np.asarray(x or (), np.int64)) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], [*kept, out])

    return source.mapInArrow(run, StructType([*source.schema, StructField(out, BinaryType())]))


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, and n_tokens, ids_sha256 and decoded_sha256 of each whole text encoded and decoded again.

    Ids are held for a run of texts and decoded bytes for one text at a time, so that neither crosses back to Spark. Null
    is as empty, which has no ids; a very long text is encoded by itself; bytes that aren't UTF-8 are replaced first.
    Rows come out as they come in, repeated ones as often; an empty table gives an empty one; a column of `keep` with
    the name of a new one gives way to it.
    """
    names = kept(keep, "n_tokens", "ids_sha256", "decoded_sha256")
    source = df.select(*names, F.col(text).alias(unused(df, "text")[0]))
    schema = df.select(*names).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(path, pattern)
        for batch in batches:
            count, ids_sha, decoded_sha = [], [], []
            for ids in _encoded(codec, batch, len(names)):
                count.append(len(ids))
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                decoded_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            made = [pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *made], [f.name for f in schema])

    return source.mapInArrow(run, schema)
