"""BPE by a table of distinct words: texts are split in Spark, each distinct word is encoded once, and its ids come back
to every position that has it; ids are decoded by joining them with their pieces."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from . import bpe
from ._shared import _poly, kept, mix, ragged, unused

#: Words whose positions share a list of distinct ones, and bytes of distinct words that are merged at once.
RUN_WORDS, MERGE_BYTES = 3 << 20, 1 << 22

# Letters and numbers of Unicode 14 to 16, which a JVM of an earlier one doesn't know as such.
NEWER_LETTERS = (
    "\\x{870}-\\x{887}\\x{889}-\\x{88e}\\x{8b5}\\x{8c8}-\\x{8c9}\\x{c5d}\\x{cdd}\\x{170d}\\x{171f}\\x{1b4c}\\x{1c89}-\\x{1c8a}\\x{2c2f}\\x{2c5f}\\x{9ffd}-\\x{9fff}"
    "\\x{a7c0}-\\x{a7c1}\\x{a7cb}-\\x{a7cd}\\x{a7d0}-\\x{a7d1}\\x{a7d3}\\x{a7d5}-\\x{a7dc}\\x{a7f2}-\\x{a7f4}\\x{10570}-\\x{1057a}\\x{1057c}-\\x{1058a}\\x{1058c}-\\x{10592}"
    "\\x{10594}-\\x{10595}\\x{10597}-\\x{105a1}\\x{105a3}-\\x{105b1}\\x{105b3}-\\x{105b9}\\x{105bb}-\\x{105bc}\\x{105c0}-\\x{105f3}\\x{10780}-\\x{10785}\\x{10787}-\\x{107b0}"
    "\\x{107b2}-\\x{107ba}\\x{10d4a}-\\x{10d65}\\x{10d6f}-\\x{10d85}\\x{10ec2}-\\x{10ec4}\\x{10f70}-\\x{10f81}\\x{11071}-\\x{11072}\\x{11075}\\x{1123f}-\\x{11240}"
    "\\x{11380}-\\x{11389}\\x{1138b}\\x{1138e}\\x{11390}-\\x{113b5}\\x{113b7}\\x{113d1}\\x{113d3}\\x{11740}-\\x{11746}\\x{11ab0}-\\x{11abf}\\x{11bc0}-\\x{11be0}"
    "\\x{11f02}\\x{11f04}-\\x{11f10}\\x{11f12}-\\x{11f33}\\x{12f90}-\\x{12ff0}\\x{1342f}\\x{13441}-\\x{13446}\\x{13460}-\\x{143fa}\\x{16100}-\\x{1611d}\\x{16a70}-\\x{16abe}"
    "\\x{16d40}-\\x{16d6c}\\x{18cff}\\x{1aff0}-\\x{1aff3}\\x{1aff5}-\\x{1affb}\\x{1affd}-\\x{1affe}\\x{1b11f}-\\x{1b122}\\x{1b132}\\x{1b155}\\x{1df00}-\\x{1df1e}"
    "\\x{1df25}-\\x{1df2a}\\x{1e030}-\\x{1e06d}\\x{1e290}-\\x{1e2ad}\\x{1e4d0}-\\x{1e4eb}\\x{1e5d0}-\\x{1e5ed}\\x{1e5f0}\\x{1e7e0}-\\x{1e7e6}\\x{1e7e8}-\\x{1e7eb}"
    "\\x{1e7ed}-\\x{1e7ee}\\x{1e7f0}-\\x{1e7fe}\\x{2a6de}-\\x{2a6df}\\x{2b735}-\\x{2b739}\\x{2ebf0}-\\x{2ee5d}\\x{31350}-\\x{323af}"
)
NEWER_NUMBERS = "\\x{10d40}-\\x{10d49}\\x{116d0}-\\x{116e3}\\x{11bf0}-\\x{11bf9}\\x{11f50}-\\x{11f59}\\x{16130}-\\x{16139}\\x{16ac0}-\\x{16ac9}\\x{16d70}-\\x{16d79}\\x{1ccf0}-\\x{1ccf9}\\x{1d2c0}-\\x{1d2d3}\\x{1e4f0}-\\x{1e4f9}\\x{1e5f1}-\\x{1e5fa}"



def _word(letter: str, number: str) -> str:
    """How byte-level BPE parts a text, as a Java expression."""
    return rf"(?U) ?[{letter}]++|'(?:[sdmt]|re|ve|ll)| ?[{number}]++| ?[^\s{letter}{number}]++|\s+(?!\S)|\s+"


WORD, WORD_OF_ANY_AGE = _word(r"\p{L}", r"\p{N}"), _word(rf"\p{{L}}{NEWER_LETTERS}", rf"\p{{N}}{NEWER_NUMBERS}")
#: What the JVM doesn't know as a character; only texts with such are parted by the longer, and far slower, expression.
UNKNOWN = r"\p{Cn}"


def alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it is printable Latin-1, and else
    the next one from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary(bpe.Codec):
    """A byte-level BPE vocabulary from a tokenizer's JSON: merges in their own order, and added tokens that are cut out of
    a text before anything else. Whatever else such a file may ask for is an error."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as lines:
            told = json.load(lines)
        model, before, added = told["model"], told.get("pre_tokenizer") or {}, told.get("added_tokens") or []
        plain = not told.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        plain = plain and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or any(x.get(k) for x in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path} is no plain byte-level BPE")
        chars, ids = alphabet(), model["vocab"]
        self.added = {x["content"]: int(x["id"]) for x in added}
        # Tokens are numbered by the merge that makes them, after the 256 bytes: a number is a rank too.
        number = dict(chars)
        pairs = []
        for i, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            if a + b in number or a not in number or b not in number:
                raise ValueError(f"{path}: merge {i} repeats a token or lacks a part")
            number[a + b] = 256 + i
            pairs.append((number[a] << 32 | number[b], 256 + i))
        self.single = np.arange(256)
        table = np.array([*pairs, (1 << 62, -1)], np.int64)
        table = table[np.argsort(table[:, 0])]
        self.pair_key, self.pair_rank = table[:, 0].copy(), table[:, 1].copy()
        key, rank = self.pair_key[:-1], self.pair_rank[:-1]
        self.hasty = set(np.concatenate(((x := key >> 32)[rank < x], (y := key & 0xFFFFFFFF)[rank < y])).tolist())
        self.outer = np.empty(len(number), np.uint32)
        for token, i in number.items():
            self.outer[i] = ids[token]
        # The join's other side: a piece of bytes for each id, none for ids that no token has.
        size = max([*ids.values(), *self.added.values()]) + 1
        pieces = [b""] * size
        for token, i in [*ids.items(), *self.added.items()]:
            pieces[i] = bytes(chars[c] for c in token) if all(c in chars for c in token) else token.encode()
        self.length = np.fromiter(map(len, pieces), np.int64, size)
        self.offset = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and how many each has."""
        special = {x.encode(): i for x, i in self.added.items()}
        own = [special.get(w) for w in words] if special else [None] * len(words)
        if not any(i is not None for i in own):
            ids, count = self.merge(words)
            return self.outer[ids], count
        ids, count = self.merge([b"" if i is not None else w for w, i in zip(words, own, strict=True)])
        at = np.array([k for k, i in enumerate(own) if i is not None])
        begin = np.cumsum(count)[at]
        out = np.insert(self.outer[ids], begin, [own[k] for k in at])
        count[at] = 1
        return out, count

    def decode(self, ids: np.ndarray, step: int = 1 << 18) -> bytes:
        """The bytes of ids, which meet their pieces by number; an id without a token has none."""
        ids = np.asarray(ids, np.int64)
        return super().decode(ids[(ids >= 0) & (ids < len(self.length))], step)


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    return Vocabulary(path)


def words(text: Column, added: list[str]) -> Column:
    """The words of a text (null: none), in order: added tokens, and the parts of what lies between them."""
    text = F.coalesce(text, F.lit(""))
    parts = lambda x: F.when(x.rlike(UNKNOWN), F.regexp_extract_all(x, F.lit(WORD_OF_ANY_AGE), 0)).otherwise(F.regexp_extract_all(x, F.lit(WORD), 0))
    if not added:
        return parts(text)
    one = "|".join(rf"\Q{x}\E" for x in sorted(added, key=len, reverse=True))
    found, between = F.regexp_extract_all(text, F.lit(one), 0), F.split(text, one, -1)
    each = F.flatten(F.transform(between, lambda x, i: F.concat(parts(x), F.slice(found, i + 1, 1))))
    return F.when(text.rlike(one), each).otherwise(parts(text))


def pack(x: np.ndarray) -> bytes:
    """Numbers below 2**32 in compressed form: their first bytes, then their second ones, and so on."""
    return zstandard.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def unpack(x: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(x), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def _strings(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of an array of strings or bytes."""
    large = pa.types.is_large_string(x.type) or pa.types.is_large_binary(x.type)
    at = np.frombuffer(x.buffers()[1], np.int64 if large else np.int32)[x.offset : x.offset + len(x) + 1]
    return np.frombuffer(x.buffers()[2] or b"", np.uint8), at.astype(np.int64)


class _Run:
    """A run of texts by the distinct words that they have: `codes` numbers them by position, the commonest least."""

    def __init__(self, found: pa.Array):
        coded = found.dictionary_encode()
        codes, self.words = coded.indices.to_numpy(), coded.dictionary
        order = np.argsort(-np.bincount(codes, minlength=len(self.words)), kind="stable")
        self.number = np.empty(len(order), np.int64)
        self.number[order] = np.arange(len(order))
        self.codes = self.number[codes]
        self.data, self.at = _strings(self.words)
        digest = xxhash.xxh3_64(self.codes.tobytes())
        digest.update(self.data[self.at[0] : self.at[-1]].tobytes())
        self.digest = digest.intdigest() - (1 << 63)

    def buckets(self, n: int) -> Iterator[tuple[int, bytes, bytes]]:
        """(bucket, words, numbers) in compressed form; a word's bucket follows from its bytes."""
        if not len(self.words):
            return
        of = (mix(_poly(self.data, self.at[:-1], self.at[1:])) % np.uint64(n)).astype(np.int64)
        order = pc.sort_indices(self.words).to_numpy().astype(np.int64)
        order = order[np.argsort(of[order], kind="stable")]
        size = np.diff(self.at)
        cuts = np.flatnonzero(np.concatenate(([True], of[order[1:]] != of[order[:-1]])))
        for begin, end in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
            part = order[begin:end]
            raw = self.data[ragged(self.at[part], size[part])].tobytes()
            lengths = pack(size[part])
            yield int(of[part[0]]), len(lengths).to_bytes(4, "little") + lengths + zstandard.compress(raw, 3), pack(self.number[part])


def _listed(blob: bytes) -> list[bytes]:
    split = 4 + int.from_bytes(blob[:4], "little")
    raw, ends = zstandard.decompress(blob[split:]), np.cumsum(unpack(blob[4:split])).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch], list[np.ndarray], _Run]]:
    """(number, rows, words of each row, run) for runs of whole texts of RUN_WORDS words, or of one text if that has more."""
    task = TaskContext.get()
    first, nr, rows, sizes, found, held = (task.partitionId() if task else 0) << 32, 0, [], [], [], 0
    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        at = lists.offsets.to_numpy().astype(np.int64)
        flat, begin = lists.flatten(), 0
        while begin < len(lists):
            end = int(np.searchsorted(at, at[begin] + RUN_WORDS - held, "right")) - 1
            if end <= begin and not rows:
                end = begin + 1
            if end > begin:
                rows.append(batch.slice(begin, end - begin))
                sizes.append(np.diff(at[begin : end + 1]))
                found.append(flat.slice(at[begin] - at[0], at[end] - at[begin]))
                held += int(at[end] - at[begin])
                begin = end
            if begin < len(lists):
                yield first + nr, rows, sizes, _Run(pa.concat_arrays(found))
                nr, rows, sizes, found, held = nr + 1, [], [], [], 0
    if rows:
        yield first + nr, rows, sizes, _Run(pa.concat_arrays(found))


def _table_rows(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (run, digest, bucket, words, numbers) sorted by bucket to (run, digest, numbers, counts, ids): the words of a
    bucket, or of several small ones, as a table in which each is encoded once."""
    vocabulary = load(path)
    held: list[tuple] = []
    table: dict[bytes, int] = {}
    size, last = 0, None

    def ready() -> pa.RecordBatch:
        flat, count, some, run = [], [], [], 0
        for word in [*table, None]:
            if word is None or run + len(word) > MERGE_BYTES and some:
                ids, n = vocabulary.encode_words(some)
                flat.append(ids)
                count.append(n)
                some, run = [], 0
            if word is not None:
                some.append(word)
                run += len(word)
        flat, count = np.concatenate(flat), np.concatenate(count)
        start, out = np.cumsum(count) - count, []
        for run, digest, numbers, at in held:
            out.append((run, digest, numbers, pack(count[at]), pack(flat[ragged(start[at], count[at])])))
        columns = [pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), *[pa.binary()] * 3), strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["run", "digest", "numbers", "counts", "ids"])

    for batch in batches:
        for run, digest, bucket, blob, numbers in zip(*(batch.column(c).to_pylist() for c in ("run", "digest", "bucket", "words", "numbers")), strict=True):
            if held and bucket != last and size >= MERGE_BYTES:
                yield ready()
                held, table, size = [], {}, 0
            before, found = len(table), _listed(blob)
            at = np.fromiter((table.setdefault(w, len(table)) for w in found), np.int64, len(found))
            size += sum(map(len, found)) if len(table) > before else 0
            held.append((run, digest, numbers, at))
            last = bucket
    if held:
        yield ready()


def _placed(head: pa.Table, found: pa.Table, finish: Callable[[list[np.ndarray]], list[pa.Array]], names: list[str], made: list[str]) -> pa.Table:
    """A run's rows with what `finish` makes of the ids of each text: by the number of the word at every position."""
    codes, sizes = unpack(head.column("codes")[0].as_py()), unpack(head.column("sizes")[0].as_py())
    n = head.column("distinct")[0].as_py()
    count, start = np.zeros(n, np.int64), np.zeros(n, np.int64)
    flat, held, met = [], 0, 0
    for numbers, counts, ids in zip(*(found.column(c).to_pylist() for c in ("numbers", "counts", "ids")), strict=True):
        at, c = unpack(numbers), unpack(counts).astype(np.int64)
        count[at], start[at] = c, held + np.cumsum(c) - c
        flat.append(unpack(ids))
        held, met = held + int(c.sum()), met + len(at)
    if met != n:
        raise RuntimeError("a task that ran again read other rows or another order than before; settle its input first")
    flat = np.concatenate([np.zeros(0, "<u4"), *flat])
    ends = np.cumsum(sizes.astype(np.int64))
    texts = (flat[ragged(start[x], count[x])] for x in (codes[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)))
    rows = head.column("rows").combine_chunks().flatten()
    return pa.table([*(rows.field(i) for i in range(len(names))), *finish(texts)], names=[*names, *made])


def _with_ids(df: DataFrame, path: str, text: str, keep: list[str], fields: list[StructField], finish: Callable) -> DataFrame:
    """The columns `keep` and what `finish` makes, as `fields`, of the ids of each text.

    A first pass parts texts and deals each run's distinct words by bucket, where each word is encoded once; a second one
    parts them again and gives the positions. Both meet by run, and by a digest of what it holds.
    """
    vocabulary, buckets = load(path), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    name = unused(df, "words")[0]
    source = df.select(*keep, words(F.col(text), list(vocabulary.added)).alias(name))
    inner = df.select(*keep).schema

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, _, run in _runs(batches):
            rows = list(run.buckets(buckets))
            if rows:
                columns = [pa.array([number] * len(rows), pa.int64()), pa.array([run.digest] * len(rows), pa.int64()), *(pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True))]
                yield pa.RecordBatch.from_arrays(columns, ["run", "digest", "bucket", "words", "numbers"])

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows, sizes, run in _runs(batches):
            parts = [pa.StructArray.from_arrays([pa.concat_arrays([r.column(i) for r in rows]) for i in range(len(keep))], [f"c{i}" for i in range(len(keep))])]
            lists = pa.ListArray.from_arrays(pa.array([0, len(parts[0])], pa.int32()), parts[0])
            one = lambda x, kind: pa.array([x], kind)
            columns = [one(number, pa.int64()), one(run.digest, pa.int64()), lists, one(pack(np.concatenate(sizes)), pa.binary()), one(pack(run.codes), pa.binary()), one(len(run.words), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["run", "digest", "rows", "sizes", "codes", "distinct"])

    names, made = [f.name for f in inner], [f.name for f in fields]
    row = StructType([StructField(f"c{i}", f.dataType, True) for i, f in enumerate(inner)])
    by_bucket = source.mapInArrow(dealt, "run long, digest long, bucket int, words binary, numbers binary").repartition("bucket").sortWithinPartitions("bucket")
    table = by_bucket.mapInArrow(lambda batches: _table_rows(path, batches), "run long, digest long, numbers binary, counts binary, ids binary")
    head = source.mapInArrow(heads, _head_schema(row))
    schema = StructType([StructField(f.name, f.dataType, True) for f in inner] + fields)
    return head.groupBy("run", "digest").cogroup(table.groupBy("run", "digest")).applyInArrow(lambda a, b: _placed(a, b, finish, names, made), schema)


def _head_schema(row: StructType) -> StructType:
    out = StructType().add("run", "long").add("digest", "long").add("rows", ArrayType(row))
    return out.add("sizes", "binary").add("codes", "binary").add("distinct", "long")


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the column `ids`, array of int: the ids of the whole text (null: none), as the tokenizer of the JSON file at
    `path` gives them without adding any. Added tokens that a text holds are themselves.

    Rows come out once each, repeated ones as often, in no order; an existing column `ids` is replaced. A text with more
    words than a run is a run by itself. An empty table gives an empty one.
    """

    def finish(texts: Iterator[np.ndarray]) -> list[pa.Array]:
        lists = [x.astype(np.int32) for x in texts]
        at = np.cumsum([0, *map(len, lists)]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.zeros(0, np.int32), *lists])))]

    return _with_ids(df, path, text, [c for c in df.columns if c.lower() != ids.lower()], [StructField(ids, ArrayType(IntegerType()))], finish)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the string column `out`: the text of its ids (null or empty: none), where bytes that aren't UTF-8 are replaced
    and ids without a token are skipped.

    The join with the pieces is made in the tasks, as one with a table of proven size: a vocabulary's, which each worker
    reads once. Nothing is shuffled, and rows stay where they are.
    """
    kept_ = [c for c in df.columns if c.lower() != out.lower()]
    source = df.select(*kept_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(path)
        for batch in batches:
            texts = [vocabulary.decode(np.asarray([i for i in x or () if i is not None], np.int64)).decode("utf-8", "replace") for x in batch.column(kept_.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*kept_, out])

    return source.mapInArrow(run, StructType([*source.schema, StructField(out, StringType())]))


def round_trip(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, and n_tokens, ids_sha256 and decoded_sha256 of each whole text encoded and decoded again.

    Null is as empty, which has no ids; a very long text is a run by itself; rows come out as often as they come in, in no
    order; an empty table gives an empty one; a column of `keep` with the name of a new one gives way to it.
    """
    names = kept(keep, "n_tokens", "ids_sha256", "decoded_sha256")
    fields = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]

    def finish(texts: Iterator[np.ndarray]) -> list[pa.Array]:
        vocabulary, count, ids_sha, decoded_sha = load(path), [], [], []
        for ids in texts:
            count.append(len(ids))
            ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
            decoded_sha.append(hashlib.sha256(vocabulary.decode(ids).decode("utf-8", "replace").encode()).hexdigest())
        return [pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]

    return _with_ids(df, path, text, names, fields, finish)
