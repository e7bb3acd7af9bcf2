"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import chunks, cut, kept, mix, unused

#: Characters of an n-gram.
ORDER = 4
#: Documents of each language that its model is fitted on, at most about so many in expectation; one in ten of
#: them isn't counted but calibrates the rejection.
SAMPLE, CALIBRATES = 2000, 10
#: Characters that an unseen one is one of.
ALPHABET = 1 << 12
#: Lengths, in scored characters, at which a bound is calibrated, and the share of a language's own pieces that may lie above it.
LENGTHS, FALSE_REJECTS = tuple(2**i for i in range(1, 14)), 0.001

UNKNOWN = "und"
_STEP = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point that may be a letter itself in lower case if it is one, else 0."""
    out = np.zeros(1 << 18, np.uint32)
    for i in range(len(out)):
        if (c := chr(i)).isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def _codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code of each character, positions that are scored, number of each text's first of these with the total at its end).

    A letter's code is its code point in lower case; every run of anything else, and the text's end, is one code 1.
    Each text is preceded by ORDER - 1 codes 1, which are only contexts. Bytes that aren't UTF-8 are no letters.
    """
    read = [x.decode("utf-8", "replace") for x in texts]
    start = "\n" * (ORDER - 1)
    point = np.frombuffer("".join(f"{start}{x}\n" for x in read).encode("utf-32-le", "replace"), np.uint32)
    letter = np.where(point < 1 << 18, _letters()[np.minimum(point, (1 << 18) - 1)], 0)
    code = np.where(letter == 0, 1, letter).astype(np.uint64)
    begin = np.concatenate(([0], np.cumsum(np.fromiter((len(x) + ORDER for x in read), np.int64, len(read)))))
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 1) | (code[:-1] != 1)
    for i in range(ORDER - 1):
        keep[begin[:-1] + i] = True
    upto = np.concatenate(([0], np.cumsum(keep)))
    first = upto[begin]
    scored = np.ones(int(upto[-1]), bool)
    for i in range(ORDER - 1):
        scored[first[:-1] + i] = False
    return code[keep], np.flatnonzero(scored), np.concatenate(([0], np.cumsum(scored)))[first]


def _grams(code: np.ndarray) -> list[np.ndarray]:
    """For each order the 64-bit hash of the codes that end at each position."""
    out = [mix(code + np.uint64(1))]
    for _ in range(ORDER - 1):
        before = np.concatenate((np.zeros(1, np.uint64), out[-1][:-1]))
        out.append(mix(before * _STEP + out[0]))
    return out


def _find(table: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key is in a sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    at = np.minimum(np.searchsorted(table, key), len(table) - 1)
    return at, table[at] == key


class Language:
    """One language's model: for each order the n-grams' hashes, sorted, with log-probabilities, and the contexts'
    with back-off weights; and the cross-entropy above which a text of some length is rejected."""

    def __init__(self, grams: list[tuple[np.ndarray, np.ndarray]], back: list[tuple[np.ndarray, np.ndarray]], unseen: float, bound: tuple[np.ndarray, np.ndarray] | None = None):
        self.grams, self.back, self.unseen, self.bound = grams, back, unseen, bound

    def log_p(self, hashes: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        """The log-probability of the character at each position after the ones before it."""
        out, rest = np.zeros(len(at), np.float32), np.arange(len(at))
        for order in range(ORDER, 0, -1):
            keys, value = self.grams[order - 1]
            i, found = _find(keys, hashes[order - 1][at[rest]])
            out[rest[found]] += value[i[found]]
            rest = rest[~found]
            if not len(rest):
                return out
            keys, value = self.back[order - 1]
            if order > 1:
                i, known = _find(keys, hashes[order - 2][at[rest] - 1])
                out[rest[known]] += value[i[known]]
        out[rest] += self.unseen
        return out

    def most(self, length: np.ndarray) -> np.ndarray:
        """The bound for texts of so many scored characters, between the calibrated lengths by their logarithm."""
        if self.bound is None or not len(self.bound[0]):
            return np.full(len(length), np.inf)
        return np.interp(np.log2(np.maximum(length, 1)), np.log2(self.bound[0]), self.bound[1])


class Model:
    """The languages' models, each with its own tables."""

    def __init__(self, languages: dict[str, Language]):
        self.names = sorted(languages)
        self.languages = [languages[x] for x in self.names]

    def cross_entropy(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """((texts, languages) nats a scored character, scored characters and letters of each text)."""
        code, at, owner = _codes(texts)
        hashes = _grams(code)
        _, one, same = np.unique(hashes[-1][at], return_index=True, return_inverse=True)
        size = np.diff(owner)
        some = np.flatnonzero(size)
        sums = np.zeros((len(texts), len(self.names)))
        for i, language in enumerate(self.languages if len(at) else []):
            sums[some, i] = -np.add.reduceat(language.log_p(hashes, at[one])[same], owner[some], dtype=np.float64)
        letters = np.concatenate(([0], np.cumsum(code[at] != 1)))[owner]
        return sums / np.maximum(size, 1)[:, None], size, np.diff(letters)

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, rejected) of each text."""
        if not self.names:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        entropy, size, letters = self.cross_entropy(texts)
        best = entropy.argmin(axis=1)
        least = entropy[np.arange(len(texts)), best]
        sharp = np.minimum(size, 64)[:, None]
        score = 1 / np.exp((least[:, None] - entropy) * sharp).sum(axis=1)
        none = letters == 0
        bound = np.stack([x.most(size) for x in self.languages])[best, np.arange(len(texts))]
        return [UNKNOWN if x else self.names[b] for b, x in zip(best.tolist(), none.tolist(), strict=True)], np.where(none, 0.0, score), none | (least > bound)


def _observed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(a row for each distinct n-gram of ORDER characters: its hash, those of its ends of falling length, and those of
    the contexts of all these; how often it occurs), a run of texts at a time."""
    rows, counts = np.zeros((0, 2 * ORDER - 1), np.uint64), np.zeros(0)
    for _, run in chunks(pa.array(texts, pa.binary())):
        code, at, _ = _codes(run)
        hashes = _grams(code)
        _, one, count = np.unique(hashes[-1][at], return_index=True, return_counts=True)
        place = at[one]
        seen = np.stack([*(h[place] for h in reversed(hashes)), *(h[place - 1] for h in reversed(hashes[:-1]))], axis=1)
        rows, counts = np.concatenate((rows, seen)), np.concatenate((counts, count))
        _, one, same = np.unique(rows[:, 0], return_index=True, return_inverse=True)
        rows, counts = rows[one], np.bincount(same, counts)
    return rows, counts


def estimate(texts: list[bytes]) -> Language:
    """One language's model of all n-grams of the texts.

    The highest order is counted as it occurs, a lower one by the distinct characters that precede it. From
    every count the absolute discount of its order, n1 / (n1 + 2 n2), is taken and given to the order below.
    """
    rows, count = _observed(texts)
    counts = []
    for order in range(ORDER, 0, -1):
        i = ORDER - order
        if i:
            _, one, count = np.unique(rows[:, i], return_index=True, return_counts=True)
            rows = rows[one]
        counts.insert(0, (rows[:, i], rows[:, i + 1] if order > 1 else None, rows[:, ORDER + i] if order > 1 else np.zeros(len(rows), np.uint64), count))
    grams: list[tuple[np.ndarray, np.ndarray]] = []
    backs: list[tuple[np.ndarray, np.ndarray]] = []
    below, unseen = 1 / ALPHABET, -np.log(ALPHABET)
    lower, lower_p = np.zeros(0, np.uint64), np.zeros(0)
    for order, (key, end, before, count) in enumerate(counts, 1):
        if not len(key):
            grams.append((key, np.zeros(0, np.float32)))
            backs.append((key, np.zeros(0, np.float32)))
            continue
        once, twice = (count == 1).sum(), (count == 2).sum()
        discount = min(max(once / max(once + 2 * twice, 1), 0.05), 0.95)
        context, of = np.unique(before, return_inverse=True)
        total = np.bincount(of, count)
        back = discount * np.bincount(of) / total
        if order > 1:
            below = lower_p[np.searchsorted(lower, end)]
        else:
            unseen = float(np.log(back[0] / ALPHABET))
        p = (count - discount) / total[of] + back[of] * below
        grams.append((key, np.log(p).astype(np.float32)))
        backs.append((context, np.log(back).astype(np.float32)))
        lower, lower_p = key, p
    return Language(grams, backs, unseen)


def calibrate(language: Language, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, bounds) from texts that the model hasn't counted.

    At each length, consecutive pieces of the texts are held against pieces of the same texts with their characters
    in random order, which no language is. All but FALSE_REJECTS of the former lie below the bound; where the two
    sorts lie apart it is midway between them.

    A length of which the texts give fewer than 20 pieces, and longer ones, get no bound: texts as long are held to that
    of the last length that has one. A language whose texts are too few for the first length rejects nothing.
    """
    rng = np.random.default_rng(0)
    own, other = [], []
    for x in texts:
        read = x.decode("utf-8", "replace")
        mixed = "".join(np.array(list(read))[rng.permutation(len(read))]).encode() if read else b""
        for held, text in ((own, x), (other, mixed)):
            code, at, _ = _codes([text])
            held.append(np.concatenate(([0.0], np.cumsum(-language.log_p(_grams(code), at), dtype=np.float64))))
    lengths, bounds = [], []
    for n in LENGTHS:
        mean = [np.concatenate([np.zeros(0), *(np.diff(s[::n]) / n for s in held if len(s) > n)]) for held in (own, other)]
        if min(map(len, mean)) < 20:
            break
        most, least = np.quantile(mean[0], 1 - FALSE_REJECTS), np.quantile(mean[1], FALSE_REJECTS)
        lengths.append(n)
        bounds.append((most + least) / 2 if least > most else most)
    return np.array(lengths, float), np.array(bounds)


def fit(df: DataFrame, learns: Column, lang: str = "lang", text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE) -> Model:
    """A Model from the rows with a language and a text of which `learns` is true.

    From each language a hash of doc_id chooses about `sample` documents (all, if fewer); whole texts are used and
    all their n-grams kept. One task fits a language on its sample. Every tenth document isn't counted but
    calibrates the rejection (see calibrate). The driver gathers one table for each language, which its sample
    bounds. Rows with a null id, language or text aren't learned from; without any rows left the model has no
    languages. Other columns of df aren't looked at.
    """
    rows = df.where(learns & F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(lang).alias("lang"), F.col(doc_id).alias("id"), F.col(text).alias("text"))
    share = cut(rows.groupBy("lang").agg((F.lit(1e6 * sample) / F.count("*")).alias("rate")))
    chosen = rows.join(F.broadcast(share) if share.count() <= 10_000 else share, "lang").where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1_000_000)) < F.col("rate"))
    chosen = chosen.select("lang", "text", F.pmod(F.xxhash64("id", F.lit(6)), F.lit(CALIBRATES)).alias("turn"))

    def run(table: pa.Table) -> pa.Table:
        texts = [x for _, r in chunks(table.column("text")) for x in r]
        turn = table.column("turn").to_pylist()
        made = estimate([x for x, t in zip(texts, turn, strict=True) if t] or texts)
        lengths, bounds = calibrate(made, [x for x, t in zip(texts, turn, strict=True) if not t] or texts)
        parts = [*enumerate(made.grams), *enumerate(made.back, ORDER), (-1, (np.zeros(1, np.uint64), np.array([made.unseen]))), (-2, (lengths.astype(np.uint64), bounds))]
        size = [len(x[0]) for _, x in parts]
        names = pa.array([table.column("lang")[0].as_py()] * sum(size), pa.string())
        return pa.table([names, np.repeat([k for k, _ in parts], size), np.concatenate([x[0] for _, x in parts]).view(np.int64), np.concatenate([x[1].astype(np.float64) for _, x in parts])], names=["lang", "part", "key", "value"])

    found = chosen.groupBy("lang").applyInArrow(run, "lang string, part long, key long, value double").toArrow()
    if not len(found):
        return Model({})
    names = found.column("lang").combine_chunks().dictionary_encode()
    part, key, value = (found.column(c).to_numpy() for c in ("part", "key", "value"))
    made = {}
    for i, name in enumerate(names.dictionary.to_pylist()):
        own = np.flatnonzero(names.indices.to_numpy() == i)

        def table_of(k: int, own: np.ndarray = own) -> tuple[np.ndarray, np.ndarray]:
            some = own[part[own] == k]
            some = some[np.argsort(key[some].view(np.uint64))]
            return key[some].view(np.uint64), value[some]

        tables = [(x, p.astype(np.float32)) for x, p in (table_of(k) for k in range(2 * ORDER))]
        lengths, bounds = table_of(-2)
        made[name] = Language(tables[:ORDER], tables[ORDER:], float(table_of(-1)[1][0]), (lengths.astype(float), bounds))
    return Model(made)


def _predicted(texts: pa.Array, model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    lang, score, rejected = [], [np.zeros(0)], [np.zeros(0, bool)]
    for _, run in chunks(texts):
        a, b, c = model.predict(run)
        lang += a
        score.append(b)
        rejected.append(c)
    return lang, np.concatenate(score), np.concatenate(rejected)


def identify(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of every row, lang_pred, score (0 to 1) and rejected.

    The language whose model gives the whole text the least cross-entropy for each character; `und` with score 0
    if the text is null or empty or has no letters. Ties go to the language first by name. rejected: there are no
    letters, or the cross-entropy is above the language's bound for the text's length. Texts are read in runs of
    bounded size, a very long one by itself. Rows come out as they come in, repeated ones as often; an empty table
    gives an empty one; a column of `keep` with the name of a new one gives way to it.
    """
    names = kept(keep, "lang_pred", "score", "rejected")
    source = df.select(*names, F.col(text).alias(unused(df, "text")[0]))
    schema = df.select(*names).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    shared = df.sparkSession.sparkContext.broadcast(model)  # the n-grams of a bounded sample of each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, rejected = _predicted(batch.column(len(names)), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], [*names, "lang_pred", "score", "rejected"])

    return source.mapInArrow(run, schema)


def accepted(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of df, with all their columns, whose text the model doesn't reject (see identify); null texts, and
    those without letters, go."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~_predicted(batch.column(at), shared.value)[2]))

    return df.mapInArrow(run, df.select("*").schema)
