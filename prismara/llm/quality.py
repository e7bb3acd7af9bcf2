"""Quality classifier: logistic regression on hashed word n-grams, fitted by follow-the-regularised-leader."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import Words, _poly, chunks, kept, mix, unused

#: Weights, a power of two.
SIZE = 1 << 18
#: Labelled documents that a model is fitted on, at most about so many in expectation, and passes over them.
SAMPLE, PASSES = 8000, 2

_FORM = np.arange(256, dtype=np.uint8)
_FORM[ord("A") : ord("Z") + 1] = ord("A")
_FORM[ord("a") : ord("z") + 1] = ord("a")
_FORM[0x80:] = ord("a")
_FORM[ord("0") : ord("9") + 1] = ord("0")


def _forms(words: Words) -> np.ndarray:
    """A hash of each word's form: letters in runs as A or a, digits as 0, other characters once a run."""
    form = _FORM[words.data]
    keep = np.concatenate(([True], form[1:] != form[:-1]))
    keep[words.start] = True
    upto = np.concatenate(([0], np.cumsum(keep)))
    return mix(_poly(form[keep], upto[words.start], upto[words.end]) + np.uint64(1))


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(place of each feature in the weights, number of each text's first feature with the total at the end).

    Features are the words, the pairs of neighbours, and the same of word forms, where a word that repeats the
    one before it has a form of its own. Repeats count. A text without words has none.
    """
    words = Words(texts)
    n = len(words)
    word, form = words.hashes(), _forms(words)
    text = np.repeat(np.arange(len(texts)), np.diff(words.first))
    after = np.zeros(n, bool)
    after[1:] = text[1:] == text[:-1]
    same = np.zeros(n, bool)
    same[1:] = after[1:] & (word[1:] == word[:-1])
    form = np.where(same, np.uint64(0x5851F42D4C957F2D), form)
    with np.errstate(over="ignore"):
        pairs = [mix(x[1:] * np.uint64(0x9E3779B97F4A7C15) + x[:-1] + np.uint64(salt)) for x, salt in ((word, 1), (form, 2))] if n else [word, form]
    late = after[1:] if n else after
    place = np.concatenate((word, form, pairs[0][late], pairs[1][late])) & np.uint64(SIZE - 1)
    owner = np.concatenate((text, text, text[1:][late], text[1:][late])) if n else text
    order = np.argsort(owner, kind="stable")
    return place[order].astype(np.int64), np.searchsorted(owner[order], np.arange(len(texts) + 1))


def train(texts: list[bytes], labels: list[int], passes: int = PASSES, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.01, l2: float = 0.1) -> tuple[np.ndarray, float]:
    """(weights, bias) by FTRL-proximal, one document at a time in the order given.

    A document's features weigh their share of it, so its score is the mean of its features' weights.
    """
    z, n = np.zeros(SIZE), np.zeros(SIZE)
    bias, bias_n = 0.0, 0.0
    examples = []
    for first, run in _runs(texts):
        place, at = features(run)
        for i in range(len(run)):
            used, count = np.unique(place[at[i] : at[i + 1]], return_counts=True)
            examples.append((used, (count / max(count.sum(), 1)).astype(np.float32), labels[first + i]))
    for _ in range(passes):
        for used, x, label in examples:
            zi, ni = z[used], n[used]
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            g = 1 / (1 + np.exp(-np.clip(SCALE * (w @ x) + bias, -35, 35))) - label
            grad = SCALE * g * x
            step = (np.sqrt(ni + grad * grad) - np.sqrt(ni)) / alpha
            z[used] += grad - step * w
            n[used] += grad * grad
            bias_n += g * g
            bias -= g / (1 + np.sqrt(bias_n))
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    return w.astype(np.float32), float(bias)


#: What the mean of weights is multiplied by, so that weights stay small.
SCALE = 8.0


def _runs(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    first = 0
    while first < len(texts):
        upto, held = first, 0
        while upto < len(texts) and (held == 0 or held + len(texts[upto]) <= limit):
            held += len(texts[upto]) + 1
            upto += 1
        yield first, texts[first:upto]
        first = upto


def fit(docs: DataFrame, labels: DataFrame, learns: Column, label: str = "quality", doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """(weights, bias) from documents with a label 0 or 1 of which `learns` (of doc_id) is true.

    The sample is what a hash of doc_id chooses of all such documents, at a rate that makes `sample` in
    expectation, or all if they are fewer; one task fits it. What comes back is SIZE weights at most. A
    document with both labels counts as its greater one; without labelled documents all weights are 0.
    """
    marked = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.max(label).cast("int").alias("label"))
    marked = marked.where(learns)
    there = marked.count()
    share = F.pmod(F.xxhash64(doc_id, F.lit(9)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / max(there, 1)))
    chosen = docs.select(doc_id, F.col(text).alias("text")).join(marked.where(share), doc_id)
    dealt = chosen.select(F.xxhash64(doc_id, F.lit(3)).alias("o"), "text", "label").repartition(1).sortWithinPartitions("o", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, marks = [], []
        for batch in batches:
            texts += [x for _, r in chunks(batch.column("text")) for x in r]
            marks += batch.column("label").to_pylist()
        w, bias = train(texts, marks)
        some = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(w[some].astype(float), bias))], ["place", "weight"])

    found = dealt.mapInArrow(run, "place long, weight double").toArrow()
    place, weight = found.column(0).to_numpy(), found.column(1).to_numpy()
    w = np.zeros(SIZE, np.float32)
    w[place[place >= 0]] = weight[place >= 0]
    return w, float(weight[place < 0].sum())


def score_texts(texts: list[bytes], weights: np.ndarray, bias: float) -> np.ndarray:
    place, at = features(texts)
    sums = np.concatenate(([0.0], np.cumsum(weights[place], dtype=np.float64)))
    number = np.diff(at)
    mean = (sums[at[1:]] - sums[at[:-1]]) / np.maximum(number, 1)
    return 1 / (1 + np.exp(-np.clip(SCALE * mean + bias, -35, 35)))


def score(df: DataFrame, model: tuple[np.ndarray, float], text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.3) -> DataFrame:
    """The columns `keep` of every row, score (0 to 1) and predicted (1 from threshold on).

    Null, empty and word-less texts get the score of the bias alone. Texts are read in runs of bounded size, a very
    long one by itself. Rows come out as they come in, repeated ones as often; equal texts have equal scores; an
    empty table gives an empty one; a column of `keep` with the name of a new one gives way to it.
    """
    names = kept(keep, "score", "predicted")
    source = df.select(*names, F.col(text).alias(unused(df, "text")[0]))
    schema = df.select(*names).schema.add("score", "double").add("predicted", "integer")
    shared = df.sparkSession.sparkContext.broadcast(model)  # SIZE weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            got = [score_texts(x, weights, bias) for _, x in chunks(batch.column(len(names)))]
            s = np.concatenate(got) if got else np.zeros(0)
            made = [pa.array(s), pa.array((s >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *made], [*names, "score", "predicted"])

    return source.mapInArrow(run, schema)
