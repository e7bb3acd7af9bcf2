import hashlib
import math
from collections import Counter

import corpus_pipeline
import pytest
import tiktoken  # noqa: F401  the library that the last stage is held against, by test_tokens
from prismara.llm import langid, mixing, substring
from prismara.llm._shared import cut, shared_table
from pyspark.sql import functions as F

from .test_overlap import near, shingles
from .test_simhash import grouped
from .test_substring import brute as left_words
from .test_tokens import RANKS, library


def test_stages_by_brute_force(spark, docs, rows):
    """Each stage on what the one before it kept, with columns that clash, against plain code."""
    stage = dict(corpus_pipeline.STAGES)
    rows = [tuple(r) for r in docs.collect()]
    columns = docs.columns

    one = stage["language_id"](spark, docs, "")
    assert one.columns == columns
    model = langid.fit(docs, F.lit(True))
    want = []
    for r in rows:
        lang, _, rejected = model.predict([(r[1] or "").encode()])
        if r[1] and any(c.isalpha() for c in r[1]) and not rejected[0]:
            want.append(r)
    kept = [tuple(r) for r in one.collect()]
    assert sorted(map(repr, kept)) == sorted(map(repr, want)) and len(kept) > 40

    two = stage["simhash_near_dedup"](spark, one, "")
    assert two.columns == columns
    root = grouped([shingles(r[1]) for r in kept], near)
    order = lambda r: (r[0] is None, r[0] or 0)
    least = Counter(repr(min((order(r) for r, x in zip(kept, root, strict=True) if x == g))) for g in set(root))
    singles = [tuple(r) for r in two.collect()]
    assert Counter(repr(order(r)) for r in singles) == least

    three = stage["substring_dedup"](spark, two, "")
    assert three.columns == columns
    lists, left = left_words([r[1] for r in singles], 35)
    texts = [r[1] if w == k else " ".join(k) for r, w, k in zip(singles, lists, left, strict=True)]
    want = sorted(repr((r[0], x, *r[2:4], len(x), *r[5:])) for r, x in zip(singles, texts, strict=True))
    assert sorted(repr(tuple(r)) for r in three.collect()) == want
    assert {r["n_removed"] for r in substring.remove_repeated(three).collect()} == {0}

    four = stage["source_mixing"](spark, three, "")
    assert four.columns == columns
    times = Counter()
    for r in mixing.mix(three).collect():
        times[repr(r["doc_id"])] += 1 if not r["size"] else math.floor(r["taken"] / r["size"] + 0.5)
    assert Counter(repr(r["doc_id"]) for r in four.collect()) == +times

    five = stage["byte_bpe"](spark, four, "").collect()
    enc = library(RANKS)
    want = []
    for r in four.collect():
        ids = enc.encode_ordinary(r["text"] or "")
        want.append((repr(r["doc_id"]), len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert sorted((repr(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in five) == sorted(want)


def test_empty_documents(spark, empty):
    df = empty
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, "")
    assert df.collect() == []


def test_all_eleven_are_registered():
    import __spark_entry__
    from prismara.llm import queries

    names = set(__spark_entry__.queries())
    assert set(queries.QUERIES) | {"pipeline"} <= names and [sum(x.startswith(f"op{n}_") for x in names) for n in range(1, 11)] == [1] * 10


def shuffle_files(spark):
    """How many files of shuffles the session's local folders hold."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


@pytest.mark.parametrize("settle", [cut, lambda df: shared_table(df, "test")])
def test_what_is_settled_leaves_no_shuffle_files(spark, settle):
    df = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count()
    before, setting = shuffle_files(spark), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    got = settle(df)
    assert shuffle_files(spark) <= before
    assert got.count() == 10 and df.count() == 10
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == setting
