import random

import pytest

#: Columns that are called like what operators make, or like names they might use on the way.
CLASH = ("score", "fp", "kept", "lang_pred", "rejected", "predicted", "n_tokens", "n_words", "ids_sha256", "decoded_sha256", "key", "k", "s", "slot", "times", "_k1", "_k2", "_n", "_key", "_text", "id", "part", "digest", "held_out")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Null ids, texts, languages and sources, empty and very long texts, copies, near copies and shared passages."""
    rng = random.Random(5)
    passage = words(rng, 60)
    base = words(rng, 300)
    texts = [None, "", " \t\n", "one", "One", "a b c d", "a b c d", "\x85 x　y z", "naïve 日本語 \U0001f642 don't", "\x00 a \x00 b"]
    texts += [words(rng, rng.randrange(1, 120)) for _ in range(40)]
    texts += [words(rng, 50) + " " + passage + " " + words(rng, 20) for _ in range(4)] + [passage, passage + " tail"]
    texts += [base] * 3 + [base.replace(f" {base.split()[i]} ", " changed ", 1) for i in (7, 150)]
    texts += ["line of words " * 40, "x" * 5000, words(rng, 20_000, 5000)]
    out = [(i, t, ("en", "de", None)[i % 3], ("s1", "s2", "s3", None)[i % 4], len(t or ""), *["clash"] * len(CLASH)) for i, t in enumerate(texts)]
    out += [(None, "no id at all", "en", "s1", 3, *["clash"] * len(CLASH)), (None,) * (5 + len(CLASH)), out[7], out[7], (7, "same id, other text", "en", "s1", 1, *["other"] * len(CLASH))]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
