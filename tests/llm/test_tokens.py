import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from prismara.llm import bpe, tokencount

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}


def library(ranks, pattern=P.PATTERN):
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_round_trip_is_the_librarys(docs, rows):
    enc = library(RANKS)
    want = []
    for r in rows:
        ids = enc.encode_ordinary(r[1] or "")
        want.append((repr(r[0]), len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    got = bpe.round_trip(docs, PATH, P.PATTERN).collect()
    assert sorted((repr(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == sorted(want)


def test_encode_and_decode_columns(docs, rows):
    df = bpe.decode(bpe.encode(docs, PATH, P.PATTERN), PATH, P.PATTERN)
    assert df.columns == [*docs.columns, "ids", "decoded"]
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in df.collect())
    assert bpe.encode(df, PATH, P.PATTERN).columns == [*docs.columns, "decoded", "ids"]


@pytest.mark.parametrize("seed", range(6))
def test_merges_of_odd_vocabularies(seed):
    """Ranks out of order, so that a merge may make a pair of lower rank, and long runs of few letters."""
    rng = random.Random(seed)
    pieces = {bytes([b]) for b in range(256)}
    while len(pieces) < 300:
        pieces.add(bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 6))))
    order = sorted(p for p in pieces if len(p) > 1)
    rng.shuffle(order)
    ranks = {p: i for i, p in enumerate([bytes([b]) for b in range(256)] + order)}
    codec, enc = bpe.Codec(ranks, r"(?s:.+)"), library(ranks, r"(?s:.+)")
    texts = ["".join(rng.choice("abc"[: 1 + seed % 3]) for _ in range(rng.randrange(300))) for _ in range(40)]
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert ids.tolist() == enc.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def greedy(word, pieces):
    n = 0
    while word:
        size = next(k for k in range(min(len(word), 130), 0, -1) if word[:k] in pieces)
        word, n = word[size:], n + 1
    return n


def test_counts_are_those_of_greedy_matching(docs, rows):
    import re

    got = tokencount.token_counts(docs, PATH).collect()
    want = []
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")
        want.append((repr(r[0]), len(words), sum(greedy(b" " + w.encode(), RANKS) for w in words)))
    assert sorted((repr(r["doc_id"]), r["n_words"], r["n_tokens"]) for r in got) == sorted(want)


def test_automaton_on_random_words():
    rng = random.Random(2)
    pieces = {bytes([b]) for b in range(256)} | {bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 7))) for _ in range(80)}
    words = [bytes(rng.choice(b"abcd") for _ in range(rng.randrange(60))) for _ in range(300)]
    assert tokencount.Automaton(sorted(pieces)).count(words).tolist() == [greedy(w, pieces) for w in words]


def test_long_words_are_counted_like_short_ones():
    rng = random.Random(4)
    pieces = {bytes([b]) for b in range(256)} | {bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 9))) for _ in range(120)}
    automaton = tokencount.Automaton(sorted(pieces))
    words = [bytes(rng.choice(b"abc") for _ in range(n)) for n in (20_000, 9_000, *range(1, 60))]
    assert automaton.count(words).tolist() == [greedy(w, pieces) for w in words]
    assert automaton.count([]).tolist() == [] and automaton.count([b"", b"a"]).tolist() == [0, 1]


def test_bytes_that_are_no_utf8_do_not_end_the_job(spark):
    odd = spark.sql("SELECT 1L AS doc_id, CAST(X'61FFFE62' AS STRING) AS text")
    assert bpe.round_trip(odd, PATH, P.PATTERN).first()["n_tokens"] > 0 and tokencount.token_counts(odd, PATH).first()["n_words"] == 1


def test_empty_tables(empty):
    assert bpe.round_trip(empty, PATH, P.PATTERN).collect() == []
    assert tokencount.token_counts(empty, PATH).collect() == []
