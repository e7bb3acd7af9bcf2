import random

import pytest

import corpus_pipeline
from prismara.llm import components, overlap

from .conftest import words
from .test_simhash import WORD, grouped


def shingles(text, k=5):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or frozenset([tuple(w)] if w else [])


def near(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def kept_of(rows):
    """The ids that stay, by brute force at 0.8; the least of each group."""
    root = grouped([shingles(r[1]) for r in rows], near)
    return sorted(min(r[0] for r, x in zip(rows, root, strict=True) if x == g) for g in set(root))


def texts():
    """Texts with copies in which some words are changed, so that similarities lie on both sides of 0.8."""
    rng, out = random.Random(3), ["", None, " ", "one", "ONE", "one two", *(["a b c d e f g h i j"] * 2), "a b c d e f g h i k"]
    for _ in range(25):
        base = words(rng, rng.randrange(60, 200)).split()
        for changes in (0, 1, 2, 3, 4, 5, 6):
            w = list(base)
            for i in rng.sample(range(len(w)), changes):
                w[i] = f"new{rng.random()}"
            out.append(" ".join(w))
    line = words(rng, 30)
    return out + [f"{words(rng, 90)} {line}" for _ in range(60)]


def test_one_of_each_is_brute_force_at_a_similarity_of_0_8(spark):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert sorted(r["doc_id"] for r in corpus_pipeline.one_of_each(spark, df, "").collect()) == kept_of(rows)


@pytest.mark.parametrize("few", [2, 8])
def test_pairs_do_not_depend_on_frequent_shingles_or_blocks(spark, monkeypatch, few):
    monkeypatch.setattr(overlap, "FEW", few)
    monkeypatch.setattr(overlap, "ONE_IN", 1)
    monkeypatch.setattr(overlap, "BLOCK", 3)
    monkeypatch.setattr(overlap, "LISTED", 2)
    rows = [(i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in overlap.deduplicate(df).collect()) == kept_of(rows)
    assert overlap.deduplicate(df.where("false")).collect() == []


def written(spark, what="shuffleWriteBytes"):
    """Bytes that all stages have shuffled so far."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(getattr(stages.apply(i), what)() for i in range(stages.size()))


def test_candidates_meet_without_their_lists_of_keys(spark):
    rng = random.Random(4)
    rows = [(rng.getrandbits(62), 2 * i + j, 1000, 2 * i + j) for i in range(100) for _ in range(200) for j in range(2)]
    rows = [(rows[k - k % 2][0], *r[1:]) for k, r in enumerate(rows)]  # two sets have each key
    rows = spark.createDataFrame(rows, "key long, fp long, n long, root long")
    before, threshold = written(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as tables of some size have it
    try:
        assert sorted(map(tuple, overlap._candidates(rows, (4, 5)).collect())) == [(2 * i, 2 * i + 1) for i in range(100)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert written(spark) - before < 10_000_000


def test_later_links_are_found_among_roots_alone(spark, monkeypatch):
    rng = random.Random(6)
    first = [(i, rng.randrange(i // 50 * 50, i + 1)) for i in range(500)]  # ten trees of fifty, but for loops
    later = [(49, 51), (3, 120), (130, 1000), (1000, 1001), (2000, 2001), (7, 8)]
    table = lambda rows: spark.createDataFrame(rows, "a long, b long")
    nodes, walked, found = components.connected_components(table(first)), [], components.connected_components
    monkeypatch.setattr(components, "connected_components", lambda edges: walked.append(edges.where("a <> b").distinct().count()) or found(edges))
    got = {}
    for r in components.extended(nodes, table(later)).collect():
        assert got.setdefault(r["node"], r["root"]) == r["root"]
    want = {r["node"]: r["root"] for r in found(table(first + later)).collect()}
    pairs = lambda x: {frozenset(n for n in x if x[n] == r) for r in set(x.values())}
    assert pairs(got) == pairs(want) and walked[0] <= len(later)


def test_candidates_are_not_held_against_prefixes_again(spark, monkeypatch):
    tested, possible = [], overlap._possible
    monkeypatch.setattr(overlap, "_possible", lambda pairs, *more: tested.append(pairs) or possible(pairs, *more))
    df = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in overlap.deduplicate(df).collect()) == kept_of(list(enumerate(texts())))
    assert len(tested) == 2


def test_rounds_do_not_multiply_estimates_of_size(spark):
    """Sizes that grew with each round had hundreds of thousands of digits, which the driver spent its memory on."""
    df = lambda rows: spark.createDataFrame(rows, "a long, b long")
    nodes = components.connected_components(df([(i, i + 1) for i in range(100)]))
    nodes = components.extended(nodes, df([(i, i + 1000) for i in range(0, 100, 5)]))
    assert {r["root"] for r in nodes.collect()} == {nodes.first()["root"]} and nodes.count() == 121
    size = nodes._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert 121 * 16 <= size < 121 * 1000


def test_only_the_most_frequent_shingles_come_to_the_driver(spark, monkeypatch):
    monkeypatch.setattr(overlap, "ONE_IN", 1)
    monkeypatch.setattr(overlap, "FREQUENT", 2000)
    rows = [(" ".join(f"w{j}" for j in range(i % 7, 8000)) + f" {i}",) for i in range(12)]
    df = spark.createDataFrame(rows, "text string").repartition(4)
    before = written(spark, "resultSize")
    frequent = overlap._frequent(df, 5)
    assert len(frequent) == 2000 and (frequent["n"] == 12).all() and (frequent["key"][1:] > frequent["key"][:-1]).all()
    assert written(spark, "resultSize") - before < 100_000  # 2,000 rows of two numbers, and not as many of each partition
