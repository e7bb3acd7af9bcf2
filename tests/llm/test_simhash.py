import re

import xxhash
from pyspark.sql import functions as F

from prismara.llm import components, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text, k=4):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(text)
    grams = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(items, near):
    """item number -> the least number it is linked to."""
    parent = list(range(len(items)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if near(items[i], items[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(items))]


def test_fingerprints_and_components_are_those_of_brute_force(docs, rows):
    got = simhash.near_duplicates(docs).collect()
    fps = [brute(r[1]) for r in rows]
    root = grouped(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for r, g in zip(rows, root, strict=True):
        if r[0] is not None:
            least[g] = min(r[0], least.get(g, r[0]))
    want = sorted((repr(r[0]), f, repr(least.get(g))) for r, f, g in zip(rows, fps, root, strict=True))
    assert sorted((repr(r["doc_id"]), r["fp"] % 2**64, repr(r["component_id"])) for r in got) == want


def test_links_reach_every_pair_within_the_limit_even_if_keys_are_too_large(spark):
    import random

    rng = random.Random(1)
    centre = [rng.getrandbits(64) for _ in range(6)]
    fps = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for c in centre for _ in range(60)})
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    root = grouped(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    for most in (50_000, 8):
        got = {r["node"] % 2**64: r["root"] for r in components.connected_components(simhash.links(df, 4, 6, most)).collect()}
        for i, f in enumerate(fps):
            for j in range(i):
                same = got.get(f, f) == got.get(fps[j], fps[j])
                assert same == (root[i] == root[j])


def test_components_of_long_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5), (2000, 2000), (None, 3), (301, 300)]
    got = {}
    for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect():
        got.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(sorted, got.values())) == [list(range(302)), list(range(1000, 1100))]


def test_empty_tables(empty):
    assert simhash.near_duplicates(empty).collect() == []
    assert components.connected_components(empty.select(F.col("doc_id").alias("a"), F.col("n_chars").alias("b"))).collect() == []
