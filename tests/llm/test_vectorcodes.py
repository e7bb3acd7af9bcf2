import hashlib
import math
import random

import numpy as np
import pytest

from prismara.llm import vectorcodes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string, _id string, _v string"


def by_hand(rows, parts, entries, rounds, scale):
    """The contract in plain code, every entry measured."""
    f32 = lambda x: float(np.float32(x))
    ok = [(i, [math.floor(scale * f32(x)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    size = len(min((i, v) for i, v, _ in ok if i is not None and len(v) % parts == 0 and v)[1])
    fit = [(i, v, label) for i, v, label in ok if len(v) == size]
    width = size // parts
    cut = lambda v: [tuple(v[p * width : (p + 1) * width]) for p in range(parts)]
    first = {}
    for i, v, _ in sorted((x for x in fit if x[0] is not None), key=lambda x: (x[0], x[1])):
        first.setdefault(i, v)
    books = [[cut(first[i])[p] for i in sorted(first)[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda p, x: min((far(x, e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        held = [{} for _ in range(parts)]
        for _, v, _ in fit:
            for p, x in enumerate(cut(v)):
                held[p].setdefault(nearest(p, x)[1], []).append(x)
        for p in range(parts):
            for k, xs in held[p].items():
                books[p][k] = tuple(sum(c) // len(xs) for c in zip(*xs, strict=True))
    sha = hashlib.sha256(",".join(str(c) for p in books for e in p for c in e).encode()).hexdigest()
    out, total = [], {}
    for i, v, label in ok:
        found = [nearest(p, x) for p, x in enumerate(cut(v))] if len(v) == size else None
        out.append((i, label, "".join(f"{k:02x}" for _, k in found) if found else None, sum(d for d, _ in found) if found else None))
        if found:
            total[label] = total.get(label, 0) + out[-1][3]
    return sorted(map(repr, ((i, code, e, total.get(label), sha) for i, label, code, e in out)))


def rows_of(rng, n, size):
    return [(i, [rng.choice((0.0, 0.5, rng.uniform(-2, 2), rng.gauss(0, 0.01))) for _ in range(size)], rng.choice((1, 2, 3, None))) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash", "clash") for r in rows], SCHEMA).repartition(5)


def found(df):
    return sorted(repr((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"])) for r in df.collect())


@pytest.mark.parametrize(("seed", "parts", "entries", "rounds"), [(1, 4, 7, 2), (2, 2, 64, 3), (3, 8, 1, 0)])
def test_codes_are_those_of_plain_code(spark, seed, parts, entries, rounds):
    rng = random.Random(seed)
    rows = rows_of(rng, 150, 16)
    rng.shuffle(rows)
    odd = [(500, None, 1), (501, [None] * 16, 1), (502, [float("nan")] * 16, 1), (503, [float("inf")] * 16, 2), (504, [0.1] * 8, 2), (505, [0.1] * 5, 9), (506, [], 2), (None, [0.2] * 16, None)]
    same = [rows[0], rows[0], (rows[1][0], [0.25] * 16, 2)]  # rows again, and an id with another vector
    rows = rows + odd + same
    assert found(vectorcodes.compress(frame(spark, rows), parts=parts, entries=entries, rounds=rounds)) == by_hand(rows, parts, entries, rounds, 256)


def test_annulus_misses_no_entry():
    """Against every entry, with ties, equal norms, and entries on the edge."""
    rng = np.random.default_rng(4)
    for size in (1, 3, 64):
        entries = rng.integers(-6, 7, (size, 3))
        x = np.concatenate((rng.integers(-9, 10, (500, 3)), entries, rng.integers(-(1 << 24), 1 << 24, (200, 3))))
        at, squared = vectorcodes.Codebook(entries).nearest(x)
        every = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert (squared == every.min(axis=1)).all() and (at == every.argmin(axis=1)).all()


def test_labels_by_a_join_if_they_are_many(spark, monkeypatch):
    rows = rows_of(random.Random(9), 60, 16)
    want = found(vectorcodes.compress(frame(spark, rows)))
    monkeypatch.setattr(vectorcodes, "FEW", 1)
    assert found(vectorcodes.compress(frame(spark, rows))) == want == by_hand(rows, 16, 64, 2, 256)


def test_large_components_and_empty_tables(spark):
    assert vectorcodes.compress(frame(spark, [])).collect() == []
    rows = [(1, [1e30] * 16, 1), (2, [0.5] * 16, 1), (3, [0.5] * 32, None)]
    got = {r["vec_id"]: (r["code"], r["error"], r["label_error"]) for r in vectorcodes.compress(frame(spark, rows)).collect()}
    assert got == {1: (None, None, 0), 2: ("00" * 16, 0, 0), 3: (None, None, None)}
    assert {r["code"] for r in vectorcodes.compress(frame(spark, [(1, [1.0] * 3, 1), (None, [1.0] * 16, 1)])).collect()} == {None}
