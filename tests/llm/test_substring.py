import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from prismara.llm import substring
from prismara.llm.fmindex import FMIndex

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, window):
    lists = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in lists for i in range(len(w) - window + 1))
    out = []
    for w in lists:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append([x for i, x in enumerate(w) if i not in gone])
    return lists, out


@pytest.mark.parametrize("finer", [((256, 7), (65_536, 1)), ((2, 7), (4, 1))])
def test_removes_what_brute_force_removes(docs, rows, finer, monkeypatch):
    monkeypatch.setattr(substring, "FINER", finer)
    lists, kept = brute([r[1] for r in rows], 35)
    want = sorted((repr(r[0]), len(w), len(w) - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest()) for r, w, k in zip(rows, lists, kept, strict=True))
    got = substring.remove_repeated(docs, window=35).collect()
    assert sorted((repr(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == want


def test_without_repeated_keeps_rows_and_columns(docs, rows):
    got = substring.without_repeated(docs)
    assert got.columns == docs.columns
    lists, kept = brute([r[1] for r in rows], 35)
    want = sorted((repr(r[0]), repr(r[1] if w == k else " ".join(k))) for r, w, k in zip(rows, lists, kept, strict=True))
    assert sorted((repr(r["doc_id"]), repr(r["text"])) for r in got.collect()) == want


def test_segments_and_whole_texts_are_dealt_in_jobs_of_their_own(docs):
    plan = substring.without_repeated(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "cid" not in plan and "route" not in plan


def test_empty_table_and_window_bounds(empty):
    assert substring.remove_repeated(empty).collect() == []
    assert substring.without_repeated(empty).collect() == []
    with pytest.raises(ValueError):
        substring.remove_repeated(empty, window=8)


@pytest.mark.parametrize("seed", range(4))
def test_index_counts_occurrences(seed):
    rng = random.Random(seed)
    lists = [[rng.randrange(1, 4 + seed * 20) for _ in range(rng.randrange(1, 62))] for _ in range(60)]
    weights = [rng.randrange(1, 3) for _ in lists]
    lengths = np.array([len(x) for x in lists])
    index = FMIndex(np.array([s for x in lists for s in x]), lengths, np.array(weights), int(lengths.max()))
    for _ in range(200):
        x = rng.choice(lists)
        i = rng.randrange(len(x))
        pattern = x[i : i + rng.randrange(1, 12)] + ([rng.randrange(1, 4)] if rng.random() < 0.3 else [])
        lo, hi = np.array([0]), np.array([index.size])
        for s in reversed(pattern):
            lo, hi = index.extend(np.array([s]), lo, hi)
        want = sum(w * sum(y[j : j + len(pattern)] == pattern for j in range(len(y))) for y, w in zip(lists, weights, strict=True))
        assert index.weights[hi[0]] - index.weights[lo[0]] == want
    for window in (3, 6):
        seen = Counter()
        for y, w in zip(lists, weights, strict=True):
            for j in range(len(y) - window + 1):
                seen[tuple(y[j : j + window])] += w
        want = [sum(1 << j for j in range(len(y) - window + 1) if seen[tuple(y[j : j + window])] > 1) for y in lists]
        assert index.repeated(lengths, window).tolist() == want
