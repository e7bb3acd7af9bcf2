import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismara.llm import media, mixing, topk, urls
from prismara.llm._shared import join_hot

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_mix_meets_targets(docs, rows):
    got = mixing.mix(docs, block=16).collect()
    assert len(got) == len(rows)
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["source_size"] is not None
    assert sum(size.values()) == sum(len(WORD.findall(r[1] or "")) for r in rows)
    names = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, left = set(), 1.5 * sum(size.values())
    while over := {s for s in names if s not in full and left * weight[s] / sum(weight[x] for x in names if x not in full) > 2 * size[s]}:
        full |= over
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in full)
        if len(full) == len(names):
            break
    for s in names:
        want = 2 * size[s] if s in full else left * weight[s] / sum(weight[x] for x in names if x not in full)
        assert target[s] == pytest.approx(want)
        assert taken[s] == math.floor(target[s])
    again = mixing.mix(docs.repartition(5), block=7).collect()
    key = lambda rs: sorted((repr(r["doc_id"]), r["size"], r["taken"]) for r in rs)
    assert key(again) == key(got)


def test_schedule_is_even_and_complete(spark):
    plan = spark.createDataFrame([("a", 1000, 2000.0), ("b", 5000, 1234.0), (None, 10, 7.0), ("d", 10, 0.0)], "source string, source_size long, target double")
    slots = mixing.schedule(plan, 10).collect()
    taken = defaultdict(int)
    for s in slots:
        taken[s["source"]] += s["take"]
    assert taken == {"a": 2000, "b": 1234, None: 7}
    order = [s["source"] for s in sorted(slots, key=lambda s: s["slot"])]
    for n in range(1, len(order)):  # every prefix holds each source's share
        assert all(abs(order[:n].count(x) - n * order.count(x) / len(order)) <= 4 for x in ("a", "b", None))


def test_slots_are_those_of_the_schedule(docs, rows):
    """Each document's first slot, from the schedule and the shuffled order by hand."""
    got = mixing.mix(docs, block=16).collect()
    target = {r["source"]: (r["source_size"], r["target"]) for r in got}
    plan = docs.sparkSession.createDataFrame([(s, *x) for s, x in target.items()], "source string, source_size long, target double")
    slots = mixing.schedule(plan, 16).collect()
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    order = defaultdict(list)
    for r in rows:
        order[r[3]].append((md5(f"{'null' if r[0] is None else r[0]} {'null' if r[1] is None else md5(r[1])}"), len(WORD.findall(r[1] or "")), repr(r[0])))
    want = []
    for source, own in order.items():
        at = 0
        for _, size, name in sorted(own):
            over = [(s["slot"], min(at + size, s["block"] * 16 + s["take"]) - max(at, s["block"] * 16)) for s in slots if s["source"] == source]
            over = [x for x in over if x[1] > 0]
            want.append((name, size, sum(x[1] for x in over), min((x[0] for x in over), default=None)))
            at += size
    assert sorted(want, key=repr) == sorted(((repr(r["doc_id"]), r["size"], r["taken"], r["slot"]) for r in got), key=repr)


def test_mixture_holds_whole_copies_in_order(docs, rows, empty):
    got = mixing.mixture(docs, block=16)
    assert got.columns == docs.columns
    by = Counter((repr(r["doc_id"]), repr(r["text"]), repr(r["source"])) for r in got.collect())
    want = Counter()
    for r in mixing.mix(docs, block=16).collect():
        n = 1 if not r["size"] else math.floor(r["taken"] / r["size"] + 0.5)
        want[(repr(r["doc_id"]), r["size"], repr(r["source"]))] += n
    size = lambda text: len(WORD.findall("" if text == "None" else eval(text)))
    have = Counter()
    for (i, text, source), n in by.items():
        have[(i, size(text), source)] += n
    assert have == +want
    assert mixing.mix(empty).collect() == [] and mixing.mixture(empty).collect() == []


@pytest.mark.parametrize("cell_rows", [1 << 17, 64])
def test_top_k_is_brute_force(spark, cell_rows):
    rng = random.Random(8)
    vector = lambda: [rng.choice((rng.uniform(-1, 1), 0.5, 0.0)) for _ in range(6)]
    rows = [(i, vector(), 1) for i in range(400)] + [(401, None, 1), (402, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (403, [float("nan")] * 6, 1), (404, [float("inf")] * 6, 1), (None, vector(), 1), (405, [0.0] * 6, 1), (406, [0.0] * 6, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 20 == 0, k=20, cell_rows=cell_rows).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    good = {r["vec_id"]: [math.floor(64 * x) for x in r["embedding"]] for r in df.where("vec_id < 401 OR vec_id > 404").collect()}
    for q in range(0, 400, 20):
        want = sorted(((-sum(a * b for a, b in zip(good[q], v, strict=True)), i) for i, v in good.items() if i != q))[:20]
        assert got[q] == [(i, -s) for s, i in want]
    assert len(got) == 20
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(few, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, (64 * 3 * 64 + 128 * 4 * 64))]
    assert topk.top_k(few.where("false"), F.lit(True)).collect() == []


def test_queries_stop_before_they_have_read_all():
    rng = np.random.default_rng(2)
    rows = np.floor(64 * np.repeat(rng.normal(size=(300, 32)) * (rng.random((300, 32)) < 0.1) * 4 + 0.0, 20, axis=0) + rng.integers(-2, 3, (6000, 32)))
    lists = topk.Lists(rows, np.arange(6000))
    read = []
    for q in range(0, 6000, 100):
        best, score, n = lists.top_k(rows[q], q, 10)
        exact = rows @ rows[q]
        exact[q] = -np.inf
        want = np.lexsort((np.arange(6000), -exact))[:10]
        assert best.tolist() == want.tolist() and score.tolist() == exact[want].tolist()
        few, kept, fewer = lists.top_k(rows[q], q, 10, floor=score[4])
        assert fewer <= n and set(best[score >= score[4]]) <= set(few)
        read.append(n)
    assert np.mean(read) < 0.6 * 6000


def described(payload):
    parts = ",".join(str(sum(b // 16 == i for b in payload)) for i in range(16))
    return f"rows={len(payload) // 64};min={min(payload)};max={max(payload)};sum={sum(payload)};squares={sum(b * b for b in payload)};parts={parts}"


def test_archive_round_trip(docs, rows):
    got = media.archive(docs).collect()
    assert len(got) == len(rows)
    want = []
    for r in rows:
        raw = (r[1] or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        stored = b"P5\n64 %d\n255\n" % (len(payload) // 64) + payload  # a portable greymap by its definition
        want.append((repr(r[0]), len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), described(payload)))
    names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    assert sorted((repr(r["doc_id"]), *(r[n] for n in names)) for r in got) == sorted(want)


def test_pages_become_sequences(spark, empty):
    html = "<title>T</title><p>one <b>two</b><img src=' a.png ' alt='A'>three<figure><figcaption>First  cap</figcaption><video src='v.mp4'></video></figure><figure><img src='sha256:" + "0" * 64 + "'><figcaption>Cap &amp; tion</figcaption></figure><script>no()</script><p>end"
    items = media.parse(html)
    assert [(i["position"], i["kind"], i["text"] or i["ref"], i["caption"]) for i in items] == [
        (0, "text", "T", None), (1, "text", "one two", None), (2, "media", "a.png", "A"), (3, "text", "three", None), (4, "media", "v.mp4", "First cap"),
        (5, "media", "sha256:" + "0" * 64, "Cap & tion"), (6, "text", "end", None),
    ]
    df = spark.createDataFrame([(1, html, "x"), (2, None, "x"), (3, "", "x"), (4, "<p<<>&#;</figure></p", "x")], "doc_id long, html string, items string")
    out = media.sequences(df)
    assert out.columns == ["doc_id", "html", "items"] and {r["doc_id"]: len(r["items"]) for r in out.collect()}[1] == 7
    store = spark.createDataFrame([("0" * 64, "found")], "digest string, feature string")
    shown = {r["position"]: r["feature"] for r in media.resolve(media.shown(out), store).collect()}
    assert shown == {2: None, 4: None, 5: "found"}
    assert media.archive(empty).collect() == []


def test_no_text_is_lost():
    said = lambda html: [(i["kind"], i["text"] or i["ref"], i["caption"]) for i in media.parse(html)]
    text = lambda *x: [("text", t, None) for t in x]
    assert said("<p>a<figcaption>b<p>c<p>d") == text("a", "b", "c", "d")
    assert said("<figcaption>alone</figcaption>x") == text("alone", "x")
    assert said("<figure>in<figcaption>cap</figcaption></figure>after") == text("in", "cap", "after")
    assert said("a<noscript>b<img src='i'>") == [*text("ab"), ("media", "i", None)]
    assert said("a<template><p>b") == text("a", "b")
    assert said("a<noscript>hid</noscript>b<style>p</style>c") == text("abc")
    assert said("<figure><img src='i'><figcaption>one <p>two</figcaption></figure>") == [("media", "i", "one two")]
    assert said("<figure><figure><img src='i'><figcaption>in</figcaption></figure><img src='o'><figcaption>out</figcaption></figure>") == [("media", "i", "out"), ("media", "o", "out")]


@pytest.mark.parametrize("seed", range(5))
def test_sequences_are_what_pages_are_made_of(seed):
    """Pages written from known items; positions, order and captions come back."""
    rng, want, html = random.Random(seed), [], []
    for i in range(60):
        kind, word = rng.randrange(5), f"w{i} v{rng.randrange(9)}"
        if kind == 0:
            html.append(f"<p>{word}</p>")
            want.append(("text", word, None))
        elif kind == 1:
            html.append(f"<img src='{i}.png' alt='alt {i}'>")
            want.append(("media", f"{i}.png", f"alt {i}"))
        elif kind == 2:
            html.append(f"<figure><figcaption>cap <b>{i}</b></figcaption><video src='{i}.mp4'></video></figure>")
            want.append(("media", f"{i}.mp4", f"cap {i}"))
        elif kind == 3:
            html.append(f"<figure><img src='{i}a'><img src='{i}b'><figcaption>both {i}</figcaption></figure>")
            want += [("media", f"{i}a", f"both {i}"), ("media", f"{i}b", f"both {i}")]
        else:
            html.append(rng.choice(("<!-- no -->", "<script>if (a<b) x('</p>')</script>", "<style>p{}</style>", "<hr>")))
    got = media.parse("".join(html))
    assert [i["position"] for i in got] == list(range(len(got)))
    assert [(i["kind"], i["text"] or i["ref"], i["caption"]) for i in got] == want


def test_illustrated_pages_resolve(spark):
    pages = [(1, "http://a/1", "<p>one<br>two</p><p>x"), (2, "http://a/2" + "y" * 80, "<br><br>"), (3, None, "<p>z"), (4, "http://a/4", None), (None, "u", "<br>t"), (2, "http://a/2" + "y" * 80, "<br><br>")]
    got = {repr(r["page_id"]): r for r in media.illustrated(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    sha = lambda *x: hashlib.sha256("\n".join(x).encode()).hexdigest()
    want = {"1": (4, 1, "1", "page 1", sha("one", "two", "x"), 64), "2": (2, 2, "0|1", "page 2|page 2", sha(), 256), "3": (1, 0, "", "", sha("z"), 0), "4": (0, 0, "", "", sha(), 0), "None": (2, 1, "0", "page ?", sha("t"), 64)}
    assert {k: tuple(r)[1:] for k, r in got.items()} == want


def test_hot_keys_join_like_any_other(spark):
    rows = spark.range(6000).select("id", F.when(F.col("id") < 4000, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.col("id").cast("string")).alias("key"))
    facts = spark.range(4000, 5000).select(F.col("id").cast("string").alias("key"), F.lit("x").alias("fact")).union(spark.sql("SELECT 'hot', 'h'"))
    for how in ("inner", "left"):
        want = rows.join(facts, "key", how).select("id", "key", "fact")
        got = join_hot(rows, facts, "key", how).select("id", "key", "fact")
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def day(n):
    return datetime(2024, 1, n)


def test_entries_hold_from_their_date_until_the_next(spark):
    entries = spark.createDataFrame(
        [("l", "Spam.example.com", "block", day(5)), ("l", "spam.example.com", "remove", day(10)), ("l", "spam.example.com", "block", day(20)), ("m", "example.com/ok", "allow", day(1)),
         ("m", "example.com", "block", day(3)), ("l", None, "block", day(1)), ("l", "x.org", "block", None), ("m", "example.com", "block", day(3)), ("z", "tie.org", "block", day(2)), ("y", "tie.org", "allow", day(2))],
        "list string, pattern string, action string, at timestamp",
    )
    rows = [
        (1, "http://spam.example.com/a", day(4), "block"), (2, "http://SPAM.example.com:80/a?b#c", day(5), "block"), (3, "https://spam.example.com/a", day(10), "block"), (4, "https://spam.example.com", day(2), "none"),
        (5, "http://example.com/ok/more", day(9), "allow"), (6, "http://user@example.com/no", day(9), "block"), (7, "http://other.org/", day(9), "none"), (8, None, day(9), "none"), (9, "not a url", day(9), "none"),
        (10, "http://x.org/", day(9), "none"), (11, "http://tie.org/", day(2), "allow"), (12, "http://example.com/", None, "none"), (11, "http://tie.org/", day(2), "allow"),
    ]
    captures = spark.createDataFrame([(*r[:3], "x") for r in rows], "page_id long, url string, at timestamp, list string")
    got = urls.judge(captures, entries)
    assert sorted((r["capture_id"], r["verdict"]) for r in got.collect()) == sorted((r[0], r[3]) for r in rows)
    by = {r["capture_id"]: (r["list"], r["pattern"]) for r in got.collect()}
    assert by[1] == ("m", "example.com") and by[2] == ("l", "spam.example.com") and by[3] == ("m", "example.com") and by[5] == ("m", "example.com/ok")
    assert {r["verdict"] for r in urls.judge(captures, entries.where("false")).collect()} == {"none"}
    assert urls.judge(captures.where("false"), entries).collect() == []
