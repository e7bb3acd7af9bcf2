import random
from datetime import datetime, timedelta

from prismara.llm import urls

AT = datetime(2024, 1, 1)


def test_entries_of_any_depth_and_case_match(spark):
    entries = spark.createDataFrame([("l", p, "block", AT) for p in ("example.com/a/b/c/d", "other.org/News", "deep.net/1/2/3/4/5/6/7/", "Parent.example", "[::1]")], "list string, pattern string, action string, at timestamp")
    urls_of = {
        "http://example.com/a/b/c/d/e": "example.com/a/b/c/d", "http://example.com/a/b/c": None, "https://other.org/News/x": "other.org/news", "https://Other.org/news": "other.org/news",
        "http://other.org/newsroom": None, "http://deep.net/1/2/3/4/5/6/7/8?q": "deep.net/1/2/3/4/5/6/7", "http://a.b.PARENT.example/x": "parent.example", "http://notparent.example/": None, "http://[::1]:80/x": "[::1]", "http://example.com/A//b/C/D": "example.com/a/b/c/d",
    }
    captures = spark.createDataFrame([(i, u, AT) for i, u in enumerate(urls_of)], "page_id long, url string, at timestamp")
    got = {r["capture_id"]: r["pattern"] for r in urls.judge(captures, entries).collect()}
    assert got == dict(enumerate(urls_of.values()))


def test_as_of_a_pattern_that_is_switched_often(spark):
    """A hot host among lists that switch at the very times of captures, dealt to many orders, against a walk over the entries."""
    rng = random.Random(5)
    day = lambda n: AT + timedelta(days=n)
    entries = [(l, p, rng.choice(("block", "allow", "remove")), day(n)) for l in ("a", "b") for p in ("hot.com", "hot.com/x", "cold.org") for n in rng.sample(range(60), 40)]
    captures = [(i, rng.choice(["http://hot.com/x/1"] * 5 + ["http://hot.com/", "http://cold.org/", "http://none.net/"]), None if i % 50 == 0 else day(rng.randrange(-3, 63))) for i in range(400)]
    captures += captures[:7]
    e = spark.createDataFrame(entries, "list string, pattern string, action string, at timestamp")
    c = spark.createDataFrame([(*x, "clash") for x in captures], "page_id long, url string, at timestamp, pattern string")

    def wanted(url, at):
        found = []
        for l, p in {(l, p) for l, p, _, _ in entries}:
            past = [(t, a) for l2, p2, a, t in entries if (l2, p2) == (l, p) and at is not None and t <= at]
            if url.removeprefix("http://").rstrip("/").startswith(p) and past and max(past)[1] != "remove":
                found.append((-len(p), max(past)[1] != "allow", l, max(past)[1], p))
        return min(found)[2:] if found else (None, "none", None)

    got = sorted(((r["capture_id"], r["list"], r["verdict"], r["pattern"]) for r in urls.judge(c, e).collect()), key=str)
    assert got == sorted(((i, *wanted(u, t)) for i, u, t in captures), key=str)
    small = urls.as_of(c.select(c.page_id.alias("capture_id"), "url", "at").withColumn("pattern", urls.host(c.url)).where("at IS NOT NULL"), urls.intervals(e), most=1)
    large = urls.as_of(c.select(c.page_id.alias("capture_id"), "url", "at").withColumn("pattern", urls.host(c.url)).where("at IS NOT NULL"), urls.intervals(e))
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect())) and small.count() > 0
