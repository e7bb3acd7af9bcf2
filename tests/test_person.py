import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prismara.plans import person

T0 = datetime(2024, 1, 1, 12)
FILES = (
    "file_id long, media_type string, status string, parent_path string, file_name string, mtime timestamp, width int, height int, duration_ms long, person_kind string, person_model string, person_vector array<double>, "
    "person_looks array<struct<kind: string, model: string, v: array<double>>>, has_face string, subject_count string, capture_type string"
)
C = F.col


def made(spark, seed, n=90):
    """Files of few families, directories and facts, with near and far vectors, nulls, and tags of every kind."""
    rng = random.Random(seed)
    base = [[rng.uniform(-1, 1) for _ in range(8)] for _ in range(4)]
    near = lambda: [x + rng.uniform(-0.06, 0.06) for x in rng.choice(base)]
    rows, tags = [], []
    for i in range(n):
        video, seen = rng.random() < 0.3, rng.random() < 0.5
        look = (rng.choice(("person_visual", "image_visual")), rng.choice(("m", "m2", "")), near()) if seen and not video else (None, None, None)
        frames = [(rng.choice(("person_visual", "video_frame_visual")), "m", near()) for _ in range(2)] if seen and video else None
        name = f"{rng.choice(('ann', 'bob_', '', 'IMG-'))}{rng.choice(('', rng.randrange(100)))}.jpg"
        rows.append((i, "video" if video else "image", "active" if i % 13 else "trashed", rng.choice(("/a", "/b", "/c", "")), name, T0 + timedelta(hours=rng.randrange(900)) if i % 11 else None, *rng.choice(((1920, 1080), (640, 480), (1080, 1920), (None, None))), rng.choice((60_000, 90_000)) if video else None, *look, frames, rng.choice(("true", "no", None)), rng.choice(("single", "two", "", None)), rng.choice(("selfie", "photo", None))))
        for name, source in (("Human", "human"), ("Model", "ai"), ("Rule few", "rule"), ("__auto:has_face:true", "auto"), ("portrait", "auto")):
            if rng.random() < (0.04 if name == "Rule few" else 0.5):
                tags.append((i, name, "ai" if source == "human" and rng.random() < 0.3 else source))
    return spark.createDataFrame(rows, FILES), spark.createDataFrame(tags, "file_id long, name string, source string")


def plain(files, tags, th=person.Thresholds()):
    """All pairs of a tag's holders, vectors compared for each."""
    rows = person.facts(files)
    held = tags.join(rows.select("file_id"), "file_id").withColumn("auto", C("source") == "auto")
    many = held.groupBy("name", "auto").agg(F.count("*").alias("holders"))
    side = lambda p: rows.select(C("file_id").alias(f"{p}_id"), *(C(c).alias(f"{p}_{c}") for c in person.FACTS))
    a = held.withColumnRenamed("file_id", "a_id").join(many, ["name", "auto"]).join(side("a"), "a_id")
    met = a.join(held.select(C("file_id").alias("b_id"), "name", "auto").join(side("b"), "b_id"), ["name", "auto"])
    near = person.near_pairs(met.where("a_id <> b_id").select("a_id", "b_id"), files, th)
    met = person.score_pairs(met.join(near, ["a_id", "b_id"], "left").fillna(0.0, ["vector_points"]))
    met = met.where((C("a_id") == C("b_id")) | person._stays(th, C("vector_points") > 0))
    met = met.withColumn("n", F.count("*").over(W.partitionBy("a_id", "name", "source"))).where("n > 1")
    return {(r["a_id"], r["name"], r["source"], r["b_id"]): r["score"] for r in met.collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_expanded_clusters_are_those_of_all_pairs(spark, seed):
    files, tags = made(spark, seed)
    want = plain(files, tags)
    f = person.factorised(files, tags)
    got = person.expand(f).collect()
    assert {(r["anchor_id"], r["name"], r["source"], r["file_id"]): r["score"] for r in got} == want and len(got) == len(want)
    assert any(s == "ai" for _, _, s, _ in want) and any(s == "auto" for _, _, s, _ in want)
    assert f.near.count() > 0
    counts = {}
    for a, name, source, _ in want:
        counts[a, name, source] = counts.get((a, name, source), 0) + 1
    assert {(r["anchor_id"], r["name"], r["source"]): r["n"] for r in person.sizes(f).collect()} == counts
    few = files.where("file_id IN (3, 40)").select("file_id", F.lit("Model").alias("name"))
    assert {(r["anchor_id"], r["file_id"]) for r in person.expand(f, few).collect()} == {(a, b) for a, name, _, b in want if a in (3, 40) and name == "Model"}


def test_ranks_begin_with_the_anchor(spark):
    files, tags = made(spark, 4, 40)
    by = {}
    for r in person.same_person(files, tags).collect():
        by.setdefault((r["anchor_id"], r["name"], r["source"]), []).append(r)
    for (anchor, _, _), rows in by.items():
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and rows[0]["file_id"] == anchor and rows[0]["role"] == "cover"
        assert [(-r["score"], r["file_id"]) for r in rows[1:]] == sorted((-r["score"], r["file_id"]) for r in rows[1:])


def test_a_title_keeps_what_its_last_anchor_found(spark):
    files, tags = made(spark, 5)
    f = person.factorised(files, tags)
    want, titles = plain(files, tags), {}
    for r in person.cluster_titles(f).collect():
        titles.setdefault(r["title"], []).append((r["file_id"], r["name"], r["source"]))
    last = {title: max(x) for title, x in titles.items()}
    assert "person:Human" in titles and any(t.startswith("person_ai:Model:") for t in titles) and any(t.startswith("person_auto:") for t in titles)
    got = {}
    for r in person.stored(f).collect():
        got.setdefault(r["title"], {})[r["file_id"]] = r["score"]
    assert got == {t: m for t, (a, n, s) in last.items() if (m := {b: v for (x, y, z, b), v in want.items() if (x, y, z) == (a, n, s)})}


def test_a_tag_of_very_many_holders_makes_rows_that_grow_as_they_do(spark):
    """20,000 holders: their square would be 400 million."""
    n = 20_000
    x = F.col("id")
    files = spark.range(n).select(
        x.alias("file_id"), F.lit("image").alias("media_type"), F.lit("active").alias("status"), F.concat(F.lit("/d"), x % 3).alias("parent_path"), F.concat(F.lit("f"), (x % 2).cast("string"), F.lit("_"), x.cast("string"), F.lit(".jpg")).alias("file_name"),
        F.lit(T0).alias("mtime"), F.lit(1920).alias("width"), F.lit(1080).alias("height"), *(F.lit(None).cast(k).alias(c) for c, k in (("duration_ms", "long"), ("person_kind", "string"), ("person_model", "string"), ("person_vector", "array<double>"))),
        F.lit(None).cast("array<struct<kind: string, model: string, v: array<double>>>").alias("person_looks"), F.lit("true").alias("has_face"), F.lit("single").alias("subject_count"), F.lit("photo").alias("capture_type"),
    )
    tags = files.select("file_id", F.lit("Human").alias("name"), F.lit("human").alias("source")).union(files.select("file_id", F.lit("Model"), F.lit("ai")))
    f = person.factorised(files, tags)
    assert f.members.count() == 2 * n and f.pairs.count() < 100
    got = {r["source"]: (r["low"], r["high"]) for r in person.sizes(f).groupBy("source").agg(F.min("n").alias("low"), F.max("n").alias("high")).collect()}
    assert got["human"] == (n, n) and got["ai"] == (n, n) or got["ai"][0] < n
    assert person.expand(f, spark.createDataFrame([(7, "Human")], "file_id long, name string")).count() == n


def test_empty(spark):
    files, tags = (spark.createDataFrame([], FILES), spark.createDataFrame([], "file_id long, name string, source string"))
    f = person.factorised(files, tags)
    assert person.expand(f).collect() == [] and person.sizes(f).collect() == [] and person.stored(f).collect() == []


def test_near_vectors_are_kept_by_look_and_not_by_pairs_of_files(spark):
    """A thousand files with two near vectors are two looks, whose pairs are four."""
    rows = [(i, "image", "active", f"/{i}", f"{i}x.jpg", T0, 1920, 1080, None, "image_visual", "m", [0.1, 0.1 + i % 2 / 100], None, None, None, None) for i in range(1000)]
    files = spark.createDataFrame(rows, FILES)
    f = person.factorised(files, files.select("file_id", F.lit("Model").alias("name"), F.lit("ai").alias("source")))
    assert f.near.count() == 4 and {r["n"] for r in person.sizes(f).collect()} == {1000}
