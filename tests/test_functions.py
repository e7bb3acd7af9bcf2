import hashlib

import pytest
from pyspark.sql import functions as F

from prismara.functions import hashing, labels, media, search, vectors
from prismara.plans import ingest


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {v}" for k, v in TYPES(values).items())) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def TYPES(values):
    return {k: {int: "long", float: "double", bool: "boolean"}.get(type(v), "array<double>" if isinstance(v, list) else "binary" if isinstance(v, bytes) else "string") for k, v in values.items()}


def quality(spark, **given):
    row = {"m": "video", "w": None, "h": None, "b": None, "f": None, "d": None, "c": "", "k": ""} | given
    df = spark.createDataFrame([tuple(row.values())], "m string, w int, h int, b long, f double, d long, c string, k string")
    return df.select(media.quality_score(*(F.col(x) for x in ("m", "w", "h", "b", "f", "d", "c", "k"))).alias("s")).first()["s"]


@pytest.mark.parametrize(("given", "score"), [
    ({"m": "image", "w": 1920, "h": 1080}, 65), ({"w": 3840, "h": 2160, "b": 8_000_000, "f": 29.97, "d": 90_000, "c": "h264", "k": "mp4"}, 100),
    ({"w": 1280, "h": 720, "b": 700_000, "f": 15.0, "d": 30_000, "c": "h264", "k": "mp4"}, 60), ({"m": "image"}, 20), ({"m": "image", "w": 100, "h": 100}, 28),
])
def test_quality_scores(spark, given, score):
    assert quality(spark, **given) == score


def test_tier_and_summary(spark):
    tiers = spark.createDataFrame([(74.9,), (75.0,), (45.0,), (44.0,)], "s double").select(media.quality_tier(F.col("s"))).collect()
    assert [r[0] for r in tiers] == ["medium", "high", "medium", "low"]
    df = spark.createDataFrame([("video", "high", 1920, 1080, "", "mp4", "h264", 8_000_000, 29.97), ("image", "low", None, None, None, None, None, None, None), ("video", "low", 10, 10, "", "mkv", "", 1500, None)], "m string, t string, w int, h int, f string, k string, c string, b long, r double")
    got = [r[0] for r in df.select(media.quality_summary(*(F.col(x) for x in ("m", "t", "w", "h", "f", "k", "c", "b", "r")))).collect()]
    assert got == ["video quality high, 1920x1080 • mp4 h264 • 8.0 Mbps • 29.97 fps.", "image quality low, unknown • image.", "video quality low, 10x10 • mkv • 1 Kbps."]


@pytest.mark.parametrize(("name", "series", "person"), [("Model_A-001.JPG", "model-a", "model_a"), ("IMG001.png", "img001", "img"), ("a b 12-34.x.mp4", "a-b-12-34-x", "a b 12-34.x"), ("007.jpg", "007", "")])
def test_families(spark, name, series, person):
    df = spark.createDataFrame([(name,)], "n string")
    assert tuple(df.select(media.series_family(F.col("n")), media.person_family(F.col("n"))).first()) == (series, person)


def test_geometry(spark):
    df = spark.createDataFrame([(1920, 1080, 1440, 1080)], "a int, b int, c int, d int")
    w = [F.col(x) for x in "abcd"]
    assert tuple(df.select(media.aspect_close(*w), media.aspect_close(*w, by_side=True), media.same_orientation(*w), media.ratio_close(F.lit(58), F.lit(60), 0.85), media.ratio_close(F.lit(0), F.lit(60), 0.85), media.ratio_close(F.lit(60), F.lit(300), 0.85)).first()) == (False, True, True, True, True, False)


def test_probe_and_frames(spark):
    text = '{"format": {"format_name": "MOV,mp4", "duration": "12.345", "bit_rate": "900"}, "streams": [{"codec_type": "audio", "codec_name": "aac"}, {"codec_type": "video", "codec_name": "h264", "width": 10, "height": 20, "avg_frame_rate": "30000/1001"}]}'
    got = one(spark, media.video_probe(F.col("t")), t=text)
    assert (got["duration_ms"], got["width"], got["container"], got["audio_codec"], got["bitrate"]) == (12345, 10, "mov", "aac", 900) and round(got["fps"], 3) == 29.97
    assert one(spark, media.frame_rate(F.col("t")), t="5/0") is None
    assert one(spark, media.frame_offsets(F.lit(95_000))) == [9500, 47_500, 85_500]
    assert one(spark, media.frame_offsets(F.lit(None).cast("long"))) == [1000, 5000, 10_000]


def test_hashes(spark):
    for size in (0, 100, 64 * 1024, 64 * 1024 + 1, 200_000, 0xE29883 % 300_000):
        content = bytes(i * 7 % 256 for i in range(size))
        tail = content[-64 * 1024 :] if size > 64 * 1024 else b""
        want = hashlib.sha256(size.to_bytes(8, "little") + content[: 64 * 1024] + tail).hexdigest()
        assert one(spark, hashing.quick_hash(F.col("c")), c=content) == want
    assert one(spark, F.hex(hashing.little_endian(F.lit(0xE29883)))) == "8398E20000000000"
    rows = [("f" * 16, "f" * 15 + "e", 1), ("f" * 16, "0" * 16, 64), ("8" + "0" * 15, "0" * 16, 1), ("ff", "f", None), ("", "", None), ("zz", "zz", None)]
    got = spark.createDataFrame([r[:2] for r in rows], "a string, b string").select(hashing.hamming(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [r[2] for r in rows]


def test_difference_hash(spark):
    w, h = 18, 16
    gray = [float((x * 13 + y * 7) % 50) for y in range(h) for x in range(w)]
    at = lambda x, y: gray[y * (h - 1) // 7 * w + x * (w - 1) // 8]
    bits = sum(1 << (y * 8 + x) for y in range(8) for x in range(8) if at(x, y) > at(x + 1, y))
    assert one(spark, hashing.difference_hash(F.col("g"), F.lit(w), F.lit(h)), g=gray) == f"{bits:016x}"


def test_vectors(spark):
    a, b = [0.95, 0.90, 0.85], [0.95, 0.89, 0.84]
    df = spark.createDataFrame([(a, b, [1.0])], "a array<double>, b array<double>, c array<double>")
    got = df.select(vectors.mean_abs(F.col("a"), F.col("b")), vectors.l2(F.col("a"), F.col("b")), vectors.near(F.col("a"), F.col("c"), 9.0)).first()
    assert got[0] == pytest.approx(0.02 / 3) and got[1] == pytest.approx(0.0002**0.5) and got[2] is False
    assert one(spark, vectors.parse(F.col("t")), t="[0.5, 1]") == [0.5, 1.0] and one(spark, vectors.parse(F.col("t")), t="no") is None
    assert one(spark, vectors.phash_vector(F.col("t")), t="8000000000000001") == [1.0] + [0.0] * 62 + [1.0]
    tokens = ["raw:x", "raw:y", "raw:x"]
    want = [0.0] * 64
    for t in tokens:
        want[hashlib.sha1(t.encode()).digest()[0] % 64] += 1
    assert one(spark, vectors.token_vector(F.array(*map(F.lit, tokens)))) == [round(x / max(want), 4) for x in want]


def test_search(spark):
    df = spark.createDataFrame([("The quick brown-fox.jpg",)], "t string")
    for query, hit in (("quick fox", True), ("quick -fox", False), ('"brown fox"', True), ('"quick fox"', False), ("cat or fox", True), ("cat", False), ("", False), ("!!", False)):
        assert df.select(search.matches(search.tokens(F.col("t")), query)).first()[0] is hit, query
    assert df.select(search.contains(F.col("t"), "BROWN_FOX")).first()[0] is True


def test_tags_and_answers(spark):
    raw = F.array(*map(F.lit, ("Glasses", " ", "a/b", "image", "sky", "sky", "uniform", "x", "y")))
    got = [(c["namespace"], c["name"]) for c in one(spark, labels.candidates(raw, F.lit("one"), F.lit(""), F.lit("no")))]
    assert got == [("content", "单人"), ("person", "眼镜"), ("content", "sky"), ("content", "制服"), ("content", "x")]
    answers = [('```json\n{"raw_tags": ["sky", "c:\\\\x"], "structured_attributes": {"has_face": "on"}, "confidence": "7", "summary": " s "}\n```',), ("no json",), (None,)]
    rows = ingest.semantic_vectors(ingest.normalize_understanding(spark.createDataFrame(answers, "payload string"))).collect()
    assert rows[0]["raw_tags"] == ["sky"] and rows[0]["confidence"] == 1.0 and rows[0]["summary"] == "s" and [c["name"] for c in rows[0]["candidates"]] == ["露脸", "sky"]
    assert max(rows[0]["vector"]) == 1.0 and rows[1]["vector"] is None and rows[2]["confidence"] == 0.5
