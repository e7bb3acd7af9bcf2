import re
import struct
import zlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from prismara.functions import labels
from prismara.operators.lineage import settled
from prismara.operators.nearest import within
from prismara.plans import clusters, content, files, ingest, library, person, series
from prismara.schema import TABLES, violations
from prismara.sources import files as scans
from prismara.sources import images, providers

T0 = datetime(2024, 1, 1, 12)
WIDE = (
    "file_id long, media_type string, status string, sha256 string, parent_path string, file_name string, mtime timestamp, size_bytes long, width int, height int, duration_ms long, bitrate long, fps double, container string, "
    "quality_score double, phash string, kind string, model string, vector array<double>, image_models array<struct<kind: string, model: string, v: array<double>>>, frame_phashes array<string>, "
    "frame_looks array<struct<kind: string, model: string, v: array<double>>>, frame_models array<struct<kind: string, model: string, v: array<double>>>, person_looks array<struct<kind: string, model: string, v: array<double>>>, "
    "person_kind string, person_model string, person_vector array<double>, has_face string, subject_count string, capture_type string"
)


def look(*vectors, kind="video_frame_visual", model="m"):
    return [(kind, model, v) for v in vectors]


def wide(spark, *rows):
    base = {"media_type": "image", "status": "active", "parent_path": "/a", "file_name": "f.jpg", "mtime": T0, "width": 1920, "height": 1080}
    full = [base | {"image_models": look(r["vector"], kind=r["kind"], model=r["model"])} | r if r.get("vector") else base | r for r in rows]
    names = spark.createDataFrame([], WIDE).columns
    return spark.createDataFrame([tuple((r | {"frame_models": r.get("frame_looks")}).get(n) for n in names) for r in full], WIDE)


def tables(spark, **rows):
    return {name: spark.createDataFrame(rows.get(name, []), schema) for name, schema in TABLES.items()}


def test_exact_copies_are_ranked(spark):
    df = wide(spark, {"file_id": 7, "sha256": "x", "quality_score": 61.0, "width": 1280, "height": 720}, {"file_id": 8, "sha256": "x", "quality_score": 84.0}, {"file_id": 9, "sha256": "y"}, {"file_id": 10, "sha256": "x", "status": "trashed"})
    got = content.same_content(df).orderBy("rank").collect()
    assert [(r["file_id"], r["role"]) for r in got] == [(8, "best_quality"), (7, "duplicate_candidate")]
    assert got[0]["score"] == 1 and 0 < got[1]["score"] < 1


def test_tiers_of_near_content(spark):
    near = {"kind": "image_visual", "model": "m"}
    df = wide(
        spark,
        {"file_id": 7, "phash": "f" * 16}, {"file_id": 10, "phash": "f" * 15 + "e"}, {"file_id": 11, "phash": "0" * 16}, {"file_id": 12, "phash": "f" * 16, "width": 1080, "height": 1920},
        {"file_id": 20, "vector": [0.95, 0.90, 0.85], **near}, {"file_id": 21, "vector": [0.95, 0.89, 0.84], **near}, {"file_id": 22, "vector": [5.0, 5.0, 5.0], **near}, {"file_id": 23, "vector": [0.95, 0.9, 0.85], **near, "model": "other"},
        {"file_id": 24, "vector": [0.95, 0.9, 0.85], **near, "width": 320, "height": 180},
        {"file_id": 30, "media_type": "video", "duration_ms": 60_000, "frame_phashes": ["1", "2", "3"]}, {"file_id": 31, "media_type": "video", "duration_ms": 58_000, "frame_phashes": ["1", "2", "9"]}, {"file_id": 32, "media_type": "video", "duration_ms": 300_000, "frame_phashes": ["1", "2"]},
        {"file_id": 40, "media_type": "video", "frame_looks": look([0.0, 0.1], [0.5, 0.5])}, {"file_id": 41, "media_type": "video", "frame_looks": look([0.0, 0.12], [0.52, 0.5])},
    )
    got = {}
    for r in content.same_content(df).collect():
        got.setdefault((r["tier"], r["cluster_key"]), set()).add(r["file_id"])
    assert got == {("phash", "phash:7"): {7, 10}, ("phash", "phash:10"): {7, 10}, ("vector", "vector:20"): {20, 21}, ("vector", "vector:21"): {20, 21}, ("frame_phash", "frame_phash:30"): {30, 31}, ("frame_phash", "frame_phash:31"): {30, 31}, ("frame_vector", "frame_vector:40"): {40, 41}, ("frame_vector", "frame_vector:41"): {40, 41}}


def test_near_vectors_are_those_of_brute_force(spark):
    import random

    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)], "mn"[i % 2]) for i in range(150)]
    odd = [(200, None, "m"), (201, [], "m"), (202, [0.1] * 3, "m"), (203, [0.1] * 4, None)]
    a = spark.createDataFrame(rows + odd, "a_id long, a_v array<double>, model string")
    want = {(i, j) for i, x, m in rows for j, y, n in rows if m == n and sum((p - q) ** 2 for p, q in zip(x, y, strict=True)) ** 0.5 <= 0.6}
    for size in (1 << 13, 16):
        got = [(r["a_id"], r["b_id"]) for r in within(a, a.withColumnsRenamed({"a_id": "b_id", "a_v": "b_v"}), ["model"], 0.6, size).collect()]
        assert len(got) == len(set(got)) and set(got) - {(202, 202)} == want


def test_videos_meet_by_two_frames(spark):
    video = lambda i, *h: {"file_id": i, "media_type": "video", "duration_ms": 60_000, "frame_phashes": list(h)}
    rows = [video(i, "black", f"own{i}", f"more{i}") for i in range(30)] + [video(40, "black", "x", "y", "z"), video(41, "z", "black", "x", "q"), video(42, "x"), video(43)]
    assert {tuple(r) for r in content.frame_phash_pairs(wide(spark, *rows)).collect()} == {(40, 41, 3), (41, 40, 3)}


def test_copies_of_a_hash_are_compared_once(spark):
    rows = [{"file_id": i, "phash": "ab" * 8} for i in range(12)] + [{"file_id": 20, "phash": "ab" * 7 + "aa"}, {"file_id": 21, "phash": "ab" * 8, "width": None}, {"file_id": 22, "phash": "cd" * 8}]
    got = {(r["a_id"], r["b_id"]) for r in content.phash_pairs(wide(spark, *rows)).collect()}
    near = [*range(12), 20, 21]
    assert got == {(i, j) for i in near for j in near if i != j}


def test_series_by_time_and_name(spark):
    row = lambda i, name, minutes, **k: {"file_id": i, "file_name": name, "mtime": T0 + timedelta(minutes=minutes)} | k
    df = wide(spark, row(1, "model-a-002.jpg", 0), row(2, "model-a-001.jpg", -6), row(3, "model-a-003.jpg", 8), row(4, "other.jpg", 1), row(5, "model-a-004.jpg", 90), row(6, "model-a-005.jpg", 2, capture_type="screenshot"), row(7, "x.jpg", 0, phash="f" * 16, parent_path="/z"), row(8, "y.jpg", 1, phash="f" * 15 + "e", parent_path="/z"))
    got = {}
    for r in series.same_series(df.withColumn("capture_type", F.coalesce("capture_type", F.when(F.col("file_id") < 4, "photo")))).orderBy("place").collect():
        got.setdefault(r["anchor_id"], []).append((r["file_id"], r["role"]))
    assert got[1] == [(2, "member"), (1, "series_focus"), (3, "member")] and 5 not in got and [x[0] for x in got[7]] == [7, 8] and 4 not in got


def test_person_scores(spark):
    near = {"person_kind": "image_visual", "person_model": "m"}
    df = wide(
        spark,
        {"file_id": 41, "file_name": "ann1.jpg", "person_vector": [0.1, 0.1], "parent_path": "/p1", **near}, {"file_id": 42, "file_name": "b.jpg", "person_vector": [0.1, 0.12], "parent_path": "/p2", "mtime": T0 + timedelta(hours=1), **near},
        {"file_id": 43, "file_name": "ann2.jpg", "parent_path": "/p3", "mtime": T0 + timedelta(hours=2)}, {"file_id": 44, "file_name": "z.jpg", "parent_path": "/p4"},
    )
    tags = spark.createDataFrame([(i, "__auto:has_face:true", "auto") for i in (41, 42, 43, 44)], "file_id long, name string, source string")
    got = [(r["file_id"], r["score"], r["role"]) for r in person.same_person(df, tags).where("anchor_id = 41").orderBy("rank").collect()]
    assert got == [(41, 1.0, "cover"), (42, 0.8, "member"), (43, 0.72, "member")]
    human = tags.where("file_id IN (41, 44)").withColumn("source", F.lit("human"))
    assert {(r["anchor_id"], r["file_id"]) for r in person.same_person(df, human).collect()} == {(41, 41), (41, 44), (44, 44), (44, 41)}


def test_pages_follow_one_another(spark):
    rows = [(i, 1, f"/v/{i}", "/v", f"n{i}", ".jpg", "image", None if i == 3 else i * 10 % 70, T0, None, None, "active", None if i == 4 else T0 + timedelta(minutes=i % 4)) for i in range(10)]
    t = tables(spark, files=rows)
    for sort in files.SORTS:
        seen, cursor = [], ""
        while True:
            page = files.list_files(t, files.ListOptions(sort=sort, limit=4, cursor=cursor))
            seen += [r["id"] for r in page.df.collect()]
            cursor = page.next_cursor
            if not page.has_more:
                break
        assert sorted(seen) == list(range(10)) and len(seen) == 10
    with pytest.raises(ValueError):
        files.list_files(t, files.ListOptions(sort="odd"))
    with pytest.raises(ValueError):
        files.decode_cursor(files.encode_cursor("size_asc", {"size_bytes": 1, "id": 1}), "size_desc")
    assert files.filtered(t, files.ListOptions(has_tags="maybe")).count() == 0
    assert set(files.file_detail(t, 3)) == {"file", "history", "analyses", "tags", "reviews", "clusters", "embeddings", "frames"}


def test_scan_of_a_directory(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "X.JPG").write_bytes(b"123")
    (tmp_path / "b.mp4").write_bytes(b"")
    (tmp_path / "c.txt").write_bytes(b"no")
    got = {r["file_name"]: r for r in scans.scan_volume(spark, str(tmp_path), 1, hashes=True).collect()}
    assert set(got) == {"X.JPG", "b.mp4"} and got["X.JPG"]["media_type"] == "image" and got["X.JPG"]["size_bytes"] == 3 and got["X.JPG"]["parent_path"] == str(tmp_path / "a")
    with pytest.raises(scans.VolumeOffline):
        scans.scan_volume(spark, str(tmp_path / "gone"), 1)


def test_merge_of_a_scan(spark):
    row = lambda i, path, status, size: (i, 1, path, "/v", path[3:], ".jpg", "image", size, T0, "s", "q", status, T0)
    t = tables(spark, files=[row(1, "/v/a", "active", 1), row(2, "/v/b", "active", 1), row(3, "/v/c", "trashed", 1), row(4, "/v/d", "active", 1)])
    scan = spark.createDataFrame([(1, p, "/v", p[3:], ".jpg", "image", s, T0) for p, s in (("/v/a", 1), ("/v/b", 2), ("/v/c", 1), ("/v/new", 5))], "volume_id long, abs_path string, parent_path string, file_name string, extension string, media_type string, size_bytes long, mtime timestamp")
    merged, history = ingest.merge_scan(t, scan, F.lit(T0 + timedelta(days=1)), 1)
    got = {r["abs_path"]: (r["status"], r["sha256"], r["updated_at"] > T0) for r in merged.collect()}
    assert got == {"/v/a": ("active", "s", True), "/v/b": ("active", None, True), "/v/c": ("active", "s", True), "/v/d": ("missing", "s", True), "/v/new": ("active", None, True)}
    assert sorted(r["event_type"] for r in history.collect()) == ["discovered"] * 4 + ["missing"]
    assert {r["abs_path"] for r in ingest.scan_changes(t["files"], scan).collect()} == {"/v/b", "/v/c", "/v/new"}


def test_jobs(spark):
    job = lambda i, status, priority, due, lease=None: (i, "hash_file", priority, status, "file", i, None, 0, 3, due, lease, *[None] * 7)
    t = tables(spark, jobs=[job(1, "pending", 90, T0), job(2, "pending", 70, T0 + timedelta(hours=1)), job(3, "leased", 80, T0, T0 - timedelta(minutes=1)), job(4, "failed", 10, T0), job(5, "running", 10, T0)])
    now = F.lit(T0)
    got = library.lease_next(t, now).first()
    assert (got["id"], got["status"], got["attempts"], got["lease_expires_at"]) == (3, "leased", 1, T0 + timedelta(minutes=10))
    assert {r["id"]: r["status"] for r in library.with_rows(t, "jobs", library.lease_next(t, now)).collect()}[3] == "leased"
    assert {r["id"]: r["status"] for r in library.retry(t, 4, now).collect()}[4] == "pending" and {r["id"]: r["status"] for r in library.retry(t, 5, now).collect()}[5] == "running"
    wanted = spark.createDataFrame([("hash_file", "file", 1), ("hash_file", "file", 4), ("hash_file", "file", 4)], "job_type string, target_type string, target_id long")
    assert [r["target_id"] for r in library.ensure_jobs(t, wanted).collect()] == [4]
    assert tuple(library.task_summary(t).first()) == (2, 2, 1, 0, 0)
    assert {r["id"]: r["last_error"] for r in library.mark(t, 5, "failed", now, "no").collect()}[5] == "no"
    ran = library.mark(t, 1, "running", now, worker="w", stage="").where("id = 1").first()
    assert (ran["status"], ran["worker_name"], ran["progress_stage"], ran["started_at"]) == ("running", "w", None, T0)
    done = library.mark(t | {"jobs": library.mark(t, 1, "running", now, worker="w", stage="s")}, 1, "succeeded", F.lit(T0 + timedelta(hours=1))).where("id = 1").first()
    assert (done["status"], done["progress_stage"], done["progress_percent"], done["started_at"], done["finished_at"]) == ("succeeded", None, 100, T0, T0 + timedelta(hours=1))
    both = {r["target_id"]: r for r in library.inserted_or_existing(t, wanted).collect()}
    assert (both[1]["id"], both[1]["created"], both[4]["created"], both[4]["status"]) == (1, False, True, "pending")


def test_tags_reviews_and_clusters(spark):
    t = tables(spark, file_tags=[(1, 1, "ai", 0.5, None), (1, 2, "human", 1.0, None), (2, 1, "ai", 0.5, None)], cluster_members=[(1, 5, 0.9, "cover"), (1, 6, 0.5, "member")], clusters=[(1, "same_person", "old", 0.5, "confirmed", 5, T0), (2, "same_series", "s", 0.6, "confirmed", 5, T0)])
    fresh = spark.createDataFrame([(1, 3, 0.7, None), (1, 3, 0.6, None)], "file_id long, tag_id long, confidence double, evidence string")
    assert sorted((r["file_id"], r["tag_id"]) for r in library.replace_ai_tags(t, fresh).collect()) == [(1, 2), (1, 3), (2, 1)]
    assert sorted((r["file_id"], r["tag_id"]) for r in library.replace_tag(t, 1, 2, 9).collect()) == [(1, 1), (1, 9), (2, 1)]
    made = library.review_cluster(t, 1, "keep", T0).collect()
    assert {r["file_id"] for r in made} == {5, 6} and len({r["id"] for r in made}) == 2
    with pytest.raises(ValueError):
        library.review(t, 1, 1, "deleted_to_trash", T0)
    members = spark.createDataFrame([("new", 7, 1.0, "cover"), ("new", 8, 0.5, "member")], "title string, file_id long, score double, role string")
    made, rows = clusters.merge_clusters(t, "same_person", members, 0.55)
    new = made.where("title = 'new'").first()["id"]
    assert {(r["id"], r["title"], r["status"]) for r in made.collect()} == {(1, "old", "ignored"), (2, "s", "confirmed"), (new, "new", "candidate")}
    assert {(r["cluster_id"], r["file_id"]) for r in rows.collect()} == {(new, 7), (new, 8)}
    again, rows = clusters.merge_clusters(t | {"clusters": made, "cluster_members": rows}, "same_person", members, 0.55)
    assert {(r["id"], r["status"]) for r in again.collect()} == {(1, "ignored"), (2, "confirmed"), (new, "candidate")} and rows.count() == 2


def png(width, height, gray):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = b"".join(b"\0" + bytes(gray[y * width : (y + 1) * width]) for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_images_are_read_by_their_heads(spark):
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc2\0\x0b\x08\0\x05\0\x07\x01\x01\x11\0"
    gif, bmp = b"GIF89a" + struct.pack("<HH", 30, 20), b"BM" + b"\0" * 16 + struct.pack("<ii", 8, -9)
    rows = [(1, png(9, 8, range(72))), (2, jpeg), (3, gif), (4, bmp), (5, b"nothing"), (6, b""), (7, None), (8, b"\x89PNG\r\n\x1a\n")]
    got = {r["file_id"]: r for r in images.decode(spark.createDataFrame(rows, "file_id long, content binary")).collect()}
    assert {i: (r["format"], r["width"], r["height"], r["orientation"]) for i, r in got.items()} == {
        1: ("png", 9, 8, "landscape"), 2: ("jpeg", 7, 5, "landscape"), 3: ("gif", 30, 20, "landscape"), 4: ("bmp", 8, 9, "portrait"), **{i: (None, None, None, "") for i in (5, 6, 7, 8)},
    }
    assert got[1]["phash"] == ("0" * 16 if images.Image else None)


def test_chat_models_are_asked_and_fall_back(spark):
    asked = []

    def post(url, body):
        asked.append((url, body))
        return {"message": {"content": 'Sure: {"raw_tags": ["x"]} ok'}, "choices": [{"message": {"content": [{"text": '{"raw_tags": ["y"]}'}]}}]}

    row = {"media_type": "video", "frame_paths": ["a", "b", "c"]}
    beside = providers.Chat(post, "u", "m", "what is it", images=lambda p: p.encode(), most=2)
    assert beside.understand(row) == {"raw_tags": ["x"]} and asked[-1][1]["messages"][0]["images"] == ["YQ==", "Yg=="]
    inside = providers.Chat(post, "u", "m", "what is it", parts=True, images=lambda p: p.encode())
    assert inside.understand({"media_type": "image", "file_path": "a"}) == {"raw_tags": ["y"]} and asked[-1][1]["messages"][0]["content"][1]["type"] == "image_url"
    chain = [Failing(), providers.Pixels(), providers.Placeholder()]
    by, vector = providers.first_of({"gray": [0, 255, 51], "phash": "8" + "0" * 15}, chain, "embed")
    assert (by.name, vector) == ("pixel", [0.0, 1.0, 0.2])
    assert providers.first_of({"phash": "8" + "0" * 15}, chain, "embed")[0].name == "placeholder"
    by, answer = providers.first_of({"media_type": "video", "file_path": "/x/y.mp4"}, chain, "understand")
    df = spark.createDataFrame([("video", "/x/y.mp4")], "m string, p string").select(labels.placeholder_understanding(F.col("m"), F.col("p")).alias("u")).first()["u"]
    assert answer["raw_tags"] == df["raw_tags"] and answer["summary"] == df["summary"] and answer["confidence"] == df["confidence"]


class Failing:
    name, model = "broken", "broken"

    def understand(self, row):
        raise OSError

    embed = understand


def test_providers_fall_back(spark):
    df = spark.createDataFrame([(1, "image", "8000000000000000"), (2, "video", "")], "file_id long, media_type string, phash string")
    assert {r["provider"] for r in providers.understand(df, Failing).collect()} == {"placeholder"}
    a, b = providers.embed(df).collect(), providers.embed(df, Failing).collect()
    assert len(a) == len(b) == 1 and a[0]["vector"] == b[0]["vector"] and a[0]["vector"][0] == 1.0


def test_rules_of_tables(spark):
    t = tables(spark, tags=[(1, "a", "x", "", False, False), (2, "a", "x", "", False, False)], clusters=[(1, "odd", "t", 0.1, "candidate", 1, None)])
    assert {r["rule"] for r in violations("tags", t["tags"]).collect()} == {"unique namespace, name"}
    assert violations("clusters", t["clusters"]).count() == 1 and violations("jobs", t["jobs"]).count() == 0


def test_unfitting_near_images_do_not_push_out_fitting_ones(spark):
    same = {"kind": "image_visual", "model": "m"}
    rows = [{"file_id": 1, "vector": [0.5, 0.5], **same}, {"file_id": 2, "vector": [0.5, 0.52], **same}]
    rows += [{"file_id": i, "vector": [0.5, 0.5], "width": 1080, "height": 1920, **same} for i in range(10, 36)]
    got = content.vector_pairs(wide(spark, *rows)).where("a_id <= 2 OR b_id <= 2").collect()
    assert {(r["a_id"], r["b_id"]) for r in got} == {(1, 2), (2, 1)}


def test_moved_files_keep_their_ids(spark):
    """Tiers, ties by id and path, names first, and no file twice."""
    row = lambda i, path, sha, quick, size=9, status="active": (i, 1, path, path.rpartition("/")[0], path.rpartition("/")[2], ".jpg", "image", size, T0, sha, quick, status, T0)
    old = [
        row(1, "/a/x.jpg", "s", "q"), row(2, "/a/y.jpg", "s", "q"), row(3, "/a/z.jpg", "s", "q"), row(4, "/a/stays.jpg", "s", "q"), row(5, "/a/quick.jpg", None, "k"), row(6, "/a/other-size.jpg", None, "k", 10),
        row(7, "/a/trashed.jpg", "t", "u", status="trashed"), row(8, "/a/empty.jpg", "e", "e", 0), row(9, "/a/gone.jpg", "alone", ""), row(10, "/a/none.jpg", None, None), row(11, "/a/name.jpg", "n", "n"),
    ]
    seen = [("/a/stays.jpg", "s", "q", 9), ("/b/y.jpg", "s", "q", 9), ("/b/1.jpg", "s", "q", 9), ("/a/2.jpg", "s", "q", 9), ("/b/4.jpg", "s", "q", 9), ("/b/quick.jpg", "new digest", "k", 9), ("/b/t.jpg", "t", "u", 9), ("/b/e.jpg", "e", "e", 0), ("/b/none.jpg", None, None, 9), ("/a/renamed.jpg", "n", "n", 9)]
    scan = spark.createDataFrame([(1, p, p.rpartition("/")[0], p.rpartition("/")[2], ".jpg", "image", size, T0, sha, quick) for p, sha, quick, size in seen], "volume_id long, abs_path string, parent_path string, file_name string, extension string, media_type string, size_bytes long, mtime timestamp, sha256 string, quick_hash string")
    t = tables(spark, files=old)
    got = {r["id"]: (r["abs_path"], r["event_type"]) for r in ingest.moves(t["files"], scan).collect()}
    # 2 has its name again; 1 and 3 take the first paths left; 5 meets by quick hash and size.
    assert got == {2: ("/b/y.jpg", "moved"), 1: ("/a/2.jpg", "renamed"), 3: ("/b/1.jpg", "moved"), 5: ("/b/quick.jpg", "moved"), 11: ("/a/renamed.jpg", "renamed")}
    merged, history = ingest.merge_moves(t, scan, F.lit(T0 + timedelta(days=1)))
    after = {r["id"]: r for r in merged.collect()}
    assert len(after) == len(old) + 4 and after[2]["abs_path"] == "/b/y.jpg" and after[2]["sha256"] == "s" and after[2]["status"] == "active" and after[9]["status"] == "missing"
    assert sorted((r["file_id"], r["event_type"]) for r in history.collect() if r["file_id"] in (2, 9)) == [(2, "discovered"), (2, "moved"), (9, "missing")]
    assert ingest.moves(t["files"].where("false"), scan).collect() == [] and ingest.moves(t["files"], scan.where("false")).collect() == []


def test_lists_are_in_their_orders(spark):
    """The newest clusters, jobs and events first, volumes by name, and a cluster's members by three ranks of roles."""
    at = lambda h: T0 + timedelta(hours=h)
    job = lambda i, h: (i, "hash_file", 70, "failed", "file", i, None, 0, 3, T0, None, None, None, None, None, None, None, at(h))
    t = tables(
        spark,
        clusters=[(1, "same_series", "a", 0.6, "candidate", 1, at(2)), (2, "same_series", "b", 0.6, "candidate", 1, at(5)), (3, "same_series", "c", 0.6, "candidate", 1, at(2)), (4, "same_series", "d", 0.6, "candidate", 1, None)],
        cluster_members=[(1, 5, 0.9, "member"), (1, 6, 0.5, "cover"), (1, 7, None, "series_focus"), (1, 8, 0.9, "best_quality"), (1, 9, 0.95, "duplicate_candidate")],
        files=[(i, 1, f"/{i}", "/", str(i), ".jpg", "image", 5, T0, None, None, "active", T0) for i in range(5, 10)],
        jobs=[job(1, 3), job(2, 9), job(3, 3)], job_events=[(i, 1, "info", "m", at(i % 3)) for i in range(30)],
        volumes=[(1, "/b", None, "beta", True, None), (2, "/a", None, "alpha", True, None), (3, "/c", None, "alpha", True, None)],
    )
    ids = lambda df, c="id": [r[c] for r in df.collect()]
    assert ids(clusters.list_clusters(t)) == [4, 2, 3, 1] and ids(clusters.list_clusters(t, limit=2)) == [4, 2]
    assert ids(clusters.cluster_members(t, 1), "file_id") == [6, 8, 9, 5, 7]
    assert ids(library.list_jobs(t)) == [2, 3, 1] and ids(library.list_volumes(t)) == [2, 3, 1]
    newest = sorted(range(30), key=lambda i: (i % 3, i), reverse=True)
    assert ids(library.list_job_events(t, 1)) == newest[:20] and ids(library.list_job_events(t, 1, 3)) == newest[:3]
    assert ids(files.file_detail(t, 5)["clusters"], "cluster_id") == [1]


def after_joins(df):
    """How many aggregates come after the last join."""
    return df._jdf.queryExecution().sparkPlan().toString().split("Join")[0].count("Aggregate")


def test_videos_with_shared_hashes_are_spelled_out_last(spark):
    """Pairs of videos leave the last join and are counted no more, however many are alike."""
    rows = [{"file_id": i, "frame_phashes": ["x", "y", f"own{i}"], "media_type": "video", "duration_ms": 60_000} for i in range(60)]
    got = content.frame_phash_pairs(wide(spark, *rows))
    assert after_joins(got) == 0 and got.where("shared = 2").count() == got.count() == 60 * 59


def test_videos_with_near_frames_are_spelled_out_last(spark):
    rows = [{"file_id": i, "frame_looks": look([i % 2 / 5, 0.5], [0.5, 0.5]), "media_type": "video", "duration_ms": 60_000} for i in range(60)]
    got = content.frame_vector_pairs(wide(spark, *rows))
    assert after_joins(got) == 0 and got.where("shared = 2 AND a_id <> b_id").count() == got.count() == 60 * 29


def test_cluster_list_counts_files_once_without_copies_of_rows(spark):
    rows = [(1, 7, 0.9, "cover"), (1, 7, 0.5, "member"), (1, 8, 0.8, "member"), (1, None, None, "member"), (2, 9, 0.1, "cover")]
    t = tables(spark, clusters=[(i, "same_person", f"c{i}", 0.5, "candidate", 7, T0) for i in (1, 2, 3)])
    t["cluster_members"] = spark.createDataFrame(rows, "cluster_id long, file_id long, score double, role string")
    t["embeddings"] = spark.createDataFrame([(1, 7, None, "person_visual"), (2, 7, None, "image_visual"), (3, 8, None, "image_visual"), (4, None, None, "person_visual")], "id long, file_id long, frame_id long, embedding_type string")
    df = clusters.list_clusters(t, limit=None).select("id", "members", "strong_members", "top_score", "person_members", "generic_members", "top_evidence")
    assert sorted(tuple(r) for r in df.collect()) == [(1, 4, 2, 0.9, 1, 2, "person_visual"), (2, 1, 0, 0.1, 0, 0, None), (3, 0, 0, None, 0, 0, None)]
    assert "Expand" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_difference_hash_computes_its_samples_once(spark):
    from prismara.functions import hashing

    gray = F.transform("v", lambda x: F.floor(x * 127).cast("int"))
    df = spark.createDataFrame([([float(i * 37 % 64) for i in range(64)],)], "v array<double>").select(hashing.difference_hash(gray, F.lit(8), F.lit(8)).alias("h"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("127.0") == 1
    grid = [i * 37 % 64 for i in range(64)]
    bits = [grid[i // 8 * 8 + i % 8 * 7 // 8] > grid[i // 8 * 8 + (i % 8 + 1) * 7 // 8] for i in range(64)]
    assert int(df.first()["h"], 16) == sum(b << i for i, b in enumerate(bits))


def test_nearest_images_are_found_by_class(spark):
    """Each of many with one vector has the first others by id, and no window goes over pairs of images."""
    same = {"kind": "image_visual", "model": "m"}
    df = content.vector_pairs(wide(spark, *({"file_id": i, "vector": [0.5, 0.5], **same} for i in range(40)), {"file_id": 90, "vector": [0.5, 0.52], **same}))
    got = {}
    for r in df.collect():
        got.setdefault(r["a_id"], set()).add(r["b_id"])
    assert got == {i: set([j for j in range(40) if j != i][:24]) for i in [*range(40), 90]}
    assert "windowspecdefinition(a_id" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_tags_are_sorted_by_file_in_a_stage_of_their_own(spark):
    from prismara.queries import QUERIES

    plan = QUERIES["tag_summary_top3"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.rindex("WindowGroupLimit [file_id") :]
    assert re.search("Exchange|Join|HashAggregate", below)[0] == "Exchange"


def test_settled_tables_leave_no_shuffle_files(spark):
    """They are read from the checkpoint; a chain of them would keep every shuffle until the driver collects its garbage."""
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(found.size()) if (name := found.apply(i).getName()).startswith("shuffle_")}

    before, df = files(), spark.range(1000).withColumn("k", F.col("id") % 7).groupBy("k").count()
    first = settled(df)
    second = settled(first.join(df, "k").repartition(3))
    assert not files() - before and second.count() == 7
