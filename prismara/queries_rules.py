"""Registered queries of scalar rules and of changes to tables, each with its SQL; they join those of `queries`."""

from __future__ import annotations

from collections import ChainMap
from datetime import datetime

from pyspark.sql import functions as F

from . import schema
from .functions import hashing, labels, media, vectors
from .operators.lineage import checkpoint_dir
from .operators.relational import values
from .plans import clusters, content, features, files, ingest, keyframes, library, person, series
from .queries import _AT, FLOOKS, UFRAMES, _features, query
from .sources import catalog, providers


@query("SELECT id, CASE WHEN lower(ltrim(extension, '.')) IN ('jpg', 'jpeg', 'png', 'webp', 'gif', 'bmp', 'heic') THEN 'image' WHEN lower(ltrim(extension, '.')) IN ('mp4', 'mov', 'mkv', 'avi', 'wmv', 'm4v', 'webm') THEN 'video' END AS kind FROM m_files")
def media_types(t):
    return t["files"].select("id", media.media_type(F.col("extension")).alias("kind"))


@query("SELECT id, abs_path, size_bytes, status FROM m_files")
def tables_saved_and_loaded(t):
    """The files by way of a saved table."""
    spark = t["files"].sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/prismara-library-{spark.sparkContext.applicationId}"
    catalog.save(t["files"], path, "files")
    return catalog.load(spark, path)["files"].select("id", "abs_path", "size_bytes", "status")


@query("SELECT cm.cluster_id, cm.file_id, v.place FROM m_cluster_members cm JOIN (VALUES ('cover', 0), ('best_quality', 1), ('series_focus', 2), ('member', 2), ('duplicate_candidate', 2)) v(role, place) ON v.role = cm.role")
def inline_roles(t):
    ranks = values(t["files"].sparkSession, "role string, place int", [(x, clusters.ROLES.index(x) if x in clusters.ROLES else len(clusters.ROLES)) for x in schema.VALUES["cluster_members", "role"]])
    return t["cluster_members"].join(F.broadcast(ranks), "role").select("cluster_id", "file_id", "place")  # one row for each role


@query("SELECT o.id, o.media_type = 'image' OR coalesce(v.poster_path, '') <> '' AS has_preview, coalesce(i.thumbnail_path, '') AS thumbnail_path, v.video_codec, v.audio_codec, i.format, v.container, v.fps, v.bitrate, v.duration_ms FROM m_files o LEFT JOIN m_image_assets i ON i.file_id = o.id LEFT JOIN m_video_assets v ON v.file_id = o.id")
def list_columns(t):
    return files.overview(t).select("id", "has_preview", "thumbnail_path", "video_codec", "audio_codec", "format", "container", "fps", "bitrate", "duration_ms")


@query("SELECT id, file_name FROM m_files ORDER BY updated_at DESC, id DESC LIMIT 100")
def list_files_page_cap(t):
    """A page is 100 rows at most, whatever is asked for."""
    return files.list_files(t, files.ListOptions(limit=5000)).df.select("id", "file_name")


@query("SELECT file_id, n, action_type FROM (SELECT *, CAST(row_number() OVER (PARTITION BY file_id ORDER BY created_at DESC, id DESC) AS INT) AS n FROM m_review_actions WHERE file_id IS NOT NULL) WHERE n <= 10")
def last_reviews(t):
    return files.latest_reviews(t).select("file_id", "n", "action_type")


@query("SELECT file_id, CAST(n - 1 AS INT) AS n, frame_path FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY CASE frame_role WHEN 'understanding' THEN 0 ELSE 1 END, timestamp_ms, id) AS n FROM m_video_frames)")
def frames_in_order(t):
    return files.frame_paths(t)


@query("""WITH fr AS (SELECT file_id, string_agg(frame_path, '|' ORDER BY timestamp_ms, id) AS p FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY timestamp_ms, id) AS n FROM m_video_frames WHERE frame_role = 'understanding') WHERE n <= 6 GROUP BY file_id)
SELECT f.id AS file_id, f.abs_path AS file_path, f.file_name, f.media_type, CASE WHEN f.media_type = 'video' THEN coalesce(fr.p, '') END AS frames FROM m_files f LEFT JOIN fr ON fr.file_id = f.id""")
def understanding_sources(t):
    return ingest.understanding_sources(t).select("file_id", "file_path", "file_name", "media_type", F.when(F.col("frame_paths").isNotNull(), F.array_join("frame_paths", "|")).alias("frames"))


@query("SELECT f.id AS file_id, CAST(NULL AS BIGINT) AS frame_id, f.abs_path AS path, coalesce(i.phash, '') AS phash FROM m_files f LEFT JOIN m_image_assets i ON i.file_id = f.id WHERE f.media_type = 'image' UNION ALL SELECT file_id, id, frame_path, phash FROM m_video_frames WHERE frame_role = 'understanding'")
def embedding_sources(t):
    return ingest.embedding_sources(t)


def _one(parts: dict) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS part, {what} AS what FROM {rest}" for name, (what, rest) in parts.items())


@query(_one({
    "file": ("CAST(id AS STRING)", "m_files WHERE id = 7"), "history": ("event_type", "m_file_path_history WHERE file_id = 7"), "analyses": ("analysis_type", "m_analysis_results r WHERE r.id IN (SELECT analysis_result_id FROM m_file_current_analysis WHERE file_id = 7)"),
    "tags": ("t.display_name", "m_file_tags ft JOIN m_tags t ON t.id = ft.tag_id WHERE ft.file_id = 7"), "reviews": ("action_type", "(SELECT * FROM m_review_actions WHERE file_id = 7 ORDER BY created_at DESC, id DESC LIMIT 10)"),
    "clusters": ("c.title", "m_cluster_members cm JOIN m_clusters c ON c.id = cm.cluster_id WHERE cm.file_id = 7"),
    "frames": ("frame_path", "(SELECT * FROM m_video_frames WHERE file_id = 7 ORDER BY CASE frame_role WHEN 'understanding' THEN 0 ELSE 1 END, timestamp_ms, id LIMIT 6)"),
    "embeddings": ("model_name", "(SELECT DISTINCT embedding_type, model_name FROM m_embeddings WHERE embedding_type IN ('image_visual', 'video_frame_visual') AND (file_id = 7 OR frame_id IN (SELECT id FROM m_video_frames WHERE file_id = 7)))"),
}))
def file_detail(t):
    """The parts of one file's detail, one below the other."""
    shown = {"file": "id", "history": "event_type", "analyses": "analysis_type", "tags": "display_name", "reviews": "action_type", "clusters": "title", "frames": "frame_path", "embeddings": "model_name"}
    out = None
    for name, df in files.file_detail(t, 7).items():
        rows = df.select(F.lit(name).alias("part"), F.col(shown[name]).cast("string").alias("what"))
        out = rows if out is None else out.unionAll(rows)
    return out


@query("SELECT file_id, sha256(document_text) AS digest FROM m_search_documents")
def content_digests(t):
    return t["search_documents"].select("file_id", hashing.sha256(F.encode("document_text", "UTF-8")).alias("digest"))


#: Grey samples made from vectors, which both engines compute alike.
_GRAY = "list_transform(vector, lambda x: CAST(floor((x + 1) * 127) AS INT))"


def _gray():
    return F.transform("vector", lambda x: F.floor((x + 1) * 127).cast("int"))


@query(f"""WITH g AS (SELECT id, {_GRAY} AS g FROM m_embeddings),
b AS (SELECT id, list_transform(range(64), lambda i: CASE WHEN g[(i // 8) * 8 + CAST(floor((i % 8) * 7 / 8) AS INT) + 1] > g[(i // 8) * 8 + CAST(floor((i % 8 + 1) * 7 / 8) AS INT) + 1] THEN 1 ELSE 0 END) AS bits FROM g)
SELECT id, lower(array_to_string(list_transform(range(16), lambda d: substr('0123456789abcdef', bits[(15 - d) * 4 + 1] + 2 * bits[(15 - d) * 4 + 2] + 4 * bits[(15 - d) * 4 + 3] + 8 * bits[(15 - d) * 4 + 4] + 1, 1)), '')) AS phash FROM b""")
def difference_hashes(t):
    return t["embeddings"].select("id", hashing.difference_hash(_gray(), F.lit(8), F.lit(8)).alias("phash"))


@query(f"SELECT id, array_to_string(list_transform({_GRAY}, lambda x: printf('%.4f', round(x / 255.0, 4))), ',') AS pixels FROM m_embeddings")
def pixel_vectors(t):
    return t["embeddings"].select("id", F.array_join(F.transform(vectors.pixel_vector(_gray()), lambda x: F.format_string("%.4f", x)), ",").alias("pixels"))


@query("SELECT file_id, array_to_string(list_transform(range(64), lambda i: CAST((CAST('0x' || substr(phash, CAST(i // 4 AS INT) + 1, 1) AS INT) >> CAST(3 - i % 4 AS INT)) & 1 AS STRING)), '') AS bits FROM m_image_assets")
def phash_vectors(t):
    return t["image_assets"].select("file_id", F.array_join(F.transform(vectors.phash_vector(F.col("phash")), lambda x: x.cast("int").cast("string")), "").alias("bits"))


@query("SELECT a.file_id AS a_id, b.file_id AS b_id, round(list_sum(list_transform(list_zip(a.vector, b.vector), lambda z: abs(z[1] - z[2]))) / 64, 9) AS mean FROM m_embeddings a JOIN m_embeddings b ON a.file_id = b.file_id - 2 AND a.embedding_type = b.embedding_type")
def neighbour_distances(t):
    side = lambda p: t["embeddings"].where("file_id IS NOT NULL").select(F.col("file_id").alias(f"{p}_id"), "embedding_type", F.col("vector").alias(f"{p}_v"))
    met = side("a").join(side("b").withColumn("a_id", F.col("b_id") - 2), ["a_id", "embedding_type"])
    return met.select("a_id", "b_id", F.round(vectors.mean_abs(F.col("a_v"), F.col("b_v")), 9).alias("mean"))


_NEAR_PAIRS = f"""{UFRAMES}, {FLOOKS}, fr AS (SELECT file_id, frame_id AS id, v FROM fl),
pr AS (SELECT DISTINCT a.file_id AS a_id, b.file_id AS b_id FROM fr a JOIN fr b ON b.file_id = a.file_id + 90),
hit AS (SELECT a.file_id AS a_id, b.file_id AS b_id, a.id FROM fr a JOIN fr b ON b.file_id = a.file_id + 90 WHERE list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2]))) / 64 <= {{}})"""


def _frame_pairs(t):
    """The frames' latest vectors of every video beside those of the video ninety ids on."""
    rows = features.frame_vectors(t, ("video_frame_visual",)).groupBy(F.col("file_id").alias("video"))
    of = rows.agg(F.transform(F.sort_array(F.collect_list(F.struct("frame_id", "v"))), lambda x: x["v"]).alias("v"))
    return of.select(F.col("video").alias("a_id"), F.col("v").alias("a_v"), (F.col("video") + 90).alias("b_id")).join(of.select(F.col("video").alias("b_id"), F.col("v").alias("b_v")), "b_id")


@query(f"WITH {_NEAR_PAIRS.format(0.005)} SELECT pr.a_id, pr.b_id, CAST(count(DISTINCT hit.id) AS INT) AS shared FROM pr LEFT JOIN hit ON hit.a_id = pr.a_id AND hit.b_id = pr.b_id GROUP BY 1, 2")
def shared_frame_counts(t):
    return _frame_pairs(t).select("a_id", "b_id", vectors.near_count(F.col("a_v"), F.col("b_v"), 0.005).alias("shared"))


@query(f"WITH {_NEAR_PAIRS.format(0.02)}, f1 AS (SELECT file_id, min(id) AS id FROM fr GROUP BY file_id) SELECT pr.a_id, pr.b_id, EXISTS (SELECT 1 FROM hit JOIN f1 ON f1.id = hit.id WHERE hit.a_id = pr.a_id AND hit.b_id = pr.b_id) AS near FROM pr")
def first_frame_near(t):
    return _frame_pairs(t).select("a_id", "b_id", vectors.any_near(F.get("a_v", F.lit(0)), F.col("b_v"), 0.02).alias("near"))


@query("SELECT id, array_to_string(list_transform(vector, lambda x: CAST(CAST(floor(x * 1e9) AS BIGINT) AS VARCHAR)), ',') AS billionths FROM m_embeddings")
def vectors_as_text(t):
    """Every component of vectors that were written as text and read again."""
    again = vectors.parse(F.to_json("vector"))
    return t["embeddings"].select("id", F.array_join(F.transform(again, lambda x: F.floor(x * 1e9).cast("string")), ",").alias("billionths"))


@query("SELECT id, embedding_type, model_name FROM m_embeddings e WHERE NOT EXISTS (SELECT 1 FROM m_image_assets i WHERE i.file_id = e.file_id AND e.embedding_type = 'image_visual' AND e.model_name = 'placeholder') UNION ALL SELECT 3000000000 + file_id, 'image_visual', 'placeholder' FROM m_image_assets")
def replaced_vectors(t):
    fresh = t["image_assets"].select((F.lit(3_000_000_000) + F.col("file_id")).alias("id"), "file_id", F.lit(None).cast("long").alias("frame_id"), F.lit("image_visual").alias("embedding_type"), F.lit("placeholder").alias("model_name"), vectors.phash_vector(F.col("phash")).alias("vector"))
    return ingest.replace_vectors(t, fresh).select("id", "embedding_type", "model_name")


@query("SELECT id, CASE WHEN size_bytes % 3 = 0 THEN 'ffmpeg-gray-8x8-v1' WHEN size_bytes % 3 = 1 THEN 'semantic-' || CASE WHEN media_type = 'image' THEN 'local' ELSE 'unknown' END || '-' || CASE WHEN media_type = 'image' THEN 'eye' ELSE 'unknown' END || '-v1' WHEN i.phash IS NOT NULL THEN 'placeholder-v1' END AS model FROM m_files LEFT JOIN m_image_assets i ON i.file_id = id")
def vector_fallbacks(t):
    """Which link of the chain gives a file its vector: samples, tokens or the hash, as a rule says which there are."""
    df = t["files"].join(t["image_assets"].select(F.col("file_id").alias("id"), "phash"), "id", "left")
    gray, tokens = F.when(F.col("size_bytes") % 3 == 0, F.array(F.lit(1), F.lit(2))), F.when(F.col("size_bytes") % 3 == 1, F.array("file_name"))
    return df.select("id", providers.fallback_vectors(gray, tokens, F.col("phash"), F.when(F.col("media_type") == "image", " local "), F.when(F.col("media_type") == "image", "eye"))["model"].alias("model"))


@query("""SELECT id AS file_id, CASE media_type WHEN 'video' THEN '视频' ELSE '图片' END || '|待AI精标' AS raw_tags, 'content:' || CASE media_type WHEN 'video' THEN '视频' ELSE '图片' END || '|management:待AI精标' AS candidates,
file_name || '，' || CASE media_type WHEN 'video' THEN '视频文件' ELSE '图片文件' END || '，当前为占位理解结果。' AS summary, CAST(0.55 AS DOUBLE) AS confidence, media_type AS kind FROM m_files""")
def placeholder_understanding(t):
    df = t["files"].select("id", labels.placeholder_understanding(F.col("media_type"), F.col("abs_path")).alias("p"))
    names = F.array_join(F.transform("p.candidates", lambda c: F.concat(c["namespace"], F.lit(":"), c["name"])), "|")
    return df.select(F.col("id").alias("file_id"), F.array_join("p.raw_tags", "|").alias("raw_tags"), names.alias("candidates"), "p.summary", "p.confidence", F.col("p.attributes")["media_type"].alias("kind"))


_UNDERSTOOD = "u AS (SELECT r.file_id, json_extract_string(r.structured_attributes, '$.has_face') AS hf, json_extract_string(r.structured_attributes, '$.subject_count') AS sc, json_extract_string(r.structured_attributes, '$.capture_type') AS ct FROM m_analysis_results r WHERE r.analysis_type = 'understanding')"


def _understood(t):
    rows = t["analysis_results"].where("analysis_type = 'understanding'")
    return rows.select("file_id", *(F.get_json_object("structured_attributes", f"$.{k}").alias(k) for k in ("has_face", "subject_count", "capture_type")))


@query(f"WITH {_UNDERSTOOD} SELECT file_id, lower(trim(hf)) IN ('true', '1', 'yes') AS in_queries, lower(trim(hf)) IN ('true', '1', 'yes', 'on') AS in_payloads, contains(lower(hf), 'true') OR contains(hf, '1') OR contains(lower(hf), 'yes') AS anywhere FROM u UNION ALL SELECT doc_id, lower(trim(source)) IN ('true', '1', 'yes'), lower(trim(source)) IN ('true', '1', 'yes', 'on'), contains(lower(source), 'true') OR contains(source, '1') OR contains(lower(source), 'yes') FROM documents")
def three_truths(t):
    """The three readings of a true attribute, over attributes and over the names of directories."""
    rows = _understood(t).select("file_id", F.col("has_face").alias("x")).unionAll(t["files"].select("id", F.element_at(F.split("parent_path", "/"), -1)))
    return rows.select("file_id", labels.truthy(F.col("x")).alias("in_queries"), labels.truthy(F.col("x"), labels.TRUE_IN_PAYLOADS).alias("in_payloads"), labels.holds_any(F.col("x")).alias("anywhere"))


@query(f"""WITH {_UNDERSTOOD}, tg AS (SELECT ft.file_id, max(t.namespace = 'person' OR (t.namespace = 'content' AND (contains(lower(t.name), 'portrait') OR contains(lower(t.name), 'selfie')))) AS hit FROM m_file_tags ft JOIN m_tags t ON t.id = ft.tag_id GROUP BY ft.file_id)
SELECT u.file_id, coalesce(tg.hit, false) OR contains(hf, 'true') OR contains(sc, 'single') OR contains(ct, 'selfie') OR contains(ct, 'photo') AS wanted FROM u LEFT JOIN tg ON tg.file_id = u.file_id""")
def person_vectors_wanted(t):
    tags = t["file_tags"].join(t["tags"].select(F.col("id").alias("tag_id"), "namespace", "name"), "tag_id").groupBy("file_id").agg(F.collect_set(F.struct("namespace", "name")).alias("tags"))
    df = _understood(t).join(tags, "file_id", "left")
    return df.select("file_id", ingest.wants_person_vectors(F.col("has_face"), F.col("subject_count"), F.col("capture_type"), F.col("tags")).alias("wanted"))


@query("SELECT file_id, tag_id, source, greatest(0, least(1, coalesce(TRY_CAST(CASE WHEN confidence > 0.6 THEN CAST(confidence * 2 AS STRING) WHEN confidence > 0.3 THEN 'sure' ELSE CAST(confidence AS STRING) END AS DOUBLE), 0.6))) AS confidence FROM m_file_tags")
def clamped_confidence(t):
    c = F.col("confidence")
    text = F.when(c > 0.6, (c * 2).cast("string")).when(c > 0.3, "sure").otherwise(c.cast("string"))
    return t["file_tags"].select("file_id", "tag_id", "source", labels.clamp(text, 0.6).alias("confidence"))


@query("SELECT r.id, json_extract_string(structured_attributes, '$.subject_count') AS subject FROM m_analysis_results r")
def json_in_noise(t):
    """Attributes found again in an answer with words around the JSON."""
    noisy = F.concat(F.lit("Sure! Here it is:\n"), "structured_attributes", F.lit("\nAnything else?"))
    return t["analysis_results"].select("id", F.get_json_object(labels.json_object(noisy), "$.subject_count").alias("subject"))


@query("""WITH fr AS (SELECT CAST((SELECT max(id) FROM m_analysis_results) + file_id AS BIGINT) AS id, file_id, 'quality' AS analysis_type, TIMESTAMP '2024-03-01 00:00:00' AS created_at FROM m_analysis_results WHERE analysis_type = 'quality'),
e AS (SELECT id, file_id, analysis_type, created_at FROM m_analysis_results UNION ALL SELECT * FROM fr)
SELECT file_id, analysis_type, arg_max(id, (created_at, id)) AS analysis_result_id FROM e GROUP BY file_id, analysis_type""")
def analyses_appended(t):
    last = t["analysis_results"].agg(F.max("id").alias("top"))
    fresh = t["analysis_results"].where("analysis_type = 'quality'").crossJoin(F.broadcast(last))  # one row
    fresh = fresh.withColumns({"id": F.col("top") + F.col("file_id"), "created_at": F.lit(_AT)}).drop("top")
    return ingest.append_analyses(t, fresh)[1]


@query("SELECT file_id, tag_id, source FROM m_file_tags WHERE NOT (file_id = 1 AND tag_id IN (SELECT min(tag_id) FROM m_file_tags WHERE file_id = 1)) AND NOT (file_id = 1 AND tag_id = 5 AND source = 'human') UNION ALL SELECT 1, 5, 'human'")
def tag_replaced(t):
    old = t["file_tags"].where("file_id = 1").agg(F.min("tag_id")).first()[0]
    return library.replace_tag(t, 1, old, 5).select("file_id", "tag_id", "source")


@query("SELECT file_id, cluster_id, action_type, created_at FROM m_review_actions UNION ALL SELECT DISTINCT file_id, CAST(1 AS BIGINT), 'keep', TIMESTAMP '2024-03-01 00:00:00' FROM m_cluster_members WHERE cluster_id = 1")
def cluster_reviewed(t):
    return library.review_cluster(t, 1, "keep", _AT).select("file_id", "cluster_id", "action_type", "created_at")


@query("SELECT id, CASE WHEN id = 5 THEN 'trashed' ELSE status END AS status, CASE WHEN id = 5 THEN 'deleted_to_trash' END AS last_action FROM m_files")
def file_trashed(t):
    moved, actions = library.trash(t, 10**9, 5, _AT)
    last = actions.where(f"id = {10**9}").select(F.col("file_id").alias("id"), F.col("action_type").alias("last_action"))
    return moved.join(last, "id", "left").select("id", "status", "last_action")


@query("SELECT id FROM m_files WHERE volume_id <> 2")
def volume_deleted(t):
    return library.delete_volume(t, 2)[1].select("id")


@query("""WITH m AS (SELECT 'cluster ' || CAST(volume_id * 9 AS STRING) AS title, id AS file_id FROM m_files), ttl AS (SELECT DISTINCT title FROM m),
o AS (SELECT title, cluster_type, CASE WHEN cluster_type <> 'same_content' THEN status WHEN title IN (SELECT title FROM ttl) THEN 'candidate' ELSE 'ignored' END AS status FROM m_clusters)
SELECT title, cluster_type, status, CAST(NULL AS BIGINT) AS file_id FROM o UNION ALL SELECT title, 'same_content', 'candidate', NULL FROM ttl WHERE title NOT IN (SELECT title FROM m_clusters WHERE cluster_type = 'same_content')
UNION ALL SELECT c.title, c.cluster_type, NULL, cm.file_id FROM m_cluster_members cm LEFT JOIN m_clusters c ON c.id = cm.cluster_id WHERE c.cluster_type IS DISTINCT FROM 'same_content' UNION ALL SELECT title, 'same_content', NULL, file_id FROM m""")
def clusters_merged(t):
    members = t["files"].select(F.concat(F.lit("cluster "), (F.col("volume_id") * 9).cast("string")).alias("title"), F.col("id").alias("file_id"), F.lit(1.0).alias("score"), F.lit("member").alias("role"))
    made, held = clusters.merge_clusters(t, "same_content", members, 1.0, F.lit(_AT))
    held = held.join(made.select(F.col("id").alias("cluster_id"), "title", "cluster_type"), "cluster_id", "left")
    return made.select("title", "cluster_type", "status", F.lit(None).cast("long").alias("file_id")).unionByName(held.select("title", "cluster_type", F.lit(None).cast("string").alias("status"), "file_id"))


@query("SELECT w.target_id, j.id IS NULL AS created, j.id AS job FROM (SELECT id AS target_id FROM m_files) w LEFT JOIN (SELECT target_id, min(id) AS id FROM m_jobs WHERE job_type = 'hash_file' AND target_type = 'file' AND status IN ('pending', 'leased', 'running') GROUP BY target_id) j USING (target_id)")
def jobs_inserted_or_existing(t):
    wanted = t["files"].select(F.lit("hash_file").alias("job_type"), F.lit("file").alias("target_type"), F.col("id").alias("target_id"))
    made = library.inserted_or_existing(t, wanted)
    return made.select("target_id", "created", F.when(~F.col("created"), F.col("id")).alias("job"))


_MARKED = "SELECT id, CASE id WHEN 7 THEN 'running' WHEN 8 THEN 'succeeded' WHEN 9 THEN 'failed' ELSE status END AS status, CASE id WHEN 7 THEN 'w1' END AS worker_name, CASE id WHEN 9 THEN 'no' END AS last_error, CASE id WHEN 8 THEN 100 END AS progress_percent, CASE WHEN id IN (8, 9) THEN TIMESTAMP '2024-03-01 00:00:00' END AS finished_at, CASE WHEN id = 7 THEN coalesce(started_at, TIMESTAMP '2024-03-01 00:00:00') ELSE started_at END AS started_at FROM m_jobs"


@query(_MARKED)
def jobs_marked(t):
    at = F.lit(_AT)
    for job, status, more in ((7, "running", {"worker": "w1", "stage": "s"}), (8, "succeeded", {}), (9, "failed", {"error": "no"})):
        t = ChainMap({"jobs": library.mark(t, job, status, at, **more)}, t)
    return t["jobs"].select("id", "status", "worker_name", "last_error", "progress_percent", "finished_at", "started_at")


@query("""WITH b AS (SELECT a_id, count(*) AS n FROM (SELECT a.id AS a_id, b.id AS b_id FROM m_files a JOIN m_files b ON a.parent_path = b.parent_path AND a.media_type = b.media_type AND a.id <> b.id AND a.status = 'active' AND b.status = 'active' AND abs(epoch_us(a.mtime) - epoch_us(b.mtime)) <= 1800000000) GROUP BY a_id)
SELECT * FROM b""")
def directory_neighbours(t):
    """How many files of its kind and directory lie within half an hour of each."""
    found = series.candidates(_features(t, "about")).where("a_parent_path = b_parent_path")
    return found.groupBy("a_id").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT file_id, name FROM (SELECT ft.file_id, t.name FROM m_file_tags ft JOIN m_tags t ON t.id = ft.tag_id WHERE t.namespace = 'person')),
x AS (SELECT f.id, json_extract_string(r.structured_attributes, '$.capture_type') AS ct FROM m_files f JOIN m_file_current_analysis c ON c.file_id = f.id AND c.analysis_type = 'understanding' JOIN m_analysis_results r ON r.id = c.analysis_result_id WHERE lower(json_extract_string(r.structured_attributes, '$.capture_type')) = 'selfie')
SELECT id AS file_id, '__auto:capture_type:selfie' AS name FROM x WHERE id NOT IN (SELECT file_id FROM s)""")
def signals_without_tags(t):
    """Files whose signal of a selfie counts, as they have no tag of a person."""
    return person.effective_tags(t, _features(t, "about")).where("name = '__auto:capture_type:selfie'").select("file_id", "name")


@query("SELECT id, 'same_content:' || substr(sha256, 1, 12) AS title FROM m_files WHERE sha256 <> ''")
def truncated_titles(t):
    return t["files"].where("sha256 <> ''").select("id", content.reference_title(F.col("sha256")).alias("title"))


@query("SELECT job_id, arg_max(status, (ts, n)) AS status FROM (SELECT id AS job_id, 'pending' AS status, scheduled_at AS ts, 0 AS n FROM m_jobs UNION ALL SELECT id, 'running', started_at, 1 FROM m_jobs WHERE started_at IS NOT NULL UNION ALL SELECT id, status, updated_at, 2 FROM m_jobs WHERE status IN ('succeeded', 'failed', 'dead')) GROUP BY job_id")
def job_states_folded(t):
    """The state of each job after the marks that were put on it."""
    j = t["jobs"]
    marks = j.select(F.col("id").alias("job_id"), F.lit("pending").alias("status"), F.col("scheduled_at").alias("at"), F.lit(0).alias("id"))
    marks = marks.unionAll(j.where("started_at IS NOT NULL").select("id", F.lit("running"), "started_at", F.lit(1)))
    marks = marks.unionAll(j.where("status IN ('succeeded', 'failed', 'dead')").select("id", "status", "updated_at", F.lit(2)))
    return library.fold_events(marks)


@query("SELECT job_id, id, level FROM m_job_events WHERE job_id = 5")
def job_events_of_one(t):
    """All events of a job."""
    return library.list_job_events(t, 5, limit=None).select("job_id", "id", "level")


@query("SELECT id FROM m_clusters WHERE CASE WHEN id = 3 THEN 'confirmed' ELSE status END = 'confirmed'")
def cluster_confirmed(t):
    return clusters.set_cluster_status(t, 3, "confirmed").where("status = 'confirmed'").select("id")


@query("SELECT id, CASE WHEN id = 1 AND status IN ('failed', 'dead') THEN 'pending' ELSE status END AS status FROM m_jobs")
def job_retried(t):
    return library.retry(t, 1, F.lit(datetime(2024, 3, 1))).select("id", "status")


_POOL = "SELECT job_id * 2 + 1 AS file_id, id, id * 7919 % 1200000 AS timestamp_ms, CASE WHEN id % 50 = 0 THEN '0000000000000000' ELSE substr(md5(CAST(id % 701 AS STRING)), 1, 16) END AS phash FROM {}"


@query(f"""WITH RECURSIVE pool AS ({_POOL.format("m_job_events")}),
c0 AS (SELECT file_id, timestamp_ms AS ms, phash, min(id) AS id FROM pool GROUP BY ALL),
v AS (SELECT va.file_id, CASE WHEN duration_ms > 0 THEN duration_ms ELSE last END AS length FROM m_video_assets va JOIN (SELECT file_id, max(ms) AS last FROM c0 GROUP BY file_id) USING (file_id)),
w AS (SELECT *, least(3000, length // 10) AS head, length - 2 * least(3000, length // 10) AS span, CASE WHEN length <= 30000 THEN 4 WHEN length <= 300000 THEN 6 WHEN length <= 1200000 THEN 10 WHEN length <= 3600000 THEN 16 ELSE 24 END AS budget FROM v),
c1 AS (SELECT c0.*, head, span, budget, (budget * 7 + 5) // 10 AS n FROM c0 JOIN w USING (file_id) WHERE phash <> '0000000000000000' AND ms BETWEEN head AND head + span),
c AS (SELECT *, least((ms - head) * n // greatest(span, 1), n - 1) AS slot, CAST('0x' || substr(phash, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(phash, 9, 8) AS BIGINT) AS h2 FROM c1),
e AS (SELECT *, row_number() OVER (PARTITION BY file_id, phash ORDER BY ms, id) AS again FROM (SELECT *, row_number() OVER (PARTITION BY file_id, slot ORDER BY abs(2 * n * (ms - head) - (2 * slot + 1) * span), ms, id) AS k FROM c) WHERE k = 1),
ev AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY ms, id) AS place, count(*) OVER (PARTITION BY file_id) AS had FROM e WHERE again = 1),
g AS (SELECT c.file_id, c.id, c.ms, c.h1, c.h2, min(bit_count(xor(c.h1, ev.h1)) + bit_count(xor(c.h2, ev.h2))) AS far, any_value(ev.had) AS r, any_value(c.budget) AS budget FROM c JOIN ev USING (file_id) GROUP BY ALL
UNION ALL SELECT file_id, id, ms, h1, h2, least(far, bit_count(xor(h1, p1)) + bit_count(xor(h2, p2))), r + 1, budget
FROM (SELECT *, first_value(h1) OVER p AS p1, first_value(h2) OVER p AS p2, max(far) OVER (PARTITION BY file_id) AS farthest FROM g WINDOW p AS (PARTITION BY file_id ORDER BY far DESC, ms, id)) WHERE farthest > 0 AND r < budget)
SELECT file_id, id, ms AS timestamp_ms, 'even' AS how, place FROM ev
UNION ALL SELECT file_id, id, ms, 'change', r + 1 FROM (SELECT *, row_number() OVER (PARTITION BY file_id, r ORDER BY far DESC, ms, id) AS k FROM g) WHERE k = 1 AND far > 0 AND r < budget""")
def video_keyframes(t):
    """Keyframes of 97 videos among many candidates, one for each event of a job, as the library's own videos have four frames each."""
    t["job_events"].createOrReplaceTempView("_keyframe_pool")
    return keyframes.keyframes(t, t["job_events"].sparkSession.sql(_POOL.format("_keyframe_pool")))
