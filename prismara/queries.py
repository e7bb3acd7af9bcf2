"""Registered queries over the made-up library, each with the SQL that DuckDB runs beside it."""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import labels, search, vectors
from .operators.lineage import settled, shared_folder
from .operators.nearest import within
from .operators.relational import after, latest_per, top_n_per
from .plans import clusters, content, features, files, ingest, library, person, searchindex, series
from .sources.catalog import Tables
from .synthetic import library as made
from .synthetic import oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str = "") -> Callable:
    """Registers a function of the library's tables under its name."""

    def put(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(made(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = oracle(sql)
        return f

    return put


LATEST_REVIEW = "rv AS (SELECT file_id, action_type FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY created_at DESC, id DESC) AS n FROM m_review_actions WHERE file_id IS NOT NULL) WHERE n = 1)"
QUALITY = "q AS (SELECT file_id, quality_score, quality_tier FROM (SELECT r.*, row_number() OVER (PARTITION BY r.file_id ORDER BY r.created_at DESC, r.id DESC) AS n FROM m_analysis_results r JOIN m_file_current_analysis c ON c.analysis_result_id = r.id AND c.analysis_type = 'quality') WHERE n = 1)"
TOP_TAGS = "tg AS (SELECT file_id, string_agg(display_name, '|' ORDER BY n) AS tags FROM (SELECT ft.file_id, t.display_name, row_number() OVER (PARTITION BY ft.file_id ORDER BY CASE ft.source WHEN 'human' THEN 0 WHEN 'ai' THEN 1 ELSE 2 END, t.display_name, t.id) AS n FROM m_file_tags ft JOIN m_tags t ON t.id = ft.tag_id) WHERE n <= 3 GROUP BY file_id)"
OVERVIEW = f"""{LATEST_REVIEW}, {QUALITY}, o AS (
SELECT f.*, coalesce(i.width, v.width) AS width, coalesce(i.height, v.height) AS height, v.duration_ms, s.document_text, q.quality_score, q.quality_tier, rv.action_type AS review_action
FROM m_files f LEFT JOIN m_image_assets i ON i.file_id = f.id LEFT JOIN m_video_assets v ON v.file_id = f.id LEFT JOIN m_search_documents s ON s.file_id = f.id
LEFT JOIN q ON q.file_id = f.id LEFT JOIN rv ON rv.file_id = f.id)"""
SHOWN = "id, file_name, width, height, quality_score, review_action"
SHOWN_LIST = SHOWN.split(", ")


def _listed(t: Tables, **options) -> DataFrame:
    return files.listed(t, files.ListOptions(**options)).select(*SHOWN_LIST, F.array_join("tags", "|").alias("tags"))


def _list_sql(where: str, order: str, limit: int = 21) -> str:
    return f"WITH {OVERVIEW}, {TOP_TAGS} SELECT {', '.join('o.' + c for c in SHOWN_LIST)}, tg.tags FROM o LEFT JOIN tg ON tg.file_id = o.id WHERE {where} ORDER BY {order} LIMIT {limit}"


@query(_list_sql("true", "o.updated_at DESC, o.id DESC"))
def list_files_default(t):
    return _listed(t)


@query(_list_sql("media_type = 'image' AND status = 'active' AND quality_tier = 'high'", "o.size_bytes DESC, o.id DESC"))
def list_files_filtered(t):
    return _listed(t, media_type="image", status="active", quality_tier="high", sort="size_desc")


@query(_list_sql("true", "coalesce(o.quality_score, -1) DESC, o.updated_at DESC, o.id DESC"))
def list_files_quality_sort(t):
    return _listed(t, sort="quality_desc")


@query(_list_sql("volume_id = 2", "o.file_name, o.id"))
def list_files_name_sort(t):
    return _listed(t, volume_id=2, sort="name_asc")


@query(_list_sql("(o.size_bytes, o.id) > (300, 50)", "o.size_bytes, o.id"))
def list_files_keyset_page2(t):
    row = {"size_bytes": 300, "id": 50}
    return _listed(t, sort="size_asc", cursor=files.encode_cursor("size_asc", row))


def _overview(t: Tables, **options) -> DataFrame:
    return files.filtered(t, files.ListOptions(**options)).select(*SHOWN_LIST)


def _overview_sql(where: str) -> str:
    return f"WITH {OVERVIEW} SELECT {SHOWN} FROM o WHERE {where}"


@query(_overview_sql("true"))
def files_overview(t):
    return _overview(t)


_INDEXES: dict[tuple, searchindex.SearchIndex] = {}


def _index(t: Tables, part: str) -> searchindex.SearchIndex:
    """The postings or the trigrams of a library, built once a session."""
    spark = t["files"].sparkSession
    key = spark.sparkContext.applicationId, getattr(t, "sf_dir", id(t)), part
    if key not in _INDEXES:
        _INDEXES[key] = searchindex.build(t, shared_folder(spark, "search"), postings=part == "postings", trigrams=part == "trigrams")
    return _INDEXES[key]


def _like(part: str) -> str:
    return " OR ".join(f"{c} ILIKE '%{part}%'" for c in searchindex.FIELDS)


def _containing(t: Tables, part: str) -> DataFrame:
    # A part without trigrams can't be narrowed by an index, so none is built for it.
    found = _index(t, "trigrams").containing(t, part) if searchindex.grams_of(part) else searchindex.looked_at(t, part)
    return _overview(t).join(found.withColumnRenamed("file_id", "id"), "id", "left_semi")


@query(_overview_sql(_like("set1")))
def search_ilike(t):
    return _containing(t, "set1")


@query(_overview_sql(_like("s_t%1__.m")))
def search_wildcards(t):
    """A part with wild cards, whose plain runs are all short: every file is looked at."""
    return _containing(t, "s_t%1__.m")


@query(_overview_sql(_like("the %_ns")))
def search_long_wildcards(t):
    """A part with wild cards, of which one plain run narrows the search."""
    return _containing(t, "the %_ns")


_TOKENS = r"regexp_extract_all(lower(document_text), '[\p{L}\p{N}]+')"
_NAMES = rf"regexp_extract_all(lower(document_text), '{search.COMPOUND}')"
_LEAST = "(SELECT min(n) FROM (SELECT unnest(" + _NAMES + ") AS n FROM m_search_documents))"


def _found(t: Tables, words: str) -> DataFrame:
    return _index(t, "postings").search(words).select(F.col("file_id").alias("id"))


@query(f"SELECT file_id AS id FROM m_search_documents WHERE list_contains({_NAMES}, {_LEAST}) AND NOT list_contains({_TOKENS}, 'der')")
def search_compound(t):
    """The texts with the first of all names of joined words (hosts, paths, hyphenated words), and without another word."""
    names = F.regexp_extract_all(F.lower("document_text"), F.lit(search.COMPOUND), 0)
    least = t["search_documents"].select(F.explode(names).alias("n")).agg(F.min("n")).first()[0]
    return _found(t, f"{least} -der")


@query(f"SELECT file_id AS id FROM m_search_documents WHERE NOT list_contains({_TOKENS}, 'the') OR (list_contains({_TOKENS}, 'and') AND (' ' || array_to_string({_TOKENS}, ' ') || ' ') LIKE '% of the %')")
def search_only_negation(t):
    return _found(t, '-the or and "of the"')


@query(f"WITH {OVERVIEW} SELECT id FROM o WHERE list_contains({_TOKENS}, 'the') AND list_contains({_TOKENS}, 'of')")
def search_all_terms(t):
    return _found(t, "the of")


@query(f"WITH {OVERVIEW} SELECT id FROM o WHERE (list_contains({_TOKENS}, 'la') AND NOT list_contains({_TOKENS}, 'les')) OR list_contains({_TOKENS}, 'der')")
def search_negation(t):
    return _found(t, "la -les or der")


@query(f"WITH {OVERVIEW} SELECT id FROM o WHERE (' ' || array_to_string({_TOKENS}, ' ') || ' ') LIKE '% of the %'")
def search_phrase(t):
    return _found(t, '"of the"')


@query(f"WITH {LATEST_REVIEW} SELECT * FROM rv")
def latest_review_per_file(t):
    return files.latest_review(t).select("file_id", "action_type")


@query("SELECT file_id, embedding_type, model_name FROM (SELECT *, row_number() OVER (PARTITION BY file_id, embedding_type ORDER BY id DESC) AS n FROM m_embeddings) WHERE n = 1")
def latest_embedding_per_type(t):
    return latest_per(t["embeddings"], ["file_id", "embedding_type"], [F.desc("id")]).select("file_id", "embedding_type", "model_name")


@query(f"WITH {TOP_TAGS} SELECT * FROM tg")
def tag_summary_top3(t):
    return files.tag_summary(t).select("file_id", F.array_join("tags", "|").alias("tags"))


@query(_overview_sql("EXISTS (SELECT 1 FROM m_file_tags ft WHERE ft.file_id = o.id)"))
def has_tags_semi(t):
    return _overview(t, has_tags="true")


@query(_overview_sql("NOT EXISTS (SELECT 1 FROM m_file_tags ft WHERE ft.file_id = o.id)"))
def has_no_tags_anti(t):
    return _overview(t, has_tags="false")


@query("SELECT f.id, f.file_name, t.name FROM m_files f JOIN m_file_tags ft ON ft.file_id = f.id JOIN m_tags t ON t.id = ft.tag_id WHERE t.namespace = 'person' AND ft.source = 'human'")
def human_person_tags(t):
    rows = t["file_tags"].where("source = 'human'").join(t["tags"].where("namespace = 'person'").select(F.col("id").alias("tag_id"), "name"), "tag_id")
    return t["files"].join(rows.select(F.col("file_id").alias("id"), "name"), "id").select("id", "file_name", "name")


_TAGGED = "EXISTS (SELECT 1 FROM m_file_tags ft JOIN m_tags t ON t.id = ft.tag_id WHERE ft.file_id = o.id AND {} AND (t.name = {value} OR t.display_name = {value}))"


@query(_overview_sql(_TAGGED.format("t.namespace = 'person'", value="(SELECT min(name) FROM m_tags WHERE namespace = 'person')")))
def tag_filter_exists(t):
    name = t["tags"].where("namespace = 'person'").agg(F.min("name")).first()[0]
    return _overview(t, tag=name, tag_namespace="person")


@query(_overview_sql(_TAGGED.format("true", value="(SELECT max(display_name) FROM m_tags)")))
def tag_filter_display_name(t):
    name = t["tags"].agg(F.max("display_name")).first()[0]
    return _overview(t, tag=name)


@query(_overview_sql("o.status = 'missing'"))
def filters_beside_nothing(t):
    """A namespace without a tag and a cluster status without a kind ask for nothing."""
    return _overview(t, status="missing", tag_namespace="person", cluster_status="confirmed")


@query(_overview_sql("false"))
def has_tags_other(t):
    return _overview(t, has_tags="maybe")


@query(_overview_sql("EXISTS (SELECT 1 FROM m_cluster_members cm JOIN m_clusters c ON c.id = cm.cluster_id WHERE cm.file_id = o.id AND c.cluster_type = 'same_person' AND c.status = 'confirmed')"))
def cluster_filter_exists(t):
    return _overview(t, cluster_type="same_person", cluster_status="confirmed")


@query("SELECT count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status IN ('leased', 'running')) AS running, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'dead') AS dead, count(*) FILTER (WHERE status = 'succeeded') AS succeeded FROM m_jobs")
def job_status_summary(t):
    return library.task_summary(t)


@query("""WITH ev AS (SELECT coalesce(e.file_id, vf.file_id) AS file_id, max(embedding_type = 'person_visual') AS person, max(embedding_type IN ('image_visual', 'video_frame_visual')) AS generic FROM m_embeddings e LEFT JOIN m_video_frames vf ON vf.id = e.frame_id GROUP BY 1),
m AS (SELECT cm.cluster_id AS id, count(*) AS members, count(*) FILTER (WHERE score >= 0.80) AS strong_members, max(score) AS top_score, count(DISTINCT cm.file_id) FILTER (WHERE person) AS person_members, count(DISTINCT cm.file_id) FILTER (WHERE generic) AS generic_members FROM m_cluster_members cm LEFT JOIN ev ON ev.file_id = cm.file_id GROUP BY cm.cluster_id)
SELECT c.id, c.cluster_type, c.status, coalesce(members, 0) AS members, coalesce(strong_members, 0) AS strong_members, round(top_score, 4) AS top_score, coalesce(person_members, 0) AS person_members, coalesce(generic_members, 0) AS generic_members,
CASE WHEN person_members > 0 THEN 'person_visual' WHEN generic_members > 0 THEN 'generic_visual' END AS top_evidence FROM m_clusters c LEFT JOIN m ON m.id = c.id""")
def cluster_list(t):
    df = clusters.list_clusters(t, limit=None)
    return df.select("id", "cluster_type", "status", "members", "strong_members", F.round("top_score", 4).alias("top_score"), "person_members", "generic_members", "top_evidence")


@query("""WITH d AS (SELECT coalesce(e.file_id, vf.file_id) AS file_id, embedding_type, model_name, count(*) AS vectors FROM m_embeddings e LEFT JOIN m_video_frames vf ON vf.id = e.frame_id WHERE embedding_type IN ('person_visual', 'image_visual', 'video_frame_visual') GROUP BY ALL),
e AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY CASE embedding_type WHEN 'person_visual' THEN 0 ELSE 1 END, vectors DESC, model_name DESC, embedding_type) AS n FROM d)
SELECT cm.cluster_id, cm.file_id, cm.role, round(cm.score, 4) AS score, f.file_name, f.status AS file_status, e.embedding_type, e.model_name, e.vectors,
CASE WHEN e.model_name LIKE 'semantic-%' THEN 'semantic' WHEN e.model_name LIKE 'ffmpeg-%' THEN 'pixel' WHEN e.model_name LIKE 'placeholder%' THEN 'placeholder' WHEN e.model_name IS NOT NULL THEN 'unknown' END AS provider
FROM m_cluster_members cm JOIN m_files f ON f.id = cm.file_id LEFT JOIN e ON e.file_id = cm.file_id AND e.n = 1""")
def cluster_detail_members(t):
    return clusters.cluster_members(t).select("cluster_id", "file_id", "role", F.round("score", 4).alias("score"), "file_name", "file_status", "embedding_type", "model_name", "vectors", "provider")


@query("SELECT c.id, c.title, count(cm.file_id) AS members FROM m_clusters c LEFT JOIN m_cluster_members cm ON cm.cluster_id = c.id WHERE c.cluster_type = 'same_series' GROUP BY ALL ORDER BY max(c.created_at) DESC NULLS FIRST, c.id DESC LIMIT 20")
def cluster_list_newest(t):
    """The first page of clusters of a kind."""
    return clusters.list_clusters(t, "same_series").select("id", "title", "members")


@query("SELECT c.cluster_type, c.status, count(DISTINCT c.id) AS clusters, count(cm.file_id) AS members FROM m_clusters c LEFT JOIN m_cluster_members cm ON cm.cluster_id = c.id GROUP BY c.cluster_type, c.status")
def cluster_summary(t):
    return clusters.summarize_clusters(t)


@query("SELECT t.id, t.namespace, t.display_name, count(ft.tag_id) AS uses FROM m_tags t LEFT JOIN m_file_tags ft ON ft.tag_id = t.id GROUP BY t.id, t.namespace, t.display_name")
def tag_counts(t):
    return library.list_tags(t, limit=None).select("id", "namespace", "display_name", "uses")


@query("SELECT t.id, t.display_name, count(ft.tag_id) AS uses FROM m_tags t LEFT JOIN m_file_tags ft ON ft.tag_id = t.id WHERE t.namespace = 'person' GROUP BY t.id, t.display_name ORDER BY uses DESC, display_name, id LIMIT 20")
def tag_list_top20(t):
    return library.list_tags(t, namespace="person").select("id", "display_name", "uses")


@query("SELECT embedding_type, CASE WHEN model_name LIKE 'semantic-%' THEN 'semantic' WHEN model_name LIKE 'ffmpeg-%' THEN 'pixel' WHEN model_name LIKE 'placeholder%' THEN 'placeholder' ELSE 'unknown' END AS provider, model_name, count(*) AS vectors FROM m_embeddings WHERE embedding_type IN ('image_visual', 'video_frame_visual') GROUP BY ALL")
def embedding_inventory(t):
    return files.embedding_inventory(t)


SCORES = """s AS (SELECT f.id AS file_id, f.media_type, coalesce(i.width, v.width) AS w, coalesce(i.height, v.height) AS h, v.bitrate, v.fps, v.duration_ms, v.video_codec, v.container, i.format
FROM m_files f LEFT JOIN m_image_assets i ON i.file_id = f.id LEFT JOIN m_video_assets v ON v.file_id = f.id),
sc AS (SELECT *, CAST(least(100, 20 + CASE WHEN w IS NULL OR h IS NULL THEN 0 WHEN w * h >= 3840 * 2160 THEN 60 WHEN w * h >= 1920 * 1080 THEN 45 WHEN w * h >= 1280 * 720 THEN 32 WHEN w * h >= 854 * 480 THEN 18 ELSE 8 END
+ CASE WHEN media_type <> 'video' THEN 0 ELSE CASE WHEN bitrate IS NULL THEN 0 WHEN bitrate >= 8000000 THEN 20 WHEN bitrate >= 4000000 THEN 12 WHEN bitrate >= 1500000 THEN 6 ELSE 2 END
+ CASE WHEN fps IS NULL THEN 0 WHEN fps >= 50 THEN 8 WHEN fps >= 29.97 THEN 5 WHEN fps >= 23.976 THEN 3 ELSE 1 END
+ CASE WHEN duration_ms >= 600000 THEN 6 WHEN duration_ms >= 120000 THEN 4 WHEN duration_ms >= 30000 THEN 2 ELSE 0 END
+ CASE video_codec WHEN 'hevc' THEN 4 WHEN 'h265' THEN 4 WHEN 'av1' THEN 4 WHEN 'h264' THEN 2 ELSE 0 END + CASE container WHEN 'mkv' THEN 2 WHEN 'mp4' THEN 1 WHEN 'mov' THEN 1 ELSE 0 END END) AS DOUBLE) AS quality_score FROM s),
ti AS (SELECT *, CASE WHEN quality_score >= 75 THEN 'high' WHEN quality_score >= 45 THEN 'medium' ELSE 'low' END AS quality_tier FROM sc)"""


@query(f"""WITH {SCORES} SELECT file_id, quality_score, quality_tier, media_type || ' quality ' || quality_tier || ', ' || concat_ws(' • ', w || 'x' || h, CASE WHEN media_type = 'video' THEN container || ' ' || video_codec ELSE format END,
CASE WHEN bitrate >= 1000000 THEN printf('%.1f Mbps', bitrate / 1000000.0) WHEN bitrate >= 1000 THEN (bitrate // 1000) || ' Kbps' WHEN bitrate IS NOT NULL THEN bitrate || ' bps' END, CASE WHEN fps IS NOT NULL THEN printf('%.2f fps', fps) END) || '.' AS summary FROM ti""")
def quality_scores(t):
    return ingest.infer_quality(t)


@query(f"WITH {SCORES} SELECT media_type, quality_tier, count(*) AS files FROM ti GROUP BY media_type, quality_tier")
def quality_tier_counts(t):
    df = ingest.infer_quality(t).join(t["files"].select(F.col("id").alias("file_id"), "media_type"), "file_id")
    return df.groupBy("media_type", "quality_tier").agg(F.count("*").alias("files"))


@query("""SELECT f.id AS file_id, concat_ws(' ', f.file_name, f.abs_path, f.extension, f.media_type, f.status, i.format, v.container, v.video_codec, v.audio_codec, i.orientation, coalesce(i.width, v.width) || 'x' || coalesce(i.height, v.height), (v.duration_ms // 1000) || 's') AS document_text
FROM m_files f LEFT JOIN m_image_assets i ON i.file_id = f.id LEFT JOIN m_video_assets v ON v.file_id = f.id""")
def search_documents(t):
    return ingest.search_documents(t)


@query("""WITH s AS (SELECT f.id, f.sha256, coalesce(q.quality_score, 0) * 100 + CAST(coalesce(i.width, v.width) AS DOUBLE) * coalesce(i.height, v.height) + coalesce(v.duration_ms, 0) / 1000 + f.size_bytes / 1e6::DOUBLE + coalesce(v.bitrate, 0) / 1e5::DOUBLE + coalesce(v.fps, 0) * 10
  + CASE v.container WHEN 'mkv' THEN 6 WHEN 'mp4' THEN 4 WHEN 'mov' THEN 3 ELSE 0 END AS raw FROM m_files f LEFT JOIN m_image_assets i ON i.file_id = f.id LEFT JOIN m_video_assets v ON v.file_id = f.id
  LEFT JOIN m_file_current_analysis c ON c.file_id = f.id AND c.analysis_type = 'quality' LEFT JOIN m_analysis_results q ON q.id = c.analysis_result_id WHERE f.status <> 'trashed' AND f.sha256 <> ''),
g AS (SELECT *, count(*) OVER (PARTITION BY sha256) AS n, row_number() OVER (PARTITION BY sha256 ORDER BY raw DESC, id) AS rank, max(raw) OVER (PARTITION BY sha256) AS top FROM s)
SELECT 'sha256:' || sha256 AS cluster_key, id AS file_id, CAST(rank AS INT) AS rank, CASE rank WHEN 1 THEN 'best_quality' ELSE 'duplicate_candidate' END AS role, round(least(1, greatest(0, raw / CASE WHEN top > 0 THEN top ELSE 1 END)), 6) AS score FROM g WHERE n > 1""")
def exact_duplicates_ranked(t):
    return content.exact_copies(features.file_features(t, ("quality",))).select("cluster_key", "file_id", "rank", "role", F.round("score", 6).alias("score"))


_ASPECT = "abs(CAST(a.width AS DOUBLE) / a.height - CAST(b.width AS DOUBLE) / b.height) <= 0.20"
_ORIENT = "sign(a.width - a.height) = sign(b.width - b.height)"


@query(f"""WITH p AS (SELECT i.*, CAST('0x' || phash AS UBIGINT) AS bits FROM m_image_assets i JOIN m_files f ON f.id = i.file_id)
SELECT a.file_id AS a_id, b.file_id AS b_id, CAST(bit_count(xor(a.bits, b.bits)) AS INT) AS bits FROM p a JOIN p b ON substr(a.phash, 1, 4) = substr(b.phash, 1, 4) AND a.file_id <> b.file_id WHERE bit_count(xor(a.bits, b.bits)) <= 4 AND {_ORIENT} AND {_ASPECT}""")
def phash_near_pairs(t):
    return content.phash_pairs(_features(t, "phash"))


#: The frames that stand for a video, and the latest vectors of each: of the kinds asked for, of any model or of each.
UFRAMES = "uf AS (SELECT * FROM m_video_frames WHERE frame_role = 'understanding')"
FLOOKS = "fl AS (SELECT file_id, frame_id, model_name, v FROM (SELECT uf.file_id, uf.id AS frame_id, e.model_name, e.vector AS v, row_number() OVER (PARTITION BY uf.id ORDER BY e.id DESC) AS n FROM uf JOIN m_embeddings e ON e.frame_id = uf.id AND e.embedding_type = 'video_frame_visual') WHERE n = 1)"
FMODELS = "fm AS (SELECT file_id, frame_id, model_name, v FROM (SELECT uf.file_id, uf.id AS frame_id, e.model_name, e.vector AS v, row_number() OVER (PARTITION BY uf.id, e.model_name ORDER BY e.id DESC) AS n FROM uf JOIN m_embeddings e ON e.frame_id = uf.id AND e.embedding_type = 'video_frame_visual') WHERE n = 1)"
_ALIKE = f"{_ORIENT} AND {_ASPECT} AND CAST(least(a.duration_ms, b.duration_ms) AS DOUBLE) / greatest(a.duration_ms, b.duration_ms) >= 0.85"
SHARED = f"""h AS (SELECT DISTINCT uf.file_id, uf.phash FROM uf JOIN m_files f ON f.id = uf.file_id WHERE uf.phash <> '' AND f.status <> 'trashed'), sh AS (SELECT a.file_id AS a_id, b.file_id AS b_id, count(DISTINCT b.phash) AS shared FROM h a JOIN h b ON a.phash = b.phash AND a.file_id <> b.file_id GROUP BY 1, 2 HAVING count(DISTINCT b.phash) >= 2),
fp AS (SELECT sh.* FROM sh JOIN m_video_assets a ON a.file_id = a_id JOIN m_video_assets b ON b.file_id = b_id WHERE {_ALIKE})"""
NEARF = f"""nf AS (SELECT a.file_id AS a_id, b.file_id AS b_id, count(DISTINCT a.frame_id) AS shared FROM fl a JOIN fm b ON a.model_name = b.model_name AND a.file_id <> b.file_id AND list_distance(a.v, b.v) <= 0.10 JOIN m_files x ON x.id = a.file_id AND x.status <> 'trashed' JOIN m_files y ON y.id = b.file_id AND y.status <> 'trashed' GROUP BY 1, 2 HAVING count(DISTINCT a.frame_id) >= 2),
fv AS (SELECT nf.* FROM nf JOIN m_video_assets a ON a.file_id = a_id JOIN m_video_assets b ON b.file_id = b_id WHERE {_ALIKE})"""


SERIES_PARTS = ("about", "phash", "image", "frame_phashes", "frame_looks")


def _features(t: Tables, *parts: str) -> DataFrame:
    """Every file's features, computed once for the joins that read them several times."""
    return settled(features.file_features(t, parts))


def _alive(t: Tables, *parts: str) -> DataFrame:
    return _features(t, *parts).where("status <> 'trashed'")


@query(f"WITH {UFRAMES}, {SHARED} SELECT * FROM fp")
def frame_shared_phash_pairs(t):
    return content.frame_phash_pairs(_alive(t, "frame_phashes"))


@query(f"WITH {UFRAMES}, {FLOOKS}, {FMODELS}, {NEARF} SELECT * FROM fv")
def frame_vector_pairs(t):
    return content.frame_vector_pairs(_alive(t, "frame_looks", "frame_models"))


@query(f"WITH {UFRAMES}, {FLOOKS} SELECT file_id, frame_id, model_name FROM fl")
def latest_frame_vectors(t):
    return features.frame_vectors(t, ("video_frame_visual",)).select("file_id", "frame_id", F.col("model").alias("model_name"))


@query(f"WITH {UFRAMES} SELECT file_id, frame_id, embedding_type, model_name FROM (SELECT uf.file_id, uf.id AS frame_id, e.embedding_type, e.model_name, row_number() OVER (PARTITION BY uf.id ORDER BY CASE WHEN e.embedding_type = 'person_visual' THEN 0 ELSE 1 END, e.id DESC) AS n FROM uf JOIN m_embeddings e ON e.frame_id = uf.id AND e.embedding_type IN ('person_visual', 'video_frame_visual')) WHERE n = 1")
def latest_person_frame_vectors(t):
    return features.frame_vectors(t, ("person_visual", "video_frame_visual")).select("file_id", "frame_id", F.col("kind").alias("embedding_type"), F.col("model").alias("model_name"))


_VECS = "e AS (SELECT id, embedding_type, model_name, vector AS v FROM m_embeddings)"


def _vectors(t: Tables, p: str) -> DataFrame:
    return t["embeddings"].select(F.col("id").alias(f"{p}_id"), "embedding_type", "model_name", vectors.doubles(F.col("vector")).alias(f"{p}_v"))


@query(f"WITH {_VECS} SELECT a.id AS a_id, b.id AS b_id, round(list_distance(a.v, b.v), 6) AS distance FROM e a JOIN e b ON a.embedding_type = b.embedding_type AND a.model_name = b.model_name AND a.id <> b.id WHERE list_distance(a.v, b.v) <= 0.10")
def embedding_range_pairs(t):
    met = within(_vectors(t, "a"), _vectors(t, "b"), ["embedding_type", "model_name"], 0.10, digits=6)
    return met.where("a_id <> b_id").select("a_id", "b_id", "distance")


#: Near images by the latest vector of a and the latest of b in that model, 24 at most that fit. A mean of differences within the threshold follows from the distance.
NEARI = f"""il AS (SELECT file_id, model_name, v FROM (SELECT file_id, model_name, vector AS v, row_number() OVER (PARTITION BY file_id ORDER BY id DESC) AS n FROM m_embeddings WHERE embedding_type = 'image_visual' AND file_id IS NOT NULL) WHERE n = 1),
im AS (SELECT file_id, model_name, v FROM (SELECT file_id, model_name, vector AS v, row_number() OVER (PARTITION BY file_id, model_name ORDER BY id DESC) AS n FROM m_embeddings WHERE embedding_type = 'image_visual' AND file_id IS NOT NULL) WHERE n = 1),
ia AS (SELECT i.* FROM m_image_assets i JOIN m_files f ON f.id = i.file_id WHERE f.media_type = 'image' AND f.status <> 'trashed'),
ni AS (SELECT a.file_id AS a_id, b.file_id AS b_id, list_distance(x.v, y.v) AS distance FROM il x JOIN im y ON x.model_name = y.model_name AND x.file_id <> y.file_id AND list_distance(x.v, y.v) <= 0.08 JOIN ia a ON a.file_id = x.file_id JOIN ia b ON b.file_id = y.file_id
  WHERE {_ORIENT} AND {_ASPECT} AND least(CAST(a.width AS DOUBLE) * a.height, CAST(b.width AS DOUBLE) * b.height) / greatest(CAST(a.width AS DOUBLE) * a.height, CAST(b.width AS DOUBLE) * b.height) >= 0.20),
ve AS (SELECT a_id, b_id FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY distance, b_id) AS n FROM ni) WHERE n <= 24)"""


@query(f"WITH {NEARI} SELECT * FROM ve")
def embedding_knn24(t):
    return content.vector_pairs(_alive(t, "image", "image_models")).select("a_id", "b_id")


FAMILY = r"btrim_(regexp_replace(regexp_replace(lower(regexp_replace(f.file_name, '\.[^./]*$', '')), '[_ .]', '-', 'g'), '-\d+$', ''))".replace("btrim_", "trim")
_MEAN = "list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2]))) / 64"
SERIES = f"""{UFRAMES}, {FLOOKS}, x AS (SELECT f.id, f.parent_path, f.media_type, f.mtime, {FAMILY} AS family, coalesce(i.width, v.width) AS width, coalesce(i.height, v.height) AS height, v.duration_ms, i.phash,
  json_extract_string(r.structured_attributes, '$.capture_type') AS capture FROM m_files f LEFT JOIN m_image_assets i ON i.file_id = f.id LEFT JOIN m_video_assets v ON v.file_id = f.id
  LEFT JOIN m_file_current_analysis c ON c.file_id = f.id AND c.analysis_type = 'understanding' LEFT JOIN m_analysis_results r ON r.id = c.analysis_result_id WHERE f.status = 'active'),
hh AS (SELECT file_id, list(DISTINCT phash) AS hs FROM uf WHERE phash <> '' GROUP BY file_id),
il AS (SELECT file_id, model_name, v FROM (SELECT file_id, model_name, vector AS v, row_number() OVER (PARTITION BY file_id ORDER BY id DESC) AS n FROM m_embeddings WHERE embedding_type = 'image_visual' AND file_id IS NOT NULL) WHERE n = 1),
cd AS (SELECT a.id AS a_id, b.id AS b_id, a.media_type, a.phash AS a_phash, b.phash AS b_phash, a.parent_path = b.parent_path AND a.family = b.family AS both_ FROM x a JOIN x b ON a.id <> b.id AND a.media_type = b.media_type AND abs(epoch_us(a.mtime) - epoch_us(b.mtime)) <= 1800000000 AND (a.parent_path = b.parent_path OR a.family = b.family)
  WHERE {_ASPECT} AND CAST(least(CAST(a.width AS DOUBLE) * a.height, CAST(b.width AS DOUBLE) * b.height) AS DOUBLE) / greatest(CAST(a.width AS DOUBLE) * a.height, CAST(b.width AS DOUBLE) * b.height) >= 0.20
  AND (a.media_type <> 'video' OR (CAST(least(a.duration_ms, b.duration_ms) AS DOUBLE) / greatest(a.duration_ms, b.duration_ms) >= 0.85 AND {_ORIENT})) AND NOT coalesce(a.capture <> b.capture, false)),
vi AS (SELECT cd.a_id, cd.b_id FROM cd JOIN il a ON a.file_id = cd.a_id JOIN il b ON b.file_id = cd.b_id AND a.model_name = b.model_name WHERE cd.media_type = 'image' AND {_MEAN} <= 0.08
  UNION SELECT cd.a_id, cd.b_id FROM cd JOIN fl a ON a.file_id = cd.a_id JOIN fl b ON b.file_id = cd.b_id AND a.model_name = b.model_name WHERE cd.media_type = 'video' AND {_MEAN} <= 0.10),
pr AS (SELECT cd.a_id, cd.b_id FROM cd LEFT JOIN hh ha ON ha.file_id = cd.a_id LEFT JOIN hh hb ON hb.file_id = cd.b_id LEFT JOIN vi ON vi.a_id = cd.a_id AND vi.b_id = cd.b_id
  WHERE both_ OR vi.a_id IS NOT NULL OR CASE WHEN media_type = 'image' THEN coalesce(bit_count(xor(CAST('0x' || a_phash AS UBIGINT), CAST('0x' || b_phash AS UBIGINT))) <= 8, false) ELSE coalesce(list_has_any(ha.hs, hb.hs), false) END)"""


@query(f"WITH {SERIES} SELECT a_id, b_id FROM pr")
def series_pairs(t):
    return series.pairs(_features(t, *SERIES_PARTS))


@query(f"""WITH {SERIES}, m AS (SELECT a_id AS anchor_id, b_id AS file_id FROM pr UNION SELECT DISTINCT a_id, a_id FROM pr), o AS (SELECT m.*, f.mtime, row_number() OVER (PARTITION BY anchor_id ORDER BY f.mtime, m.file_id) - 1 AS place, count(*) OVER (PARTITION BY anchor_id) AS n, min(f.mtime) OVER (PARTITION BY anchor_id) AS start FROM m JOIN m_files f ON f.id = m.file_id)
SELECT anchor_id, 'same_series:' || substr(sha1(x.parent_path), 1, 12) || ':' || CASE x.family WHEN '' THEN '' ELSE x.family || ':' END || strftime(start, '%Y%m%dT%H%M') AS cluster_key, file_id, CAST(place AS INT) AS place, CASE WHEN place = n // 2 THEN 'series_focus' ELSE 'member' END AS role, CAST(0.65 AS DOUBLE) AS score FROM o JOIN x ON x.id = o.anchor_id""")
def series_clusters(t):
    return series.same_series(_features(t, *SERIES_PARTS))


def _series_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time-band pairs over events, each event a file in the directory of its type."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("file_id"), F.col("event_type").alias("parent_path"), F.col("ts").cast("timestamp").alias("mtime"))
    like = {"status": "active", "media_type": "image", "file_name": "", "capture_type": None}
    rows = rows.withColumns({c: F.lit(v).cast("string") for c, v in like.items()}).withColumns({c: F.lit(None).cast("long") for c in ("width", "height", "duration_ms")})
    return series.candidates(rows).select("a_id", "b_id")


QUERIES["series_candidates"] = _series_candidates
ORACLES["series_candidates"] = "SELECT a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b ON a.event_type = b.event_type AND a.event_id <> b.event_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 1800000000"

PERSON = r"""tg AS (SELECT file_id, name, source FROM (SELECT ft.file_id, t.name, ft.source, row_number() OVER (PARTITION BY ft.file_id, t.name ORDER BY CASE ft.source WHEN 'human' THEN 0 ELSE 1 END, ft.source) AS n FROM m_file_tags ft JOIN m_tags t ON t.id = ft.tag_id WHERE t.namespace = 'person') WHERE n = 1),
x AS (SELECT f.id, f.media_type, f.parent_path, f.mtime, trim(regexp_replace(trim(lower(regexp_replace(f.file_name, '\.[^./]*$', '')), '-_. '), '\d+$', ''), '-_. ') AS family, coalesce(i.width, v.width) AS w, coalesce(i.height, v.height) AS h, v.duration_ms AS d,
  coalesce(json_extract_string(r.structured_attributes, '$.has_face') = 'true', false) AS face, json_extract_string(r.structured_attributes, '$.subject_count') AS sc, json_extract_string(r.structured_attributes, '$.capture_type') AS ct
  FROM m_files f LEFT JOIN m_image_assets i ON i.file_id = f.id LEFT JOIN m_video_assets v ON v.file_id = f.id LEFT JOIN m_file_current_analysis c ON c.file_id = f.id AND c.analysis_type = 'understanding' LEFT JOIN m_analysis_results r ON r.id = c.analysis_result_id WHERE f.status = 'active'),
h AS (SELECT tg.*, count(*) OVER (PARTITION BY name) AS holders FROM tg JOIN x ON x.id = tg.file_id),
pr AS (SELECT a.file_id AS anchor_id, a.name, a.source, b.file_id, a.holders, xa.family = xb.family AND xa.family <> '' AS fam, xa.parent_path = xb.parent_path AS par, abs(epoch_us(xa.mtime) - epoch_us(xb.mtime)) / 3600000000 AS hours,
  xa.face AND xb.face AS faces, coalesce(xa.sc = xb.sc, false) AS scs, coalesce(xa.ct = xb.ct, false) AS cts,
  sign(xa.w - xa.h) = sign(xb.w - xb.h) AND abs(CAST(least(xa.w, xa.h) AS DOUBLE) / greatest(xa.w, xa.h) - CAST(least(xb.w, xb.h) AS DOUBLE) / greatest(xb.w, xb.h)) <= 0.20 AND least(CAST(xa.w AS DOUBLE) * xa.h, CAST(xb.w AS DOUBLE) * xb.h) / greatest(CAST(xa.w AS DOUBLE) * xa.h, CAST(xb.w AS DOUBLE) * xb.h) >= 0.20
  AND coalesce(CAST(least(xa.d, xb.d) AS DOUBLE) / CASE WHEN xa.d > 0 AND xb.d > 0 THEN greatest(xa.d, xb.d) END >= 0.85, true) AS fit
  FROM h a JOIN h b ON a.name = b.name JOIN x xa ON xa.id = a.file_id JOIN x xb ON xb.id = b.file_id),
lk AS (SELECT file_id, true AS img, kind, model_name, v FROM (SELECT file_id, CASE embedding_type WHEN 'person_visual' THEN 'p' ELSE 'g' END AS kind, model_name, vector AS v, row_number() OVER (PARTITION BY file_id ORDER BY CASE embedding_type WHEN 'person_visual' THEN 0 ELSE 1 END, id DESC) AS n FROM m_embeddings WHERE file_id IS NOT NULL AND embedding_type IN ('person_visual', 'image_visual')) WHERE n = 1
  UNION ALL SELECT file_id, false, kind, model_name, v FROM (SELECT vf.file_id, CASE e.embedding_type WHEN 'person_visual' THEN 'p' ELSE 'g' END AS kind, e.model_name, e.vector AS v, row_number() OVER (PARTITION BY vf.id ORDER BY CASE e.embedding_type WHEN 'person_visual' THEN 0 ELSE 1 END, e.id DESC) AS n FROM m_video_frames vf JOIN m_embeddings e ON e.frame_id = vf.id WHERE vf.frame_role = 'understanding' AND e.embedding_type IN ('person_visual', 'video_frame_visual')) WHERE n = 1),
vp AS (SELECT d.anchor_id AS va, d.file_id AS vb, max(CASE a.kind WHEN 'p' THEN 0.26::DOUBLE ELSE 0.18::DOUBLE END) AS points FROM (SELECT DISTINCT anchor_id, file_id FROM pr) d JOIN lk a ON a.file_id = d.anchor_id JOIN lk b ON b.file_id = d.file_id AND a.kind = b.kind AND a.model_name = b.model_name
  WHERE list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2]))) / 64 <= CASE WHEN a.img AND b.img THEN 0.08 ELSE 0.10 END GROUP BY 1, 2),
sc AS (SELECT pr.*, coalesce(points, 0.0::DOUBLE) AS points, CASE WHEN anchor_id = file_id THEN 1.0::DOUBLE ELSE floor(least(CASE source WHEN 'human' THEN 0.86::DOUBLE WHEN 'ai' THEN 0.68::DOUBLE ELSE 0.50::DOUBLE END + CASE WHEN fam THEN 0.10::DOUBLE ELSE 0 END + CASE WHEN par THEN 0.08::DOUBLE ELSE 0 END + coalesce(points, 0.0::DOUBLE) + CASE WHEN faces THEN 0.08::DOUBLE ELSE 0 END
  + CASE WHEN scs THEN 0.04::DOUBLE ELSE 0 END + CASE WHEN cts THEN 0.04::DOUBLE ELSE 0 END + CASE WHEN hours <= 6 THEN 0.06::DOUBLE WHEN hours <= 24 THEN 0.04::DOUBLE WHEN hours <= 168 THEN 0.02::DOUBLE ELSE 0 END, 0.99::DOUBLE) * 100 + 0.5) / 100 END AS score FROM pr LEFT JOIN vp ON va = anchor_id AND vb = file_id
  WHERE anchor_id = file_id OR source = 'human' OR holders <= 4 OR (fit AND (fam OR par OR coalesce(points, 0) > 0))),
rk AS (SELECT *, row_number() OVER (PARTITION BY anchor_id, name, source ORDER BY anchor_id <> file_id, score DESC, file_id) AS rank, count(*) OVER (PARTITION BY anchor_id, name, source) AS n FROM sc)"""


@query(f"WITH {PERSON} SELECT anchor_id, name, source, file_id, CAST(rank AS INT) AS rank, CASE rank WHEN 1 THEN 'cover' ELSE 'member' END AS role, score FROM rk WHERE n > 1")
def person_clusters(t):
    return person.expand(_persons(t))


def _persons(t: Tables) -> person.Factors:
    return person.factorised(_features(t, "about", "person", "person_looks"), person.person_tags(t))


@query(f"WITH {PERSON} SELECT DISTINCT anchor_id, name, source, n FROM rk WHERE n > 1")
def person_cluster_sizes(t):
    """How large each anchor's cluster is, by counts of classes."""
    return person.sizes(_persons(t))


@query(f"""WITH {PERSON}, tt AS (SELECT h.file_id, h.name, h.source, CASE WHEN h.source = 'human' THEN 'person:' || h.name ELSE 'person_ai:' || h.name || ':' || CASE WHEN x.family <> '' THEN x.family ELSE substr(sha1(x.parent_path), 1, 8) END END AS title FROM h JOIN x ON x.id = h.file_id),
la AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY file_id DESC, name DESC) AS last FROM tt) WHERE last = 1)
SELECT la.title, rk.file_id, CAST(rk.rank AS INT) AS rank, CASE rk.rank WHEN 1 THEN 'cover' ELSE 'member' END AS role, rk.score FROM rk JOIN la ON la.file_id = rk.anchor_id AND la.name = rk.name AND la.source = rk.source WHERE rk.n > 1""")
def person_clusters_stored(t):
    """The clusters as they are stored: one of each title."""
    return person.stored(_persons(t))


@query("""WITH u AS (SELECT c.file_id, r.structured_attributes AS s FROM m_file_current_analysis c JOIN m_analysis_results r ON r.id = c.analysis_result_id WHERE c.analysis_type = 'understanding')
SELECT ft.file_id, t.name, 'auto' AS source FROM m_file_tags ft JOIN m_tags t ON t.id = ft.tag_id WHERE t.namespace IN ('content', 'sensitive') AND (t.name ILIKE '%portrait%' OR t.name ILIKE '%selfie%' OR t.name ILIKE '%av%')
UNION SELECT file_id, '__auto:subject_count:single', 'auto' FROM u JOIN m_files f ON f.id = file_id WHERE lower(json_extract_string(s, '$.subject_count')) IN ('single', '1', 'one')
UNION SELECT file_id, '__auto:has_face:true', 'auto' FROM u JOIN m_files f ON f.id = file_id WHERE lower(json_extract_string(s, '$.has_face')) IN ('true', '1', 'yes')
UNION SELECT file_id, '__auto:capture_type:selfie', 'auto' FROM u JOIN m_files f ON f.id = file_id WHERE lower(json_extract_string(s, '$.capture_type')) = 'selfie'""")
def auto_person_signals(t):
    return person.auto_signals(t, features.file_features(t, ("about",)))


_RAW = """coalesce(q.quality_score, 0) * 100 + CAST(coalesce(i.width, v.width) AS DOUBLE) * coalesce(i.height, v.height) + coalesce(v.duration_ms, 0) / 1000 + f.size_bytes / 1e6::DOUBLE + coalesce(v.bitrate, 0) / 1e5::DOUBLE + coalesce(v.fps, 0) * 10 + CASE v.container WHEN 'mkv' THEN 6 WHEN 'mp4' THEN 4 WHEN 'mov' THEN 3 ELSE 0 END"""


def _digit(place: int):
    return F.substring(F.md5("abs_path"), place, 1)


_D = "substr(md5(abs_path), {}, 1)".format


_CONTENT = f"""WITH {UFRAMES}, {FLOOKS}, {FMODELS}, {SHARED}, {NEARF}, {NEARI},
p AS (SELECT i.*, CAST('0x' || phash AS UBIGINT) AS bits FROM m_image_assets i JOIN m_files f ON f.id = i.file_id WHERE f.status <> 'trashed'),
ph AS (SELECT a.file_id AS a_id, b.file_id AS b_id FROM p a JOIN p b ON substr(a.phash, 1, 4) = substr(b.phash, 1, 4) AND a.file_id <> b.file_id WHERE bit_count(xor(a.bits, b.bits)) <= 4 AND {_ORIENT} AND {_ASPECT}),
s AS (SELECT f.id, f.sha256, {_RAW} AS raw FROM m_files f LEFT JOIN m_image_assets i ON i.file_id = f.id LEFT JOIN m_video_assets v ON v.file_id = f.id
  LEFT JOIN m_file_current_analysis c ON c.file_id = f.id AND c.analysis_type = 'quality' LEFT JOIN m_analysis_results q ON q.id = c.analysis_result_id WHERE f.status <> 'trashed'),
cp AS (SELECT id FROM (SELECT *, count(*) OVER (PARTITION BY sha256) AS n FROM s WHERE sha256 <> '') WHERE n > 1),
pairs AS (SELECT 1 AS nr, 'frame_phash' AS tier, a_id, b_id FROM fp UNION ALL SELECT 2, 'frame_vector', a_id, b_id FROM fv UNION ALL SELECT 3, 'phash', a_id, b_id FROM ph UNION ALL SELECT 4, 'vector', a_id, b_id FROM ve),
first_ AS (SELECT a_id, min(nr) AS nr FROM pairs WHERE a_id NOT IN (SELECT id FROM cp) GROUP BY a_id),
m AS (SELECT 'sha256' AS tier, 'sha256:' || sha256 AS cluster_key, id AS file_id FROM s WHERE id IN (SELECT id FROM cp)
  UNION ALL SELECT tier, tier || ':' || a_id, b_id FROM pairs JOIN first_ USING (a_id, nr)
  UNION SELECT tier, tier || ':' || a_id, a_id FROM pairs JOIN first_ USING (a_id, nr)),
g AS (SELECT m.*, raw, row_number() OVER (PARTITION BY cluster_key ORDER BY raw DESC, file_id) AS rank, max(raw) OVER (PARTITION BY cluster_key) AS top FROM m JOIN s ON s.id = m.file_id)
SELECT tier, cluster_key, file_id, CAST(rank AS INT) AS rank, CASE rank WHEN 1 THEN 'best_quality' ELSE 'duplicate_candidate' END AS role, round(least(1, greatest(0, raw / CASE WHEN top > 0 THEN top ELSE 1 END)), 6) AS score FROM g"""


@query(_CONTENT)
def same_content_tiers(t):
    return content.same_content(_features(t, *CONTENT_PARTS)).withColumn("score", F.round("score", 6))


CONTENT_PARTS = ("quality", "phash", "image", "image_models", "frame_phashes", "frame_looks", "frame_models")
_LATER = f"""cf AS (SELECT * REPLACE (CASE WHEN {_D(7)} = '0' THEN 'trashed' WHEN {_D(7)} = '1' THEN 'active' ELSE status END AS status, CASE WHEN {_D(8)} = '0' THEN 'c' || CAST(id % 9 AS STRING) ELSE sha256 END AS sha256,
  CASE WHEN {_D(9)} = '0' THEN size_bytes + 5 ELSE size_bytes END AS size_bytes) FROM m_files), """


def _later(t: Tables) -> Tables:
    """The library some time later: by digits of a hash of the path some files are in the trash, or out of it, have other digests,
    or have grown."""
    status = F.when(_digit(7) == "0", "trashed").when(_digit(7) == "1", "active").otherwise(F.col("status"))
    sha = F.when(_digit(8) == "0", F.concat(F.lit("c"), (F.col("id") % 9).cast("string"))).otherwise(F.col("sha256"))
    grown = F.when(_digit(9) == "0", F.col("size_bytes") + 5).otherwise(F.col("size_bytes"))
    return ChainMap({"files": t["files"].withColumns({"status": status, "sha256": sha, "size_bytes": grown})}, t)


@query("WITH " + _LATER + _CONTENT.replace("m_files", "cf")[5:])
def content_recomputed(t):
    """The clusters of the later library from those of the earlier one and what has changed."""
    old, new = _features(t, *CONTENT_PARTS), _features(_later(t), *CONTENT_PARTS)
    return content.recompute(content.factored(old), new, settled(content.changed_files(old, new))).withColumn("score", F.round("score", 6))


@query("SELECT c.file_id, json_extract_string(r.structured_attributes, '$.capture_type') AS capture_type, json_extract_string(r.structured_attributes, '$.has_face') = 'true' AS has_face FROM m_file_current_analysis c JOIN m_analysis_results r ON r.id = c.analysis_result_id WHERE c.analysis_type = 'understanding'")
def json_attributes(t):
    df = files.current(t, "understanding")
    return df.select("file_id", F.get_json_object("structured_attributes", "$.capture_type").alias("capture_type"), labels.truthy(F.get_json_object("structured_attributes", "$.has_face")).alias("has_face"))


def _scan(t: Tables) -> DataFrame:
    """A later scan of every volume: by digits of a hash of the path some files are gone, some have grown and some are new."""
    f = t["files"]
    grown = F.when(_digit(1) < "4", F.col("size_bytes") + 1).otherwise(F.col("size_bytes"))
    rows = f.where(_digit(2) > "1").withColumn("size_bytes", grown)
    fresh = f.where(_digit(3) == "7").withColumn("abs_path", F.concat("abs_path", F.lit(".new")))
    return rows.unionByName(fresh).select("volume_id", "abs_path", *ingest.SCANNED)


_SCAN = "sn AS (SELECT volume_id, abs_path, CASE WHEN substr(md5(abs_path), 1, 1) < '4' THEN size_bytes + 1 ELSE size_bytes END AS size_bytes FROM m_files WHERE substr(md5(abs_path), 2, 1) > '1' UNION ALL SELECT volume_id, abs_path || '.new', size_bytes FROM m_files WHERE substr(md5(abs_path), 3, 1) = '7')"
_BOTH = "f.abs_path = sn.abs_path AND f.volume_id = sn.volume_id"
_AT = datetime(2024, 3, 1)


@query(f"WITH {_SCAN} SELECT f.id, sn.abs_path, sn.size_bytes FROM sn LEFT JOIN m_files f ON {_BOTH} WHERE f.id IS NULL OR f.size_bytes IS DISTINCT FROM sn.size_bytes OR f.status <> 'active'")
def scan_merge_changed(t):
    return ingest.scan_changes(t["files"], _scan(t)).select("id", "abs_path", "size_bytes")


@query(f"WITH {_SCAN} SELECT f.id, f.abs_path FROM m_files f WHERE f.status = 'active' AND NOT EXISTS (SELECT 1 FROM sn WHERE {_BOTH})")
def scan_missing(t):
    return ingest.missing(t["files"], _scan(t)).select("id", "abs_path")


@query(f"""WITH {_SCAN} SELECT coalesce(sn.abs_path, f.abs_path) AS abs_path, CASE WHEN sn.abs_path IS NOT NULL THEN 'active' WHEN f.status = 'active' THEN 'missing' ELSE f.status END AS status, coalesce(sn.size_bytes, f.size_bytes) AS size_bytes,
CASE WHEN sn.abs_path IS NOT NULL OR f.status = 'active' THEN TIMESTAMP '2024-03-01 00:00:00' ELSE f.updated_at END AS updated_at, CASE WHEN sn.abs_path IS NULL OR (f.id IS NOT NULL AND f.size_bytes IS NOT DISTINCT FROM sn.size_bytes) THEN f.sha256 END AS sha256 FROM m_files f FULL JOIN sn ON {_BOTH}""")
def scan_merge(t):
    merged, _ = ingest.merge_scan(t, _scan(t), F.lit(_AT))
    return merged.select("abs_path", "status", "size_bytes", "updated_at", "sha256")


@query(f"WITH {_SCAN} SELECT coalesce(sn.abs_path, f.abs_path) AS abs_path, CASE WHEN sn.abs_path IS NOT NULL THEN 'discovered' ELSE 'missing' END AS event_type, TIMESTAMP '2024-03-01 00:00:00' AS seen_at FROM m_files f FULL JOIN sn ON {_BOTH} WHERE sn.abs_path IS NOT NULL OR f.status = 'active' UNION ALL SELECT abs_path, event_type, seen_at FROM m_file_path_history")
def scan_history(t):
    return ingest.merge_scan(t, _scan(t), F.lit(_AT))[1].select("abs_path", "event_type", "seen_at")


def _hashed(t: Tables) -> DataFrame:
    """The files with a quick hash, which the made-up library lacks."""
    return t["files"].withColumn("quick_hash", F.md5("sha256"))


def _moved_scan(t: Tables) -> DataFrame:
    """A scan in which, by digits of a hash of the path, some files lie elsewhere, some of these under other names, some are
    gone, and of some only the quick hash is known."""
    f = _hashed(t)
    away = _digit(2) <= "3"
    parent = F.when(away & (_digit(4) < "a"), F.concat("parent_path", F.lit("/moved"))).otherwise(F.col("parent_path"))
    name = F.when(away & (_digit(5) < "5"), F.concat(F.lit("n-"), "file_name")).otherwise(F.col("file_name"))
    rows = f.where(~away | (_digit(3) > "2")).withColumns({"parent_path": parent, "file_name": name, "sha256": F.when(_digit(6) > "3", F.col("sha256"))})
    rows = rows.withColumn("abs_path", F.concat("parent_path", F.lit("/"), "file_name"))
    return rows.select("volume_id", "abs_path", *ingest.SCANNED, "sha256", "quick_hash")


def _tier(n: int, keys: str, left: str) -> str:
    on = " AND ".join(f"g.{k} = w.{k}" for k in [*keys.split(", "), "n"])
    known = " AND ".join(f"{k} IS NOT NULL" for k in keys.split(", "))
    number = f"row_number() OVER (PARTITION BY {keys} ORDER BY"
    return f"""t{n} AS (SELECT g.id, w.volume_id, w.abs_path FROM (SELECT *, {number} id) AS n FROM gone WHERE {known} AND id NOT IN (SELECT id FROM {left})) g
  JOIN (SELECT *, {number} volume_id, abs_path) AS n FROM fresh WHERE {known} AND (volume_id, abs_path) NOT IN (SELECT (volume_id, abs_path) FROM {left})) w ON {on}),
u{n} AS (SELECT * FROM {left} UNION ALL SELECT * FROM t{n})"""


_MOVES = f"""fs AS (SELECT *, {_D(2)} <= '3' AS away, parent_path || CASE WHEN {_D(2)} <= '3' AND {_D(4)} < 'a' THEN '/moved' ELSE '' END AS pp, CASE WHEN {_D(2)} <= '3' AND {_D(5)} < '5' THEN 'n-' ELSE '' END || file_name AS nn FROM m_files),
sn AS (SELECT volume_id, pp || '/' || nn AS abs_path, pp AS parent_path, nn AS file_name, size_bytes, CASE WHEN {_D(6)} > '3' THEN sha256 END AS sha256, md5(sha256) AS quick_hash FROM fs WHERE NOT away OR {_D(3)} > '2'),
gone AS (SELECT id, volume_id, parent_path, file_name, size_bytes, sha256, md5(sha256) AS quick_hash FROM m_files f WHERE status = 'active' AND size_bytes > 0 AND NOT EXISTS (SELECT 1 FROM sn WHERE sn.abs_path = f.abs_path AND sn.volume_id = f.volume_id)),
fresh AS (SELECT * FROM sn WHERE size_bytes > 0 AND NOT EXISTS (SELECT 1 FROM m_files f WHERE sn.abs_path = f.abs_path AND sn.volume_id = f.volume_id)),
u0 AS (SELECT CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS volume_id, CAST(NULL AS STRING) AS abs_path WHERE false),
{_tier(1, "sha256, file_name", "u0")},
{_tier(2, "sha256", "u1")},
{_tier(3, "quick_hash, size_bytes, file_name", "u2")},
{_tier(4, "quick_hash, size_bytes", "u3")},
mv AS (SELECT u4.*, CASE WHEN g.volume_id = u4.volume_id AND g.parent_path = w.parent_path THEN 'renamed' ELSE 'moved' END AS event_type FROM u4 JOIN gone g ON g.id = u4.id JOIN fresh w ON w.volume_id = u4.volume_id AND w.abs_path = u4.abs_path)"""


@query(f"WITH {_MOVES} SELECT * FROM mv")
def scan_moves(t):
    """Files that a scan found elsewhere, by digests and quick hashes, one to one."""
    return ingest.moves(_hashed(t), _moved_scan(t))


@query(f"""WITH {_MOVES}, af AS (SELECT f.id, coalesce(mv.volume_id, f.volume_id) AS volume_id, coalesce(mv.abs_path, f.abs_path) AS abs_path, f.status FROM m_files f LEFT JOIN mv ON mv.id = f.id)
SELECT id, abs_path, event_type FROM mv UNION ALL SELECT af.id, coalesce(sn.abs_path, af.abs_path), CASE WHEN sn.abs_path IS NOT NULL THEN 'discovered' ELSE 'missing' END FROM af FULL JOIN sn ON sn.abs_path = af.abs_path AND sn.volume_id = af.volume_id WHERE sn.abs_path IS NOT NULL OR af.status = 'active'""")
def scan_moves_history(t):
    """What such a scan adds to the history; the ids of new files, hashes of their paths, aren't shown."""
    of = ChainMap({"files": _hashed(t)}, t)
    history = ingest.merge_moves(of, _moved_scan(t), F.lit(_AT))[1].where(F.col("seen_at") == F.lit(_AT))
    known = t["files"].select(F.col("id").alias("file_id"), F.col("id"))
    return history.join(known, "file_id", "left").select("id", "abs_path", "event_type")


@query("""WITH tk AS (SELECT doc_id, unnest(['raw:' || source, 'raw:' || lang, 'summary:' || CAST(n_chars AS STRING)]) AS tok FROM documents), b AS (SELECT doc_id, CAST('0x' || substr(sha1(tok), 1, 2) AS INT) % 64 AS k FROM tk), c AS (SELECT doc_id, k, count(*) AS n FROM b GROUP BY doc_id, k)
SELECT c.doc_id AS file_id, c.k AS bucket, floor(CAST(n AS DOUBLE) / max(n) OVER (PARTITION BY c.doc_id) * 10000 + 0.5) / 10000 AS weight FROM c""")
def semantic_token_vector(t):
    f = t["files"]
    parts = F.split("parent_path", "/")
    tokens = F.array(F.concat(F.lit("raw:"), F.element_at(parts, -1)), F.concat(F.lit("raw:"), F.element_at(F.split("file_name", "_"), 1)), F.concat(F.lit("summary:"), F.col("size_bytes").cast("string")))
    df = f.select(F.col("id").alias("file_id"), F.posexplode(vectors.token_vector(tokens)).alias("bucket", "weight"))
    return df.where("weight > 0")


def _tag_sql() -> str:
    """Distinct words of each text in order, filed under names and spaces of the fixed tables after three constant tags; five in all."""
    text = lambda x: "'" + x.replace("'", "''") + "'"
    names = f"MAP {{{', '.join(f'{text(k)}: {text(v)}' for k, v in labels.TAG_NAMES.items())}}}"
    space = " ".join(f"WHEN name IN ({', '.join(map(text, v))}) THEN {text(k)}" for k, v in labels.TAG_SPACES.items())
    return f"""WITH w AS (SELECT file_id, unnest(string_split(lower(document_text), ' ')) AS raw, generate_subscripts(string_split(lower(document_text), ' '), 1) AS pos FROM m_search_documents),
c AS (SELECT file_id, pos, trim(trim(raw, '.,'), ' ') AS raw FROM w),
k AS (SELECT file_id, pos, nullif(coalesce({names}[lower(raw)], raw), '') AS name FROM c WHERE NOT contains(raw, '/') AND NOT contains(raw, '\\')),
f AS (SELECT file_id, 0 AS pos, 'content' AS namespace, '双人' AS name, 0.65 AS confidence FROM m_search_documents UNION ALL SELECT file_id, 1, 'content', '自拍', 0.7 FROM m_search_documents UNION ALL SELECT file_id, 2, 'person', '露脸', 0.6 FROM m_search_documents
  UNION ALL SELECT file_id, pos + 2, CASE {space} ELSE 'content' END, name, 0.6 FROM k WHERE name IS NOT NULL),
d AS (SELECT file_id, namespace, name, min(pos) AS pos, arg_min(confidence, pos) AS confidence FROM f GROUP BY file_id, namespace, name),
r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY pos) - 1 AS n FROM d)
SELECT file_id, CAST(n AS INT) AS n, namespace, name, CAST(confidence AS DOUBLE) AS confidence FROM r WHERE n < 5"""


@query(_tag_sql())
def tag_normalisation(t):
    raw = F.transform(F.array_distinct(F.split(F.lower("document_text"), " ")), lambda x: F.btrim(x, F.lit(".,")))
    df = t["search_documents"].select("file_id", labels.candidates(raw, F.lit("two"), F.lit("selfie"), F.lit("on")).alias("c"))
    return df.select("file_id", F.posexplode("c").alias("n", "c")).select("file_id", "n", "c.namespace", "c.name", "c.confidence")


@query("""SELECT id, job_type, priority, attempts + 1 AS attempts FROM m_jobs WHERE (status = 'pending' AND scheduled_at <= TIMESTAMP '2024-01-20 00:00:00') OR (status = 'leased' AND lease_expires_at < TIMESTAMP '2024-01-20 00:00:00') ORDER BY priority, scheduled_at, id LIMIT 1""")
def job_lease_next(t):
    return library.lease_next(t, F.lit(datetime(2024, 1, 20))).select("id", "job_type", "priority", "attempts")


@query("""SELECT w.job_type, w.target_id FROM (SELECT DISTINCT CASE id % 2 WHEN 0 THEN 'hash_file' ELSE 'infer_tags' END AS job_type, id AS target_id FROM m_files) w WHERE NOT EXISTS (SELECT 1 FROM m_jobs j WHERE j.job_type = w.job_type AND j.target_type = 'file' AND j.target_id = w.target_id AND j.status IN ('pending', 'leased', 'running'))""")
def job_ensure_idempotent(t):
    wanted = t["files"].select(F.when(F.col("id") % 2 == 0, "hash_file").otherwise("infer_tags").alias("job_type"), F.lit("file").alias("target_type"), F.col("id").alias("target_id"))
    return library.ensure_jobs(t, wanted).select("job_type", "target_id")


@query("SELECT job_id, arg_max(level, (created_at, id)) AS status FROM m_job_events GROUP BY job_id")
def job_state_fold(t):
    return library.fold_events(t["job_events"].select("job_id", F.col("level").alias("status"), F.col("created_at").alias("at"), "id"))


@query("SELECT id, job_type, status FROM m_jobs WHERE status = 'failed' ORDER BY updated_at DESC NULLS FIRST, id DESC LIMIT 20")
def job_list_failed(t):
    return library.list_jobs(t, "failed").select("id", "job_type", "status")


@query("SELECT id, display_name, mount_path, is_online FROM m_volumes")
def volume_list(t):
    return library.list_volumes(t).select("id", "display_name", "mount_path", "is_online")


@query("""WITH fr AS (SELECT file_id, frame_path, row_number() OVER (PARTITION BY file_id ORDER BY CASE frame_role WHEN 'understanding' THEN 0 ELSE 1 END, timestamp_ms, id) AS n FROM m_video_frames)
SELECT f.id, f.abs_path AS content_path, CASE WHEN f.media_type = 'image' THEN coalesce(nullif(i.thumbnail_path, ''), f.abs_path) ELSE coalesce(nullif(v.poster_path, ''), fr.frame_path) END AS preview_path
FROM m_files f LEFT JOIN m_image_assets i ON i.file_id = f.id LEFT JOIN m_video_assets v ON v.file_id = f.id LEFT JOIN fr ON fr.file_id = f.id AND fr.n = 1""")
def preview_paths(t):
    return files.preview_paths(t)


@query("SELECT file_id, tag_id, source FROM m_file_tags WHERE NOT (source = 'ai' AND file_id IN (SELECT id FROM m_files)) UNION ALL SELECT id, size_bytes % 7 + 1, 'ai' FROM m_files")
def replace_ai_tags(t):
    fresh = t["files"].select(F.col("id").alias("file_id"), (F.col("size_bytes") % 7 + 1).alias("tag_id"), F.lit(0.5).alias("confidence"), F.lit(None).cast("string").alias("evidence"))
    return library.replace_ai_tags(t, fresh).select("file_id", "tag_id", "source")


@query("SELECT event_type AS kind, date_trunc('hour', ts) AS since, count(*) AS events FROM events GROUP BY ALL")
def hourly_activity(t):
    from .streaming.ingest import activity

    rows = t["job_events"].select(F.col("created_at").alias("ts"), F.col("message").alias("event_type"))
    return activity(rows, "ts", "event_type").select("kind", "since", "events")


@query("""WITH b AS (SELECT file_id, encode(document_text) AS c FROM m_search_documents)
SELECT file_id, sha256(unhex(array_to_string(list_reverse([substr(format('{:016x}', octet_length(c)), i, 2) for i in [1, 3, 5, 7, 9, 11, 13, 15]]), '')) || c[1:65536] || CASE WHEN octet_length(c) > 65536 THEN c[octet_length(c) - 65535:octet_length(c)] ELSE ''::BLOB END) AS quick_hash FROM b""")
def quick_hash(t):
    from .functions.hashing import quick_hash as of

    return t["search_documents"].select("file_id", of(F.encode("document_text", "UTF-8")).alias("quick_hash"))


@query("SELECT id FROM m_files WHERE updated_at < TIMESTAMP '2024-01-15 00:00:00' OR (updated_at = TIMESTAMP '2024-01-15 00:00:00' AND id < 100)")
def keyset_after(t):
    return t["files"].where(after([(F.col("updated_at"), datetime(2024, 1, 15), True), (F.col("id"), 100, True)])).select("id")
