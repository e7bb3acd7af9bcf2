"""The tables of a media library, and checks that stand in for a database's constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TABLES = {
    "volumes": "id long, mount_path string, volume_uuid string, display_name string, is_online boolean, last_seen_at timestamp",
    "files": "id long, volume_id long, abs_path string, parent_path string, file_name string, extension string, media_type string, size_bytes long, mtime timestamp, sha256 string, quick_hash string, status string, updated_at timestamp",
    "file_path_history": "file_id long, volume_id long, abs_path string, event_type string, seen_at timestamp",
    "image_assets": "file_id long, width int, height int, format string, orientation string, exif string, thumbnail_path string, phash string",
    "video_assets": "file_id long, duration_ms long, width int, height int, fps double, container string, video_codec string, audio_codec string, bitrate long, poster_path string",
    "video_frames": "id long, file_id long, timestamp_ms long, frame_path string, phash string, frame_role string",
    "embeddings": "id long, file_id long, frame_id long, embedding_type string, model_name string, vector array<double>",
    "tags": "id long, namespace string, name string, display_name string, is_system boolean, is_sensitive boolean",
    "file_tags": "file_id long, tag_id long, source string, confidence double, evidence string",
    "analysis_results": "id long, file_id long, analysis_type string, status string, summary string, structured_attributes string, quality_score double, quality_tier string, created_at timestamp",
    "file_current_analysis": "file_id long, analysis_type string, analysis_result_id long",
    "search_documents": "file_id long, document_text string",
    "clusters": "id long, cluster_type string, title string, confidence double, status string, cover_file_id long, created_at timestamp",
    "cluster_members": "cluster_id long, file_id long, score double, role string",
    "file_relationships": "from_file_id long, to_file_id long, relation_type string, score double",
    "review_actions": "id long, file_id long, cluster_id long, action_type string, created_at timestamp",
    "jobs": "id long, job_type string, priority int, status string, target_type string, target_id long, payload string, attempts int, max_attempts int, scheduled_at timestamp, lease_expires_at timestamp, last_error string, "
    "progress_stage string, progress_percent int, worker_name string, started_at timestamp, finished_at timestamp, updated_at timestamp",
    "job_events": "id long, job_id long, level string, message string, created_at timestamp",
}

UNIQUE = {
    "files": ("volume_id", "abs_path"),
    "video_frames": ("file_id", "timestamp_ms", "frame_role"),
    "tags": ("namespace", "name"),
    "file_tags": ("file_id", "tag_id", "source"),
    "file_current_analysis": ("file_id", "analysis_type"),
    "cluster_members": ("cluster_id", "file_id"),
}

VALUES = {
    ("files", "media_type"): ("image", "video"),
    ("files", "status"): ("active", "missing", "ignored", "trashed"),
    ("file_path_history", "event_type"): ("discovered", "moved", "renamed", "missing"),
    ("video_frames", "frame_role"): ("candidate", "index", "understanding"),
    ("embeddings", "embedding_type"): ("image_visual", "video_frame_visual", "person_visual", "face", "search_text"),
    ("file_tags", "source"): ("ai", "rule", "human"),
    ("analysis_results", "analysis_type"): ("understanding", "quality", "search_doc"),
    ("clusters", "cluster_type"): ("same_content", "same_person", "same_series"),
    ("clusters", "status"): ("candidate", "confirmed", "ignored"),
    ("cluster_members", "role"): ("cover", "member", "best_quality", "duplicate_candidate", "series_focus"),
    ("review_actions", "action_type"): ("keep", "trash_candidate", "ignore", "favorite", "hide", "deleted_to_trash"),
    ("jobs", "status"): ("pending", "leased", "running", "succeeded", "failed", "dead"),
    ("job_events", "level"): ("info", "warning", "error"),
}


def violations(name: str, df: DataFrame) -> DataFrame:
    """(rule, rows) for each rule of a table that rows break."""
    found = df.sparkSession.createDataFrame([], "rule string, rows long")
    if keys := UNIQUE.get(name):
        twice = df.groupBy(*keys).count().where("count > 1").agg(F.count("*").alias("rows"))
        found = found.union(twice.select(F.lit(f"unique {', '.join(keys)}"), "rows"))
    for (table, column), values in VALUES.items():
        if table == name:
            bad = df.where(F.col(column).isNotNull() & ~F.col(column).isin(*values)).agg(F.count("*").alias("rows"))
            found = found.union(bad.select(F.lit(f"{column} in {', '.join(values)}"), "rows"))
    if name == "embeddings":
        one = df.where(F.col("file_id").isNull() == F.col("frame_id").isNull()).agg(F.count("*").alias("rows"))
        size = df.where(F.size("vector") != 64).agg(F.count("*").alias("rows"))
        found = found.union(one.select(F.lit("one of file_id, frame_id"), "rows")).union(size.select(F.lit("64 dimensions"), "rows"))
    return found.where("rows > 0")
