"""From scans to derived tables: merges of snapshots and the stages that fill satellites."""

from __future__ import annotations

from collections import ChainMap

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels, media, vectors
from ..operators.lineage import settled
from ..operators.relational import changed, latest_per, top_n_per
from ..sources.catalog import Tables

KEYS = ["volume_id", "abs_path"]
SCANNED = ["parent_path", "file_name", "extension", "media_type", "size_bytes", "mtime"]


def scan_changes(files: DataFrame, scan: DataFrame) -> DataFrame:
    """Scanned rows that are new, differ from the snapshot or bring a file back to life; with `id`, null for new ones."""
    old = files.select(*KEYS, "id", "status", *(F.col(c).alias(f"old_{c}") for c in SCANNED))
    met = scan.join(old, KEYS, "left")
    differs = changed([F.col(c) for c in SCANNED], [F.col(f"old_{c}") for c in SCANNED])
    return met.where(F.col("id").isNull() | differs | (F.col("status") != "active")).select("id", *KEYS, *SCANNED)


def _of_volume(volume_id: int | None) -> Column:
    return F.lit(True) if volume_id is None else F.col("volume_id") == volume_id


def missing(files: DataFrame, scan: DataFrame, volume_id: int | None = None) -> DataFrame:
    """Active files of a volume, or of all, that the scan hasn't seen."""
    return files.where(_of_volume(volume_id) & (F.col("status") == "active")).join(scan.select(*KEYS), KEYS, "left_anti")


def merge_scan(t: Tables, scan: DataFrame, as_of: Column, volume_id: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, file_path_history) after a scan of a volume, or of all.

    Every scanned file is active, updated and gets a `discovered` event; active ones not seen become missing, with
    an event. Ids of known paths stay; a new path's id is a hash of volume and path.
    """
    seen = scan.select(*KEYS, *(F.col(c).alias(f"new_{c}") for c in SCANNED)).withColumn("seen", F.lit(True))
    met = t["files"].join(seen, KEYS, "full")
    here = F.col("seen").isNotNull()
    gone = ~here & _of_volume(volume_id) & (F.col("status") == "active")
    differs = changed([F.col(c) for c in SCANNED], [F.col(f"new_{c}") for c in SCANNED])
    new_id = F.xxhash64("volume_id", "abs_path").bitwiseAND(F.lit(2**62 - 1))
    values = {
        "id": F.coalesce("id", new_id),
        **{c: F.when(here, F.col(f"new_{c}")).otherwise(F.col(c)) for c in SCANNED},
        "status": F.when(here, "active").when(gone, "missing").otherwise(F.col("status")),
        "sha256": F.when(here & differs, None).otherwise(F.col("sha256")),
        "quick_hash": F.when(here & differs, None).otherwise(F.col("quick_hash")),
        "updated_at": F.when(here | gone, as_of).otherwise(F.col("updated_at")),
    }
    event = F.when(here, "discovered").when(gone, "missing")
    both = met.select(*(values.get(c, F.col(c)).alias(c) for c in t["files"].columns), event.alias("event_type"))
    events = both.where("event_type IS NOT NULL").select(F.col("id").alias("file_id"), *KEYS, "event_type", as_of.alias("seen_at"))
    return both.drop("event_type"), t["file_path_history"].unionByName(events)


def _matched(gone: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(id, volume_id, abs_path): missing and new files with equal keys, one to one: the first by id with the first by path,
    and so on."""
    known = " AND ".join(f"{k} IS NOT NULL AND {k} <> ''" for k in keys if k != "size_bytes")
    a = gone.where(known).withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy("id")))
    b = new.where(known).withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*KEYS)))
    return a.select("id", *keys, "_n").join(b.select(*KEYS, *keys, "_n"), [*keys, "_n"]).select("id", *KEYS)


def moves(files: DataFrame, scan: DataFrame) -> DataFrame:
    """(id, volume_id, abs_path, event_type): files that a scan hasn't seen at their paths, and has at others.

    scan has sha256 and quick_hash beside its other columns. Active files that are missing meet paths that are new, one to
    one, in tiers, each among what earlier ones left: by digest and name, by digest, by quick hash, size and name, and by
    quick hash and size. Where several fit, the first by id takes the first by path, so a second run gives the same. An
    event is `renamed` if the directory stayed and `moved` if not. Files without hashes, and empty ones, are no evidence.
    """
    hashes = ["sha256", "quick_hash", "size_bytes", "file_name"]
    gone = settled(missing(files, scan).where("size_bytes > 0").select("id", F.col("volume_id").alias("_volume"), F.col("parent_path").alias("_parent"), *hashes))
    new = settled(scan.where("size_bytes > 0").join(files.select(*KEYS), KEYS, "left_anti").select(*KEYS, "parent_path", *hashes))
    found, left, open_ = None, gone, new
    for keys in (["sha256", "file_name"], ["sha256"], ["quick_hash", "size_bytes", "file_name"], ["quick_hash", "size_bytes"]):
        now = settled(_matched(left, open_, keys))
        found = now if found is None else found.unionByName(now)
        left, open_ = left.join(now.select("id"), "id", "left_anti"), open_.join(now.select(*KEYS), KEYS, "left_anti")
    met = found.join(gone.select("id", "_volume", "_parent"), "id").join(new.select(*KEYS, "parent_path"), KEYS)
    stays = (F.col("volume_id") == F.col("_volume")) & F.col("parent_path").eqNullSafe(F.col("_parent"))
    return met.select("id", *KEYS, F.when(stays, "renamed").otherwise("moved").alias("event_type"))


def merge_moves(t: Tables, scan: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(files, file_path_history) after a scan of all volumes in which moved files keep their ids, hashes and satellites: each
    is first put where it is now, with its event, and then the scan is merged."""
    found = settled(moves(t["files"], scan))
    there = found.select("id", *(F.col(k).alias(f"_{k}") for k in KEYS)).join(scan.select(*(F.col(k).alias(f"_{k}") for k in KEYS), *(F.col(c).alias(f"_{c}") for c in SCANNED)), [f"_{k}" for k in KEYS])
    now = [*KEYS, *SCANNED]
    files = t["files"].join(there.withColumn("_moved", F.lit(True)), "id", "left")
    files = files.select(*(F.when(F.col("_moved"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in now else F.col(c) for c in t["files"].columns))
    events = found.select(F.col("id").alias("file_id"), *KEYS, "event_type", as_of.alias("seen_at"))
    return merge_scan(ChainMap({"files": settled(files), "file_path_history": t["file_path_history"].unionByName(events)}, t), scan.drop("sha256", "quick_hash"), as_of)


def quality_source(t: Tables) -> DataFrame:
    """Files with the technical features that score them; width and height from whichever satellite has them."""
    image = t["image_assets"].select(F.col("file_id").alias("id"), F.col("width").alias("iw"), F.col("height").alias("ih"), "format", "orientation")
    video = t["video_assets"].select(F.col("file_id").alias("id"), F.col("width").alias("vw"), F.col("height").alias("vh"), "duration_ms", "fps", "container", "video_codec", "audio_codec", "bitrate")
    df = t["files"].join(image, "id", "left").join(video, "id", "left")
    return df.withColumns({"width": F.coalesce("iw", "vw"), "height": F.coalesce("ih", "vh")}).drop("iw", "ih", "vw", "vh")


def understanding_sources(t: Tables, most: int = 6) -> DataFrame:
    """(file_id, file_path, file_name, media_type, frame_paths): what a model is asked about; of a video the first `understanding` frames."""
    frames = top_n_per(t["video_frames"].where("frame_role = 'understanding'"), ["file_id"], [F.col("timestamp_ms"), F.col("id")], most, "n")
    frames = frames.groupBy(F.col("file_id").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "frame_path"))), lambda x: x["frame_path"]).alias("frame_paths"))
    df = t["files"].join(frames, "id", "left")
    return df.select(F.col("id").alias("file_id"), F.col("abs_path").alias("file_path"), "file_name", "media_type", F.when(F.col("media_type") == "video", F.coalesce("frame_paths", F.array().cast("array<string>"))).alias("frame_paths"))


def embedding_sources(t: Tables) -> DataFrame:
    """(file_id, frame_id, path, phash): what vectors are made from, images and the `understanding` frames of videos."""
    none = lambda c: F.coalesce(c, F.lit(""))
    images = t["files"].where("media_type = 'image'").join(t["image_assets"].select(F.col("file_id").alias("id"), "phash"), "id", "left")
    images = images.select(F.col("id").alias("file_id"), F.lit(None).cast("long").alias("frame_id"), none("abs_path").alias("path"), none("phash").alias("phash"))
    frames = t["video_frames"].where("frame_role = 'understanding'").select("file_id", F.col("id").alias("frame_id"), none("frame_path").alias("path"), none("phash").alias("phash"))
    return images.unionByName(frames)


def infer_quality(t: Tables) -> DataFrame:
    """(file_id, quality_score, quality_tier, summary)."""
    c = F.col
    score = media.quality_score(c("media_type"), c("width"), c("height"), c("bitrate"), c("fps"), c("duration_ms"), c("video_codec"), c("container"))
    df = quality_source(t).withColumn("quality_score", score).withColumn("quality_tier", media.quality_tier(c("quality_score")))
    text = media.quality_summary(c("media_type"), c("quality_tier"), c("width"), c("height"), c("format"), c("container"), c("video_codec"), c("bitrate"), c("fps"))
    return df.select(c("id").alias("file_id"), "quality_score", "quality_tier", text.alias("summary"))


def search_documents(t: Tables) -> DataFrame:
    c = F.col
    text = media.search_document(c("file_name"), c("abs_path"), c("extension"), c("media_type"), c("status"), c("format"), c("container"), c("video_codec"), c("audio_codec"), c("orientation"), c("width"), c("height"), c("duration_ms"))
    return quality_source(t).select(c("id").alias("file_id"), text.alias("document_text"))


def append_analyses(t: Tables, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(analysis_results, file_current_analysis) with fresh results, the latest of each file and type current."""
    every = t["analysis_results"].unionByName(fresh.select(*t["analysis_results"].columns))
    last = latest_per(every, ["file_id", "analysis_type"], [F.desc("created_at"), F.desc("id")])
    return every, last.select("file_id", "analysis_type", F.col("id").alias("analysis_result_id"))


PAYLOAD = "struct<raw_tags: array<string>, canonical_candidates: array<struct<namespace: string, name: string, confidence: string>>, summary: string, sensitive_tags: array<string>, quality_hints: array<string>, structured_attributes: map<string, string>, confidence: string>"


def normalize_understanding(df: DataFrame, payload: str = "payload") -> DataFrame:
    """A model's answers, noisy JSON text, as raw_tags, candidates, summary, sensitive_tags, quality_hints, attributes and confidence.

    Tags that look like paths are dropped. Candidates given are kept if they have a namespace and a name;
    without any they are derived from attributes and tags.
    """
    p = F.from_json(labels.json_object(F.col(payload)), PAYLOAD)
    none = F.array().cast("array<string>")
    clean = lambda a: F.filter(F.transform(F.coalesce(a, none), F.trim), lambda x: (x != "") & ~labels.looks_like_path(x))
    attr = lambda k: F.try_element_at(F.coalesce(p["structured_attributes"], F.create_map().cast("map<string,string>")), F.lit(k))
    given = F.filter(
        F.transform(F.coalesce(p["canonical_candidates"], F.array().cast("array<struct<namespace: string, name: string, confidence: string>>")), lambda c: F.struct(F.trim(c["namespace"]).alias("namespace"), F.trim(c["name"]).alias("name"), labels.clamp(c["confidence"], 0.6).alias("confidence"))),
        lambda c: (c["namespace"] != "") & (c["name"] != ""),
    )
    derived = labels.candidates(clean(p["raw_tags"]), attr("subject_count"), attr("capture_type"), attr("has_face"))
    return df.withColumns({
        "raw_tags": clean(p["raw_tags"]), "candidates": F.when(F.size(given) > 0, given).otherwise(derived), "summary": F.coalesce(F.trim(p["summary"]), F.lit("")),
        "sensitive_tags": clean(p["sensitive_tags"]), "quality_hints": clean(p["quality_hints"]), "attributes": p["structured_attributes"], "confidence": labels.clamp(p["confidence"], 0.5),
    })


def semantic_vectors(df: DataFrame) -> DataFrame:
    """df with `vector`: its normalised understanding hashed into 64 buckets; null where it says nothing."""
    named = lambda prefix, array: F.transform(array, lambda x: F.concat(F.lit(prefix), x))
    attributes = F.transform(F.array_sort(F.map_entries(F.coalesce("attributes", F.create_map().cast("map<string,string>")))), lambda e: F.concat(F.lit("attr:"), e["key"], F.lit("="), e["value"]))
    tokens = F.concat(
        named("raw:", F.col("raw_tags")), F.transform("candidates", lambda c: F.concat(F.lit("canonical:"), c["namespace"], F.lit(":"), c["name"])),
        named("sensitive:", F.col("sensitive_tags")), named("quality:", F.col("quality_hints")), F.filter(attributes, lambda x: x.isNotNull()),
        F.filter(F.array(F.when(F.col("summary") != "", F.concat(F.lit("summary:"), F.col("summary")))), lambda x: x.isNotNull()),
    )
    return df.withColumn("vector", vectors.token_vector(tokens))


def replace_vectors(t: Tables, fresh: DataFrame) -> DataFrame:
    """embeddings with fresh rows in place of a file's of the same type and model, and of a frame's of the same type."""
    keys = lambda c, *more: fresh.where(F.col(c).isNotNull()).select(c, "embedding_type", *more).distinct()
    own = t["embeddings"]
    kept = own.join(keys("file_id", "model_name"), ["file_id", "embedding_type", "model_name"], "left_anti")
    kept = kept.join(keys("frame_id"), ["frame_id", "embedding_type"], "left_anti")
    return kept.select(*own.columns).unionByName(fresh.select(*own.columns))


def wants_person_vectors(has_face: Column, subject: Column, capture: Column, candidates: Column) -> Column:
    """Whether an understanding calls for person vectors: a tag that names a person or shows one, a face, subjects, or a way of taking that shows people."""
    tagged = F.exists(candidates, lambda c: (c["namespace"] == "person") | ((c["namespace"] == "content") & labels.holds_any(c["name"], labels.CONTENT_WORDS)))
    return F.coalesce(tagged, F.lit(False)) | labels.holds_any(has_face) | labels.holds_any(subject, labels.SUBJECT_WORDS) | labels.holds_any(capture, labels.CAPTURE_WORDS)
