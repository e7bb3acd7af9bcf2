"""The file list, a file's detail, and where previews lie."""

from __future__ import annotations

import base64
import json
from collections import ChainMap
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import search
from ..operators.lineage import settled
from ..operators.relational import after, latest_per, top_n_per
from ..sources.catalog import Tables
from .searchindex import SearchIndex

#: Sort name -> [(column, falls)]; the id breaks ties.
SORTS = {
    "updated_desc": [("updated_at", True), ("id", True)],
    "size_desc": [("size_bytes", True), ("id", True)],
    "size_asc": [("size_bytes", False), ("id", False)],
    "name_asc": [("file_name", False), ("id", False)],
    "quality_desc": [("quality_key", True), ("updated_at", True), ("id", True)],
}
SOURCE_ORDER = {"human": 0, "ai": 1}
#: Rows of a page: by default and at most.
PAGE, MOST = 20, 100


@dataclass
class ListOptions:
    """What may be asked of the file list; None and '' ask for nothing."""

    query: str = ""
    media_type: str = ""
    quality_tier: str = ""
    review_action: str = ""
    status: str = ""
    volume_id: int = 0
    has_tags: str = ""
    tag_namespace: str = ""
    tag: str = ""
    cluster_type: str = ""
    cluster_status: str = ""
    sort: str = "updated_desc"
    limit: int = PAGE
    offset: int = 0
    cursor: str = ""

    @property
    def size(self) -> int:
        return min(self.limit, MOST) if self.limit > 0 else PAGE


@dataclass
class Page:
    df: DataFrame
    has_more: bool
    next_cursor: str


def current(t: Tables, kind: str) -> DataFrame:
    """The current analysis of a kind for each file: the latest that a pointer names."""
    of = t["file_current_analysis"].where(F.col("analysis_type") == kind).select("file_id", F.col("analysis_result_id").alias("id"))
    results = t["analysis_results"].drop("file_id").join(of, "id")
    return latest_per(results, ["file_id"], [F.desc("created_at"), F.desc("id")])


def latest_review(t: Tables) -> DataFrame:
    rows = t["review_actions"].where("file_id IS NOT NULL")
    return latest_per(rows, ["file_id"], [F.desc("created_at"), F.desc("id")])


def source_order(source: Column) -> Column:
    out = F.lit(2)
    for name, rank in SOURCE_ORDER.items():
        out = F.when(source == name, rank).otherwise(out)
    return out


def tag_summary(t: Tables, most: int = 3) -> DataFrame:
    """(file_id, tags): the first tags of each file, those given by people first, then by name."""
    rows = t["file_tags"].join(t["tags"].select(F.col("id").alias("tag_id"), "display_name"), "tag_id")
    # Dealt by file before they are sorted, so that no task holds this sort beside those of the join, or the groups the rows come from.
    rows = rows.withColumn("by", source_order(F.col("source"))).repartition("file_id")
    first = top_n_per(rows, ["file_id"], [F.col("by"), F.col("display_name"), F.col("tag_id")], most, "n")
    return first.groupBy("file_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "display_name"))), lambda x: x["display_name"]).alias("tags"))


def overview(t: Tables) -> DataFrame:
    """One row for each file with what the list shows and filters by. A video has a preview if it has a poster."""
    image = t["image_assets"].select(F.col("file_id").alias("id"), F.col("width").alias("iw"), F.col("height").alias("ih"), "format", F.col("thumbnail_path").alias("thumb"))
    video = t["video_assets"].select(F.col("file_id").alias("id"), F.col("width").alias("vw"), F.col("height").alias("vh"), "duration_ms", "fps", "container", "bitrate", "poster_path", "video_codec", "audio_codec")
    text = t["search_documents"].select(F.col("file_id").alias("id"), "document_text")
    quality = current(t, "quality").select(F.col("file_id").alias("id"), "quality_score", "quality_tier")
    review = latest_review(t).select(F.col("file_id").alias("id"), F.col("action_type").alias("review_action"))
    df = t["files"]
    for side in (image, video, text, quality, review):
        df = df.join(side, "id", "left")
    return df.select(
        *t["files"].columns, F.coalesce("iw", "vw").alias("width"), F.coalesce("ih", "vh").alias("height"), "duration_ms", "fps", "container", "bitrate", "format", "video_codec", "audio_codec",
        ((F.col("media_type") == "image") | (F.coalesce("poster_path", F.lit("")) != "")).alias("has_preview"), F.coalesce("thumb", F.lit("")).alias("thumbnail_path"),
        "document_text", "quality_score", "quality_tier", "review_action", F.coalesce("quality_score", F.lit(-1.0)).alias("quality_key"),
    )


def tagged(t: Tables, namespace: str = "", tag: str = "") -> DataFrame:
    """(id): files with any tag, or with a tag of that name or display name; a namespace counts only beside one."""
    rows = t["file_tags"]
    if tag:
        named = t["tags"].where((F.col("name") == tag) | (F.col("display_name") == tag))
        named = named.where(F.col("namespace") == namespace) if namespace else named
        rows = rows.join(named.select(F.col("id").alias("tag_id")), "tag_id", "left_semi")
    return rows.select(F.col("file_id").alias("id"))


def clustered(t: Tables, kind: str, status: str = "") -> DataFrame:
    """(id): members of clusters of a kind; a status counts only beside a kind."""
    of = t["clusters"].where(F.col("cluster_type") == kind)
    of = of.where(F.col("status") == status) if status else of
    return t["cluster_members"].join(of.select(F.col("id").alias("cluster_id")), "cluster_id", "left_semi").select(F.col("file_id").alias("id"))


def _of(t: Tables, ids: DataFrame) -> Tables:
    """The tables that overview() reads, cut to a page's files: `ids` has MOST + 1 rows at most, so it is sent to all."""
    few = F.broadcast(ids.select("id"))
    cut = lambda name, key: t[name].join(few.withColumnRenamed("id", key), key, "left_semi")
    own = {name: cut(name, "file_id") for name in ("image_assets", "video_assets", "search_documents", "file_current_analysis", "review_actions", "file_tags")}
    return ChainMap(own | {"files": cut("files", "id")}, t)


def filtered(t: Tables, o: ListOptions, sides: bool = True, index: SearchIndex | None = None) -> DataFrame:
    """overview() with the filters that are asked for; predicates that aren't asked for don't enter the plan. Without
    `sides` it is the files alone, which will do if nothing else is asked about (see _needs_sides). A search reads the
    index, if one is given, and else every text."""
    df = overview(t) if sides else t["files"]
    for column, value in (("media_type", o.media_type), ("status", o.status), ("volume_id", o.volume_id), ("quality_tier", o.quality_tier), ("review_action", o.review_action)):
        if value:
            df = df.where(F.col(column) == value)
    if o.query and index:
        df = df.join(index.matching(t, o.query).withColumnRenamed("file_id", "id"), "id", "left_semi")
    elif o.query:
        text = F.col("document_text")
        hit = search.matches(search.tokens(text), o.query, search.compounds(text))
        for column in (F.col("file_name"), F.col("abs_path"), text):
            hit = hit | search.contains(column, o.query)
        df = df.where(hit)
    if o.has_tags == "true":
        df = df.join(tagged(t), "id", "left_semi")
    elif o.has_tags == "false":
        df = df.join(tagged(t), "id", "left_anti")
    elif o.has_tags:
        df = df.where(F.lit(False))
    if o.tag:
        df = df.join(tagged(t, o.tag_namespace, o.tag), "id", "left_semi")
    if o.cluster_type:
        df = df.join(clustered(t, o.cluster_type, o.cluster_status), "id", "left_semi")
    return df


def _order(sort: str) -> list[Column]:
    if sort not in SORTS:
        raise ValueError(f"unknown sort {sort!r}")
    return [F.col(c).desc_nulls_last() if falls else F.col(c).asc_nulls_first() for c, falls in SORTS[sort]]


def encode_cursor(sort: str, row: dict) -> str:
    at = {c: row[c].isoformat() if isinstance(row[c], datetime) else row[c] for c, _ in SORTS[sort]}
    return base64.urlsafe_b64encode(json.dumps({"sort": sort} | at).encode()).decode()


def decode_cursor(cursor: str, sort: str) -> list[tuple[Column, object, bool]]:
    held = json.loads(base64.urlsafe_b64decode(cursor))
    if held.get("sort") != sort:
        raise ValueError("the cursor belongs to another sort")
    return [(F.col(c), datetime.fromisoformat(held[c]) if c == "updated_at" and held[c] else held[c], falls) for c, falls in SORTS[sort]]


def _needs_sides(o: ListOptions, index: SearchIndex | None = None) -> bool:
    """Whether a filter or the order reads more than the files."""
    return bool((o.query and not index) or o.quality_tier or o.review_action or o.sort == "quality_desc")


def listed(t: Tables, o: ListOptions, index: SearchIndex | None = None) -> DataFrame:
    """The rows of a page and, if there are more, one beyond it, in order and with their tags.

    The page is cut from the files alone wherever nothing else is asked about; what is shown beside them is then
    joined for its rows only.
    """
    sides = _needs_sides(o, index)
    df = filtered(t, o, sides, index)
    if o.cursor:
        df = df.where(after(decode_cursor(o.cursor, o.sort or "updated_desc")))
    order = _order(o.sort or "updated_desc")
    page = settled(df.orderBy(*order).offset(max(0, o.offset)).limit(o.size + 1))  # once, for all that is joined to its rows
    few = _of(t, page)
    page = page if sides else overview(few)
    return page.join(tag_summary(few).withColumnRenamed("file_id", "id"), "id", "left").orderBy(*order)


def list_files(t: Tables, options: ListOptions | None = None, index: SearchIndex | None = None) -> Page:
    """A page of the library. Only the page's rows, MOST + 1 at most, come to the driver."""
    o = options or ListOptions()
    sort, df = o.sort or "updated_desc", listed(t, o, index)
    rows = df.collect()
    more = len(rows) > o.size
    return Page(df.sparkSession.createDataFrame(rows[: o.size], df.schema), more, encode_cursor(sort, rows[o.size - 1].asDict()) if more else "")


def file_detail(t: Tables, file_id: int) -> dict[str, DataFrame]:
    """What is known of one file, by part."""
    own = F.col("file_id") == file_id
    tags = t["file_tags"].where(own).join(t["tags"].withColumnRenamed("id", "tag_id"), "tag_id")
    clusters = t["cluster_members"].where(own).join(t["clusters"].withColumnRenamed("id", "cluster_id"), "cluster_id")
    frames = t["video_frames"].where(own)
    pointers = t["file_current_analysis"].where(own).select(F.col("analysis_result_id").alias("id"))
    return {
        "file": overview(t).where(F.col("id") == file_id),
        "history": t["file_path_history"].where(own).orderBy(F.desc("seen_at")),
        "analyses": t["analysis_results"].join(pointers, "id", "left_semi").orderBy("analysis_type"),
        "tags": tags.orderBy(source_order(F.col("source")), "display_name"),
        "reviews": t["review_actions"].where(own).orderBy(F.desc("created_at"), F.desc("id")).limit(10),
        "clusters": clusters.orderBy(F.desc_nulls_first("created_at"), F.desc("cluster_id")),
        "embeddings": embedding_inventory(t, file_id),
        "frames": frames.orderBy(*frame_order()).limit(6),
    }


def frame_order() -> list[Column]:
    return [F.when(F.col("frame_role") == "understanding", 0).otherwise(1), F.col("timestamp_ms"), F.col("id")]


def latest_reviews(t: Tables, most: int = 10) -> DataFrame:
    """Each file's last reviews, with their place `n`."""
    return top_n_per(t["review_actions"].where("file_id IS NOT NULL"), ["file_id"], [F.desc("created_at"), F.desc("id")], most, "n")


def frame_paths(t: Tables) -> DataFrame:
    """(file_id, n, frame_path): the frames of each video in the order they are shown, from 0."""
    n = top_n_per(t["video_frames"], ["file_id"], frame_order(), 2**31 - 1, "n")
    return n.select("file_id", (F.col("n") - 1).alias("n"), "frame_path")


def preview_paths(t: Tables) -> DataFrame:
    """(id, content_path, preview_path): an image's thumbnail or itself, a video's poster or else its first frame."""
    first = frame_paths(t).where("n = 0").select(F.col("file_id").alias("id"), "frame_path")
    df = t["files"].join(t["image_assets"].select(F.col("file_id").alias("id"), "thumbnail_path"), "id", "left")
    df = df.join(t["video_assets"].select(F.col("file_id").alias("id"), "poster_path"), "id", "left").join(first, "id", "left")
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    path = F.when(F.col("media_type") == "image", F.coalesce(some("thumbnail_path"), "abs_path")).otherwise(F.coalesce(some("poster_path"), some("frame_path")))
    return df.select("id", F.col("abs_path").alias("content_path"), path.alias("preview_path"))


def provider_of(model: Column) -> Column:
    return F.when(model.startswith("semantic-"), "semantic").when(model.startswith("ffmpeg-"), "pixel").when(model.startswith("placeholder"), "placeholder").otherwise("unknown")


def embedding_inventory(t: Tables, file_id: int | None = None) -> DataFrame:
    """(embedding_type, provider, model_name, vectors) of a file, its frames included, or of the whole library; visual types only."""
    rows = t["embeddings"].where(F.col("embedding_type").isin("image_visual", "video_frame_visual"))
    if file_id is not None:
        frames = t["video_frames"].where(F.col("file_id") == file_id).select(F.col("id").alias("frame_id"))
        rows = rows.where(F.col("file_id") == file_id).unionByName(rows.join(frames, "frame_id", "left_semi").select(*rows.columns))
    return rows.groupBy("embedding_type", provider_of(F.col("model_name")).alias("provider"), "model_name").agg(F.count("*").alias("vectors"))
