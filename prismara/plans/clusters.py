"""Reading clusters: the list, one cluster's members, counts by type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.relational import latest_per
from ..sources.catalog import Tables
from .files import provider_of

#: Roles in the order a cluster shows them; all others follow alike.
ROLES = ("cover", "best_quality")


def role_order(role: Column) -> Column:
    out = F.lit(len(ROLES))
    for i, name in enumerate(ROLES):
        out = F.when(role == name, i).otherwise(out)
    return out


def newest() -> list[Column]:
    """The order of clusters wherever they are listed."""
    return [F.desc_nulls_first("created_at"), F.desc("id")]


def visual_evidence(t: Tables) -> DataFrame:
    """(file_id, person, generic): which kinds of vectors a file, or its frames, has."""
    frames = t["video_frames"].select(F.col("id").alias("frame_id"), F.col("file_id").alias("of"))
    rows = t["embeddings"].join(frames, "frame_id", "left").withColumn("file_id", F.coalesce("file_id", "of"))
    kind = F.col("embedding_type")
    return rows.groupBy("file_id").agg(F.max(kind == "person_visual").alias("person"), F.max(kind.isin("image_visual", "video_frame_visual")).alias("generic"))


def list_clusters(t: Tables, cluster_type: str = "", status: str = "", limit: int | None = 20, offset: int = 0) -> DataFrame:
    """Clusters with members, strong members (score from 0.8), top score, and members with either kind of vector.

    top_evidence is the kind that says most: person vectors before generic ones.
    """
    of = t["clusters"]
    of = of.where(F.col("cluster_type") == cluster_type) if cluster_type else of
    of = of.where(F.col("status") == status) if status else of
    # A file's rows in a cluster come together first, so distinct files are counted as rows and no row is copied for them.
    each = t["cluster_members"].groupBy("cluster_id", "file_id").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= 0.80).alias("strong"), F.max("score").alias("top"))
    counts = each.join(visual_evidence(t).where("file_id IS NOT NULL"), "file_id", "left").groupBy(F.col("cluster_id").alias("id")).agg(
        F.sum("n").alias("members"), F.sum("strong").alias("strong_members"), F.max("top").alias("top_score"),
        F.count_if("person").alias("person_members"), F.count_if("generic").alias("generic_members"),
    )
    df = of.join(counts, "id", "left").fillna(0, ["members", "strong_members", "person_members", "generic_members"])
    df = df.withColumn("top_evidence", F.when(F.col("person_members") > 0, "person_visual").when(F.col("generic_members") > 0, "generic_visual"))
    if limit is None:
        return df
    return df.orderBy(*newest()).offset(max(0, offset)).limit(limit)


def dominant_vectors(t: Tables) -> DataFrame:
    """(file_id, embedding_type, provider, model_name, vectors): the vectors a file has most of, person vectors first."""
    frames = t["video_frames"].select(F.col("id").alias("frame_id"), F.col("file_id").alias("of"))
    rows = t["embeddings"].where(F.col("embedding_type").isin("person_visual", "image_visual", "video_frame_visual"))
    rows = rows.join(frames, "frame_id", "left").withColumn("file_id", F.coalesce("file_id", "of"))
    counts = rows.groupBy("file_id", "embedding_type", "model_name").agg(F.count("*").alias("vectors"))
    order = [F.when(F.col("embedding_type") == "person_visual", 0).otherwise(1), F.desc("vectors"), F.desc("model_name"), F.col("embedding_type")]
    return latest_per(counts, ["file_id"], order).withColumn("provider", provider_of(F.col("model_name")))


def cluster_members(t: Tables, cluster_id: int | None = None) -> DataFrame:
    """Members of one cluster, or of all, with their file and dominant vectors; in order of role, score and id for one."""
    rows = t["cluster_members"]
    rows = rows.where(F.col("cluster_id") == cluster_id) if cluster_id is not None else rows
    files = t["files"].select(F.col("id").alias("file_id"), "file_name", "media_type", F.col("status").alias("file_status"))
    df = rows.join(files, "file_id").join(dominant_vectors(t), "file_id", "left")
    return df.orderBy(role_order(F.col("role")), F.desc_nulls_last("score"), "file_id") if cluster_id is not None else df


def summarize_clusters(t: Tables) -> DataFrame:
    """(cluster_type, status, clusters, members)."""
    rows = t["clusters"].join(t["cluster_members"].select(F.col("cluster_id").alias("id"), "file_id"), "id", "left")
    return rows.groupBy("cluster_type", "status").agg(F.count_distinct("id").alias("clusters"), F.count("file_id").alias("members"))


def set_cluster_status(t: Tables, cluster_id: int, status: str) -> DataFrame:
    if status not in ("candidate", "confirmed", "ignored"):
        raise ValueError(f"unknown status {status!r}")
    return t["clusters"].withColumn("status", F.when(F.col("id") == cluster_id, status).otherwise(F.col("status")))


def merge_clusters(t: Tables, kind: str, members: DataFrame, confidence: float, as_of: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(clusters, cluster_members) after a recompute of a kind from members(title, file_id, score, role).

    A cluster is known by its title. Those computed again become candidates with just these members; those of
    the kind that weren't are ignored and lose theirs. A new cluster's id is a hash of kind and title, and it is made
    at `as_of` (now).
    """
    old = t["clusters"]
    titles = members.groupBy("title").agg(F.min(F.when(F.col("role").isin("cover", "best_quality", "series_focus"), F.col("file_id"))).alias("cover"))
    known = old.where(F.col("cluster_type") == kind).select("title", "id", "created_at")
    fresh = titles.join(known, "title", "left_anti").select("title", F.xxhash64(F.lit(kind), "title").bitwiseAND(F.lit(2**62 - 1)).alias("id"), (F.current_timestamp() if as_of is None else as_of).alias("created_at"))
    ids = titles.join(known.join(titles, "title", "left_semi").unionByName(fresh), "title")
    made = ids.select("id", F.lit(kind).alias("cluster_type"), "title", F.lit(confidence).alias("confidence"), F.lit("candidate").alias("status"), F.col("cover").alias("cover_file_id"), "created_at")
    rest = old.join(ids.select("id"), "id", "left_anti").withColumn("status", F.when(F.col("cluster_type") == kind, "ignored").otherwise(F.col("status")))
    gone = old.where(F.col("cluster_type") == kind).select(F.col("id").alias("cluster_id"))
    kept = t["cluster_members"].join(gone, "cluster_id", "left_anti")
    now = members.join(ids.select("title", F.col("id").alias("cluster_id")), "title").select("cluster_id", "file_id", "score", "role")
    return rest.unionByName(made), kept.unionByName(now)
