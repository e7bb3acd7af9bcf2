"""Tags, volumes, reviews and jobs: what is read of them and how they change. A change is a new table."""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..operators.relational import replace_slice
from ..schema import TABLES
from ..sources.catalog import Tables

ACTIONS = ("keep", "trash_candidate", "ignore", "favorite", "hide")
OPEN = ("pending", "leased", "running")

#: Priority of each kind of job; lower ones run first.
PRIORITIES = {
    "scan_volume": 50, "hash_file": 70, "extract_image_features": 80, "extract_video_features": 80, "recompute_search_doc": 90,
    "infer_quality": 95, "embed_person_image": 97, "embed_person_video_frames": 97, "embed_image": 98, "embed_video_frames": 99,
    "infer_tags": 100, "cluster_same_content": 110, "cluster_same_series": 115, "cluster_same_person": 118,
}


def _rows(t: Tables, name: str, rows: Sequence[Row | tuple]) -> DataFrame:
    return t[name].sparkSession.createDataFrame(list(rows), TABLES[name])


def list_tags(t: Tables, namespace: str = "", limit: int | None = 20) -> DataFrame:
    """Tags with the number of files that have them, the most used first."""
    tags = t["tags"].where(F.col("namespace") == namespace) if namespace else t["tags"]
    counts = t["file_tags"].groupBy(F.col("tag_id").alias("id")).agg(F.count("*").alias("uses"))
    df = tags.join(counts, "id", "left").withColumn("uses", F.coalesce("uses", F.lit(0)))
    return df if limit is None else df.orderBy(F.desc("uses"), "display_name", "id").limit(limit)


def replace_ai_tags(t: Tables, fresh: DataFrame) -> DataFrame:
    """file_tags after an analysis: AI tags of the files in fresh(file_id, tag_id, confidence, evidence) give way to these."""
    files = fresh.select("file_id").distinct().withColumn("again", F.lit(True))
    rows = t["file_tags"].join(files, "file_id", "left").where(~(F.coalesce("again", F.lit(False)) & (F.col("source") == "ai"))).drop("again")
    one = fresh.groupBy("file_id", "tag_id").agg(F.max("confidence").alias("confidence"), F.max("evidence").alias("evidence"))
    return rows.unionByName(one.withColumn("source", F.lit("ai")))


def add_tag(t: Tables, file_id: int, tag_id: int) -> DataFrame:
    own = (F.col("file_id") == file_id) & (F.col("tag_id") == tag_id) & (F.col("source") == "human")
    return replace_slice(t["file_tags"], _rows(t, "file_tags", [(file_id, tag_id, "human", 1.0, None)]), own)


def delete_tag(t: Tables, file_id: int, tag_id: int) -> DataFrame:
    """The tag goes whoever gave it."""
    return t["file_tags"].where(~((F.col("file_id") == file_id) & (F.col("tag_id") == tag_id)))


def replace_tag(t: Tables, file_id: int, old: int, new: int) -> DataFrame:
    return add_tag(ChainMap({"file_tags": delete_tag(t, file_id, old)}, t), file_id, new)


def list_volumes(t: Tables) -> DataFrame:
    return t["volumes"].orderBy("display_name", "id")


def create_volume(t: Tables, volume_id: int, name: str, path: str) -> DataFrame:
    if not name.strip() or not path.strip():
        raise ValueError("a volume needs a name and a path")
    return t["volumes"].unionByName(_rows(t, "volumes", [(volume_id, path.strip(), None, name.strip(), True, None)]))


def delete_volume(t: Tables, volume_id: int) -> tuple[DataFrame, DataFrame]:
    """(volumes, files) without the volume."""
    return t["volumes"].where(F.col("id") != volume_id), t["files"].where(F.col("volume_id") != volume_id)


def review(t: Tables, action_id: int, file_id: int, action: str, at: datetime) -> DataFrame:
    if action not in ACTIONS:
        raise ValueError(f"unknown action {action!r}")
    return t["review_actions"].unionByName(_rows(t, "review_actions", [(action_id, file_id, None, action, at)]))


def review_cluster(t: Tables, cluster_id: int, action: str, at: datetime) -> DataFrame:
    """review_actions with the action for every member of a cluster; a row's id is a hash of cluster, file, action and time."""
    if action not in ACTIONS:
        raise ValueError(f"unknown action {action!r}")
    own = t["cluster_members"].where(F.col("cluster_id") == cluster_id).select("file_id").distinct()
    rows = own.select("file_id", F.lit(cluster_id).cast("long").alias("cluster_id"), F.lit(action).alias("action_type"), F.lit(at).alias("created_at"))
    return t["review_actions"].unionByName(rows.withColumn("id", F.xxhash64("cluster_id", "file_id", "action_type", "created_at").bitwiseAND(F.lit(2**62 - 1))))


def trash(t: Tables, action_id: int, file_id: int, at: datetime) -> tuple[DataFrame, DataFrame]:
    """(files, review_actions) with the file in the trash."""
    files = t["files"].withColumn("status", F.when(F.col("id") == file_id, "trashed").otherwise(F.col("status")))
    return files, t["review_actions"].unionByName(_rows(t, "review_actions", [(action_id, file_id, None, "deleted_to_trash", at)]))


def task_summary(t: Tables) -> DataFrame:
    """One row: pending, running (leased ones too), failed, dead and succeeded jobs."""
    s = F.col("status")
    return t["jobs"].agg(F.count_if(s == "pending").alias("pending"), F.count_if(s.isin("leased", "running")).alias("running"), F.count_if(s == "failed").alias("failed"), F.count_if(s == "dead").alias("dead"), F.count_if(s == "succeeded").alias("succeeded"))


def list_jobs(t: Tables, status: str = "", limit: int = 20) -> DataFrame:
    rows = t["jobs"].where(F.col("status") == status) if status else t["jobs"]
    return rows.orderBy(F.desc_nulls_first("updated_at"), F.desc("id")).limit(limit)


def list_job_events(t: Tables, job_id: int, limit: int | None = 20) -> DataFrame:
    """A job's last events, the newest first; without a limit all of them."""
    events = t["job_events"].where(F.col("job_id") == job_id).orderBy(F.desc_nulls_first("created_at"), F.desc("id"))
    return events if limit is None else events.limit(limit if limit > 0 else 20)


def leasable(t: Tables, as_of: Column) -> DataFrame:
    """Jobs that may be leased: due ones that are pending, and leased ones whose lease has run out."""
    due = (F.col("status") == "pending") & (F.col("scheduled_at") <= as_of)
    lost = (F.col("status") == "leased") & (F.col("lease_expires_at") < as_of)
    return t["jobs"].where(due | lost)


def lease_next(t: Tables, as_of: Column) -> DataFrame:
    """The one job to run next, leased for ten minutes."""
    first = leasable(t, as_of).orderBy("priority", "scheduled_at", "id").limit(1)
    return first.withColumns({"status": F.lit("leased"), "attempts": F.col("attempts") + 1, "lease_expires_at": as_of + F.expr("INTERVAL 10 MINUTES")})


_TARGET = ["job_type", "target_type", "target_id"]


def ensure_jobs(t: Tables, wanted: DataFrame) -> DataFrame:
    """Of wanted(job_type, target_type, target_id, ...), distinct, those without an open job of the same type and target."""
    return wanted.dropDuplicates(_TARGET).join(t["jobs"].where(F.col("status").isin(*OPEN)).select(*_TARGET), _TARGET, "left_anti")


def inserted_or_existing(t: Tables, wanted: DataFrame) -> DataFrame:
    """(job_type, target_type, target_id, id, status, created): of each wanted target the open job there is, the first by
    id, or a new pending one, whose id is a hash of the target."""
    there = t["jobs"].where(F.col("status").isin(*OPEN)).groupBy(*_TARGET).agg(F.min(F.struct("id", "status")).alias("job"))
    met = wanted.select(*_TARGET).distinct().join(there, _TARGET, "left")
    new_id = F.xxhash64(*_TARGET).bitwiseAND(F.lit(2**62 - 1))
    return met.select(*_TARGET, F.coalesce("job.id", new_id).alias("id"), F.coalesce("job.status", F.lit("pending")).alias("status"), F.col("job").isNull().alias("created"))


def with_rows(t: Tables, name: str, rows: DataFrame, key: str = "id") -> DataFrame:
    """A table with rows in place of those of the same key."""
    return t[name].join(rows.select(key), key, "left_anti").unionByName(rows.select(*t[name].columns))


def mark(t: Tables, job_id: int, status: str, as_of: Column, error: str | None = None, worker: str | None = None, stage: str | None = None) -> DataFrame:
    """Jobs with one running (by a worker, at a stage), succeeded or failed; the first start of a job stays."""
    if status not in ("running", "succeeded", "failed"):
        raise ValueError(f"a job can't be marked {status!r}")
    changes = {"status": F.lit(status), "updated_at": as_of}
    if status == "running":
        changes |= {"progress_stage": F.nullif(F.lit(stage), F.lit("")), "worker_name": F.nullif(F.lit(worker), F.lit("")), "started_at": F.coalesce("started_at", as_of)}
    else:
        changes |= {"finished_at": as_of, "lease_expires_at": F.lit(None).cast("timestamp")}
        changes |= {"last_error": F.lit(error)} if status == "failed" else {"progress_stage": F.lit(None).cast("string"), "progress_percent": F.lit(100)}
    own = F.col("id") == job_id
    return t["jobs"].withColumns({c: F.when(own, v).otherwise(F.col(c)) for c, v in changes.items()})


def retry(t: Tables, job_id: int, as_of: Column) -> DataFrame:
    """Jobs with one pending again, if it had failed or was dead."""
    own = (F.col("id") == job_id) & F.col("status").isin("failed", "dead")
    return t["jobs"].withColumns({"status": F.when(own, "pending").otherwise(F.col("status")), "scheduled_at": F.when(own, as_of).otherwise(F.col("scheduled_at"))})


def fold_events(events: DataFrame) -> DataFrame:
    """(job_id, status): the state after all of events(job_id, status, at, id), by the last of each job."""
    return events.groupBy("job_id").agg(F.max_by("status", F.struct("at", "id")).alias("status"))
