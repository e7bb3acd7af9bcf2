"""One wide row for each file: what the three families of clusters are computed from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import latest_per
from ..sources.catalog import Tables
from .files import current
from .ingest import quality_source

#: The frames that clusters are made from.
ROLE = "understanding"


def understanding_frames(t: Tables) -> DataFrame:
    """(frame_id, file_id, timestamp_ms, frame_phash) of the frames that stand for their video."""
    return t["video_frames"].where(f"frame_role = '{ROLE}'").select(F.col("id").alias("frame_id"), "file_id", "timestamp_ms", F.col("phash").alias("frame_phash"))


def frame_vectors(t: Tables, kinds: tuple[str, ...], each_model: bool = False) -> DataFrame:
    """(file_id, frame_id, kind, model, v): the latest vector of each such frame, or of each and model; earlier kinds first."""
    of = t["embeddings"].where(F.col("frame_id").isNotNull() & F.col("embedding_type").isin(*kinds) & (F.col("model_name") != ""))
    of = of.select("frame_id", "id", F.col("embedding_type").alias("kind"), F.col("model_name").alias("model"), F.col("vector").cast("array<double>").alias("v"))
    order = [F.array_position(F.array(*map(F.lit, kinds)), F.col("kind")), F.desc("id")]
    of = latest_per(of.join(understanding_frames(t).select("frame_id", "file_id"), "frame_id"), ["frame_id", *["model"] * each_model], order)
    return of.select("file_id", "frame_id", "kind", "model", "v")


def _looks(rows: DataFrame, name: str) -> DataFrame:
    """(file_id, name): each file's vectors as an array of (kind, model, v)."""
    return rows.groupBy("file_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("frame_id", "kind", "model", "v"))), lambda x: F.struct(x["kind"].alias("kind"), x["model"].alias("model"), x["v"].alias("v"))).alias(name))


#: What may be asked for beside the files' own columns and dimensions.
PARTS = ("phash", "quality", "about", "image", "image_models", "person", "frame_phashes", "frame_looks", "frame_models", "person_looks")


def file_features(t: Tables, parts: tuple[str, ...] = PARTS) -> DataFrame:
    """Files with dimensions and the parts asked for: hashes, quality, structured attributes, the latest vectors. What isn't
    asked for isn't read.

    `vector` is the latest image vector, `image_models` that of each model, `person_vector` the latest with person
    vectors first. Of a video's
    `understanding` frames there are the hashes, `frame_looks` (the latest frame vector of each), `frame_models`
    (that of each and model) and `person_looks` (the latest person vector, or else frame vector), each vector
    with its own kind and model.
    """
    of_frame = ("person_visual", "video_frame_visual")

    def vectors(*kinds: str) -> DataFrame:
        of = t["embeddings"].where(F.col("file_id").isNotNull() & F.col("embedding_type").isin(*kinds))
        return of.select("file_id", "id", F.col("embedding_type").alias("kind"), F.col("model_name").alias("model"), F.col("vector").cast("array<double>").alias("vector"))

    def person() -> DataFrame:
        of = latest_per(vectors("image_visual", "person_visual"), ["file_id"], [F.when(F.col("kind") == "person_visual", 0).otherwise(1), F.desc("id")])
        return of.select("file_id", F.col("kind").alias("person_kind"), F.col("model").alias("person_model"), F.col("vector").alias("person_vector"))

    sides = {
        "phash": lambda: t["image_assets"].select("file_id", "phash"),
        "quality": lambda: current(t, "quality").select("file_id", "quality_score", "quality_tier"),
        "about": lambda: current(t, "understanding").select("file_id", *(F.get_json_object("structured_attributes", f"$.{k}").alias(k) for k in ("has_face", "subject_count", "capture_type"))),
        "image": lambda: latest_per(vectors("image_visual"), ["file_id"], [F.desc("id")]).drop("id"),
        "image_models": lambda: _looks(latest_per(vectors("image_visual"), ["file_id", "model"], [F.desc("id")]).select("file_id", F.col("id").alias("frame_id"), "kind", "model", F.col("vector").alias("v")), "image_models"),
        "person": person,
        "frame_phashes": lambda: understanding_frames(t).where("frame_phash <> ''").groupBy("file_id").agg(F.sort_array(F.collect_set("frame_phash")).alias("frame_phashes")),
        "frame_looks": lambda: _looks(frame_vectors(t, of_frame[1:]), "frame_looks"),
        "frame_models": lambda: _looks(frame_vectors(t, of_frame[1:], each_model=True), "frame_models"),
        "person_looks": lambda: _looks(frame_vectors(t, of_frame), "person_looks"),
    }
    df = quality_source(t).withColumnRenamed("id", "file_id")
    for part in parts:
        df = df.join(sides[part](), "file_id", "left")
    return df
