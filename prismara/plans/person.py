"""Files of one person: by tags, or by signals where there are none, scored against an anchor."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels, media, vectors
from ..operators.classes import classed
from ..operators.lineage import settled
from ..operators.nearest import within
from ..operators.relational import latest_per
from ..sources.catalog import Tables


@dataclass(frozen=True)
class Thresholds:
    # Fixed values.
    image_distance: float = 0.08
    frame_distance: float = 0.10
    duration: float = 0.85
    pixels: float = 0.20
    aspect: float = 0.20
    narrow_over: int = 4
    weak_days: int = 14


# Points of a score.
BASE = {"human": 0.86, "ai": 0.68, "auto": 0.56}
OTHER_BASE, FAMILY, PARENT, PERSON_VECTOR, GENERIC_VECTOR, FACES, SUBJECTS, CAPTURES, MOST = 0.50, 0.10, 0.08, 0.26, 0.18, 0.08, 0.04, 0.04, 0.99
TIME = ((6, 0.06), (24, 0.04), (24 * 7, 0.02))
CONFIDENCE = 0.55

FACTS = ("media_type", "parent_path", "family", "t", "width", "height", "duration_ms", "face", "subject_count", "capture_type")
LOOKS = ("person_kind", "person_model", "person_vector", "person_looks")


def person_tags(t: Tables) -> DataFrame:
    """(file_id, name, source): tags of the namespace `person`; of one name the human one counts."""
    rows = t["file_tags"].join(t["tags"].where("namespace = 'person'").select(F.col("id").alias("tag_id"), "name"), "tag_id")
    order = [F.when(F.col("source") == "human", 0).otherwise(1), F.col("source")]
    return latest_per(rows.select("file_id", "name", "source"), ["file_id", "name"], order)


def auto_signals(t: Tables, files: DataFrame) -> DataFrame:
    """(file_id, name, source `auto`): signs of a person in content and sensitive tags and in structured attributes."""
    names = t["tags"].where(F.col("namespace").isin("content", "sensitive") & labels.has_sign(F.col("name"), labels.PERSON_SIGNS)).select(F.col("id").alias("tag_id"), "name")
    signals = t["file_tags"].join(names, "tag_id").select("file_id", "name")
    lower = lambda c: F.lower(F.coalesce(c, F.lit("")))
    for name, test in (
        ("__auto:subject_count:single", lower(F.col("subject_count")).isin(*labels.SUBJECT_COUNTS["single"])),
        ("__auto:has_face:true", lower(F.col("has_face")).isin(*labels.TRUE_IN_QUERIES)),
        ("__auto:capture_type:selfie", lower(F.col("capture_type")).isin(*labels.CAPTURE_TYPES["selfie"])),
    ):
        signals = signals.union(files.where(test).select("file_id", F.lit(name)))
    return signals.distinct().withColumn("source", F.lit("auto"))


def effective_tags(t: Tables, files: DataFrame) -> DataFrame:
    """Person tags, and for files without any their signals."""
    tags = person_tags(t)
    return tags.unionByName(auto_signals(t, files).join(tags, "file_id", "left_anti"))


def facts(files: DataFrame) -> DataFrame:
    """What scores compare, for active files; `seen` says whether there are vectors."""
    clean = {"family": media.person_family(F.col("file_name")), "t": F.unix_micros("mtime"), "face": labels.truthy(F.col("has_face"))}
    clean["seen"] = F.col("person_vector").isNotNull() | (F.coalesce(F.size("person_looks"), F.lit(0)) > 0)
    return files.where("status = 'active'").withColumns(clean).select("file_id", *FACTS, "seen")


def _known(a: str, b: str) -> Column:
    return F.coalesce((F.col(a) != "") & (F.col(a) == F.col(b)), F.lit(False))


def _looks(p: str) -> tuple[Column, Column]:
    """A side's image and its frames as arrays of (kind, model, v); kinds that aren't about persons are one."""
    kind = lambda k: F.when(F.lower(F.trim(F.coalesce(k, F.lit("")))) == "person_visual", "person_visual").otherwise("generic_visual")
    image = F.struct(kind(F.col(f"{p}_person_kind")).alias("kind"), F.col(f"{p}_person_model").alias("model"), F.col(f"{p}_person_vector").alias("v"))
    frames = F.transform(f"{p}_person_looks", lambda x: F.struct(kind(x["kind"]).alias("kind"), x["model"].alias("model"), x["v"].alias("v")))
    return F.when(F.col(f"{p}_person_vector").isNotNull(), F.array(image)), frames


def near_looks(files: DataFrame, th: Thresholds = Thresholds()) -> tuple[DataFrame, DataFrame]:
    """(file_id, look) and (a_look, b_look, vector_points): files with the same vectors have one look, and which looks are near:
    the best of image to image, frames to frames and image to frames, both vectors of one model and one kind.

    Distinct vectors meet by a range join over cells, and no pair of files is spelled out. Both are settled.
    """
    image, frames = _looks("x")
    of = files.select("file_id", *(F.col(c).alias(f"x_{c}") for c in LOOKS))
    one = of.select("file_id", F.explode(image).alias("k"), F.lit(True).alias("image"))
    each = one.unionByName(of.select("file_id", F.explode(frames).alias("k"), F.lit(False).alias("image"))).where("k.model <> ''")
    vectors, each = classed(each.select("file_id", "image", F.col("k.kind").alias("kind"), F.col("k.model").alias("model"), F.col("k.v").alias("v")), ["kind", "model", "v"], "_v")
    side = lambda p: vectors.select("kind", "model", F.col("_v").alias(f"{p}_n"), F.col("v").alias(f"{p}_v"))
    near = settled(within(side("a"), side("b"), ["kind", "model"], max(th.image_distance, th.frame_distance), metric="mean"))
    looks, held = classed(each.groupBy("file_id").agg(F.sort_array(F.collect_set(F.struct("image", "_v"))).alias("h")), ["h"], "look")
    part = lambda p: looks.select(F.col("look").alias(f"{p}_look"), F.explode("h").alias("x")).select(f"{p}_look", F.col("x.image").alias(f"{p}_image"), F.col("x._v").alias(f"{p}_n"))
    met = near.join(part("a"), "a_n").join(part("b"), "b_n")
    met = met.where(F.col("distance") <= F.when(F.col("a_image") & F.col("b_image"), th.image_distance).otherwise(th.frame_distance))
    met = met.groupBy("a_look", "b_look").agg(F.max(F.when(F.col("kind") == "person_visual", PERSON_VECTOR).otherwise(GENERIC_VECTOR)).alias("vector_points"))
    return settled(held), settled(met)


def vector_points(th: Thresholds) -> Column:
    """The best of image to image, frames to frames and image to frames; both vectors of one model and one kind."""
    (image_a, frames_a), (image_b, frames_b) = _looks("a"), _looks("b")
    out = F.lit(0.0)
    for kind, points in (("generic_visual", GENERIC_VECTOR), ("person_visual", PERSON_VECTOR)):
        near = vectors.looks_near(image_a, image_b, th.image_distance, kind)
        for left, right in ((frames_a, frames_b), (image_a, frames_b), (frames_a, image_b)):
            near = near | vectors.looks_near(left, right, th.frame_distance, kind)
        out = F.when(near, points).otherwise(out)
    return out


def near_pairs(pairs: DataFrame, files: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    """(a_id, b_id, vector_points) of the pairs (a_id, b_id) whose vectors are near."""
    side = lambda p: files.select(F.col("file_id").alias(f"{p}_id"), *(F.col(c).alias(f"{p}_{c}") for c in LOOKS))
    met = pairs.distinct().join(side("a"), "a_id").join(side("b"), "b_id").withColumn("vector_points", vector_points(th))
    return met.where("vector_points > 0").select("a_id", "b_id", "vector_points")


def score_pairs(pairs: DataFrame) -> DataFrame:
    """pairs(source, a_..., b_..., vector_points) with same_family, same_parent and score, which is relative to side a."""
    c = F.col
    hours = F.abs(c("a_t") - c("b_t")) / 3_600_000_000
    soon = F.lit(0.0)
    for most, points in reversed(TIME):
        soon = F.when(hours <= most, points).otherwise(soon)
    base = F.lit(OTHER_BASE)
    for name, points in BASE.items():
        base = F.when(c("source") == name, points).otherwise(base)
    df = pairs.withColumns({"same_family": _known("a_family", "b_family"), "same_parent": _known("a_parent_path", "b_parent_path")})
    add = lambda test, points: F.when(test, points).otherwise(0.0)
    total = base + add(c("same_family"), FAMILY) + add(c("same_parent"), PARENT) + c("vector_points") + add(c("a_face") & c("b_face"), FACES)
    total = total + add(labels.equal_known(c("a_subject_count"), c("b_subject_count")), SUBJECTS) + add(labels.equal_known(c("a_capture_type"), c("b_capture_type")), CAPTURES) + F.coalesce(soon, F.lit(0.0))
    score = F.when(c("a_id") == c("b_id"), 1.0).otherwise(F.floor(F.least(total, F.lit(MOST)) * 100 + 0.5) / 100)
    return df.withColumn("score", score)


def _compatible(th: Thresholds) -> Column:
    w = [F.col(x) for x in ("a_width", "a_height", "b_width", "b_height")]
    return media.same_orientation(*w) & media.aspect_close(*w, th.aspect, by_side=True) & media.ratio_close(w[0].cast("double") * w[1], w[2].cast("double") * w[3], th.pixels)


def _conflict() -> Column:
    c = F.col
    out = labels.conflict(labels.subject_count(c("a_subject_count")), labels.subject_count(c("b_subject_count"))) | labels.conflict(labels.capture_type(c("a_capture_type")), labels.capture_type(c("b_capture_type")))
    return out | (c("a_face") & ~c("b_face") & F.coalesce(c("b_subject_count") != "", F.lit(False)))


def _stays(th: Thresholds, vectors: Column) -> Column:
    """Whether side b belongs to side a's cluster, given whether their vectors are near; reads no vector and, but for weak
    signals with near vectors alone, no time."""
    c = F.col
    fit = _compatible(th)
    long_as = fit & media.ratio_close(c("a_duration_ms"), c("b_duration_ms"), th.duration)
    family, parent = _known("a_family", "b_family"), _known("a_parent_path", "b_parent_path")
    close = family | parent | vectors
    soon = F.coalesce(F.abs(c("a_t") - c("b_t")) <= th.weak_days * 86_400_000_000, F.lit(False))
    weak = labels.has_sign(c("name"), labels.WEAK_SIGNS)
    strict = long_as & ~_conflict() & (family | (vectors & soon))
    return F.when(c("source") == "human", True).when(c("source") != "auto", (c("holders") <= th.narrow_over) | (long_as & close)).otherwise(F.when(weak, strict).otherwise(fit & close))


@dataclass(frozen=True)
class Factors:
    """Clusters of persons before any is spelled out: as many rows as files have tags, and pairs of classes.

    members(name, auto, source, file_id, t, holders, cls, look): each tag of each file, with its facts as the struct `cls`.
    pairs(name, auto, source, a_cls, b_cls, links): of tags whose holders are narrowed, which classes belong together by
    facts alone, and by how many pairs of files. Where all holders belong together there are no pairs.
    near(a_look, b_look, vector_points): looks with near vectors, of two files or of one.
    """

    members: DataFrame
    pairs: DataFrame
    near: DataFrame
    th: Thresholds


_CLASS = tuple(f for f in FACTS if f != "t")


def factorised(files: DataFrame, tags: DataFrame, th: Thresholds = Thresholds()) -> Factors:
    """The parts of all clusters of persons; pass settled features. All three are settled.

    Files of equal facts are one class, and classes meet where they have a family or a directory in common, which a
    narrowed cluster's files have unless their vectors are near. So pairs grow with the square of the classes of one
    family or directory, and not with that of a tag's holders.
    """
    rows = facts(files)
    held = tags.join(rows.select("file_id", "t", F.struct(*_CLASS).alias("cls"), "seen"), "file_id").withColumn("auto", F.col("source") == "auto")
    many = held.groupBy("name", "auto").agg(F.count("*").alias("holders"))
    members = settled(held.join(many, ["name", "auto"]))
    looked = files.join(members.where("seen").select("file_id").distinct(), "file_id", "left_semi")
    looks, near = near_looks(looked, th)
    narrowed = members.where((F.col("source") != "human") & ((F.col("source") == "auto") | (F.col("holders") > th.narrow_over)))
    a = narrowed.groupBy("name", "auto", "source", "holders", F.col("cls").alias("a_cls")).agg(F.count("*").alias("a_n"))
    b = members.groupBy("name", "auto", F.col("cls").alias("b_cls")).agg(F.count("*").alias("b_n"))
    keyed = lambda df, p: df.withColumn("by", F.explode(F.array(F.struct(F.lit("family").alias("k"), F.col(f"{p}_cls.family").alias("v")), F.struct(F.lit("parent").alias("k"), F.col(f"{p}_cls.parent_path").alias("v"))))).where("by.v <> ''")
    met = keyed(a, "a").join(keyed(b, "b"), ["name", "auto", "by"])
    # Classes that have both in common meet by the family.
    met = met.where((F.col("by.k") == "family") | ~_same("family")).select("*", *(F.col(f"{p}_cls.{f}").alias(f"{p}_{f}") for p in "ab" for f in _CLASS), *(F.lit(None).cast("long").alias(f"{p}_t") for p in "ab"))
    pairs = met.where(_stays(th, F.lit(False))).select("name", "auto", "source", "a_cls", "b_cls", (F.col("a_n") * F.col("b_n")).alias("links"))
    return Factors(settled(members.drop("seen").join(looks, "file_id", "left")), settled(pairs), near, th)


def _same(fact: str) -> Column:
    return F.coalesce((F.col(f"a_cls.{fact}") != "") & (F.col(f"a_cls.{fact}") == F.col(f"b_cls.{fact}")), F.lit(False))


def _pairs_of(f: Factors, anchors: DataFrame) -> DataFrame:
    """(name, auto, source, holders, a_..., b_..., vector_points) of anchors(file_id, name) and the files of their clusters,
    themselves included, once each."""
    c, on = F.col, ["name", "auto"]
    a = f.members.join(anchors.select("file_id", "name").distinct(), ["file_id", "name"], "left_semi")
    a = a.select(c("file_id").alias("a_id"), "name", "auto", "source", "holders", c("t").alias("a_t"), c("cls").alias("a_cls"), c("look").alias("a_look"))
    b = f.members.select(c("file_id").alias("b_id"), *on, c("t").alias("b_t"), c("cls").alias("b_cls"), c("look").alias("b_look"))
    narrowed = (c("source") != "human") & ((c("source") == "auto") | (c("holders") > f.th.narrow_over))
    whole = a.where(~narrowed).join(b, on)
    few = a.where(narrowed)
    by_facts = few.join(f.pairs.select(*on, "source", "a_cls", "b_cls"), [*on, "source", "a_cls"]).join(b, [*on, "b_cls"])
    itself = few.select("*", c("a_id").alias("b_id"), c("a_t").alias("b_t"), c("a_cls").alias("b_cls"), c("a_look").alias("b_look"))
    by_looks = few.join(f.near.select("a_look", "b_look"), "a_look").join(b, ["b_look", *on]).where("a_id <> b_id")
    found = whole
    for part in (by_facts.where("a_id <> b_id"), itself, by_looks):
        found = found.unionByName(part.select(*whole.columns))
    found = found.select("*", *(c(f"{p}_cls.{x}").alias(f"{p}_{x}") for p in "ab" for x in _CLASS)).drop("a_cls", "b_cls").distinct()
    found = found.join(f.near, ["a_look", "b_look"], "left").fillna(0.0, ["vector_points"])
    return found.where((c("a_id") == c("b_id")) | _stays(f.th, c("vector_points") > 0))


def expand(f: Factors, anchors: DataFrame | None = None) -> DataFrame:
    """(anchor_id, name, source, file_id, rank, role, score) of the anchors(file_id, name) asked for, or of all: each one's
    cluster, if it has another member. An anchor's cluster is as large as its tag, so all of them are as many rows as the
    square of that: ask for those that are shown or stored."""
    c = F.col
    df = score_pairs(_pairs_of(f, f.members if anchors is None else anchors))
    group = W.partitionBy("a_id", "name", "source")
    order = group.orderBy((c("a_id") != c("b_id")).cast("int"), F.desc("score"), "b_id")
    df = df.withColumns({"rank": F.row_number().over(order), "n": F.count("*").over(group)}).where("n > 1")
    return df.select(c("a_id").alias("anchor_id"), "name", "source", c("b_id").alias("file_id"), "rank", F.when(c("rank") == 1, "cover").otherwise("member").alias("role"), "score")


def sizes(f: Factors) -> DataFrame:
    """(anchor_id, name, source, n): how many files each anchor's cluster has, itself included, where it has another one; by
    counts of classes, so no cluster is spelled out. Near vectors add the files that facts alone don't."""
    c, on = F.col, ["name", "auto"]
    linked = f.pairs.join(f.members.groupBy(*on, "source", c("cls").alias("a_cls")).agg(F.count("*").alias("a_n")), [*on, "source", "a_cls"])
    linked = linked.groupBy(*on, "source", "a_cls").agg(F.sum(c("links") / c("a_n")).cast("long").alias("by_facts"), F.max(c("a_cls") == c("b_cls")).alias("own"))
    a = f.members.withColumnRenamed("cls", "a_cls").join(linked, [*on, "source", "a_cls"], "left")
    narrowed = (c("source") != "human") & ((c("source") == "auto") | (c("holders") > f.th.narrow_over))
    few = a.where(narrowed).select(c("file_id").alias("a_id"), *on, "source", "holders", c("t").alias("a_t"), "a_cls", c("look").alias("a_look"))
    b = f.members.select(c("file_id").alias("b_id"), *on, c("t").alias("b_t"), c("cls").alias("b_cls"), c("look").alias("b_look"))
    looks = few.join(f.near.select("a_look", "b_look"), "a_look").join(b, ["b_look", *on]).where("a_id <> b_id").join(f.pairs.select(*on, "source", "a_cls", "b_cls"), [*on, "source", "a_cls", "b_cls"], "left_anti")
    looks = looks.select("*", *(c(f"{p}_cls.{x}").alias(f"{p}_{x}") for p in "ab" for x in _CLASS)).where(_stays(f.th, F.lit(True)))
    looks = looks.groupBy(c("a_id").alias("file_id"), *on, "source").agg(F.count("*").alias("by_looks"))
    a = a.join(looks, ["file_id", *on, "source"], "left").fillna(0, ["by_facts", "by_looks"]).fillna(False, ["own"])
    # A class that belongs together by facts has counted the anchor itself.
    n = F.when(narrowed, c("by_facts") + c("by_looks") + F.when(c("own"), 0).otherwise(1)).otherwise(c("holders"))
    return a.select(c("file_id").alias("anchor_id"), "name", "source", n.alias("n")).where("n > 1")


def cluster_titles(f: Factors) -> DataFrame:
    """(file_id, name, source, title): the cluster that each tag of each file is stored under: one for a person that people
    named, and else one for each family of file names, or directory where a name has none."""
    c = F.col
    of = F.when(c("cls.family") != "", c("cls.family")).otherwise(F.substring(F.sha1(F.coalesce("cls.parent_path", F.lit("")).cast("binary")), 1, 8))
    kind = F.when(c("source") == "auto", "person_auto:").otherwise("person_ai:")
    title = F.when(c("source") == "human", F.concat(F.lit("person:"), "name")).otherwise(F.concat(kind, c("name"), F.lit(":"), of))
    return f.members.select("file_id", "name", "source", title.alias("title"))


def stored(f: Factors) -> DataFrame:
    """(title, file_id, rank, role, score): clusters as they are stored. A title keeps the members that its last anchor found,
    the one of the greatest id, and goes where that one finds no other; so only one anchor of a title is spelled out."""
    last = cluster_titles(f).groupBy("title", "name", "source").agg(F.max("file_id").alias("file_id"))
    last = last.groupBy("title").agg(F.max_by(F.struct("file_id", "name", "source"), F.struct("file_id", "name")).alias("x")).select("title", "x.*")
    found = expand(f, last)
    return found.join(last.withColumnRenamed("file_id", "anchor_id"), ["anchor_id", "name", "source"]).select("title", "file_id", "rank", "role", "score")


def same_person(files: DataFrame, tags: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    """(anchor_id, name, source, file_id, rank, role, score) for each tag of each active file with another member.

    People's tags take all files with the tag. Tags by models or rules are narrowed if over `narrow_over` files
    have them; signals always are, weak ones more. This spells out every anchor's cluster; see factorised, sizes and stored
    for what doesn't grow so.
    """
    return expand(factorised(files, tags, th))
