"""Normalisation of tags and structured attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of attribute values.
SUBJECT_COUNTS = {"single": ("single", "单人", "1", "one"), "multiple": ("multiple", "multi", "多人", "couple", "情侣", "2", "two")}
CAPTURE_TYPES = {"selfie": ("selfie", "自拍"), "screen": ("screenshot", "截图", "screen_recording", "屏幕录制"), "photo": ("photo", "实拍", "live_action")}
TRUE_IN_QUERIES = ("true", "1", "yes")
TRUE_IN_PAYLOADS = ("true", "1", "yes", "on")

# What a file's content tags must hold to count as a sign of a person, and those that are weak signs.
PERSON_SIGNS = ("单人", "多人", "情侣", "写真", "自拍", "portrait", "selfie", "做爱", "口交", "av")
WEAK_SIGNS = ("多人", "情侣", "av", "做爱", "口交")

# What attributes imply as (spellings, namespace, name, confidence), in order.
SUBJECT_TAGS = ((("1", "single", "one"), "content", "单人", 0.65), (("2", "two", "couple"), "content", "双人", 0.65), (("multiple", "many", "group"), "content", "多人", 0.65))
CAPTURE_TAGS = ((("closeup", "close_up", "close-up"), "content", "局部特写", 0.6), (("selfie",), "content", "自拍", 0.7))
FACE_TAG = ("person", "露脸", 0.6)
DEFAULT_SPACE, TAG_CONFIDENCE = "content", 0.6

# Words that a content tag or an attribute holds anywhere where it calls for person vectors.
CONTENT_WORDS = ("单人", "多人", "情侣", "写真", "自拍", "portrait", "selfie")
SUBJECT_WORDS = ("single", "单人", "multiple", "多人", "couple", "情侣")
CAPTURE_WORDS = ("selfie", "自拍", "photo", "实拍")

# The answer of the placeholder, by media type.
PLACEHOLDER = {"video": ("视频", "视频文件"), "image": ("图片", "图片文件")}
PLACEHOLDER_TAG, PLACEHOLDER_SPACE, UNNAMED, PLACEHOLDER_REST, PLACEHOLDER_CONFIDENCE = "待AI精标", "management", "未命名文件", "当前为占位理解结果。", 0.55

# Names that raw tags are filed under; an empty one drops the tag.
TAG_NAMES = {
    "jk": "JK制服", "glasses": "眼镜", "straps": "束缚", "bondage": "束缚", "darkmode": "低光高对比",
    "dark mode": "低光高对比", "closeup": "局部特写", "close-up": "局部特写", "close_up": "局部特写",
    "blowjob": "口交", "oral": "口交", "oral sex": "口交", "cunnilingus": "舔阴", "vaginal": "阴道性交",
    "vaginal sex": "阴道性交", "anal": "肛交", "anal sex": "肛交", "masturbation": "自慰", "handjob": "手淫",
    "cumshot": "射精镜头", "facial": "颜射", "pussy": "外阴暴露", "vulva": "外阴暴露", "breasts": "乳房暴露",
    "boobs": "乳房暴露", "lingerie": "内衣", "uniform": "制服", "video": "", "image": "",
}
TAG_SPACES = {
    "sensitive": ("口交", "舔阴", "阴道性交", "肛交", "自慰", "手淫", "乳房暴露", "外阴暴露", "颜射", "射精镜头", "束缚"),
    "quality": ("低光高对比", "低照度", "模糊", "清晰"),
    "person": ("眼镜", "露脸"),
}


def _spelled(value: Column, table: dict[str, tuple[str, ...]]) -> Column:
    clean = F.lower(F.trim(value))
    out = clean
    for name, spellings in table.items():
        out = F.when(clean.isin(*spellings), name).otherwise(out)
    return out


def subject_count(value: Column) -> Column:
    return _spelled(value, SUBJECT_COUNTS)


def capture_type(value: Column) -> Column:
    return _spelled(value, CAPTURE_TYPES)


def conflict(a: Column, b: Column) -> Column:
    """Both known and different."""
    return F.coalesce((a != "") & (b != "") & (a != b), F.lit(False))


def equal_known(a: Column, b: Column) -> Column:
    a, b = F.lower(F.trim(a)), F.lower(F.trim(b))
    return F.coalesce((a != "") & (a == b), F.lit(False))


def truthy(value: Column, words: tuple[str, ...] = TRUE_IN_QUERIES) -> Column:
    return F.lower(F.coalesce(F.trim(value), F.lit(""))).isin(*words)


def holds_any(value: Column, words: tuple[str, ...] = TRUE_IN_QUERIES) -> Column:
    """Whether a text holds one of the words anywhere; only A-Z are alike in either case."""
    plain = F.translate(F.coalesce(value, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = F.lit(False)
    for word in words:
        out = out | plain.contains(word)
    return out


def placeholder_understanding(media_type: Column, file_path: Column) -> Column:
    """What is said of a file that no model has seen: raw_tags, candidates, summary, quality_hints, attributes, confidence."""
    kind = F.lower(F.trim(F.coalesce(media_type, F.lit(""))))
    name = F.nullif(F.element_at(F.split(F.trim(F.coalesce(file_path, F.lit(""))), "/"), -1), F.lit(""))
    tag, about = (F.when(kind == "video", PLACEHOLDER["video"][i]).otherwise(PLACEHOLDER["image"][i]) for i in (0, 1))
    item = lambda space, name, sure: F.struct(F.lit(space).alias("namespace"), name.alias("name"), F.lit(sure).alias("confidence"))
    return F.struct(
        F.array(tag, F.lit(PLACEHOLDER_TAG)).alias("raw_tags"),
        F.array(item("content", tag, 0.70), item(PLACEHOLDER_SPACE, F.lit(PLACEHOLDER_TAG), 0.60)).alias("candidates"),
        F.concat(F.coalesce(name, F.lit(UNNAMED)), F.lit("，"), about, F.lit("，"), F.lit(PLACEHOLDER_REST)).alias("summary"),
        F.array(F.lit("placeholder")).alias("quality_hints"),
        F.create_map(F.lit("media_type"), F.when(kind == "", "unknown").otherwise(kind), F.lit("is_sensitive"), F.lit("false")).alias("attributes"),
        F.lit(PLACEHOLDER_CONFIDENCE).alias("confidence"),
    )


def has_sign(name: Column, signs: tuple[str, ...]) -> Column:
    return F.coalesce(F.lower(name).rlike("|".join(signs)), F.lit(False))


def looks_like_path(tag: Column) -> Column:
    return tag.contains("/") | tag.contains("\\")


def tag_name(tag: Column, names: dict[str, str] | None = None) -> Column:
    """The name a raw tag is filed under, or null for one that is dropped."""
    names = TAG_NAMES if names is None else names
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    clean = F.trim(tag)
    mapped = F.coalesce(F.get(F.filter(F.array(F.element_at(table, F.lower(clean))), lambda x: x.isNotNull()), F.lit(0)), F.when(~looks_like_path(clean), clean))
    return F.nullif(mapped, F.lit(""))


def tag_space(name: Column, spaces: dict[str, tuple[str, ...]] | None = None) -> Column:
    out = F.lit(DEFAULT_SPACE)
    for space, members in reversed((TAG_SPACES if spaces is None else spaces).items()):
        out = F.when(name.isin(*members), space).otherwise(out)
    return out


def candidates(raw: Column, subject: Column, capture: Column, has_face: Column, most: int = 5) -> Column:
    """array<struct<namespace, name, confidence>>: what attributes imply, then the raw tags; the first of equal ones, `most` at most."""
    item = lambda space, name, sure: F.struct(space.alias("namespace"), name.alias("name"), F.lit(sure).alias("confidence"))
    lit = lambda space, name, sure: item(F.lit(space), F.lit(name), sure)
    implied = lambda value, table: F.coalesce(*(F.when(F.lower(F.trim(value)).isin(*words), lit(*tag)) for words, *tag in table))
    first = F.array(implied(subject, SUBJECT_TAGS), implied(capture, CAPTURE_TAGS), F.when(truthy(has_face, TRUE_IN_PAYLOADS), lit(*FACE_TAG)))
    names = F.filter(F.transform(raw, lambda t: F.when(~looks_like_path(F.trim(t)), tag_name(t))), lambda n: n.isNotNull())
    rest = F.transform(names, lambda n: item(tag_space(n), n, TAG_CONFIDENCE))
    every = F.filter(F.concat(first, rest), lambda c: c.isNotNull())
    key = lambda c: F.concat(c["namespace"], F.lit(":"), c["name"])
    # An array of one element binds what would be computed anew for each use.
    bound = lambda value, of: F.get(F.transform(F.array(value), of), F.lit(0))
    first_of = lambda e, keys: F.transform(F.slice(F.array_distinct(keys), 1, most), lambda k: F.get(e, (F.array_position(keys, k) - 1).cast("int")))
    return bound(every, lambda e: bound(F.transform(e, key), lambda keys: first_of(e, keys)))


def clamp(value: Column, fallback: float) -> Column:
    """A confidence within 0 and 1; fallback if it is no number."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value.try_cast("double"), F.lit(fallback))))


def json_object(text: Column) -> Column:
    """From the first brace to the last of a noisy answer, if that is JSON; else null."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(found).isNotNull() & (found != ""), found)
