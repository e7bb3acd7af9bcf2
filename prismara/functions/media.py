"""Scalar rules on technical features of images and videos, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Steps of the quality score, highest first.
PIXEL_STEPS = ((3840 * 2160, 60), (1920 * 1080, 45), (1280 * 720, 32), (854 * 480, 18))
BITRATE_STEPS = ((8_000_000, 20), (4_000_000, 12), (1_500_000, 6))
FPS_STEPS = ((50, 8), (29.97, 5), (23.976, 3))
DURATION_STEPS = ((600_000, 6), (120_000, 4), (30_000, 2))
CODEC_POINTS = {"hevc": 4, "h265": 4, "av1": 4, "h264": 2}
CONTAINER_POINTS = {"mkv": 2, "mp4": 1, "mov": 1}
CONTAINER_RANK = {"mkv": 6, "mp4": 4, "mov": 3}
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "webp", "gif", "bmp", "heic")
VIDEO_EXTENSIONS = ("mp4", "mov", "mkv", "avi", "wmv", "m4v", "webm")


def steps(value: Column, table: tuple[tuple[float, float], ...], below: float) -> Column:
    """The points of the first step that value reaches, `below` under all, null for null."""
    out = F.lit(below)
    for least, points in reversed(table):
        out = F.when(value >= least, points).otherwise(out)
    return F.when(value.isNotNull(), out)


def points(value: Column, table: dict[str, int]) -> Column:
    out = F.lit(0)
    for name, p in table.items():
        out = F.when(value == name, p).otherwise(out)
    return out


def media_type(extension: Column) -> Column:
    """`image` or `video` by extension with or without its dot; null for others."""
    name = F.lower(F.ltrim(extension, F.lit(".")))
    return F.when(name.isin(*IMAGE_EXTENSIONS), "image").when(name.isin(*VIDEO_EXTENSIONS), "video")


def quality_score(media: Column, width: Column, height: Column, bitrate: Column, fps: Column, duration_ms: Column, codec: Column, container: Column) -> Column:
    """20 to 100; what is null earns nothing."""
    pixels = steps(width.cast("long") * height, PIXEL_STEPS, 8)
    moving = F.coalesce(steps(bitrate, BITRATE_STEPS, 2), F.lit(0)) + F.coalesce(steps(fps, FPS_STEPS, 1), F.lit(0))
    moving = moving + F.coalesce(steps(duration_ms, DURATION_STEPS, 0), F.lit(0)) + points(codec, CODEC_POINTS) + points(container, CONTAINER_POINTS)
    score = F.lit(20) + F.coalesce(pixels, F.lit(0)) + F.when(media == "video", moving).otherwise(0)
    return F.least(score, F.lit(100)).cast("double")


def quality_tier(score: Column) -> Column:
    return F.when(score >= 75, "high").when(score >= 45, "medium").otherwise("low")


def _fixed(x: Column, places: int) -> Column:
    return F.when(x.isNotNull(), F.format_string(f"%.{places}f", x))


def bitrate_text(rate: Column) -> Column:
    mega = F.concat(_fixed(rate / 1e6, 1), F.lit(" Mbps"))
    return F.when(rate >= 1_000_000, mega).when(rate >= 1000, F.concat(F.floor(rate / 1000).cast("string"), F.lit(" Kbps"))).otherwise(F.concat(rate.cast("string"), F.lit(" bps")))


def quality_summary(media: Column, tier: Column, width: Column, height: Column, fmt: Column, container: Column, codec: Column, bitrate: Column, fps: Column) -> Column:
    """`<media> quality <tier>, <W>x<H> • <label>[ • bitrate][ • fps].`"""
    fmt, container, codec = (F.coalesce(x, F.lit("")) for x in (fmt, container, codec))
    video = media == "video"
    label = F.when(video & (codec != ""), F.trim(F.concat(container, F.lit(" "), codec))).when(video & (container != ""), container).otherwise(fmt)
    label = F.when(label == "", media).otherwise(label)
    size = F.coalesce(F.concat(width.cast("string"), F.lit("x"), height.cast("string")), F.lit("unknown"))
    parts = F.concat_ws(" • ", size, label, F.when(video, bitrate_text(bitrate)), F.when(video, F.concat(_fixed(fps.cast("double"), 2), F.lit(" fps"))))
    return F.concat(media, F.lit(" quality "), tier, F.lit(", "), parts, F.lit("."))


def search_document(name: Column, path: Column, extension: Column, media: Column, status: Column, fmt: Column, container: Column, video_codec: Column, audio_codec: Column, orientation_: Column, width: Column, height: Column, duration_ms: Column) -> Column:
    """All fields that aren't blank, trimmed, by one space."""
    clean = [F.nullif(F.trim(x), F.lit("")) for x in (name, path, extension, media, status, fmt, container, video_codec, audio_codec, orientation_)]
    size = F.concat(width.cast("string"), F.lit("x"), height.cast("string"))
    length = F.concat(F.floor(duration_ms / 1000).cast("string"), F.lit("s"))
    return F.concat_ws(" ", *clean, size, length)


def orientation(width: Column, height: Column) -> Column:
    """'' if a side is unknown, else landscape, portrait or square."""
    known = (width > 0) & (height > 0)
    return F.when(~F.coalesce(known, F.lit(False)), "").when(width > height, "landscape").when(width < height, "portrait").otherwise("square")


def _both(a: Column, b: Column) -> Column:
    return F.coalesce((a > 0) & (b > 0), F.lit(False))


def same_orientation(w1: Column, h1: Column, w2: Column, h2: Column) -> Column:
    a, b = orientation(w1, h1), orientation(w2, h2)
    return (a == "") | (b == "") | (a == b)


def aspect_close(w1: Column, h1: Column, w2: Column, h2: Column, most: float = 0.20, by_side: bool = False) -> Column:
    """Aspect ratios at most `most` apart; unknown sides are compatible. by_side: short over long side, else width over height."""
    ratio = (lambda w, h: F.least(w, h) / F.greatest(w, h)) if by_side else (lambda w, h: w / h)
    return F.when(_both(w1, h1) & _both(w2, h2), F.abs(ratio(w1, h1) - ratio(w2, h2)) <= most).otherwise(True)


def ratio_close(a: Column, b: Column, least: float) -> Column:
    """The smaller at least `least` of the larger; unknown values are compatible."""
    return F.when(_both(a, b), F.least(a, b) / F.greatest(a, b) >= least).otherwise(True)


def _stem(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"\.[^./]*$", ""))


def series_family(name: Column) -> Column:
    """The stem with separators as hyphens and without one number at its end."""
    hyphens = F.regexp_replace(_stem(F.trim(name)), "[_ .]", "-")
    return F.btrim(F.regexp_replace(hyphens, r"-\d+$", ""), F.lit("-"))


def person_family(name: Column) -> Column:
    """The stem without separators at its ends and without all digits at its end."""
    ends = F.lit("-_. ")
    return F.btrim(F.regexp_replace(F.btrim(_stem(F.trim(name)), ends), r"\d+$", ""), ends)


def frame_offsets(duration_ms: Column) -> Column:
    """Where frames are taken: a tenth, half and nine tenths of the duration; 1, 5 and 10 s if it is unknown."""
    d = duration_ms.cast("long")
    known = F.array(F.floor(d / 10), F.floor(d / 2), F.floor(d * 9 / 10))
    return F.when(d > 0, known).otherwise(F.array(*(F.lit(x).cast("long") for x in (1000, 5000, 10_000))))


def frame_rate(text: Column) -> Column:
    """A rate like 30000/1001 or 25; null for a zero denominator or no number."""
    parts = F.split(text, "/")
    over = F.when(F.size(parts) > 1, F.expr("try_cast(0 as double)") + F.get(parts, F.lit(1)).try_cast("double")).otherwise(1.0)
    return F.try_divide(F.get(parts, F.lit(0)).try_cast("double"), over)


PROBE = "struct<format: struct<format_name: string, duration: string, bit_rate: string>, streams: array<struct<codec_type: string, codec_name: string, width: int, height: int, avg_frame_rate: string>>>"


def video_probe(json: Column) -> Column:
    """A media probe's JSON as duration_ms, width, height, fps, container, video_codec, audio_codec and bitrate."""
    p = F.from_json(json, PROBE)
    of = lambda kind: F.get(F.filter(p["streams"], lambda s: s["codec_type"] == kind), F.lit(0))
    video, audio = of("video"), of("audio")
    return F.struct(
        F.round(p["format"]["duration"].try_cast("double") * 1000).cast("long").alias("duration_ms"),
        video["width"].alias("width"), video["height"].alias("height"),
        frame_rate(video["avg_frame_rate"]).alias("fps"),
        F.lower(F.get(F.split(p["format"]["format_name"], ","), F.lit(0))).alias("container"),
        video["codec_name"].alias("video_codec"), audio["codec_name"].alias("audio_codec"),
        p["format"]["bit_rate"].try_cast("long").alias("bitrate"),
    )
