"""Which frames stand for a video: as many as its duration allows, most at even places, the rest where the picture changes most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.lineage import settled
from ..sources.catalog import Tables

#: Durations in ms up to which a video has so many frames, and the number of longer ones.
TIERS = ((30_000, 4), (300_000, 6), (1_200_000, 10), (3_600_000, 16))
LONGEST = 24
#: Tenths of the frames that lie at even places, and ms left out at either end (of a short video a tenth).
EVEN_TENTHS, MARGIN_MS = 7, 3000
#: Candidates are looked at by pieces of this many ms, and a video's pieces are dealt to so many tasks.
PIECE_MS, DEAL = 60_000, 16


def budget(duration_ms: Column) -> Column:
    """How many frames a video of this duration has."""
    out = F.lit(LONGEST)
    for most, n in reversed(TIERS):
        out = F.when(duration_ms <= most, n).otherwise(out)
    return out


def even_places(n: Column) -> Column:
    """How many of n frames lie at even places."""
    return F.floor((n * EVEN_TENTHS + 5) / 10)


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def keyframes(t: Tables, candidates: DataFrame | None = None) -> DataFrame:
    """(file_id, id, timestamp_ms, how, place) of each video's keyframes; place counts from 1 in the order they were chosen.

    Candidates (file_id, id, timestamp_ms, phash) are those of `video_frames` if none are given. The time between a video's
    margins is cut into as many slots as it has even places, and each slot gives the frame nearest to its middle (`even`);
    of those with one hash the earliest stays. What is left of the budget, places of empty slots included, goes to the frame
    whose least Hamming distance to all frames chosen so far is greatest, one after the other (`change`), until none differs.
    Ties go to the earlier frame, then to the smaller id.

    Left out are frames with a null, without 16 hexadecimal digits, of files without a row in `video_assets`, within the
    margins, and flat ones (hash zero, as of black or white pictures). Of equal frames at one time the smallest id stays, so
    repeated rows count once. A duration that is null or not positive is taken to be the last candidate's time. A video with
    no candidates left has no rows. Other columns aren't looked at.

    A round sees all candidates once, by pieces of a minute that are dealt to several tasks, so a video with a large share
    of all frames isn't one group, and hands on one frame for each piece; rounds are as many as a budget at most. Only what
    is chosen, 24 frames a video at most, goes from round to round.
    """
    rows = (candidates if candidates is not None else t["video_frames"]).where(F.col("phash").rlike("^[0-9a-fA-F]{16}$") & F.expr("id IS NOT NULL AND timestamp_ms >= 0"))
    rows = rows.select("file_id", F.col("timestamp_ms").cast("long").alias("ms"), "id", F.conv("phash", 16, -10).cast("long").alias("h"))
    rows = rows.groupBy("file_id", "ms", "h").agg(F.min("id").alias("id"))
    last = rows.groupBy("file_id").agg(F.max("ms").alias("last"))
    length = F.when(F.col("duration_ms") > 0, F.col("duration_ms")).otherwise(F.col("last"))
    videos = t["video_assets"].groupBy("file_id").agg(F.max("duration_ms").alias("duration_ms")).join(last, "file_id")
    videos = videos.select("file_id", length.alias("length"), F.least(F.lit(MARGIN_MS), F.floor(length / 10)).cast("long").alias("first"), budget(length).alias("budget"))
    videos = videos.withColumns({"span": F.col("length") - 2 * F.col("first"), "n": even_places(F.col("budget"))})
    rows = rows.join(videos, "file_id").where("h <> 0 AND ms BETWEEN first AND first + span")
    # The end of the last slot belongs to it; a video without a length has one slot.
    slot = F.least(F.floor(F.expr("((ms - first) * n) div greatest(span, 1)")), F.col("n") - 1)
    rows = rows.select("file_id", "budget", "ms", "id", "h", slot.alias("slot"), F.abs(2 * F.col("n") * (F.col("ms") - F.col("first")) - (2 * slot + 1) * F.col("span")).alias("off"))

    even = rows.groupBy("file_id", "budget", "slot").agg(F.min(F.struct("off", "ms", "id", "h")).alias("f")).select("file_id", "budget", "f.*")
    # At most one row for each slot of a video.
    even = even.withColumn("again", F.row_number().over(W.partitionBy("file_id", "h").orderBy("ms", "id"))).where("again = 1")
    frame = F.struct("ms", "id", "h", F.lit("even").alias("how"))
    chosen = even.groupBy("file_id", "budget").agg(F.array_sort(F.collect_list(frame)).alias("frames"))
    chosen = settled(chosen.select("file_id", "frames", (F.col("budget") - F.size("frames")).alias("left")))

    pieces = rows.groupBy("file_id", F.expr(f"ms div {PIECE_MS}").alias("piece")).agg(F.collect_list(F.struct("ms", "id", "h")).alias("seen"))
    pieces = settled(pieces.select("file_id", F.pmod("piece", F.lit(DEAL)).cast("int").alias("deal"), "seen"))
    deals = F.explode(F.array(*map(F.lit, range(DEAL)))).alias("deal")
    while not (open_ := chosen.where("left > 0")).isEmpty():
        met = pieces.join(open_.select("file_id", F.col("frames.h").alias("taken"), deals), ["file_id", "deal"])
        least = lambda c: F.array_min(F.transform("taken", lambda x: _distance(x, c["h"])))
        far = F.transform("seen", lambda c: F.struct(least(c).alias("far"), (-c["ms"]).alias("ms"), (-c["id"]).alias("id"), c["h"].alias("h")))
        best = met.groupBy("file_id").agg(F.max(F.array_max(far)).alias("best")).where("best.far > 0")
        more = F.array(F.struct((-F.col("best.ms")).alias("ms"), (-F.col("best.id")).alias("id"), F.col("best.h").alias("h"), F.lit("change").alias("how")))
        found = F.col("best").isNotNull()
        chosen = settled(chosen.join(best, "file_id", "left").select("file_id", F.when(found, F.concat("frames", more)).otherwise(F.col("frames")).alias("frames"), F.when(found, F.col("left") - 1).otherwise(0).alias("left")))
    out = chosen.select("file_id", F.posexplode("frames").alias("at", "f"))
    return out.select("file_id", "f.id", F.col("f.ms").alias("timestamp_ms"), "f.how", (F.col("at") + 1).alias("place"))
