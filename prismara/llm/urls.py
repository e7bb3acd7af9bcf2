"""URL filters by dated lists: entries become validity intervals, and each capture meets those active at its time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import shared_table


def host(url: Column) -> Column:
    """The host of an absolute URL in lower case, without user, port and last dot, an IPv6 address in its brackets; null if there is none."""
    found = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:\[\]]+)", 1)
    return F.nullif(F.rtrim(F.lower(found), F.lit(".")), F.lit(""))


def path(url: Column) -> Column:
    """The path of an absolute URL, at least "/"."""
    found = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)", 1)
    return F.when(found == "", "/").otherwise(found)


def keys(url: Column, most: Column) -> Column:
    """What a list entry may name of a URL, in lower case: its host, every parent domain of two labels or more, and
    host + path up to each of its first `most` steps, where `most` is the depth of the list's deepest entry. Bounded
    by the URL, so matching is an equality join."""
    name, labels = host(url), F.split(host(url), r"\.")
    many = F.size(labels)
    domains = F.transform(F.sequence(F.lit(0), F.greatest(many - 2, F.lit(0))), lambda i: F.array_join(F.slice(labels, i + 1, many), "."))
    steps = F.filter(F.split(F.lower(path(url)), "/"), lambda x: x != "")
    deep = F.least(F.size(steps), most)
    paths = F.when(deep > 0, F.transform(F.sequence(F.lit(1), deep), lambda i: F.concat(name, F.lit("/"), F.array_join(F.slice(steps, 1, i), "/"))))
    return F.when(name.isNotNull(), F.array_distinct(F.concat(domains, F.coalesce(paths, F.array().cast("array<string>")))))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, pattern, action, since, until) for dated entries (list, pattern, action, at).

    An entry holds from its date until the next dated entry of the same list and pattern, without end if there
    is none (null). The action `remove` ends what was there and has no interval of its own. Of entries with the
    same list, pattern and date the one with the greatest action counts. Entries with a null pattern or date
    are of no effect. Patterns are compared in lower case, without slashes at their end.
    """
    rows = entries.select("list", F.rtrim(F.lower(F.trim("pattern")), F.lit("/")).alias("pattern"), "action", F.col("at").cast("timestamp").alias("at")).where("pattern IS NOT NULL AND at IS NOT NULL")
    rows = rows.groupBy("list", "pattern", "at").agg(F.max("action").alias("action"))
    until = F.lead("at").over(W.partitionBy("list", "pattern").orderBy("at"))
    return rows.select("list", "pattern", "action", F.col("at").alias("since"), until.alias("until")).where("action <> 'remove'")


#: Captures of one pattern that are sorted together at least; more only where the pattern has more intervals than that.
ROWS = 4096


def as_of(spread: DataFrame, held: DataFrame, most: int = ROWS) -> DataFrame:
    """The rows of spread (capture_id, url, at, pattern) with (list, action) of each list's interval in held that is active.

    For each list and pattern, intervals and captures are put in one order of time, and a capture takes the last interval
    that began no later: no capture meets the intervals that it isn't in, however often a pattern is switched. A pattern
    with many captures is dealt to several orders, each with a copy of its intervals; as an order has at least as many
    captures as there are intervals, the copies are no more than captures and intervals together. Captures whose pattern
    no list has are left out before anything is sorted.
    """
    seen = spread.groupBy("pattern").agg(F.count("*").alias("_n"))
    lists = held.groupBy("list", "pattern").agg(F.count("*").alias("_m"))
    parts = F.ceil(F.col("_n") / F.greatest(F.lit(most), F.col("_m"))).cast("int")
    lists = lists.join(seen, "pattern").select("list", "pattern", parts.alias("_parts"))
    part = F.pmod(F.xxhash64("capture_id", "url", "at"), F.col("_parts")).cast("int").alias("_part")
    captures = spread.join(lists, "pattern").select("list", "pattern", part, "at", F.struct("capture_id", "url").alias("_capture"), F.lit(None).cast("struct<action:string,until:timestamp>").alias("_held"))
    begun = held.join(lists, ["list", "pattern"]).select("list", "pattern", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), F.col("since").alias("at"), F.lit(None).cast(captures.schema["_capture"].dataType).alias("_capture"), F.struct("action", "until").alias("_held"))
    # At the same time the interval comes first: it is active from its start.
    time = W.partitionBy("list", "pattern", "_part").orderBy("at", F.col("_held").isNull())
    last = F.last("_held", ignorenulls=True).over(time.rowsBetween(W.unboundedPreceding, W.currentRow))
    met = begun.unionByName(captures).withColumn("_last", last).where("_capture IS NOT NULL AND _last IS NOT NULL AND (_last.until IS NULL OR at < _last.until)")
    return met.select("_capture.capture_id", "_capture.url", "at", "list", "pattern", "_last.action")


def judge(captures: DataFrame, entries: DataFrame, capture_id: str = "page_id", url: str = "url", at: str = "at") -> DataFrame:
    """(capture_id, host, verdict, list, pattern) for every capture.

    verdict: `block` or `allow` by the active entry that names most of the URL (the longest pattern; of equal
    ones `allow` before `block`, then the list first by name), or `none`. An interval is active from its start
    until just before its end. Captures with a null or unreadable URL or a null time match nothing. Repeated
    captures are judged each; a very long URL has as many keys as the list is deep. Extra columns aren't looked at; an
    empty list judges all `none`, and without captures there are no rows.

    Each capture is spread over the few keys that an entry could name, meets each key's intervals in order of time
    (`as_of`), and what matches is brought together by capture again; the matches of one capture are few. Timestamps
    of captures and entries are compared as `timestamp`.
    """
    rows = captures.select(F.col(capture_id).alias("capture_id"), F.col(url).alias("url"), F.col(at).cast("timestamp").alias("at"))
    rows = rows.groupBy("capture_id", "url", "at").agg(F.count("*").alias("times"))
    # Intervals are read for their depth, their sizes and themselves: a table of the list's size in the shared folder.
    held = shared_table(intervals(entries), "intervals")
    # No path is cut off before the deepest interval of the list, whose depth is one row.
    deepest = held.agg(F.coalesce(F.max(F.length("pattern") - F.length(F.replace("pattern", F.lit("/"), F.lit("")))), F.lit(0)).alias("deepest"))
    most = F.lit(deepest.first()["deepest"])
    spread = rows.select("capture_id", "url", "at", F.explode(keys(F.col("url"), most)).alias("pattern"))
    met = as_of(spread.where("at IS NOT NULL"), held)
    order = F.struct((-F.length("pattern")).alias("size"), (F.col("action") != "allow").alias("last"), "list", "action", "pattern")
    best = met.groupBy(F.col("capture_id").alias("c"), F.col("url").alias("u"), F.col("at").alias("t")).agg(F.min(order).alias("b"))
    same = F.col("capture_id").eqNullSafe(F.col("c")) & F.col("url").eqNullSafe(F.col("u")) & F.col("at").eqNullSafe(F.col("t"))
    out = rows.join(best, same, "left").withColumn("_", F.explode(F.expr("sequence(1L, times)")))
    return out.select("capture_id", host(F.col("url")).alias("host"), F.coalesce("b.action", F.lit("none")).alias("verdict"), "b.list", "b.pattern")
