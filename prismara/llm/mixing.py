"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import WORD, cut, unused

#: Hexadecimal digits of the shuffle key that part a source, so that no window holds a whole source.
PART_DIGITS = 3
#: Slots that are ranked together.
SLOT_RUN = 1 << 13
#: The golden ratio's fractional part times 2**31, made odd: multiples of it modulo 2**31 are evenly spread.
GOLDEN, PERIOD = 1327217885, 1 << 31
#: Cells that cut the unit interval, for finding a point's source by an equality join.
CELLS = 1 << 12


def words_in(text: str = "text") -> Column:
    """The number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) for sizes(source, source_size), one row for each source.

    Sources by code point, null last, weigh as `weights`, repeating, and share `share` of all words; no target
    is over `most` times its source's size, and what is over is shared again by weight among the rest. Filling
    in the order of room for each unit of weight does this in one pass: a source is full exactly if the level
    at which it would be full is at or below the level of those after it. One row for each source is sorted
    in one task here.
    """
    w = W.orderBy(F.col("source").asc_nulls_last())
    given = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(w) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", given.cast("double")).withColumn("room", F.col("source_size") * F.lit(float(most)))
    order = W.orderBy(F.col("room") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(0, W.unboundedFollowing)
    every = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.select(
        "*",
        F.coalesce(F.sum("room").over(before), F.lit(0.0)).alias("filled"),
        F.sum("weight").over(after).alias("left"),
        (F.sum("source_size").over(every) * F.lit(float(share))).alias("all"),
    )
    level = F.greatest(F.col("all") - F.col("filled"), F.lit(0.0)) / F.col("left")
    # Levels rise until the first source that isn't filled, and fall from there: the highest is the right one.
    rows = rows.withColumn("each", level).withColumn("level", F.max("each").over(every))
    target = F.least("room", F.col("level") * F.col("weight"))
    return rows.select("source", "source_size", target.alias("target"))


def _shuffle_key(doc_id: str, text: str) -> Column:
    return F.md5(F.concat_ws(" ", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.coalesce(F.md5(text), F.lit("null"))))


def _dealt(df: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """Every row with its size, shuffle key and part of its source."""
    key = _shuffle_key(doc_id, text)
    return df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words_in(text).alias("size"), key.alias("key")).withColumn("part", F.substring("key", 1, PART_DIGITS))


def schedule(plan: DataFrame, block: int) -> DataFrame:
    """(slot, source, epoch, block, take) for plan(source, source_size, target).

    Slot i is the point i times the golden ratio modulo 1, mapped through the sources' cumulative numbers of
    slots; slots are ranked within their source, and rank r takes block r modulo the source's number of blocks
    in epoch r div that number. A source's last slot takes what is left of its target; ranks past a source's
    need are dropped, and the few that the points haven't reached come at the end, in a slot after all others. Ranks are
    summed over runs of slots, so no task holds a source's slots together. Slots are as many as all targets
    hold blocks; nothing but one row for each source and cell is ever joined by broadcast.
    """
    need = plan.where("target > 0").select(
        "source",
        F.col("source_size").alias("n"),
        F.floor("target").alias("words"),
        F.ceil(F.col("source_size") / block).alias("blocks"),
    )
    need = need.withColumn("epochs", F.expr("words div n")).withColumn("rest", F.expr("words % n"))
    need = need.withColumn("slots", F.col("epochs") * F.col("blocks") + F.ceil(F.col("rest") / block))
    upto = W.orderBy(F.col("source").asc_nulls_last())
    need = need.withColumn("hi", F.sum("slots").over(upto)).withColumn("all", F.sum("slots").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    need = cut(need.withColumn("lo", (F.col("hi") - F.col("slots")) / F.col("all")).withColumn("hi", F.col("hi") / F.col("all")))
    total = need.agg(F.max("all")).first()[0] or 0
    point = ((F.col("id") % PERIOD) * GOLDEN) % PERIOD / F.lit(float(PERIOD))
    points = need.sparkSession.range(total).select("id", point.alias("u"))
    cells = need.select("source", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))).alias("cell"))
    points = points.withColumn("cell", F.floor(F.col("u") * CELLS)).withColumn("run", F.expr(f"id div {SLOT_RUN}"))
    hit = points.join(cells, "cell").where("u >= lo AND u < hi").select("id", "run", "source")
    runs = hit.groupBy("source", "run").count()
    seen = W.partitionBy("source").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select(F.col("source").alias("s"), F.col("run").alias("r"), F.coalesce(F.sum("count").over(seen), F.lit(0)).alias("ahead"))
    rank = F.row_number().over(W.partitionBy("source", "run").orderBy("id")) - 1
    ranked = hit.withColumn("in_run", rank).join(runs, F.col("source").eqNullSafe(F.col("s")) & (F.col("run") == F.col("r")))
    ranked = ranked.select("source", (F.col("in_run") + F.col("ahead")).alias("rank"), F.col("id").alias("slot"))
    # The ranks that the points haven't reached.
    got = hit.groupBy(F.col("source").alias("s")).agg(F.count("*").alias("got"))
    short = need.join(got, F.col("source").eqNullSafe(F.col("s")), "left").where("slots > coalesce(got, 0)")
    short = short.select("source", F.explode(F.expr("sequence(coalesce(got, 0L), slots - 1)")).alias("rank"), F.lit(total).cast("long").alias("slot"))
    of = need.select(F.col("source").alias("s"), "n", "blocks", "epochs", "rest", "slots")
    full = ranked.union(short).join(of, F.col("source").eqNullSafe(F.col("s"))).where("rank < slots")
    full = full.withColumn("epoch", F.expr("rank div blocks")).withColumn("block", F.expr("rank % blocks"))
    ends = F.least(F.when(F.col("epoch") < F.col("epochs"), F.col("n")).otherwise(F.col("rest")), (F.col("block") + 1) * block)
    return full.select("slot", "source", "epoch", "block", (ends - F.col("block") * block).alias("take"))


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block: int = 4096) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, slot) for every row: the words of it that the mix takes, repeats
    counted, and the schedule's slot in which it is first taken from (null if it isn't).

    Each source's rows are shuffled by a hash of their id and text and cut, end to end, into blocks of `block`
    words; `schedule` deals blocks to slots until each source's target is met to the word. The same rows give
    the same result at every run and partitioning. A null source is a source of its own; a null or empty text
    has no words and takes none; rows that are alike in id and text follow one another, and which comes first makes
    no difference but to which of the two equal rows gets which count. Sources without words have target 0. A text
    of any length is as many blocks as it spans; an empty table gives an empty one. Other columns aren't looked at.
    Sums run over parts of a source first, then over rows within a part.
    """
    taken = _taken(df, doc_id, text, source, weights, share, most, block)
    return taken.select("doc_id", "source", "size", "source_size", "target", "taken", "slot")


def mixture(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block: int = 4096) -> DataFrame:
    """df's rows with all their columns, each as often as the mix holds it as a whole (see mix and copies), so
    not at all or up to `most` times. Rows alike in id, text and source are as one, with all their copies.

    Rows come in the schedule's order, over partitions and within them: each copy lies where the schedule has its turn
    of the block that the document begins in; documents without words come last.
    """
    key, own, k, s, n, place, times = unused(df, "key", "source", "k", "s", "n", "place", "times")
    found = _taken(df, doc_id, text, source, weights, share, most, block)
    found = found.groupBy("key", "source").agg(F.sum(copies(F.col("taken"), F.col("size"))).cast("int").alias(times), F.min("turns").alias("turns"), F.min("slot").alias("first"), F.max("slots").alias("slots")).where(F.col(times) > 0)
    last = F.coalesce("slots", F.lit(0))
    turn = F.transform(F.sequence(F.lit(0), F.col(times) - 1), lambda i: F.coalesce(F.get("turns", i), F.element_at(F.when(F.size("turns") > 0, F.col("turns")), -1), F.col("first"), last))
    found = found.select(F.col("key").alias(k), F.col("source").alias(s), turn.alias(times), last.alias("_all"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = found.withColumn(times, F.transform(times, lambda x: F.struct(x.alias("at"), F.least(F.floor(x * parts / (F.col("_all") + 1)), F.lit(parts - 1)).cast("int").alias("part")))).drop("_all")
    met = df.withColumns({key: _shuffle_key(doc_id, text), own: F.col(source)}).join(found, (F.col(key) == F.col(k)) & F.col(own).eqNullSafe(F.col(s)))
    met = met.withColumn(n, F.row_number().over(W.partitionBy(key, own).orderBy(key))).where(F.col(n) == 1).withColumn(place, F.explode(times))
    return met.repartitionById(parts, F.col(place)["part"]).sortWithinPartitions(F.col(place)["at"], key).select(*df.columns)


def _taken(df: DataFrame, doc_id: str, text: str, source: str, weights: tuple[int, ...], share: float, most: float, block: int) -> DataFrame:
    rows = _dealt(df, doc_id, text, source)
    by_part = cut(rows.groupBy("source", "part").agg(F.sum("size").alias("words")))
    sizes = by_part.groupBy("source").agg(F.sum("words").alias("source_size"))
    plan = cut(targets(sizes, weights, share, most))
    slots = schedule(plan, block)
    slots = cut(slots)
    all_slots = slots.agg(F.max("slot")).first()[0]
    times = slots.groupBy("source", "block", "take").agg(F.count("*").alias("times"), F.min("slot").alias("slot"))
    # Every turn of a block, in order: one for each epoch, so `most` + 1 at the most.
    turns = slots.groupBy(F.col("source").alias("s"), F.col("block").alias("b")).agg(F.sort_array(F.collect_list("slot")).alias("turns"))

    ahead = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = by_part.select(F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead"))
    inner = W.partitionBy("source", "part").orderBy("key").rowsBetween(W.unboundedPreceding, 0)
    placed = rows.select("doc_id", "source", "part", "key", "size", (F.sum("size").over(inner) - F.col("size")).alias("at"), F.row_number().over(W.partitionBy("source", "part").orderBy("key")).alias("nth"))
    placed = placed.join(parts, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    placed = placed.select("doc_id", "source", "part", "key", "nth", "size", (F.col("at") + F.col("ahead")).alias("begin"))
    named = plan.select(F.col("source").alias("s"), "source_size", "target")
    placed = placed.join(named, F.col("source").eqNullSafe(F.col("s"))).drop("s")

    last = F.expr(f"(begin + greatest(size, 1) - 1) div {block}")
    pieces = placed.withColumn("block", F.explode(F.sequence(F.expr(f"begin div {block}"), last)))
    at = times.select(F.col("source").alias("s"), F.col("block").alias("b"), "take", "times", "slot")
    met = pieces.join(at, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left")
    overlap = F.greatest(F.least(F.col("begin") + F.col("size"), F.col("block") * block + F.coalesce("take", F.lit(0))) - F.greatest("begin", F.col("block") * block), F.lit(0))
    met = met.withColumn("taken", overlap * F.coalesce("times", F.lit(0))).withColumn("slot", F.when(F.col("taken") > 0, F.col("slot"))).drop("s", "b")
    begins = F.col("block") == F.expr(f"begin div {block}")
    met = met.join(turns, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")) & begins, "left")
    keys = ["source", "part", "key", "nth", "doc_id", "size", "source_size", "target"]
    return met.groupBy(*keys).agg(F.sum("taken").alias("taken"), F.min("slot").alias("slot"), F.min("turns").alias("turns")).withColumn("slots", F.lit(all_slots).cast("long"))


def copies(taken: Column, size: Column) -> Column:
    """How often the mix holds a document as a whole: taken over size to the nearest; once if it has no words."""
    return F.when(size == 0, 1).otherwise(F.floor(taken / size + F.lit(0.5))).cast("int")


#: The same result in DuckDB SQL: the schedule's points, the sources they fall to and the blocks that these take in turn.
ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, md5(concat(coalesce(CAST(doc_id AS VARCHAR), 'null'), ' ', coalesce(md5(text), 'null'))) AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS DOUBLE) AS weight,
             source_size * 2.0::DOUBLE AS room FROM s),
f AS (SELECT *, coalesce(sum(room) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
             sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
             sum(source_size) OVER () * 1.5::DOUBLE AS total
      FROM w WINDOW o AS (ORDER BY room / weight, source NULLS LAST)),
l AS (SELECT *, greatest(total - filled, 0) / rest AS level FROM f),
t AS (SELECT source, source_size, least(room, max(level) OVER () * weight) AS target FROM l),
n AS (SELECT source, source_size AS n, CAST(floor(target) AS BIGINT) // source_size AS epochs, CAST(floor(target) AS BIGINT) % source_size AS rest, (source_size + 4095) // 4096 AS blocks FROM t WHERE target > 0),
c AS (SELECT *, epochs * blocks + (rest + 4095) // 4096 AS slots FROM n),
b AS (SELECT *, CAST(sum(slots) OVER (ORDER BY source NULLS LAST) AS BIGINT) AS upto, CAST(sum(slots) OVER () AS BIGINT) AS total FROM c),
pt AS (SELECT id, CAST(((id % {PERIOD}) * {GOLDEN}) % {PERIOD} AS DOUBLE) / {PERIOD} AS u FROM (SELECT unnest(range((SELECT coalesce(max(total), 0) FROM b))) AS id)),
h AS (SELECT b.source, row_number() OVER (PARTITION BY b.source ORDER BY pt.id) - 1 AS rank, pt.id AS slot FROM pt JOIN b ON u >= CAST(upto - slots AS DOUBLE) / total AND u < CAST(upto AS DOUBLE) / total),
gt AS (SELECT source, count(*) AS got FROM h GROUP BY source),
r AS (SELECT b.*, h.rank, h.slot FROM h JOIN b ON b.source IS NOT DISTINCT FROM h.source WHERE h.rank < b.slots
      UNION ALL SELECT b.*, unnest(range(coalesce(gt.got, 0), CAST(b.slots AS BIGINT))) AS rank, b.total AS slot FROM b LEFT JOIN gt ON gt.source IS NOT DISTINCT FROM b.source WHERE coalesce(gt.got, 0) < b.slots),
e AS (SELECT source, slot, rank % blocks AS block, least(CASE WHEN rank // blocks < epochs THEN n ELSE rest END, (rank % blocks + 1) * 4096) AS ends FROM r),
p AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos, row_number() OVER () AS nr FROM d),
g AS (SELECT nr, sum(least(pos + size, ends) - greatest(pos, block * 4096)) AS taken, min(slot) AS slot FROM p JOIN e ON e.source IS NOT DISTINCT FROM p.source AND least(pos + size, ends) > greatest(pos, block * 4096) GROUP BY nr)
SELECT p.doc_id, p.source, p.size, t.source_size, t.target, CAST(coalesce(g.taken, 0) AS BIGINT) AS taken, g.slot
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source LEFT JOIN g ON g.nr = p.nr
"""
