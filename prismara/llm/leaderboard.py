"""A change feed of leaderboards: running revenue by nation and item in treaps that a stateful stream keeps, and the boards
that follow from their first ten."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from heapq import merge
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import checkpoint_dir
from ._shared import _place, done, mix, shared_table

#: First day of the batches, their number and days, days a line may be late, and places of a board.
DAY0, BATCHES, DAYS, LATE, PLACES = 19_723, 8, 180, 15, 10
#: Items of a treap that one key of the state may hold, about; and boards that are merged into one at once.
LEAF, FAN = 1 << 11, 1 << 5
#: Rows that a task sums up before it hands them on.
HELD = 1 << 18

LINES = "s int, a int, nation_id int, leaf int, item_id long, cents double"
CHANGES = "nation_id int, leaf int, a int, items array<long>, revenues array<double>, gone array<long>, left array<double>"
FEED = "nation_id int, arrival_day long, item_id long, batch int, change string, old_rank int, new_rank int, revenue long"

Board = list[tuple[int, float]]


class Treap:
    """Items in the order of falling revenue and then rising id, with the size of every subtree.

    A node's key is one whole number made of both; its priority is a hash of the item, so the same items always make
    the same tree, and what is stored is their sorted list alone.
    """

    def __init__(self, items: np.ndarray, revenues: np.ndarray):
        """items and their revenues in the order of their keys."""
        self.item, self.revenue = items.tolist(), revenues.tolist()
        self.key = [self._key(r, i) for r, i in zip(self.revenue, self.item, strict=True)]
        self.priority = mix(items.astype(np.int64).view(np.uint64)).tolist()
        n = len(self.item)
        self.left, self.right, self.size = [-1] * n, [-1] * n, [1] * n
        self.place = dict(zip(self.item, range(n), strict=True))
        self.root = self._built()

    @staticmethod
    def _key(revenue: float, item: int) -> int:
        return (-int(revenue) << 64) + item + (1 << 63)

    def _built(self) -> int:
        """Links all nodes, which are in order: each hangs below the last of greater priority on the right edge."""
        edge: list[int] = []
        left, right, size, priority = self.left, self.right, self.size, self.priority
        for i, p in enumerate(priority):
            below = -1
            while edge and priority[edge[-1]] < p:
                below = edge.pop()
                if right[below] >= 0:
                    size[below] += size[right[below]]
            left[i] = below
            if below >= 0:
                size[i] += size[below]
            if edge:
                right[edge[-1]] = i
            edge.append(i)
        while len(edge) > 1:
            last = edge.pop()
            size[edge[-1]] += size[last]
        return edge[0] if edge else -1

    def _insert(self, i: int) -> None:
        key, priority, left, right, size = self.key, self.priority, self.left, self.right, self.size
        k, p = key[i], priority[i]
        above, at, under = -1, self.root, False
        while at >= 0 and priority[at] >= p:
            size[at] += 1
            above = at
            under = k < key[at]
            at = left[at] if under else right[at]
        # What was there is split by the key into the new node's two sides.
        low, high, path, total = i, i, [], size[at] if at >= 0 else 0
        left[i] = right[i] = -1
        while at >= 0:
            path.append(at)
            if key[at] < k:
                if low == i:
                    left[i] = at
                else:
                    right[low] = at
                low, at = at, right[at]
            else:
                if high == i:
                    right[i] = at
                else:
                    left[high] = at
                high, at = at, left[at]
        if low != i:
            right[low] = -1
        if high != i:
            left[high] = -1
        for at in reversed(path):
            a, b = left[at], right[at]
            size[at] = 1 + (size[a] if a >= 0 else 0) + (size[b] if b >= 0 else 0)
        size[i] = total + 1
        if above < 0:
            self.root = i
        elif under:
            left[above] = i
        else:
            right[above] = i

    def _remove(self, i: int) -> None:
        key, priority, left, right, size = self.key, self.priority, self.left, self.right, self.size
        k, above, at, under = key[i], -1, self.root, False
        while at != i:
            size[at] -= 1
            above = at
            under = k < key[at]
            at = left[at] if under else right[at]
        low, high = left[i], right[i]
        while low >= 0 or high >= 0:
            # The side of greater priority comes up, and holds the other one from now on.
            first = high < 0 or low >= 0 and priority[low] >= priority[high]
            top, other = (low, high) if first else (high, low)
            if other >= 0:
                size[top] += size[other]
            if above < 0:
                self.root = top
            elif under:
                left[above] = top
            else:
                right[above] = top
            if other < 0:
                return
            above, under = top, not first
            if first:
                low = right[top]
            else:
                high = left[top]
        if above < 0:
            self.root = -1
        elif under:
            left[above] = -1
        else:
            right[above] = -1

    def add(self, item: int, change: float) -> None:
        """Changes an item's revenue: it is taken out and put back under its new key."""
        i = self.place.get(item)
        if i is None:
            i = self.place[item] = len(self.item)
            self.item.append(item)
            self.revenue.append(change)
            self.key.append(self._key(change, item))
            self.priority.append(_priority(item))
            self.left.append(-1)
            self.right.append(-1)
            self.size.append(1)
        else:
            self._remove(i)
            self.revenue[i] += change
            self.key[i] = self._key(self.revenue[i], item)
        self._insert(i)

    def __iter__(self) -> Iterator[int]:
        """Nodes in order."""
        at, path, left, right = self.root, [], self.left, self.right
        while path or at >= 0:
            while at >= 0:
                path.append(at)
                at = left[at]
            at = path.pop()
            yield at
            at = right[at]

    def first(self, n: int) -> Board:
        """The first n items with their revenues, as long as those are positive."""
        out = []
        for i in islice(self, n):
            if self.revenue[i] <= 0:
                break
            out.append((self.item[i], self.revenue[i]))
        return out

    def rank(self, item: int) -> int | None:
        """An item's place in the order, from 0."""
        i = self.place.get(item)
        if i is None:
            return None
        k, at, before = self.key[i], self.root, 0
        while at >= 0:
            if self.key[at] < k:
                before += 1 + (self.size[self.left[at]] if self.left[at] >= 0 else 0)
                at = self.right[at]
            else:
                at = self.left[at]
        return before

    def stored(self) -> bytes:
        order = list(self)
        return np.array([self.item[i] for i in order], np.int64).tobytes() + np.array([self.revenue[i] for i in order], np.float64).tobytes()

    @classmethod
    def read(cls, x: bytes) -> Treap:
        half = len(x) // 2
        return cls(np.frombuffer(x[:half], np.int64), np.frombuffer(x[half:], np.float64))


def _priority(item: int) -> int:
    """The finishing steps of the splitmix64 generator, as in `mix`, for one number."""
    m = (1 << 64) - 1
    x = item & m
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & m
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & m
    return x ^ (x >> 31)


def _board_bytes(board: Board) -> bytes:
    return np.array([i for i, _ in board], np.int64).tobytes() + np.array([r for _, r in board], np.float64).tobytes()


def _board(x: bytes) -> Board:
    half = len(x) // 2
    return list(zip(np.frombuffer(x[:half], np.int64).tolist(), np.frombuffer(x[half:], np.float64).tolist(), strict=True))


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Takes a batch into the treap of one nation and leaf, arrival day by arrival day; a row for each day after which its
    board isn't the stored one, with the items that left it and what they have now."""
    held = state.get if state.exists else (b"", b"")
    treap, board = Treap.read(held[0]), _board(held[1])
    parts = [(f["a"].to_numpy(), f["item_id"].to_numpy(), f["cents"].to_numpy()) for f in frames]
    days, items, cents = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((items, days))
    days, items, cents = days[order], items[order], cents[order]
    heads = np.flatnonzero(np.concatenate(([True], (days[1:] != days[:-1]) | (items[1:] != items[:-1]))))
    cents, days, items = np.add.reduceat(cents, heads).tolist(), days[heads], items[heads].tolist()
    cuts = [*np.flatnonzero(np.concatenate(([True], days[1:] != days[:-1]))).tolist(), len(items)]
    out = []
    for begin, end in zip(cuts, cuts[1:], strict=False):
        for k in range(begin, end):
            treap.add(items[k], cents[k])
        now = treap.first(PLACES)
        if now != board:
            stay = {i for i, _ in now}
            gone = [i for i, _ in board if i not in stay]
            out.append((*key, int(days[begin]), [i for i, _ in now], [r for _, r in now], gone, [treap.revenue[treap.place[i]] for i in gone]))
            board = now
    state.update((treap.stored(), _board_bytes(board)))
    yield pd.DataFrame(out, columns=[x.split()[0] for x in CHANGES.split(", ")])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of equal nation, item and arrival day as one, as far as a task's memory goes: a hot item ends here."""
    keys = ["nation_id", "leaf", "item_id", "a"]
    held: list[pa.Table] = []

    def one() -> pa.Table:
        return pa.concat_tables(held).group_by(keys, use_threads=False).aggregate([("cents", "sum")]).rename_columns({"cents_sum": "cents"}).select([*keys, "cents"])

    for batch in batches:
        held.append(pa.Table.from_batches([batch]).select([*keys, "cents"]))
        if sum(t.num_rows for t in held) >= HELD:
            held = [one()]
            if held[0].num_rows >= HELD // 2:
                yield from held.pop().to_batches()
    if held:
        yield from one().to_batches()


def _merged(rows: pd.DataFrame) -> Iterator[tuple[int, Board, Board, dict[int, float]]]:
    """(arrival day, board before, board after, revenues) of several leaves' changes taken together, for each day after
    which the board is another one. Each leaf hands on ten items at most, so a day's work is bounded by their number."""
    own: dict[int, Board] = {}
    board: Board = []
    order = lambda x: (-x[1], x[0])
    for day, part in rows.sort_values(["a", "leaf"]).groupby("a"):
        known: dict[int, float] = {}
        for leaf, items, revenues, gone, left in zip(*(part[c] for c in ("leaf", "items", "revenues", "gone", "left")), strict=True):
            own[leaf] = list(zip(items, revenues, strict=True))
            known.update(zip(gone, left, strict=True))
        for held in own.values():
            known.update(held)
        now = list(islice(merge(*own.values(), key=order), PLACES))
        if now != board:
            yield day, board, now, known
            board = now


def _gathered(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The changes of several leaves as those of one."""
    out = []
    for day, before, now, known in _merged(rows):
        stay = {i for i, _ in now}
        gone = [i for i, _ in before if i not in stay]
        out.append((*key, day, [i for i, _ in now], [r for _, r in now], gone, [known[i] for i in gone]))
    return pd.DataFrame(out, columns=[x.split()[0] for x in CHANGES.split(", ")])


def _told(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """A nation's feed."""
    out = []
    for day, before, now, known in _merged(rows):
        was, new = ({i: n for n, (i, _) in enumerate(b, 1)} for b in (before, now))
        for item in {**was, **new}:
            old, rank = was.get(item), new.get(item)
            if old != rank:
                out.append((key[0], day, item, _batch_of(day), "enter" if old is None else "exit" if rank is None else "move", old, rank, int(known[item])))
    frame = pd.DataFrame(out, columns=[x.split()[0] for x in FEED.split(", ")])
    return frame.astype({"old_rank": "Int32", "new_rank": "Int32"})


def _batch_of(day: int) -> int:
    return max(1, min(BATCHES, 1 + (day - DAY0) * BATCHES // DAYS))


def arrivals(lines: DataFrame, prices: DataFrame, nations: DataFrame, leaves: int) -> DataFrame:
    """Every line's day `s`, arrival day `a`, batch, nation and item, the leaf of its item, and its revenue in cents. A line that
    counts for nothing but the days has no nation.

    prices(item_id, price) and nations(vendor_id, nation_id) have one row for each id at most. Items grow with the shop, so
    lines and prices are dealt by item, never sent to all; Spark splits hot items' lines.
    """
    c = F.col
    text = F.concat(*(x for name in ("sale_id", "item_id", "vendor_id", "line_no") for x in (F.coalesce(c(name).cast("string"), F.lit("")), F.lit(","))))
    text = F.substring(text, F.lit(1), F.length(text) - 1)
    rows = lines.select("sale_id", "item_id", "vendor_id", "line_no", "quantity", "amount", "flag", "shipped_at", F.crc32(text.cast("binary")).alias("_h"))
    s = F.coalesce(F.unix_date(c("shipped_at").cast("date")).cast("long"), DAY0 + c("_h") % 150).alias("s")
    rows = rows.select("*", s).withColumn("a", c("s") + c("_h") % 7 + F.when(c("_h") % 5 == 0, 20).otherwise(0))
    batch = F.greatest(F.lit(1), F.least(F.lit(BATCHES), 1 + F.floor((c("a") - DAY0) * BATCHES / DAYS)))
    sold = F.when(~F.isnan("amount") & (F.abs("amount") < float("inf")), F.floor(100 * c("amount") + 0.5).cast("double"))
    priced = F.when(~F.isnan("price") & (F.abs("price") < float("inf")), F.floor(100 * c("price") + 0.5).cast("double"))
    rows = rows.join(prices.withColumn("_there", F.lit(True)).hint("merge"), "item_id", "left").join(nations, "vendor_id", "left")
    cents = F.coalesce(sold, c("quantity") * priced, F.lit(0.0))
    cents = F.when(c("flag") == "swapped", -cents).otherwise(cents)
    leaf = F.pmod(F.xxhash64("item_id"), F.lit(leaves)).cast("int")
    return rows.select(c("s").cast("int"), c("a").cast("int"), F.when(c("_there"), c("nation_id")).alias("nation_id"), leaf.alias("leaf"), "item_id", cents.alias("cents"), batch.cast("int").alias("batch"))


def _kept(rows: DataFrame, latest: int | None) -> DataFrame:
    """What isn't late, nor counts for nothing."""
    rows = rows.where(F.col("nation_id").isNotNull())
    return rows if latest is None else rows.where(F.col("s") + LATE >= latest)


def change_feed(lines: DataFrame, items: DataFrame, vendors: DataFrame, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """(nation_id, arrival_day, item_id, batch, change, old_rank, new_rank, revenue): each change of a rank in a nation's board
    of its ten highest positive revenues, by arrival days.

    Lines are cut into eight batches by their arrival, written in the shared folder, and fed one after the other to a
    stateful stream that is started anew for each on one checkpoint. As a nation may hold a third of all lines, and its
    items grow with the shop, a nation's treap is kept in leaves of about `leaf` items dealt by a hash; lines of one
    item and day are summed before they are dealt. A leaf hands on its own ten first items after a day that changes them, with
    what the items that left have now; nations' boards are the first ten of these, `fan` leaves at a time.

    A line without an item of `items`, or whose vendor has no nation, counts for the days only. Of a repeated id of an item or
    a vendor the least price or nation counts. Days before the first batch belong to it; amounts and prices that aren't
    finite are as null. Repeated lines add up; ties go to the smaller item; empty tables give no change. Other columns
    aren't looked at. Everything but the changes is deleted once it is read.
    """
    spark = lines.sparkSession
    home = f"{checkpoint_dir(spark).rstrip('/')}/prismara-board-{uuid.uuid4().hex}"
    where, system = _place(lines, home)
    system.deleteOnExit(where)
    once = lambda df, key, value: shared_table(df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias(value)), "ids")
    prices, nations = once(items, "item_id", "price"), once(vendors, "vendor_id", "nation_id")
    leaves = 1 << max(0, -(-prices.count() // leaf) - 1).bit_length()
    arrivals(lines, prices, nations, leaves).write.partitionBy("batch").option("compression", "zstd").parquet(f"{home}/lines")
    done(prices, nations)
    # Eight rows: the largest day and the batch, whatever the lines' number.
    if system.globStatus(_place(lines, f"{home}/lines/batch=*")[0]):
        days = spark.read.schema(f"{LINES}, batch int").parquet(f"{home}/lines").groupBy("batch").agg(F.max("s").alias("s")).orderBy("batch").collect()
    else:
        days = []
    latest, seen = None, []
    for batch, s in days:
        seen.append(str(batch))
        _feed(spark, home, seen, latest)
        latest = s if latest is None else max(latest, s)
    for part in ("lines", "checkpoint"):
        system.delete(_place(lines, f"{home}/{part}")[0], True)
    if not days:
        return spark.createDataFrame([], FEED)
    changes = spark.read.schema(CHANGES).parquet(f"{home}/changes")
    while leaves > fan:
        leaves = -(-leaves // fan)
        changes = changes.groupBy("nation_id", F.floor(F.col("leaf") / fan).cast("int").alias("part")).applyInPandas(_gathered, CHANGES)
    return changes.groupBy("nation_id").applyInPandas(_told, FEED)


def _feed(spark: SparkSession, home: str, batches: list[str], latest: int | None) -> None:
    """Runs the stream over the batches so far, of which it has seen all but the last."""
    source = spark.readStream.schema(LINES).option("recursiveFileLookup", "true").parquet(f"{home}/lines/batch={{{','.join(batches)}}}")
    rows = _kept(source, latest).select("nation_id", "leaf", "item_id", "a", "cents")
    rows = rows.mapInArrow(_summed, "nation_id int, leaf int, item_id long, a int, cents double")
    changes = rows.groupBy("nation_id", "leaf").applyInPandasWithState(_advance, CHANGES, "treap binary, board binary", "append", "NoTimeout")
    query = changes.writeStream.format("parquet").option("path", f"{home}/changes").option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


ORACLE = f"""
WITH tb AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS t),
x AS (SELECT *, coalesce(sale_id::VARCHAR, '') || ',' || coalesce(item_id::VARCHAR, '') || ',' || coalesce(vendor_id::VARCHAR, '') || ',' || coalesce(line_no::VARCHAR, '') AS k FROM sale_lines),
h AS (SELECT x.*, xor(list_reduce(list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(k[i]) AS BIGINT)), lambda c, b: xor(c // 256, tb.t[xor(c, b) % 256 + 1]), 4294967295), 4294967295) AS h FROM x, tb),
d AS (SELECT *, coalesce(date_diff('day', DATE '1970-01-01', CAST(shipped_at AS DATE)), {DAY0} + h % 150) AS s FROM h),
a AS (SELECT *, s + h % 7 + CASE WHEN h % 5 = 0 THEN 20 ELSE 0 END AS a FROM d),
b AS (SELECT *, greatest(1, least({BATCHES}, 1 + CAST(floor((a - {DAY0}) * {BATCHES} / {DAYS}) AS BIGINT))) AS batch FROM a),
w AS (SELECT batch, max(max(s)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM b GROUP BY batch),
r AS (SELECT v.nation_id, b.item_id, b.a, sum((CASE WHEN b.flag = 'swapped' THEN -1 ELSE 1 END) * coalesce(floor(100 * b.amount + 0.5), b.quantity * floor(100 * i.price + 0.5), 0)) AS cents
  FROM b JOIN w USING (batch) JOIN items i ON i.item_id = b.item_id JOIN vendors v ON v.vendor_id = b.vendor_id
  WHERE v.nation_id IS NOT NULL AND (w.latest IS NULL OR b.s + {LATE} >= w.latest) GROUP BY ALL),
-- Revenue after every arrival day of a nation from an item's first one on.
g AS (SELECT n.nation_id, n.a, i.item_id, coalesce(r.cents, 0) AS cents FROM (SELECT DISTINCT nation_id, a FROM r) n JOIN (SELECT nation_id, item_id, min(a) AS since FROM r GROUP BY ALL) i ON i.nation_id = n.nation_id AND i.since <= n.a
  LEFT JOIN r ON r.nation_id = n.nation_id AND r.a = n.a AND r.item_id = i.item_id),
t AS (SELECT nation_id, a, item_id, sum(cents) OVER (PARTITION BY nation_id, item_id ORDER BY a) AS revenue FROM g),
p AS (SELECT *, CASE WHEN revenue > 0 THEN row_number() OVER (PARTITION BY nation_id, a ORDER BY revenue > 0 DESC, revenue DESC, item_id) END AS n FROM t),
q AS (SELECT nation_id, a, item_id, revenue, CASE WHEN n <= {PLACES} THEN n END AS new_rank FROM p),
z AS (SELECT *, lag(new_rank) OVER (PARTITION BY nation_id, item_id ORDER BY a) AS old_rank FROM q)
SELECT CAST(nation_id AS INT) AS nation_id, CAST(a AS BIGINT) AS arrival_day, item_id, CAST(greatest(1, least({BATCHES}, 1 + CAST(floor((a - {DAY0}) * {BATCHES} / {DAYS}) AS BIGINT))) AS INT) AS batch,
  CASE WHEN old_rank IS NULL THEN 'enter' WHEN new_rank IS NULL THEN 'exit' ELSE 'move' END AS change, CAST(old_rank AS INT) AS old_rank, CAST(new_rank AS INT) AS new_rank, CAST(revenue AS BIGINT) AS revenue
FROM z WHERE old_rank IS DISTINCT FROM new_rank
"""
