import random
import zlib
from datetime import datetime, timedelta
from math import floor, isfinite

import numpy as np
import pytest

from prismara.llm import leaderboard

LINES = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz, a string, cents string, nation_id string, batch string"
ITEMS, VENDORS = "item_id long, name string, price double, cents string", "vendor_id long, nation_id int, leaf string"


def test_treap_is_a_sorted_list():
    rng = random.Random(1)
    treap, held = leaderboard.Treap(np.zeros(0, np.int64), np.zeros(0)), {}
    for step in range(4000):
        item, change = rng.choice((rng.randrange(60), rng.randrange(-5, 900))), float(rng.randrange(-400, 500))
        treap.add(item, change)
        held[item] = held.get(item, 0.0) + change
        if step % 400 == 7:
            treap = leaderboard.Treap.read(treap.stored())
        if step % 50 == 0:
            want = sorted(held, key=lambda i: (-held[i], i))
            assert [treap.item[i] for i in treap] == want
            assert treap.first(10) == [(i, held[i]) for i in want if held[i] > 0][:10]
            assert [treap.rank(i) for i in want] == list(range(len(want))) and treap.rank(-99) is None
            assert treap.size[treap.root] == len(want)
            for i in treap:  # heap order and sizes
                below = [x for x in (treap.left[i], treap.right[i]) if x >= 0]
                assert all(treap.priority[x] <= treap.priority[i] for x in below) and treap.size[i] == 1 + sum(treap.size[x] for x in below)
    assert [leaderboard._priority(i) for i in (-5, 0, 7)] == leaderboard.mix(np.array([-5, 0, 7], np.int64).view(np.uint64)).tolist()


def by_hand(lines, items, vendors):
    """The contract in plain code: all lines in order, whole boards anew after every day."""
    least = lambda rows: {k: min((v for x, v in rows if x == k and v is not None), default=None) for k, _ in rows if k is not None}
    price, nation = least([(r[0], r[2]) for r in items]), least([(r[0], r[1]) for r in vendors])
    rows = []
    for sale, line, item, vendor, quantity, amount, _, flag, at, *_ in lines:
        h = zlib.crc32(",".join("" if x is None else str(x) for x in (sale, item, vendor, line)).encode())
        s = (at - datetime(1970, 1, 1)).days if at else 19723 + h % 150
        a = s + h % 7 + 20 * (h % 5 == 0)
        cents = floor(100 * amount + 0.5) if amount is not None and isfinite(amount) else None
        if cents is None and quantity is not None and price.get(item) is not None:
            cents = quantity * floor(100 * price[item] + 0.5)
        cents = (cents or 0) * (-1 if flag == "swapped" else 1)
        rows.append((max(1, min(8, 1 + (a - 19723) * 8 // 180)), s, a, nation.get(vendor) if item in price else None, item, cents))
    kept = [r for r in rows if r[3] is not None and all(r[1] + 15 >= x[1] for x in rows if x[0] < r[0])]
    out = []
    for n in {r[3] for r in kept}:
        total, board = {}, {}
        for day in sorted({r[2] for r in kept if r[3] == n}):
            for r in kept:
                if r[3] == n and r[2] == day:
                    total[r[4]] = total.get(r[4], 0) + r[5]
            now = {i: k for k, i in enumerate(sorted((i for i in total if total[i] > 0), key=lambda i: (-total[i], i))[:10], 1)}
            for i in {**board, **now}:
                if board.get(i) != now.get(i):
                    change = "enter" if i not in board else "exit" if i not in now else "move"
                    out.append((n, day, i, max(1, min(8, 1 + (day - 19723) * 8 // 180)), change, board.get(i), now.get(i), total[i]))
            board = now
    return sorted(map(repr, out))


def made(seed, n=900, hot=False):
    rng = random.Random(seed)
    pick = lambda k: None if rng.random() < 0.02 else 0 if hot and rng.random() < 0.34 else rng.randrange(k)
    lines = []
    for _ in range(n):
        at = None if rng.random() < 0.05 else datetime(2024, 1, 1) + timedelta(days=rng.randrange(-3 if seed == 2 else 0, 150), hours=rng.randrange(24))
        amount = rng.choice((None, float(rng.randrange(1, 9)), round(rng.uniform(0, 50), 2), float("nan") if seed == 2 else 1.0))
        lines.append((pick(200), rng.randrange(1, 5), pick(40), pick(8), rng.choice((None, 1, 2, 3)), amount, 0.0, rng.choice(("kept", "returned", "swapped", None)), at, *["clash"] * 4))
    lines += [lines[0]] * 3
    items = [(i, "x", rng.choice((None, round(rng.uniform(1, 30), 2))), "clash") for i in range(36)] + [(3, "again", 2.5, "clash"), (None, None, 1.0, None)]
    vendors = [(i, rng.choice((None, 1, 2, 3)), "clash") for i in range(7)] + [(0, 2, "clash"), (None, 1, None)]
    return lines, items, vendors


def found(df):
    return sorted(repr(tuple(r)) for r in df.select(*(x.split()[0] for x in leaderboard.FEED.split(", "))).collect())


@pytest.mark.parametrize(("seed", "leaf", "fan"), [(1, 2048, 32), (2, 3, 2)])
def test_feed_is_that_of_plain_code(spark, seed, leaf, fan):
    """With one treap for a nation, and with many leaves merged in several rounds; a hot nation and item in both."""
    lines, items, vendors = made(seed, hot=True)
    frames = [spark.createDataFrame(x, schema).repartition(3) for x, schema in ((lines, LINES), (items, ITEMS), (vendors, VENDORS))]
    assert found(leaderboard.change_feed(*frames, leaf=leaf, fan=fan)) == by_hand(lines, items, vendors)


def test_few_lines_and_empty_tables(spark):
    frame = lambda x, schema: spark.createDataFrame(x, schema)
    lines, items, vendors = made(5)
    assert leaderboard.change_feed(frame([], LINES), frame(items, ITEMS), frame(vendors, VENDORS)).collect() == []
    assert leaderboard.change_feed(frame(lines[:9], LINES), frame([], ITEMS), frame([], VENDORS)).collect() == []
    one = [(1, 1, 5, 1, 1, 3.0, 0.0, "kept", None, *["clash"] * 4), (1, 1, 5, 1, 1, 3.0, 0.0, "kept", None, *["clash"] * 4)]
    assert found(leaderboard.change_feed(frame(one, LINES), frame([(5, "x", 1.0, "")], ITEMS), frame([(1, 4, "")], VENDORS))) == by_hand(one, [(5, "x", 1.0, "")], [(1, 4, "")])


def test_sums_of_a_task_are_bounded(monkeypatch):
    monkeypatch.setattr(leaderboard, "HELD", 40)
    rng, total, rows = random.Random(3), {}, []
    for _ in range(30):
        rows.append([(1, 0, rng.randrange(12), rng.randrange(4), float(rng.randrange(9))) for _ in range(15)])
        for r in rows[-1]:
            total[r[:4]] = total.get(r[:4], 0) + r[4]
    names = ["nation_id", "leaf", "item_id", "a", "cents"]
    batches = [leaderboard.pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*b, strict=True)), strict=True))) for b in rows]
    got = {}
    for batch in leaderboard._summed(iter(batches)):
        for r in batch.to_pylist():
            key = tuple(r[c] for c in names[:4])
            got[key] = got.get(key, 0) + r["cents"]
    assert got == total
