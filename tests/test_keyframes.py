import random

from prismara.plans import keyframes

ASSETS, FRAMES = "file_id long, duration_ms long", "file_id long, id long, timestamp_ms long, phash string, left string"


def by_hand(duration, frames):
    """Keyframes of one video by plain code: [(id, ms, how)]."""
    fine = {}
    for i, ms, h in frames:
        if i is not None and ms is not None and ms >= 0 and h and len(h) == 16:
            fine[ms, h] = min(i, fine.get((ms, h), i))
    if not fine:
        return []
    length = duration if duration and duration > 0 else max(ms for ms, _ in fine)
    n = next((k for most, k in ((30_000, 4), (300_000, 6), (1_200_000, 10), (3_600_000, 16)) if length <= most), 24)
    first = min(3000, length // 10)
    span, places = length - 2 * first, {4: 3, 6: 4, 10: 7, 16: 11, 24: 17}[n]
    pool = [(ms, i, int(h, 16)) for (ms, h), i in fine.items() if int(h, 16) and first <= ms <= first + span]
    slots = {}
    for f in pool:
        k = min((f[0] - first) * places // max(span, 1), places - 1)
        slots.setdefault(k, []).append((abs(2 * places * (f[0] - first) - (2 * k + 1) * span), *f))
    out = []
    for f in sorted(min(x)[1:] for x in slots.values()):
        if f[2] not in {x[2] for x in out}:
            out.append(f)
    even = len(out)
    while out and len(out) < n:
        far, ms, i, h = min((-min((f[2] ^ x[2]).bit_count() for x in out), *f) for f in pool)
        if far == 0:
            break
        out.append((ms, i, h))
    return [(f[1], f[0], "even" if k < even else "change") for k, f in enumerate(out)]


def check(spark, assets, frames):
    t = {"video_assets": spark.createDataFrame(assets, ASSETS), "video_frames": spark.createDataFrame([(*f, "clash") for f in frames], FRAMES)}
    got = {}
    for r in sorted(keyframes.keyframes(t).collect(), key=lambda r: (r["file_id"], r["place"])):
        got.setdefault(r["file_id"], []).append((r["id"], r["timestamp_ms"], r["how"]))
    want = {v: found for v, d in assets if (found := by_hand(d, [f[1:] for f in frames if f[0] == v]))}
    assert got == want
    return got


def test_keyframes_of_every_tier_ties_and_odd_rows(spark):
    rng = random.Random(3)
    hashes = [f"{rng.getrandbits(64):016x}" for _ in range(40)] + ["0" * 16]
    assets = [(1, 20_000), (2, 30_000), (3, 250_000), (4, 1_000_000), (5, 3_000_000), (6, 9_000_000), (7, None), (8, 0), (9, 5), (10, 60_000), (11, 90_000)]
    frames = [(v, v * 1000 + i, rng.randrange(max(d or 50_000, 1)), rng.choice(hashes)) for v, d in assets[:9] for i in range(60)]
    frames += [(10, 1, 30_000, hashes[0]), (10, 2, 30_000, hashes[0]), (10, 3, 31_000, hashes[0]), (11, 4, 10, hashes[1])]  # one picture; only at the margin
    frames += [(12, 5, 10_000, hashes[1]), (None, 6, 1, hashes[1]), (1, None, 10_000, hashes[1]), (1, 7, None, hashes[1]), (1, 8, 10_000, None), (1, 9, 10_000, "xyz"), (1, 10, -5, hashes[2])]
    got = check(spark, assets, frames + frames[:50])
    assert [len(got[v]) for v in (1, 3, 4, 5, 6)] == [4, 6, 10, 16, 24] and len(got[10]) == 1 and 11 not in got and 12 not in got


def test_an_empty_library_has_none(spark):
    check(spark, [], [])
    check(spark, [(1, 5000)], [])


def test_a_long_video_with_most_frames(spark):
    rng = random.Random(4)
    frames = [(1, i, rng.randrange(7_200_000), f"{rng.getrandbits(64):016x}") for i in range(3000)] + [(2, i, i * 100, f"{i % 3 + 1:016x}") for i in range(100)]
    got = check(spark, [(1, 7_200_000), (2, 10_000)], frames)
    assert sum(how == "change" for _, _, how in got[1]) == 7
