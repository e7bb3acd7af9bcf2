import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from prismara.plans import files, pages
from prismara.schema import TABLES

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def library(spark):
    rng, names = random.Random(2), [x.split()[0] for x in TABLES["files"].split(", ")]
    rows = []
    for i in range(3000):
        row = {"id": i, "size_bytes": rng.choice((None, rng.randrange(900), 7)), "file_name": rng.choice((None, f"n{rng.randrange(400):04d}")), "updated_at": rng.choice((None, T0 + timedelta(minutes=rng.randrange(5000)), T0)), "status": rng.choice(("active", "missing")), "media_type": "image"}
        rows.append(tuple(row.get(c) for c in names))
    return spark.createDataFrame(rows, TABLES["files"]).repartition(4)


@pytest.mark.parametrize("sort", ["updated_desc", "size_desc", "size_asc", "name_asc"])
def test_pages_follow_one_another_to_the_end(library, sort, tmp_path, monkeypatch):
    monkeypatch.setattr(pages, "FENCE", 64)
    monkeypatch.setattr(pages, "FILE", 1000)
    held = pages.build(library, str(tmp_path / sort), sort)
    want = [r["id"] for r in library.orderBy(*files._order(sort)).collect()]
    got, cursor = [], ""
    while True:
        rows = held.page(cursor, 700).collect()
        got += [r["id"] for r in rows]
        if len(rows) < 700:
            break
        cursor = files.encode_cursor(sort, rows[-1].asDict())
    assert got == want
    few = held.page(cursor, 5, F.col("status") == "missing").collect()
    place = want.index(got[2799])
    status = {r["id"]: r["status"] for r in library.collect()}
    assert [r["id"] for r in few] == [i for i in want[place + 1 :] if status[i] == "missing"][:5]


def test_a_filter_that_leaves_little_reads_on(library, tmp_path, monkeypatch):
    monkeypatch.setattr(pages, "FENCE", 64)
    held = pages.build(library, str(tmp_path / "p"), "size_asc")
    assert [r["id"] for r in held.page("", 3, F.col("id") % 997 == 5).collect()] == [r["id"] for r in library.where("id % 997 = 5").orderBy(*files._order("size_asc")).limit(3).collect()]


def test_a_page_at_depth_reads_a_small_part(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pages, "GROUP_BYTES", 1 << 14)
    rows = spark.range(200_000).select(F.col("id"), (F.col("id") * 7919 % 1_000_003).alias("size_bytes"), F.sha1(F.col("id").cast("string")).alias("abs_path"))
    held = pages.build(rows, str(tmp_path / "deep"), "size_asc")
    page = held.page(files.encode_cursor("size_asc", {"size_bytes": 600_000, "id": 0}), 20)
    read = pages.scanned(page)
    assert page.count() == 20 and 20 <= read < 30_000
    assert "size_bytes" in page._jdf.queryExecution().executedPlan().toString().split("PushedFilters:")[1].split("]")[0]


def test_empty(spark, tmp_path):
    held = pages.build(spark.createDataFrame([], TABLES["files"]), str(tmp_path / "none"))
    assert held.page().collect() == []
