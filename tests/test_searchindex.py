import random
import re

import pytest
from pyspark.sql import functions as F

from prismara.functions import search
from prismara.plans import files, searchindex
from prismara.schema import TABLES

WORDS = ("red", "blue", "Grün", "x1", "well-known", "a.example.com", "/vol1/set/", "a.example.com/news/today.html", "me@mail.org", "日本語", "don't", "--", "R2-D2", "red.")
TEXTS = ["", "Red red blue", "well known things, well-known ones", "see a.example.com/news/today.html now", "100% sure_thing \\ back"]


def names(text):
    """Compound tokens by plain code."""
    out = set()
    for x in re.findall(r"/?[^\W_]+(?:[-._/@:+]+[^\W_]+)+|/[^\W_]+", text.lower()):
        out.add(x)
        if x.find("/") > 0:
            out |= {x[: x.find("/")], x[x.find("/") :]}
    return out


def answers(text, *parts):
    """Whether any part holds: each a list of (rule out, words in a row or a compound)."""
    row = re.findall(r"[^\W_]+", text.lower())
    has = lambda x: x in names(text) if isinstance(x, str) else any(row[i : i + len(x)] == x for i in range(len(row)))
    return any(all(has(x) != minus for minus, x in part) for part in parts)


QUERIES = {
    "red": ([(False, ["red"])],),
    "blue RED": ([(False, ["red"]), (False, ["blue"])],),
    '"red blue"': ([(False, ["red", "blue"])],),
    '"red red blue" -x1': ([(False, ["red", "red", "blue"]), (True, ["x1"])],),
    "-red": ([(True, ["red"])],),
    "red -blue or grün": ([(False, ["red"]), (True, ["blue"])], [(False, ["grün"])]),
    "well-known": ([(False, "well-known")],),
    '"well-known red"': ([(False, ["well", "known", "red"])],),
    "a.example.com": ([(False, "a.example.com")],),
    "/news/today.html red": ([(False, "/news/today.html"), (False, ["red"])],),
    "/vol1/set -r2-d2": ([(False, "/vol1/set"), (True, "r2-d2")],),
    "nowhere red": ([(False, ["nowhere"])],),
    "red -nowhere": ([(False, ["red"])],),
    "日本語 or me@mail.org": ([(False, ["日本語"])], [(False, "me@mail.org")]),
    "... or": (),
}


@pytest.fixture(scope="module")
def library(spark):
    rng = random.Random(4)
    texts = TEXTS + [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(12))) for _ in range(120)] + ["blue " * 3000 + "well-known red"]
    rows = {i: t for i, t in enumerate(texts)}
    paths = {i: (f"{rng.choice(('IMG', 'video', 'Été'))}_{i}.jpg", f"/vol{i % 3}/Set-{i % 7}/{i}") for i in range(len(texts) + 2)}
    t = {n: spark.createDataFrame([], s) for n, s in TABLES.items()}
    whole = [f.name for f in t["files"].schema]
    t["files"] = spark.createDataFrame([tuple({"id": i, "file_name": n, "abs_path": p, "status": "active", "media_type": "image"}.get(c) for c in whole) for i, (n, p) in paths.items()], TABLES["files"])
    t["search_documents"] = spark.createDataFrame([*rows.items(), (len(texts), None)], TABLES["search_documents"]).repartition(3)
    return t, rows, paths


@pytest.fixture(scope="module")
def index(library, tmp_path_factory):
    return searchindex.build(library[0], str(tmp_path_factory.mktemp("index")))


@pytest.mark.parametrize("query", QUERIES)
def test_search_is_that_of_plain_code(library, index, query):
    t, rows, _ = library
    want = sorted(i for i, text in [*rows.items(), (len(rows), "")] if answers(text, *QUERIES[query]))
    found = sorted(r["file_id"] for r in index.search(query).collect())
    assert found == want
    text = F.col("document_text")
    plain = t["search_documents"].where(search.matches(search.tokens(text), query, search.compounds(text)))
    assert sorted(r["file_id"] for r in plain.collect()) == want


@pytest.mark.parametrize("part", ["red", "RED BLUE", "x", "_", "%", "", "set-3", "e_ kn%wn", "été", "100\\% s", "sure\\_th", "g_zz", "/vol2/", "blue blue", "日本", "jpg", "\\\\ b"])
def test_substrings_are_those_of_ilike(library, index, part):
    t, rows, paths = library
    shape = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c[-1]) for c in re.findall(r"\\.|[^\\]|\\", part))
    has = lambda text: re.search(shape, text.lower(), re.S | re.I) is not None
    want = sorted(i for i, (name, path) in paths.items() if has(name) or has(path) or (i in rows and has(rows[i])))
    assert sorted(r["file_id"] for r in index.containing(t, part).collect()) == want


def test_the_list_finds_by_the_index_what_it_finds_without(library, index):
    t = library[0]
    for query in ("well-known", "img", "red -blue", "nothing at all"):
        o = files.ListOptions(query=query, sort="name_asc", limit=100)
        assert [r["id"] for r in files.list_files(t, o, index).df.collect()] == [r["id"] for r in files.list_files(t, o).df.collect()]


def test_plan_reads_only_the_querys_tokens(index):
    plan = index._rows("postings", searchindex.POSTINGS, [("red",)])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan or "bucket" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert "token" in plan.split("PushedFilters:")[1].split("]")[0]


def test_buckets_are_split_where_they_are_large(library, monkeypatch, tmp_path):
    """A word of most texts then lies in several files, none of which one task alone writes."""
    monkeypatch.setattr(searchindex, "ROWS", 2)
    monkeypatch.setattr(searchindex, "BUCKETS", 2)
    t, rows, _ = library
    own = searchindex.build(t, str(tmp_path / "index"), trigrams=False)
    held = own.spark.read.parquet(f"{own.path}/postings").where("token = 'red'")
    assert held.select(F.input_file_name()).distinct().count() > 4
    assert sorted(r[0] for r in own.search("red").collect()) == sorted(i for i, x in rows.items() if answers(x, [(False, ["red"])]))


def test_empty_library(spark, tmp_path):
    t = {n: spark.createDataFrame([], s) for n, s in TABLES.items()}
    index = searchindex.build(t, str(tmp_path / "none"))
    assert index.search("a").collect() == [] and index.search("-a").collect() == [] and index.containing(t, "abc").collect() == []


def test_no_index_is_built_for_what_it_cannot_narrow(library, monkeypatch):
    from prismara import queries

    def fails(*_, **__):
        raise AssertionError("built")

    monkeypatch.setattr(searchindex, "build", fails)
    t, rows, paths = library
    got = sorted(r["id"] for r in queries.search_wildcards(t).collect())
    shape = re.compile("s.t.*1..\\.m", re.S | re.I)
    assert got == sorted(i for i, (name, path) in paths.items() if any(shape.search(x) for x in (name, path, rows.get(i) or "")))


def test_an_index_is_written_without_a_shuffle_of_its_rows(library, monkeypatch, tmp_path):
    """Texts are dealt, and what each task finds is written by it; trigrams are runs of files."""
    plans = []
    save = searchindex._save
    monkeypatch.setattr(searchindex, "_save", lambda rows, *rest: (plans.append(rows._jdf.queryExecution().executedPlan().toString()), save(rows, *rest)))
    own = searchindex.build(library[0], str(tmp_path / "index"))
    assert len(plans) == 2
    for plan in plans:
        assert "Exchange" not in plan.split("MapInArrow")[0] and "Exchange" in plan.split("MapInArrow")[-1]
    rows = own.spark.read.parquet(f"{own.path}/trigrams").agg(F.count("*"), F.sum(F.size("files"))).first()
    assert rows[0] * 3 < rows[1]
