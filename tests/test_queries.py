import subprocess
import sys
from datetime import datetime, timedelta

from prismara import queries, queries_rules  # noqa: F401  the second adds its own to those of the first
from prismara.schema import TABLES

from .conftest import ROOT

T0 = datetime(2024, 1, 1, 12)


def tags_of(text):
    """By plain code: the three constant tags' names and then the distinct words, five at most."""
    out = ["双人", "自拍", "露脸"]
    for x in text.lower().split(" "):
        x = x.strip(".,").strip(" ")
        if x and "/" not in x and "\\" not in x and x not in out:
            out.append(x)
    return out[:5]


def test_tags_come_from_the_whole_text(spark):
    texts = ["Ating. Ating. Ating. Ating. Ating. Ating. Ating. Boro, cere", "one " * 30 + "two", "a/b " * 9 + "c d e", "x", "v w"]
    t = {"search_documents": spark.createDataFrame(list(enumerate(texts)), "file_id long, document_text string")}
    got = {i: [] for i in range(len(texts))}
    for r in sorted(queries.tag_normalisation(t).collect(), key=lambda r: (r["file_id"], r["n"])):
        got[r["file_id"]].append(r["name"])
    assert got == {i: tags_of(x) for i, x in enumerate(texts)}


def test_distances_are_rounded_for_pairs_of_distinct_vectors(spark):
    """Once for each pair of distinct vectors, and not for each pair of rows that leaves the last join."""
    vectors = [[0.1, 0.1]] * 3 + [[0.1, 0.1234567]] * 2 + [[0.9, 0.9]]
    rows = [(i, "image_visual", "m", v) for i, v in enumerate(vectors)]
    t = {"embeddings": spark.createDataFrame(rows, "id long, embedding_type string, model_name string, vector array<double>")}
    got = queries.embedding_range_pairs(t)
    assert "round(" not in got._jdf.queryExecution().optimizedPlan().toString()
    near = {(a, b): 0.0 if (a < 3) == (b < 3) else 0.023457 for a in range(5) for b in range(5) if a != b}
    assert {(r["a_id"], r["b_id"]): r["distance"] for r in got.collect()} == near


def test_person_clusters_count_near_vectors(spark):
    rows = {
        "files": [(i, 1, f"/{p}/{n}", f"/{p}", n, ".jpg", "image", 5, T0 + timedelta(days=30 * i), None, None, "active", T0) for i, p, n in ((1, "p", "ann.jpg"), (2, "q", "bob.jpg"), (3, "r", "cid.jpg"))],
        "tags": [(1, "person", "someone", "someone", False, False)],
        "file_tags": [(i, 1, "human", 1.0, None) for i in (1, 2, 3)],
    }
    t = {name: spark.createDataFrame(rows.get(name, []), schema) for name, schema in TABLES.items()}
    names = [f.name for f in t["embeddings"].schema]
    vectors = [{"id": i, "file_id": i, "embedding_type": "image_visual", "model_name": "m", "vector": v} for i, v in ((1, [0.1, 0.1]), (2, [0.1, 0.12]), (3, [0.9, 0.9]))]
    t["embeddings"] = spark.createDataFrame([tuple(v.get(n) for n in names) for v in vectors], TABLES["embeddings"])
    score = {(r["anchor_id"], r["file_id"]): r["score"] for r in queries.person_clusters(t).collect()}
    # A human tag has 0.86 points, and 0.18 more, of 0.99 at most, for a near vector.
    mean = lambda a, b: sum(abs(x - y) for x, y in zip(a["vector"], b["vector"], strict=True)) / 2
    want = {(a["id"], b["id"]): 1.0 if a is b else round(min(0.86 + 0.18 * (mean(a, b) <= 0.08), 0.99), 2) for a in vectors for b in vectors}
    assert score == want


def test_the_entry_loads_whatever_the_document_operators_lack():
    code = "import sys; sys.modules[{!r}] = None; import __spark_entry__ as e; assert 'list_files_default' in e.queries() and 'list_files_default' in e.oracle_sql() and 'pipeline' not in e.queries()"
    for missing in ("xxhash", "prismara.llm", "corpus_pipeline"):
        subprocess.run([sys.executable, "-c", code.format(missing)], check=True, cwd=ROOT)


def test_every_query_has_its_sql():
    assert set(queries.QUERIES) == set(queries.ORACLES)


def test_all_events_of_a_job_are_listed(spark):
    events = [(i, 5 if i < 50 else 6, "info", "m", T0 + timedelta(minutes=i)) for i in range(60)]
    t = {"job_events": spark.createDataFrame(events, "id long, job_id long, level string, message string, created_at timestamp")}
    assert sorted(r["id"] for r in queries_rules.job_events_of_one(t).collect()) == list(range(50))
