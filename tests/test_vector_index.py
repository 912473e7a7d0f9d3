"""The kept vector index: recall, what it reads, exactness, upkeep."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import retrieval
from docloom.operators.vector_index import VectorIndex, fitted

TAGS = [("HR", "company", "in_force"), ("DEV", "department", "in_force"), ("HR", "department", "in_force"), ("DEV", "board", "draft")]


def chunk_rows(n, clusters, seed, dims=16, datasets=("en", "de")):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(clusters, dims))
    return [(f"c{seed}-{i:06d}", datasets[i % len(datasets)], *TAGS[i // 3 % 4], (centre[i % clusters] + 0.25 * rng.normal(size=dims)).astype(float).tolist()) for i in range(n)], centre


SCHEMA = "id string, dataset_id string, department string, scope string, status string, embedding array<float>"
ASKED = "query_id long, question string, vector array<float>, dataset_id string, is_admin boolean, department string"


def found(df):
    return {(r.query_id, r.rank): (r.id, round(r.score, 9)) for r in df.collect()}


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rows, centre = chunk_rows(12_000, 60, 1)
    chunks = spark.createDataFrame(rows, SCHEMA).repartition(4)
    rng = np.random.default_rng(5)
    asked = [(i, "q", (centre[i * 7 % 60] + 0.3 * rng.normal(size=16)).tolist(), ("en", "de")[i % 2], i % 5 == 0, ("DEV", None, "HR")[i % 3]) for i in range(6)]
    queries = spark.createDataFrame(asked, ASKED)
    index = VectorIndex(spark, f"file://{tmp_path_factory.mktemp('index')}").build(chunks)
    return index, chunks, queries


def test_recall_and_bytes_read(made):
    index, chunks, queries = made
    exact, got = found(retrieval.knn(queries, chunks)), found(index.search(queries))
    ids = lambda x, q: {v[0] for k, v in x.items() if k[0] == q}
    recall = np.mean([len(ids(exact, q) & ids(got, q)) / len(ids(exact, q)) for q in range(6)])
    assert recall >= 0.9, recall
    size = lambda df: df.select("_metadata.file_path", "_metadata.file_size").distinct().agg(F.sum("file_size")).first()[0]
    for q in range(6):  # a question alone
        plan = index.plan(queries.where(F.col("query_id") == q)).where("before < 240")
        there = index.rows._rows(index.rows.manifest(), index.rows.manifest().folders)
        assert size(there.where(_filter(index, plan))) < size(there) / 3


def _filter(index, plan):
    from docloom.operators.vector_index import _among

    return _among({tuple(r) for r in plan.select("q_dataset", "cell").distinct().collect()})


def test_candidates_are_those_one_may_see(made):
    """Each question looks at 240 vectors that it may see, or all."""
    index, chunks, queries = made
    plan = index.plan(queries).where("before < 240")
    seen = index._scored(plan).groupBy("query_id").count().collect()
    assert len(seen) == 6 and all(r["count"] >= 240 for r in seen)


def test_exact_search_is_exact(made):
    index, chunks, queries = made
    want = found(retrieval.knn(queries, chunks))
    assert found(index.search(queries, exact=True)) == want
    assert found(index.search(queries, candidates=1, exact=True)) == want


def test_upkeep(spark, tmp_path):
    rows, centre = chunk_rows(1500, 20, 2)
    chunks = spark.createDataFrame(rows, SCHEMA)
    queries = spark.createDataFrame([(i, "q", centre[i].tolist(), ("en", "de")[i % 2], True, None) for i in range(4)], ASKED)
    index = VectorIndex(spark, f"file://{tmp_path}").build(chunks)
    fresh, _ = chunk_rows(60, 20, 3)
    moved = [(rows[i][0], rows[i][1], *TAGS[0], rows[(i + 7) % 100][5]) for i in range(30)]
    emptied = [(rows[i][0], rows[i][1], *TAGS[0], v) for i, v in ((40, []), (41, None), (42, [0.0] * 16), (43, [float("nan")] * 16))]
    odd = [("odd", "en", *TAGS[0], [1.0, 2.0]), ("none", None, *TAGS[0], rows[0][5]), ("other", "fr", *TAGS[0], rows[0][5])]
    changes = spark.createDataFrame([*fresh, *moved, *emptied, *odd], SCHEMA)
    before = set(index.rows.manifest().folders)
    index.upsert(changes)
    now = chunks.join(changes, "id", "left_anti").unionByName(changes.where("id <> 'c2-000043'"))  # not a number: exact search takes it as the greatest
    assert found(index.search(queries, exact=True)) == found(retrieval.knn(queries, now))
    assert index.rows.read().count() == 1500 + 60 - 4 + 3
    index.delete(now.where("id like 'c2-0001%'").select("id"))
    now = now.where("id not like 'c2-0001%'")
    assert found(index.search(queries, exact=True)) == found(retrieval.knn(queries, now))
    two = spark.createDataFrame([(9, "q", [2.0, 1.0], "en", True, None), (10, "q", rows[0][5], "fr", True, None), (11, "q", [], "en", True, None)], ASKED)
    assert found(index.search(two, exact=True)) == found(retrieval.knn(two, now))
    # One vector of one cell: one folder of many is written anew.
    folders = set(index.rows.manifest().folders)
    index.upsert(spark.createDataFrame([rows[700]], SCHEMA))
    assert len(folders - set(index.rows.manifest().folders)) == 1 and len(before) > 10


def test_cells_and_counts_agree(made):
    index, chunks, _ = made
    want = {(r.dataset_id, r.n) for r in chunks.groupBy("dataset_id").agg(F.count("*").alias("n")).collect()}
    assert {(r.dataset_id, r.n) for r in index.cells.read().groupBy("dataset_id").agg(F.sum("n").alias("n")).collect()} == want
    assert 100 < index.centroids.read().count() <= 12_000 / 64 + 1


def test_fitting_of_equal_and_few_vectors():
    assert len(fitted(np.ones((3, 4)), 10)) == 3
    assert np.isfinite(fitted(np.ones((50, 4)), 8)).all()


def test_empty_table(spark, made, tmp_path):
    _, chunks, queries = made
    index = VectorIndex(spark, f"file://{tmp_path}").build(chunks.where("false"))
    assert index.search(queries, exact=True).count() == 0
    index.upsert(chunks.where("id < 'c1-000005'"))
    assert index.search(queries, exact=True).count() > 0
