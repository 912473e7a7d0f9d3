"""Tables in versions: what a write touches, what readers see, what is kept."""

import threading

import pytest
from pyspark.sql import functions as F

from docloom.operators import versioned as V


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def made(spark, tmp_path):
    rows = [(f"d{d}", c, f"text {d} {c}", ("in_force", "draft")[d % 2]) for d in range(40) for c in range(5)]
    df = spark.createDataFrame(rows, "document_id string, chunk_no int, content string, status string").withColumn("_bucket", V.chunk_bucket(8))
    t = V.VersionedTable(spark, f"file://{tmp_path}/t")
    assert t.version() == 0
    t.create(df, ["document_id", "chunk_no"], ["status", "_bucket"], "_bucket")
    return t, df


def test_an_update_of_one_document_rewrites_one_partition(made):
    t, df = made
    before = t.manifest()
    t.update(F.col("document_id") == "d7", content=F.lit("new"))
    after = t.manifest()
    assert len(set(before.folders) - set(after.folders)) == 1 and len(set(after.folders) - set(before.folders)) == 1
    want = df.withColumn("content", F.when(F.col("document_id") == "d7", "new").otherwise(F.col("content")))
    assert rows_of(t.read()) == rows_of(want.select(t.read().columns)) and rows_of(t.read(1)) == rows_of(df.select(t.read().columns))


def test_a_tag_that_moves_rows(made):
    """The rows leave one partition for another; the other's files stay."""
    t, df = made
    before = t.manifest()
    t.update(F.col("document_id") == "d2", status=F.lit("draft"))
    gone, come = set(before.folders) - set(t.manifest().folders), set(t.manifest().folders) - set(before.folders)
    assert len(gone) == 1 and "status=in_force" in next(iter(gone)) and len(come) <= 2 and any("status=draft" in f for f in come)
    assert t.read().count() == 200 and t.read().where("document_id = 'd2' and status = 'draft'").count() == 5


def test_merge_against_loops(made, spark):
    t, df = made
    new = [("d3", 0, "x", "expired"), ("d3", 9, "y", "in_force"), ("new", 0, "z", "draft"), (None, None, "null key", None), ("odd {a}*[b]/c %20 é", 0, "o", "odd {a}*[b]/c %20 é")]
    up = spark.createDataFrame(new, "document_id string, chunk_no int, content string, status string").withColumn("_bucket", V.chunk_bucket(8))
    held = {(r.document_id, r.chunk_no): (r.content, r.status) for r in df.collect()}
    for _ in range(2):
        t.merge(up, df.where("document_id in ('d5', 'd6')"))
        held = {k: v for k, v in held.items() if k[0] not in ("d5", "d6")} | {(d, c): (x, s) for d, c, x, s in new}
        assert {(r.document_id, r.chunk_no): (r.content, r.status) for r in t.read().collect()} == held and t.read().count() == len(held)
    up = up.withColumn("content", F.lit("again"))
    t.merge(up)
    held |= {(d, c): ("again", s) for d, c, _, s in new}
    assert {(r.document_id, r.chunk_no): (r.content, r.status) for r in t.read().collect()} == held and t.read().count() == len(held)
    version = t.version()
    assert t.merge(deletes=df.where("false")) == version and t.delete(F.lit(False)) == version
    t.delete(F.lit(True))
    assert t.read().count() == 0 and t.read(version).count() == len(held)
    t.merge(up)
    assert t.read().count() == len(new)


def test_readers_see_the_old_or_the_new(made):
    t, df = made
    seen, stop = [], threading.Event()

    def reader():
        while not stop.is_set():
            seen.append({r.content for r in t.read().where("document_id = 'd1'").select("content").distinct().collect()})

    thread = threading.Thread(target=reader)
    thread.start()
    for i in range(4):
        t.update(F.col("document_id") == "d1", content=F.lit(f"step {i}"))
    stop.set()
    thread.join()
    assert seen and all(len(x) == 1 or x == {f"text 1 {c}" for c in range(5)} for x in seen)


def test_of_two_writers_one_fails(made):
    t, df = made
    m = t.manifest()
    m.version += 1
    t._commit(m)
    with pytest.raises(V.Conflict):
        t._commit(m)
    assert t.version() == 2 and t.read().count() == 200


def test_only_partitions_of_the_keys_are_looked_into(made, spark):
    """Keys of one bucket: other buckets' files are not read for the merge."""
    t, df = made
    one = df.where("document_id = 'd7'").withColumn("content", F.lit("q"))
    bucket = one.first()["_bucket"]
    t.merge(one)
    fresh = {f for f in t.manifest().folders if f.startswith("v=2")}
    assert fresh and all(f"_bucket={bucket}" in f for f in fresh)


def test_compact_and_vacuum(made, spark):
    t, df = made
    for i in range(5):
        t.merge(df.where("document_id = 'd1'").limit(1).withColumns({"document_id": F.lit("d1"), "chunk_no": F.lit(100 + i)}))
    want = rows_of(t.read())
    parts = lambda: [f.partition("/")[2] for f in t.manifest().folders]
    assert len(parts()) > len(set(parts()))
    t.compact(most=1)
    assert len(parts()) == len(set(parts())) and rows_of(t.read()) == want
    assert t.vacuum(keep=1)
    assert rows_of(t.read()) == want and t.vacuum(keep=1) == []
    with pytest.raises(Exception):
        t.read(1)


def test_a_long_document_lies_in_several_buckets(spark):
    rows = spark.range(20_000).select(F.lit("d").alias("document_id"), F.col("id").cast("int").alias("chunk_no"))
    assert rows.select(V.chunk_bucket(64)).distinct().count() > 3
