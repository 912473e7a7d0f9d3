"""The versioned chunk store: changes of one document, access by folders, ingestion of what changed."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from docloom.operators import store as plain
from docloom.operators.acl import Viewer, visible
from docloom.operators.chunk_store import ChunkStore, differences, longest_rise
from docloom.operators.versioned import chunk_bucket
from docloom.schemas import DEPARTMENTS, SCOPES, STATUSES

SCHEMA = "id string, document_id string, chunk_no int, content string, dataset_id string, document_name string, department string, doc_type string, scope string, status string, embedding array<float>"
EMBED = lambda c: F.array(F.char_length(c).cast("float"))


def rows_of(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


@pytest.fixture
def made(spark, tmp_path):
    rows = [(f"{d}-{c}", f"d{d:02d}", c, f"text {d} {c % 7}", ("en", "de")[d % 2], f"D{d}", DEPARTMENTS[d % 5], "policy", SCOPES[d % 3], STATUSES[d % 3], [float(d), float(c)]) for d in range(24) for c in range(12)]
    chunks = spark.createDataFrame(rows, SCHEMA)
    return ChunkStore(spark, f"file://{tmp_path}/s").create(chunks, buckets=16), chunks


def folders(store):
    return set(store.table.manifest().folders)


def test_changes_equal_those_of_whole_tables(made):
    store, chunks = made
    before = folders(store)
    store.set_tag("d03", "department", "HR")
    assert len(before - folders(store)) == 1
    want = plain.set_tag(chunks, "d03", "department", "HR")
    assert rows_of(store.read()) == rows_of(want)
    before = folders(store)
    store.delete_document("d05")
    assert len(before - folders(store)) == 1
    want = plain.delete_where(want, F.col("document_id") == "d05")
    assert rows_of(store.read()) == rows_of(want)
    version = store.table.version()
    store.set_tag("d03", "department", "HR")  # as it is: nothing is written
    store.delete_document("none")
    assert store.table.version() == version
    with pytest.raises(ValueError):
        store.set_tag("d03", "department", "nobody")
    new = chunks.where("document_id = 'd07'").withColumn("content", F.lit("n"))
    store.replace_documents(new.where("chunk_no < 3"), new)
    want = want.where("document_id <> 'd07'").unionByName(new.where("chunk_no < 3"))
    assert rows_of(store.read()) == rows_of(want)


def test_access_by_folders(made, spark):
    store, chunks = made
    viewers = spark.createDataFrame([("a", "en", True, None), ("b", "en", False, "DEV"), ("c", "de", False, None), ("d", "de", False, "HR"), ("e", None, True, "HR"), ("f", "xx", True, None), ("g", "en", None, "BA")], "username string, dataset_id string, is_admin boolean, department string")
    got = store.visible_to_each(viewers)
    have = {(r.username, r.id) for r in got.collect()}
    want = {(v.username, r.id) for v in viewers.collect() if v.dataset_id for r in chunks.where(visible(Viewer(v.dataset_id, bool(v.is_admin), v.department))).collect()}
    assert have == want and want
    for v in (Viewer("en", True), Viewer("de", False, "TEST"), Viewer("zz", True)):
        assert rows_of(store.scan(v)) == rows_of(chunks.where(visible(v)))
    plan = store.scan(Viewer("en", False, "DEV"))._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "status" in plan.split("PartitionFilters")[1][:400]


def test_dynamic_pruning_by_the_viewers_table(made, spark, tmp_path):
    store, _ = made
    spark.createDataFrame([(f"u{i}", ("en", "de", "fr")[i % 3], i % 4 == 0, DEPARTMENTS[i % 5]) for i in range(60)], "username string, dataset_id string, is_admin boolean, department string").write.parquet(f"{tmp_path}/users")
    viewers = spark.read.parquet(f"{tmp_path}/users").where("username in ('u4', 'u5', 'u7')")
    df = store.visible_to_each(viewers)
    df.collect()
    plan = df._jdf.queryExecution().toString()
    assert plan.count("dynamicpruning") >= 2 and "status" in plan


def brute(old, new):
    from collections import defaultdict

    out, places = set(), defaultdict(list)
    same = {n for n, t in old if (n, t) in new}
    for n, t in old:
        if n not in same:
            places[t].append(n)
    pairs, used = [], set()
    for n, t in new:
        if n in same:
            used.add(n)
            pairs.append((n, n))
        elif places[t]:
            o = places[t].pop(0)
            used.add(o)
            pairs.append((n, o))
        else:
            out.add(("added", None, n))
    out |= {("removed", n, None) for n, _ in old if n not in used}
    kept = longest_rise([o for _, o in pairs])
    return out, pairs, sum(kept)


def test_differences_against_loops(spark):
    rnd = random.Random(1)
    olds, news, cases = [], [], {}
    for d in range(40):
        old = [(i, rnd.choice("abcdefghijklmnop")) for i in range(rnd.randint(0, 14))]
        texts = [t for _, t in old]
        for _ in range(rnd.randint(0, 4)):
            if texts and rnd.random() < 0.6:
                t = texts.pop(rnd.randrange(len(texts)))
                if rnd.random() < 0.6:
                    texts.insert(rnd.randint(0, len(texts)), t)
            else:
                texts.insert(rnd.randint(0, len(texts)), rnd.choice("abcxyz"))
        new = list(enumerate(texts))
        cases[f"d{d}"] = (old, new)
        olds += [(f"d{d}", *x) for x in old]
        news += [(f"d{d}", *x) for x in new]
    schema = "document_id string, chunk_no int, content string"
    got: dict = {}
    for r in differences(spark.createDataFrame(olds, schema), spark.createDataFrame(news, schema)).collect():
        got.setdefault(r.document_id, []).append((r.kind, r.old_no, r.new_no))
    moved = 0
    for d, (old, new) in cases.items():
        rest, pairs, n_kept = brute(old, new)
        own = got.get(d, [])
        assert {x for x in own if x[0] in ("added", "removed")} == rest
        assert {(n, o) for k, o, n in own if k in ("kept", "moved")} == set(pairs)
        kept = sorted((n, o) for k, o, n in own if k == "kept")
        assert len(kept) == n_kept and all(a[1] < b[1] for a, b in zip(kept, kept[1:]))
        moved += sum(k == "moved" for k, *_ in own)
    assert moved > 5


def test_longest_rise():
    rnd = random.Random(2)
    for _ in range(200):
        x = rnd.sample(range(30), rnd.randint(0, 8))
        got = [v for v, k in zip(x, longest_rise(x)) if k]
        best = max((len(c) for n in range(len(x) + 1) for c in combinations(x, n) if list(c) == sorted(c)), default=0)
        assert got == sorted(got) and len(got) == best


def test_one_edited_paragraph_writes_one_chunk(made, spark):
    store, chunks = made
    doc = chunks.where("document_id = 'd09'").select("id", "document_id", "chunk_no", "content")
    fresh = doc.withColumn("content", F.when(F.col("chunk_no") == 4, F.lit("edited")).otherwise(F.col("content")))
    before = folders(store)
    diff = {(r.kind, r.old_no, r.new_no) for r in store.reingest(fresh, EMBED).where("kind <> 'kept'").collect()}
    assert diff == {("removed", 4, None), ("added", None, 4)}
    new = [f for f in folders(store) - before]
    assert len(before - folders(store)) == 1 and len(new) == 1
    got = {r.chunk_no: (r.content, r.embedding, r.department, r.status) for r in store.read().where("document_id = 'd09'").collect()}
    assert got[4][0] == "edited" and got[4][1] == [6.0] and got[4][2:] == got[3][2:] and len(got) == 12
    assert all(got[c][1] == [9.0, float(c)] for c in range(12) if c != 4)


def test_moved_chunks_keep_their_vectors(made):
    """A paragraph put in front: all numbers change, one text is embedded."""
    store, chunks = made
    doc = chunks.where("document_id = 'd11'").select("id", "document_id", "chunk_no", "content")
    fresh = doc.withColumn("chunk_no", F.col("chunk_no") + 1).unionByName(doc.limit(1).selectExpr("'x' id", "document_id", "0 chunk_no", "'in front' content"))
    store.reingest(fresh, EMBED)
    got = {r.chunk_no: (r.content, r.embedding) for r in store.read().where("document_id = 'd11'").collect()}
    assert got[0] == ("in front", [8.0]) and all(got[c + 1][1] == [11.0, float(c)] for c in range(12))
    store.reingest(fresh.where("chunk_no in (0, 5)").withColumn("chunk_no", F.when(F.col("chunk_no") == 5, 1).otherwise(0)), EMBED)
    assert {r.chunk_no: r.content for r in store.read().where("document_id = 'd11'").collect()} == {0: "in front", 1: "text 11 4"}
    assert store.read().where("document_id = 'd10'").count() == 12


def test_differences_of_a_long_document_take_no_shrinking_frames(spark):
    """A frame up to the end is gone through anew for each row: quadratic in a document's chunks."""
    rows = spark.range(2000).select(F.lit("d").alias("document_id"), F.col("id").cast("int").alias("chunk_no"), F.col("id").cast("string").alias("content"))
    got = differences(rows, rows.withColumn("chunk_no", 1999 - F.col("chunk_no")))
    assert "unboundedfollowing" not in got._jdf.queryExecution().analyzed().toString().lower()
    assert {r.kind: r["count"] for r in got.groupBy("kind").count().collect()} == {"moved": 1999, "kept": 1}


def test_a_change_of_a_long_document_leaves_most_buckets(spark, tmp_path):
    """However long its documents are, what a change writes doesn't grow beyond their own few buckets."""
    rows = spark.range(60_000).select((F.col("id") % 2).cast("string").alias("document_id"), F.col("id").cast("int").alias("chunk_no"), F.lit("x").alias("content"), F.lit("en").alias("dataset_id"), F.lit("HR").alias("department"), F.lit("draft").alias("status"))
    store = ChunkStore(spark, f"file://{tmp_path}/long").create(rows, buckets=64)
    before = folders(store)
    store.delete_document("1")
    assert store.read().count() == 30_000 and len(before - folders(store)) <= 4
    store.upsert(rows.where("chunk_no = 59998").withColumn("content", F.lit("new")))
    assert store.read().where("content = 'new'").count() == 1 and store.read().count() == 30_000


def test_a_store_laid_out_without_a_spread_is_kept(spark, tmp_path):
    rows = spark.range(60_000).select(F.lit("d").alias("document_id"), F.col("id").cast("int").alias("chunk_no"), F.lit("x").alias("content"), F.lit("en").alias("dataset_id"), F.lit("draft").alias("status"))
    store = ChunkStore(spark, f"file://{tmp_path}/old")
    store.table.create(rows.withColumn("_bucket", chunk_bucket(64, spread=None)), ["document_id", "chunk_no"], ["dataset_id", "status", "_bucket"], "_bucket", buckets=64)
    store.upsert(rows.where("chunk_no % 5000 = 0").withColumn("content", F.lit("new")))
    assert store.read().count() == 60_000 and store.read().where("content = 'new'").count() == 12
    store.delete_document("d")
    assert store.read().count() == 0
