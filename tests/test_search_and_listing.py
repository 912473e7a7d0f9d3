"""Signatures for substring search; paged listings."""

import json
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from docloom.operators import store
from docloom.operators.text_index import SubstringIndex
from docloom.operators.versioned import VersionedTable, bucket_of
from docloom.sources import listing


@pytest.fixture
def made(spark, tmp_path):
    rnd = random.Random(1)
    words = ["lorem", "ipsum", "dolor", "amet", "Éclair", "STRASSE", "a+b%c", "日本語テキスト"]
    rows = [(f"r{i:04d}", i % 40, " ".join(rnd.choices(words, k=30)) + (f" only{i % 40}here" if i % 7 == 0 else "")) for i in range(800)] + [("null", 3, None), ("empty", 4, ""), ("two", 5, "zq"), ("long", 6, "x" * (1 << 20) + "needle" + "y" * 100_000)]
    df = spark.createDataFrame(rows, "id string, part int, content string").withColumn("_bucket", bucket_of(8, F.col("id")))
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    t.create(df, ["id"], ["part", "_bucket"], "_bucket")
    return t, df, SubstringIndex(t, f"file://{tmp_path}/signatures")


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_search_equals_reading_all_and_skips_folders(made):
    t, df, index = made
    assert index.folders("lorem") == t.manifest().folders  # no signatures yet
    index.refresh()
    everything = len(t.manifest().folders)
    for q in ("only7here", "ONLY13HERE", "needle", "LoReM ipsum", "éclair", "ÉCLAIR", "日本", "語テ", "zq", "q", "", "nowhere at all", "b%c", "strasse"):
        assert ids(index.search(q)) == ids(store.content_search(df, q)), q
    assert 0 < len(index.folders("only7here")) < everything / 4 and index.folders("nowhere at all") == [] and len(index.folders("needle")) == 1
    assert index.folders("zq") == t.manifest().folders


def test_new_folders_are_read_until_taken_in(made, spark):
    t, df, index = made
    index.refresh()
    new = spark.createDataFrame([("new1", 50, "brandnew text"), ("r0007", 7, "changed to brandnew")], "id string, part int, content string").withColumn("_bucket", bucket_of(8, F.col("id")))
    t.merge(new)
    now = t.read()
    for _ in range(2):
        for q in ("brandnew", "only7here", "lorem"):
            assert ids(index.search(q)) == ids(store.content_search(now, q))
        index.refresh()
    version = index.signatures.version()
    assert index.refresh().signatures.version() == version and len(index.folders("brandnew")) == 2


@pytest.fixture
def service():
    docs = [{"id": f"d{i}", "name": f"n{i}.txt", "size": i, "run": "DONE", "progress": 0.5} for i in range(257)]
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            from urllib.parse import parse_qs, urlparse

            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            page, size = int(q["page"]), int(q["page_size"])
            seen.append((page, size, self.headers.get("Authorization")))
            if page == 3 and sum(s[0] == 3 for s in seen) == 1:  # busy once
                self.send_response(503)
                self.end_headers()
                return
            body = {"code": 0, "data": {"docs": docs[(page - 1) * size : page * size], "total": len(docs)}}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/api/v1/datasets/x/documents", seen
    server.shutdown()


def test_pages_of_a_service_are_partitions(spark, service):
    url, seen = service
    spark.dataSource.register(listing.ListingSource)
    pages = spark.read.format("listing").option("url", url).option("token", "t").option("page_size", 50).load()
    assert pages.rdd.getNumPartitions() == 6
    got = listing.documents_of(pages).orderBy("size").collect()
    assert [r.id for r in got] == [f"d{i}" for i in range(257)] and got[60].page == 2 and (got[0].type, got[0].chunk_count, got[0].progress) == ("", 0, 0.5)
    assert all(s[2] == "Bearer t" for s in seen) and (6, 50, "Bearer t") in seen


def test_odd_responses(spark):
    bodies = [(1, '{"code":0,"data":{"docs":[{"id":"a","name":"b","size":"12x","chunk_count":1.5,"progress":"none"},{"name":"no id"}]}}'), (2, "not json"), (3, None), (4, '{"code":102,"message":"no rights","data":false}'), (5, '{"code":0,"data":{}}')]
    df = spark.createDataFrame(bodies, "page int, body string")
    (r,) = listing.documents_of(df).collect()
    assert (r.id, r.size, r.chunk_count, r.progress, r.run) == ("a", 0, 0, 0.0, "UNSTART")
    assert {(r.page, r.code) for r in listing.errors_of(df).collect()} == {(2, -1), (3, -1), (4, 102)}


def test_keyset_pages_read_no_rows_before_them(spark, tmp_path):
    """All pages in turn are the whole; a late page reads as few row groups as the first."""
    rows = spark.range(5000).select((F.col("id") % 70).alias("a"), F.col("id").alias("b"), F.lit("x" * 50).alias("t"))
    rows.repartitionByRange(8, "a", "b").sortWithinPartitions("a", "b").write.option("parquet.block.size", 4096).parquet(f"{tmp_path}/r")
    there = spark.read.parquet(f"{tmp_path}/r")
    after, got = None, []
    while (page := store.page_after(there, 700, ["a", "b"], after).collect()):
        got += [(r.a, r.b) for r in page]
        after = (page[-1].a, page[-1].b)
    assert got == sorted((r.a, r.b) for r in there.collect())
    assert store.cursor_of(store.page_after(there, 10, ["a", "b"]), ["a", "b"]) == got[9]
    assert store.cursor_of(there.where("false"), ["a"]) is None
    late = store.page_after(there, 5, ["a", "b"], got[4900])
    assert "GreaterThanOrEqual(a," in late._jdf.queryExecution().toString()
