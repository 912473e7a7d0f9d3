"""Operators on hand-made rows and against plain Python."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from docloom.functions import metrics, text
from docloom.operators import chunking, conversations, elements, forms, retrieval, store
from docloom.sources import files
from docloom.streaming import ingest


def test_min_max_of_one_and_of_equal_hits_is_half(spark):
    hits = spark.createDataFrame([(1, "a", 3.0, 1), (2, "a", 2.0, 1), (2, "b", 2.0, 2), (3, "a", 5.0, 1), (3, "b", 1.0, 2)], "query_id long, id string, score double, rank int")
    got = {(r.query_id, r.id): r.vec for r in retrieval.scaled(hits, "vec").collect()}
    assert got == {(1, "a"): 0.5, (2, "a"): 0.5, (2, "b"): 0.5, (3, "a"): 1.0, (3, "b"): 0.0}
    assert retrieval.scaled(hits.limit(0), "vec").count() == 0


def test_fusion_thresholds_before_rounding_and_breaks_ties_by_neighbour_rank(spark):
    hits = spark.createDataFrame([(1, "a", 0.2857, 0.0, 2, None), (1, "b", 0.28570, 0.0, 1, None), (1, "c", 0.0, 0.6667, None, 1), (1, "d", 0.2856, 0.0, 3, None), (1, "e", 0.28571429, 0.0, 4, None)], "query_id long, id string, vec double, bm25 double, vec_rank int, bm25_rank int")
    got = retrieval.fuse(hits, F.lit(0.3)).orderBy("rank").collect()
    assert [r.id for r in got] == ["c", "e"]
    tied = spark.createDataFrame([(1, "z", 1.0, 0.0, 1, None), (1, "a", 1.0, 0.0, 2, None)], "query_id long, id string, vec double, bm25 double, vec_rank int, bm25_rank int")
    assert [r.id for r in retrieval.fuse(tied, F.lit(0.0)).orderBy("rank").collect()] == ["z", "a"]


def test_retrieval_sees_only_what_the_viewer_may(spark):
    rows = [("1", "ds", "HR", "company", "in_force"), ("2", "ds", "DEV", "department", "in_force"), ("3", "ds", "HR", "department", "in_force"), ("4", "ds", "DEV", "company", "draft"), ("5", "other", "DEV", "company", "in_force")]
    chunks = spark.createDataFrame([(*r, "word here", [1.0, 0.0]) for r in rows], "id string, dataset_id string, department string, scope string, status string, content string, embedding array<float>")
    ask = lambda admin, dept: spark.createDataFrame([(1, "word", [1.0, 0.1], "ds", admin, dept)], "query_id long, question string, vector array<float>, dataset_id string, is_admin boolean, department string")
    seen = lambda q: ({r.id for r in retrieval.knn(q, chunks).collect()}, {r.id for r in retrieval.bm25(q, chunks).collect()})
    assert seen(ask(False, "DEV")) == ({"1", "2"}, {"1", "2"})
    assert seen(ask(True, None)) == ({"1", "2", "3", "4"},) * 2
    assert seen(ask(False, " ")) == ({"1"},) * 2


def python_collapse(rows):
    out, i = [], 0
    while i < len(rows):
        if i + 2 < len(rows) and rows[i][0] == "user" and rows[i + 2][0] == "user" and rows[i][1] == rows[i + 2][1]:
            i += 2
            continue
        out.append(i)
        i += 1
    return out


def test_collapse_against_the_loop(spark):
    rnd = random.Random(3)
    sessions = {s: [(rnd.choice(["user", "user", "assistant"]), rnd.choice("ab")) for _ in range(rnd.randint(0, 12))] for s in range(400)}
    df = spark.createDataFrame([(s, i, r, c) for s, rows in sessions.items() for i, (r, c) in enumerate(rows)], "session_id int, turn int, role string, content string")
    got: dict = {}
    for r in conversations.collapse_regenerations(df).collect():
        got.setdefault(r.session_id, []).append(r.turn)
    for s, rows in sessions.items():
        assert sorted(got.get(s, [])) == python_collapse(rows), rows


def python_chunks(els, ceiling):
    out, header, buf = [], None, []

    def flush():
        body = "\n\n".join(t.strip() for t in buf if t and t.strip())
        if body:
            out.append(f"## {header}\n\n{body}" if header is not None else body)
        buf.clear()

    for category, t in els:
        if category in chunking.DROPPED:
            continue
        if category in chunking.HEADERS:
            flush()
            header = t.strip() if t is not None else None
        else:
            buf.append(t)
            if sum(len(x or "") for x in buf) >= ceiling:
                flush()
    flush()
    return out


def test_layout_chunks_against_a_fold(spark):
    rnd = random.Random(5)
    kinds = ["Text", "Text", "Text", "ListItem", "SectionHeader", "PageHeader", "Picture"]
    docs = {f"d{i}": [(rnd.choice(kinds), rnd.choice([None, " ", "x" * rnd.randint(1, 5000), "short one"])) for _ in range(rnd.randint(0, 30))] for i in range(60)}
    df = spark.createDataFrame([(d, i, c, t) for d, els in docs.items() for i, (c, t) in enumerate(els)], "document_id string, ord int, category string, text string").select("*", F.lit(1).alias("page"), elements.box(0, 0, 1, 1).alias("bbox"))
    got: dict = {}
    for r in chunking.layout_chunks(df).orderBy("document_id", "chunk_no").collect():
        got.setdefault(r.document_id, []).append(r.content)
    assert got == {d: c for d, els in docs.items() if (c := python_chunks(els, chunking.CEILING))}


def test_long_documents_are_cut_by_doubled_steps(spark, monkeypatch):
    """Stretches of some hundred chunks, elements of no length at the cuts, an element longer than a chunk; without Python."""
    monkeypatch.setattr(chunking, "CEILING", 100)
    rnd = random.Random(6)
    docs = {f"d{i}": [(rnd.choice(["Text"] * 60 + ["SectionHeader", "Picture"]), rnd.choice([None, "", "  ", "y" * 100, "x" * rnd.randint(1, 30), "x" * rnd.randint(1, 30), "z" * 250])) for _ in range(rnd.choice([1, 5, 900]))] for i in range(12)}
    docs["one"] = [("Text", "x" * 50)] * 700
    docs[None] = [("Text", "x" * 99), ("Text", "x"), ("Text", "after")]
    rows = [(d, i, c, t) for d, els in docs.items() for i, (c, t) in enumerate(els)]
    df = spark.createDataFrame(rows, "document_id string, ord int, category string, text string").select("*", F.col("ord").alias("page"), F.when(F.col("ord") % 3 > 0, elements.box(F.col("ord"), 0, 1, 1)).alias("bbox"))
    out = chunking.layout_chunks(df)
    got: dict = {}
    for r in out.orderBy("document_id", "chunk_no").collect():
        assert r.chunk_no == len(got.setdefault(r.document_id, []))
        got[r.document_id].append(r.content)
    assert got == {d: c for d, els in docs.items() if (c := python_chunks(els, 100))}
    pages = [r.page for r in out.where("document_id = 'one'").orderBy("chunk_no").collect()]
    assert pages == list(range(0, 700, 2))
    boxes = [tuple(r.bbox) for r in out.where("document_id = 'one'").orderBy("chunk_no").limit(3).collect()]
    assert boxes == [(1, 0, 1, 1), (2, 0, 1, 1), (4, 0, 1, 1)]
    assert not any(x in out._jdf.queryExecution().toString() for x in ("Python", "Pandas", "Arrow"))


def test_table_chunks_keep_their_section(spark):
    table = "<table><tr><td>a</td></tr></table>"
    rows = [("d", 0, "Text", "before"), ("d", 1, "SectionHeader", " Head "), ("d", 2, "Text", "body"), ("d", 3, "Table", table), ("d", 4, "Text", "after"), ("d", 5, "SectionHeader", "Empty")]
    df = spark.createDataFrame(rows, "document_id string, ord int, category string, text string").select("*", (F.col("ord") + 1).alias("page"), elements.box(0, 0, 1, 1).alias("bbox"))
    got = [(r.content, r.content_type, r.page) for r in chunking.layout_chunks(df).orderBy("chunk_no").collect()]
    assert got == [("before", "text", 1), ("## Head\n\nbody", "text", 3), (f"## Head\n\n{table}", "table", 4), ("## Head\n\nafter", "text", 5)]


def test_text_elements_edges(spark):
    rows = [
        ("a", "x" * 20 + "\r\n" + "y" * 21), ("b", "z" * 99), ("c", "z" * 100), ("d", "z" * 50 + "."), ("e", "## A heading of some length"), ("f", "words before the table stand here.\n<table><tr></tr></table>\nwords after the table stand here."),
        ("g", "q" * 4500), ("h", "short"), ("i", None), ("j", "| a cell | another cell | third"), ("k", "<table> never closed but long enough."),
    ]
    got: dict = {}
    for r in elements.text_elements(spark.createDataFrame(rows, "document_id string, text string")).orderBy("document_id", "ord").collect():
        got.setdefault(r.document_id, []).append((r.category, len(r.text)))
    assert got == {
        "a": [("SectionHeader", 21)], "b": [("SectionHeader", 99)], "c": [("Text", 100)], "d": [("Text", 51)], "e": [("SectionHeader", 24)], "f": [("Text", 34), ("Table", 24), ("Text", 33)],
        "g": [("Text", 2000), ("Text", 2000), ("Text", 500)], "h": [("Text", 5)], "i": [("Text", 0)], "j": [("Text", 31)], "k": [("Table", 37)],
    }


def test_rounding_is_half_even(spark):
    r = spark.range(1).select(F.bround(F.lit(0.12345), 4).alias("a"), F.bround(F.lit(2.25), 1).alias("b"), metrics.jaccard(F.array(F.lit("a")), F.array().cast("array<string>")).alias("c")).first()
    assert (r.a, r.b, r.c) == (0.1234, 2.2, 0.0)


def test_error_rates(spark):
    rows = [("", "x"), ("same", "same"), ("été", "ete"), ("Word two", "word two"), ("a b c", "a x c d")]
    from docloom.operators.evaluation import ocr_metrics

    got = [(r.cer, r.wer, r.error) for r in ocr_metrics(spark.createDataFrame(rows, "reference string, hypothesis string")).collect()]
    assert got == [(None, None, "both texts are required"), (0.0, 0.0, None), (0.6667, 1.0, None), (0.125, 0.0, None), (0.6, 0.6667, None)]


def test_keys_and_slugs(spark):
    rows = spark.createDataFrame([("Họ và tên đầy đủ",), (" A  b-C_ ",)], "s string")
    assert [r.k for r in rows.select(text.ascii_key(F.lower("s")).alias("k")).collect()] == ["hovatendaydu", "abc_"]
    assert [r.k for r in rows.select(text.slug(F.col("s")).alias("k")).collect()][1] == "a_bc"


def test_upsert_save_and_read_back(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string").write.parquet(path)
    store.save(store.upsert(spark.read.parquet(path), spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")), path)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    with pytest.raises(ValueError):
        store.set_tag(spark.range(1).withColumn("department", F.lit("HR")), "x", "department", "SPACE")


def docx_bytes():
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a&lt;b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", body)
    return out.getvalue()


def xlsx_bytes():
    s, r = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{s}" xmlns:r="{r}"><sheets><sheet name="One" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{s}"><si><t>x</t></si></sst>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{s}"><sheetData><row><c t="s"><v>0</v></c><c><v>5</v></c></row><row/></sheetData></worksheet>')
    return out.getvalue()


PDF = b"%PDF-1.4\n1 0 obj <</Type /Page /Contents 2 0 R>> endobj\n2 0 obj <</Length 30>> stream\nBT (Hello \\(pdf\\)) Tj T* (line) Tj ET\nendstream endobj\n3 0 obj <</Type /Page>> endobj\n"


def test_parsers(spark, tmp_path):
    for name, raw in {"a.docx": docx_bytes(), "b.xlsx": xlsx_bytes(), "c.txt": b"plain", "d.pdf": PDF, "e.xls": b"?", "f.docx": b"broken", "g.svg": b"<svg><text>hi</text></svg>"}.items():
        (tmp_path / name).write_bytes(raw)
    got = {r.document_id: (r.kind, r.text, r.error) for r in files.parse(files.read_files(spark, f"file://{tmp_path}")).collect()}
    assert got["a"] == ("docx", "Hello\n<table><tr><td>a&lt;b</td></tr></table>", None)
    assert got["b"] == ("xlsx", "## One\n| x | 5 |", None)
    assert got["c"] == ("text", "plain", None) and got["g"] == ("svg", "hi", None)
    assert got["d"][0] == "pdf" and got["d"][1].startswith("Hello (pdf)\nline")
    assert got["e"] == (None, None, "unsupported") and got["f"] == ("docx", None, "unreadable")
    assert files.file_of(files.read_files(spark, f"file://{tmp_path}"), "c").count() == 1


def test_questions_fall_through_to_the_second_path(spark, tmp_path):
    (tmp_path / "bad.json").write_text("{not json")
    (tmp_path / "q.json").write_text('[{"id": 1, "question": "why?", "ground_truth": "so"}]')
    got = files.read_questions(spark, f"file://{tmp_path}/missing.json", f"file://{tmp_path}/bad.json", f"file://{tmp_path}/q.json").collect()
    assert [(r.id, r.question, r.ground_truth) for r in got] == [(1, "why?", "so")]
    assert files.read_questions(spark, f"file://{tmp_path}/missing.json").count() == 0


LONG = "A sentence that is long enough to be a text."
JOB_TAGS = ("DEV", "guide", "company", "in_force")


@pytest.fixture
def queue(spark, tmp_path):
    """Drops jobs and works them off; what is current, and the states."""
    base = f"file://{tmp_path}"

    class Queue:
        def run(self, *rows):
            spark.createDataFrame([(*r[:5], *JOB_TAGS, r[5] if len(r) > 5 else None) for r in rows], ingest.JOB).write.mode("append").parquet(f"{base}/jobs")
            ingest.ingest(ingest.job_stream(spark, f"{base}/jobs"), f"{base}/chunks", f"{base}/states", f"{base}/cp").awaitTermination()

        def reparse(self, texts, *rows):
            spark.createDataFrame([(*r, None) for r in rows], ingest.REPARSE).write.mode("append").parquet(f"{base}/again")
            now = lambda s: s.createDataFrame(list(texts.items()), "document_id string, text string")
            ingest.reparse(ingest.job_stream(spark, f"{base}/again", schema=ingest.REPARSE), now, f"{base}/chunks", f"{base}/states", f"{base}/cp2").awaitTermination()

        def chunks(self):
            rows = ingest.current_chunks(spark, f"{base}/chunks", f"{base}/states").collect()
            assert all((r.department, r.status) == ("DEV", "in_force") for r in rows)
            return sorted(((r.document_id, r.content) for r in rows), key=str)

        def states(self):
            from docloom.operators.jobs import job_states

            return {r.job_id: (r.state, r.message) for r in job_states(ingest.states(spark, f"{base}/states")).collect()}

        def compact(self):
            ingest.compact(spark, f"{base}/chunks", f"{base}/states")

        def last_step(self):
            return [(r.document_id, r.state) for r in ingest.states(spark, f"{base}/states").where("step = 2").collect()]

        def seen(self, job):
            return [r.state for r in ingest.states(spark, f"{base}/states").where(F.col("job_id") == job).orderBy("step").collect()]

    return Queue()


def test_stream_upserts_and_isolates_failures(queue):
    queue.run(("j1", "ds", "d1", LONG, "a.txt"), ("j2", "ds", "d2", None, "b.txt"))
    queue.run(("j3", "ds", "d1", LONG + " Now changed.", "a.txt"))
    assert queue.states() == {"j1": ("done", None), "j2": ("failed", "no chunks"), "j3": ("done", None)}
    assert queue.chunks() == [("d1", LONG + " Now changed.")]
    assert queue.seen("j1") == ["pending", "processing", "done"]


def test_two_jobs_of_a_document_in_one_batch(queue):
    queue.run(("j1", "ds", "d1", LONG, "a.txt"), ("j2", "ds", "d1", LONG + " Later.", "a.txt"))
    assert queue.chunks() == [("d1", LONG + " Later.")]
    assert queue.states() == {"j1": ("done", "replaced by j2"), "j2": ("done", None)}


def test_the_job_queued_last_counts(queue):
    """Whatever the ids say: job9 before job10, and random ids."""
    import datetime as dt
    import uuid

    at = lambda m: dt.datetime(2026, 1, 1, 12, m)
    queue.run(("job9", "ds", "d1", LONG, "a.txt", at(1)), ("job10", "ds", "d1", LONG + " Later.", "a.txt", at(2)))
    assert queue.chunks() == [("d1", LONG + " Later.")] and queue.states()["job9"] == ("done", "replaced by job10")
    ids = sorted((uuid.uuid4().hex for _ in range(6)), reverse=True)
    queue.run(*[(i, "ds", "d2", f"{LONG} Number {k}.", "b.txt", at(k)) for k, i in enumerate(ids)])
    assert ("d2", f"{LONG} Number 5.") in queue.chunks()


def test_failing_documents_that_share_a_job_id(queue, monkeypatch):
    """Halving ends, and no job is lost: null and repeated ids, null documents."""
    real = ingest.text_elements
    bad = lambda jobs: real(jobs).withColumn("text", F.when(F.col("text").contains("BAD"), F.raise_error(F.lit("broken"))).otherwise(F.col("text")))
    monkeypatch.setattr(ingest, "text_elements", bad)
    queue.run(*[(("same", None)[i % 2], "ds", f"d{i}" if i < 6 else None, LONG + (" BAD" if i in (1, 2, 4) else ""), "a.txt") for i in range(7)])
    assert sorted(str(d) for d, _ in queue.chunks()) == ["None", "d0", "d3", "d5"]
    states = queue.last_step()
    assert sorted((str(d), s) for d, s in states) == [("None", "done"), ("d0", "done"), ("d1", "failed"), ("d2", "failed"), ("d3", "done"), ("d4", "failed"), ("d5", "done")]


def test_a_job_without_chunks_takes_the_old_ones_away(queue):
    queue.run(("j1", "ds", "d1", LONG, "a.txt"), ("j2", "ds", "d2", LONG, "b.txt"))
    queue.run(("j3", "ds", "d1", " ", "a.txt"))
    assert queue.chunks() == [("d2", LONG)] and queue.states()["j3"] == ("failed", "no chunks")


def test_a_raising_document_fails_alone(queue, monkeypatch):
    real = ingest.text_elements
    bad = lambda jobs: real(jobs).withColumn("text", F.when(F.col("text").contains("BAD"), F.raise_error(F.lit("broken"))).otherwise(F.col("text")))
    monkeypatch.setattr(ingest, "text_elements", bad)
    queue.run(*[(f"j{i}", "ds", f"d{i}", LONG + (" BAD" if i == 2 else ""), "a.txt") for i in range(5)])
    assert [d for d, _ in queue.chunks()] == ["d0", "d1", "d3", "d4"]
    states = queue.states()
    assert states["j2"][0] == "failed" and "broken" in states["j2"][1] and all(states[f"j{i}"] == ("done", None) for i in (0, 1, 3, 4))


def test_reparse_is_a_queue_of_its_own(queue):
    queue.run(("j1", "ds", "d1", LONG, "a.txt"), ("j2", "ds", "d2", LONG, "b.txt"))
    queue.reparse({"d1": LONG + " Read again."}, ("r1", "d1", "a.txt"))
    assert queue.chunks() == [("d1", LONG + " Read again."), ("d2", LONG)] and queue.states()["r1"] == ("done", None)
    queue.compact()
    assert queue.chunks() == [("d1", LONG + " Read again."), ("d2", LONG)]
    queue.run(("j3", "ds", "d1", LONG + " Third.", "a.txt"))
    assert queue.chunks() == [("d1", LONG + " Third."), ("d2", LONG)]


def test_save_keeps_the_table_when_it_cannot_swap(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    store.save(spark.range(3), path)
    store.save(spark.read.parquet(path).where("id > 0"), path)
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(OSError):
        store.swap(spark, f"file://{tmp_path}/not-there", path)
    assert spark.read.parquet(path).count() == 2


def test_access_rules(spark):
    from docloom.operators import acl

    names = {"abc": True, "ab": False, "user.name": False, "Žofie_ä-9": True, "a" * 40: True, "a b c": False, "abc\n": False, "": False}
    words = {"123456": True, "      ": False, "12345": False, "pässwörd": True, "a     ": True}
    files_ = {"a.PNG": True, "a.jpeg": True, "a.bmp": False, "a.tif": False, "a.webp": True, "png": False}
    for f, cases in ((acl.valid_username, names), (acl.valid_password, words), (acl.is_image, files_)):
        got = {r.s: r.ok for r in spark.createDataFrame([(k,) for k in cases], "s string").select("s", f(F.col("s")).alias("ok")).collect()}
        assert got == cases


def test_sequence_numbers_of_any_length(spark):
    chunks = spark.createDataFrame([("d", i, f"c{i}", "text", 1, None, None) for i in (0, 9, 10, 9999, 10_000, 123_456)], "document_id string, chunk_no int, content string, content_type string, page int, bbox string, section string")
    tags = spark.createDataFrame([("d", "n", "HR", "guide", "company", "in_force")], "document_id string, document_name string, department string, doc_type string, scope string, status string")
    rows = chunking.to_store(chunks, tags, "ds")
    more = rows.limit(1).withColumns({"id": F.lit("z"), "content": F.lit("none"), "keywords": F.array().cast("array<string>")})
    assert [r.content for r in store.by_sequence(rows.unionByName(more)).collect()] == ["c0", "c9", "c10", "c9999", "c10000", "c123456", "none"]


@pytest.mark.parametrize("block", [2, 4096])
def test_windows_of_the_joined_corpus(spark, block):
    texts = {i: "x" * (i * 7 % 23) + str(i) for i in range(60)} | {60: "", 61: None, 62: "y" * 300, 63: "end"}
    got = chunking.joined_chunks(spark.createDataFrame(list(texts.items()), "k long, text string"), 50, "k", block=block).orderBy("chunk_no").collect()
    whole = "\n\n".join(t or "" for _, t in sorted(texts.items()))
    assert [r.content for r in got] == [whole[i : i + 50] for i in range(0, len(whole), 50)] and [r.chunk_no for r in got] == list(range(len(got)))


def test_null_documents_are_chunked_alone(spark):
    rows = [(None, 0, "SectionHeader", "Head"), (None, 1, "Text", "one"), ("a", 0, "Text", "two"), ("a", 1, "Text", "three")]
    df = spark.createDataFrame([(*r, 1, None, None) for r in rows], "document_id string, ord int, category string, text string, page int, bbox struct<x1:int,y1:int,x2:int,y2:int>, pieces string").drop("pieces")
    got = {(r.document_id, r.chunk_no): (r.content, r.section) for r in chunking.layout_chunks(df.coalesce(1)).collect()}
    assert got == {(None, 0): ("## Head\n\none", "Head"), ("a", 0): ("two\n\nthree", None)}


def test_bm25_by_names_and_by_join(spark, monkeypatch):
    chunks = spark.createDataFrame([(str(i), "ds", "HR", "company", "in_force", t) for i, t in enumerate(["red apple tree", "blue sky", "", None, "red red rose"])], "id string, dataset_id string, department string, scope string, status string, content string")
    q = spark.createDataFrame([(1, "red apple", "ds", True, None), (2, "", "ds", True, None)], "query_id long, question string, dataset_id string, is_admin boolean, department string")
    by_name = retrieval.bm25(q, chunks).collect()
    monkeypatch.setattr(retrieval, "MOST_TERMS", 1)
    assert sorted(by_name) == sorted(retrieval.bm25(q, chunks).collect()) and [r.id for r in sorted(by_name, key=lambda r: r["rank"])] == ["0", "4"]


def test_ocr_that_repeats_itself_is_not_taken(spark):
    from docloom.functions.text import usable_output
    from docloom.operators import elements

    page = lambda *t: "[" + ",".join(f'{{"bbox":[1,2,3,4],"category":"Text","text":"{x}"}}' for x in t) + "]"
    loop, fine = page(*"aaaabc"), page(*"aabcdef")
    rows = [(1, loop, fine, "x"), (2, loop, loop, "other"), (3, fine, loop, None), (4, page("a", "a", "a", "a"), None, None), (5, loop, None, " ")]
    got = {r.id: r.t for r in spark.createDataFrame(rows, "id int, a string, b string, c string").select("id", elements.ocr_cascade(F.col("a"), F.col("b"), F.col("c"), usable_output).alias("t")).collect()}
    assert got == {1: fine, 2: "other", 3: fine, 4: page("a", "a", "a", "a"), 5: "[page could not be read]"}


def test_windowed_stream(spark, sf_dir, tmp_path):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "e.parquet").symlink_to(f"{sf_dir}/events.parquet")
    got = ingest.windowed_counts(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in"))
    q = got.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/cp").start()
    q.awaitTermination()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf_dir}/events.parquet").count()


def test_form_fields_survive_nulls(spark):
    assert forms.detect_fields(spark.createDataFrame([("t", None), ("u", "")], "template_id string, text string")).count() == 0


def test_docx_forms(spark):
    from docloom.sources import docx_forms

    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda *runs: "<w:p>" + "".join(f"<w:r><w:t>{r}</w:t></w:r>" for r in runs) + "</w:p>"
    body = (
        f'<w:sdt><w:sdtPr><w:alias w:val="Job Title"/></w:sdtPr><w:sdtContent>{p("old")}</w:sdtContent></w:sdt><w:p><w:fldSimple w:instr=" MERGEFIELD city "><w:r><w:t>«city»</w:t></w:r></w:fldSimple></w:p>'
        + p("Dear {{Full", " Name}},") + p("Phone: ____") + p("One, two: ____") + p("Address:") + f"<w:tbl><w:tr><w:tc>{p('Unit:')}</w:tc><w:tc>{p('....')}</w:tc></w:tr></w:tbl>"
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    rows = spark.createDataFrame([(out.getvalue(), '{"full_name":"Ann","phone":"12","city":"Rome","unit":"R","job_title":"Dev"}'), (b"no", "{}")], "raw binary, v string")
    got = rows.select(docx_forms.docx_fields("raw").alias("f"), docx_forms.docx_fill("raw", "v").alias("d")).collect()
    assert [r.key for r in got[0].f] == ["job_title", "city", "unit", "full_name", "phone", "address"] and got[1].f is None and got[1].d is None
    text = files.docx_text(bytes(got[0].d))
    more = (
        p("Address:") + "<w:p/>" + p("Kind:") + p("taken already") + p("Needed papers:") + "<w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>a list</w:t></w:r></w:p>"
        + '<w:p><w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText> MERGEFI</w:instrText></w:r><w:r><w:instrText>ELD street </w:instrText></w:r><w:r><w:fldChar w:fldCharType="separate"/></w:r>'
        + '<w:r><w:t>«str</w:t></w:r><w:r><w:t>eet»</w:t></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r></w:p>'
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{more}</w:body></w:document>')
    assert [k for k, _ in docx_forms.fields(out.getvalue())] == ["street", "address", "kind"]
    filled = files.docx_text(docx_forms.fill(out.getvalue(), {"address": "Via 1", "kind": "new", "needed_papers": "no", "street": "Main"}))
    assert filled.split("\n") == ["Address:", "Via 1", "Kind: new", "taken already", "Needed papers:", "a list", "Main"]
    assert "Dear Ann," in text and "Phone: 12" in text and "Rome" in text and "<td>R</td>" in text and "One, two: ____" in text


def test_stand_in_models_feed_retrieval(spark):
    from docloom.functions import models

    chunks = spark.createDataFrame([(str(i), "ds", "HR", "company", "in_force", t) for i, t in enumerate(["red apple tree", "blue sky", "", "red rose"])], "id string, dataset_id string, department string, scope string, status string, content string")
    q = spark.createDataFrame([(1, "red apple", "ds", True, None)], "query_id long, question string, dataset_id string, is_admin boolean, department string")
    got = retrieval.retrieve(models.embed_questions(q), models.embed_chunks(chunks).withColumns({"document_id": F.col("id"), "document_name": F.col("id")})).orderBy("rank").collect()
    assert got[0].chunk_id == "0" and got[0].similarity == 1.0 and "2" not in {r.chunk_id for r in got}


def test_numbered_wide_rows(spark):
    """Ranges of rows with texts are cut by size otherwise than ranges of the keys alone: each row has its place still."""
    from docloom.operators.store import numbered

    own = {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        wide = spark.range(3000).select((F.col("id") * 3).alias("k"), F.concat(*[F.sha2(F.concat(F.lit(str(i)), F.col("id").cast("string")), 512) for i in range(4)]).alias("t"))
        got = {r.k: r.pos for r in numbered(wide.repartition(5), F.col("k")).where("t is not null").select("k", "pos").collect()}
        whole = numbered(wide.repartition(5), F.col("k")).agg(F.count("*").alias("n"), F.sum(F.length("t")).alias("t"), F.sum("pos").alias("p")).first()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == {3 * i: i for i in range(3000)} and (whole.n, whole.t, whole.p) == (3000, 3000 * 512, 3000 * 2999 // 2)


def test_places_of_a_batch_are_counted_in_many_tasks(spark, tmp_path, monkeypatch):
    """No task reads the texts of all jobs of a micro-batch."""
    seen = {}
    monkeypatch.setattr(ingest, "discard", lambda *tables: [seen.setdefault(t._docloom_path, (t.columns, sorted(r[0] for r in t.select("pos").collect()), spark.read.parquet(t._docloom_path).select("_p").distinct().count())) for t in tables if "pos" in t.columns])
    own = {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        jobs = spark.range(400).select(*[F.col("id").cast("string").alias(c) for c in ("job_id", "document_id")], F.lit("en").alias("dataset_id"), F.repeat(F.sha2(F.col("id").cast("string"), 512), 4).alias("text"), *[F.lit("x").alias(c) for c in ("file_name", "department", "doc_type", "scope", "status")], F.current_timestamp().alias("queued_at"))
        ingest.ingest_batch(jobs, f"file://{tmp_path}/chunks", f"file://{tmp_path}/states", 0)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    ((columns, places, files),) = seen.values()
    assert "text" in columns and places == list(range(400)) and files > 1
    assert ingest.current_chunks(spark, f"file://{tmp_path}/chunks", f"file://{tmp_path}/states").count() == 400


def test_lines_without_a_mark_cost_no_search_for_labels(spark):
    """Lines with neither a colon nor braces go before any pattern is tried; fields and their order stay."""
    t = "word " * 50 + "\n{{ One }} and Two: ____ " + "x" * 90 + " Three: ...\nplain. Four: …\n" + "y" * 85 + ": __\nFive:\nSix.Seven:__"
    got = forms.detect_fields(spark.createDataFrame([(1, t)], "template_id int, text string"))
    assert "Contains(_line" in got._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.pos, r.label) for r in got.orderBy("pos").collect()][:2] == [(0, "One"), (1, "and Two")]
    assert {"Three", "Four", "Five", "Seven"} <= {r.label.split()[-1] for r in got.collect()}


@pytest.mark.parametrize("named", [True, False])
def test_bm25_reads_texts_twice_and_counts_rows_of_one_chunk_together(spark, tmp_path, monkeypatch, named):
    """Once for the statistics of all chunks, once for the frequencies of those that may be seen; scores as loops give them."""
    import math
    import random
    from collections import Counter, defaultdict

    if not named:
        monkeypatch.setattr(retrieval, "MOST_TERMS", 2)
    rnd = random.Random(4)
    rows = [(f"c{i:02d}", rnd.choice(["en", "de"]), rnd.choice(["DEV", "HR"]), rnd.choice(["company", "department"]), rnd.choice(["in_force", "draft"]), " ".join(rnd.choice("ab cd ef gh ij kl".split()) for _ in range(rnd.randint(0, 30)))) for i in range(60)]
    asked = [(1, "ab ab CD?", "en", False, "DEV"), (2, "ef", "de", True, None), (3, "gh zz", "en", False, " "), (4, "", "en", True, None), (5, "ij kl ab", "xx", True, None)]
    q = spark.createDataFrame([(i, t, [1.0], d, a, p) for i, t, d, a, p in asked], "query_id long, question string, vector array<float>, dataset_id string, is_admin boolean, department string")

    def brute(rows):
        held = defaultdict(Counter)
        for *kept, text in rows:
            held[(*kept, len(text.split()))].update(text.split())
        n, average = len(rows), sum(len(r[-1].split()) for r in rows) / len(rows)
        df = Counter(t for words in held.values() for t in words)
        out = {}
        for i, text, dataset, admin, department in asked:
            own = defaultdict(float)
            for (c, d, p, scope, status, dl), words in held.items():
                if d == dataset and (admin or (status == "in_force" and (scope == "company" or (p == department and department.strip())))):
                    for t, m in Counter(text.lower().replace("?", "").split()).items():
                        if words[t]:
                            own[c] += m * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * words[t] / (words[t] + 1.2 * (1 - 0.75 + 0.75 * dl / average))
            out |= {(i, c): pytest.approx(x, abs=1e-8) for c, x in own.items()}
        return out

    for name, some in (("once", rows), ("again", [*rows, *rows[:20], rows[0]])):
        spark.createDataFrame(some, "id string, dataset_id string, department string, scope string, status string, content string").write.parquet(f"{tmp_path}/{name}")
        got = retrieval.bm25(q, spark.read.parquet(f"{tmp_path}/{name}"))
        assert {(r.query_id, r.id): r.score for r in got.collect()} == brute(some)
        if name == "once":
            plan = got._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[2]
            assert sum("FileScan" in x and "content" in x for x in plan.split("\n")) == 2
