import hashlib
import random

import numpy as np
import pytest

from docloom.llm import fim


def brute(doc_id, text, seed=1):
    text = text or ""
    n = len(text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def held(frame):
    return sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in frame.collect()), key=repr)


def expected(rows):
    return sorted(((d, *brute(d, t)) for d, t in rows), key=repr)


def test_scan_gives_units_marks_and_offsets():
    rng = random.Random(3)
    for _ in range(60):
        texts = ["".join(rng.choice(["a", "<", "P", ">", "é", "語", "𝄞", "<S>"]) for _ in range(rng.choice([0, 1, 5, 63, 64, 65, 300]))) for _ in range(7)]
        scan = fim.Scan([t.encode() for t in texts])
        left, units, marks = scan.functions()
        assert units[:, 0].tolist() == list(map(len, texts))
        assert marks[:, 0].tolist() == [t.count("<P>") + t.count("<S>") + t.count("<M>") for t in texts]
        k = np.array([rng.randint(0, len(t)) for t in texts])
        assert scan.offsets(np.zeros(7, np.uint8), k).tolist() == [len(t[:i].encode()) for t, i in zip(texts, k)]


def test_functions_compose_over_any_cut():
    """Pieces cut within characters and marks, entered in the state the last one left, give what the whole gives."""
    rng = random.Random(4)
    for _ in range(40):
        data = "".join(rng.choice(["a", "<", "<P>", "é", "語", "𝄞"]) for _ in range(200)).encode()
        cuts = sorted({0, len(data), *(rng.randrange(len(data)) for _ in range(5))})
        left, units, marks = fim.Scan([data[a:b] for a, b in zip(cuts, cuts[1:])]).functions()
        state = n = m = 0
        for x, u, v in zip(left, units, marks):
            n, m, state = n + u[state], m + v[state], x[state]
        assert (n, m) == (len(data.decode()), data.count(b"<P>"))


@pytest.mark.parametrize("piece", [fim.PIECE, 7, 64, 1000])
def test_transform_equals_slicing(spark, piece):
    rng = random.Random(piece)
    rows = [(i, "".join(rng.choice("ab <PSM>é語𝄞\n") for _ in range(rng.choice([0, 1, 3, 50, 400, 2500])))) for i in range(150)]
    rows += [(None, "no id " * 30), (None, None), (7000, None), (7001, ""), (5, "again"), (5, "again"), (7002, "x<M>y" * 50), (7003, "a<" * 40 + "P>" + "b" * 90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert held(fim.transform(docs, piece=piece)) == expected(rows)


def test_edge_rows_long_texts_and_clashing_names(edge):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    assert held(fim.transform(edge)) == expected(rows)
    assert held(fim.transform(edge.where("false"))) == []


def test_restored_is_the_text(documents, texts):
    out = fim.transform(documents.select("doc_id", "text"))
    got = {r.doc_id: (r.form, r.t) for r in out.select("doc_id", "form", fim.restored(out["output"], out["form"]).alias("t")).collect()}
    assert {k: t for k, (_, t) in got.items()} == {k: t or "" for k, t in texts.items()}
    assert {f for f, _ in got.values()} == {"plain", "psm", "spm"}


def test_query_equals_brute_force(spark, sf_dir, texts):
    from docloom.llm.queries import QUERIES

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = {r.doc_id: (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) for r in QUERIES["op12_fill_in_middle"](spark, sf_dir).collect()}
    want = {k: (*(b := brute(k, t))[:4], sha(b[4]), sha(t or "")) for k, t in texts.items()}
    assert got == want


def test_query_against_sql(spark, sf_dir):
    import duckdb

    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    columns = "doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256"
    want = c.sql(f"select {columns} from ({fim.SQL}) order by doc_id").fetchall()
    assert [tuple(r) for r in fim.query(spark, sf_dir).select(*columns.split(", ")).orderBy("doc_id").collect()] == want
