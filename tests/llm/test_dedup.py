import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docloom.llm import common, fingerprints, simhash_dedup


def brute_fp(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    terms = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    votes = np.unpackbits(np.array([xxhash.xxh64_intdigest(t, seed=42) for t in terms], dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0)
    return int("".join("1" if 2 * v > len(terms) else "0" for v in votes), 2)


def brute_components(prints, radius=4):
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    a = np.array([prints[i] for i in ids], np.uint64)
    for i, j in zip(*np.nonzero(np.bitwise_count(a[:, None] ^ a[None]) <= radius)):
        x, y = find(ids[i]), find(ids[j])
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def brute_similar(texts, similarity=0.8):
    """Text -> smallest id reachable over Jaccard similarities of ``similarity`` or more."""
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and len(a & b) >= similarity * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


def test_similar_texts_are_joined(spark):
    rnd = random.Random(6)
    vocab = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    texts = {}
    for k in range(60):
        words = [rnd.choice(vocab) for _ in range(rnd.choice([40, 200, 400]))]
        for j in range(4):
            own = list(words)
            for _ in range(int(len(own) * rnd.choice([0, 0.005, 0.01, 0.05, 0.2]))):
                own[rnd.randrange(len(own))] = rnd.choice(vocab)
            texts[4 * k + j] = " ".join(own)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.root for r in simhash_dedup.similar_components(df).collect()}
    wanted = brute_similar(texts)
    same = lambda x: {frozenset(i for i in x if x[i] == r) for r in x.values()}
    missed = same(wanted) - same(got)
    assert len(missed) <= 0.05 * len(same(wanted))
    for group in same(got):  # no text is joined with one that isn't similar to any of its group
        assert len({wanted[i] for i in group}) == 1


def test_repeated_lines_hide_no_similar_texts(spark):
    """A footer repeated many times adds few shingles, however many words it has."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    texts = {}
    for k in range(8):
        texts[2 * k] = " ".join(word() for _ in range(300))
        texts[2 * k + 1] = texts[2 * k] + " please read our terms of use" * 100
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.root for r in simhash_dedup.similar_components(df).collect()}
    assert all(got[2 * k] == got[2 * k + 1] for k in range(8)) and len(set(got.values())) == 8


def test_set_fingerprints_against_loops():
    """Distinct shingles, majorities of bits and least hashes, each counted one by one; texts of few words and of none among them."""
    import pyarrow as pa

    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(["a", "B", "cc", "Éa", "日"]) for _ in range(n)) for n in (1, 3, 5, 6, 40, 3000)] + ["", " \t ", "A b", "a B", " a  b\n", "a\x85b"]
    h, n = simhash_dedup._shingle_hashes(pa.array(texts), 5)
    ends = np.cumsum(n)
    sets = [set(h[e - k : e].tolist()) for e, k in zip(ends, n)]
    own = [shingles(t) for t in texts]
    assert [len(s) for s in sets] == [len(x) for x in own] == n.tolist()
    for i, a in enumerate(own):
        for j, b in enumerate(own):
            assert len(sets[i] & sets[j]) == len(a & b), (i, j)
    prints = simhash_dedup._majorities(h, ends - n, n)
    for s, p in zip(sets, prints.tolist()):
        assert p == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in s) > len(s))
    keys = simhash_dedup._band_keys(h, ends - n)
    assert all((keys[i] == keys[j]).all() == (own[i] == own[j]) for i in range(len(texts)) for j in range(len(texts)))


def test_least_hashes_agree_as_often_as_sets_are_alike():
    rnd = np.random.default_rng(1)
    h = rnd.integers(0, 1 << 63, 600 * 100).astype(np.uint64) * np.uint64(2)
    pairs = np.concatenate([np.concatenate([x[:500], x[100:]]) for x in h.reshape(100, 600)])  # similarity 400 / 600
    keys = simhash_dedup._band_keys(pairs, np.arange(0, len(pairs), 500)).reshape(100, 2, -1)
    assert abs((keys[:, 0] == keys[:, 1]).mean() - (4 / 6) ** 4) < 0.05


def test_equal_fingerprints_alone_join_nothing(spark, monkeypatch):
    """Different texts whose fingerprints are equal stay; equal texts are one."""
    real = simhash_dedup.set_fingerprints
    monkeypatch.setattr(simhash_dedup, "set_fingerprints", lambda *a: real(*a).withColumns({"fp": F.lit(7).cast("long"), "fp2": F.lit(7).cast("long")}))
    rnd = random.Random(12)
    texts = [" ".join(rnd.choice("abcdefghijklmnop") * 3 for _ in range(60)) for _ in range(6)]
    df = spark.createDataFrame(list(enumerate([*texts, texts[0], texts[1]])), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash_dedup.drop_near_duplicates(df).collect()) == [0, 1, 2, 3, 4, 5]


def test_texts_between_hide_no_similar_pair(spark):
    """A and B are similar; between them in fingerprints lie many texts C that are similar to neither."""
    rnd = random.Random(13)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    texts, n = {}, 400

    def changed(words, times):
        own = list(words)
        for k in range(times):
            own[(k * n) // times + rnd.randrange(5)] = word()
        return own

    for k in range(12):
        base = [word() for _ in range(n)]
        for j in range(30):
            texts[100 * k + j] = " ".join(changed(base, 7) if j < 4 else changed(base, 13))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.root for r in simhash_dedup.similar_components(df).collect()}
    wanted = brute_similar(texts)
    linked = [i for i in texts if wanted[i] != i]
    assert len(linked) > 20
    missed = [i for i in linked if got[i] != got[wanted[i]]]
    assert len(missed) <= 0.02 * len(linked), (len(missed), len(linked))
    for i in texts:
        for j in texts:
            assert got[i] != got[j] or wanted[i] == wanted[j]


@pytest.mark.parametrize("part", [16, 8192])
def test_all_pairs_of_a_bucket_are_compared(monkeypatch, part):
    """Row 0 and row 1 are similar, row 2 lies between them and is similar to neither: the forest keeps 0-2 and 1-2 alone."""
    import pyarrow as pa

    monkeypatch.setattr(simhash_dedup, "PART", part)
    fp, zero = np.array([0b1111, 0b11110000, 0], np.int64), np.zeros(3, np.int64)
    keep = simhash_dedup.closest_forest(3, np.array([0, 0, 1]), np.array([1, 2, 2]), np.array([8, 4, 4]))
    assert sorted(keep) == [1, 2]
    nodes = np.array([10, 11, 12])
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in (zero + 5, nodes, nodes, fp, zero)], names=["key", "node", "root", "fp", "fp2"])
    (got,) = simhash_dedup._open_rows(iter([batch]), 8)
    assert got.column("node").to_pylist() == [10, 11, 12]
    sets = pa.array([list(range(100)), list(range(5, 100)), list(range(20, 120))], pa.list_(pa.int64()))
    (links,) = simhash_dedup._confirmed_links(iter([pa.RecordBatch.from_arrays([*got.columns, sets], names=[*got.schema.names, "s"])]), 8, 0.8)
    assert links.to_pydict() == {"a": [11], "b": [10]}


def test_closest_forest_joins_what_all_links_join():
    rnd = np.random.default_rng(3)
    u, v, d = rnd.integers(0, 200, 3000), rnd.integers(0, 200, 3000), rnd.integers(0, 20, 3000)
    keep = simhash_dedup.closest_forest(200, u, v, d)
    assert len(keep) <= 199
    for most in range(20):
        joined = []
        for at in (np.flatnonzero(d <= most), keep[d[keep] <= most]):
            parent = np.arange(200)
            simhash_dedup._unite(parent, u[at], v[at])
            joined.append(simhash_dedup._root(parent, parent))
        assert np.array_equal(*joined)


def test_query_against_brute_force(spark, sf_dir, texts):
    got = {r.doc_id: r for r in simhash_dedup.query(spark, sf_dir).collect()}
    prints = {i: brute_fp(t) for i, t in texts.items()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in prints.items()}
    assert {i: r.component_id for i, r in got.items()} == brute_components(prints)


@pytest.mark.parametrize("part", [64, 8192])
def test_links_of_crowded_buckets(spark, monkeypatch, part):
    """Fingerprints crowd round a few centres, so that buckets are cut into parts; chains of links join at last."""
    rnd = random.Random(part)
    own = set()
    for _ in range(6):
        at = rnd.getrandbits(64)
        for _ in range(150):
            at ^= sum(1 << b for b in rnd.sample(range(64), rnd.choice([1, 2, 4, 5])))
            own.add(at)
    own |= {rnd.getrandbits(64) for _ in range(200)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    monkeypatch.setattr(simhash_dedup, "PART", part)
    df = spark.createDataFrame([(signed(x),) for x in own], "fp long")
    got = {r.fp: r.root for r in simhash_dedup.link_components(df).collect()}
    wanted = brute_components({signed(x): x for x in own})
    assert {x: got.get(x, x) for x in wanted} == wanted


def test_more_blocks_for_more_rows():
    assert len(simhash_dedup.tables_for(1000)) == 5 and len(simhash_dedup.tables_for(1 << 30)) == 15 and len(simhash_dedup.tables_for(1 << 40)) > 15


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 500)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, **{1000 + i: 1000 for i in range(1, 500)}}


def test_edges(edge, empty):
    got = simhash_dedup.near_duplicates(edge).select("doc_id", "fp", "component_id").collect()
    assert len(got) == edge.count()
    assert {r.component_id for r in got if r.fp == 0} == {1}  # null, empty and blank texts, with and without an id
    assert [r.component_id for r in got if r.doc_id in (4, 5)] == [4, 4, 4]
    assert simhash_dedup.near_duplicates(empty).count() == 0
    kept = simhash_dedup.drop_near_duplicates(edge)
    assert kept.columns == edge.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(4) == 1 and 5 not in ids and 1 in ids and 2 not in ids and 6 in ids and ids.count(None) == 1
    assert simhash_dedup.drop_near_duplicates(empty).count() == 0


def test_fingerprints_and_edits(spark, sf_dir, texts):
    import hashlib

    got = {r.doc_id: r for r in fingerprints.query(spark, sf_dir).collect()}
    ids = sorted(texts)
    by_text: dict = {}
    for i, n in zip(ids, ids[1:] + ids[:1]):
        t, half = texts[i], len(texts[i]) // 2
        edited = t[: len(t) - half] + texts[n][:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_next == pytest.approx(likeness(r.fingerprint, got[n].fingerprint)) and r.near_edited == pytest.approx(likeness(r.fingerprint, r.edited_fingerprint))
        by_text.setdefault(t, set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
    near, far = np.array([r.near_edited for r in got.values()]), np.array([r.near_next for r in got.values()])
    assert (near[:, None] > far[None]).mean() > 0.95
    prints = {i: int(r.fingerprint, 16) for i, r in got.items()}
    for i, r in got.items():
        near_ids = sum((prints[i] ^ f).bit_count() <= fingerprints.RADIUS for j, f in prints.items() if j != i)
        assert r.n_near == (near_ids if i % 20 == 0 else None)


def likeness(a, b):
    return max(0.0, float(np.cos((int(a, 16) ^ int(b, 16)).bit_count() * np.pi / 128)))


def test_search_finds_all_within_the_radius(spark):
    rnd = random.Random(1)
    base = [rnd.getrandbits(128) for _ in range(50)]
    rows = {x ^ sum(1 << b for b in rnd.sample(range(128), rnd.randint(0, 9))) for x in base for _ in range(10)}
    halves = lambda x: tuple(h - (1 << 64) if h >> 63 else h for h in (x >> 64, x & (1 << 64) - 1))
    df = lambda xs: spark.createDataFrame([halves(x) for x in xs], "hi long, lo long")
    got = {(r.q_hi, r.q_lo, r.hi, r.lo) for r in fingerprints.near_search(df(base), df(rows)).collect()}
    assert got == {(*halves(q), *halves(x)) for q in base for x in rows if (q ^ x).bit_count() <= fingerprints.RADIUS}


def test_block_tables_are_not_broadcast(spark, sf_dir):
    """However small Spark takes them for: they have 28 rows for each fingerprint. Nor is what has a row for each document."""
    rows = spark.range(200).select(F.xxhash64("id").alias("hi"), F.xxhash64("id", F.lit(1)).alias("lo"))
    plan = fingerprints.near_search(rows.where("id % 20 = 0"), rows)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    plan = fingerprints.fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_fingerprints_run_without_python(spark, sf_dir):
    plan = fingerprints.fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_fingerprint_edges(edge, empty, spark):
    got = fingerprints.fingerprint_documents(edge).collect()
    assert len(got) == edge.count()
    assert all((r.hi, r.lo) == (0, 0) for r in got if r.n_chars == 0)
    assert len({(r.hi, r.lo) for r in got if r.doc_id in (4, 5)}) == 1
    assert fingerprints.fingerprint_documents(empty).count() == 0
    alone = fingerprints.fingerprint_documents(edge.where("doc_id = 8")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0


def test_next_goes_over_the_ends_of_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 3)
    rows = [(i * 7 % 101, f"t{i * 7 % 101}") for i in range(101)]
    got = {r.doc_id: r._next_text for r in fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: f"t{(i + 1) % 101}" for i in range(101)}


def test_next_among_many_rows_of_one_id(spark, monkeypatch):
    """An id, and null, that fill many ranges are cut by the text's hash; rows follow each other in that order, all round."""
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 4)
    rows = [(None, f"n{i}") for i in range(60)] + [(7, f"h{i}") for i in range(90)] + [(i, f"t{i}") for i in (1, 3, 9, 12, 13)] + [(7, "h0")] * 3
    got = fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    order = sorted(((r.doc_id is not None, r.doc_id or 0, r._key, r.text) for r in got))
    assert len(got) == len(rows)
    after = {a[1:]: b[3] for a, b in zip(order, order[1:] + order[:1])}
    for r in got:
        wanted = after[(r.doc_id or 0, r._key, r.text)]
        assert r._next_text == wanted or r.text == r._next_text == "h0"


@pytest.mark.parametrize("n", [23, 24, 25, 26, 60])
def test_terms_do_not_switch_at_long_words(spark, n):
    """Two texts that differ in the length of one word, on each side of the bound, stay alike; so do texts without spaces, edited."""
    words = [f"word{i} of" for i in range(200)]
    long = "".join(random.Random(n).sample("abcdefghijklmnopqrstuvwxyz" * 3, n + 1))
    cjk = "".join(chr(0x4E00 + i * 37 % 5000) for i in range(400))
    rows = [(0, " ".join([*words, long[:n]])), (1, " ".join([*words, long])), (2, cjk), (3, "前" + cjk[:200] + cjk[203:])]
    got = {r._row: r for r in fingerprints.simhash(spark.createDataFrame(rows, "_row long, text string"), "text", ["_row"]).collect()}
    bits = lambda a, b: ((got[a].hi ^ got[b].hi) & (1 << 64) - 1).bit_count() + ((got[a].lo ^ got[b].lo) & (1 << 64) - 1).bit_count()
    assert bits(0, 1) <= 16 and bits(2, 3) <= 24 and bits(0, 2) > 40


def brute_print(text):
    """128 bits of weighted word pairs, term by term."""
    def xx(raw, seed=42):
        return xxhash.xxh64_intdigest(raw, seed=seed)

    words = []
    for w in re.split(r"[\x20\x09-\x0D]+", (text or "").strip(" \t\n\x0b\x0c\r")):
        words += [w[i : i + 6] for i in range(len(w) - 5)] if len(w) > 24 else [w]
    if words == [""]:
        return 0
    votes, total = np.zeros(128, int), 0
    for a, b in zip(words, words[1:]) if len(words) > 1 else [(words[0], None)]:
        term = a if b is None else f"{a} {b}"
        weight = min(4, 1 + len(term.encode()) // 6)
        h = xx(term.encode())
        g = xx(h.to_bytes(8, "little"))
        votes += weight * np.array([h >> i & 1 for i in range(64)] + [g >> i & 1 for i in range(64)])
        total += weight
    bits = [int(2 * v > total) for v in votes]
    return sum(b << (64 + i) for i, b in enumerate(bits[:64])) | sum(b << i for i, b in enumerate(bits[64:]))


def test_fingerprints_against_brute_force(spark, sf_dir, texts):
    got = {r.doc_id: r.fingerprint for r in fingerprints.query(spark, sf_dir).collect()}
    some = sorted(texts, key=lambda i: len(texts[i]))
    assert all(got[i] == f"{brute_print(texts[i]):032x}" for i in some[:120])
    rows = [(0, "x" * 40 + " " + "日本" * 30 + " end"), (1, ""), (2, None), (3, "one"), (4, "a\x85b  c")]
    own = {r._row: ((r.hi & (1 << 64) - 1) << 64) | (r.lo & (1 << 64) - 1) for r in fingerprints.simhash(spark.createDataFrame(rows, "_row long, text string"), "text", ["_row"]).collect()}
    assert own == {i: brute_print(t) for i, t in rows}
