"""Language ID, quality, nearest neighbours."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import ann, langid, quality


def brute_vector(text, seed=9):
    """Trigram by trigram; each letter's vector is drawn alone."""
    out = np.zeros(langid.DIM, int)
    syms = [0, *(ord(c.lower()[0]) if c.isalpha() else 0 for c in text or ""), 0]
    own = {s: langid.letter_vectors(np.array([s]), seed)[0].astype(int) for s in set(syms)}
    for a, b, c in zip(syms, syms[1:], syms[2:]):
        if b:
            out += np.roll(own[a], 2) * np.roll(own[b], 1) * own[c]
    return out


def test_text_vectors_bind_and_bundle(monkeypatch):
    texts = ["Ab c1d", None, "", "日本語のテキスト 漢字かな交じり文", "Привет, мир!", "𝔘𝔫𝔦 a𐐀𐐨", "é\u0301x"]
    wanted = np.stack([brute_vector(t) for t in texts]).astype(np.float32)
    assert np.array_equal(langid.text_vectors(texts), wanted)
    monkeypatch.setattr(langid, "TRIGRAMS", 3)
    assert np.array_equal(langid.text_vectors(texts), wanted)


def test_each_letter_has_a_vector_of_its_own():
    letters = [ord(c) for c in "abzåжщωשقかカ漢字한"] + [0x4E00 + 37 * i for i in range(500)]
    v = langid.letter_vectors(np.array(letters)).astype(int)
    cosines = v @ v.T / langid.DIM
    assert (np.abs(cosines - np.eye(len(letters))) < 0.2).all() and set(np.unique(v)) == {-1, 1}


def test_many_letters_at_once():
    rnd = random.Random(4)
    texts = ["".join(chr(0x4E00 + rnd.randrange(3000)) for _ in range(300)) for _ in range(20)]
    assert np.array_equal(langid.text_vectors(texts), np.stack([brute_vector(t) for t in texts]).astype(np.float32))


def test_long_texts_are_taken_apart_without_loss(monkeypatch):
    texts = ["abc def " * 50, "xyz"]
    whole = langid.text_vectors(texts)
    monkeypatch.setattr(langid, "PIECE", 7)
    assert np.array_equal(whole, langid.text_vectors(texts))


def test_language_query_against_brute_force(spark, sf_dir):
    """All of it one document at a time: sample (all rows, at this size), prototypes, cosines, the best of them and its share."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()
    norm = lambda x: x / np.linalg.norm(x) if np.linalg.norm(x) else x * 0.0
    own = {r.doc_id: norm(brute_vector(r.text)) for r in rows}
    langs = sorted({r.lang for r in rows if r.lang})
    sums = [norm(sum(own[r.doc_id] for r in rows if r.lang == k and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 5)) for k in langs]
    prototypes = np.stack([norm(s - np.mean(sums, axis=0)) for s in sums])
    for r in langid.query(spark, sf_dir).collect():
        cosines = prototypes @ own[r.doc_id]
        if not own[r.doc_id].any():
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        share = np.exp(12 * cosines) / np.exp(12 * cosines).sum()
        assert r.score == pytest.approx(share.max(), abs=1e-4)
        assert cosines[langs.index(r.lang_pred)] >= cosines.max() - 1e-5


def test_rejection_does_not_depend_on_the_number_of_languages(spark):
    """Short clean texts stay, whether there is one language or thirty."""
    rnd = random.Random(9)
    for n in (1, 2, 30):
        alphabets = [[chr(0x61 + rnd.randrange(26)) + chr(0x61 + rnd.randrange(26)) for _ in range(14)] for _ in range(n)]
        word = lambda k: "".join(rnd.choice(alphabets[k]) for _ in range(rnd.randint(1, 4)))
        rows = [(40 * k + i, " ".join(word(k) for _ in range(12)), f"l{k:02d}") for k in range(n) for i in range(40)]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        assert langid.accepted(df).count() >= 0.99 * len(rows)


def test_language_of_held_out_documents(spark, sf_dir, documents):
    got = langid.query(spark, sf_dir).join(documents.select("doc_id", "lang", F.char_length("text").alias("n")), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.n > 50]
    assert len(got) == documents.count() and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)


def test_language_edges(edge, empty):
    model = langid.learn(edge)
    got = {(r.doc_id, r.text): (r._lang, r._score) for r in langid.predict(edge.select("doc_id", "text"), model).collect()}
    for key in ((1, None), (2, ""), (3, " \n\t"), (9, "1234 5678 !!"), (None, None)):
        assert got[key] == ("und", 0.0)
    assert all(0 < s <= 1 for (i, _), (lang, s) in got.items() if i in (4, 6, 8, 10))
    assert langid.learn(empty).langs == [] and langid.predict(empty, model).count() == 0
    kept = langid.accepted(edge)
    assert kept.columns == edge.columns and {r.doc_id for r in kept.collect()} >= {4, 6, 7} and not {r.doc_id for r in kept.collect()} & {1, 2, 3, 9}
    assert langid.accepted(edge.withColumn("lang", F.lit(None).cast("string"))).where("doc_id = 8").count() == 1


def test_trees_walk_like_a_loop():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(600, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < 0)).astype(float)
    trees = quality.fit(x, y, rounds=20)
    p = trees.predict(x)
    assert ((p > 0.5) == y).mean() > 0.95

    def one(row):
        total = trees.base
        for f, c, v in zip(trees.feature, trees.cut, trees.value):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > c[node])
            total += v[node - len(f)]
        return 1 / (1 + math.exp(-total))

    assert np.allclose(p[:50], [one(r) for r in x[:50]])
    assert quality.fit(x, np.ones(600)).predict(x)[0] > 0.99 and quality.fit(x[:0], y[:0]).predict(x)[0] == 0.5


def brute_statistics(text):
    raw = (text or "").encode()
    n, words, lines = len(raw), raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    out = dict.fromkeys(quality.FEATURES, 0.0)
    if not n:
        return list(out.values())
    share = lambda test: sum(map(test, raw)) / n
    out["log_bytes"] = math.log1p(n)
    for name, chars in (("digit", b"0123456789"), ("space", b" \t\r\x0b\x0c"), ("newline", b"\n"), ("sentence_marks", b".,;:?"), ("exclamations", b"!"), ("pipes", b"|"), ("symbols", b"#$%&*<>{}[]\\/=+~^_@"), ("quotes", b"\"'`()")):
        out[name] = share(lambda c, chars=chars: c in chars)
    out["upper"], out["lower"] = share(lambda c: 65 <= c <= 90), share(lambda c: 97 <= c <= 122)
    out["non_ascii"], out["control"] = share(lambda c: c >= 128), share(lambda c: c < 32 and c not in (9, 10, 11, 12, 13) or c == 127)
    if words:
        lens = [len(w) for w in words]
        mean = sum(lens) / len(lens)
        out |= {"log_words": math.log1p(len(words)), "mean_word": mean, "sd_word": (sum((x - mean) ** 2 for x in lens) / len(lens)) ** 0.5, "max_word": math.log1p(max(lens)), "distinct_words": len(set(words)) / len(words)}
        out |= {"short_words": sum(x <= 3 for x in lens) / len(lens), "symbol_ends": sum(w[-1:] in [bytes([c]) for c in b"#$%&*<>{}[]\\/=+~^_@|!"] for w in words) / len(words), "upper_starts": sum(b"A" <= w[:1] <= b"Z" for w in words) / len(words)}
        out |= {"most_common_word": max(map(words.count, set(words))) / len(words), "distinct_pairs": len({(a, b) for a, b in zip(words, words[1:])}) / max(1, len(words) - 1)}
    if lines:
        out |= {"log_lines": math.log1p(len(lines)), "distinct_lines": len(set(lines)) / len(lines), "mean_line": math.log1p(n / len(lines)), "closed_lines": sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / len(lines)}
    return list(out.values())


def test_quality_query_against_loops(spark, sf_dir):
    """Statistics one by one, trees fitted on the labelled rows that aren't held out, and walked node by node."""
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r.quality is not None}
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    x = {i: np.array(brute_statistics(t), np.float32) for i, t in rows.items()}
    for t in ("a\x00b é\n\n  Two! three?\nA|b #", " \n", "one"):
        assert np.allclose(quality.statistics(t), brute_statistics(t), atol=1e-12)
    learnt = [i for i in sorted(labels) if i in x and not held(i)]
    trees = quality.fit(np.stack([x[i] for i in learnt]), np.array([float(labels[i] > 0) for i in learnt]))
    for r in quality.query(spark, sf_dir).collect():
        total = trees.base
        for f, c, v in zip(trees.feature, trees.cut, trees.value):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(x[r.doc_id][f[node]] > c[node])
            total += v[node - len(f)]
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-6) and r.held_out == held(r.doc_id)


def test_repeated_labels(spark):
    x = quality.with_statistics(spark.createDataFrame([(i, f"text {i} " * (i + 1)) for i in range(40)], "doc_id long, text string"))
    rows = [(i, int(i > 20)) for i in range(40)]
    once = quality.learn(x, spark.createDataFrame(rows, "doc_id long, quality int"))
    again = quality.learn(x, spark.createDataFrame([*rows, *rows, *rows[:5], (None, 1)], "doc_id long, quality int"))
    assert all(np.array_equal(a, b) for a, b in zip((once.feature, once.cut, once.value), (again.feature, again.cut, again.value)))


def test_quality_of_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = quality.query(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)


def test_quality_edges(spark, edge, empty):
    x = quality.with_statistics(edge)
    labels = spark.createDataFrame([(4, 1), (6, None), (None, 0)], "doc_id long, quality int")
    trees = quality.learn(x, labels)
    got = quality.score(x, trees).collect()
    assert len(got) == edge.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.score(quality.with_statistics(empty), quality.learn(quality.with_statistics(empty), labels.limit(0))).count() == 0
    assert not quality.statistics(None).any() and np.isfinite(quality.statistics("\x00 é")).all()


def brute_nearest(rows, k, asks):
    out = {}
    ids = np.array(sorted(rows))
    x = np.stack([rows[i] for i in ids])
    for q in ids[[bool(asks(i)) for i in ids]]:
        d = np.sqrt(((x - rows[q]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != q][:k]
        out[int(q)] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def found(df):
    out: dict = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_recall_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART_ROWS", 250)
    rnd = np.random.default_rng(4)
    centres = rnd.normal(size=(40, 16))
    x = (centres[rnd.integers(0, 40, 4000)] + 0.4 * rnd.normal(size=(4000, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    router = ann.fit(x[:2000].astype(float), ann.parts_for(4000, 2000))
    assert router.w2.shape[1] == 16 and router.probes < 10
    got, wanted = found(ann.search(df, F.col("id") % 20 == 0)), brute_nearest({i: v.astype(float) for i, v in enumerate(x)}, 10, lambda i: i % 20 == 0)
    assert got.keys() == wanted.keys() and all(len(v) == 10 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in wanted[q]}) for q in wanted)
    assert hits >= 0.9 * 10 * len(wanted)
    for q, rows in got.items():
        assert rows == sorted(rows, key=lambda r: (r[1], r[0]))
        for i, s in rows:
            assert s == pytest.approx(float(np.sqrt(((x[i].astype(float) - x[q]) ** 2).sum())), rel=1e-14)


def test_routing_prunes_a_clustered_table(spark, monkeypatch):
    """50,000 vectors in clusters: fewer than half of the parts are searched, and of the table's own neighbours 0.9 or more found."""
    seen, real = [], ann.fit
    monkeypatch.setattr(ann, "fit", lambda *a, **b: seen.append(real(*a, **b)) or seen[-1])
    rnd = np.random.default_rng(9)
    centres = rnd.normal(size=(300, 24))
    x = (centres[rnd.integers(0, 300, 50_000)] + 0.35 * rnd.normal(size=(50_000, 24))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = found(ann.search(df, F.col("id") % 500 == 0))
    parts = seen[0].w2.shape[1]
    assert parts == 24 and seen[0].probes < parts / 2, (parts, seen[0].probes)
    hits = 0
    for q in range(0, 50_000, 500):
        d = ((x.astype(float) - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len({i for i, _ in got[q]} & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert hits >= 0.9 * 10 * 100, hits


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_against_brute_force(spark, monkeypatch, sf):
    """The table's own vectors go through parts as those of any size: recall of 0.9 or more, exact distances, more than one part."""
    seen, real = [], ann.fit
    monkeypatch.setattr(ann, "fit", lambda *a, **b: seen.append(real(*a, **b)) or seen[-1])
    rows = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet").collect()}
    got, wanted = found(ann.query(spark, f"/root/testdata/sf{sf}")), brute_nearest(rows, 10, lambda i: i % 100 == 0)
    assert seen[0].w2.shape[1] == 8
    assert got.keys() == wanted.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in wanted[q]}) for q in wanted)
    assert hits >= 0.9 * sum(map(len, wanted.values()))
    for q, near in got.items():
        assert len(near) == 10 and near == sorted(near, key=lambda r: (r[1], r[0]))
        assert all(s == pytest.approx(float(np.sqrt(((rows[i] - rows[q]) ** 2).sum())), rel=1e-13) for i, s in near)


def test_parts_grow_with_rows():
    assert [ann.parts_for(n, min(n, ann.SAMPLE)) for n in (10, 63, 64, 300, 4095, 4096, 16_383, 16_384, 1 << 20, 1 << 30)] == [1, 1, 2, 8, 8, 8, 8, 8, 512, 512]


def test_parts_are_cut_again(spark, monkeypatch):
    """Two levels, with pieces within parts: recall of 0.9 or more."""
    monkeypatch.setattr(ann, "PART_ROWS", 100)
    monkeypatch.setattr(ann, "SAMPLE", 512)
    monkeypatch.setattr(ann, "ROUTED", 300)
    monkeypatch.setattr(ann, "PIECE", 50)
    rnd = np.random.default_rng(6)
    x = (rnd.normal(size=(60, 12))[rnd.integers(0, 60, 6000)] + 0.5 * rnd.normal(size=(6000, 12))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    levels, real = [], ann.within_parts

    def counted(*a, **b):
        out = real(*a, **b)
        levels.append(out.where("asks = 0").select("part", "sub").distinct().groupBy("part").count().agg(F.count("*"), F.max("count")).first())
        return out

    monkeypatch.setattr(ann, "within_parts", counted)
    got, wanted = found(ann.search(df, F.col("id") % 50 == 0, sample=512)), brute_nearest({i: v.astype(float) for i, v in enumerate(x)}, 10, lambda i: i % 50 == 0)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in wanted[q]}) for q in wanted)
    assert hits >= 0.9 * 10 * len(wanted) and all(len(v) == 10 for v in got.values())
    assert levels[0][0] > 4 and levels[0][1] > 2


def test_parts_are_balanced():
    rnd = np.random.default_rng(2)
    graph = ann.neighbour_graph(rnd.normal(size=(1000, 8)))
    sizes = np.bincount(ann.balanced_parts(graph, 8), minlength=8)
    assert sizes.sum() == 1000 and sizes.max() <= 1.1 * 125 + 2


def test_copies_and_unusable_vectors(spark):
    nan = float("nan")
    rows = [(i, [1.0, 2.0]) for i in range(0, 60)] + [(60, [1.0, 2.5]), (61, [3.0, 3.0]), (62, None), (63, [0.0, 0.0]), (64, [nan, 1.0]), (65, [None, 1.0]), (66, [float("inf"), 1.0]), (None, [1.0, 1.0]), (67, [1.0, 2.0, 3.0]), (61, [3.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("*", *[F.lit("x").alias(c) for c in ("id", "rep", "q", "part", "rank")])
    got = found(ann.search(df, F.col("id") % 20 == 0))
    assert got[0] == [(i, 0.0) for i in range(1, 11)] and got[20] == [(i, 0.0) for i in range(10)]
    assert got[60] == [(i, 0.5) for i in range(10)] and set(got) == {0, 20, 40, 60}
    other = spark.createDataFrame([(i, [float(i)] * (2 + i % 2)) for i in range(1, 9)], "vec_id long, embedding array<double>")
    assert found(ann.search(other, F.col("id") == 4)) == {4: [(i, pytest.approx(abs(4 - i) * 2**0.5)) for i in (2, 6, 8)]}
    assert ann.search(df.limit(0), F.col("id") % 20 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert found(ann.search(few, F.col("id") == 0)) == {0: [(1, 1.0)]}
