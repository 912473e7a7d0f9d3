import random
import re
import zlib
from collections import Counter

import numpy as np

from docloom.llm import variants


def near(a, b):
    """By trying every edit place."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    counts = Counter()
    for d, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r)
            h = zlib.crc32(f"{'' if d is None else d}:{r}".encode())
            if h % 199 == 0:
                k = h % len(r)
                r = r[:k] + r[k + 1 :]
            counts[r] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}
    by_size: dict = {}
    for w in n:
        by_size.setdefault(len(w), []).append(w)
    form, many = {}, {}
    for w in n:
        own = [v for k in (-1, 0, 1) for v in by_size.get(len(w) + k, ()) if near(w, v)]
        best = min(own, key=lambda v: (-n[v], v), default=None)
        many[w] = len(own)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], many[w], n.get(form[w])))
    return out


def held(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "doc_id long, text string, word string, id string, n string").repartition(3)


def test_against_brute_force(spark):
    rnd = random.Random(1)
    words = {"".join(rnd.choice("abé") for _ in range(rnd.choice([5, 6, 6, 7, 7, 8]))) for _ in range(900)}
    often = {w: rnd.choice([1, 4, 5, 6, 25, 30, 130, 700]) for w in words}
    pool = [w for w, k in often.items() for _ in range(k)]
    rnd.shuffle(pool)
    rows = [(i, rnd.choice([" ", ", ", "\n", "1"]).join(w.upper() if rnd.random() < 0.1 else w for w in pool[i * 97 : i * 97 + 97])) for i in range(len(pool) // 97 + 1)]
    want = brute(rows)
    assert len(want) > 500 and any(r not in (w, f) for w, f, r, *_ in want)  # chains of more than one form
    got = variants.variants(frame(spark, rows))
    assert got.count() == len(want) and held(got) == want


def test_edge_rows(spark, edge):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    assert held(variants.variants(edge)) == brute(rows)
    assert held(variants.variants(edge.where("false"))) == set()
    rows = [(None, "colours colour"), (None, None), (1, ""), *[(i, "colour colours ÉCOLES École écoles ÷÷÷÷÷÷ ×××××××") for i in range(30)], (5, "Colourx"), *[(40, "colourx")] * 5]
    assert held(variants.variants(frame(spark, rows))) == brute(rows)


def test_long_words_and_texts(spark):
    """One run of letters of 30,000, with its neighbours, in a text longer than a stretch."""
    a = "xyz" * 10_000
    rows = [(i, " ".join([a, a[:-1], a + "q", a[:7000] + "w" + a[7001:]])) for i in range(6)] + [(9, "short words only " * 100_000), (10, "letter" * 200_000)] + [(11, a)] * 40
    assert held(variants.variants(frame(spark, rows))) == brute_long(rows)


def brute_long(rows):
    counts = Counter()
    for d, t in rows:
        for r, k in Counter(re.findall("[A-Za-zÀ-ÿ]+", t)).items():
            counts[variants.respelled(r, zlib.crc32(f"{d}:".encode()))] += k
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}

    def near_fast(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]

    out = set()
    best = {w: min((v for v in n if near_fast(w, v)), key=lambda v: (-n[v], v), default=None) for w in n}
    form = {w: b if b and n[b] >= 5 * n[w] else None for w, b in best.items()}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], sum(near_fast(w, v) for v in n), n.get(form[w])))
    return out


def test_runs_of_a_long_text_are_whole(monkeypatch):
    monkeypatch.setattr(variants, "STRETCH", 10)
    text = "abcdefghijklmno pqrstu vw xyzabc" * 20
    assert variants.runs(text) == Counter(re.findall("[a-z]{6,}", text))


def test_keys_are_equal_where_strings_are():
    rnd = random.Random(2)
    words = list({"".join(rnd.choice("abÿ") for _ in range(rnd.randint(1, 9))) for _ in range(400)})
    key, owner, kind = variants.keys_of(words)
    said = {}
    for w in words:
        said.setdefault(("s", w), []).append(w)
    want = [("s", w) for w in words]
    want += [("s", w[:i] + w[i + 1 :]) for w in words for i in range(len(w)) if i == 0 or w[i] != w[i - 1]]
    want += [("o", w[:i] + "?" + w[i + 1 :]) for w in words for i in range(len(w))]
    assert len(want) == len(key) and len(set(zip(want, key.tolist()))) == len(set(want)) == len(set(key.tolist()))
    assert [words[i] for i in owner[: len(words)]] == words and set(kind.tolist()) == {0, 1, 2}


def test_collisions_are_verified(spark, monkeypatch):
    """With hashes of a few bits most candidates are false; results stay."""
    rnd = random.Random(3)
    vocab = ["".join(rnd.choice("abcd") for _ in range(6)) for _ in range(150)]
    words = spark.createDataFrame([(i, w, 5 + i) for i, w in enumerate(sorted(set(vocab)))], "id long, word string, n long")
    full = {(r.id, r.near, r.n) for r in variants.near_words(words).collect()}
    monkeypatch.setattr(variants, "keys_of", lambda ws, f=variants.keys_of: (lambda k, o, t: (k & np.int64(63), o, t))(*f(ws)))
    assert variants.candidates(words).count() > 5 * len(full)
    assert {(r.id, r.near, r.n) for r in variants.near_words(words).collect()} == full
    names = {r.id: r.word for r in words.collect()}
    assert {(names[i], v) for i, v, _ in full} == {(a, b) for a in names.values() for b in names.values() if near(a, b)}
