"""Edit distance over a band: equal to the whole table, and fast for near texts."""

import random
import time

import pytest
from pyspark.sql import functions as F

from docloom.functions import edits as E


def table(a, b):
    row = list(range(len(b) + 1))
    for i, p in enumerate(a, 1):
        corner, row[0] = row[0], i
        for j, q in enumerate(b, 1):
            corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (p != q))
    return row[-1]


def edited(rnd, x, n, letters):
    x = list(x)
    for _ in range(n):
        i = rnd.randint(0, len(x))
        k = rnd.randrange(3)
        if k == 0:
            x.insert(i, rnd.choice(letters))
        elif x:
            i = min(i, len(x) - 1)
            if k == 1:
                x.pop(i)
            else:
                x[i] = rnd.choice(letters)
    return x


@pytest.mark.parametrize("first", [1, 2, 5, 32])
def test_equal_to_the_whole_table(monkeypatch, first):
    monkeypatch.setattr(E, "FIRST_BAND", first)
    rnd = random.Random(first)
    for _ in range(1500):
        letters = rnd.choice(["ab", "abcd", "abcdefghijklmnopqrst"])
        a = [rnd.choice(letters) for _ in range(rnd.randint(0, 40))]
        b = edited(rnd, a, rnd.randint(0, 25), letters) if rnd.random() < 0.7 else [rnd.choice(letters) for _ in range(rnd.randint(0, 40))]
        assert E.distance(a, b) == table(a, b) == E.distance("".join(b), "".join(a)), (a, b)


def test_a_band_gives_the_distance_or_nothing():
    rnd = random.Random(9)
    for _ in range(800):
        a = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 30)))
        b = "".join(edited(rnd, a, rnd.randint(0, 12), "abc"))
        a, b = sorted((a, b), key=len, reverse=True)
        want = table(a, b)
        for t in range(max(1, len(a) - len(b)), len(a) + 1):
            assert E.within(a, b, t) == (want if want <= t else None)


def test_long_sequences_are_fast_where_near():
    rnd = random.Random(3)
    words = [f"w{rnd.randint(0, 5000)}" for _ in range(20_000)]
    near = edited(rnd, words, 200, words)
    began = time.process_time()
    d = E.distance(words, near)
    assert 150 < d <= 200 and time.process_time() - began < 1
    text = "".join(rnd.choice("abcdefgh ") for _ in range(200_000))
    began = time.process_time()
    assert 50 < E.distance(text, "".join(edited(rnd, text, 100, "abc"))) <= 100 and time.process_time() - began < 5
    far = "".join(rnd.choice("stuvwxyz") for _ in range(30_000))
    began = time.process_time()
    assert E.distance(text[:30_000], far) == 30_000 and time.process_time() - began < 15


def test_columns(spark):
    rnd = random.Random(4)
    rows = [(i, "".join(rnd.choice("ab é語𝄞") for _ in range(n)), None) for i, n in enumerate([0, 1, 300, 700])]
    rows = [(i, a, "".join(edited(rnd, a, 9, "abé𝄞"))) for i, a, _ in rows] + [(9, None, "a"), (10, "a" * 400, None), (11, "", "x" * 300)]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    from pyspark.sql import functions as F

    got = {r.i: (r.t, r.w) for r in df.select("i", E.text_edits(F.col("a"), F.col("b")).alias("t"), E.list_edits(F.split("a", " "), F.split("b", " ")).alias("w")).collect()}
    for i, a, b in rows:
        assert got[i][0] == (None if a is None or b is None else table(a, b))
        assert got[i][1] == table((a or "").split(" ") if a is not None else [], (b or "").split(" ") if b is not None else [])


@pytest.mark.parametrize("size", [30, 200, 900])
def test_texts_that_have_little_in_common(size):
    """Bands are left early, and the whole table is taken; the distance is the same."""
    rnd = random.Random(size)
    for _ in range(6):
        letters = rnd.choice(["ab", "abcdefgh", "abcdefghijklmnopqrstuvwxyzéè "])
        a, b = ("".join(rnd.choice(letters) for _ in range(rnd.randint(size // 2, size))) for _ in range(2))
        moved = a[size // 4 :] + a[: size // 4]
        for x, y in ((a, b), (a, moved), (a, a + b), (a, b + a)):
            assert E.distance(x, y) == E.whole(x, y) == E.whole(y, x) == table(x, y)


def test_far_texts_take_one_pass():
    """Bands up to the length took 1.3 s for these texts, eleven times as long as the whole table at once."""
    rnd = random.Random(8)
    a, b = ("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(20_000)) for _ in range(2))
    began = time.process_time()
    d = E.distance(a, b)
    far = time.process_time() - began
    began = time.process_time()
    assert d == E.whole(a, b) and far < 2 * (time.process_time() - began) + 0.5


def test_far_lists_of_words_take_one_pass():
    rnd = random.Random(11)
    a, b = ([f"w{rnd.randint(0, 3000)}" for _ in range(6000)] for _ in range(2))
    began = time.process_time()
    d = E.distance(a, b)
    far = time.process_time() - began
    began = time.process_time()
    assert d == E.whole(b, a) and far < 2 * (time.process_time() - began) + 0.5


def test_words_cross_to_python_in_one_string(spark):
    """Word edits equal those of arrays of tokens; no array is sent."""
    from docloom.functions.metrics import word_count, word_edits
    from docloom.functions.text import normalise_ws, token_line, tokens

    texts = [None, "", " \t", "--", "a", "A  b_c\u00a0D9 \u00bd x\u2003y", "\u039f\u0394\u039f\u03a3\n\u03a3 \u03a3a", "e\u0301 \u0130I \u216b \u4e00\u4e8c, \U0001d538 \u0661\u0662", "a b c d\x85e f-g"]
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate((x, y) for x in texts for y in texts)], "i int, a string, b string")
    own = lambda c: tokens(normalise_ws(F.col(c)))
    got = df.select("i", word_edits(F.col("a"), F.col("b")).alias("w"), E.list_edits(own("a"), own("b")).alias("v"), word_count(token_line(F.col("a"))).alias("n"), F.size(own("a")).alias("m"))
    assert all(r.w == r.v and r.n == r.m for r in got.collect()) and len({r.w for r in got.collect()}) > 3
    plan = df.select(word_edits(F.col("a"), F.col("b")))._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "_token_edits" in plan


def test_bands_that_too_few_shared_words_rule_out_are_not_tried(monkeypatch):
    rnd = random.Random(3)
    tried, within = [], E._within
    monkeypatch.setattr(E, "_within", lambda a, b, t: tried.append(t) or within(a, b, t))
    for _ in range(30):
        a = [rnd.choice("abcdefgh") for _ in range(rnd.randint(80, 300))]
        b = [rnd.choice("abcdijkl" if rnd.random() < 0.5 else "wxyz") for _ in range(len(a) - rnd.randint(0, 20))]
        assert E.distance(a, b) == table(a, b) == E.whole(a, b)
    few = len(tried)
    a = [str(i) for i in range(400)]
    assert E.distance(a, ["x", *a[:300]]) == 101 and tried[few:] == [100]
    assert E.distance([*a, "y"], [f"-{i}" for i in range(400)]) == 401 and len(tried) == few + 1
