"""Spelling variants: words one inserted, deleted or replaced code point apart, found by rolling-hash deletion keys.

Words are counted where texts are read; their counts meet by word. From the prefix and suffix sums of a polynomial over a word's code
points, NumPy gives all keys of all words at once: one of the word itself, one of it without each of its code points, and one of it with
each code point left open. Keys are dealt by their top bits and sorted. A word itself meets the words that a deletion turns into it;
words with one place left open meet each other, at most one for each letter of the alphabet. Both are neighbours unless hashes collide,
so each pair is verified on the words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import discard, spread, stash, steps_of, table, tidied

#: Letters of words, and the misspelling of the contract.
LETTERS = r"A-Za-zÀ-ÿ"
EVERY = 199
#: Code points and occurrences of a word at least; times as frequent a form is at least.
LEAST_LETTERS, LEAST_COUNT, TIMES = 6, 5, 5
_RUN, _OTHER = re.compile(f"[{LETTERS}]{{{LEAST_LETTERS},}}"), re.compile(f"[^{LETTERS}]")
#: Characters of a text whose runs are held at once; words that a task counts before it hands them on.
STRETCH, HELD = 1 << 20, 200_000
#: Code points whose keys are made at once.
STEP = 1 << 17
BASE = np.uint64(0x9E3779B97F4A7C15)
#: The code point that stands for an open place; no text has it.
OPEN = np.uint64(0x110000)
WHOLE, SHORTER, OPENED = 0, 1, 2


def runs(text: str) -> Counter:
    """The runs of ``LEAST_LETTERS`` letters or more of a whole text whose A-Z are lower-cased, and how often each occurs."""
    if len(text) <= STRETCH:
        return Counter(_RUN.findall(text))
    out: Counter = Counter()
    at = 0
    while at < len(text):
        cut = _OTHER.search(text, min(at + STRETCH, len(text)))  # no run is cut
        end = cut.start() if cut else len(text)
        out.update(_RUN.findall(text, at, end))
        at = end
    return out


def respelled(run: str, salt: int) -> str:
    """The run as it counts: without one code point where ``EVERY`` divides its hash. ``salt``: the crc32 of the document's id and a colon."""
    h = zlib.crc32(run.encode(), salt)
    if h % EVERY:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def counted(docs: DataFrame) -> DataFrame:
    """``word, n`` of all of ``docs(doc_id, text)``: words of ``LEAST_LETTERS`` code points with ``LEAST_COUNT`` occurrences, or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return made

        for batch in batches:
            for part in steps_of(batch, "text", 4 << 20, 4096):
                for id_, text in zip(part.column("_id").to_pylist(), pc.ascii_lower(part.column("text"))):
                    salt = zlib.crc32(f"{id_}:".encode())
                    for r, n in runs(text.as_py()).items():
                        w = respelled(r, salt)
                        if len(w) >= LEAST_LETTERS:
                            total[w] += n
                    if len(total) >= HELD:
                        yield out()
        yield out()

    own = docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), "text")
    return own.mapInArrow(lambda b: tidied(run(b)), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _mixed(x: np.ndarray, tag: np.ndarray | int) -> np.ndarray:
    """Spread over all bits, so that the top ones deal evenly; keys of different tags don't meet."""
    x = x + np.uint64(0xD1B54A32D192ED03) * np.asarray(tag, np.uint64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def keys_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All keys of some words: the key, the word's place in the list, the kind of key.

    With c_j the code points, a word's hash is the sum of c_j * BASE**j modulo 2**64. Without c_i it is the prefix sum up to i and, of what
    follows, the suffix sum in which each power is one less; with c_i left open it is the whole with one term exchanged. Of a run of one
    letter only the first deletion is kept, as all give one string. Lengths are part of the tag.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(points)) - first[owner]
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(sizes.max(initial=0)), BASE)]), dtype=np.uint64)
    sums = lambda x: np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)])
    term = points * powers[place]
    up, down = sums(term), sums(np.where(place > 0, points * powers[np.maximum(place - 1, 0)], np.uint64(0)))
    whole = up[first[1:]] - up[first[:-1]]
    at, end = np.arange(len(points)), first[1:][owner]
    shorter = (up[at] - up[first[:-1]][owner]) + (down[end] - down[at + 1])
    opened = whole[owner] - term + OPEN * powers[place]
    begins = (place == 0) | (points != np.concatenate([[np.uint64(0)], points[:-1]]))
    key = np.concatenate([_mixed(whole, 2 * sizes), _mixed(shorter, 2 * (sizes[owner] - 1))[begins], _mixed(opened, 2 * sizes[owner] + 1)])
    kind = np.repeat(np.array([WHOLE, SHORTER, OPENED], np.int8), [len(words), int(begins.sum()), len(points)])
    return key.view(np.int64), np.concatenate([np.arange(len(words)), owner[begins], owner]), kind


def _keys(words: DataFrame) -> DataFrame:
    """``key, id, kind`` for each key of ``words(id, word)``."""

    def steps(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Some words at a time, by their letters; a long one alone."""
        ends = np.cumsum(pc.utf8_length(batch.column("word")).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP, "right")))
            yield batch.slice(at, end - at)
            at = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                key, word, kind = keys_of(part.column("word").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(key), part.column("id").take(pa.array(word)), pa.array(kind)], names=["key", "id", "kind"])

    return words.select("id", "word").mapInArrow(run, "key long, id long, kind byte")


def _met(key: np.ndarray, id_: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ids of one key, in rows sorted by key and kind: a whole word and a shortened one, or two with an open place."""
    a, b = [], []
    step = 1
    while True:
        same = np.flatnonzero(key[step:] == key[:-step]) if step < len(key) else np.zeros(0, np.int64)
        if not len(same):
            break
        left, right = same, same + step
        fit = ((kind[left] == OPENED) & (kind[right] == OPENED)) | ((kind[left] == WHOLE) & (kind[right] == SHORTER))
        a.append(id_[left[fit]])
        b.append(id_[right[fit]])
        step += 1
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def candidates(words: DataFrame) -> DataFrame:
    """``a, b``: ids of ``words(id, word)`` that share a key, each pair once. Keys are dealt by their top 16 bits and sorted within the
    partition by Spark, whose sort of whole numbers is by radix and may spill; rows of one key are compared as they stream by. Under one
    key lie a word and its extensions by one letter, or words that differ in one place: some tens each at most, but for collisions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int8)]
        for batch in batches:
            own = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("key", "id", "kind"))]
            last = int(np.searchsorted(own[0] == own[0][-1], True)) if len(own[0]) else 0  # the last key may go on
            held = [x[last:] for x in own]
            a, b = _met(*[x[:last] for x in own])
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
        a, b = _met(*held)
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    dealt = _keys(words).repartition(F.shiftrightunsigned("key", 48)).sortWithinPartitions("key", "kind")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_words(words: DataFrame) -> DataFrame:
    """``id, near, n``: for each of ``words(id, word, n)`` the words near it, with their counts; each pair both ways. Pairs that only a
    collision of hashes proposed go: the edit distance of the words, looked for within one step of the diagonal, must be one."""
    own = lambda x: words.select(F.col("id").alias(x), F.col("word").alias(f"{x}_word"), F.col("n").alias(f"{x}_n"))
    pairs = candidates(words).join(own("a"), "a").join(own("b"), "b").where(F.levenshtein("a_word", "b_word", 1) == 1)
    both = F.array(F.struct(F.col("a").alias("id"), F.col("b_word").alias("near"), F.col("b_n").alias("n")), F.struct(F.col("b").alias("id"), F.col("a_word").alias("near"), F.col("a_n").alias("n")))
    return pairs.select(F.explode(both).alias("x")).select("x.*")


def rooted(forms: DataFrame) -> DataFrame:
    """``word, root`` for each of ``forms(word, form)``, by pointer doubling. Each form is ``TIMES`` as frequent as its word at least, so that
    no chain has a circle or more steps than a count has digits to that base; each round is written, and they end when none moves."""
    now = stash(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("_at"), F.col("root").alias("_root"))
        after = stash(now.join(onward, now["root"] == onward["_at"], "left").select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")), "roots")
        discard(now)
        now = after
        if not now.where("moved").limit(1).count():
            return now.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each word of ``docs(doc_id, text)``.

    Null and empty texts have no words; a null id counts as no digits. Texts and words of any length are taken whole; repeated rows count
    again; of equally frequent near words the first by code point is the form; other columns are ignored; an empty table gives no rows.
    """
    words = stash(counted(docs).select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col("near").alias("word")))
    near = near_words(words).groupBy("id").agg(F.count("*").alias("n_near"), best.alias("best"))
    rows = words.join(near, "id", "left").withColumn("_fits", -F.col("best.less") >= TIMES * F.col("n"))
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("_fits"), F.col("best.word")).alias("form"), F.when(F.col("_fits"), -F.col("best.less")).alias("form_n"))
    rows = stash(rows, "forms")
    roots = rooted(rows.where("form is not null").select("word", "form"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark, sf_dir: str) -> DataFrame:
    return variants(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
