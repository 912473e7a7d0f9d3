"""Language ID with hyperdimensional profiles.

Each letter has a random vector of +-1. A trigram's vector binds the letters' vectors, each permuted by its place, with an
elementwise product; a text's vector bundles (sums) its trigrams' vectors; a language's prototype bundles the vectors of its
sample texts. The prediction is the language whose prototype has the largest cosine with the text's vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import crc_of_id, fresh, spread, steps_of, table, tidied

DIM = 1024
#: Texts are taken apart into pieces of this many characters; a step works on about ``STEP`` characters, and on so many trigrams at once.
PIECE, STEP, TRIGRAMS = 1 << 20, 1 << 20, 4096
#: Bound of the sample that prototypes are learnt from: documents of each language, about.
SAMPLE = 3000
UNKNOWN = "und"
_U = np.uint64


def _folded() -> np.ndarray:
    """Code point below 65,536 -> the code point of its letter in lower case, 0 where it is no letter."""
    return np.fromiter((ord(chr(cp).lower()[0]) if chr(cp).isalpha() else 0 for cp in range(0x10000)), np.uint32, 0x10000)


_LUT: list[np.ndarray] = []


def symbols_of(text: str) -> np.ndarray:
    """Of each character the code point of its letter, either case; 0 where it is no letter."""
    if not _LUT:
        _LUT.append(_folded())
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    high = cps >= 0x10000
    if not high.any():
        return _LUT[0][cps]
    out = _LUT[0][np.where(high, 0, cps)]
    for cp in np.unique(cps[high]):
        if chr(cp).isalpha():
            out[cps == cp] = ord(chr(cp).lower()[0])
    return out


def letter_vectors(symbols: np.ndarray, seed: int = 9) -> np.ndarray:
    """(symbols, dim): a vector of +-1 for each code point, drawn from a hash of it, so that each letter has its own."""
    x = (symbols.astype(_U)[:, None] * _U(DIM // 64) + np.arange(DIM // 64, dtype=_U)) * _U(0x9E3779B97F4A7C15) + _U(seed)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return (np.unpackbits(x.astype("<u8").view(np.uint8), axis=1).view(np.int8) << 1) - 1


def text_vectors(texts: list[str | None], seed: int = 9) -> np.ndarray:
    """(texts, dim): the bundled trigrams of each text; zero for null and for texts without a letter."""
    out = np.zeros((len(texts), DIM), np.float32)
    pieces: list[tuple[int, str]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if not pieces:
            return
        letters = symbols_of("".join(p for _, p in pieces))
        # The letters met here are numbered, 0 first; a trigram is a number of three such digits.
        met = np.zeros(0x110000, bool)
        met[0] = True
        met[letters] = True
        symbols = np.flatnonzero(met)
        number = np.zeros(0x110000, np.int32)
        number[symbols] = np.arange(len(symbols))
        syms, n = number[letters].astype(np.int64), len(symbols)
        lens = np.array([len(p) for _, p in pieces])
        row = np.repeat(np.arange(len(pieces)), lens)
        ok = np.ones(len(syms), bool)
        ends = np.cumsum(lens)
        ok[ends - 1] = ok[ends - 2] = False
        ok[:-1] &= syms[1:] > 0  # a trigram has a letter in the middle
        at = np.flatnonzero(ok)
        codes, row = (syms[at] * n + syms[at + 1]) * n + syms[at + 2], row[at]
        if n**3 <= 1 << 21:
            seen = np.flatnonzero(np.bincount(codes, minlength=n**3))
            place = np.zeros(n**3, np.int64)
            place[seen] = np.arange(len(seen))
            codes = place[codes]
        else:
            seen = np.sort(codes)
            seen = seen[np.concatenate([[True], seen[1:] != seen[:-1]])] if len(seen) else seen
            codes = np.searchsorted(seen, codes)
        # The letters' vectors as they stand in a trigram's first, second and third place.
        own = letter_vectors(symbols, seed)
        first, second = np.roll(own, 2, axis=1), np.roll(own, 1, axis=1)
        owners = [i for i, _ in pieces]
        for k in range(0, len(seen), TRIGRAMS):
            some = seen[k : k + TRIGRAMS]
            here = (codes >= k) & (codes < k + TRIGRAMS) if len(seen) > TRIGRAMS else slice(None)
            counts = np.bincount(row[here] * len(some) + codes[here] - k, minlength=len(pieces) * len(some)).reshape(len(pieces), len(some)).astype(np.float32)
            vectors = (first[some // n**2] * second[some // n % n] * own[some % n]).astype(np.float32)
            np.add.at(out, owners, counts @ vectors)
        pieces.clear()
        size = 0

    for i, text in enumerate(texts):
        if not text:
            continue
        padded = f"\0{text}\0"
        for k in range(0, len(text), PIECE):
            pieces.append((i, padded[k : k + PIECE + 2]))
            size += len(pieces[-1][1])
            if size >= STEP or len(pieces) >= 512:
                flush()
    flush()
    return out


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


@dataclass
class Model:
    langs: list[str]
    prototypes: np.ndarray
    seed: int = 9
    sharpness: float = 12.0

    def cosines(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, langs), and which texts have a letter."""
        vectors = text_vectors(texts, self.seed)
        return unit(vectors) @ self.prototypes.T, vectors.any(axis=1)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """(texts, langs): softmax of the cosines; zeros where a text has no letter."""
        cosines, some = self.cosines(texts)
        return self.shares(cosines) * some[:, None]

    def shares(self, cosines: np.ndarray) -> np.ndarray:
        power = np.exp(self.sharpness * cosines)
        return power / np.maximum(power.sum(axis=1, keepdims=True), 1e-30)


def learn(docs: DataFrame, sample: int = SAMPLE, seed: int = 9) -> Model:
    """Prototypes from ``docs(doc_id, text, lang)``: about ``sample`` documents of each language, chosen by a hash of id and text.

    Rows whose text or lang is null don't count. Without any, the model has no language and predicts ``und``.
    """
    docs = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}  # a prototype each is held anyway
    if not counts:
        return Model([], np.zeros((0, DIM), np.float32), seed)
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, sample / n)))])
    # The text belongs to the hash: rows of one id, or of none, are a sample like others.
    chosen = docs.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20))

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                langs = np.array(part.column("lang").to_pylist(), object)
                vectors = unit(text_vectors(part.column("text").to_pylist(), seed))
                for lang in set(langs):
                    sums[lang] = sums.get(lang, 0) + vectors[langs == lang].sum(axis=0, dtype=np.float64)
        yield from _sums(sums)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for lang, v in zip(batch.column("lang").to_pylist(), batch.column("v")):
                sums[lang] = sums.get(lang, 0) + v.values.to_numpy()
        yield from _sums(sums)

    # A sum for each split and language, then one for each language: that bounds what the driver gets.
    kind = "lang string, v array<double>"
    summed = chosen.select("lang", "text").mapInArrow(bundle, kind).repartition("lang").mapInArrow(total, kind)
    got = {r["lang"]: np.array(r["v"]) for r in summed.collect()}
    langs = sorted(got)
    own = unit(np.stack([np.round(got[k], 6) for k in langs])) if langs else np.zeros((0, DIM))
    if len(langs) > 1:
        own = unit(own - own.mean(axis=0))  # what all languages share tells none apart
    return Model(langs, own.astype(np.float32), seed)


def _sums(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"])


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with three columns more (with further underscores if taken): ``_lang``, ``_score`` (0 to 1), and ``_lead``, by how much
    the best cosine is above the second (or above 0); ``und``, 0 and 0 for null texts and texts without a letter. Of equal cosines the
    language that comes first by code point is told; repeated rows stay rows; long texts are read whole, some at a time; an empty table
    gives no rows."""
    more = {"_lang": T.StringType(), "_score": T.DoubleType(), "_lead": T.DoubleType()}
    schema = T.StructType([*docs.schema.fields, *[T.StructField(fresh(docs, c), t) for c, t in more.items()]])
    names = np.array([*model.langs, UNKNOWN], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps_of(whole, text, 1 << 22, 1024):
                best, score, lead = np.full(batch.num_rows, len(names) - 1), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
                if model.langs:
                    cosines, some = model.cosines(batch.column(text).to_pylist())
                    first = cosines.argmax(axis=1)
                    at = np.arange(len(first))
                    best, score = np.where(some, first, len(names) - 1), model.shares(cosines)[at, first] * some
                    top, cosines[at, first] = cosines[at, first], 0 if len(model.langs) == 1 else -2
                    lead = (top - cosines.max(axis=1)) * some
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names[best].tolist(), pa.string()), *(pa.array(x.astype(np.float64)) for x in (score, lead))], names=[f.name for f in schema])

    return docs.mapInArrow(lambda it: tidied(run(it)), schema)


def held_out(doc_id) -> F.Column:
    return crc_of_id(doc_id) % 5 == 0


#: The pipeline rejects documents without letters, and those whose best cosine is not above the second by this much, however many
#: languages there are.
MIN_LEAD = 0.01


def accepted(docs: DataFrame, min_lead: float = MIN_LEAD) -> DataFrame:
    """The rows of ``docs`` whose language is told with ``min_lead`` at least; columns as they were. If no language can be
    learnt (none is given), all texts with a letter stay. Null and empty texts go; repeated rows stay rows; long texts are read whole; an
    empty table gives no rows."""
    model = learn(docs.where(~held_out(F.col("doc_id"))))
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    told = predict(docs, model)
    lang, _, lead = told.columns[-3:]
    return told.where((F.col(lang) != UNKNOWN) & (F.col(lead) >= min_lead)).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """Repeated rows stay rows; a null id is learnt from unless its crc32 (of the empty text) says otherwise; null and empty texts are
    ``und``; long texts are read whole; columns but id, text and lang are ignored; an empty table gives no rows."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    model = learn(docs.where(~held_out(F.col("doc_id"))))
    out = predict(docs.select("doc_id", "text"), model)  # no other columns, so the names below are these
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))
