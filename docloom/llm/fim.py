"""Fill-in-the-middle: a text is cut in three at two places and put together in another order, by a parallel automaton scan.

One automaton reads the bytes of UTF-8: its states are the bytes of a character still to come and the beginning of a mark that has
been read; it tells where a unit (a code point) ends, and where a mark of the format ends, which such a text must not hold. A text is
taken apart in blocks at any byte. Each block gives, for each state that it may be entered in, the state it is left in and how many
units and marks end within. These functions are composed, which is associative: first over the blocks of a piece, by doubling, then
over the pieces of a document. That resolves the state and the counts at each block's start, so the block that holds the k-th unit's
end is found by search and is alone read again. Documents of one piece are done where they are read; the pieces of longer ones are
dealt to all tasks, and only their functions, a row of some bytes for each, meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import spread, stash, steps_of, table, tidied

#: The marks of prefix, suffix and middle, and the shares (of 100) of texts rewritten and of those with the suffix first.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
REWRITTEN, SUFFIX_FIRST = 90, 20
SEED = 1
#: Bytes of a block; bytes of a piece, beyond which a document is dealt to several tasks.
BLOCK, PIECE = 64, 1 << 16
FORMS = np.array(["plain", "psm", "spm"])
#: A byte that UTF-8 never has fills the last block.
FILL = 0xFF
UNIT, MARK = 0, 1


def automaton() -> tuple[np.ndarray, np.ndarray]:
    """``after`` and ``ends``, by state * 256 + byte: the next state; bit 0 where a unit ends, bit 1 where a mark does.

    State 0: between characters; 1: after ``<``; 2: after ``<`` and a mark's letter; 3 to 5: one to three bytes of a character to come.
    """
    after, ends = np.zeros((6, 256), np.uint8), np.zeros((6, 256), np.uint8)
    after[:, 0xC0:0xE0], after[:, 0xE0:0xF0], after[:, 0xF0:0xF8] = 3, 4, 5
    ends[:, :0x80] = 1
    after[:, ord("<")] = 1
    for mark in (PREFIX, SUFFIX, MIDDLE):
        after[1, ord(mark[1])] = 2
    ends[2, ord(">")] |= 2
    for to_come in (1, 2, 3):
        after[2 + to_come, 0x80:0xC0] = 1 + to_come if to_come > 1 else 0
    ends[3, 0x80:0xC0] = 1
    after[:, FILL], ends[:, FILL] = np.arange(6), 0
    return after.ravel(), ends.ravel()


AFTER, ENDS = automaton()
STATES = 6


class Scan:
    """Pieces of bytes, read in blocks; all blocks take a step together, from each state."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        blocks = -(-self.sizes // BLOCK)
        self.first = np.concatenate([[0], np.cumsum(blocks)])
        total = int(self.first[-1])
        flat = np.full(total * BLOCK, FILL, np.uint8)
        for at, data in zip(self.first * BLOCK, pieces):
            flat[at : at + len(data)] = np.frombuffer(data, np.uint8)
        self.lanes = np.ascontiguousarray(flat.reshape(total, BLOCK).T)
        state = np.tile(np.arange(STATES, dtype=np.uint8), (total, 1))
        seen = np.zeros((2, total, STATES), np.uint8)
        for step in self.lanes:
            at = (state.astype(np.uint16) << 8) | step[:, None]
            state, ended = AFTER[at], ENDS[at]
            seen[UNIT] += ended & 1
            seen[MARK] += ended >> 1
        self.seen = seen
        # Block by block, the composed function of all blocks of the piece up to it.
        place = np.arange(total) - np.repeat(self.first[:-1], blocks)
        upto, d = state, 1
        while total and d <= place.max():
            later = np.flatnonzero(place >= d)
            composed = upto.copy()
            composed[later] = np.take_along_axis(upto[later], upto[later - d], axis=1)
            upto, d = composed, 2 * d
        self.entry = np.tile(np.arange(STATES, dtype=np.uint8), (total, 1))
        self.entry[1:][place[1:] > 0] = upto[:-1][place[1:] > 0]
        self.upto, self.blocks = upto, blocks

    def functions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each piece and state that it may be entered in: the state it is left in, its units, its marks."""
        left = np.tile(np.arange(STATES, dtype=np.uint8), (len(self.sizes), 1))
        some = self.blocks > 0
        left[some] = self.upto[self.first[1:][some] - 1]
        sums = []
        for what in (UNIT, MARK):
            own = np.take_along_axis(self.seen[what], self.entry, axis=1).astype(np.int64)
            line = np.concatenate([np.zeros((1, STATES), np.int64), np.cumsum(own, axis=0)])
            sums.append(line[self.first[1:]] - line[self.first[:-1]])
        return left, *sums

    def offsets(self, state: np.ndarray, k: np.ndarray) -> np.ndarray:
        """For each piece, entered in ``state``: the byte after which ``k`` units have ended (0 for no unit)."""
        out = np.zeros(len(self.sizes), np.int64)
        asked = np.flatnonzero(k > 0)
        if not len(asked):
            return out
        entry = self.entry[np.arange(len(self.entry)), np.repeat(state, self.blocks)]
        line = np.concatenate([[0], np.cumsum(self.seen[UNIT][np.arange(len(entry)), entry], dtype=np.int64)])
        aim = line[self.first[asked]] + k[asked]
        block = np.searchsorted(line, aim, "left") - 1
        now, left, at = entry[block], aim - line[block], np.zeros(len(asked), np.int64)
        for j in range(BLOCK):
            index = (now.astype(np.uint16) << 8) | self.lanes[j, block]
            now = AFTER[index]
            left = left - (ENDS[index] & 1)
            at[(left == 0) & (at == 0)] = j + 1
        out[asked] = (block - self.first[asked]) * BLOCK + at
        return out


def decided(n: np.ndarray, marked: np.ndarray, h: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Form (0 plain, 1 psm, 2 spm) and both cuts in units, from the number of units, whether there are marks, and four hashes."""
    a, b = h[0] % (n + 1), h[1] % (n + 1)
    form = np.where((n == 0) | marked | (h[2] % 100 >= REWRITTEN), 0, np.where(h[3] % 100 < SUFFIX_FIRST, 2, 1))
    return form, np.minimum(a, b), np.maximum(a, b)


def put_together(form: int, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    if form == 0:
        return prefix + middle + suffix
    return b"".join([p, prefix, s, suffix, m, middle] if form == 1 else [s, suffix, p, prefix, m, middle])


def _hashes(doc_id: Column, seed: int) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


_H = ["h1", "h2", "h3", "h4"]
_OUT = "n long, form string, prefix_chars long, middle_chars long, output string"


def _numbers(batch: pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False) for c in names]


def _short(docs: DataFrame, kind: str) -> DataFrame:
    """Documents of one piece, done as they are read."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        scan = Scan(texts)
        _, units, marks = scan.functions()
        n, start = units[:, 0], np.zeros(len(texts), np.uint8)
        form, a, b = decided(n, marks[:, 0] > 0, _numbers(batch, _H))
        x, y = scan.offsets(start, np.where(form > 0, a, 0)), scan.offsets(start, np.where(form > 0, b, 0))
        made = pa.array([t if not f else put_together(f, t[:i], t[i:j], t[j:]) for t, f, i, j in zip(texts, form, x, y)], pa.binary())
        cuts = [pa.array(v, pa.int64(), mask=form == 0) for v in (a, b - a)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(FORMS[form].astype(object), pa.string()), *cuts, made.cast(pa.string())], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from tidied(one(part) for batch in batches for part in steps_of(batch, "text", 4 << 20, 4096))

    return docs.mapInArrow(run, f"doc_id {kind}, {_OUT}")


def _long(docs: DataFrame, kind: str, piece: int) -> DataFrame:
    """Documents of several pieces: taken apart, scanned, cut and put together again, each step over all tasks."""

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column("text")[i].as_buffer()
                for k in range(0, data.size, piece * 64):  # some pieces at a time
                    own = [data.slice(j, min(piece, data.size - j)).to_pybytes() for j in range(k, min(data.size, k + piece * 64), piece)]
                    same = [pa.array([batch.column(c)[i].as_py()] * len(own), batch.column(c).type) for c in ("_key", "doc_id", *_H)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(range(k // piece, k // piece + len(own)), pa.int32()), pa.array(own, pa.binary())], names=["_key", "doc_id", *_H, "part", "data"])

    row = f"_key long, doc_id {kind}, h1 long, h2 long, h3 long, h4 long, part int"
    pieces = docs.withColumn("_key", F.monotonically_increasing_id()).mapInArrow(apart, f"{row}, data binary")
    pieces = stash(pieces.repartition("_key", "part"), "pieces")

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps_of(whole, "data", 4 << 20, 4096):
                lists = [pa.array(x.astype(np.int64).tolist(), pa.list_(pa.int64())) for x in Scan(batch.column("data").to_pylist()).functions()]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("_key", "doc_id", *_H, "part")], *lists], names=["_key", "doc_id", *_H, "part", "after", "units", "marks"])

    def resolve(frame: pd.DataFrame) -> pd.DataFrame:
        """A row for each piece of one document: at 2 GB, the most a text can hold, some 32,768."""
        frame = frame.sort_values("part")
        state, units, marks, entry, before = 0, 0, 0, [], []
        for after, u, m in zip(frame["after"], frame["units"], frame["marks"]):
            entry.append(state), before.append(units)
            state, units, marks = int(after[state]), units + int(u[state]), marks + int(m[state])
        form, a, b = decided(np.array([units]), np.array([marks > 0]), [frame[c].to_numpy()[:1] for c in _H])
        return pd.DataFrame({"_key": frame["_key"], "part": frame["part"], "state": entry, "before": before, "n": units, "form": int(form[0]), "a": int(a[0]), "b": int(b[0])})

    plan = "_key long, part int, state int, before long, n long, form int, a long, b long"
    found = pieces.mapInArrow(functions, f"{row}, after array<long>, units array<long>, marks array<long>").groupBy("_key").applyInPandas(resolve, plan)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_key", "doc_id", "n", "form", "a", "b", "part"]
        for whole in batches:
            for batch in steps_of(whole, "data", 4 << 20, 4096):
                data = batch.column("data").to_pylist()
                scan = Scan(data)
                state, before, form, a, b = _numbers(batch, ["state", "before", "form", "a", "b"])
                units = scan.functions()[1][np.arange(len(data)), state]
                at = []
                for aim in (a, b):
                    # A cut behind this piece leaves all of it before the cut, one in an earlier piece none.
                    k = aim - before
                    at.append(np.where(k > units, scan.sizes, scan.offsets(state.astype(np.uint8), np.clip(k, 0, units))))
                rows = [[i, s, d[x:y]] for i, (d, u, v) in enumerate(zip(data, *at)) for s, (x, y) in enumerate(((0, u), (u, v), (v, len(d)))) if y > x]
                index = pa.array([r[0] for r in rows], pa.int32())
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(index) for c in names], pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=[*names, "segment", "data"])

    def together(frame: pd.DataFrame) -> pd.DataFrame:
        """One document, which is one value of the result."""
        frame = frame.sort_values(["segment", "part"])
        own = [b"".join(frame["data"][frame["segment"] == s]) for s in range(3)]
        form, n, a, b = (int(frame[c].iloc[0]) for c in ("form", "n", "a", "b"))
        cuts = (None, None) if form == 0 else (a, b - a)
        return frame[["doc_id"]].head(1).assign(n=n, form=FORMS[form], prefix_chars=pd.array(cuts[:1], "Int64"), middle_chars=pd.array(cuts[1:], "Int64"), output=put_together(form, *own).decode())

    parts = pieces.select("_key", "doc_id", "part", "data").join(found, ["_key", "part"])
    parts = parts.mapInArrow(cut, f"_key long, doc_id {kind}, n long, form int, a long, b long, part int, segment int, data binary")
    return parts.groupBy("_key").applyInPandas(together, f"doc_id {kind}, {_OUT}")


def transform(docs: DataFrame, seed: int = SEED, piece: int = PIECE) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` for each row of ``docs(doc_id, text)``: its units, its form (plain, psm or
    spm), the units of prefix and middle (null if plain), and the text as rewritten.

    A null text counts as empty, and an empty one is plain; a null id hashes as no digits. Repeated rows stay rows and are cut alike;
    long texts are cut whole, those beyond ``piece`` bytes by several tasks, with the same result; other columns, whatever their names,
    are ignored; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *_hashes(F.col("doc_id"), seed))
    fits = F.octet_length("text") <= piece
    return _short(own.where(fits), kind).unionByName(_long(own.where(~fits), kind, piece))


def restored(output: Column, form: Column) -> Column:
    """The text again: between its three marks the output holds no other, so they tell its parts."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    at = lambda i: F.get(part, F.lit(i))
    return F.when(form == "psm", F.concat(at(1), at(3), at(2))).when(form == "spm", F.concat(at(2), at(3), at(1))).otherwise(output)


def query(spark, sf_dir: str) -> DataFrame:
    out = transform(spread(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


#: The same in SQL.
SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h, length(coalesce(text, ''))::BIGINT AS n FROM documents),
u AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS x, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS y, ('0x' || substr(h, 17, 8))::BIGINT % 100 AS r, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS f FROM d),
c AS (SELECT *, least(x, y) AS a, greatest(x, y) AS b,
  CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r >= 90 THEN 'plain' WHEN f < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, substr(text, 1, a) AS pre, substr(text, a + 1, b - a) AS mid, substr(text, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""
