"""SentencePiece encoding and decoding by streaming Viterbi.

Each boundary of the text keeps one state: the best way to reach it, its last piece and a back pointer. For a unigram model the
best way has the largest sum of scores. For a BPE model a sequence of pieces is what merging gives exactly when each two
neighbours stand next to each other in their own merging, so a step to a boundary counts only where its piece agrees with the
piece before; that leaves one way to each boundary, and the ids are those of the library. Only the last ``max_piece``
boundaries can be stepped from; once the back pointers of these meet at one boundary, the ids before it are committed and
forgotten. All ways also meet at boundaries that no piece crosses (before a space, round a line break): a window never reaches over
them, and what lies between two of them is walked once and kept in a bounded table, since most words come again and again.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import fresh, spread, steps_of, table, tidied
from docloom.llm.wordtable import WordTable, stretches

SPACE = "▁"
#: Words remembered by a worker, and piece pairs; beyond, the words used least go, and the pairs' memory starts anew.
REMEMBERED, PAIRS = 500_000, 300_000
#: What keeps a text from being encoded by words: spaces that stand together, or beside a line break, or at an end; the space's own sign.
ODD = f"  | \n|^\n|^ | $|{SPACE}|^$"
#: Characters between two looks for the boundary where the back pointers meet.
LOOK = 64


def _fields(raw: bytes) -> Iterator[tuple[int, int | float | bytes]]:
    """The (number, value) fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(raw):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            value = raw[at : at + size]
            at += size
            yield key >> 3, struct.unpack("<f", value)[0] if key & 7 == 5 else value


@dataclass
class Pieces:
    """A model's pieces. ``kinds``: 1 normal, 2 unknown, 3 control, 4 user defined, 6 byte (fixed by the file format)."""

    texts: list[str]
    scores: list[float]
    kinds: list[int]
    bpe: bool
    dummy_prefix: bool
    #: For BPE: the two pieces whose merge makes a piece; absent for single characters and for pieces no merging makes.
    parts: dict[int, tuple[int, int]] = field(default_factory=dict)
    usable: frozenset[int] = frozenset()

    def __post_init__(self) -> None:
        self.ids = {t: i for i, (t, k) in enumerate(zip(self.texts, self.kinds)) if k in (1, 4)}
        self.byte_ids = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.texts, self.kinds)) if k == 6}
        self.unknown = self.kinds.index(2)
        self.max_piece = max((len(t) for t in self.ids), default=1)
        if self.bpe and not self.usable:
            made = {i: merged(t, self) for t, i in self.ids.items() if len(t) > 1 and t.strip(SPACE)}
            self.parts = {i: last for i, (ids, last) in made.items() if ids == [i]}
            self.usable = frozenset(self.parts) | {i for t, i in self.ids.items() if len(t) == 1}


    def digest(self) -> bytes:
        """What tells models apart: all pieces, scores and kinds."""
        h = hashlib.sha256(repr((self.bpe, self.dummy_prefix)).encode())
        for own in (self.texts, self.scores, self.kinds):
            h.update(repr(own).encode("utf-8", "surrogatepass"))
        return h.digest()


def merged(text: str, pieces: Pieces) -> tuple[list[int], tuple[int, int] | None]:
    """BPE by merging, of a short text of known characters: its ids, and the last two pieces merged. Highest score first, then leftmost."""
    symbols = list(text)
    last = None
    while True:
        best = None
        for i in range(len(symbols) - 1):
            k = pieces.ids.get(symbols[i] + symbols[i + 1])
            if k is not None and (best is None or pieces.scores[k] > best[0]):
                best = (pieces.scores[k], i)
        if best is None:
            return [pieces.ids.get(s, pieces.unknown) for s in symbols], last
        i = best[1]
        last = (pieces.ids.get(symbols[i], -1), pieces.ids.get(symbols[i + 1], -1))
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]


def load(path: str) -> Pieces:
    """Pieces of a ``.model`` file. Only the identity normaliser, without removal of extra spaces, is supported."""
    texts, scores, kinds, model, prefix = [], [], [], 1, True
    with open(path, "rb") as f:
        for number, value in _fields(f.read()):
            if number == 1:
                one = dict(_fields(value))
                texts.append(one[1].decode())
                scores.append(one.get(2, 0.0))
                kinds.append(one.get(3, 1))
            elif number == 2:
                model = dict(_fields(value)).get(3, 1)
            elif number == 3:
                how = dict(_fields(value))
                prefix = bool(how.get(3, 1))
                if how.get(2) or how.get(4, 1):
                    raise ValueError("only the identity normaliser is supported")
    if model not in (1, 2):
        raise ValueError(f"model type {model} is not supported")
    return Pieces(texts, scores, kinds, model == 2, prefix)


class Encoder:
    """Encodes texts; keeps stretches and pair verdicts it has met, within bounds."""

    def __init__(self, pieces: Pieces) -> None:
        self.p = pieces
        self.table = WordTable(self.walk_words, REMEMBERED)
        self.known: dict[str, list[int]] = {}
        self.parts: pa.Array | None = None
        self.pairs: dict[int, bool] = {}
        self.runs: dict[int, list[int]] = {}
        self.size = len(pieces.texts)
        # A piece with a space or line break inside a word, or a space at the end of a word, would cross the stretches.
        free = all(SPACE not in t.lstrip(SPACE) for t in pieces.ids) and not any("\n" in t and len(t) > 1 for t in pieces.ids)
        self.stretch = re.compile(f"{SPACE}?[^{SPACE}\n]+|{SPACE}+(?={SPACE}[^{SPACE}\n])|{SPACE}+|\n") if free else None
        self.space = pieces.ids.get(SPACE, -1)
        self.chosen = {t: i for t, i in pieces.ids.items() if not pieces.bpe or i in pieces.usable}
        # Lengths of the pieces of three characters or more, longest first, by their last three characters.
        tails: dict[str, set[int]] = {}
        for t in self.chosen:
            if len(t) > 2:
                tails.setdefault(t[-3:], set()).add(len(t))
        self.tails = {k: sorted(v, reverse=True) for k, v in tails.items()}

    def agree(self, a: int, b: int) -> bool:
        """Whether merging the text of pieces ``a`` and ``b`` leaves the boundary between them.

        Merges come in the order of their scores. Going back in that order, the piece made last comes apart; were the two
        pieces at the boundary ever to make a piece that comes before that, the boundary would be merged away.
        """
        key = a * self.size + b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._agree(a, b)
        return known

    def _agree(self, a: int, b: int) -> bool:
        texts, scores, parts, ids = self.p.texts, self.p.scores, self.p.parts, self.p.ids
        until, left_first = float("-inf"), False  # a joint piece with a better score than this is made first
        while True:
            joint = ids.get(texts[a] + texts[b])
            if joint is not None and (scores[joint] > until or scores[joint] == until and left_first):
                return False
            apart_a, apart_b = parts.get(a), parts.get(b)
            if apart_a is None and apart_b is None:
                return True
            if apart_b is None or apart_a is not None and scores[a] < scores[b]:
                until, left_first, a = scores[a], False, apart_a[1]  # the merge inside a lies further left
            else:
                until, left_first, b = scores[b], True, apart_b[0]

    def reach(self, text: str, done: int, upto: int, base: int, piece: list[int], start: list[int], score: list[float]) -> None:
        """Find the boundaries after ``done`` characters, up to ``upto``: of each the piece before it, where that starts, sum of scores.
        Boundary k is at place k - base; it follows from the text before it alone."""
        ids, bpe, scores = self.chosen, self.p.bpe, self.p.scores
        tails, pairs, size = self.tails, self.pairs, self.size
        for end in range(done + 1, upto + 1):
            best_piece, best_start, best_score = None, 0, 0.0
            for length in (*tails.get(text[end - 3 : end], ()), 2, 1) if end > 2 else range(end, 0, -1):
                begin = end - length
                if begin < 0:
                    continue
                i = ids.get(text[begin:end])
                if i is None:
                    continue
                before = piece[begin - base]
                if bpe:
                    verdict = before < 0 or pairs.get(before * size + i)
                    if verdict or verdict is None and self.agree(before, i):
                        best_piece, best_start = i, begin
                        break
                else:
                    s = score[begin - base] + scores[i]
                    if best_piece is None or s > best_score:
                        best_piece, best_start, best_score = i, begin, s
            if best_piece is None:
                best_piece, best_start, best_score = -1 - ord(text[end - 1]), end - 1, score[end - 1 - base] - 1e4
            piece.append(best_piece), start.append(best_start), score.append(best_score)

    def back(self, meet: int, base: int, piece: list[int], start: list[int]) -> list[int]:
        """Ids from boundary ``base`` to boundary ``meet``."""
        chosen, at = [], meet
        while at > base:
            chosen.append(piece[at - base])
            at = start[at - base]
        out: list[int] = []
        for i in reversed(chosen):
            if i >= 0:
                out.append(i)
            else:
                out += self.fallback(chr(-1 - i))
        return out

    def walk(self, text: str) -> list[int]:
        """Ids of a stretch of any length; characters without a piece come out as their bytes (or as unknown)."""
        top, n = self.p.max_piece, len(text)
        out: list[int] = []
        piece, start, score, base, end = [-1], [0], [0.0], 0, 0
        while end < n:
            upto = min(n, end + LOOK)
            self.reach(text, end, upto, base, piece, start, score)
            end = upto
            # Follow the boundaries that can still be stepped from back to where they meet.
            live = {end} if end == n else set(range(max(base, end - top + 1), end + 1))
            while len(live) > 1:
                far = max(live)
                live.discard(far)
                live.add(start[far - base])
            meet = live.pop()
            out += self.back(meet, base, piece, start)
            cut = meet - base
            del piece[:cut], start[:cut], score[:cut]
            base = meet
        return out

    def walk_all(self, texts: list[str]) -> list[list[int]]:
        """Ids of stretches. In sorted order one that is no longer than a window shares the boundaries of its beginning with the one before."""
        out: list[list[int]] = [[]] * len(texts)
        before, piece, start, score = "", [-1], [0], [0.0]
        for k in sorted(range(len(texts)), key=texts.__getitem__):
            text = texts[k]
            if len(text) > LOOK:
                out[k] = self.walk(text)
                continue
            same = 0
            for x, y in zip(before, text):
                if x != y:
                    break
                same += 1
            del piece[same + 1 :], start[same + 1 :], score[same + 1 :]
            self.reach(text, same, len(text), 0, piece, start, score)
            out[k], before = self.back(len(text), 0, piece, start), text
        return out

    def fallback(self, char: str) -> list[int]:
        got = [self.p.byte_ids.get(b) for b in char.encode("utf-8", "surrogatepass")]
        return [self.p.unknown] if None in got else got

    def run(self, n: int) -> list[int]:
        """Ids of ``n`` spaces in a BPE model: they merge last, the leftmost of equal scores first."""
        if n not in self.runs:
            ids, scores = self.p.ids, self.p.scores
            size, after, before = [1] * n, [*range(1, n), -1], list(range(-1, n - 1))
            queue: list[tuple[float, int, int]] = []

            def offer(i: int) -> None:
                if i >= 0 and after[i] >= 0:
                    k = ids.get(SPACE * (size[i] + size[after[i]])) if size[i] + size[after[i]] <= self.p.max_piece else None
                    if k is not None:
                        heapq.heappush(queue, (-scores[k], i, size[i] + size[after[i]]))

            for i in range(n):
                offer(i)
            while queue:
                _, i, made = heapq.heappop(queue)
                if not size[i] or after[i] < 0 or size[i] + size[after[i]] != made:
                    continue
                j = after[i]
                size[i], size[j], after[i] = made, 0, after[j]
                if after[i] >= 0:
                    before[after[i]] = i
                offer(before[i]), offer(i)
            got = [ids[SPACE * s] for s in size if s]
            if n > 64:
                return got
            self.runs[n] = got
        return self.runs[n]

    def walk_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, each after a blank; a line break in a word is a stretch of its own."""
        own = words.to_pylist()
        parts = [[SPACE + first, *[x for line in lines for x in ("\n", line) if x]] for first, *lines in (w.split("\n") for w in own)]
        ids = iter(self.walk_all([*chain.from_iterable(parts)]))
        made = [next(ids) if len(p) == 1 else [*chain.from_iterable(next(ids) for _ in p)] for p in parts]
        return np.fromiter(chain.from_iterable(made), np.int32), np.fromiter(map(len, made), np.int64, len(made))

    def by_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many are each text's; the texts are plain (see ``ODD``)."""
        parts = pc.split_pattern(texts, " ")
        many = np.diff(parts.offsets.to_numpy()).astype(np.int64)
        self.table.tidy()
        at = self.table.places(parts.flatten())
        sizes = self.table.sizes[at]
        upto, ends = np.concatenate([[0], np.cumsum(sizes)]), np.cumsum(many)
        return self.table.ids[stretches(self.table.starts[at], sizes)], upto[ends] - upto[ends - many]

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all whole texts, one after another, and how many are each text's; none for null and empty."""
        texts = texts.fill_null("")
        odd = np.ones(len(texts), bool)
        if self.stretch is not None and self.p.dummy_prefix:
            odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self.by_words(texts)
        ids, sizes = self.by_words(texts.filter(pa.array(~odd)))
        slow = [self.slow(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        n = np.zeros(len(texts), np.int64)
        n[~odd], n[odd] = sizes, [len(x) for x in slow]
        own, starts = np.concatenate([ids, *slow]), np.zeros(len(texts), np.int64)
        starts[~odd], starts[odd] = np.cumsum(sizes) - sizes, len(ids) + np.cumsum(n[odd]) - n[odd]
        return own[stretches(starts, n)].astype(np.int32), n

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each whole text."""
        ids, sizes = self.encode_all(pa.array(texts, pa.string()))
        return np.split(ids, np.cumsum(sizes)[:-1]) if len(texts) else []

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_many([text])[0]

    def slow(self, text: str) -> np.ndarray:
        """A text with spaces that stand together: in a BPE model a run of them takes in the space that the next stretch leaves alone
        at its start."""
        text = ((SPACE if self.p.dummy_prefix else "") + text.replace(" ", SPACE)) if text else ""
        if self.stretch is None:
            return np.array(self.walk(text), np.int32)
        out: list[int] = []
        waiting = 0
        for s in self.stretch.findall(text):
            if self.p.bpe and not s.strip(SPACE):
                waiting += len(s)
                continue
            ids = self.known.get(s)
            if ids is None:
                ids = self.walk(s)
                if len(s) <= LOOK:
                    if len(self.known) >= PAIRS // 8:
                        self.known.clear()
                    self.known[s] = ids
            if waiting:
                alone = len(ids) > 0 and ids[0] == self.space
                out += self.run(waiting + alone)
                ids, waiting = ids[alone:], 0
            out += ids
        if waiting:
            out += self.run(waiting)
        return np.array(out, np.int32)

    def raw(self) -> list[bytes]:
        """What each id stands for: bytes of byte pieces, nothing for control pieces."""
        back = {i: bytes([b]) for b, i in self.p.byte_ids.items()}
        return [back.get(i) or (b"" if k == 3 else b" \xe2\x81\x87 " if k == 2 else t.replace(SPACE, " ").encode()) for i, (t, k) in enumerate(zip(self.p.texts, self.p.kinds))]

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids: bytes are joined, the space that encoding put in front is taken off."""
        if self.parts is None:
            self.parts = pa.array([*(raw := self.raw()), *[r[1:] if r[:1] == b" " else r for r in raw]], pa.binary())
        raw = b"".join(self.parts.take(pa.array(ids)).to_pylist())
        if self.p.dummy_prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")

    def decode_all(self, ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
        """The texts of the ids, so many for each. Second versions of the pieces lack the space in front; a text's first piece is one."""
        if self.parts is None:
            self.decode(ids[:0])
        ids, ends = ids.astype(np.int64), np.cumsum(sizes)
        starts = (ends - sizes)[sizes > 0]
        if self.p.dummy_prefix:
            ids[starts] += self.size
        joined = self.parts.take(pa.array(ids))
        if len(ids) and joined.offset == 0:
            at = np.frombuffer(joined.buffers()[1], np.int32)[np.concatenate([[0], ends])]
            out = pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(at), joined.buffers()[2]])
            try:
                out.validate(full=True)
                return out
            except pa.ArrowInvalid:  # bytes that are no text
                pass
        return pa.array([self.decode(x) for x in np.split(ids % self.size, ends[:-1])], pa.string())


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


_ENCODERS: dict[bytes, Encoder] = {}
#: Bytes of text that a step takes.
STEP_BYTES = 1 << 22


def encode(docs: DataFrame, pieces: Pieces, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` and ``decoded`` (the text that the ids decode to; null for null) instead of ``text``; both with underscores
    in front if ``docs`` has such columns."""
    rest = [f for f in docs.schema.fields if f.name != text]
    schema = T.StructType([*rest, T.StructField(fresh(docs, "ids"), T.ArrayType(T.IntegerType())), T.StructField(fresh(docs, "decoded"), T.StringType())])
    token = pieces.digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if token not in _ENCODERS:
            _ENCODERS.clear()  # a worker keeps the last model's
            _ENCODERS[token] = Encoder(pieces)
        encoder = _ENCODERS[token]
        for whole in batches:
            for batch in steps_of(whole, text, STEP_BYTES, 8192):
                texts = batch.column(text)
                ids, sizes = encoder.encode_all(texts)
                decoded = pc.if_else(texts.is_null(), pa.scalar(None, pa.string()), encoder.decode_all(ids, sizes))
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in rest], flat, decoded], names=[f.name for f in schema])

    return docs.mapInArrow(lambda it: tidied(run(it)), schema)


def encoded(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """``doc_id, n_ids, ids, exact`` of each row of ``docs(doc_id, text)``; ``exact``: the ids decode to the text (null for null)."""
    out = encode(docs.select("doc_id", "text", F.xxhash64("text").alias("_h"), F.octet_length("text").alias("_n")), pieces)
    exact = F.when(F.col("decoded").isNotNull(), (F.xxhash64("decoded") == F.col("_h")) & (F.octet_length("decoded") == F.col("_n")))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", exact.alias("exact"))


def query(spark, sf_dir: str, model: str | None = None) -> DataFrame:
    """Null and empty texts have no ids; repeated rows stay rows; long texts are encoded whole, a window at a time; columns but id and text
    are ignored; an empty table gives no rows."""
    return encoded(spread(table(spark, sf_dir, "documents")), load(model or default_model()))
