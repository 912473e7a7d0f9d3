"""Token ids as binary files: an adaptive context-mixing range coder in independently reset, checksummed blocks.

A block holds up to ``BLOCK`` ids, dealt to lanes of neighbouring ids, each with a range coder of its own; all lanes take a
step together and share one model, which starts anew with each block. For each id the model has three distributions: order 2,
the id that last followed the two ids before it (none if that is unsure); order 1, counts of all ids that followed the id before
it; order 0, counts of all ids. They are mixed with weights learnt as the block goes by, for each context of confidences: how often
order 2 was right in this place and how many times in a row, and how often the id before was met. An id takes its share from the
highest order that knows it, so the weight of each order is coded first, then the id in that order's distribution.

A file is a row of blocks, each followed by a line feed: ``TCM2``, lengths of header and payload, crc32 of both, header (part,
number of the first document in the part, whether that document goes on from the block before, ids, lanes, size of the
vocabulary; then each document's id, whether it is null, and its ids in this block), payload (words of each lane, then all
lanes' 32-bit words). Numbers are little-endian.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import keyed, shared_dir, stash, steps_of, table
from docloom.llm.wordtable import WordTable, stretches

BLOCK, LANES = 1 << 22, 12288
#: Code points aimed at in a file: the least, the most, and (between them) a share of all.
FILE_CHARS, MOST_FILE_CHARS, FILES = 1 << 24, 1 << 28, 1 << 12
MAGIC, HEAD, FIXED = b"TCM2", struct.Struct("<4sIII"), struct.Struct("<IQBIIIQ")
_U, _I, _L = np.uint64, np.int32, np.int64
#: Ids take this many bits in a pair; the distributions of order 0 and 1 are in units of 2**-20; ids must fit beside 12 bits in a slot.
_ID, _MOST_IDS = 20, (1 << 19) - 2
_IDS, _ONE = (1 << _ID) - 1, 1 << 20
_SLOT_BITS, _PLACE_BITS = 18, 19
#: What an id weighs in the counts of order 0, beside the 1 that each id has from the start.
_STEP = 16


def _order2_states() -> np.ndarray:
    """Next state of a slot, after its guess came true (first half) or not; a state is hits and misses, 4 bits each. 256 is
    added where the guess is replaced."""
    n = np.arange(256)
    hits, misses = n >> 4, n & 15
    right = np.minimum(hits + 1, 15) << 4 | np.where(misses > 1, misses >> 1, misses)
    wrong = np.where(hits <= 1, 1, hits >> 1) << 4 | np.minimum(misses + 1, 15) | (hits <= 1) << 8
    return np.concatenate([right, wrong]).astype(_I)


_NEXT = _order2_states()
_STATES = np.arange(256)
# Classes of confidence: of a slot (8), of the times in a row that order 2 was right (6), of how often an id was met (8).
_OF_SLOT = np.where(_STATES >> 4 == 0, 0, np.digitize(_STATES >> 4, [1, 2, 4]) * 2 + np.digitize(_STATES & 15, [1])).astype(_I)
_OF_RUN = (np.digitize(np.arange(32), [1, 2, 4, 8, 16]) * 8).astype(_I)
_MET = [1, 4, 16, 64, 256, 1024, 4096]
_CONTEXTS = 8 * 6 * 8


def _rebuilds() -> frozenset[int]:
    """Steps before which the tables of orders 0 and 1 are made anew: the first four, then each time the past has doubled."""
    out, at = {1, 2, 3}, 4.0
    while at < 1 << 32:
        out.add(int(at))
        at *= 2
    return frozenset(out)


_REBUILDS = _rebuilds()


class Model:
    """What encoder and decoder know alike; both call ``look`` before an id of each lane and ``learn`` after it.

    Orders 0 and 1 lie in one table of pairs (id before, id), sorted: order 0 is the context ``vocab + 1``, after which each id has
    come. A pair has the place where it begins in its context's distribution, and its width.
    """

    def __init__(self, vocab: int, lanes: int, decodes: bool) -> None:
        if vocab > _MOST_IDS:
            raise ValueError(f"{vocab} ids, of {_MOST_IDS} at most")
        self.vocab, self.decodes, self.steps = vocab, decodes, 0
        self.counts, self.pairs, self.seen = np.ones(vocab, _L), np.zeros(0, _L), np.zeros(0, _L)
        self.waiting: list[np.ndarray] = []
        self.slots = np.zeros(1 << _SLOT_BITS, _I)
        self.came = np.tile(np.array([4, 8, 4], _L), (_CONTEXTS, 1))
        self.last, self.before, self.run = np.full(lanes, vocab, _I), np.full(lanes, vocab, _I), np.zeros(lanes, _I)
        self.build()
        self.weigh()

    def count(self, new: np.ndarray) -> None:
        """Add pairs to the counts."""
        new.sort()
        self.counts += np.bincount(new & _IDS, minlength=self.vocab) * _STEP
        first = np.flatnonzero(np.concatenate([[True], new[1:] != new[:-1]]))
        times, new = np.diff(np.append(first, len(new))), new[first]
        at = np.searchsorted(self.pairs, new)
        old = self.pairs[np.minimum(at, len(self.pairs) - 1)] == new if len(self.pairs) else np.zeros(len(new), bool)
        self.seen[at[old]] += times[old]
        self.pairs, self.seen = np.insert(self.pairs, at[~old], new[~old]), np.insert(self.seen, at[~old], times[~old])

    def build(self) -> None:
        if self.waiting:
            self.count(np.concatenate(self.waiting))
            self.waiting = []
        of, n = self.pairs >> _ID, self.vocab + 1
        met, kinds = np.bincount(of, self.seen, n).astype(_L), np.bincount(of, minlength=n)
        begin = np.cumsum(kinds) - kinds
        upto = np.cumsum(self.seen)
        upto -= np.concatenate([[0], upto])[begin][of]
        rank, room = np.arange(len(of)) - begin[of], (_ONE - kinds)[of]
        low, high = (upto - self.seen) * room // met[of] + rank, upto * room // met[of] + rank + 1
        all_ = np.concatenate([[0], np.cumsum(self.counts)])
        all_ = all_ * (_ONE - self.vocab) // all_[-1] + np.arange(self.vocab + 1)
        self.alone = len(of)  # where order 0 begins
        self.keys = np.concatenate([self.pairs, (n << _ID) + np.arange(self.vocab)])
        low = np.concatenate([low, all_[:-1]])
        self.low, self.width = low.astype(_U), np.concatenate([high - low[: len(of)], np.diff(all_)]).astype(_U)
        self.of_last = (np.digitize(met, _MET) * 48).astype(_I)
        if self.decodes:
            # Each context has as many cells as it has kinds, or up to twice that; a cell has the last pair that begins at or before it.
            kinds = np.append(kinds, self.vocab)
            bits = np.ceil(np.log2(np.maximum(kinds, 1))).astype(_L)
            self.shift = 20 - bits
            self.cell = np.cumsum(1 << bits) - (1 << bits)
            at = self.keys >> _ID
            cells = self.cell[at] + ((low + (1 << self.shift[at]) - 1) >> self.shift[at])
            self.pair_at = np.cumsum(np.bincount(cells, minlength=int((1 << bits).sum()) + 1)) - 1
            self.edges = np.append((at << 20) | low, np.iinfo(_L).max)
        else:
            # Where a pair may be, by a hash; where two have one place, a frequent one has it.
            self.place, at = np.zeros(1 << _PLACE_BITS, _I), self.hashed(self.pairs)
            self.place[at] = np.arange(len(of))
            often = np.flatnonzero(self.seen > 2)
            self.place[at[often]] = often

    @staticmethod
    def hashed(pairs: np.ndarray) -> np.ndarray:
        return (pairs * _L(0x1E3779B97F4A7C15)) >> _L(63 - _PLACE_BITS) & _L((1 << _PLACE_BITS) - 1)

    def weigh(self) -> None:
        """Of 4096ths, in each context of confidences: where orders 2, 1 and 0 begin and end."""
        own = self.came * (4096 - 24) // self.came.sum(axis=1, keepdims=True) + 8
        edges = np.concatenate([np.zeros((_CONTEXTS, 1), _L), np.cumsum(own[:, :2], axis=1), np.full((_CONTEXTS, 1), 4096)], axis=1).astype(_U)
        self.bounds, self.one, self.none = edges.ravel(), edges[:, 1].copy(), edges[:, 2].copy()

    def look(self, n: int) -> None:
        self.now = self.last[:n].copy()
        h = (self.before[:n] * _I(0x1E3779B1) + self.now * _I(0x25EBCA77)).view(np.uint32)
        self.slot, self.check = h >> np.uint32(32 - _SLOT_BITS), (h >> np.uint32(6)).view(_I) & _I(15)
        held = self.slots.take(self.slot)
        self.state = (held & _I(255)) * ((held >> _I(8) & _I(15)) == self.check)
        self.guess = held >> _I(12)
        self.context = _OF_SLOT.take(self.state) + _OF_RUN.take(self.run[:n]) + self.of_last.take(self.now)

    def find(self, ids: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order that codes each id (0: order 2, 1: order 1, 2: order 0), and its pair there."""
        pairs = self.now.astype(_L) << _L(_ID) | ids
        at = self.place.take(self.hashed(pairs)).astype(_L)
        known = self.keys.take(at) == pairs
        lost = np.flatnonzero(~(known | right))
        if len(lost):
            at[lost] = np.searchsorted(self.keys, pairs[lost])
            known[lost] = self.keys.take(at[lost]) == pairs[lost]
            gone = lost[~known[lost]]
            at[gone] = self.alone + ids[gone]
        return np.where(right, _I(0), np.where(known, _I(1), _I(2))), at

    def pair_of(self, order: np.ndarray, last: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The pair whose stretch holds ``place`` in the distribution of order 1 or 0."""
        of = np.where(order == 1, last, _I(self.vocab + 1)).astype(_L)
        at = self.pair_at.take(self.cell.take(of) + (place >> self.shift.take(of)))
        wanted = (of << _L(20)) | place
        on = np.flatnonzero(self.edges.take(at + 1) <= wanted)
        for _ in range(6):
            if not len(on):
                return at
            at[on] += 1
            on = on[self.edges.take(at[on] + 1) <= wanted[on]]
        at[on] = np.searchsorted(self.edges, wanted[on], "right") - 1
        return at

    def learn(self, ids: np.ndarray, order: np.ndarray) -> None:
        n, right = len(ids), order == 0
        self.came += np.bincount(self.context * _I(3) + order, minlength=3 * _CONTEXTS).reshape(_CONTEXTS, 3)
        after = _NEXT.take(self.state + _I(256) * ~right)
        self.slots[self.slot] = np.where(after & _I(256), ids, self.guess) << _I(12) | self.check << _I(8) | (after & _I(255))
        self.run[:n] = np.minimum(self.run[:n] + _I(1), _I(31)) * right
        self.waiting.append(self.now.astype(_L) << _L(_ID) | ids)
        self.before[:n], self.last[:n] = self.now, ids
        self.steps += 1
        if self.steps < 64 or self.steps % 8 == 0:
            self.weigh()
        if self.steps in _REBUILDS:
            self.build()


def _lanes(n: int, lanes: int) -> tuple[int, int, int, np.ndarray]:
    """Lanes, steps, lanes that take the last step, and ids of each lane: lane i has the next ``sizes[i]`` ids of the block."""
    lanes = max(1, min(lanes, n // 256))  # steps enough to learn from
    steps = -(-n // lanes)
    full = n - lanes * (steps - 1)
    sizes = np.full(lanes, steps)
    sizes[full:] -= 1
    return lanes, steps, full, sizes


#: A lane's range is 2**32 at least; below, 32 bits go out. An id narrows a range by less than that.
_LEAST, _OUT, _FINE, _WORD = _U(1 << 32), _U(32), _U(20), _U(0xFFFFFFFF)


def encode_block(ids: np.ndarray, vocab: int, lanes: int = LANES) -> bytes:
    """The payload of a block: words of each lane (uint32), then the words (uint32)."""
    lanes, steps, full, sizes = _lanes(len(ids), lanes)
    # A row for each step; lanes that don't take the last step have any id there.
    places = np.minimum((np.cumsum(sizes) - sizes)[:, None] + np.arange(steps), len(ids) - 1) if full < lanes else None
    rows = np.ascontiguousarray((ids[places] if full < lanes else ids.reshape(lanes, steps)).T.astype(_I))
    model = Model(vocab, lanes, False)
    low, wide = np.zeros(lanes, _U), np.full(lanes, (1 << 64) - 1, _U)
    cap = steps + 4
    words = np.zeros(lanes * cap, _U)
    at = np.arange(lanes) * cap + 1  # the word before a lane's first takes no carry
    first = at.copy()
    for k in range(steps):
        n = lanes if k < steps - 1 else full
        now = rows[k, :n]
        model.look(n)
        right = (now == model.guess) & (model.state > 0)
        order, pair = model.find(now, right)
        bound = model.context * _I(4) + order
        begin = model.bounds.take(bound)
        unit = wide[:n] >> _U(12)
        wi, off = unit * (model.bounds.take(bound + _I(1)) - begin), unit * begin
        part = wi >> _FINE
        off += np.where(right, _U(0), part * model.low.take(pair))
        wi = np.where(right, wi, part * model.width.take(pair))
        lo = low[:n]
        lo += off
        over = np.flatnonzero(lo < off)
        if len(over):
            words[at[over] - 1] += _U(1)
        out = np.flatnonzero(wi < _LEAST)
        a = at[out]
        words[a] = lo[out] >> _OUT
        at[out] = a + 1
        lo[out] <<= _OUT
        wi[out] <<= _OUT
        wide[:n] = wi
        model.learn(now, order)
    # One word more names a number within each lane's last range; the words after it count as zero.
    last = low + (_LEAST - _U(1))
    words[at[last < low] - 1] += _U(1)
    words[at] = last >> _OUT
    count = at + 1 - first
    used = np.arange(int(count.max()))
    mine = used[None, :] < count[:, None]
    flat = np.where(mine, words.reshape(lanes, cap)[:, 1 : 1 + len(used)], _U(0)).reshape(-1)
    over = np.flatnonzero(flat > _WORD)
    while len(over):
        flat[over] &= _WORD
        flat[over - 1] += _U(1)
        over = (over - 1)[flat[over - 1] > _WORD]
    return count.astype("<u4").tobytes() + flat.reshape(lanes, -1)[mine].astype("<u4").tobytes()


def decode_block(payload: bytes, n_ids: int, vocab: int, lanes: int = LANES) -> np.ndarray:
    lanes, steps, full, sizes = _lanes(n_ids, lanes)
    count = np.frombuffer(payload, "<u4", lanes).astype(_L)
    cap = int(count.max()) + 4
    held = np.zeros((lanes, cap), np.uint32)
    held[np.arange(cap)[None, :] < count[:, None]] = np.frombuffer(payload, "<u4", offset=4 * lanes)
    gap, wide = held[:, 0].astype(_U) << _OUT | held[:, 1], np.full(lanes, (1 << 64) - 1, _U)
    words, at = held.reshape(-1), np.arange(lanes) * cap + 2
    model, out = Model(vocab, lanes, True), np.zeros((steps, lanes), _I)
    for k in range(steps):
        n = lanes if k < steps - 1 else full
        model.look(n)
        unit, ga = wide[:n] >> _U(12), gap[:n]
        v = ga // unit
        order = (v >= model.one.take(model.context)).view(np.int8) + (v >= model.none.take(model.context)).view(np.int8)
        bound = model.context * _I(4) + order
        begin = model.bounds.take(bound)
        wi = unit * (model.bounds.take(bound + _I(1)) - begin)
        ga -= unit * begin
        now = model.guess.copy()
        rest = np.flatnonzero(order)
        part, g = wi[rest] >> _FINE, ga[rest]
        pair = model.pair_of(order[rest], model.now[rest], np.minimum(g // part, _U(_ONE - 1)).astype(_L))
        now[rest] = model.keys.take(pair) & _L(_IDS)
        ga[rest] = g - part * model.low.take(pair)
        wi[rest] = part * model.width.take(pair)
        more = np.flatnonzero(wi < _LEAST)
        a = at[more]
        ga[more] = ga[more] << _OUT | words[a]
        at[more] = a + 1
        wi[more] <<= _OUT
        wide[:n] = wi
        out[k, :n] = now
        model.learn(now, order)
    whole = np.ascontiguousarray(out.T)
    return whole.reshape(-1) if full == lanes else whole[np.arange(steps)[None, :] < sizes[:, None]]


def pack(part: int, first: int, goes_on: bool, docs: list[tuple[int | None, int]], ids: np.ndarray, vocab: int) -> bytes:
    header = FIXED.pack(part, first, goes_on, len(ids), LANES, vocab, len(docs))
    header += np.array([d or 0 for d, _ in docs], "<i8").tobytes() + np.array([d is None for d, _ in docs], "u1").tobytes() + np.array([n for _, n in docs], "<u4").tobytes()
    payload = encode_block(ids, vocab) if len(ids) else b""
    return HEAD.pack(MAGIC, len(header), len(payload), zlib.crc32(payload, zlib.crc32(header))) + header + payload


def unpack(raw: bytes) -> Iterator[tuple[int, int, bool, list[tuple[int | None, int]], np.ndarray]]:
    """The blocks of a file: part, number of the first document, whether it goes on, (doc_id, ids here) of each, ids."""
    at = 0
    while at < len(raw):
        magic, h, p, crc = HEAD.unpack_from(raw, at)
        header, payload = raw[at + HEAD.size : at + HEAD.size + h], raw[at + HEAD.size + h : at + HEAD.size + h + p]
        if magic != MAGIC or zlib.crc32(payload, zlib.crc32(header)) != crc:
            raise ValueError("damaged block")
        part, first, goes_on, n, lanes, vocab, docs = FIXED.unpack_from(header)
        rest = FIXED.size
        doc_ids = np.frombuffer(header, "<i8", docs, rest).tolist()
        none = np.frombuffer(header, "u1", docs, rest + 8 * docs).tolist()
        sizes = np.frombuffer(header, "<u4", docs, rest + 9 * docs).tolist()
        ids = decode_block(payload, n, vocab, lanes) if n else np.zeros(0, np.int64)
        yield part, first, bool(goes_on), [(None if z else d, s) for d, z, s in zip(doc_ids, none, sizes)], ids
        at += HEAD.size + h + p + 1


class BlockWriter:
    """Gathers documents' ids into blocks; a document is cut only if it is longer than a block."""

    def __init__(self, part: int, vocab: int) -> None:
        self.part, self.vocab, self.seen = part, vocab, 0
        self.start()

    def start(self, goes_on: bool = False) -> None:
        self.docs, self.held, self.size, self.first, self.goes_on = [], [], 0, self.seen, goes_on

    def flush(self, goes_on: bool = False) -> Iterator[bytes]:
        if self.docs:
            yield pack(self.part, self.first, self.goes_on, self.docs, np.concatenate(self.held), self.vocab)
        self.start(goes_on)

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[bytes]:
        if self.size + len(ids) > BLOCK:
            yield from self.flush()
        while len(ids) > BLOCK:
            self.docs, self.held = [(doc_id, BLOCK)], [ids[:BLOCK]]
            yield from self.flush(goes_on=True)
            ids = ids[BLOCK:]
        self.docs.append((doc_id, len(ids)))
        self.held.append(ids)
        self.size += len(ids)
        self.seen += 1


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Words that a worker remembers (beyond, the half used most stays), and the ids (of a word; characters, at the start of a text) of the longest.
REMEMBERED, LONGEST = 500_000, 64
#: Bytes and rows of text that a step takes.
STEP_BYTES, STEP_ROWS = 1 << 23, 8192
# White space of the tokenizer's first step (control characters beside it are taken for such, which only means that a
# text is encoded whole), and marks that it cuts off from the letter or digit before them.
_BLANKS = "".join(rf"\x{{{x}}}" for x in ("09", "0a", "0b", "0c", "0d", "1c", "1d", "1e", "1f", "85", "a0", "1680")) + r"\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000} "
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"



def stem(word: str) -> int:
    """How many characters of a word come before the marks at its end, or before its only line break and the marks before that; the
    last of them is a letter or digit. All of them, if that can't be said."""
    if word.isalnum():
        return len(word)
    at = word.find("\n")
    if at == 0 or at > 0 and (at == len(word) - 1 or word[at + 1].isspace() or word.find("\n", at + 1) > 0):
        return len(word)
    first = len(word[:at].rstrip(_MARKS) if at > 0 else word.rstrip(_MARKS))
    return first if first and word[first - 1].isalnum() else len(word)


class Tokens:
    """Ids of texts by the tokenizers library. Its own first step cuts a text before each blank that stands between two characters
    that are none, and merging never crosses a cut; so each word, with the blank before it, is encoded once and then remembered. It
    cuts as well before marks that follow a letter or digit, and round a line break between two characters that are no blanks: a word's
    beginning and the rest after it are remembered apart. Texts with other white space beside a blank are encoded whole, as are texts that hold the
    string of an added token (one id, whatever its characters), and all texts if the file's first step is another."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        added = [re.sub(r"([^\w])", r"\\\1", t["content"], flags=re.ASCII) for t in parts.get("added_tokens") or []]
        self.odd = "|".join([f"[{_BLANKS}] | [{_BLANKS}]", *added])
        first = parts.get("pre_tokenizer") or {}
        self.cuts = first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space") and not parts.get("normalizer")
        self.begins = np.zeros(self.model.get_vocab_size(), bool)
        for piece, i in self.model.get_vocab().items():
            if piece.startswith("Ġ") and i < len(self.begins):
                self.begins[i] = True
        #: Words after a blank; words at the start of a text have none before them, and a memory of their own.
        self.table = WordTable(self.learn, REMEMBERED, LONGEST)
        self.heads: dict[str, np.ndarray] = {}

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, _I) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def after_blanks(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, each with a blank before it, one after another, and how many are each word's."""
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([*range(0, len(words), 512), len(words)], pa.int32()), words), " ").to_pylist()
        ids = np.fromiter(chain.from_iterable(e.ids for e in self.model.encode_batch_fast([f" {x}" for x in joined], add_special_tokens=False)), _I)
        begin = np.flatnonzero(self.begins[ids])  # a word's first piece, and no other, starts with the blank
        return ids, np.diff(np.append(begin, len(ids)))

    def learn(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new words: those of the word's stem, then those of the rest."""
        table = self.table
        # A word of letters and digits alone is its own stem, as most are.
        plain = pc.utf8_is_alnum(new).to_numpy(zero_copy_only=False)
        marked = new.filter(pa.array(~plain))
        bare = pc.ascii_rtrim(marked, _MARKS)
        fit = pc.and_(pc.utf8_is_alnum(pc.utf8_slice_codeunits(bare, -1)), pc.invert(pc.match_substring(marked, "\n"))).to_numpy(zero_copy_only=False)
        cut = pc.utf8_length(bare).to_numpy(zero_copy_only=False).tolist()
        marked = marked.to_pylist()
        for i in np.flatnonzero(~fit).tolist():
            cut[i] = stem(marked[i])
        places = np.arange(len(new))
        places[~plain] = len(new) + np.arange(len(marked))
        stems = pa.concat_arrays([new, pa.array([w[:n] for w, n in zip(marked, cut)], pa.string())]).take(pa.array(places))
        rests = pa.concat_arrays([pa.array([""], pa.string()), pa.array([w[n:] for w, n in zip(marked, cut)], pa.string())]).take(pa.array(np.where(plain, 0, places - len(new) + 1))).dictionary_encode()
        own = stems.unique()
        # Few words are looked for in many: the many pass by a table of the few.
        back = pc.index_in(table.words, value_set=own)
        seen = np.flatnonzero(back.is_valid().to_numpy(zero_copy_only=False))
        known, gone = np.zeros(len(own), _L), np.ones(len(own), bool)
        at = back.drop_null().to_numpy()
        known[at], gone[at] = seen, False
        ids, sizes = self.after_blanks(own.filter(pa.array(gone)))
        ids = np.append(table.ids, ids)
        starts, all_sizes = np.empty(len(own), _L), np.empty(len(own), _L)
        all_sizes[gone], starts[gone] = sizes, len(table.ids) + np.cumsum(sizes) - sizes
        all_sizes[~gone], starts[~gone] = table.sizes[known[~gone]], table.starts[known[~gone]]
        at = pc.index_in(stems, value_set=own).to_numpy()
        starts, sizes = starts[at], all_sizes[at]
        made = self.rest(rests.dictionary.to_pylist())
        at, more = rests.indices.to_numpy(), np.fromiter(map(len, made), _L, len(made))
        after, more = (np.cumsum(more) - more)[at], more[at]
        ends = np.cumsum(sizes + more)
        out = np.empty(int(ends[-1]), _I)
        out[stretches(ends - more - sizes, sizes)] = ids[stretches(starts, sizes)]
        out[stretches(ends - more, more)] = np.concatenate(made)[stretches(after, more)]
        return out, sizes + more

    def rest(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of what follows a stem."""
        cut: dict[str, list[str]] = {}
        for t in texts:
            marks, line, after = t.partition("\n")
            n = len(after.rstrip(_MARKS))
            n = n if n and after[n - 1].isalnum() else len(after)
            cut[t] = [x for x in (marks, line, after[:n], after[n:]) if x]
        parts = list(set(chain.from_iterable(cut.values())))
        ids = dict(zip(parts, self.head(parts)))
        none = np.zeros(0, _I)
        return [np.concatenate([none, *(ids[x] for x in cut[t])]) for t in texts]

    def head(self, words: list[str]) -> list[np.ndarray]:
        """Ids of words without a blank before them."""
        if len(self.heads) > REMEMBERED // 8:
            self.heads = {}
        new = list(set(words).difference(self.heads))
        self.heads.update(zip(new, self.whole(new)))
        out = [self.heads[w] for w in words]
        for w in new:
            if len(w) > LONGEST:
                del self.heads[w]
        return out

    def by_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many are each text's; none of the texts is odd."""
        parts = pc.split_pattern(texts, " ")
        many = np.diff(parts.offsets.to_numpy()).astype(_L)
        ends = np.cumsum(many)
        words = parts.flatten()
        first = np.zeros(len(words), bool)
        first[ends - many] = True
        heads = self.head(words.filter(pa.array(first)).to_pylist())
        words = words.filter(pa.array(~first))
        table = self.table
        table.tidy()
        at = table.places(words)
        # In the order of the texts: a head's ids, then those of its words. Heads lie behind the words' ids.
        head_sizes = np.fromiter(map(len, heads), _L, len(heads))
        sizes, starts = np.empty(len(first), _L), np.empty(len(first), _L)
        sizes[first], starts[first] = head_sizes, len(table.ids) + np.cumsum(head_sizes) - head_sizes
        sizes[~first], starts[~first] = table.sizes[at], table.starts[at]
        ids = np.concatenate([table.ids, *heads])[stretches(starts, sizes)]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        return ids, upto[ends] - upto[ends - many]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text (no nulls)."""
        odd = np.ones(len(texts), bool)
        if self.cuts:
            odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        out: list = [None] * len(texts)
        whole = np.flatnonzero(odd).tolist()
        for i, ids in zip(whole, self.whole([texts[i].as_py() for i in whole])):
            out[i] = ids
        if len(whole) < len(texts):
            ids, sizes = self.by_words(texts.filter(pa.array(~odd)))
            for i, e, n in zip(np.flatnonzero(~odd).tolist(), np.cumsum(sizes).tolist(), sizes.tolist()):
                out[i] = ids[e - n : e]
        return out


_TOKENS: dict[tuple, Tokens] = {}


def tokens_of(path: str) -> Tokens:
    """The tokenizer of a file, and what it remembers; a worker keeps the last one."""
    of = os.stat(path)
    key = (path, of.st_size, of.st_mtime_ns)
    if key not in _TOKENS:
        _TOKENS.clear()
        _TOKENS[key] = Tokens(path)
    return _TOKENS[key]


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Write ids of ``docs(doc_id, text)``, ascending doc_id (null first; rows of one id by a hash of their text), one file a range.

    Null and empty texts have the end id alone; an empty table gives no blocks; other columns are ignored; long texts are encoded whole. A file holds ``FILE_CHARS`` code points or, in a table of more than ``FILES`` such
    files, a like share of all, up to ``MOST_FILE_CHARS``; a writer holds a block, whatever the size of its file.
    """
    # The row key parts rows alike in id and text, which may change places; ids with many texts are ordered by what these hold.
    own = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))).withColumn("_text", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), "_text", "_row"]
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(1, chars // min(MOST_FILE_CHARS, max(FILE_CHARS, chars // FILES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(tokenizer)
        writer = BlockWriter(TaskContext.get().partitionId(), max(tokens.model.get_vocab_size(), end_id + 1))
        wrap = lambda blocks: (pa.RecordBatch.from_arrays([pa.array([b], pa.binary())], names=["block"]) for b in blocks)
        for batch in batches:
            for part in steps_of(batch, "text", STEP_BYTES, STEP_ROWS):
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), tokens.encode(part.column("text"))):
                    yield from wrap(writer.add(doc_id, np.append(ids, _I(end_id))))
        yield from wrap(writer.flush())

    dealt = own.repartitionByRange(files, *order).sortWithinPartitions(*order)
    dealt.select("doc_id", "text").mapInArrow(run, "block binary").select(F.col("block").cast("string")).write.option("lineSep", "\n").text(path)


def read_documents(spark, path: str) -> DataFrame:
    """``part, seq, doc_id, n_tokens, ids_crc32`` of each document in the files, from their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows: list[list] = []
                for part, first, goes_on, docs, ids in unpack(content.as_py()):
                    raw = memoryview(ids.astype("<u4").tobytes())
                    at = 0
                    for i, (doc_id, n) in enumerate(docs):
                        if i == 0 and goes_on:
                            rows[-1][3] += n
                            rows[-1][4] = zlib.crc32(raw[: 4 * n], rows[-1][4])
                        else:
                            rows.append([part, first + i, doc_id, n, zlib.crc32(raw[at : at + 4 * n])])
                        at += 4 * n
                columns = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], names=["part", "seq", "doc_id", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, "part int, seq long, doc_id long, n_tokens long, ids_crc32 long")


def query(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Files are written to the shared folder and read back; ``start`` adds up what the files before hold."""
    path = f"{shared_dir(spark)}/docloom-ids-{uuid.uuid4().hex}"
    write_ids(table(spark, sf_dir, "documents"), path, tokenizer or default_tokenizer())
    rows = stash(read_documents(spark, path), "ids")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("own", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(files, "part")
    return out.select("doc_id", (F.col("base") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")
