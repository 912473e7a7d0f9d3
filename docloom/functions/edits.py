"""Edit distance in time that grows with the distance: bit-parallel over a band that is doubled until the distance lies in it.

A column of the table of distances is held as differences between neighbouring cells, one bit each (up by one, down by one), in whole
numbers as wide as the band; a column takes a dozen operations on them. The band follows the diagonal: all cells within ``t`` of it. A way
of at most ``t`` edits never leaves it, so a distance of at most ``t`` is exact; else ``t`` is doubled. A band is left as soon as no cell
of a column is within ``t``; how far the column got tells, for texts that have little in common, that the whole table costs least.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Hashable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.shared import by_value

by_value(__name__)
FIRST_BAND = 32
#: Cells of a table up to which the JVM's own function, which fills all of it, is used for characters.
SMALL = 1 << 16


def within(a: Sequence[Hashable], b: Sequence[Hashable], t: int) -> int | None:
    """The distance of ``a`` and ``b`` (no longer than ``a``, nor shorter by more than ``t``), if it is at most ``t``."""
    return _within(a, b, t)[0]


def _within(a: Sequence[Hashable], b: Sequence[Hashable], t: int) -> tuple[int | None, float]:
    """That, and, where the distance is more than ``t``, about how many edits a column takes.

    Bit k of column j stands for row j - t + k. Rows above the first stand for values that fall by one to it, as the first row itself
    rises by one a column; what lies beside the band is taken as one more than its neighbour.
    """
    m, n = len(a), len(b)
    wide, middle = 2 * t + 1, 1 << t
    full, last = (1 << wide) - 1, 1 << (2 * t)
    seen: dict[Hashable, list[int]] = {}
    for i, x in enumerate(a[:t]):
        own = seen.setdefault(x, [0, 0])
        own[0] |= 1 << (t + 1 + i)
    up, down, edits = full ^ ((middle << 1) - 1), (middle << 1) - 1, 0
    look = t
    for j, y in enumerate(b, 1):
        if j + t <= m:  # a row enters the band
            own = seen.get(a[j + t - 1])
            if own is None:
                seen[a[j + t - 1]] = [last, j]
            else:
                own[0], own[1] = (own[0] >> (j - own[1])) | last, j
        own = seen.get(y)
        if own is None:
            match = 0
        else:
            own[0], own[1] = own[0] >> (j - own[1]), j
            match = own[0]
        up, down = (up >> 1) | last, down >> 1
        same = ((((match & up) + up) ^ up) | match | down) & full
        right = down | (full ^ (same | up))
        left = same & up
        if not same & middle:
            edits += 1
        right = ((right << 1) | 1) & full
        up = ((left << 1) | (full ^ (same | right))) & full
        down = right & same
        if j >= look:
            look = j + max(t // 4, FIRST_BAND)
            least = _least(up, down, edits, t)
            if least > t:
                return None, least / j
    rest = ((1 << (m - n)) - 1) << (t + 1)
    edits += (up & rest).bit_count() - (down & rest).bit_count()
    return (edits, 0.0) if edits <= t else (None, edits / n)


def _least(up: int, down: int, edits: int, t: int) -> int:
    """The least of a band's column whose middle is ``edits``: what goes on from there takes no less."""
    size = (2 * t + 8) // 8
    steps = _steps(up, size, t) - _steps(down, size, t)
    rows = np.cumsum(steps)
    return edits + int(rows.min()) - int(rows[t])


def _steps(bits: int, size: int, t: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits.to_bytes(size, "little"), "u1"), bitorder="little")[: 2 * t + 1].astype("i4")


def whole(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """The distance by all rows of each column: for sequences that have little in common it costs a quarter of what bands would."""
    m, shared = len(a), set(b)
    places: dict[Hashable, bytearray] = {}
    for i, x in enumerate(a):
        own = places.get(x)
        if own is None:
            if x not in shared:
                continue
            own = places[x] = bytearray((m + 7) // 8)
        own[i >> 3] |= 1 << (i & 7)
    match_of = {x: int.from_bytes(own, "little") for x, own in places.items()}
    full = (1 << m) - 1
    up, down = full, 0
    for y in b:
        match = match_of.get(y)
        if match is None:  # the same for no bit of a match, in half the operations
            right = ((full ^ up) << 1) | 1
            up, down = full ^ ((down | right) & full), right & down
            continue
        same = ((((match & up) + up) ^ up) | match | down) & full
        right = ((down | (full ^ (same | up))) << 1) | 1
        up = (((same & up) << 1) | (full ^ ((same | right) & full))) & full
        down = right & same
    return len(b) + up.bit_count() - down.bit_count()


def distance(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """Levenshtein distance of two sequences (strings, lists of words)."""
    if len(a) < len(b):
        a, b = b, a
    head = _alike(a, b)
    a, b = a[head:], b[head:]
    tail = _alike(a[::-1], b[::-1])
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    t = max(FIRST_BAND, len(a) - len(b))
    if b and 2 * t + 1 < len(a):
        # What of a has no partner in b takes an edit each: narrower bands are left out.
        had = Counter(b)
        t = max(t, sum(n - min(n, had[x]) for x, n in Counter(a).items()))
    while b and 2 * t + 1 < len(a):
        found, rate = _within(a, b, t)
        if found is not None:
            return found
        # Bands go on while they are narrow: what has been moved looks like what is new. Then the rate counts.
        t = 2 * t if 16 * t < len(a) else max(2 * t, int(rate * len(b)))
    return whole(a, b)


def _alike(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """Length of the common beginning, found by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        half = (low + high + 1) // 2
        low, high = (half, high) if a[low:half] == b[low:half] else (low, half - 1)
    return low


@F.pandas_udf(T.IntegerType())
def _text_edits(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else distance(x, y) for x, y in zip(a, b)], dtype="Int32")


@F.pandas_udf(T.IntegerType())
def _list_edits(a: pd.Series, b: pd.Series) -> pd.Series:
    words = lambda x: [] if x is None else x.tolist() if isinstance(x, np.ndarray) else list(x)
    return pd.Series([distance(words(x), words(y)) for x, y in zip(a, b)], dtype="int32")


@F.pandas_udf(T.IntegerType())
def _token_edits(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([distance(x.split(), y.split()) for x, y in zip(a, b)], dtype="int32")


def text_edits(a: Column, b: Column) -> Column:
    """Distance in characters of whole texts; null where one is null."""
    small = F.char_length(a) * F.char_length(b).cast("long") <= SMALL
    return F.when(small, F.levenshtein(a, b)).otherwise(_text_edits(F.when(~small, a), F.when(~small, b)))


def list_edits(a: Column, b: Column) -> Column:
    """Distance of arrays of strings; a null array counts as empty."""
    return _list_edits(a, b)


def token_edits(a: Column, b: Column) -> Column:
    """Distance in words of two lines of tokens, none null: a text each crosses to Python, not an array of words."""
    return _token_edits(a, b)
