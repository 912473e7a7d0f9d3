"""A table of words and their ids that a worker keeps: words that come again are looked up all at once, new ones are encoded once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def stretches(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``start, start + 1, ...`` of each stretch, one stretch after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class WordTable:
    """``encode`` gives the ids of distinct words, one word's after another's, and how many are each word's. Beyond ``most`` words the
    half used most stays; words of more than ``longest`` ids are not kept."""

    def __init__(self, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], most: int, longest: int = 64) -> None:
        self.encode, self.most, self.longest = encode, most, longest
        self.words, self.ids = pa.array([], pa.string()), np.zeros(0, np.int32)
        self.starts, self.sizes, self.uses = (np.zeros(0, np.int64) for _ in range(3))

    def find(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The place of each word (0 for new ones), and whether it is new."""
        at = pc.index_in(words, value_set=self.words)
        return at.fill_null(0).to_numpy().astype(np.int64), at.is_null().to_numpy(zero_copy_only=False)

    def keep_only(self, at: np.ndarray) -> None:
        self.ids = self.ids[stretches(self.starts[at], self.sizes[at])]
        self.words, self.sizes, self.uses = self.words.take(pa.array(at)), self.sizes[at], self.uses[at] >> 1
        self.starts = np.cumsum(self.sizes) - self.sizes

    def tidy(self) -> None:
        """Between two steps: forget what is too long, and what is too much."""
        if len(self.sizes) and self.sizes.max() > self.longest:
            self.keep_only(np.flatnonzero(self.sizes <= self.longest))
        if len(self.words) > self.most:
            self.keep_only(np.sort(np.argsort(-self.uses, kind="stable")[: self.most // 2]))

    def places(self, words: pa.Array) -> np.ndarray:
        """The place of each word in ``starts`` and ``sizes``, until ``tidy``."""
        at, new = self.find(words)
        if new.any():
            coded = words.filter(pa.array(new)).dictionary_encode()
            at[new] = len(self.words) + coded.indices.to_numpy().astype(np.int64)
            ids, sizes = self.encode(coded.dictionary)
            self.starts = np.append(self.starts, len(self.ids) + np.cumsum(sizes) - sizes)
            self.words, self.ids = pa.concat_arrays([self.words, coded.dictionary]), np.append(self.ids, ids)
            self.sizes, self.uses = np.append(self.sizes, sizes), np.append(self.uses, np.zeros(len(sizes), np.int64))
        self.uses += np.bincount(at, minlength=len(self.uses))
        return at
