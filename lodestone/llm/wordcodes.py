"""Codes of words: what encoders share that work word by word.

The words of a batch come as one Arrow array. They are looked up among those that the worker has met (Arrow's hash
join of arrays, no Python object a word), the rest become one each and are learnt together, and the codes of all words
in turn are gathered with numpy. What is remembered is bounded in bytes: beyond that the half goes that was not asked
for lately.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What an entry takes besides its characters and codes: three numbers and an offset.
_ENTRY = 28
#: Longer words are not remembered.
LONGEST = 200
#: Words that are worked off at once.
SLICE = 1 << 20


class WordCodes:
    """learn(words) gives the codes (int32) of all in turn and how many each has. most: bytes that are remembered, about."""

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 24 << 20) -> None:
        self.learn, self.most, self.turn = learn, most, 0
        self.words: pa.Array | None = None
        self.start, self.count, self.asked, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all words in turn, and the number of each word's codes. The words may not be null."""
        parts = [self._of(words.slice(i, SLICE)) for i in range(0, len(words), SLICE)]
        if len(parts) == 1:
            return parts[0]
        return (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])) if parts else (np.zeros(0, np.int32), np.zeros(0, np.int64))

    def _of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.words is None or self.words.type != words.type:
            self.words = words.slice(0, 0)
            self.start, self.count, self.asked, self.pool = self.start[:0], self.count[:0], self.asked[:0], self.pool[:0]
        if self.words.nbytes + _ENTRY * len(self.words) + self.pool.nbytes > self.most:
            self._forget()
        self.turn += 1
        found = pc.index_in(words, value_set=self.words)
        slot = found.fill_null(-1).to_numpy().astype(np.int64)
        if found.null_count:
            new = words.filter(found.is_null()).dictionary_encode()
            codes, counts = self.learn(new.dictionary.to_pylist())
            slot[slot < 0] = new.indices.to_numpy() + len(self.words)
            self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(counts) - counts])
            self.count, self.pool = np.concatenate([self.count, counts]), np.concatenate([self.pool, codes])
            self.asked = np.concatenate([self.asked, np.zeros(len(counts), np.int32)])
            self.words = pa.concat_arrays([self.words, new.dictionary])
        self.asked[slot] = self.turn
        return self._codes(slot)

    def _codes(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = self.count[slot]
        place = np.repeat(self.start[slot] - (np.cumsum(counts) - counts), counts)
        place += np.arange(len(place))
        return self.pool[place], counts

    def _forget(self) -> None:
        """Keeps the half that was asked for last, without long words."""
        keep = np.sort(np.argsort(-self.asked, kind="stable")[: len(self.asked) // 2])
        keep = keep[pc.binary_length(self.words.take(pa.array(keep))).to_numpy() <= LONGEST]
        self.pool, self.count = self._codes(keep)
        self.start = np.cumsum(self.count) - self.count
        self.asked, self.words = self.asked[keep], self.words.take(pa.array(keep))


def parts(texts: pa.Array, most: int = 8 << 20) -> Iterator[tuple[int, pa.Array]]:
    """Slices of an array of texts, each with the number of its first, of about `most` bytes (or one text) and at most 4,096 texts."""
    sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)) if len(texts) else np.zeros(0, np.int64)
    first = size = 0
    for i, n in enumerate(sizes.tolist()):
        if i > first and (size + n > most or i - first >= 4096):
            yield first, texts.slice(first, i - first)
            first, size = i, 0
        size += n
    if first < len(sizes):
        yield first, texts.slice(first)
