"""Statistics of a run of whole texts, by numpy over their bytes; each is computed when first asked for."""

from __future__ import annotations

from functools import cached_property

import numpy as np

from cartonscope.llm.common import BLANKS, Words, mix, sums

SYMBOLS = b"#*$%&|<>"
_COEF = mix(np.arange(201, 206, dtype=np.uint64)) | np.uint64(1)
_WORDS = Words(BLANKS, lower=False)

#: Kinds of bytes that are counted.
UPPER, LOWER, DIGIT, SYMBOL, BANG, STOP, OTHER, BLANK, BREAK, LEAD, TAIL = range(11)
_KIND = np.full(256, OTHER, np.int64)
_KIND[65:91], _KIND[97:123], _KIND[48:58] = UPPER, LOWER, DIGIT
_KIND[list(SYMBOLS)], _KIND[list(b"!")], _KIND[list(b".,;:?")] = SYMBOL, BANG, STOP
_KIND[list(BLANKS)], _KIND[10] = BLANK, BREAK
_KIND[0x80:0xC0], _KIND[0xC0:] = TAIL, LEAD
KINDS = 11


class Texts:
    """`data` holds the texts one after the other; text i is data[bounds[i]:bounds[i + 1]]."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds = data, bounds

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def only(self, keep: np.ndarray) -> Texts:
        sizes = np.diff(self.bounds)
        return Texts(self.data[np.repeat(keep, sizes)], np.concatenate([[0], np.cumsum(sizes[keep])]))

    @cached_property
    def kinds(self) -> np.ndarray:
        """Bytes of each kind, a row per text."""
        row = np.repeat(np.arange(len(self)), np.diff(self.bounds))
        return np.bincount(row * KINDS + _KIND[self.data], minlength=len(self) * KINDS).reshape(-1, KINDS)

    @cached_property
    def _hashed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _WORDS(self.data, self.bounds)

    @property
    def hashes(self) -> np.ndarray:
        return self._hashed[0]

    @property
    def n_words(self) -> np.ndarray:
        return self._hashed[2].astype(np.int64)

    @cached_property
    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.n_words)

    @cached_property
    def word_chars(self) -> np.ndarray:
        """Code points in words."""
        k = self.kinds
        return k.sum(1) - k[:, TAIL] - k[:, BLANK] - k[:, BREAK]

    @property
    def n_symbols(self) -> np.ndarray:
        return self.kinds[:, SYMBOL]

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines with a word, and how many of them equal an earlier line, for each text."""
        raw, total, again = self.data.tobytes(), [], []
        for a, b in zip(self.bounds, self.bounds[1:]):
            found = [x for x in raw[a:b].split(b"\n") if x.strip()]
            total.append(len(found))
            again.append(len(found) - len(set(found)))
        return np.array(total, np.int64), np.array(again, np.int64)

    def repeated(self, n: int) -> np.ndarray:
        """Words inside n-word windows that the text holds twice or more, for each text."""
        h, row = self.hashes, self.row_of_word
        size = len(h) - n + 1
        if size < 1:
            return np.zeros(len(self), np.int64)
        gram = row[:size].astype(np.uint64) * _COEF[0]
        for k in range(n):
            gram = mix(gram + h[k:k + size] * _COEF[k + 1])
        whole = row[:size] == row[n - 1:]
        _, at, count = np.unique(np.where(whole, gram, np.arange(size, dtype=np.uint64)), return_inverse=True, return_counts=True)
        often = whole & (count[at] > 1)
        covered = np.zeros(len(h), bool)
        for k in range(n):
            covered[k:k + size] |= often
        return sums(covered.astype(np.int64), self.n_words)

    @cached_property
    def vocabulary(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct words, and the count of the most frequent one, for each text."""
        distinct, most = np.zeros(len(self), np.int64), np.zeros(len(self), np.int64)
        if len(self.hashes):
            key, first, count = np.unique(mix(self.hashes + self.row_of_word.astype(np.uint64) * _COEF[1]), return_index=True, return_counts=True)
            row = self.row_of_word[first]
            np.add.at(distinct, row, 1)
            np.maximum.at(most, row, count)
        return distinct, most
