"""Distinct pieces of texts, remembered by a Python worker from task to task, so that each is encoded once."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A worker forgets what it knows beyond so many distinct pieces; they are then found anew.
REMEMBERED = 1 << 21
#: Texts handed to a tokenizer at once; it returns an object of some kilobytes for each.
AT_ONCE = 1 << 13


def load_tokenizer(path: str, plain_specials: bool = False):
    """A tokenizer of the tokenizers library, one thread to a task. plain_specials: strings of special tokens are plain text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = plain_specials
    return tokenizer


class Remembered:
    """Places of distinct strings in a growing list; `learn` is called with those not met before."""

    def __init__(self, learn: Callable[[list[str]], None], forget: Callable[[], None], most: int = REMEMBERED):
        self.learn, self.forget, self.most = learn, forget, most
        self.known = pa.array([], pa.large_string())

    def __call__(self, distinct: pa.Array) -> np.ndarray:
        distinct = distinct.cast(pa.large_string())
        if len(self.known) + len(distinct) > self.most:
            self.known = self.known[:0]
            self.forget()
        place = pc.index_in(distinct, value_set=self.known)
        new = place.is_null().to_numpy(zero_copy_only=False)
        missing = distinct.filter(pa.array(new))
        place = place.fill_null(0).to_numpy().astype(np.int64)
        place[new] = len(self.known) + np.arange(len(missing))
        if len(missing):
            self.known = pa.concat_arrays([self.known, missing])
            self.learn(missing.to_pylist())
        return place


def runs(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... counts[0] of them, then the same from first[1], and so on."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - counts), counts)


def flat(texts: list[str], encode: Callable[[list[str]], list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and how many each has."""
    ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for at in range(0, len(texts), AT_ONCE):
        found = encode(texts[at:at + AT_ONCE])
        counts.append(np.fromiter(map(len, found), np.int64, len(found)))
        ids.append(np.fromiter(chain.from_iterable(found), np.uint32, int(counts[-1].sum())))
    return np.concatenate(ids), np.concatenate(counts)


class TextEncoder:
    """Ids of texts, each followed by an end id.

    by_word: texts are cut at ASCII white space and every distinct word is encoded once. That gives the ids of the whole text
    only for tokenizers that drop white space and never look across it; others encode each text whole.
    """

    def __init__(self, path: str, end_id: int, by_word: bool, most: int = REMEMBERED):
        self.tokenizer, self.end_id, self.by_word = load_tokenizer(path), end_id, by_word
        self._forget()
        self.words = Remembered(self._learn, self._forget, most)

    def _forget(self) -> None:
        self.ids, self.bounds = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return flat(texts, lambda some: [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)])

    def _learn(self, words: list[str]) -> None:
        ids, counts = self._encode(words)
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(counts)])
        self.ids = np.concatenate([self.ids, ids])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each text has; its end id is the last."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if self.by_word:
            split = pc.ascii_split_whitespace(texts)
            coded = split.flatten().dictionary_encode()
            word = self.words(coded.dictionary)[coded.indices.to_numpy()]
            counts = np.diff(self.bounds)[word]
            body = self.ids[runs(self.bounds[word], counts)]
            ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum(pc.list_value_length(split).to_numpy())]
            sizes = np.diff(ends, prepend=0)
        else:
            body, sizes = self._encode(texts.to_pylist())
        out = np.full(len(body) + len(sizes), self.end_id, np.uint32)
        is_body = np.ones(len(out), bool)
        is_body[np.cumsum(sizes + 1) - 1] = False
        out[is_body] = body
        return out, sizes + 1


@lru_cache(maxsize=1)
def text_encoder(path: str, end_id: int, by_word: bool) -> TextEncoder:
    """The worker's encoder; it keeps what it has learned until the worker ends or reads another vocabulary."""
    return TextEncoder(path, end_id, by_word)
