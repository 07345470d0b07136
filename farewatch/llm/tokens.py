"""Token-wise scoring of whole texts: every distinct white-space token is computed once per
worker (vectorised over many tokens), documents then gather the rows of their tokens."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_CHARS = 3_000_000     # text made into words at a time

_HELD: dict = {}


def held(kind: str, key, make: Callable):
    """What a worker process keeps from task to task (a memo, an automaton): one thing at a time,
    so the stages of a job, which share their workers, do not add up their memory. ``make()`` must
    keep whatever object ``key`` is the id of alive."""
    if (kind, key) not in _HELD:
        _HELD.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)          # glibc keeps freed arrays otherwise
        if trim:
            trim(0)
        _HELD[kind, key] = make()
    return _HELD[kind, key]


def words_of(text: str | None) -> list[str]:
    """Words between ASCII white space, as ``split_words`` cuts them."""
    return [w.decode("utf-8", "replace") for w in (text or "").encode("utf-8", "replace").split()]


def slices(texts: pa.Array, chars: int = SLICE_CHARS) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of about ``chars`` characters; whole texts only."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    cut = (np.flatnonzero(np.diff(np.cumsum(size, dtype=np.int64) // chars)) + 1).tolist()
    for a, e in zip([0, *cut], [*cut, len(texts)], strict=True):
        if e > a:
            yield a, texts.slice(a, e - a)


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Words per text, and all words as a dictionary array (empty words stand at the edges of
    texts that begin or end with white space)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    return lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().dictionary_encode()


class TokenMemo:
    """Rows of numbers per distinct word: ``compute(words)`` gives a (words x width) array. Holds
    at most about ``limit`` words and starts anew when full, so memory is bounded; ``at_once`` bounds
    the words that ``compute`` gets in one call."""

    def __init__(self, compute: Callable[[list[str]], np.ndarray], limit: int = 350_000, at_once: int | None = None):
        self.compute, self.limit, self.at_once = compute, limit, at_once
        self.known: dict[str, int] = {}
        self.rows: np.ndarray | None = None

    def places(self, distinct: list[str]) -> np.ndarray:
        """Row number of each of the distinct words."""
        if len(self.known) + len(distinct) > self.limit and self.known:
            self.known, self.rows = {}, None
        at = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(at < 0)
        if len(new):
            todo = [distinct[k] for k in new.tolist()]
            step = self.at_once or len(todo)
            rows = np.concatenate([self.compute(todo[k:k + step]) for k in range(0, len(todo), step)])
            start = len(self.known)
            at[new] = start + np.arange(len(new))
            self.known.update(zip(todo, range(start, start + len(todo)), strict=True))
            if self.rows is None or start + len(todo) > len(self.rows):
                grown = np.zeros((2 * (start + len(todo)), rows.shape[1]), rows.dtype)
                if self.rows is not None:
                    grown[:start] = self.rows[:start]
                self.rows = grown
            self.rows[start:start + len(todo)] = rows
        return at

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row number of every word of all texts, words per text), without empty words."""
        per_text, coded = split_words(texts)
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if not distinct:
            return np.zeros(0, np.int64), per_text
        index = coded.indices.to_numpy(zero_copy_only=False)
        if "" in distinct:
            real = index != distinct.index("")
            per_text = np.diff(np.concatenate([[0], np.cumsum(real)])[np.concatenate([[0], np.cumsum(per_text)])])
            index = index[real]
        return self.places(distinct)[index], per_text


def sum_rows(memo: TokenMemo, texts: pa.Array) -> np.ndarray:
    """Sum of the word rows per text (texts x width)."""
    out = []
    for _, part in slices(texts):
        word, n = memo.words(part)
        end = np.concatenate([[0], np.cumsum(n)])
        if not len(word):
            out.append(None)
            out[-1] = len(part)
            continue
        # per column, so no (words x width) array is made
        cum = np.stack([np.concatenate([[0.0], np.cumsum(memo.rows[word, j])])[end] for j in range(memo.rows.shape[1])], axis=1)
        out.append(np.diff(cum, axis=0))
    width = next((x.shape[1] for x in out if not isinstance(x, int)), None)
    if width is None:
        width = memo.compute(["x"]).shape[1]
    return np.concatenate([np.zeros((x, width)) if isinstance(x, int) else x for x in out]) if out else np.zeros((0, width))


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of " w1 w2 ... wn " and the word number of every position (a space belongs to
    the word after it; the last one to word n). Words hold no spaces."""
    cp = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return cp, np.cumsum(cp == 32) - 1


_MULT = np.uint64(0x9E3779B97F4A7C15)


def mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def char_ngrams(words: list[str], sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, 64-bit hash) of every character n-gram of " word " for all words."""
    cp, owner = code_points(words)
    space = np.concatenate([[0], np.cumsum(cp == 32)])
    c = cp.astype(np.uint64)
    at, hs = [], []
    for n in sizes:
        m = len(cp) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for j in range(n):
            h = h * _MULT + c[j:j + m]
        inner = space[n - 1:n - 1 + m] - space[1:1 + m]      # spaces strictly inside
        ok = np.flatnonzero(inner == 0)
        at.append(owner[ok])
        hs.append(mix64(h[ok]))
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(at), np.concatenate(hs)


def word_hashes(words: list[str], salt: int = 0) -> np.ndarray:
    """64-bit hash per word (polynomial over its code points)."""
    cp, owner = code_points(words)
    cp, owner = cp[:-1], owner[:-1]                         # without the last space: every word is " word"
    start = np.searchsorted(owner, np.arange(len(words)))
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(np.max(np.diff(np.append(start, len(cp))))), _MULT)]))
    pos = np.arange(len(cp)) - start[owner]
    terms = (cp.astype(np.uint64) + np.uint64(salt + 1)) * power[pos]
    return mix64(np.add.reduceat(terms, start))
