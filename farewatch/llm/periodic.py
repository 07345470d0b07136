"""Periodic runs of words, found by seeds and extension on diagonals.

A run is a stretch of consecutive words with smallest period q, at least ``MIN_LENGTH`` and two
periods long, that no neighbouring word extends. On the diagonal of lag q (word i against word i+q)
a run is a maximal stretch of at least max(MIN_LENGTH - q, q) matches, and the least such overlap
over all lags is ``SEED`` = MIN_LENGTH / 2 words. So the SEED-grams of a document are indexed, and
every run shows as an occurrence pair of one SEED-gram whose distance is its period.

Pairs are enumerated by classes of lags [L, 2L): a run of such a lag has at least L - SEED + 1
consecutive seeds, so seeds at every (L - SEED + 1)th word are enough, each paired with its
occurrences between L and 2L words later. That is about as many pairs as words and class, however
periodic the text is. A pair is dropped when neither half of the needed overlap matches (prefix
hashes; they only spare work, what remains is compared word by word), or when both of its seeds lie
in a known run whose period divides the lag (such a stretch has the smaller period). The rest is
extended both ways; a table of the furthest word covered per lag spares repeated extensions.

One pass over the rows, no shuffle; a task holds one batch of texts and one document's arrays.

Defined results: null, empty and white-space-only texts have no words and no runs; a null doc_id is
kept and never changed by ``make_periodic``; repeated rows are treated alike; whole texts are used,
however long; an empty table gives an empty table; columns other than doc_id and text are ignored.
Of the longest runs the one with the smallest start, then period, is reported.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import crc32_text, id_text, map_rows, read_table

MIN_LENGTH = 12                 # fixed value: words of a run, at least (and two periods)
SEED = MIN_LENGTH // 2          # least guaranteed overlap of a run with itself, one period later
SMALL_LAGS = 8                  # lags below this take every word as a seed
_BASE = np.uint64(0x9E3779B97F4A7C15)

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                    ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()),
                    ("collapsed_sha256", pa.string()), ("n_words", pa.int64()), ("n_dropped", pa.int64())])
DDL = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
       "collapsed_sha256 string, n_words long, n_dropped long")


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def make_periodic(words: list, doc_id: int | None) -> list:
    """The words with a tail repeated, for a tenth of all ids (fixed values of the query's contract)."""
    h, n = (0 if doc_id is None else crc32_text(doc_id)), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def overlap(lag):
    """Matches on its diagonal that a run of this period has at least."""
    return np.maximum(MIN_LENGTH - lag, lag)


class _Seeds:
    """Occurrences of the SEED-grams of one document, and prefix hashes of its words."""

    def __init__(self, ids: np.ndarray):
        self.n, self.count = len(ids), len(ids) - SEED + 1
        x = ids.astype(np.uint64) + np.uint64(1)
        gram = np.zeros(self.count, np.uint64)
        for k in range(SEED):
            gram = gram * _BASE + x[k:k + self.count]
        gram ^= gram >> np.uint64(31)
        self.gram, times = np.unique(gram, return_inverse=True, return_counts=True)[1:]
        self.repeated = times[self.gram] > 1
        self.any = bool(self.repeated.any())
        if self.any:
            self.place = np.sort(self.gram * (self.n + 1) + np.arange(self.count))     # (gram, word) as one number
            self.power = np.concatenate([[np.uint64(1)], np.full(self.n, _BASE)])
            np.multiply.accumulate(self.power, out=self.power)
            self.prefix = np.concatenate([[np.uint64(0)], np.cumsum(x * self.power[:-1], dtype=np.uint64)])

    def pairs(self, low: int, high: int, step: int) -> tuple[np.ndarray, np.ndarray]:
        """(word, lag) of the seeds at every ``step``th word and their occurrences low <= lag < high later."""
        at = np.arange(0, self.count, step)
        at = at[self.repeated[at]]
        key = self.gram[at] * (self.n + 1) + at
        # the gram's numbers end before its successor's begin
        end = (self.gram[at] + 1) * (self.n + 1)
        first = np.searchsorted(self.place, np.minimum(key + low, end))
        many = np.searchsorted(self.place, np.minimum(key + high, end)) - first
        word = np.repeat(at, many)
        slot = np.arange(len(word)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
        return word, self.place[slot] - self.gram[word] * (self.n + 1) - word

    def same(self, word: np.ndarray, lag: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether words [word, word + size) and those a lag later agree, by their hashes."""
        ok = (word >= 0) & (word + lag + size <= self.n)
        w, q, m = np.where(ok, word, 0), np.where(ok, lag, 0), np.where(ok, size, 0)
        here = (self.prefix[w + m] - self.prefix[w]) * self.power[q]
        return ok & (here == self.prefix[w + q + m] - self.prefix[w + q])


def _matches(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common prefix, compared in growing pieces."""
    at, size = 0, 64
    while at < len(a):
        differ = np.flatnonzero(a[at:at + size] != b[at:at + size])
        if len(differ):
            return at + int(differ[0])
        at, size = at + size, size * 4
    return len(a)


def _primitive(square: np.ndarray, lag: int) -> bool:
    """Whether no proper divisor of the lag is a period of two periods; lag / prime suffices."""
    rest, prime = lag, 2
    while rest > 1:
        prime = prime if prime * prime <= rest else rest
        if rest % prime:
            prime += 1
            continue
        if np.array_equal(square[lag // prime:], square[:-(lag // prime)]):
            return False
        while rest % prime == 0:
            rest //= prime
    return True


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a document's word numbers, by start, then period."""
    n = len(ids)
    if n < MIN_LENGTH:
        return []
    seeds = _Seeds(ids)
    if not seeds.any:
        return []
    found: list[tuple[int, int, int]] = []
    far_end, far_period = np.zeros(n, np.int64), np.ones(n, np.int64)     # per word, the known run that goes furthest
    low = 1
    while low <= n // 2:
        high = SMALL_LAGS if low == 1 else 2 * low
        word, lag = seeds.pairs(low, min(high, n // 2 + 1), 1 if low == 1 else low - SEED + 1)
        half = (overlap(lag) + 1) // 2
        good = seeds.same(word, lag, half) | seeds.same(word - half, lag, half)
        good &= (far_end[word] < word + lag + SEED) | (lag % far_period[word] != 0)
        word, lag = word[good], lag[good]
        order = np.lexsort((word, lag))
        covered: dict[int, int] = {}                       # per lag, the furthest word compared
        fresh = []
        for j, q in zip(word[order].tolist(), lag[order].tolist(), strict=True):
            floor = covered.get(q, 0)
            if j < floor:
                continue
            right = j + _matches(ids[j:n - q], ids[j + q:])
            left = j - _matches(ids[floor:j][::-1], ids[floor + q:j + q][::-1])
            covered[q] = right
            if right - left >= overlap(q) and _primitive(ids[left:left + 2 * q], q):
                fresh.append((left, right - left + q, q))
        for s, m, d in fresh:
            longer = far_end[s:s + m] < s + m
            far_end[s:s + m][longer] = s + m
            far_period[s:s + m][longer] = d
        found += fresh
        low = high
    return sorted(found, key=lambda r: (r[0], r[2]))


def number_words(words: list) -> np.ndarray:
    known: dict = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that stand in no run, or in the first period of every run they stand in."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for s, m, q in runs:
        drop[s + q] += 1
        drop[s + m] -= 1
    keep = np.cumsum(drop[:-1]) == 0
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k]


def _digest(words: list) -> tuple:
    runs = runs_of(number_words(words))
    kept = collapse(words, runs)
    s, m, q = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None, None, None)
    listing = "".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()
    return (len(runs), s, m, q, 1000 * m // q if runs else None, hashlib.sha256(listing).hexdigest(),
            hashlib.sha256(b" ".join(kept)).hexdigest(), len(words), len(words) - len(kept))


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, start, length, period), one row per run of each text."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "period")])

    def run(batches):
        def cols(ids, texts):
            rows = [(d, *r) for d, t in zip(ids.to_pylist(), texts, strict=True) for r in runs_of(number_words(words_of(t)))]
            return dict(zip(schema.names, zip(*rows, strict=True) if rows else [[]] * 4, strict=True))
        return map_rows(batches, schema, cols)
    return id_text(docs).mapInArrow(run, "doc_id long, start long, length long, period long")


def collapse_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): each text's words without the later periods of its runs, joined by spaces."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        def cols(ids, texts):
            words = [words_of(t) for t in texts]
            return {"doc_id": ids, "text": [b" ".join(collapse(w, runs_of(number_words(w)))).decode("utf-8", "replace") for w in words]}
        return map_rows(batches, schema, cols)
    return id_text(docs).mapInArrow(run, "doc_id long, text string")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the runs of every document, a tenth of them made periodic first."""
    def run(batches):
        def cols(ids, texts):
            rows = [_digest(make_periodic(words_of(t), d)) for d, t in zip(ids.to_pylist(), texts, strict=True)]
            return dict(zip(SCHEMA.names, [ids, *zip(*rows, strict=True)], strict=True))
        return map_rows(batches, SCHEMA, cols)
    return id_text(read_table(spark, sf_dir, "documents")).mapInArrow(run, DDL)
