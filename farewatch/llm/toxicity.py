"""Toxicity severity by cumulative-link ordinal regression.

Features are sparse: hashed words and character n-grams (with word edges, so roots that start a
word are features too). The features kept are those whose presence separates toxic from clean
labelled texts significantly; each counts at several levels (occurrences, and share of the words). One weight vector is shared by all
thresholds: P(grade > k) = sigmoid(w . x - t_k), t_0 <= t_1 <= ...; the severity is the expected
grade, sum over k of P(grade > k).

The labels are yes or no, so grades are read off them first: clean texts are grade 0; toxic ones
grade 1, 2 or 3 by tercile of the share of their words that carry the most frequent of their
features seen in toxic training texts only. ``toxic`` says P(grade > 0) >= 0.5.

The labelled rows for the fit are bounded (``max_rows``, smallest hash of the id, clean and toxic
drawn separately), and so are the features kept (``max_features``). Scoring covers every whole text.

Defined results: null and empty texts have no features: severity near 0, not toxic; without toxic
labels nothing is toxic and every severity is 0; repeated rows are scored alike; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, materialise, read_table
from .tokens import TokenMemo, char_ngrams, held, slices, word_hashes, words_of

SIZES = (4, 5, 6)
MAX_ROWS = 8000             # bound of the labelled sample; at most half of it toxic
MAX_FEATURES = 1500
MIN_LIFT = 1.0              # a feature is more frequent in toxic texts ... (by this factor)
MIN_G2 = 20.0               # ... and its log-likelihood ratio statistic this large
LEVELS = (1, 2, 4)          # occurrences of a feature in a text ...
SHARES = (0.004, 0.01, 0.02)  # ... and per word; each level reached is a 0/1 input
N_LEVELS = len(LEVELS) + len(SHARES)
MIN_DOCS = 3                # a feature must occur in so many toxic texts of the sample
GRADES = 3
LETTERS = re.compile(r"[^\W\d_]+")


def token_hashes(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(token number, feature hash as signed 64-bit) of the letter runs of tokens."""
    runs, owner = [], []
    for k, t in enumerate(tokens):
        found = LETTERS.findall(t.lower())
        runs += found
        owner += [k] * len(found)
    if not runs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.array(owner, np.int64)
    at, grams = char_ngrams(runs, SIZES)
    return (np.concatenate([owner, owner[at]]),
            np.concatenate([word_hashes(runs, salt=3), grams]).view(np.int64))


def text_hashes(text: str | None) -> np.ndarray:
    tokens = sorted(set(words_of(text)))
    return np.unique(token_hashes(tokens)[1]) if tokens else np.zeros(0, np.int64)


class Ordinal:
    """Feature hashes (sorted) with weights, and the ordered thresholds."""

    def __init__(self, keys, weights, thresholds, only_toxic):
        self.keys, self.weights, self.thresholds, self.only_toxic = keys, weights, thresholds, only_toxic

    def above(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k) per text and threshold."""
        p = 1.0 / (1.0 + np.exp(-np.clip(z[:, None] - self.thresholds[None, :], -500, 500)))
        p[:, np.isinf(self.thresholds)] = 0.0
        return p


def inputs(feature: np.ndarray, count: np.ndarray, n_words: int) -> np.ndarray:
    """The 0/1 inputs switched on by features with their counts in a text of ``n_words`` words."""
    on = [feature[count >= c] * N_LEVELS + j for j, c in enumerate(LEVELS)]
    on += [feature[count >= c * n_words] * N_LEVELS + len(LEVELS) + j for j, c in enumerate(SHARES)]
    return np.concatenate(on)


class Finder:
    """Kept features of texts, through a memo of distinct tokens."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.lists = keys, []
        self.memo = TokenMemo(self._rows)

    def _rows(self, tokens: list[str]) -> np.ndarray:
        out = np.zeros((len(tokens), 1), np.int64)          # number of the token's feature list; 0: none
        at, h = token_hashes(tokens)
        if len(self.keys) and len(h):
            pos = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            hit = np.flatnonzero(self.keys[pos] == h)
            for k in np.unique(at[hit]):
                self.lists.append(np.unique(pos[hit[at[hit] == k]]))
                out[k] = len(self.lists)
        return out

    def __call__(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """Per text: features, their counts, number of words."""
        out = []
        for _, part in slices(texts):
            if not self.memo.known:
                self.lists = []
            word, per_text = self.memo.words(part)
            mark = self.memo.rows[word, 0] if len(word) else word
            at = np.flatnonzero(mark)
            text = np.repeat(np.arange(len(part)), per_text)[at]
            if not len(at):
                out += [(np.zeros(0, np.int64), np.zeros(0), n) for n in per_text.tolist()]
                continue
            # (text, feature) pairs of all marked words of the slice, counted at once
            used, which = np.unique(mark[at], return_inverse=True)
            lists = [self.lists[k - 1] for k in used.tolist()]
            size = np.array([len(x) for x in lists])
            flat, start = np.concatenate(lists), np.cumsum(size) - size
            n = size[which]
            feature = flat[np.repeat(start[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            pair, count = np.unique(np.repeat(text, n) * len(self.keys) + feature, return_counts=True)
            stop = np.searchsorted(pair, np.arange(len(part) + 1) * len(self.keys))
            out += [(pair[a:e] % len(self.keys), count[a:e].astype(float), w)
                    for a, e, w in zip(stop[:-1].tolist(), stop[1:].tolist(), per_text.tolist(), strict=True)]
        return out


def fit_ordinal(rows: list[np.ndarray], grade: np.ndarray, n_features: int, steps: int = 500,
                rate: float = 0.1, l2: float = 2e-5) -> tuple[np.ndarray, np.ndarray]:
    """Full-batch gradient ascent (Adam) on the cumulative-link likelihood; thresholds are kept
    ordered by learning the first and the logs of the gaps."""
    n = max(len(rows), 1)
    indptr = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    col = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(rows)), np.diff(indptr))
    k_max = GRADES
    theta = np.concatenate([[1.0], np.zeros(k_max - 1)])
    p = np.concatenate([np.zeros(n_features), theta])
    m, v = np.zeros_like(p), np.zeros_like(p)
    balance = 1.0 / n
    for step in range(1, steps + 1):
        w, th = p[:n_features], p[n_features:]
        gaps = np.exp(th[1:])
        t = th[0] + np.concatenate([[0.0], np.cumsum(gaps)])
        z = np.bincount(doc, weights=w[col], minlength=len(rows))
        cum = np.concatenate([np.ones((len(rows), 1)), 1 / (1 + np.exp(-np.clip(z[:, None] - t, -500, 500))), np.zeros((len(rows), 1))], axis=1)
        idx = np.arange(len(rows))
        hi, lo = cum[idx, grade], cum[idx, grade + 1]          # P(grade >= g), P(grade > g)
        like = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi), lo * (1 - lo)
        dz = balance * (dhi - dlo) / like
        dt = np.zeros(k_max)
        np.add.at(dt, np.maximum(grade - 1, 0), np.where(grade > 0, -balance * dhi / like, 0.0))
        np.add.at(dt, np.minimum(grade, k_max - 1), np.where(grade < k_max, balance * dlo / like, 0.0))
        grad = np.concatenate([np.bincount(col, weights=dz[doc], minlength=n_features) - l2 * w,
                               [dt.sum()], [dt[j:].sum() * gaps[j - 1] for j in range(1, k_max)]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        p = p + rate * (1 - step / (steps + 1)) * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-9)
        p[:n_features] = np.maximum(p[:n_features], 0.0)    # features are evidence for toxicity only
    th = p[n_features:]
    return p[:n_features], th[0] + np.concatenate([[0.0], np.cumsum(np.exp(th[1:]))])


def sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(text, toxic) of a bounded number of labelled rows, by smallest hash of the id."""
    lab = (labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
           .select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("label")))
    key = [F.xxhash64("_id"), F.col("_id")]
    parts = [lab.where(F.col("label") == v).orderBy(*key).limit(max_rows // 2) for v in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.join(F.broadcast(chosen), d["doc_id"] == chosen["_id"]).select("doc_id", "text", "label")   # max_rows rows


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES) -> Ordinal:
    spark = docs.sparkSession
    rows = materialise(sample(docs, labels, max_rows), "tox-sample")
    totals = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    none = Ordinal(np.zeros(0, np.int64), np.zeros(0), np.full(GRADES, np.inf), np.zeros(0, bool))
    if not n1:
        return none

    def run(batches):
        """Texts of each label per feature, summed inside each task first."""
        sums: list[list[np.ndarray]] = [[], []]

        def flush(label):
            u, c = np.unique(np.concatenate(sums[label]), return_counts=True)
            sums[label] = []
            n = [np.zeros(len(u), np.int64), c.astype(np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(n[label]), pa.array(n[1 - label])], names=["h", "pos", "neg"])
        for b in batches:
            for t, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[label].append(text_hashes(t))
                if sum(map(len, sums[label])) > 2_000_000:
                    yield flush(label)
        for label in (0, 1):
            if sums[label]:
                yield flush(label)
    count = (rows.select("text", "label").mapInArrow(run, "h long, pos long, neg long")
             .groupBy("h").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where(F.col("pos") >= MIN_DOCS))
    # every feature is tested; max_features of them, the most significant, reach the driver
    pos, neg = F.col("pos"), F.col("neg")
    p1, p0, p = pos / F.lit(n1), neg / F.lit(max(n0, 1)), (pos + neg) / F.lit(n1 + n0)

    def ll(k, n, q):
        q = F.greatest(F.least(q, F.lit(1 - 1e-12)), F.lit(1e-12))
        return k * F.log(q) + (F.lit(n) - k) * F.log(F.lit(1.0) - q)
    # the log-likelihood ratio statistic of "present" against the label
    g2 = F.lit(2.0) * (ll(pos, n1, p1) + ll(neg, n0, p0) - ll(pos, n1, p) - ll(neg, n0, p))
    lifted = materialise(count.where(p1 > MIN_LIFT * p0).select("h", "neg", g2.alias("g2")), "tox-features")

    def best(some):
        return some.orderBy(F.desc("g2"), "h").limit(max_features).toPandas().sort_values("h")
    strong = best(lifted.where(F.col("g2") > MIN_G2))
    if not len(strong):                      # tiny samples: the best there is
        strong = best(lifted)
    if not len(strong):
        return none
    keys, only = strong["h"].to_numpy(np.int64), strong["neg"].to_numpy(np.int64) == 0
    kept = spark.sparkContext.broadcast((keys, only))

    def features(batches):
        ks, lone = kept.value
        find = Finder(ks)
        for b in batches:
            found = find(b.column("text"))
            # share of words with a toxic-only feature: the most frequent such feature's words at least
            share = [c[lone[f]].max(initial=0.0) / max(n, 1) for f, c, n in found]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("label"), pa.array([inputs(*x).astype(np.int32) for x in found], pa.list_(pa.int32())),
                 pa.array([float(x) for x in share], pa.float64())], names=["doc_id", "label", "feature", "share"])
    got = sorted(rows.mapInArrow(features, "doc_id long, label int, feature array<int>, share double").collect(),
                 key=lambda r: (r["doc_id"], r["label"]))
    x = [np.array(r["feature"], np.int64) for r in got]
    label, dense = np.array([r["label"] for r in got]), np.array([r["share"] for r in got])
    cuts = np.quantile(dense[label == 1], [1 / 3, 2 / 3])
    grade = np.where(label == 0, 0, 1 + (dense > cuts[0]) + (dense > cuts[1]))
    weights, thresholds = fit_ordinal(x, grade.astype(np.int64), len(keys) * N_LEVELS)
    return Ordinal(keys, weights, thresholds, only)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("severity", pa.float64()), ("grade", pa.int32()),
                    ("p_toxic", pa.float64()), ("toxic", pa.bool_())])
DDL = "doc_id long, severity double, grade int, p_toxic double, toxic boolean"

def _strength(m: Ordinal, texts: pa.Array) -> np.ndarray:
    """w . x of each text; the worker's memo of tokens lives as long as the model."""
    _, find = held("toxicity", id(m), lambda: (m, Finder(m.keys)))
    return np.array([m.weights[inputs(*x)].sum() if len(x[0]) else 0.0 for x in find(texts)])


def score(docs: DataFrame, model: Ordinal) -> DataFrame:
    """Expected severity of every row of ``docs``; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            above = shared.value.above(_strength(shared.value, b.column(1)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(above.sum(axis=1)), pa.array((above >= 0.5).sum(axis=1).astype(np.int32)),
                 pa.array(above[:, 0].copy()), pa.array(above[:, 0] >= 0.5)], schema=SCHEMA)
    return id_text(docs).mapInArrow(run, DDL)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score(docs, train(docs, read_table(spark, sf_dir, "labels")))
