"""Quality classifier: supervised subword embeddings.

A document is the bag of its white-space tokens; each token contributes a word vector, the
vectors of its character n-grams (with the token's edges), a vector of its collapsed shape
(upper, lower, digits, other), and, where it repeats the token before it, a repeat vector. All
vectors live in one hashed table and are averaged per document; a softmax over the two classes
follows. Table and softmax are learned by plain stochastic gradient descent in numpy.

The labelled rows for the fit are bounded: at most ``max_rows`` (those with the smallest hash
of their id, half of them from either label where there are enough), whole texts. Their feature
counts are made on the executors.

Scoring covers every whole text in one pass without a shuffle. As averages and softmax are
linear up to the last step, table and softmax fold into one number per hashed feature.

Defined results: null and empty texts have no features and get the prior's score; without
labels every score is 0.5; with labels of one class only, near that class; conflicting repeated
labels each count; repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_bucket, id_text, read_table
from .tokens import TokenMemo, char_ngrams, held, slices, word_hashes, words_of

BUCKETS = 1 << 18
DIM = 8
SIZES = (3, 4, 5)
MAX_ROWS = 3000         # bound of the labelled sample
EPOCHS = 12
RATE = 0.5
SEED = 11
HELD_MODULUS, HELD_REST = 3, 1     # fixed values of the contract
REPEAT = 7              # hashed id of the repeat feature

_SHAPE = [(re.compile(r"[^\W\d_]+"), lambda m: "X" if m[0].isupper() else "x" if m[0].islower() else "Xx"),
          (re.compile(r"\d+"), lambda m: "9")]


def shape(token: str) -> str:
    for rule, to in _SHAPE:
        token = rule.sub(to, token)
    return token


def token_features(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(token number, hashed feature) of every feature of distinct tokens."""
    own = np.arange(len(tokens))
    words = word_hashes(tokens)
    shapes = word_hashes([shape(t) for t in tokens], salt=1)
    at, grams = char_ngrams(tokens, SIZES)
    feature = np.concatenate([words, shapes, grams]) % np.uint64(BUCKETS)
    return np.concatenate([own, own, at]), feature.astype(np.int64)


def document_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(feature, count) of one text, features distinct."""
    tokens = words_of(text)
    if not tokens:
        return np.zeros(0, np.int64), np.zeros(0)
    distinct, inverse, count = np.unique(np.array(tokens, dtype=object), return_inverse=True, return_counts=True)
    at, feature = token_features(list(distinct))
    repeats = int((inverse[1:] == inverse[:-1]).sum())
    feature = np.append(feature, REPEAT)
    weight = np.append(count[at].astype(float), float(repeats))
    u, inv = np.unique(feature, return_inverse=True)
    return u, np.bincount(inv, weights=weight)


class Classifier:
    def __init__(self, fold: np.ndarray, bias: float):
        self.fold, self.bias = fold, bias          # one number per hashed feature

    def rows(self, tokens: list[str]) -> np.ndarray:
        at, feature = token_features(tokens)
        return np.stack([np.bincount(at, weights=self.fold[feature], minlength=len(tokens)),
                         np.bincount(at, minlength=len(tokens)).astype(float)], axis=1)


def fit(samples: list[tuple[np.ndarray, np.ndarray, int]], dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE,
        seed: int = SEED) -> Classifier:
    """Stochastic gradient descent over (features, counts, label) documents."""
    rng = np.random.default_rng(seed)
    if not samples:
        return Classifier(np.zeros(BUCKETS), 0.0)
    table = rng.uniform(-1.0 / dim, 1.0 / dim, (BUCKETS, dim))
    softmax, bias = np.zeros((2, dim)), np.zeros(2)
    steps, total = 0, epochs * len(samples)
    for _ in range(epochs):
        for k in rng.permutation(len(samples)):
            feature, count, label = samples[k]
            lr = rate * (1.0 - steps / total)
            steps += 1
            n = count.sum()
            share = count / n if n else count
            hidden = share @ table[feature] if n else np.zeros(dim)
            z = softmax @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            error = -p
            error[label] += 1.0
            if n:
                # the mean's gradient per feature is its share; scaled by the number of distinct
                # features so that a step does not vanish for long texts
                table[feature] += (lr * min(len(feature), 50.0)) * np.outer(share, error @ softmax)
            softmax += lr * np.outer(error, hidden)
            bias += lr * 0.1 * error
    return Classifier(table @ (softmax[1] - softmax[0]), float(bias[1] - bias[0]))


def sample(docs: DataFrame, labels: DataFrame, column: str, allowed, max_rows: int = MAX_ROWS) -> DataFrame:
    """At most ``max_rows`` labelled rows (text, label), half from either class where possible,
    by smallest hash of the id."""
    lab = (labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull()).where(allowed)
           .select(F.col("doc_id").cast("long").alias("_id"), F.col(column).cast("int").alias("label")))
    key = [F.xxhash64("_id"), F.col("_id")]
    parts = [lab.where(F.col("label") == v).orderBy(*key).limit(max_rows // 2) for v in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.join(F.broadcast(chosen), d["doc_id"] == chosen["_id"]).select("doc_id", "text", "label")   # max_rows rows


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, **kw) -> Classifier:
    held = F.coalesce(id_bucket("doc_id", HELD_MODULUS) == HELD_REST, F.lit(False))
    rows = sample(docs, labels, "quality", ~held, max_rows)
    ddl = "doc_id long, label int, feature array<int>, count array<float>"
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("feature", pa.list_(pa.int32())), ("count", pa.list_(pa.float32()))])

    def run(batches):
        for b in batches:
            found = [document_features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"),
                                              pa.array([f.astype(np.int32) for f, _ in found], pa.list_(pa.int32())),
                                              pa.array([c.astype(np.float32) for _, c in found], pa.list_(pa.float32()))], schema=schema)
    got = rows.mapInArrow(run, ddl).toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])
    flat_f, flat_c = got["feature"].combine_chunks(), got["count"].combine_chunks()
    fs, cs = flat_f.flatten().to_numpy(), flat_c.flatten().to_numpy()
    cut = np.concatenate([[0], np.cumsum(flat_f.value_lengths().to_numpy())]) if len(got) else [0]
    samples = [(fs[cut[k]:cut[k + 1]], cs[cut[k]:cut[k + 1]].astype(float), int(y)) for k, y in enumerate(got["label"].to_pylist())]
    return fit(samples, **kw)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_tokens", pa.int64())])

def _judge(m: Classifier, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(score, tokens) of each text; the worker's memo of tokens lives as long as the model."""
    memo = held("quality", id(m), lambda: TokenMemo(m.rows))            # it holds the model
    sums = []
    for _, part in slices(texts):
        word, per_text = memo.words(part)
        text = np.repeat(np.arange(len(part)), per_text)
        rows = memo.rows[word] if len(word) else np.zeros((0, 2))
        again = np.flatnonzero((word[1:] == word[:-1]) & (text[1:] == text[:-1])) if len(word) else word
        repeats = np.bincount(text[again], minlength=len(part)) if len(again) else np.zeros(len(part))
        sums.append(np.stack([np.bincount(text, weights=rows[:, 0], minlength=len(part)) + repeats * m.fold[REPEAT],
                              np.bincount(text, weights=rows[:, 1], minlength=len(part)) + repeats, per_text.astype(float)], axis=1))
    total, weight, n = np.concatenate(sums).T if sums else np.zeros((3, 0))
    z = np.divide(total, weight, out=np.zeros_like(total), where=weight > 0) + m.bias
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))), n.astype(np.int64)


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, score, n_tokens) of every row of ``docs``; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            p, n = _judge(shared.value, b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array(n)], schema=SCHEMA)
    return id_text(docs).mapInArrow(run, "doc_id long, score double, n_tokens long")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = score(docs, train(docs, read_table(spark, sf_dir, "labels")))
    held = F.coalesce(id_bucket("doc_id", HELD_MODULUS) == HELD_REST, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
