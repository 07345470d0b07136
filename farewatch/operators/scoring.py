"""Card anomaly scoring (S1-S5) with an isolation forest trained and applied on Spark.

The published algorithm (Liu, Ting, Zhou, "Isolation Forest", ICDM 2008): each tree isolates a
random subsample of ``max_samples`` rows by axis-aligned random splits; anomalies have short
average path lengths. Score ``s = 2^(-E[h(x)] / c(psi))``; ``anomaly_score = s - 0.5`` (the
usual "auto" offset), higher = stranger.

Spark plan:
  * sampling: each (card, tree) pair is kept when a hash of (seed, tree, card) falls below
    ``2 * psi / n``, so each tree gets about ``2 * psi`` rows whatever the table size;
  * training: ``groupBy(tree).applyInPandas`` grows one tree per group from its ``psi``
    lowest-hash rows (a group never exceeds ``~2 * psi`` rows);
  * scoring: the node table (``n_trees * (2 * psi - 1)`` rows at most: a bound set by the
    parameters, not by the data) is broadcast and every partition is scored by ``mapInPandas``,
    vectorised over rows and tree levels;
  * ranking: global rank by (score desc, card) through the range-partitioned prefix sum
    (no single-partition window); the top share is a rank filter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farewatch.functions.ordered import exclusive_prefix_sum
from farewatch.operators.features import NUMERIC_FEATURES
from farewatch.session import ship_package

NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, size int, depth int"


@dataclass(frozen=True)
class ForestConfig:
    n_trees: int = 100
    max_samples: int = 256
    seed: int = 42
    model_name: str = "isolation_forest"
    excluded_cats: tuple = ()
    features: tuple = tuple(NUMERIC_FEATURES)


def average_path(n: float) -> float:
    """c(n): average unsuccessful-search path length in a binary search tree of n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def prepare_matrix(features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Model inputs as doubles to six decimals (so that the last bits of a mean or an entropy never
    decide a split); missing columns raise; null / NaN / +-inf -> 0."""
    missing = [c for c in columns if c not in features.columns]
    if missing:
        raise ValueError(f"feature table lacks model columns: {', '.join(missing)}")
    clean = [F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
                    | F.col(c).cast("double").isin(float("inf"), float("-inf")), F.lit(0.0))
             .otherwise(F.floor(F.col(c).cast("double") * 1e6 + 0.5) / 1e6).alias(c) for c in columns]
    return features.select("card_id", *clean)


def unit(*parts) -> float:
    """A number in [0, 1) from the first 32 bits of an md5; ``unit_column`` and SQL draw the same."""
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 4294967296.0


def unit_column(*parts) -> Column:
    cols = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 8), 16, 10).cast("double") / 4294967296.0


def _grow(columns: list[str], psi: int, seed: int):
    height_limit = int(math.ceil(math.log2(max(psi, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values(["h", "card_id"]).head(psi)
        x = pdf[columns].to_numpy(dtype=float)
        rows: list[tuple] = []
        stack = [(np.arange(len(x)), 0, 0)]
        while stack:
            idx, node, depth = stack.pop()
            sub = x[idx]
            if len(idx) > 1:
                lo, hi = sub.min(axis=0), sub.max(axis=0)
                splittable = np.flatnonzero(hi > lo)
            else:
                lo = hi = None
                splittable = np.array([], dtype=int)
            if depth >= height_limit or len(idx) <= 1 or len(splittable) == 0:
                rows.append((tree, node, -1, 0.0, -1, -1, len(idx), depth))
                continue
            f = int(splittable[int(unit(seed, tree, node, "f") * len(splittable))])
            thr = float(lo[f] + unit(seed, tree, node, "t") * (hi[f] - lo[f]))
            left_mask = sub[:, f] < thr
            left, right = 2 * node + 1, 2 * node + 2          # numbered like a heap
            rows.append((tree, node, f, thr, left, right, len(idx), depth))
            stack.append((idx[left_mask], left, depth + 1))
            stack.append((idx[~left_mask], right, depth + 1))
        return pd.DataFrame(rows, columns=["tree", "node", "feature", "threshold", "left", "right", "size", "depth"])

    return grow


def train_forest(matrix: DataFrame, cfg: ForestConfig = ForestConfig()) -> DataFrame:
    """Node table of the forest (schema ``NODE_SCHEMA``).

    Each (card, tree) pair is kept with probability ``p = 2 * psi / n``. To avoid touching
    ``n * n_trees`` pairs, rows are first pre-sampled with one hash at ``q = min(1, n_trees * p)``
    and only those rows are expanded over the trees, each kept with ``p / q``: the same
    inclusion probability per pair, about ``2 * psi * n_trees`` rows in total."""
    ship_package(matrix.sparkSession)
    columns = list(cfg.features)
    n = matrix.count()
    psi = min(cfg.max_samples, max(n, 1))
    p = min(1.0, 2.0 * psi / max(n, 1)) if n > psi else 1.0
    q = min(1.0, cfg.n_trees * p)
    trees = F.sequence(F.lit(0), F.lit(cfg.n_trees - 1))
    sample = (
        matrix.filter(unit_column(cfg.seed, -1, F.col("card_id")) <= q)
        .withColumn("tree", F.explode(trees))
        .withColumn("h", unit_column(cfg.seed, F.col("tree"), F.col("card_id")))
        .filter(F.col("h") <= p / q)
    )
    return sample.groupBy("tree").applyInPandas(_grow(columns, psi, cfg.seed), NODE_SCHEMA)


PATH_UNIT = 1e9     # path lengths are summed as whole billionths: exact in any order


class Trees:
    """The node table as arrays, one lookup table per tree."""

    def __init__(self, nodes: pd.DataFrame):
        self.trees = []
        for _, t in nodes.groupby("tree"):
            size = int(t["node"].max()) + 1
            feat, thr = np.full(size, -1, dtype=int), np.zeros(size)
            kids, leaf = np.zeros((2, size), dtype=int), np.zeros(size, dtype=np.int64)
            at = t["node"].to_numpy()
            feat[at], thr[at] = t["feature"].to_numpy(), t["threshold"].to_numpy()
            kids[0, at], kids[1, at] = t["left"].to_numpy(), t["right"].to_numpy()
            paths = t["depth"].to_numpy() + np.array([average_path(s) for s in t["size"].to_numpy()])
            leaf[at] = np.floor(paths * PATH_UNIT + 0.5).astype(np.int64)
            self.trees.append((feat, thr, kids, leaf))

    def path_units(self, x: np.ndarray) -> np.ndarray:
        """Summed path lengths of rows over all trees, in units of 1 / PATH_UNIT."""
        total = np.zeros(len(x), dtype=np.int64)
        for feat, thr, kids, leaf in self.trees:
            at = np.zeros(len(x), dtype=int)
            active = feat[at] >= 0
            while active.any():
                i = np.flatnonzero(active)
                right = x[i, feat[at[i]]] >= thr[at[i]]
                at[i] = kids[right.astype(int), at[i]]
                active = feat[at] >= 0
            total += leaf[at]
        return total


def score_features(features: DataFrame, nodes: DataFrame, cfg: ForestConfig = ForestConfig(),
                   psi: int | None = None) -> DataFrame:
    """features + ``anomaly_score``, ``rank`` (1 = strangest; ties by card id) and ``model``."""
    spark: SparkSession = features.sparkSession
    ship_package(spark)
    kept = features
    if cfg.excluded_cats:
        kept = kept.filter(~F.col("dominant_cat").isin(*[str(c) for c in cfg.excluded_cats]))
    columns = list(cfg.features)
    matrix = prepare_matrix(kept, columns)
    node_pdf = nodes.toPandas()  # bounded: n_trees * (2 * max_samples - 1) rows
    psi = psi or int(node_pdf.loc[node_pdf["node"] == 0, "size"].max() if len(node_pdf) else 1)
    c = average_path(psi)
    bc = spark.sparkContext.broadcast(node_pdf)
    n_trees = cfg.n_trees

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = Trees(bc.value)               # once per task
        for pdf in batches:
            eh = trees.path_units(pdf[columns].to_numpy(dtype=float)) / PATH_UNIT / max(n_trees, 1)
            x = pdf
            s = np.power(2.0, -eh / c) if c > 0 else np.full(len(x), 0.5)
            yield pd.DataFrame({"card_id": pdf["card_id"], "anomaly_score": s - 0.5})

    scores = matrix.mapInPandas(score, "card_id string, anomaly_score double")
    ranked = exclusive_prefix_sum(scores.withColumn("_one", F.lit(1)), [],
                                  [(-F.col("anomaly_score")), F.col("card_id")], "_one", "_before")
    ranked = ranked.select("card_id", "anomaly_score", (F.col("_before") + 1).cast("bigint").alias("rank"))
    return kept.join(ranked, "card_id").withColumn("model", F.lit(cfg.model_name))


def select_top_percent(scored: DataFrame, top_percent: float = 0.01) -> DataFrame:
    """Best-ranked ``max(1, round_half_even(n * p))`` rows, flagged ``ml_fraud_flag = 1``."""
    n = scored.agg(F.count(F.lit(1))).scalar()
    top_n = F.greatest(F.lit(1), F.bround(n * F.lit(top_percent), 0).cast("bigint"))
    return scored.filter(F.col("rank") <= top_n).withColumn("ml_fraud_flag", F.lit(1))


def known_fraud(labels: DataFrame) -> DataFrame:
    if "is_fraud" not in labels.columns:
        return labels.sparkSession.createDataFrame([], "card_id string")
    return labels.filter(F.col("is_fraud").cast("int") == 1).select(F.col("card_id").cast("string"))


def new_pattern_candidates(top: DataFrame, labels: DataFrame) -> DataFrame:
    return top.join(known_fraud(labels), "card_id", "left_anti")


def inference_summary(scored: DataFrame, top: DataFrame, candidates: DataFrame, cfg: ForestConfig,
                      top_percent: float = 0.01) -> DataFrame:
    top_n = top.agg(F.count(F.lit(1))).scalar()
    new_n = candidates.agg(F.count(F.lit(1))).scalar()
    return scored.agg(F.count(F.lit(1)).alias("scored_cards")).select(
        F.lit(cfg.model_name).alias("model_name"), "scored_cards",
        F.lit(float(top_percent)).alias("top_percent"),
        top_n.alias("top_cards"), (top_n - new_n).alias("known_fraud_excluded"),
        new_n.alias("new_pattern_candidates"))
