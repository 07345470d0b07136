"""S1 as a fitted, saved and loaded model: standardisation, isolation forest and score offset.

``fit`` takes the cards outside the excluded categories, fits mean and scale of every model column
(one aggregation), trains the forest on the standardised columns, scores the training cards and
fixes the offset at a quantile of their scores, so that the share ``contamination`` of them lies
above zero. The quantile is read off the global rank (two rows at known positions), so no buffer of
scores is built. A bundle is a folder of small tables: ``scaler`` (position, feature, mean, scale),
``nodes``, ``excluded_cats`` and ``settings`` (one row); ``load`` reads it back and ``score`` needs
nothing else. The score is -(score_samples - offset) with score_samples = -2^(-E[h] / c(psi)).

Means and scales are kept to six decimals, so that the order of a sum never decides a split. A
column without spread has scale 1. Missing columns raise; an empty training set has the offset
-0.5, the score_samples of a forest without evidence."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farewatch.functions.ordered import written
from farewatch.operators.normalize import once
from farewatch.operators.scoring import ForestConfig, prepare_matrix, score_features, train_forest

TABLES = ("scaler", "nodes", "excluded_cats", "settings")
NO_EVIDENCE = -0.5


@dataclass(frozen=True)
class Bundle:
    """A fitted model: configuration, contamination, subsample size, offset and its two tables."""

    cfg: ForestConfig
    contamination: float
    psi: int
    offset: float
    scaler: DataFrame
    nodes: DataFrame


def _kept(features: DataFrame, cfg: ForestConfig) -> DataFrame:
    if not cfg.excluded_cats:
        return features
    return features.filter(~F.coalesce(F.col("dominant_cat").cast("string").isin(*map(str, cfg.excluded_cats)), F.lit(False)))


def _six(c: Column) -> Column:
    return F.floor(c * 1e6 + 0.5) / 1e6


def fit_scaler(features: DataFrame, columns: tuple) -> DataFrame:
    """(position, feature, mean, scale) of the model columns; one row each."""
    matrix = prepare_matrix(features, columns)
    stats = matrix.agg(*[e for k, c in enumerate(columns) for e in (F.avg(c).alias(f"m{k}"), F.stddev_pop(c).alias(f"s{k}"))])
    rows = F.array(*[F.struct(F.lit(k).alias("position"), F.lit(c).alias("feature"), F.coalesce(_six(F.col(f"m{k}")), F.lit(0.0)).alias("mean"),
                              F.coalesce(F.nullif(_six(F.col(f"s{k}")), F.lit(0.0)), F.lit(1.0)).alias("scale")) for k, c in enumerate(columns)])
    return stats.select(F.inline(rows))


def standardised(features: DataFrame, scaler: DataFrame) -> DataFrame:
    """card_id and the model columns, cleaned, centred and scaled."""
    fitted = scaler.orderBy("position").collect()                     # one row per model column
    columns = [r["feature"] for r in fitted]
    matrix = prepare_matrix(features, columns)
    # computed once: the model's own cleaning above reads every column several times
    return once(matrix, {r["feature"]: (F.col(r["feature"]) - F.lit(r["mean"])) / F.lit(r["scale"]) for r in fitted})


def _scores(matrix: DataFrame, nodes: DataFrame, cfg: ForestConfig, psi: int | None) -> DataFrame:
    """(card_id, strangeness, rank) of standardised rows: strangeness is -score_samples."""
    out = score_features(matrix, nodes, replace(cfg, excluded_cats=()), psi)
    return out.select("card_id", (F.col("anomaly_score") + 0.5).alias("strangeness"), "rank")


def offset_of(scores: DataFrame, contamination: float) -> float:
    """The ``contamination`` quantile of score_samples, by linear interpolation between two ranks."""
    n = scores.count()
    if not n:
        return NO_EVIDENCE
    place = contamination * (n - 1)
    low = math.floor(place)
    at = {r["rank"]: -r["strangeness"] for r in scores.where(F.col("rank").isin(low + 1, low + 2)).select("rank", "strangeness").collect()}
    return at[low + 1] + (at.get(low + 2, at[low + 1]) - at[low + 1]) * (place - low)


def fit(features: DataFrame, cfg: ForestConfig, path: str, contamination: float = 0.01) -> Bundle:
    """Fit a bundle, write it to ``path`` and return it as read back."""
    spark = features.sparkSession
    train = _kept(features, cfg)
    fit_scaler(train, cfg.features).write.mode("overwrite").parquet(f"{path}/scaler")
    scaler = spark.read.parquet(f"{path}/scaler")
    matrix = written(standardised(train, scaler), "standardised")
    train_forest(prepare_matrix(matrix, cfg.features), cfg).write.mode("overwrite").parquet(f"{path}/nodes")
    nodes = spark.read.parquet(f"{path}/nodes")
    psi = nodes.where("node = 0").agg(F.max("size")).first()[0] or 1
    offset = offset_of(_scores(matrix, nodes, cfg, psi), contamination)
    spark.createDataFrame([(str(c),) for c in cfg.excluded_cats], "cat string").write.mode("overwrite").parquet(f"{path}/excluded_cats")
    settings = [(cfg.model_name, cfg.n_trees, cfg.max_samples, cfg.seed, int(psi), float(contamination), float(offset))]
    spark.createDataFrame(settings, "model_name string, n_trees int, max_samples int, seed int, psi int, contamination double, offset double") \
        .write.mode("overwrite").parquet(f"{path}/settings")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Bundle:
    """The bundle a folder holds."""
    tables = {t: spark.read.parquet(f"{path}/{t}") for t in TABLES}
    s = tables["settings"].first()
    cfg = ForestConfig(n_trees=s["n_trees"], max_samples=s["max_samples"], seed=s["seed"], model_name=s["model_name"],
                       excluded_cats=tuple(sorted(r["cat"] for r in tables["excluded_cats"].collect())),
                       features=tuple(r["feature"] for r in tables["scaler"].orderBy("position").collect()))
    return Bundle(cfg, s["contamination"], s["psi"], s["offset"], tables["scaler"], tables["nodes"])


def score(features: DataFrame, bundle: Bundle) -> DataFrame:
    """features + ``anomaly_score`` (above 0: stranger than the offset), ``rank`` and ``model``."""
    missing = [c for c in bundle.cfg.features if c not in features.columns]
    if missing:
        raise ValueError(f"feature table lacks model columns: {', '.join(missing)}")
    kept = _kept(features, bundle.cfg)
    scores = _scores(standardised(kept, bundle.scaler), bundle.nodes, bundle.cfg, bundle.psi)
    scores = scores.select("card_id", (F.col("strangeness") + F.lit(bundle.offset)).alias("anomaly_score"), "rank")
    return kept.join(scores, "card_id").withColumn("model", F.lit(bundle.cfg.model_name))


def summary(bundle: Bundle) -> DataFrame:
    """The bundle as one table: mean and scale per column, and the offset."""
    return bundle.scaler.select("position", "feature", "mean", "scale", F.lit(bundle.offset).alias("offset"))
