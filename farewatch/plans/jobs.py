"""Batch jobs: rules -> report -> dashboard tables, and labels -> features -> scores.

Every stage reads the previous stage's written tables, so a failed or resumed job restarts at
a stage boundary and no plan carries the whole lineage. Paths are folders on the cluster's
shared file system."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farewatch.config import RulesConfig
from farewatch.functions.time import iso_text
from farewatch.operators import model_bundle
from farewatch.operators import presentation as P
from farewatch.operators import scoring as S
from farewatch.operators.dedupe import remove_near_duplicates
from farewatch.operators.features import build_features, feature_rows_raw
from farewatch.operators.labels import build_card_labels, load_labels
from farewatch.operators.normalize import normalize_transactions
from farewatch.operators.report import aggregate_results, export_anomalies, hypothesis_stats, top_entities
from farewatch.operators.rules import run_rules, union_anomalies
from farewatch.session import prepare
from farewatch.sources.one_file import write_one_csv
from farewatch.sources.raw_files import read_raw_with_rejects




def _write(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> DataFrame:
    if partition_by:
        # files by partition value: Spark clusters the rows by it and cuts large values in pieces
        df = df.hint("rebalance", *partition_by)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)
    return df.sparkSession.read.format(fmt).option("header", True).load(path) if fmt == "csv" else \
        df.sparkSession.read.format(fmt).load(path)


def load_raw(spark: SparkSession, raw_dir: str, out_dir: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a raw folder, read once and written: every later step starts from here."""
    rows, rejects = read_raw_with_rejects(spark, raw_dir)
    return _write(rows, os.path.join(out_dir, "raw")), _write(rejects, os.path.join(out_dir, "raw_rejects"))


def load_transactions(spark: SparkSession, raw: DataFrame, out_dir: str) -> tuple[DataFrame, DataFrame]:
    """Raw rows -> (normalised, de-duplicated) tables, both written partitioned by date."""
    norm = _write(normalize_transactions(raw), os.path.join(out_dir, "tx_norm"), partition_by=["date"])
    tx = _write(remove_near_duplicates(norm), os.path.join(out_dir, "tx"), partition_by=["date"])
    return norm, tx


def transaction_summary(tx: DataFrame, approx: bool = False) -> DataFrame:
    """Rows, period and distinct cards / validators / routes / categories. ``approx=True``
    uses HyperLogLog++ sketches (``approx_count_distinct``, ~2 % error) instead of exact
    distinct counts, which avoids one expanded shuffle per distinct column on huge inputs."""
    distinct = (lambda c: F.approx_count_distinct(c)) if approx else (lambda c: F.countDistinct(c))
    return tx.agg(
        F.count(F.lit(1)).alias("transactions"),
        iso_text(F.min("dt")).alias("period_start"), iso_text(F.max("dt")).alias("period_end"),
        distinct("card").alias("cards"), distinct("trm_id").alias("validators"),
        distinct("route_num").alias("routes"), distinct("cat_num").alias("categories"))


def run_rules_pipeline(spark: SparkSession, tx: DataFrame, out_dir: str,
                       selected: Iterable[str] | None = None, config: RulesConfig | None = None) -> dict[str, DataFrame]:
    prepare(spark)
    results = run_rules(tx, selected, config)
    anomalies = _write(union_anomalies(results), os.path.join(out_dir, "anomalies"), partition_by=["hypothesis"])
    report = _write(P.ordered(aggregate_results(anomalies)), os.path.join(out_dir, "fraud_report"))
    write_one_csv(P.ordered(report), os.path.join(out_dir, "fraud_report.csv"))
    stats = _write(hypothesis_stats(spark, anomalies, list(results)), os.path.join(out_dir, "hypothesis_stats"))
    _write(export_anomalies(anomalies), os.path.join(out_dir, "dashboard_anomalies"), fmt="json",
           partition_by=["hypothesis"])
    _write(top_entities(report), os.path.join(out_dir, "dashboard_top"), fmt="json")
    totals = anomalies.agg(F.count(F.lit(1))).scalar()
    entities = report.agg(F.count(F.lit(1))).scalar()
    # rows per rule as a map (one entry per selected rule: bounded by the registry)
    per_rule = stats.agg(F.map_from_entries(F.collect_list(F.struct("hypothesis", "rows")))).scalar()
    summary = transaction_summary(tx).select(F.lit("rules").alias("stage"), "*", entities.alias("entities"),
                                             totals.alias("total_anomalies"), per_rule.alias("hypotheses"))
    _write(summary, os.path.join(out_dir, "summary"), fmt="json")
    for kind in ("high", "medium", "validators"):
        write_one_csv(P.action_list(P.ordered(report), kind), os.path.join(out_dir, f"action_{kind}.csv"))
    return {"anomalies": anomalies, "report": report, "stats": stats, "summary": summary}


def build_feature_table(spark: SparkSession, labels: DataFrame, out_dir: str, tx_norm: DataFrame | None = None,
                        feature_rows: DataFrame | None = None) -> DataFrame:
    """The feature job by itself: a label table (or file, see ``load_labels``) and taps, either
    normalised ones or the feature loader's own view of raw rows."""
    prepare(spark)
    return _write(build_features(tx_norm, load_labels(labels), rows=feature_rows), os.path.join(out_dir, "features"))


def fit_model(spark: SparkSession, features: DataFrame, model_dir: str, cfg: S.ForestConfig = S.ForestConfig(),
              contamination: float = 0.01) -> model_bundle.Bundle:
    """Fit scaler, forest and offset on a feature table and save them as a folder of tables."""
    prepare(spark)
    return model_bundle.fit(features, cfg, model_dir, contamination)


def run_bundle_inference(spark: SparkSession, features: DataFrame, labels: DataFrame, model_dir: str, out_dir: str,
                         top_percent: float = 0.01) -> dict[str, DataFrame]:
    """The scoring job with a saved model: scores, top share, candidates and summary."""
    prepare(spark)
    model = model_bundle.load(spark, model_dir)
    return _published(_write(model_bundle.score(features, model), os.path.join(out_dir, "inference_scores")), labels, out_dir, model.cfg, top_percent)


def run_inference(spark: SparkSession, features: DataFrame, labels: DataFrame, out_dir: str,
                  cfg: S.ForestConfig = S.ForestConfig(), top_percent: float = 0.01,
                  nodes: DataFrame | None = None) -> dict[str, DataFrame]:
    """The scoring job by itself, from given features and labels; the forest is trained unless its
    node table is given."""
    prepare(spark)
    if nodes is None:
        nodes = _write(S.train_forest(S.prepare_matrix(features, cfg.features), cfg), os.path.join(out_dir, "model"))
    return _published(_write(S.score_features(features, nodes, cfg), os.path.join(out_dir, "inference_scores")), labels, out_dir, cfg, top_percent)


def _published(scored: DataFrame, labels: DataFrame, out_dir: str, cfg: S.ForestConfig, top_percent: float) -> dict[str, DataFrame]:
    top = _write(S.select_top_percent(scored, top_percent), os.path.join(out_dir, "top_percent_cards"))
    cands = _write(S.new_pattern_candidates(top, labels), os.path.join(out_dir, "new_candidates"))
    write_one_csv(cands.orderBy("rank"), os.path.join(out_dir, "new_candidates.csv"))
    summary = _write(S.inference_summary(scored, top, cands, cfg, top_percent),
                     os.path.join(out_dir, "inference_summary"), fmt="json")
    return {"scored": scored, "top": top, "candidates": cands, "summary": summary}


def run_ml_pipeline(spark: SparkSession, tx_norm: DataFrame, tx: DataFrame, report: DataFrame, out_dir: str,
                    cfg: S.ForestConfig = S.ForestConfig(), top_percent: float = 0.01,
                    feature_rows: DataFrame | None = None) -> dict[str, DataFrame]:
    """Labels, features (from ``feature_rows`` when given, the feature loader's own view of the
    raw files; else from the normalised table), forest, scores, top share, candidates."""
    prepare(spark)
    labels = _write(build_card_labels(tx, report), os.path.join(out_dir, "labels"))
    features = build_feature_table(spark, labels, out_dir, tx_norm, feature_rows)
    found = run_inference(spark, features, labels, out_dir, cfg, top_percent)
    summary = found["summary"]
    n_features = features.agg(F.count(F.lit(1))).scalar()
    ml = labels.agg(F.count(F.lit(1)).alias("labels"), F.sum("is_fraud").alias("fraud_labels")).select(
        F.lit("ml").alias("stage"), F.lit("inference").alias("mode"), "labels", "fraud_labels",
        n_features.alias("features"),
        F.struct(*[summary.agg(F.first(c)).scalar().alias(c) for c in summary.columns]).alias("inference"))
    ml = _write(ml, os.path.join(out_dir, "summary"), fmt="json")
    return {"labels": labels, "features": features, **found, "ml_summary": ml}


def run_full_pipeline(spark: SparkSession, raw_dir: str, out_dir: str, selected: Iterable[str] | None = None,
                      config: RulesConfig | None = None) -> dict[str, DataFrame]:
    """Everything from one read of the raw folder; ``summary`` holds both stages' summaries."""
    tables = os.path.join(out_dir, "tables")
    raw, rejects = load_raw(spark, raw_dir, tables)
    tx_norm, tx = load_transactions(spark, raw, tables)
    rules = run_rules_pipeline(spark, tx, os.path.join(out_dir, "rules"), selected, config)
    rows = _write(feature_rows_raw(raw), os.path.join(tables, "feature_rows"))
    ml = run_ml_pipeline(spark, tx_norm, tx, rules["report"], os.path.join(out_dir, "ml"), feature_rows=rows)
    part = ml["ml_summary"].agg(F.first(F.struct("*"))).scalar()
    full = _write(rules["summary"].select(F.struct("*").alias("rules"), part.alias("ml")), os.path.join(out_dir, "summary"), fmt="json")
    return {**rules, **{f"ml_{k}": v for k, v in ml.items()}, "rejects": rejects, "full_summary": full}


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_artifact(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """A stage table written by an earlier run, read with an explicit schema (ids stay text);
    a missing artifact is an empty frame with that schema."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(path)
