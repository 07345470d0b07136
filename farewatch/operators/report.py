"""Fold all rule hits into one risk row per entity (P1) and the export tables (P3)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from farewatch.config import ReportConfig
from farewatch.functions.numeric import np_round
from farewatch.schemas import REPORT_COLUMNS

# fixed values: every entity type a rule can emit (bounds the per-type weight table)
TOP_PER_TYPE = 20
HIGH_RISK, MEDIUM_RISK = 70, 40


def entity_weights(entities: DataFrame, cfg: ReportConfig = ReportConfig()) -> DataFrame:
    """One row per entity type: ``clamp(75 / p95(total_violations))``, 1 when p95 <= 0.
    ``percentile`` keeps a value->count map, so its state is bounded by distinct counts."""
    p = entities.groupBy("entity_type").agg(
        F.percentile(F.col("total_violations").cast("double"), cfg.target_percentile / 100.0).alias("p"))
    raw = F.when(F.col("p") <= 0, F.lit(1.0)).otherwise(F.lit(75.0) / F.col("p"))
    return p.select("entity_type", F.least(F.lit(cfg.max_weight), F.greatest(F.lit(cfg.min_weight), raw)).alias("weight"))


def aggregate_results(anomalies: DataFrame, cfg: ReportConfig = ReportConfig()) -> DataFrame:
    """Report columns ``schemas.REPORT_COLUMNS``. Raw and strong hits both count as violations;
    ``info`` counts as raw; first/last seen are text minimum/maximum of the non-empty dates."""
    seen = F.when(F.col("seen_date") != "", F.col("seen_date"))
    ent = anomalies.groupBy("entity_type", "entity_id").agg(
        F.count(F.lit(1)).alias("total_violations"),
        # at most one entry per rule: bounded by the size of the rule registry
        F.array_sort(F.collect_set("hypothesis")).alias("_rules"),
        F.max((F.col("severity") == "strong").cast("int")).alias("_strong"),
        F.coalesce(F.min(seen), F.lit("")).alias("first_seen"),
        F.coalesce(F.max(seen), F.lit("")).alias("last_seen"),
    )
    # the weight table has one row per entity type (a fixed, five-value domain)
    weights = F.broadcast(entity_weights(ent, cfg))
    scored = ent.join(weights, "entity_type", "left")
    risk = np_round(F.least(F.lit(100.0), F.col("total_violations") * F.coalesce(F.col("weight"), F.lit(1.0))), 1)
    return scored.select(
        "entity_type", "entity_id",
        F.size("_rules").cast("int").alias("total_unique_hypotheses"),
        F.col("total_violations").cast("bigint").alias("total_violations"),
        F.array_join("_rules", ", ").alias("hypotheses"),
        F.when(F.col("_strong") == 1, "strong").otherwise("raw").alias("max_severity"),
        risk.alias("risk_score"),
        "first_seen", "last_seen",
    )


def risk_level(score: Column) -> Column:
    return F.when(score >= HIGH_RISK, "high").when(score >= MEDIUM_RISK, "medium").otherwise("low")


def report_order() -> list[Column]:
    return [F.desc("risk_score"), F.desc("total_violations"), F.asc("entity_type"), F.asc("entity_id")]


def top_entities(report: DataFrame, entity_types: Iterable[str] = ("card", "validator"),
                 k: int = TOP_PER_TYPE) -> DataFrame:
    """Top ``k`` rows per entity type in report order (plans as a WindowGroupLimit)."""
    w = Window.partitionBy("entity_type").orderBy(*report_order())
    return (
        report.filter(F.col("entity_type").isin(*entity_types))
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= k)
    )


def hypothesis_stats(spark: SparkSession, anomalies: DataFrame, rule_names: Iterable[str]) -> DataFrame:
    """Rows per rule, zero for rules that found nothing (right join to the rule list)."""
    names = spark.createDataFrame([(n, i) for i, n in enumerate(rule_names)], "hypothesis string, rule_order int")
    counts = anomalies.groupBy("hypothesis").agg(F.count(F.lit(1)).alias("rows"))
    return names.join(counts, "hypothesis", "left").select(
        "hypothesis", "rule_order", F.coalesce(F.col("rows"), F.lit(0)).cast("bigint").alias("rows"))


def export_anomalies(anomalies: DataFrame) -> DataFrame:
    """Dashboard anomaly records (ISO dates); written with ``partitionBy('hypothesis')``."""
    return anomalies.select("hypothesis", "entity_type", "entity_id", F.col("anomaly_date").alias("date"),
                            "metric_name", "metric_value", "threshold_value", "severity", "details")


REPORT_SCHEMA = ", ".join([
    "entity_type string", "entity_id string", "total_unique_hypotheses int", "total_violations bigint",
    "hypotheses string", "max_severity string", "risk_score double", "first_seen string", "last_seen string",
])
assert [c.split()[0] for c in REPORT_SCHEMA.split(", ")] == REPORT_COLUMNS
