"""Summary tables behind the dashboard: rule counts, risk histograms, KPI block, action lists.
All are aggregates or projections over the report; none collects rows to the driver."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farewatch.operators.report import HIGH_RISK, MEDIUM_RISK, report_order, risk_level

HIST_LABELS = [f"{lo}-{lo + 10}" for lo in range(0, 100, 10)]
LEVELS = ["low", "medium", "high"]


def rule_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def entities_per_rule(report: DataFrame) -> DataFrame:
    """How many report entities each rule flagged (entities, not hits)."""
    return report.select(F.explode(rule_list(F.col("hypotheses"))).alias("hypothesis")) \
        .groupBy("hypothesis").agg(F.count(F.lit(1)).alias("entities"))


def card_rows(report: DataFrame) -> DataFrame:
    """Card rows, or every row when the report has no cards."""
    has_cards = report.agg(F.count_if(F.col("entity_type") == "card") > 0).scalar()
    return report.filter((F.col("entity_type") == "card") | ~has_cards)


def _with_dim(spark: SparkSession, counts: DataFrame, key: str, labels: list[str]) -> DataFrame:
    dim = spark.createDataFrame([(lab, i) for i, lab in enumerate(labels)], f"{key} string, position int")
    return dim.join(counts, key, "left").select(
        key, "position", F.coalesce(F.col("entities"), F.lit(0)).cast("bigint").alias("entities"))


def risk_histogram(spark: SparkSession, report: DataFrame) -> DataFrame:
    """Ten left-closed buckets of width 10; 100 falls into '90-100'; empty buckets kept."""
    b = F.least(F.floor(F.least(F.greatest(F.col("risk_score"), F.lit(0.0)), F.lit(100.0)) / 10), F.lit(9))
    label = F.concat((b * 10).cast("string"), F.lit("-"), (b * 10 + 10).cast("string"))
    counts = card_rows(report).groupBy(label.alias("risk_bucket")).agg(F.count(F.lit(1)).alias("entities"))
    return _with_dim(spark, counts, "risk_bucket", HIST_LABELS)


def risk_level_counts(spark: SparkSession, report: DataFrame) -> DataFrame:
    counts = card_rows(report).groupBy(risk_level(F.col("risk_score")).alias("risk_level")) \
        .agg(F.count(F.lit(1)).alias("entities"))
    return _with_dim(spark, counts, "risk_level", LEVELS)


def kpi(report: DataFrame, anomalies: DataFrame) -> DataFrame:
    total = anomalies.agg(F.count(F.lit(1))).scalar()
    return report.agg(
        F.count_if(F.col("entity_type") == "card").alias("suspicious_cards"),
        F.count_if(F.col("entity_type") == "validator").alias("suspicious_validators"),
        F.count_if(F.col("risk_score") >= HIGH_RISK).alias("high_risk_entities"),
    ).select(total.alias("total_anomalies"), "*")


def filter_by_rules(report: DataFrame, selected: Iterable[str]) -> DataFrame:
    selected = list(selected)
    if not selected:
        return report
    return report.filter(F.arrays_overlap(rule_list(F.col("hypotheses")), F.array(*[F.lit(s) for s in selected])))


def _short_date(c: Column) -> Column:
    """'YYYY-MM-DD' / 'YYYY-MM' -> 'dd.MM'; other text unchanged; empty -> '—'."""
    d = F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd")), F.try_to_timestamp(c, F.lit("yyyy-MM")))
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("—")) \
        .when(d.isNotNull(), F.date_format(d, "dd.MM")).otherwise(c)


def period_text(first: Column, last: Column) -> Column:
    a, b = _short_date(first), _short_date(last)
    return (
        F.when((a == "—") & (b == "—"), F.lit("—"))
        .when((a == b) | (b == "—"), a)
        .when(a == "—", b)
        .otherwise(F.concat(a, F.lit(" — "), b))
    )


def readable(report: DataFrame) -> DataFrame:
    """Export projection of report rows (anything that is not a card is labelled validator)."""
    return report.select(
        F.when(F.col("entity_type") == "card", "card").otherwise("validator").alias("object_type"),
        F.col("entity_id").alias("object_id"),
        "total_violations", "total_unique_hypotheses", "hypotheses", "risk_score",
        period_text(F.col("first_seen"), F.col("last_seen")).alias("period"),
    )


def action_list(report: DataFrame, kind: str) -> DataFrame:
    """'high' cards (risk >= 70), 'medium' cards (40 <= risk < 70), or all 'validators'."""
    cards = report.filter(F.col("entity_type") == "card")
    if kind == "high":
        rows = cards.filter(F.col("risk_score") >= HIGH_RISK)
    elif kind == "medium":
        rows = cards.filter((F.col("risk_score") >= MEDIUM_RISK) & (F.col("risk_score") < HIGH_RISK))
    elif kind == "validators":
        rows = report.filter(F.col("entity_type") == "validator")
    else:
        raise ValueError(kind)
    return readable(rows)


def ordered(report: DataFrame) -> DataFrame:
    return report.orderBy(*report_order())
