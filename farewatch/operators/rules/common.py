"""Shared shape of rule output and the one-pass severity layering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farewatch.schemas import ANOMALY_COLUMNS

ANOMALY_SCHEMA = T.StructType([
    T.StructField("hypothesis", T.StringType()),
    T.StructField("entity_type", T.StringType()),
    T.StructField("entity_id", T.StringType()),
    T.StructField("anomaly_date", T.StringType()),
    T.StructField("seen_date", T.StringType()),
    T.StructField("metric_name", T.StringType()),
    T.StructField("metric_value", T.DoubleType()),
    T.StructField("threshold_value", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("details", T.StringType()),
])

JSON_OPTS = {"ignoreNullFields": "false"}


def details(**fields: Column) -> Column:
    """Valid JSON object text from named columns, in the given key order."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), JSON_OPTS)


def threshold_text(value) -> str:
    """Thresholds print the way the configured Python value prints (6, 0.21, 0.0)."""
    return str(value)


def layers(df: DataFrame, levels: Sequence[tuple[Column, str, object]]) -> DataFrame:
    """Emit each input row once per satisfied ``(condition, severity, threshold)`` level in a single
    pass (``explode`` of a filtered array), instead of re-scanning the input per level."""
    hits = F.array(*[
        F.when(cond, F.struct(F.lit(sev).alias("severity"), F.lit(threshold_text(thr)).alias("threshold_value")))
        for cond, sev, thr in levels
    ])
    return (
        df.withColumn("_hit", F.explode(F.filter(hits, lambda h: h.isNotNull())))
        .withColumn("severity", F.col("_hit.severity"))
        .withColumn("threshold_value", F.col("_hit.threshold_value"))
        .drop("_hit")
    )


def anomalies(df: DataFrame, hypothesis: str, entity_type: str | Column, entity_id: Column,
              anomaly_date: Column, seen_date: Column, metric_name: str, metric_value: Column,
              details_col: Column, severity: Column | str | None = None,
              threshold_value: Column | object | None = None) -> DataFrame:
    sev = F.col("severity") if severity is None else (F.lit(severity) if isinstance(severity, str) else severity)
    if threshold_value is None:
        thr = F.col("threshold_value")
    elif isinstance(threshold_value, Column):
        thr = threshold_value
    else:
        thr = F.lit(threshold_text(threshold_value))
    et = F.lit(entity_type) if isinstance(entity_type, str) else entity_type
    return df.select(
        F.lit(hypothesis).alias("hypothesis"),
        et.alias("entity_type"),
        entity_id.cast("string").alias("entity_id"),
        anomaly_date.alias("anomaly_date"),
        seen_date.alias("seen_date"),
        F.lit(metric_name).alias("metric_name"),
        metric_value.cast("double").alias("metric_value"),
        thr.cast("string").alias("threshold_value"),
        sev.alias("severity"),
        details_col.alias("details"),
    )


assert [f.name for f in ANOMALY_SCHEMA.fields] == ANOMALY_COLUMNS
