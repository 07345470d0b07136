"""H2 route flow spikes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farewatch.config import H2Config
from farewatch.functions.numeric import np_round
from farewatch.functions.time import iso_text, seconds_after
from farewatch.operators.rules.common import anomalies, details, layers
from farewatch.operators.rules.taps import Taps, taps_of


def h2_route_spike(tx: DataFrame | Taps, cfg: H2Config = H2Config()) -> DataFrame:
    """As written in the source rule: the flow of each (route, weekday, hour) is compared with
    the median of that same single value, so the ratio is always 1 and nothing fires for
    thresholds above 1. ``min_history_days`` is accepted and, as in the source, not used."""
    keys = ["route_num", "weekday", "hour"]
    flow = taps_of(tx).counts("flows").filter(F.col("route_num").isNotNull()).withColumnRenamed("n", "flow")
    base = flow.groupBy(*keys).agg(F.median("flow").alias("median_flow"))
    r = flow.join(base, keys).withColumn("excess", F.col("flow") / F.col("median_flow"))
    pos = F.col("median_flow") > 0
    hit = layers(r, [
        (pos & (F.col("excess") >= cfg.threshold_raw), "raw", cfg.threshold_raw),
        (pos & (F.col("excess") >= cfg.threshold_strong), "strong", cfg.threshold_strong),
    ])
    label = F.format_string("weekday=%d, hour=%d", F.col("weekday"), F.col("hour"))
    return anomalies(hit, "H2", "route", F.col("route_num"), label, label, "flow_excess", np_round(F.col("excess"), 2),
                     details(flow=F.col("flow"), median=F.bround("median_flow", 0).cast("bigint")))


def h2_route_spike_daily(tx: DataFrame | Taps, cfg: H2Config = H2Config(), min_history_days: int = 0) -> DataFrame:
    """H2d: flow of each (route, date, hour) against the median flow of the same route, weekday
    and hour over all observed dates. Routes seen on fewer than ``min_history_days`` dates are
    skipped (0 = no gate)."""
    tx = taps_of(tx).tx
    cells = tx.filter(F.col("route_num").isNotNull()) \
        .groupBy("route_num", "date", "weekday", "hour").agg(F.count(F.lit(1)).alias("flow"))
    base = cells.groupBy("route_num", "weekday", "hour").agg(F.median("flow").alias("median_flow"))
    r = cells.join(base, ["route_num", "weekday", "hour"]).withColumn("excess", F.col("flow") / F.col("median_flow"))
    if min_history_days:
        days = tx.groupBy("route_num").agg(F.countDistinct("date").alias("days")) \
            .filter(F.col("days") >= min_history_days)
        r = r.join(days.select("route_num"), "route_num", "left_semi")
    pos = F.col("median_flow") > 0
    hit = layers(r, [
        (pos & (F.col("excess") >= cfg.threshold_raw), "raw", cfg.threshold_raw),
        (pos & (F.col("excess") >= cfg.threshold_strong), "strong", cfg.threshold_strong),
    ])
    start = seconds_after(F.col("date").cast("timestamp_ntz"), F.col("hour") * 3600)
    return anomalies(hit, "H2d", "route", F.col("route_num"), iso_text(start), F.col("date").cast("string"),
                     "flow_excess", np_round(F.col("excess"), 2),
                     details(flow=F.col("flow"), median=F.format_string("%.1f", F.col("median_flow"))))
