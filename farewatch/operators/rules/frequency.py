"""H1 trips per card-day, service cards, H20 same-second duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farewatch.config import H1Config, H20Config
from farewatch.functions.time import day_text, iso_text
from farewatch.operators.rules.common import anomalies, details, layers
from farewatch.operators.rules.taps import Taps, taps_of


def daily_trips(tx: DataFrame | Taps) -> DataFrame:
    return taps_of(tx).counts("daily")


def service_cards(tx: DataFrame | Taps, threshold: int = 12, distinct: bool = True) -> DataFrame:
    """Cards with more than ``threshold`` taps on any day (staff / service cards). Anti-joins
    pass ``distinct=False``: repeats do not change an anti-join and the extra shuffle is saved."""
    days = daily_trips(tx).filter(F.col("n") > threshold).select("card")
    return days.distinct() if distinct else days


def h1_high_frequency(tx: DataFrame | Taps, cfg: H1Config = H1Config()) -> DataFrame:
    daily = daily_trips(tx)
    if cfg.exclude_service_cards:
        # per-card max over that card's days: one row per day, so a hot card stays small
        daily = daily.withColumn("_mx", F.max("n").over(Window.partitionBy("card"))) \
            .filter(F.col("_mx") <= cfg.service_card_threshold)
    hit = layers(daily, [
        (F.col("n") >= cfg.threshold_raw, "raw", cfg.threshold_raw),
        (F.col("n") >= cfg.threshold_strong, "strong", cfg.threshold_strong),
    ])
    return anomalies(hit, "H1", "card", F.col("card"), day_text("date"), day_text("date"),
                     "trips_per_day", F.col("n"), details(card=F.col("card")))


def h20_duplicates(tx: DataFrame | Taps, cfg: H20Config = H20Config()) -> DataFrame:
    """Same card, validator and second at least ``single_threshold`` times; one row per group,
    strong when at least ``mass_threshold``."""
    g = taps_of(tx).seconds().filter(F.col("n") >= cfg.single_threshold)
    strong = F.col("n") >= cfg.mass_threshold
    return anomalies(
        g, "H20", "transaction", F.col("card"), iso_text("dt"), day_text("dt"), "duplicate_count", F.col("n"),
        details(validator=F.col("trm_id")),
        severity=F.when(strong, "strong").otherwise("raw"),
        threshold_value=F.when(strong, str(cfg.mass_threshold)).otherwise(str(cfg.single_threshold)),
    )
