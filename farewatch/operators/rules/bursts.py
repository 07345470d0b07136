"""H3: many taps by different cards on one validator inside one tumbling window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farewatch.config import H3Config
from farewatch.functions.ordered import first_k
from farewatch.functions.time import day_text, floor_to_seconds, iso_text
from farewatch.operators.rules.common import anomalies, details, layers
from farewatch.operators.rules.frequency import service_cards
from farewatch.operators.rules.taps import Taps, taps_of

SAMPLE_CARDS = 5
WINDOW_KEYS = ["trm_id", "time_window"]


def burst_windows(tx: DataFrame | Taps, cfg: H3Config = H3Config()) -> DataFrame:
    """Per (validator, window) with enough taps and cards: tx_count, unique_cards and the first
    five cards in card order. Counts come from a (validator, window, card) pre-aggregate, so a
    crowded window never materialises as one list."""
    taps = taps_of(tx)
    per_card = taps.seconds()
    if cfg.exclude_service_cards:
        # plain join: AQE broadcasts the service-card set when it is small at run time, and
        # splits a skewed card partition otherwise
        per_card = per_card.join(service_cards(taps, cfg.service_card_threshold, distinct=False), "card", "left_anti")
    if cfg.time_window_seconds == 1:
        per_card = per_card.withColumnRenamed("dt", "time_window")        # taps are on whole seconds
    else:
        per_card = per_card.groupBy("trm_id", floor_to_seconds("dt", cfg.time_window_seconds).alias("time_window"), "card") \
            .agg(F.sum("n").alias("n"))
    return bursts_of(per_card, cfg)


def bursts_of(per_card: DataFrame, cfg: H3Config = H3Config()) -> DataFrame:
    """Bursts among (validator, window, card) counts."""
    stats = per_card.groupBy(*WINDOW_KEYS).agg(F.sum("n").alias("tx_count"), F.count(F.lit(1)).alias("unique_cards"))
    bursts = stats.filter((F.col("tx_count") >= cfg.threshold_raw) & (F.col("unique_cards") >= cfg.min_cards_in_burst))
    samples = first_k(per_card.join(bursts.select(*WINDOW_KEYS), WINDOW_KEYS, "left_semi"),
                      WINDOW_KEYS, "card", ["card"], SAMPLE_CARDS, "sample_cards", distinct=False)
    return bursts.join(samples, WINDOW_KEYS, "left")


def h3_bursts(tx: DataFrame | Taps, cfg: H3Config = H3Config()) -> DataFrame:
    hit = layers(burst_windows(tx, cfg), [
        (F.lit(True), "raw", cfg.threshold_raw),
        (F.col("tx_count") >= cfg.threshold_strong, "strong", cfg.threshold_strong),
    ])
    return anomalies(hit, "H3", "validator", F.col("trm_id"), iso_text("time_window"), day_text("time_window"),
                     "tx_per_sec", F.col("tx_count"),
                     details(unique_cards=F.col("unique_cards"), sample_cards=F.col("sample_cards")))
