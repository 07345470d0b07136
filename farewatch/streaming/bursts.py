"""X1: the H3 burst rule as a Structured Streaming query.

Taps arrive as files of events; each micro-batch is mapped to transactions with the batch
mapping, then two chained stateful aggregations (Spark >= 3.5 allows several in append mode)
count taps per (validator, 1 s window, card) and fold them per (validator, window). The
watermark closes a window once event time has moved ``watermark`` past it, so late taps within
that delay are still counted and state stays bounded. Exact distinct counts are not allowed in
streaming aggregations, hence the card-level first stage.

``run_burst_stream`` publishes the windows by themselves. ``run_burst_rule_stream`` is the whole rule,
service cards and sample cards included: one stream publishes the closed (validator, window, card)
counts, another the days on which a card exceeds the service limit, and the bursts are what both
tables say together. A card's earlier bursts are thus withdrawn from the result as soon as one of its
days is published as a service day, without any stream rewriting what it has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farewatch.config import H3Config
from farewatch.functions.time import from_epoch_seconds, instant
from farewatch.operators.rules.bursts import bursts_of
from farewatch.sources.fixture import read_table
from farewatch.streaming.replay import TxRows, open_rows, run_to_table, taps

EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    return (spark.readStream.schema(EVENTS_SCHEMA).option("pathGlobFilter", "events*.parquet")
            .option("maxFilesPerTrigger", files_per_trigger).parquet(sf_dir))


def burst_stream(events: DataFrame | TxRows, cfg: H3Config = H3Config(), watermark: str = "10 seconds") -> DataFrame:
    tx = taps(events).select("trm_id", "card", instant("dt").alias("et"))
    per_card = (
        tx.withWatermark("et", watermark)
        .groupBy("trm_id", F.window("et", f"{cfg.time_window_seconds} seconds").alias("w"), "card")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    per_window = per_card.groupBy("trm_id", "w").agg(
        F.sum("n").alias("tx_count"), F.count(F.lit(1)).alias("unique_cards"))
    return per_window.filter((F.col("tx_count") >= cfg.threshold_raw)
                             & (F.col("unique_cards") >= cfg.min_cards_in_burst)) \
        .select("trm_id", from_epoch_seconds(F.unix_seconds("w.start")).alias("time_window"), "tx_count", "unique_cards")


def card_window_stream(events: DataFrame | TxRows, cfg: H3Config = H3Config(), watermark: str = "10 seconds") -> DataFrame:
    """(trm_id, time_window, card, n) of closed windows."""
    tx = taps(events).select("trm_id", "card", instant("dt").alias("et"))
    return tx.withWatermark("et", watermark) \
        .groupBy("trm_id", F.window("et", f"{cfg.time_window_seconds} seconds").alias("w"), "card") \
        .agg(F.count(F.lit(1)).alias("n")) \
        .select("trm_id", from_epoch_seconds(F.unix_seconds("w.start")).alias("time_window"), "card", "n")


def service_day_stream(events: DataFrame | TxRows, cfg: H3Config = H3Config(), watermark: str = "10 seconds") -> DataFrame:
    """(card, day as epoch second, n) of closed days with more taps than the service limit."""
    tx = taps(events).select("card", instant("dt").alias("et"))
    days = tx.withWatermark("et", watermark).groupBy("card", F.window("et", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return days.where(F.col("n") > cfg.service_card_threshold).select("card", F.unix_seconds("w.start").alias("day"), "n")


def current_bursts(card_windows: DataFrame, service_days: DataFrame, cfg: H3Config = H3Config()) -> DataFrame:
    """The rule's bursts as the two published tables have them now, with their first five cards."""
    counted = card_windows
    if cfg.exclude_service_cards:
        counted = counted.join(service_days.select("card"), "card", "left_anti")
    return bursts_of(counted, cfg)


CARD_WINDOW_SCHEMA = "trm_id string, time_window timestamp_ntz, card string, n bigint"
SERVICE_DAY_SCHEMA = "card string, day bigint, n bigint"
DAY_SECONDS = 86400


def run_burst_rule_stream(spark: SparkSession, sf_dir: str, name: str, cfg: H3Config = H3Config(), delay_seconds: int = 10) -> DataFrame:
    """Both streams over a whole folder, what is open at its end completed from its own taps."""
    delay, events = f"{delay_seconds} seconds", read_table(spark, sf_dir, "events")
    windows = run_to_table(spark, card_window_stream(event_stream(spark, sf_dir), cfg, delay), f"{name}-windows", CARD_WINDOW_SCHEMA) \
        .unionByName(card_window_stream(open_rows(events, cfg.time_window_seconds, delay_seconds), cfg, delay))
    days = run_to_table(spark, service_day_stream(event_stream(spark, sf_dir), cfg, delay), f"{name}-days", SERVICE_DAY_SCHEMA) \
        .unionByName(service_day_stream(open_rows(events, DAY_SECONDS, delay_seconds), cfg, delay))
    return current_bursts(windows, days, cfg)


BURST_SCHEMA = "trm_id string, time_window timestamp_ntz, tx_count bigint, unique_cards bigint"


def run_burst_stream(spark: SparkSession, sf_dir: str, name: str = "stream_bursts",
                     cfg: H3Config = H3Config(), delay_seconds: int = 10) -> DataFrame:
    """Replay the folder with ``availableNow`` into a Parquet sink (exactly-once through the
    checkpoint), then add the windows still open when the input ended, from a batch pass over
    the taps of those windows."""
    closed = run_to_table(spark, burst_stream(event_stream(spark, sf_dir), cfg, f"{delay_seconds} seconds"), name, BURST_SCHEMA)
    events = read_table(spark, sf_dir, "events")
    rest = open_rows(events, cfg.time_window_seconds, delay_seconds)
    return closed.unionByName(burst_stream(rest, cfg, f"{delay_seconds} seconds"))
