"""Order-dependent rules: H4 benefit-card series on a validator at night, H8 repeated
school-card taps. Both as written (one group per validator / card over all time) and as
real sessions (H4s / H8s: maximal runs of consecutive qualifying taps)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farewatch.config import H4Config, H8Config
from farewatch.functions import ordered
from farewatch.functions.ordered import SPARSE_BUCKET_SECONDS, carry_forward_last, first_k, with_previous
from farewatch.functions.time import day_text, iso_text, seconds_between
from farewatch.operators.rules.common import anomalies, details
from farewatch.operators.rules.taps import Taps, taps_of

SAMPLE_CARDS = 5


def _gap_seconds() -> Column:
    return seconds_between("prev_dt", "dt")


def benefit_steps(tx: DataFrame | Taps, cfg: H4Config = H4Config()) -> DataFrame:
    """Every tap of every validator with ``q``: it and its predecessor are benefit taps less
    than ``interval`` apart, at an atypical hour (validator order: time, then card)."""
    d = taps_of(tx).tx.select("trm_id", "card", "dt", "hour", F.col("cat_num").isin(*cfg.benefit_cats).alias("is_benefit"))
    d = with_previous(d, ["trm_id"], "dt", ["card"], ["is_benefit"])
    atypical = (F.col("hour") >= cfg.atypical_hours_start) | (F.col("hour") < cfg.atypical_hours_end)
    q = F.col("is_benefit") & F.col("prev_is_benefit") & (_gap_seconds() < cfg.interval_seconds) & atypical
    return d.withColumn("q", F.coalesce(q, F.lit(False)))


def _h4_rows(groups: DataFrame, group_cols: list[str], cfg: H4Config, name: str) -> DataFrame:
    # qualifying taps only, read twice: written, so the window above them runs once
    groups = ordered.written(groups.select(*group_cols, "card", "dt"), "series")
    stats = groups.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("series_length"), F.min("dt").alias("start_time"))
    cards = first_k(groups, group_cols, "card", ["dt", "card"], SAMPLE_CARDS, "cards")
    hit = stats.filter(F.col("series_length") >= cfg.series_length).join(cards, group_cols, "left")
    return anomalies(hit, name, "validator", F.col("trm_id"), iso_text("start_time"), day_text("start_time"),
                     "benefit_series_length", F.col("series_length"), details(cards=F.col("cards")),
                     severity="strong", threshold_value=cfg.series_length)


def h4_benefit_series(tx: DataFrame | Taps, cfg: H4Config = H4Config()) -> DataFrame:
    """As written in the source rule: its cluster id never changes, so all qualifying taps of a
    validator form one series."""
    return _h4_rows(benefit_steps(tx, cfg).filter("q"), ["trm_id"], cfg, "H4")


def h4_benefit_sessions(tx: DataFrame | Taps, cfg: H4Config = H4Config()) -> DataFrame:
    """H4s: each maximal run of consecutive qualifying taps of a validator is its own series."""
    steps = carry_forward_last(benefit_steps(tx, cfg), ["trm_id"], "dt", ["card"], ~F.col("q"),
                               F.struct("dt", "card"), "session")
    return _h4_rows(steps.filter("q"), ["trm_id", "session"], cfg, "H4s")


def school_steps(tx: DataFrame | Taps, cfg: H8Config = H8Config()) -> DataFrame:
    """School taps of each card with ``q``: same validator as the previous school tap (when
    required) and less than ``interval`` later (card order: time, then validator)."""
    d = taps_of(tx).rows().filter(F.col("cat_num").isin(*cfg.school_cats)).select("card", "trm_id", "dt")
    d = with_previous(d, ["card"], "dt", ["trm_id"], ["trm_id"], bucket_seconds=SPARSE_BUCKET_SECONDS)
    q = _gap_seconds() < cfg.interval_seconds
    if cfg.same_validator_required:
        q = q & (F.col("trm_id") == F.col("prev_trm_id"))
    return d.withColumn("q", F.coalesce(q, F.lit(False)))


def _h8_rows(groups: DataFrame, group_cols: list[str], cfg: H8Config, name: str) -> DataFrame:
    stats = groups.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("consecutive_count"),
        F.min("dt").alias("start_time"),
        F.min_by("trm_id", F.struct("dt", "trm_id")).alias("validator"),
    ).filter(F.col("consecutive_count") >= cfg.min_consecutive)
    return anomalies(stats, name, "card", F.col("card"), iso_text("start_time"), day_text("start_time"),
                     "consecutive_uses", F.col("consecutive_count"), details(validator=F.col("validator")),
                     severity="raw", threshold_value=cfg.min_consecutive)


def h8_school_card_multiple(tx: DataFrame | Taps, cfg: H8Config = H8Config()) -> DataFrame:
    """As written in the source rule: one group per card over all time."""
    return _h8_rows(school_steps(tx, cfg).filter("q"), ["card"], cfg, "H8")


def h8_school_sessions(tx: DataFrame | Taps, cfg: H8Config = H8Config()) -> DataFrame:
    """H8s: each maximal run of consecutive qualifying school taps of a card."""
    steps = carry_forward_last(school_steps(tx, cfg), ["card"], "dt", ["trm_id"], ~F.col("q"),
                               F.struct("dt", "trm_id"), "session", bucket_seconds=SPARSE_BUCKET_SECONDS)
    return _h8_rows(steps.filter("q"), ["card", "session"], cfg, "H8s")
