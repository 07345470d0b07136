"""H11 / H12: share of cash taps per validator, too high or too low."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farewatch.config import H11Config, H12Config
from farewatch.functions.numeric import np_round
from farewatch.operators.rules.common import anomalies, details, layers
from farewatch.operators.rules.taps import Taps, taps_of


def terminal_cash(tx: DataFrame | Taps, cash_cat: int, min_transactions: int) -> DataFrame:
    """(trm_id, total_tx, cash_tx, cash_share) for validators with at least ``min_transactions``."""
    return (
        taps_of(tx).counts("validator_categories").groupBy("trm_id")
        .agg(F.sum("n").alias("total_tx"), F.coalesce(F.sum(F.when(F.col("cat_num") == cash_cat, F.col("n"))), F.lit(0)).alias("cash_tx"))
        .filter(F.col("total_tx") >= min_transactions)
        .withColumn("cash_share", F.col("cash_tx") / F.col("total_tx"))
    )


def _cash_rows(tx: DataFrame | Taps, stats: DataFrame, name: str, levels) -> DataFrame:
    period = taps_of(tx).period()
    return anomalies(layers(stats, levels), name, "validator", F.col("trm_id"), period, period, "cash_share",
                     np_round(F.col("cash_share"), 3), details(total_tx=F.col("total_tx")))


def h11_high_cash(tx: DataFrame | Taps, cfg: H11Config = H11Config()) -> DataFrame:
    s = terminal_cash(tx, cfg.cash_cat, cfg.min_transactions)
    share = F.col("cash_share")
    return _cash_rows(tx, s, "H11", [(share >= cfg.threshold_raw, "raw", cfg.threshold_raw),
                                     (share >= cfg.threshold_strong, "strong", cfg.threshold_strong)])


def h12_low_cash(tx: DataFrame | Taps, cfg: H12Config = H12Config()) -> DataFrame:
    s = terminal_cash(tx, cfg.cash_cat, cfg.min_transactions)
    share = F.col("cash_share")
    return _cash_rows(tx, s, "H12", [(share <= cfg.threshold_raw, "raw", cfg.threshold_raw),
                                     (share <= cfg.threshold_strong, "strong", cfg.threshold_strong)])
