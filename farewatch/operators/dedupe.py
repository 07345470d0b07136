"""Exact and near-duplicate removal (taps of one card on one validator within 2 s).

Semantics: rows sorted by (card, terminal, time, source position); a row is dropped when the
row right before it belongs to the same card and terminal and is at most ``gap`` seconds
earlier. Exact copies are therefore dropped too (gap 0), and a chain 0 s, 2 s, 4 s keeps only
the first tap.

Plan: the previous row of the same (card, terminal) comes from ``with_previous``: one shuffle by
(card, terminal), and by the hour too for pairs with a large share of all taps, so neither a busy
card nor a busy terminal meets in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farewatch.config import NEAR_DUPLICATE_SECONDS
from farewatch.functions.ordered import with_previous
from farewatch.functions.time import seconds_between


def remove_near_duplicates(tx: DataFrame, gap_seconds: int = NEAR_DUPLICATE_SECONDS) -> DataFrame:
    paired = with_previous(tx, ["card", "trm_id"], "dt", ["src_file", "src_row"], [])
    gap = seconds_between("prev_dt", "dt")
    return paired.where(F.col("prev_dt").isNull() | (gap > gap_seconds)).select(*tx.columns)
