"""Card labels from the rule report (L1) and label loading (L2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def build_card_labels(tx: DataFrame, report: DataFrame) -> DataFrame:
    """Every distinct card of the de-duplicated transactions; ``is_fraud`` = 1 when the report
    holds a *card* entity with that id (``transaction`` entities do not label)."""
    cards = tx.select(F.col("card").alias("card_id")).distinct()
    fraud = report.filter(F.col("entity_type") == "card").select(F.col("entity_id").alias("card_id")).distinct() \
        .withColumn("is_fraud", F.lit(1))
    return cards.join(fraud, "card_id", "left").select(
        "card_id", F.coalesce(F.col("is_fraud"), F.lit(0)).cast("int").alias("is_fraud"))


def load_labels(labels: DataFrame, card_col: str = "card_id", target_col: str = "is_fraud") -> DataFrame:
    """First row per card (by input position), trimmed id, integer target."""
    d = labels.select(F.trim(F.col(card_col).cast("string")).alias("card_id"),
                      F.col(target_col).cast("int").alias("is_fraud"),
                      F.monotonically_increasing_id().alias("_pos"))
    w = Window.partitionBy("card_id").orderBy("_pos")
    return d.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_pos")
