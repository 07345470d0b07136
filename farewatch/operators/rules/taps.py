"""What the rules read from the transactions, by itself or shared by several rules.

``Taps`` computes each piece from the table when it is asked for. ``SharedTaps`` reads the table
twice for all of them: one pass writes the counts of all grouping sets the rules need, one writes the
few rows that the category rules look at. Both hold the same columns, so rules do not see which
one they got."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farewatch.config import RulesConfig
from farewatch.functions.ordered import written
from farewatch.functions.time import month_text


def category_text() -> Column:
    """The category's text; one that is a number but no whole one goes under its own value."""
    return F.coalesce(F.col("cat_num").cast("string"), F.col("cat").try_cast("double").cast("string"))


class Taps:
    """Pieces of a transaction table, computed from it on demand."""

    SETS = {
        "daily": ("card", "date"),
        "flows": ("route_num", "weekday", "hour"),
        "category_hours": ("cat_num", "hour"),
        "validator_categories": ("trm_id", "cat_num"),
    }

    def __init__(self, tx: DataFrame):
        self.tx = tx

    def counts(self, name: str) -> DataFrame:
        """(keys of the set, n): taps per key combination."""
        return self.tx.groupBy(*self.SETS[name]).agg(F.count(F.lit(1)).alias("n"))

    def seconds(self) -> DataFrame:
        """(card, trm_id, dt, n): taps of a card on a validator in one second. Rules that use it
        in one plan share its exchange; the filter (normalised rows have all three) keeps joins
        above from adding different ones of their own."""
        return self.tx.where("card is not null and trm_id is not null and dt is not null").groupBy("card", "trm_id", "dt").agg(F.count(F.lit(1)).alias("n"))

    def period(self) -> Column:
        """Month of the first tap ('YYYY-MM') as a scalar subquery."""
        return self.tx.agg(month_text(F.min("dt"))).scalar()

    def total(self) -> DataFrame:
        return self.tx.agg(F.count(F.lit(1)).alias("n"))

    def rows(self) -> DataFrame:
        """Rows for the category rules (they filter again)."""
        return self.tx


class SharedTaps(Taps):
    """The same pieces from two written tables."""

    def __init__(self, tx: DataFrame, config: RulesConfig):
        super().__init__(tx)
        self.config = config

    @cached_property
    def _tallies(self) -> DataFrame:
        keys = sorted({k for ks in self.SETS.values() for k in ks})
        sets = [[F.col(k) for k in ks] for ks in self.SETS.values()]
        present = [F.grouping(k).alias(f"_g_{k}") for k in keys]
        t = self.tx.groupingSets(sets, *keys).agg(F.count(F.lit(1)).alias("n"), F.min("dt").alias("first"), *present)
        which = F.coalesce(*[F.when(F.lit(True) if not ks else self._is_set(ks, keys), F.lit(name)) for name, ks in self.SETS.items()])
        return written(t.select(*keys, "n", "first", which.alias("set")), "tallies")

    @staticmethod
    def _is_set(ks: tuple, keys: list) -> Column:
        cond = F.lit(True)
        for k in keys:
            cond &= F.col(f"_g_{k}") == (0 if k in ks else 1)
        return cond

    @cached_property
    def _marked(self) -> DataFrame:
        c = self.config
        school = F.col("cat_num").isin(*c.h7.school_cats, *c.h8.school_cats)
        zero = F.col("cat_num").isin(*c.h17.fraud_zero_cats) & (F.col("summ_num") == 0)
        unknown = category_text().isNotNull() & ~F.coalesce(F.col("cat_num").isin(*c.h19.known_cats), F.lit(False))
        return written(self.tx.where(F.coalesce(school, F.lit(False)) | F.coalesce(zero, F.lit(False)) | unknown), "marked")

    def counts(self, name: str) -> DataFrame:
        return self._tallies.where(F.col("set") == name).select(*self.SETS[name], "n")

    def period(self) -> Column:
        return self._tallies.where(F.col("set") == "validator_categories").agg(month_text(F.min("first"))).scalar()

    def total(self) -> DataFrame:
        return self._tallies.where(F.col("set") == "validator_categories").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"))

    def rows(self) -> DataFrame:
        return self._marked


def taps_of(tx: DataFrame | Taps) -> Taps:
    return tx if isinstance(tx, Taps) else Taps(tx)
