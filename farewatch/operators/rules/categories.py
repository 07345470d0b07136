"""Category-driven rules: H7 night school rides, H10 peak-hour benefit profile,
H17 zero fares on bank cards, H19 categories outside the known list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farewatch.config import H7Config, H10Config, H17Config, H19Config
from farewatch.functions.ordered import first_k
from farewatch.functions.time import day_text, iso_text
from farewatch.operators.rules.common import anomalies, details
from farewatch.operators.rules.taps import Taps, category_text, taps_of

H19_SAMPLE = 3


def h7_night_school(tx: DataFrame | Taps, cfg: H7Config = H7Config()) -> DataFrame:
    night = taps_of(tx).rows().filter(F.col("cat_num").isin(*cfg.school_cats)
                      & (F.col("hour") >= cfg.night_start_hour) & (F.col("hour") < cfg.night_end_hour))
    return anomalies(night, "H7", "card", F.col("card"), iso_text("dt"), day_text("dt"), "night_trip", F.lit(1),
                     details(validator=F.col("trm_id"), route=F.col("route_num")),
                     severity="strong", threshold_value="night")


def h10_atypical_benefit(tx: DataFrame | Taps, cfg: H10Config = H10Config()) -> DataFrame:
    """Share of peak-hour trips for the school and the senior group (one global aggregate,
    ``stack``-ed into at most two rows)."""
    taps = taps_of(tx)
    peak = F.col("hour").isin(*(cfg.peak_hours_morning + cfg.peak_hours_evening))
    school = F.col("cat_num").isin(*cfg.school_cats)
    senior = F.col("cat_num").isin(*cfg.senior_cats)

    def taps_where(cond):
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("bigint")

    g = taps.counts("category_hours").agg(
        taps_where(school).alias("school_total"), taps_where(school & peak).alias("school_peak"),
        taps_where(senior).alias("senior_total"), taps_where(senior & peak).alias("senior_peak"),
    ).withColumn("period", taps.period())
    rows = g.select("period", F.explode(F.array(
        F.struct(F.lit("school").alias("grp"), F.col("school_total").alias("total"),
                 F.col("school_peak").alias("peak"), F.lit(float(cfg.school_peak_threshold)).alias("thr"),
                 F.lit(str(cfg.school_peak_threshold)).alias("thr_text")),
        F.struct(F.lit("senior").alias("grp"), F.col("senior_total").alias("total"),
                 F.col("senior_peak").alias("peak"), F.lit(float(cfg.senior_peak_threshold)).alias("thr"),
                 F.lit(str(cfg.senior_peak_threshold)).alias("thr_text")),
    )).alias("r")).select("period", "r.*")
    pct = F.when(F.col("total") > 0, F.col("peak") * 100.0 / F.col("total")).otherwise(F.lit(0.0))
    hit = rows.withColumn("pct", pct).filter(F.col("pct") > F.col("thr"))
    return anomalies(hit, "H10", "category", F.col("grp"), F.col("period"), F.col("period"), "peak_hour_share",
                     F.bround("pct", 1), details(total_trips=F.col("total"), peak_trips=F.col("peak")),
                     severity="strong", threshold_value=F.col("thr_text"))


def h17_zero_sum(tx: DataFrame | Taps, cfg: H17Config = H17Config()) -> DataFrame:
    z = taps_of(tx).rows().filter(F.col("cat_num").isin(*cfg.fraud_zero_cats) & (F.col("summ_num") == 0))
    return anomalies(z, "H17", "transaction", F.col("card"), iso_text("dt"), day_text("dt"), "zero_sum", F.lit(1),
                     details(cat=F.col("cat_num"), validator=F.col("trm_id"), route=F.col("route_num")),
                     severity="strong", threshold_value=0)


def h19_unknown_categories(tx: DataFrame | Taps, cfg: H19Config = H19Config()) -> DataFrame:
    unknown = taps_of(tx).rows().withColumn("category", category_text()).filter(
        F.col("category").isNotNull() & ~F.coalesce(F.col("cat_num").isin(*cfg.known_cats), F.lit(False)))
    counts = unknown.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    # first rows in (card, validator, time) order, repeats allowed
    samples = first_k(unknown, ["category"], "card", ["card", "trm_id", "dt"], H19_SAMPLE, "sample_cards",
                      distinct=False)
    rows = counts.join(samples, "category", "left")
    period = taps_of(tx).period()
    return anomalies(rows, "H19", "category", F.col("category"), period, period,
                     "unknown_category", F.col("n"), details(sample_cards=F.col("sample_cards")),
                     severity="raw", threshold_value="not_in_known")
