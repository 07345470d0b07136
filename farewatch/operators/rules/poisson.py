"""H21: is the arrival process at a validator Poisson?

``h21_poisson_deviation`` reproduces the source rule, which is a stub that always emits one
``info`` row. ``h21_ks_exponential`` (H21k) runs the test: the one-sample Kolmogorov-Smirnov
distance between each validator's inter-arrival gaps and an exponential law with the same mean,
with the asymptotic Kolmogorov p-value (approximate, since the mean is estimated)."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farewatch.config import H21Config
from farewatch.functions.ordered import exclusive_prefix_sum, with_previous
from farewatch.functions.time import seconds_between
from farewatch.operators.rules.common import anomalies, details
from farewatch.operators.rules.taps import Taps, taps_of

STUB_NOTE = "statistical test needs 30+ days of data"
KOLMOGOROV_TERMS = 100


def h21_poisson_deviation(tx: DataFrame | Taps, cfg: H21Config = H21Config()) -> DataFrame:
    period = taps_of(tx).period()
    one = taps_of(tx).total()
    return anomalies(one, "H21", "validator", F.lit("all"), period, period, "poisson_p_value", F.lit(0.0),
                     details(note=F.lit(STUB_NOTE)), severity="info", threshold_value=cfg.p_value_threshold)


def kolmogorov_p(lam: Column) -> Column:
    """Q_KS(lambda) = 2 * sum_{k>=1} (-1)^(k-1) exp(-2 k^2 lambda^2), clamped to [0, 1]."""
    ks = F.sequence(F.lit(1), F.lit(KOLMOGOROV_TERMS))
    terms = F.transform(ks, lambda k: F.pow(F.lit(-1.0), k - 1) * F.exp(-2.0 * k * k * lam * lam))
    total = F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x) * 2.0
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)))


def terminal_ks(tx: DataFrame) -> DataFrame:
    """(trm_id, gaps, days, ks_distance, p_value) over whole-second inter-arrival gaps."""
    d = with_previous(tx.select("trm_id", "card", "dt"), ["trm_id"], "dt", ["card"], [])
    gaps = d.filter(F.col("prev_dt").isNotNull()) \
        .select("trm_id", seconds_between("prev_dt", "dt").alias("gap"))
    # the empirical CDF only needs counts per distinct gap value
    counts = gaps.groupBy("trm_id", "gap").agg(F.count(F.lit(1)).alias("c"))
    cum = exclusive_prefix_sum(counts, ["trm_id"], ["gap"], "c", "before")
    per = cum.groupBy("trm_id").agg(F.sum("c").alias("n"), (F.sum(F.col("gap") * F.col("c")) / F.sum("c")).alias("mean_gap"))
    days = tx.groupBy("trm_id").agg(F.countDistinct("date").alias("days"))
    fit = F.when(F.col("mean_gap") > 0, 1 - F.exp(-F.col("gap") / F.col("mean_gap"))).otherwise(F.lit(1.0))
    dist = cum.join(per, "trm_id").withColumn("F", fit).select(
        "trm_id",
        F.greatest((F.col("before") + F.col("c")) / F.col("n") - F.col("F"),
                   F.col("F") - F.col("before") / F.col("n")).alias("d"),
    )
    ks = dist.groupBy("trm_id").agg(F.max("d").alias("ks_distance"))
    sq = F.sqrt(F.col("n"))
    lam = (sq + 0.12 + 0.11 / sq) * F.col("ks_distance")
    return ks.join(per, "trm_id").join(days, "trm_id").select(
        "trm_id", F.col("n").alias("gaps"), "days", "ks_distance", kolmogorov_p(lam).alias("p_value"))


def h21_ks_exponential(tx: DataFrame | Taps, cfg: H21Config = H21Config()) -> DataFrame:
    period = taps_of(tx).period()
    r = terminal_ks(taps_of(tx).tx).filter((F.col("days") >= cfg.min_history_days) & (F.col("p_value") < cfg.p_value_threshold))
    return anomalies(r, "H21k", "validator", F.col("trm_id"), period, period, "poisson_p_value",
                     F.bround("p_value", 6),
                     details(ks_distance=F.format_string("%.6f", F.col("ks_distance")), gaps=F.col("gaps"),
                             days=F.col("days")),
                     severity="raw", threshold_value=cfg.p_value_threshold)


