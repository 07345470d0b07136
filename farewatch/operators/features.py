"""Card feature table (63 columns): counts, gaps between consecutive taps, tumbling-bucket peaks,
shares and entropies, daily spans and percentile ranks inside the card's dominant category.

Plan (all keyed by ``card_id``; a hot card is never one task):
  * taps are shuffled once by card, into partitions of about ``TAPS_PER_TASK`` rows, so that the
    counts of a task fit its memory whatever the table size;
  * every categorical and bucket dimension is exploded from the taps into (card, dim, value)
    counts; a second aggregate per (card, dim) gives distinct counts, entropies, top shares,
    bucket peaks, daily spans and the scalar shares; a third folds the dims into one row per card.
    None of them moves a row: the exploded rows, fifteen a tap, never leave their task;
  * cards that would fill half of such a partition are shuffled by card and hour instead, and
    their three aggregates are partial + final on their own keys: a card that makes a third of all
    taps leaves one row per task and (card, dim) after the second partial aggregate;
  * the dominant category has its own count per (card, category): text in an aggregate's state
    would make the large aggregates sort their input;
  * gap family: previous tap per card from ``with_previous`` (time-bucketed, skew-safe).
  * percentile ranks: average-tie rank inside ``dominant_cat`` from per-value counts and one
    range-partitioned prefix sum for all six source columns.
Both families come out clustered by ``card_id`` with one row per card.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farewatch.config import SEGMENT_CATS
from farewatch.functions.ordered import DEFAULT_BUCKET_SECONDS, SPARSE_BUCKET_SECONDS, exclusive_prefix_sum, hot_keys, with_previous, written
from farewatch.functions.time import epoch_seconds, seconds_between

GRAIN = ["card_id", "terminal_id", "route_num", "carrier_id", "cat", "amount_kop", "minute"]
TAPS_PER_TASK = 100_000     # each becomes fifteen counts in memory


def card_grain(rows: DataFrame) -> DataFrame:
    """Taps pre-aggregated to (card, terminal, route, carrier, category, amount, minute) with a
    count and the first / last tap time. The aggregate is partial + final on the whole grain, so a
    card used on many validators stays spread over all tasks."""
    minute = F.floor(epoch_seconds("date") / 60).alias("minute")
    return rows.groupBy(*GRAIN[:-1], minute).agg(
        F.count(F.lit(1)).alias("c"), F.min("date").alias("t0"), F.max("date").alias("t1"))


def clustered_taps(rows: DataFrame) -> list[DataFrame]:
    """Single taps with the columns of ``card_grain``, in one or two frames: cards as a rule, all
    rows of one in one partition; and hot cards, if there are any, by card and hour."""
    minute = F.floor(epoch_seconds("date") / 60).alias("minute")
    taps = rows.select(*GRAIN[:-1], minute, F.lit(1).cast("bigint").alias("c"), F.col("date").alias("t0"), F.col("date").alias("t1"))
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // TAPS_PER_TASK))
    hot = hot_keys(rows, ["card_id"], parts)
    if not hot:
        return [taps.repartition(parts, "card_id")]
    is_hot = F.xxhash64("card_id").isin(hot)
    hour = F.floor(F.col("minute") * 60 / DEFAULT_BUCKET_SECONDS)
    return [taps.where(~is_hot).repartition(parts, "card_id"), taps.where(is_hot).repartition(parts, "card_id", hour)]


def _dominant_cat(rows: DataFrame) -> DataFrame:
    """(card, most frequent category; the least text of equally frequent ones)."""
    n = F.col("_n")
    return rows.groupBy("card_id", "cat").agg(F.count(F.lit(1)).alias("_n")).groupBy("card_id").agg(
        F.min_by("cat", F.struct((-n).alias("neg"), F.col("cat").alias("v"))).alias("dominant_cat"))


def _dims() -> list[tuple[str, Column]]:
    """(name, value) of every categorical or bucket dimension, as text, from grain columns."""
    m = F.col("minute")
    day = F.floor(m / 1440)
    sep = F.lit("\u0001")
    return [
        ("day", day.cast("string")),
        ("h1", F.floor(m / 60).cast("string")),
        ("m1", m.cast("string")),
        ("m5", F.floor(m / 5).cast("string")),
        ("m15", F.floor(m / 15).cast("string")),
        ("trm_m5", F.concat(F.col("terminal_id"), sep, F.floor(m / 5).cast("string"))),
        ("trm_m15", F.concat(F.col("terminal_id"), sep, F.floor(m / 15).cast("string"))),
        ("route", F.col("route_num")),
        ("terminal", F.col("terminal_id")),
        ("carrier", F.col("carrier_id")),
        ("trm_route", F.concat(F.col("terminal_id"), sep, F.col("route_num"))),
        ("hour", (F.floor(m / 60) % 24).cast("string")),
        ("weekday", F.pmod(day + 3, F.lit(7)).cast("string")),  # 1970-01-01 was a Thursday; Monday is 0
        ("cat", F.col("cat")),
        ("amount", F.col("amount_kop").cast("string")),
    ]


# fixed values: source column and percentile column, the output contract
PERCENTILE_SOURCES = {
    "tx_count": "tx_count_percentile_in_cat",
    "unique_routes": "unique_routes_percentile_in_cat",
    "unique_terminals": "unique_terminals_percentile_in_cat",
    "min_gap_sec": "min_gap_percentile_in_cat",
    "same_terminal_gap_le_5m_count": "same_terminal_burst_percentile_in_cat",
    "night_share": "night_share_percentile_in_cat",
}

# fixed values: the column names and order of the feature table, the output contract
FEATURE_COLUMNS = [
    "card_id", "tx_count", "active_days", "unique_routes", "unique_terminals", "unique_carriers", "unique_cats",
    "mean_amount", "sum_amount", "unique_amounts", "zero_amount_share", "night_share", "weekend_share",
    "active_hours_count", "active_weekdays_count", "tx_per_active_day",
    "min_gap_sec", "median_gap_sec", "gap_le_1m_count", "gap_le_5m_count", "gap_le_15m_count",
    "same_terminal_gap_le_1m_count", "same_terminal_gap_le_5m_count", "same_terminal_gap_le_15m_count",
    "diff_terminal_gap_le_1m_count", "diff_terminal_gap_le_3m_count", "diff_terminal_gap_le_5m_count",
    "diff_route_gap_le_1m_count", "diff_route_gap_le_3m_count", "diff_route_gap_le_5m_count",
    "terminal_switch_count", "route_switch_count", "min_gap_diff_terminal_sec", "min_gap_diff_route_sec",
    "max_tx_per_day", "max_tx_per_hour", "max_tx_per_1m", "max_tx_per_5m", "max_tx_per_15m",
    "max_same_terminal_tx_5m", "max_same_terminal_tx_15m",
    "top_terminal_share", "top_route_share", "top_terminal_route_share",
    "route_entropy", "terminal_entropy", "carrier_entropy", "hour_entropy", "dominant_cat",
    "daily_span_hours_mean", "daily_span_hours_max", "cat_201_share", "cat_203_share", "cat_204_share",
    "terminal_switch_rate", "route_switch_rate", *PERCENTILE_SOURCES.values(), "segment",
]
# the 60 numeric model inputs (everything but the key, dominant_cat and segment)
NUMERIC_FEATURES = [c for c in FEATURE_COLUMNS if c not in ("card_id", "dominant_cat", "segment")]


def feature_rows(tx_norm: DataFrame) -> DataFrame:
    """Feature-loader view of normalised (not de-duplicated) rows: missing text -> '', category
    without leading zeros, amount in kopecks (unparseable -> 0), input position for ties."""
    d = tx_norm.select(
        F.col("card").alias("card_id"),
        F.col("dt").alias("date"),
        F.coalesce("trm_id", F.lit("")).alias("terminal_id"),
        F.coalesce("route_num", F.lit("")).alias("route_num"),
        F.coalesce("trc_id", F.lit("")).alias("carrier_id"),
        F.regexp_replace(F.coalesce("cat", F.lit("")), "^0+", "").alias("cat"),
        F.coalesce("summ_num", F.lit(0.0)).alias("amount_kop"),
        "src_file", "src_row",
    )
    return d.withColumn("day", F.to_date("date")).withColumn("hour", F.hour("date")) \
        .withColumn("weekday", F.weekday("date"))


# fixed values: the raw columns the feature loader reads, by their exact (trimmed) header
FEATURE_SOURCE_COLUMNS = {"DATE": "date", "TRM_ID": "terminal_id", "ROUTE_NUM": "route_num", "TRC_ID": "carrier_id",
                          "CAT": "cat", "SUMM": "amount_raw", "CARD": "card_id"}


def feature_rows_raw(raw: DataFrame) -> DataFrame:
    """The feature loader's own view of raw text rows (it differs from ``normalize``): headers
    are trimmed but not upper-cased, every missing value becomes '' and every value is
    stripped, no row is de-duplicated, only unparseable dates drop a row (a blank card or
    validator stays as ''), leading zeros leave the category and an unparseable amount is 0."""
    from farewatch.operators.normalize import LINEAGE, parse_date, strip_text

    # header names are trimmed; unlike the source loader (which fails unless they are exactly
    # upper-case) they are matched case-insensitively
    by_upper = {c.strip().upper(): c for c in raw.columns if c not in LINEAGE}
    df = raw.select(*[F.col(f"`{by_upper[k]}`").alias(k) for k in FEATURE_SOURCE_COLUMNS if k in by_upper],
                    *[c for c in raw.columns if c in LINEAGE])
    missing = [c for c in FEATURE_SOURCE_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"feature loader needs columns: {', '.join(missing)}")
    text = {c: strip_text(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in FEATURE_SOURCE_COLUMNS}
    amount = text["SUMM"].try_cast("double")
    d = df.select(
        text["CARD"].alias("card_id"),
        parse_date(text["DATE"]).alias("date"),
        text["TRM_ID"].alias("terminal_id"),
        text["ROUTE_NUM"].alias("route_num"),
        text["TRC_ID"].alias("carrier_id"),
        F.regexp_replace(text["CAT"], "^0+", "").alias("cat"),
        F.coalesce(F.when(~F.isnan(amount), amount), F.lit(0.0)).alias("amount_kop"),      # kopecks, fractions kept
        (F.col("_src_file") if "_src_file" in df.columns else F.input_file_name()).cast("string").alias("src_file"),
        (F.col("_src_row") if "_src_row" in df.columns else F.monotonically_increasing_id()).cast("bigint").alias("src_row"),
    ).filter(F.col("date").isNotNull())
    return d.withColumn("day", F.to_date("date")).withColumn("hour", F.hour("date")) \
        .withColumn("weekday", F.weekday("date"))


def _dim_features(grain: DataFrame) -> DataFrame:
    dims = _dims()
    pairs = grain.select("card_id", "c", "t0", "t1", F.explode(F.array(*[
        F.struct(F.lit(n).alias("dim"), v.alias("value")) for n, v in dims])).alias("p")) \
        .select("card_id", "c", "t0", "t1", "p.dim", "p.value")
    level1 = pairs.groupBy("card_id", "dim", "value").agg(
        F.sum("c").alias("c"), F.min("t0").alias("t0"), F.max("t1").alias("t1"))
    c = F.col("c")
    dim, value = F.col("dim"), F.col("value")

    def csum(cond: Column) -> Column:
        return F.sum(F.when(cond, c).otherwise(F.lit(0)))

    level2 = level1.groupBy("card_id", "dim").agg(
        # scalar measures are conditional sums over one dim's value counts
        F.sum(F.when(dim == "amount", value.cast("double") * c)).alias("amount_sum"),
        csum((dim == "amount") & (value == "0.0")).alias("zero_c"),
        csum((dim == "hour") & value.isin("0", "1", "2", "3", "4")).alias("night_c"),
        csum((dim == "weekday") & value.isin("5", "6")).alias("weekend_c"),
        *[csum((dim == "cat") & (value == cat)).alias(f"cat_{cat}_c") for cat in SEGMENT_CATS],
        F.count(F.lit(1)).alias("distinct"),
        F.sum("c").alias("n"),
        F.max("c").alias("max_c"),
        F.sum(c * F.log2(c)).alias("clogc"),
        # integer seconds summed first: one final division, independent of summation order
        (F.sum(seconds_between("t0", "t1")) / F.count(F.lit(1)) / 3600.0).alias("span_mean"),
        (F.max(seconds_between("t0", "t1")) / 3600.0).alias("span_max"),
    )
    entropy = F.log2(F.col("n")) - F.col("clogc") / F.col("n")

    def pick(dim: str, expr: Column) -> Column:
        return F.max(F.when(F.col("dim") == dim, expr))

    n = pick("day", F.col("n"))
    return level2.groupBy("card_id").agg(
        n.alias("tx_count"),
        (pick("amount", F.col("amount_sum")) / n / 100.0).alias("mean_amount"),
        (pick("amount", F.col("amount_sum")) / 100.0).alias("sum_amount"),
        (pick("amount", F.col("zero_c")) / n).alias("zero_amount_share"),
        (pick("hour", F.col("night_c")) / n).alias("night_share"),
        (pick("weekday", F.col("weekend_c")) / n).alias("weekend_share"),
        *[(pick("cat", F.col(f"cat_{cat}_c")) / n).alias(f"cat_{cat}_share") for cat in SEGMENT_CATS],
        pick("day", F.col("distinct")).alias("active_days"),
        pick("route", F.col("distinct")).alias("unique_routes"),
        pick("terminal", F.col("distinct")).alias("unique_terminals"),
        pick("carrier", F.col("distinct")).alias("unique_carriers"),
        pick("cat", F.col("distinct")).alias("unique_cats"),
        pick("amount", F.col("distinct")).alias("unique_amounts"),
        pick("hour", F.col("distinct")).alias("active_hours_count"),
        pick("weekday", F.col("distinct")).alias("active_weekdays_count"),
        pick("day", F.col("max_c")).alias("max_tx_per_day"),
        pick("h1", F.col("max_c")).alias("max_tx_per_hour"),
        pick("m1", F.col("max_c")).alias("max_tx_per_1m"),
        pick("m5", F.col("max_c")).alias("max_tx_per_5m"),
        pick("m15", F.col("max_c")).alias("max_tx_per_15m"),
        pick("trm_m5", F.col("max_c")).alias("max_same_terminal_tx_5m"),
        pick("trm_m15", F.col("max_c")).alias("max_same_terminal_tx_15m"),
        pick("terminal", F.col("max_c") / F.col("n")).alias("top_terminal_share"),
        pick("route", F.col("max_c") / F.col("n")).alias("top_route_share"),
        pick("trm_route", F.col("max_c") / F.col("n")).alias("top_terminal_route_share"),
        pick("route", entropy).alias("route_entropy"),
        pick("terminal", entropy).alias("terminal_entropy"),
        pick("carrier", entropy).alias("carrier_entropy"),
        pick("hour", entropy).alias("hour_entropy"),
        pick("day", F.col("span_mean")).alias("daily_span_hours_mean"),
        pick("day", F.col("span_max")).alias("daily_span_hours_max"),
    )


def _gap_features(rows: DataFrame) -> DataFrame:
    d = with_previous(rows.select("card_id", "date", "terminal_id", "route_num", "src_file", "src_row"),
                      ["card_id"], "date", ["src_file", "src_row"], ["terminal_id", "route_num"],
                      bucket_seconds=SPARSE_BUCKET_SECONDS)
    gap = seconds_between("prev_date", "date")
    has_prev = F.col("prev_date").isNotNull()
    same_t = F.coalesce(F.col("terminal_id") == F.col("prev_terminal_id"), F.lit(False))
    diff_t = has_prev & ~same_t
    diff_r = has_prev & (F.col("route_num") != F.col("prev_route_num"))
    d = d.select("card_id", gap.alias("gap"), has_prev.alias("has_prev"), same_t.alias("same_t"),
                 diff_t.alias("diff_t"), diff_r.alias("diff_r"))
    g, st, dt_, dr = F.col("gap"), F.col("same_t"), F.col("diff_t"), F.col("diff_r")

    def cnt(cond: Column) -> Column:
        return F.count_if(F.col("has_prev") & cond)

    return d.groupBy("card_id").agg(
        F.min(g).alias("min_gap_sec"),
        F.median(g).alias("median_gap_sec"),
        cnt(g <= 60).alias("gap_le_1m_count"),
        cnt(g <= 300).alias("gap_le_5m_count"),
        cnt(g <= 900).alias("gap_le_15m_count"),
        cnt(st & (g <= 60)).alias("same_terminal_gap_le_1m_count"),
        cnt(st & (g <= 300)).alias("same_terminal_gap_le_5m_count"),
        cnt(st & (g <= 900)).alias("same_terminal_gap_le_15m_count"),
        cnt(dt_ & (g <= 60)).alias("diff_terminal_gap_le_1m_count"),
        cnt(dt_ & (g <= 180)).alias("diff_terminal_gap_le_3m_count"),
        cnt(dt_ & (g <= 300)).alias("diff_terminal_gap_le_5m_count"),
        cnt(dr & (g <= 60)).alias("diff_route_gap_le_1m_count"),
        cnt(dr & (g <= 180)).alias("diff_route_gap_le_3m_count"),
        cnt(dr & (g <= 300)).alias("diff_route_gap_le_5m_count"),
        cnt(dt_).alias("terminal_switch_count"),
        cnt(dr).alias("route_switch_count"),
        F.min(F.when(dt_, g)).alias("min_gap_diff_terminal_sec"),
        F.min(F.when(dr, g)).alias("min_gap_diff_route_sec"),
    )


def _percentile_features(features: DataFrame) -> DataFrame:
    """Average-tie percentile rank of six columns inside ``dominant_cat`` (pandas
    ``rank(pct=True)``), all six through one per-value count table and one prefix sum."""
    long = features.select("card_id", "dominant_cat", F.explode(F.array(*[
        F.struct(F.lit(src).alias("feature"), F.col(src).cast("double").alias("v"))
        for src in PERCENTILE_SOURCES])).alias("p")).select("card_id", "dominant_cat", "p.feature", "p.v")
    counts = long.groupBy("feature", "dominant_cat", "v").agg(F.count(F.lit(1)).alias("_eq"))
    ranked = exclusive_prefix_sum(counts, ["feature", "dominant_cat"], ["v"], "_eq", "_lt")
    sizes = counts.groupBy("feature", "dominant_cat").agg(F.sum("_eq").alias("_n"))
    table = ranked.join(sizes, ["feature", "dominant_cat"]).select(
        "feature", "dominant_cat", "v", ((F.col("_lt") + (F.col("_eq") + 1) / 2.0) / F.col("_n")).alias("pct"))
    per_card = long.join(table, ["feature", "dominant_cat", "v"], "left").groupBy("card_id").agg(*[
        F.max(F.when(F.col("feature") == src, F.col("pct"))).alias(out) for src, out in PERCENTILE_SOURCES.items()])
    return features.join(per_card, "card_id", "left")


def build_features(tx_norm: DataFrame | None, labels: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """One row per labelled card with ``FEATURE_COLUMNS``, from the normalised table or from
    ready feature rows (``feature_rows_raw``)."""
    rows = (rows if rows is not None else feature_rows(tx_norm)).join(labels.select("card_id"), "card_id", "left_semi")
    f = reduce(DataFrame.unionByName, map(_dim_features, clustered_taps(rows)))
    f = f.join(_dominant_cat(rows), "card_id", "left").join(_gap_features(rows), "card_id", "left")
    f = f.withColumn("tx_per_active_day", F.col("tx_count") / F.greatest(F.col("active_days"), F.lit(1)))
    numeric = [c for c in NUMERIC_FEATURES if c not in PERCENTILE_SOURCES.values()
               and c not in ("terminal_switch_rate", "route_switch_rate")]
    # null / NaN / +-inf -> 0 for every numeric column (one-trip cards have no gaps)
    f = f.select("card_id", "dominant_cat", *[
        F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | F.col(c).cast("double").isin(
            float("inf"), float("-inf")), F.lit(0)).otherwise(F.col(c)).alias(c) for c in numeric])
    denom = F.greatest(F.col("tx_count") - 1, F.lit(1))
    f = f.withColumn("terminal_switch_rate", F.col("terminal_switch_count") / denom) \
        .withColumn("route_switch_rate", F.col("route_switch_count") / denom)
    # one row per card, read by the ranks and by the final join
    f = _percentile_features(written(f, "card-features"))
    f = f.withColumn("segment", F.when(F.col("dominant_cat").isin(*SEGMENT_CATS), F.col("dominant_cat"))
                     .otherwise(F.lit("other")))
    for out in PERCENTILE_SOURCES.values():
        f = f.withColumn(out, F.coalesce(F.col(out), F.lit(0.0)))
    return f.select(*FEATURE_COLUMNS)


# column families (each also a registered query)
FAMILIES = {
    "feat_base": ["card_id", "tx_count", "active_days", "unique_routes", "unique_terminals", "unique_carriers",
                  "unique_cats", "mean_amount", "sum_amount", "unique_amounts", "zero_amount_share", "night_share",
                  "weekend_share", "active_hours_count", "active_weekdays_count", "tx_per_active_day",
                  "cat_201_share", "cat_203_share", "cat_204_share"],
    "feat_gaps": ["card_id", "min_gap_sec", "median_gap_sec", "gap_le_1m_count", "gap_le_5m_count",
                  "gap_le_15m_count", "same_terminal_gap_le_1m_count", "same_terminal_gap_le_5m_count",
                  "same_terminal_gap_le_15m_count", "diff_terminal_gap_le_1m_count", "diff_terminal_gap_le_3m_count",
                  "diff_terminal_gap_le_5m_count", "diff_route_gap_le_1m_count", "diff_route_gap_le_3m_count",
                  "diff_route_gap_le_5m_count", "terminal_switch_count", "route_switch_count",
                  "min_gap_diff_terminal_sec", "min_gap_diff_route_sec", "terminal_switch_rate", "route_switch_rate"],
    "feat_buckets": ["card_id", "max_tx_per_day", "max_tx_per_hour", "max_tx_per_1m", "max_tx_per_5m",
                     "max_tx_per_15m", "max_same_terminal_tx_5m", "max_same_terminal_tx_15m"],
    "feat_shares_entropy": ["card_id", "top_terminal_share", "top_route_share", "top_terminal_route_share",
                            "route_entropy", "terminal_entropy", "carrier_entropy", "hour_entropy", "dominant_cat",
                            "segment"],
    "feat_span": ["card_id", "daily_span_hours_mean", "daily_span_hours_max"],
    "feat_percentiles": ["card_id", "dominant_cat", *PERCENTILE_SOURCES.values()],
    "features_full": FEATURE_COLUMNS,
}
DOUBLE_FEATURES = {
    "mean_amount", "sum_amount", "zero_amount_share", "night_share", "weekend_share", "tx_per_active_day",
    "median_gap_sec", "top_terminal_share", "top_route_share", "top_terminal_route_share", "route_entropy",
    "terminal_entropy", "carrier_entropy", "hour_entropy", "daily_span_hours_mean", "daily_span_hours_max",
    "cat_201_share", "cat_203_share", "cat_204_share", "terminal_switch_rate", "route_switch_rate",
    *PERCENTILE_SOURCES.values(),
}
