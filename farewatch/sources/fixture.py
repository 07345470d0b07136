"""Transaction table derived from the driver's ``events`` table.

The mapping is deterministic so that Spark and the SQL oracle build the same rows: plain events
become one tap each; every 40th / 41st / 43rd event is replicated into a burst across cards, a
same-second duplicate run, or a school-card series 20 s apart. ``(event_id, copy)`` stands in for
the (file, row) position of a raw dump.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farewatch.functions.time import seconds_after

# fixed values of the mapping: kind -> copies
BURST_EVERY, DUP_EVERY, SERIES_EVERY = 40, 41, 43
BURST_COPIES, DUP_COPIES, SERIES_COPIES = 6, 5, 8
SERIES_STEP_SECONDS = 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _category(kind: Column, event_type: Column, k: Column) -> Column:
    return (
        F.when(kind == "series", F.lit(203))
        .when(event_type == "error", F.when(k < 5, 999).otherwise(151))
        .when(event_type == "view", F.when((k % 10).isin(5, 7), 151).otherwise(201))
        .when(event_type == "click", F.when(k % 10 == 5, 151).otherwise(203))
        .when(event_type == "signup", F.lit(207))
        .when(event_type == "purchase", F.lit(91))
    )


def _replicated(ev: DataFrame) -> DataFrame:
    ev = ev.select("event_id", "ts", "user_id", "event_type", "value", "props")
    kind = (
        F.when(F.col("event_id") % BURST_EVERY == 0, "burst")
        .when(F.col("event_id") % DUP_EVERY == 0, "dup")
        .when(F.col("event_id") % SERIES_EVERY == 0, "series")
        .otherwise("plain")
    )
    copies = (
        F.when(F.col("kind") == "burst", BURST_COPIES)
        .when(F.col("kind") == "dup", DUP_COPIES)
        .when(F.col("kind") == "series", SERIES_COPIES)
        .otherwise(1)
    )
    return (
        ev.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
        .withColumn("kind", kind)
        .withColumn("i", F.explode(F.sequence(F.lit(0), copies - 1)))
    )


def events_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised (typed, not de-duplicated) transactions, schema ``schemas.TX_COLUMNS``."""
    return tx_from_events(read_table(spark, sf_dir, "events"))


def tx_from_events(events: DataFrame) -> DataFrame:
    """Row-wise mapping (works on batch and streaming frames alike)."""
    r = _replicated(events)
    k = F.col("k")
    trm = F.concat(F.lit("V"), (k % 10).cast("string"))
    cat0 = _category(F.col("kind"), F.col("event_type"), k)
    cat_num = F.when((cat0 == 151) & (trm == "V3"), 201).otherwise(cat0).cast("int")
    step = F.when(F.col("kind") == "series", F.col("i") * SERIES_STEP_SECONDS).otherwise(0)
    card = F.when(F.col("kind") == "burst", F.col("user_id") + F.col("i")).otherwise(F.col("user_id"))
    tx = r.select(
        card.cast("string").alias("card"),
        trm.alias("trm_id"),
        F.concat(F.lit("R"), (k % 7).cast("string")).alias("route_num"),
        F.concat(F.lit("C"), (k % 3).cast("string")).alias("trc_id"),
        cat_num.cast("string").alias("cat"),
        F.lit(None).cast("string").alias("cat_type"),
        cat_num.alias("cat_num"),
        (F.floor("value") * 100).cast("double").alias("summ_num"),
        F.lit("").alias("vehicle"),
        # on the whole second, then the step of the series
        seconds_after("ts", step + F.second("ts") - F.extract(F.lit("SECOND"), F.col("ts"))).alias("dt"),
        F.lit("events").alias("src_file"),
        (F.col("event_id") * 10 + F.col("i")).alias("src_row"),
    )
    return with_calendar(tx)


def events_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same taps as raw text, the way a CSV dump delivers them (all strings,
    ``dd.MM.yyyy HH:mm:ss`` dates, zero-padded categories, padded header names)."""
    tx = events_tx(spark, sf_dir)
    dt = F.col("dt").cast("string")
    return tx.select(
        F.concat(F.substring(dt, 9, 2), F.lit("."), F.substring(dt, 6, 2), F.lit("."), F.substring(dt, 1, 4), F.lit(" "),
                 F.substring(dt, 12, 8)).alias(" date "),
        F.col("card").alias("Card"),
        F.concat(F.lit(" "), F.col("trm_id")).alias("TRM_ID "),
        F.col("route_num").alias("ROUTE_NUM"),
        F.col("trc_id").alias("TRC_ID"),
        F.lpad(F.col("cat_num").cast("string"), 4, "0").alias("CAT"),
        F.col("summ_num").cast("bigint").cast("string").alias("SUMM"),
        F.lit(None).cast("string").alias("VEHICLE"),
        F.col("src_file").alias("_src_file"),
        F.col("src_row").alias("_src_row"),
    )


def with_calendar(tx: DataFrame) -> DataFrame:
    dt = F.col("dt")
    return tx.select(
        "card", "trm_id", "route_num", "trc_id", "cat", "cat_type", "cat_num", "summ_num", "vehicle",
        "dt",
        F.to_date(dt).alias("date"),
        F.hour(dt).alias("hour"),
        F.minute(dt).alias("minute"),
        F.second(dt).alias("second"),
        F.weekday(dt).alias("weekday"),
        "src_file", "src_row",
    )


def replicated_events(spark: SparkSession, sf_dir: str, factor: int) -> DataFrame:
    """``events`` repeated ``factor`` times inside Spark (``explode``, no cross join): replica r
    gets new event ids and new riders (user ids shifted by r * 10^7) on the same clock, i.e. the
    same network carrying ``factor`` times the passengers. For scale runs only."""
    ev = read_table(spark, sf_dir, "events")
    if factor <= 1:
        return ev
    r = F.explode(F.sequence(F.lit(0), F.lit(factor - 1))).alias("r")
    return ev.select("*", r).select(
        (F.col("event_id") * factor + F.col("r")).alias("event_id"), "ts",
        (F.col("user_id") + F.col("r") * 10_000_000).alias("user_id"), "event_type", "value", "props")
