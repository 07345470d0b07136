"""Streaming variants of rules that are naturally incremental (X2-X4).

* X2 ``daily_trip_stream``: H1's trips per card and day as a watermarked tumbling count; a day
  is emitted once the watermark closes it, with the raw / strong layer. Excluding service
  cards needs every day of a card, so rows carry ``service_day`` (over the service threshold)
  for the consumer instead of retracting earlier output.
* X3 ``near_dedup_stream``: the 2-second rule for taps in any order within the delay. State is kept
  per hash bucket of (card, validator) (``applyInPandasWithState``): the taps the watermark has not
  passed, and those of the last two seconds before it. Once it passes, taps are judged in time order,
  in one vectorised pass per bucket, so a chain split across micro-batches or files is still cut;
  an event-time timeout fires for the earliest tap that waits. What waits at the end of a replay is
  judged in batch mode.
* X4 ``school_session_stream``: H8-style sessions of school taps per (card, validator) with
  ``session_window``; the window merges taps whose gap is at most the gap duration, so 59 s on
  whole-second times means "less than 60 s".
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from farewatch.config import NEAR_DUPLICATE_SECONDS, H1Config, H8Config
from farewatch.functions.time import epoch_seconds, instant
from farewatch.operators.dedupe import remove_near_duplicates
from farewatch.session import ship_package
from farewatch.sources.fixture import read_table, tx_from_events
from farewatch.streaming.bursts import event_stream
from farewatch.streaming.replay import TxRows, open_rows, run_to_table, taps, watermark_seconds

DAY_SECONDS = 86400


def _event_time(tx: DataFrame) -> DataFrame:
    return tx.withColumn("et", instant("dt"))


def daily_trip_stream(events: DataFrame | TxRows, cfg: H1Config = H1Config(), delay_seconds: int = 3600) -> DataFrame:
    days = _event_time(taps(events)).withWatermark("et", f"{delay_seconds} seconds") \
        .groupBy("card", F.window("et", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_seconds("w.start") / DAY_SECONDS).cast("int"))
    return days.filter(F.col("n") >= cfg.threshold_raw).select(
        "card", day.alias("date"), "n",
        F.when(F.col("n") >= cfg.threshold_strong, "strong").otherwise("raw").alias("severity"),
        (F.col("n") > cfg.service_card_threshold).alias("service_day"))


DAILY_SCHEMA = "card string, date date, n bigint, severity string, service_day boolean"


def run_daily_trips(spark: SparkSession, sf_dir: str, name: str, delay_seconds: int = 3600) -> DataFrame:
    """X2 over a whole folder: the closed days from the stream, the open ones from their taps."""
    closed = run_to_table(spark, daily_trip_stream(event_stream(spark, sf_dir), delay_seconds=delay_seconds), name, DAILY_SCHEMA)
    rest = open_rows(read_table(spark, sf_dir, "events"), DAY_SECONDS, delay_seconds)
    return closed.unionByName(daily_trip_stream(rest, delay_seconds=delay_seconds))


NEAR_DUP_OUT = "card string, trm_id string, dt timestamp_ntz, src_row bigint"
NEAR_DUP_STATE = "taps binary"
NEAR_DUP_BUCKETS = 64           # fixed for the life of a checkpoint; at least the cores that share the work


def _packed(pdf: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(pdf, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_pandas()


def judge_taps(taps: pd.DataFrame, gap: int, passed: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(kept taps, taps to hold) once the watermark has passed second ``passed``. ``taps`` hold those
    judged before (``seen``) of the last ``gap`` seconds, which only serve as predecessors."""
    final = taps["sec"] <= passed
    done = taps[final].sort_values(["card", "trm_id", "sec", "src_row"], kind="mergesort")
    same = (done["card"] == done["card"].shift(1)) & (done["trm_id"] == done["trm_id"].shift(1))
    near = same & (done["sec"] - done["sec"].shift(1) <= gap)
    held = pd.concat([taps[~final], done[done["sec"] >= passed - gap].assign(seen=True)], ignore_index=True)
    return done.loc[~near & ~done["seen"], ["card", "trm_id", "dt", "src_row"]], held


def _near_dedup(gap: int):
    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = [b[["card", "trm_id", "dt", "src_row", "sec"]].assign(seen=False) for b in batches if len(b)]
        if state.exists:
            parts.insert(0, _unpacked(state.get[0]))
        if not parts:
            return
        passed = state.getCurrentWatermarkMs() // 1000
        out, held = judge_taps(pd.concat(parts, ignore_index=True), gap, passed)
        waiting = held.loc[~held["seen"], "sec"]
        if len(waiting):
            state.update((_packed(held),))
            state.setTimeoutTimestamp(max(int(waiting.min()), passed) * 1000 + 1)
        elif len(held):
            # predecessors only: dropped when the watermark is past their reach
            state.update((_packed(held),))
            state.setTimeoutTimestamp((max(int(held["sec"].max()), passed) + gap + 1) * 1000)
        elif state.exists:
            state.remove()
        if len(out):
            yield out

    return step


def near_dedup_stream(events: DataFrame, gap: int = NEAR_DUPLICATE_SECONDS, delay_seconds: int = 3600,
                      buckets: int = NEAR_DUP_BUCKETS) -> DataFrame:
    """Taps that the watermark has passed and that no tap of their card on their validator precedes
    by ``gap`` seconds or less."""
    ship_package(events.sparkSession)
    tx = _event_time(tx_from_events(events)).select("card", "trm_id", "dt", "src_row", epoch_seconds("dt").alias("sec"), "et",
                                                    F.pmod(F.xxhash64("card", "trm_id"), F.lit(buckets)).alias("bucket"))
    return tx.withWatermark("et", f"{delay_seconds} seconds").groupBy("bucket").applyInPandasWithState(
        _near_dedup(gap), NEAR_DUP_OUT, NEAR_DUP_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def run_near_dedup(spark: SparkSession, sf_dir: str, name: str, gap: int = NEAR_DUPLICATE_SECONDS, delay_seconds: int = 3600) -> DataFrame:
    """X3 over a whole folder: judged taps from the stream, those after the final watermark from a
    batch pass over them and the taps right before it."""
    judged = run_to_table(spark, near_dedup_stream(event_stream(spark, sf_dir), gap, delay_seconds), name, NEAR_DUP_OUT)
    events = read_table(spark, sf_dir, "events")
    mark = watermark_seconds(events, delay_seconds)
    rest = remove_near_duplicates(tx_from_events(events).where(epoch_seconds("dt") >= mark - gap), gap)
    return judged.unionByName(rest.where(epoch_seconds("dt") > mark).select("card", "trm_id", "dt", "src_row"))


def school_session_stream(events: DataFrame | TxRows, cfg: H8Config = H8Config(), delay_seconds: int = 600,
                          with_end: bool = False) -> DataFrame:
    tx = _event_time(taps(events)).filter(F.col("cat_num").isin(*cfg.school_cats))
    gap = f"{cfg.interval_seconds - 1} seconds"
    s = tx.withWatermark("et", f"{delay_seconds} seconds").groupBy("card", "trm_id", F.session_window("et", gap).alias("s")) \
        .agg(F.count(F.lit(1)).alias("taps"), F.min("dt").alias("start_time"))
    # taps after the first one are the "consecutive uses"
    out = s.withColumn("consecutive_count", F.col("taps") - 1).filter(F.col("consecutive_count") >= cfg.min_consecutive)
    return out.select("card", "trm_id", "start_time", "consecutive_count",
                      *([F.unix_seconds("s.end").alias("end_second")] if with_end else []))


SESSION_SCHEMA = "card string, trm_id string, start_time timestamp_ntz, consecutive_count bigint"


def run_school_sessions(spark: SparkSession, sf_dir: str, name: str, cfg: H8Config = H8Config(),
                        delay_seconds: int = 600) -> DataFrame:
    """X4 over a whole folder: closed sessions from the stream; those open at its end from the taps
    of the (card, validator) pairs that tapped after the final watermark less the gap."""
    closed = run_to_table(spark, school_session_stream(event_stream(spark, sf_dir), cfg, delay_seconds), name, SESSION_SCHEMA)
    events = read_table(spark, sf_dir, "events")
    tx, mark = tx_from_events(events), watermark_seconds(events, delay_seconds)
    live = tx.where(epoch_seconds("dt") + cfg.interval_seconds - 1 > mark).select("card", "trm_id").distinct()
    rest = TxRows(tx.join(live, ["card", "trm_id"], "left_semi"))
    late = school_session_stream(rest, cfg, delay_seconds, with_end=True).where(F.col("end_second") > mark)
    return closed.unionByName(late.drop("end_second"))
