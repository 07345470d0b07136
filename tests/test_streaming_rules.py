import os
import random
import shutil
import uuid

import pandas as pd
from pyspark.sql import functions as F

from farewatch.functions.time import epoch_seconds
from farewatch.operators.dedupe import remove_near_duplicates
from farewatch.operators.rules.frequency import daily_trips
from farewatch.operators.rules.series import h8_school_sessions
from farewatch.plans import tables
from farewatch.sources.fixture import tx_from_events
from farewatch.streaming.bursts import event_stream
from farewatch.streaming.replay import open_rows, run_to_table, watermark_seconds
from farewatch.streaming.rules import DAILY_SCHEMA, daily_trip_stream, judge_taps, near_dedup_stream, run_daily_trips, run_near_dedup, run_school_sessions

SF = "/root/testdata/sf0.001"


def name(prefix):
    return f"{prefix}_{uuid.uuid4().hex[:6]}"


def test_x3_stream_dedup_equals_batch(spark):
    got = run_near_dedup(spark, SF, name("x3"))
    want = remove_near_duplicates(tables.tx_norm(spark, SF)).select("card", "trm_id", "dt", "src_row")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_x2_days_equal_batch(spark):
    got = run_daily_trips(spark, SF, name("x2"))
    want = daily_trips(tables.tx_norm(spark, SF)).filter(F.col("n") >= 6)
    a, b = (sorted((r["card"], r["date"], r["n"]) for r in x.collect()) for x in (got, want))
    assert a == b and a


def test_x4_sessions_equal_batch_h8s(spark):
    got = run_school_sessions(spark, SF, name("x4"))
    want = h8_school_sessions(tables.tx_norm(spark, SF))
    a = sorted((r["card"], r["consecutive_count"]) for r in got.collect())
    b = sorted((r["entity_id"], int(r["metric_value"])) for r in want.collect())
    assert a == b and a


def files_in_order(tmp_path, parts):
    """One folder whose files are read one per micro-batch, in order of modification time."""
    folder = tmp_path / "sf"
    folder.mkdir()
    for k, p in enumerate(parts):
        p.coalesce(1).write.parquet(str(tmp_path / f"p{k}"))
        file = next((tmp_path / f"p{k}").glob("part-*.parquet"))
        shutil.copy(file, folder / f"events{k}.parquet")
        os.utime(folder / f"events{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    return str(folder)


def test_x3_with_taps_out_of_order(spark, tmp_path):
    """Taps reach the stream up to almost the delay late, chains cut between files: equal to the batch."""
    ev = spark.read.parquet(f"{SF}/events.parquet")
    first, last = ev.agg(F.unix_seconds(F.min("ts").cast("timestamp")), F.unix_seconds(F.max("ts").cast("timestamp"))).collect()[0]
    delay = (last - first) // 3
    # a tap arrives at its time plus up to 0.9 of the delay; files are cut by arrival
    arrival = F.unix_seconds(F.col("ts").cast("timestamp")) + F.pmod(F.xxhash64("event_id"), F.lit(delay * 9 // 10))
    part = F.least(F.floor((arrival - first) / ((last - first) / 4)), F.lit(4))
    parts = [ev.where(part == k) for k in range(5)]
    assert sum(p.count() for p in parts) == ev.count() and all(p.count() for p in parts)
    folder = files_in_order(tmp_path, parts)
    stream = run_to_table(spark, near_dedup_stream(event_stream(spark, folder), delay_seconds=delay), name("x3o"), "card string, trm_id string, dt timestamp_ntz, src_row bigint")
    want = remove_near_duplicates(tables.tx_norm(spark, SF)).select("card", "trm_id", "dt", "src_row")
    judged = want.where(F.unix_seconds(F.col("dt").cast("timestamp")) <= last - delay)
    assert abs(stream.count() - judged.count()) <= judged.count() // 50 and stream.count() > 0
    events = spark.read.parquet(folder)
    mark = watermark_seconds(events, delay)
    rest = remove_near_duplicates(tx_from_events(events).where(epoch_seconds("dt") >= mark - 2)).where(epoch_seconds("dt") > mark)
    got = stream.unionByName(rest.select("card", "trm_id", "dt", "src_row"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_judge_taps_in_any_split():
    rnd = random.Random(1)
    taps = pd.DataFrame([(f"c{rnd.randint(0, 3)}", f"v{rnd.randint(0, 1)}", k, rnd.randint(0, 120)) for k in range(400)], columns=["card", "trm_id", "src_row", "sec"])
    taps["dt"], taps["seen"] = taps["sec"], False
    whole = judge_taps(taps, 2, 10 ** 9)[0]["src_row"].tolist()
    held, got = taps.iloc[:0], []
    for passed in [*range(0, 121, 7), 10 ** 6]:
        arriving = taps[(taps["sec"] <= passed) & (taps["sec"] > passed - 7)] if passed < 10 ** 6 else taps[taps["sec"] > 119]
        out, held = judge_taps(pd.concat([held, arriving.sample(frac=1, random_state=passed)]), 2, passed - 3)
        got += out["src_row"].tolist()
    assert sorted(got) == sorted(whole)


def test_several_files_with_late_taps_and_open_windows(spark, tmp_path):
    """Files out of order within the delay; the last windows stay open at the end of the replay."""
    ev = spark.read.parquet(f"{SF}/events.parquet")
    cut = ev.agg(F.percentile_approx("ts", [0.5, 0.995])).collect()[0][0]
    late = (F.col("event_id") % 50 == 0) & (F.col("ts") > F.lit(cut[0]) - F.expr("INTERVAL 5 MINUTES"))
    parts = [ev.where((F.col("ts") <= F.lit(cut[0])) & ~late), ev.where((F.col("ts") > F.lit(cut[0])) & (F.col("ts") <= F.lit(cut[1])) | late & (F.col("ts") <= F.lit(cut[1]))),
             ev.where(F.col("ts") > F.lit(cut[1]))]
    assert sum(p.count() for p in parts) == ev.count()
    folder = files_in_order(tmp_path, parts)
    stream = event_stream(spark, folder)
    closed = run_to_table(spark, daily_trip_stream(stream), name("x2f"), DAILY_SCHEMA)
    events = spark.read.parquet(folder)
    got = closed.unionByName(daily_trip_stream(open_rows(events, 86400, 3600)))
    want = daily_trips(tables.tx_norm(spark, SF)).filter(F.col("n") >= 6)
    assert sorted((r["card"], r["date"], r["n"]) for r in got.collect()) == sorted((r["card"], r["date"], r["n"]) for r in want.collect())
    assert 0 < closed.count() < got.count()
