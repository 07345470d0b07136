"""Hand-made transaction rows for micro fixtures."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from farewatch.sources.fixture import with_calendar

TX_SCHEMA = ("card string, trm_id string, route_num string, trc_id string, cat string, cat_type string, "
             "cat_num int, summ_num double, vehicle string, dt timestamp_ntz, src_file string, src_row bigint")

T0 = dt.datetime(2024, 1, 8, 10, 0, 0)  # a Monday


def at(seconds: float = 0, base: dt.datetime = T0) -> dt.datetime:
    return base + dt.timedelta(seconds=seconds)


def tx(spark: SparkSession, rows: list[dict]) -> DataFrame:
    out = []
    for i, r in enumerate(rows):
        cat = r.get("cat", 201)
        out.append((r.get("card", "C1"), r.get("trm", "V1"), r.get("route", "R1"), r.get("trc", "T1"),
                    None if cat is None else str(cat), None, cat, None if r.get("summ", 3500) is None else float(r.get("summ", 3500)), "",
                    r["dt"], "f", i))
    return with_calendar(spark.createDataFrame(out, TX_SCHEMA))
