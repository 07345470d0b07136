"""Skew-safe order helpers against plain windows / pandas on data with one hot key."""

import random

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from farewatch.functions.ordered import carry_forward_last, exclusive_prefix_sum, first_k, with_previous
from tests.helpers import T0, at


def events(spark, n=3000, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rnd.random() < 0.4 else f"k{rnd.randint(0, 30)}"
        rows.append((key, at(rnd.randint(0, 20000)), i, rnd.random() < 0.5))
    return spark.createDataFrame(rows, "key string, ts timestamp_ntz, pos bigint, flag boolean")


def test_with_previous_matches_lag(spark):
    df = events(spark)
    got = with_previous(df, ["key"], "ts", ["pos"], ["flag"], bucket_seconds=600)
    w = Window.partitionBy("key").orderBy("ts", "pos")
    want = df.select("pos", F.lag("ts").over(w).alias("prev_ts"), F.lag("flag").over(w).alias("prev_flag"))
    a = sorted(map(tuple, got.select("pos", "prev_ts", "prev_flag").collect()))
    b = sorted(map(tuple, want.collect()))
    assert a == b


def test_carry_forward_matches_running_max(spark):
    df = events(spark)
    got = carry_forward_last(df, ["key"], "ts", ["pos"], F.col("flag"), F.col("pos"), "last", bucket_seconds=900)
    w = Window.partitionBy("key").orderBy("ts", "pos").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("pos", F.last(F.when(F.col("flag"), F.col("pos")), ignorenulls=True).over(w).alias("last"))
    assert sorted(map(tuple, got.select("pos", "last").collect())) == sorted(map(tuple, want.collect()))


def test_exclusive_prefix_sum_matches_pandas(spark):
    rnd = random.Random(3)
    rows = [("g1" if rnd.random() < 0.7 else "g2", rnd.randint(0, 500), i, rnd.randint(1, 4)) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, v int, pos int, w int")
    got = exclusive_prefix_sum(df, ["g"], ["v", "pos"], "w", "before", partitions=7).toPandas()
    pdf = pd.DataFrame(rows, columns=["g", "v", "pos", "w"]).sort_values(["g", "v", "pos"])
    pdf["before"] = pdf.groupby("g")["w"].cumsum() - pdf["w"]
    m = got.merge(pdf, on=["g", "v", "pos", "w"], suffixes=("", "_want"))
    assert len(m) == 2000 and (m["before"] == m["before_want"]).all()


def test_first_k(spark):
    rows = [("a", c, i) for i, c in enumerate("zyxwvzz")] + [("b", "q", 0)]
    df = spark.createDataFrame(rows, "g string, v string, pos int")
    got = {r["g"]: r["s"] for r in first_k(df, ["g"], "v", ["pos"], 3, "s").collect()}
    assert got == {"a": ["z", "y", "x"], "b": ["q"]}
    assert T0.year == 2024
