"""One card holds a third of all taps: the order-dependent operators must spread it over tasks
(and still be exact)."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from farewatch.functions.ordered import with_previous
from farewatch.operators.dedupe import remove_near_duplicates
from tests.helpers import at, tx

PARTS = 16


# observe the planned shuffle partitioning: no coalescing of tiny partitions, no runtime switch
# to a broadcast join with a local shuffle read (which would keep the map-side layout), no packing
# of small written files into one read partition
PLANNED = {
    "spark.sql.files.maxPartitionBytes": "64k",
    "spark.sql.files.openCostInBytes": "64k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.localShuffleReader.enabled": "false",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.shuffle.partitions": str(PARTS),
}


@pytest.fixture()
def no_coalesce(spark):
    old = {k: spark.conf.get(k) for k in PLANNED}
    for k, v in PLANNED.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def hot_rows(n_hot=1200, n_other=2400):
    rnd = random.Random(11)
    rows = [{"dt": at(90 * i), "card": "HOT", "trm": "V1"} for i in range(n_hot)]
    rows += [{"dt": at(rnd.randint(0, 90 * n_hot)), "card": f"c{rnd.randint(0, 300)}", "trm": f"V{rnd.randint(1, 5)}"}
             for _ in range(n_other)]
    rnd.shuffle(rows)
    return rows


def hot_share(df):
    # every output column stays referenced, so no operator under test can be pruned away
    per = (df.withColumn("p", F.spark_partition_id()).filter(F.col("card") == "HOT")
           .groupBy("p").agg(F.count(F.lit(1)).alias("count"), F.sum(F.hash(*df.columns)).alias("h")).collect())
    total = sum(r["count"] for r in per)
    return max(r["count"] for r in per) / total, len(per)


def test_with_previous_spreads_hot_card(spark, no_coalesce):
    d = tx(spark, hot_rows())
    out = with_previous(d.select("card", "trm_id", "dt", "src_row"), ["card"], "dt", ["src_row"], ["trm_id"],
                        bucket_seconds=3600)
    share, parts = hot_share(out)
    assert parts > 4 and share < 0.5
    w = Window.partitionBy("card").orderBy("dt", "src_row")
    want = d.select("src_row", F.lag("dt").over(w).alias("prev_dt"))
    assert sorted(map(tuple, out.select("src_row", "prev_dt").collect())) == sorted(map(tuple, want.collect()))


def test_dedupe_spreads_hot_card(spark, no_coalesce):
    out = remove_near_duplicates(tx(spark, hot_rows()))
    share, parts = hot_share(out)
    assert parts > 4 and share < 0.5


def test_features_spread_a_card_on_many_validators(spark, no_coalesce):
    """A pseudo-card with a third of the taps, on many validators: no task gets its rows together."""
    from farewatch.operators import features as FE
    rows = hot_rows()
    for k, r in enumerate(rows):
        if r["card"] == "HOT":
            r["trm"] = f"V{k % 400}"
    taps = FE.feature_rows(tx(spark, rows))
    grain = FE.card_grain(taps).withColumnRenamed("card_id", "card")
    share, parts = hot_share(grain)
    assert parts > 4 and share < 0.3
    got = {r["card_id"]: r for r in FE._dim_features(FE.card_grain(taps)).collect()}
    assert got["HOT"]["tx_count"] == 1200 and got["HOT"]["unique_terminals"] == len({r["trm"] for r in rows if r["card"] == "HOT"})


def test_hot_cards_of_the_feature_table(spark, no_coalesce, monkeypatch):
    """A hot card's taps are dealt by hour, all others' by card alone; the features are the same."""
    from farewatch.operators import features as FE
    rows = hot_rows()
    for k, r in enumerate(rows):
        r |= {"trm": f"V{k % 7}", "cat": 201 + k % 3, "route": f"R{k % 4}"}
    taps = FE.feature_rows(tx(spark, rows))
    cold, hot = FE.clustered_taps(taps)
    assert {r["card_id"] for r in hot.select("card_id").collect()} == {"HOT"} and cold.where("card_id = 'HOT'").count() == 0
    share, parts = hot_share(hot.withColumnRenamed("card_id", "card"))
    assert parts > 4 and share < 0.5
    monkeypatch.setattr(FE, "TAPS_PER_TASK", 100)
    assert cold.rdd.getNumPartitions() == PARTS and FE.clustered_taps(taps)[0].rdd.getNumPartitions() == 36
    got = {r["card_id"]: r.asDict() for r in FE.build_features(None, taps.select("card_id").distinct(), taps).collect()}
    want = {r["card_id"]: r.asDict() for r in FE._dim_features(FE.card_grain(taps)).collect()}
    assert got.keys() == want.keys()
    for card, w in want.items():
        assert {k: got[card][k] for k in w} == pytest.approx(w), card
    cats = {r["cat"]: r["count"] for r in taps.where("card_id = 'HOT'").groupBy("cat").count().collect()}
    assert got["HOT"]["dominant_cat"] == min(cats, key=lambda c: (-cats[c], c))


def test_prefix_sum_spreads_one_group(spark, no_coalesce):
    from farewatch.functions.ordered import exclusive_prefix_sum
    df = spark.range(4000).select(F.lit("HOT").alias("card"), "id", F.lit(1).alias("w"))
    out = exclusive_prefix_sum(df, ["card"], ["id"], "w", "before")
    assert out.where("before <> id").count() == 0
    share, parts = hot_share(out)
    assert parts > 4 and share < 0.3
