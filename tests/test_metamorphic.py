"""Metamorphic properties on the driver fixture (sf0.001)."""

from dataclasses import replace

from pyspark.sql import functions as F

from farewatch.config import RulesConfig
from farewatch.operators.dedupe import remove_near_duplicates
from farewatch.operators.rules import run_rules
from farewatch.plans import tables

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()))


def keys(df):
    return {(r["hypothesis"], r["entity_id"], r["anomaly_date"]) for r in df.collect()}


def test_raising_thresholds_shrinks_output(spark):
    tx = tables.tx(spark, SF)
    base = RulesConfig()
    strict = replace(base, h1=replace(base.h1, threshold_raw=8), h3=replace(base.h3, threshold_raw=4),
                     h11=replace(base.h11, threshold_raw=0.3))
    for name in ("H1", "H3", "H11"):
        a = run_rules(tx, [name], base)[name]
        b = run_rules(tx, [name], strict)[name]
        assert b.count() <= a.count()
        assert keys(b.filter("severity = 'raw'")) <= keys(a.filter("severity = 'raw'"))


def test_strong_is_subset_of_raw(spark):
    res = run_rules(tables.tx(spark, SF), ["H1", "H3", "H11", "H12"])
    for name, df in res.items():
        assert keys(df.filter("severity = 'strong'")) <= keys(df.filter("severity = 'raw'")), name


def test_high_and_low_cash_disjoint(spark):
    res = run_rules(tables.tx(spark, SF), ["H11", "H12"])
    ids = [{r["entity_id"] for r in res[n].collect()} for n in ("H11", "H12")]
    assert not (ids[0] & ids[1])


def test_date_split_union_is_whole(spark):
    tx = tables.tx(spark, SF)
    cut = F.lit("2024-01-15").cast("date")
    for name in ("H7", "H17"):
        whole = rows(run_rules(tx, [name])[name])
        parts = rows(run_rules(tx.filter(F.col("date") < cut), [name])[name]) + \
            rows(run_rules(tx.filter(F.col("date") >= cut), [name])[name])
        assert whole == sorted(parts), name


def test_appending_a_copy_changes_nothing(spark):
    norm = tables.tx_norm(spark, SF)
    once = remove_near_duplicates(norm)
    twice = remove_near_duplicates(norm.unionByName(norm.withColumn("src_row", F.col("src_row") + 10**12)))
    for name in ("H1", "H3", "H4", "H8", "H19"):
        assert rows(run_rules(once, [name])[name]) == rows(run_rules(twice, [name])[name]), name
