"""Counts on the driver fixture at sf0.001 as listed in FIXTURES.md §3 (an independent probe)."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from farewatch.plans import tables

SF = "/root/testdata/sf0.001"

# query -> (raw rows, strong rows); None = no severity split checked
EXPECTED = {
    "rule_h1": (28, 1), "rule_h3": (25, 10), "rule_h4": (None, 9), "rule_h4_sessions": (None, 19),
    "rule_h7": (None, 139), "rule_h8": (10, None), "rule_h8_sessions": (23, None), "rule_h11": (3, 0),
    "rule_h12": (1, 1), "rule_h17": (None, 0), "rule_h19": (1, None), "rule_h20": (0, 0),
    "rule_h2_daily": (3, 1), "rule_h21": (None, None),
}


def test_table_sizes(spark):
    assert tables.tx_norm(spark, SF).count() == 1382
    assert tables.tx(spark, SF).count() == 1286
    summary = E.queries()["tx_summary"](spark, SF).collect()[0]
    assert (summary["cards"], summary["validators"], summary["routes"], summary["categories"]) == (20, 10, 7, 6)


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_rule_counts(spark, name):
    df = E.queries()[name](spark, SF)
    raw, strong = EXPECTED[name]
    if raw is not None:
        assert df.filter(F.col("severity") == "raw").count() == raw
    if strong is not None:
        assert df.filter(F.col("severity") == "strong").count() == strong
    if name == "rule_h21":
        assert df.count() == 1


def test_h20_raw_and_service_cards(spark):
    assert E.queries()["rule_h20_raw"](spark, SF).count() == 24
    assert E.queries()["service_cards"](spark, SF).count() == 3


def test_ks_distance_of_v0(spark):
    import json
    row = E.queries()["rule_h21_ks"](spark, SF).filter("entity_id = 'V0'").collect()[0]
    d = json.loads(row["details"])
    assert d["gaps"] == 152 and abs(float(d["ks_distance"]) - 0.2314) < 5e-5
