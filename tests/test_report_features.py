import datetime as dt

from pyspark.sql import functions as F

from farewatch.operators.features import FEATURE_COLUMNS, build_features
from farewatch.operators.labels import build_card_labels
from farewatch.operators.presentation import risk_histogram
from farewatch.operators.report import aggregate_results
from farewatch.operators.rules.common import ANOMALY_SCHEMA
from tests.helpers import at, tx


def anomalies(spark, rows):
    full = [(r.get("h", "H1"), r.get("type", "card"), r["id"], r.get("date", "2024-01-01"), r.get("date", "2024-01-01"),
             "m", 1.0, "1", r.get("sev", "raw"), "{}") for r in rows]
    return spark.createDataFrame(full, ANOMALY_SCHEMA)


def test_risk_weights(spark):  # M22
    rows = [{"id": f"c{n}"} for n, k in zip(range(5), (1, 2, 3, 4, 10)) for _ in range(k)]
    got = {r["entity_id"]: r["risk_score"] for r in aggregate_results(anomalies(spark, rows)).collect()}
    assert got == {"c0": 8.5, "c1": 17.0, "c2": 25.6, "c3": 34.1, "c4": 85.2}


def test_first_last_seen_text_order_and_info(spark):  # M23, M24
    rows = [{"id": "x", "date": "2024-01", "sev": "info"}, {"id": "x", "date": "2024-01-09", "sev": "info", "h": "H10"}]
    r = aggregate_results(anomalies(spark, rows)).collect()[0]
    assert (r["first_seen"], r["last_seen"], r["max_severity"], r["hypotheses"]) == ("2024-01", "2024-01-09", "raw", "H1, H10")


def test_labels_ignore_transaction_entities(spark):  # M25
    t = tx(spark, [{"dt": at(0), "card": "X"}, {"dt": at(60), "card": "Y"}])
    report = aggregate_results(anomalies(spark, [{"id": "X", "type": "transaction", "h": "H17"}, {"id": "Y"}]))
    got = {r["card_id"]: r["is_fraud"] for r in build_card_labels(t, report).collect()}
    assert got == {"X": 0, "Y": 1}


def test_one_trip_card_and_ties(spark):  # M26, M27, M28
    day = dt.datetime(2024, 1, 8, 3, 0, 0)
    rows = [{"dt": at(0, day), "card": "solo", "cat": 207}]
    # cards with 1, 2, 2 and 5 taps, all dominant category 201
    for card, n in (("a", 1), ("b", 2), ("c", 2), ("d", 5)):
        rows += [{"dt": at(100 * i), "card": card, "cat": 201} for i in range(n)]
    rows += [{"dt": at(7), "card": "m", "cat": 204}, {"dt": at(8), "card": "m", "cat": 204},
             {"dt": at(9), "card": "m", "cat": 203}, {"dt": at(10), "card": "m", "cat": 203}]
    t = tx(spark, rows)
    labels = t.select(F.col("card").alias("card_id")).distinct().withColumn("is_fraud", F.lit(0))
    f = {r["card_id"]: r for r in build_features(t, labels).collect()}
    assert list(next(iter(f.values())).asDict()) == FEATURE_COLUMNS
    solo = f["solo"]
    assert solo["min_gap_sec"] == 0 and solo["terminal_switch_rate"] == 0 and solo["route_entropy"] == 0
    assert solo["night_share"] == 1.0
    assert [f[c]["tx_count_percentile_in_cat"] for c in "abcd"] == [0.25, 0.625, 0.625, 1.0]
    assert f["m"]["dominant_cat"] == "203" and f["m"]["segment"] == "203"


def test_risk_histogram_buckets(spark):  # M29
    rows = [("card", f"c{i}", 1, 1, "H1", "raw", s, "", "") for i, s in enumerate((0.0, 9.9, 10.0, 69.9, 99.9, 100.0))]
    report = spark.createDataFrame(rows, "entity_type string, entity_id string, total_unique_hypotheses int, "
                                   "total_violations bigint, hypotheses string, max_severity string, risk_score double, "
                                   "first_seen string, last_seen string")
    got = {r["risk_bucket"]: r["entities"] for r in risk_histogram(spark, report).collect()}
    assert got == {"0-10": 2, "10-20": 1, "20-30": 0, "30-40": 0, "40-50": 0, "50-60": 0, "60-70": 1,
                   "70-80": 0, "80-90": 0, "90-100": 2}


def test_feature_loader_view_matches_typed_path(spark):
    from farewatch.operators.features import feature_rows, feature_rows_raw
    from farewatch.plans import tables
    sf = "/root/testdata/sf0.001"
    raw = tables.raw(spark, sf)
    cols = ["card_id", "date", "terminal_id", "route_num", "carrier_id", "cat", "amount_kop", "src_row"]
    a = sorted(map(tuple, feature_rows_raw(raw).select(*cols).collect()))
    b = sorted(map(tuple, feature_rows(tables.tx_norm(spark, sf)).select(*cols).collect()))
    assert a == b


def test_feature_loader_keeps_blank_validator(spark):
    from farewatch.operators.features import feature_rows_raw
    raw = spark.createDataFrame([(" 09.05.2023 05:08:48", "7", None, "R1", "C1", "0201", "x"),
                                 ("bad date", "8", "V1", "R1", "C1", "0201", "100")],
                                "DATE string, CARD string, TRM_ID string, ROUTE_NUM string, TRC_ID string, "
                                "CAT string, SUMM string")
    rows = feature_rows_raw(raw).collect()
    assert len(rows) == 1 and rows[0]["terminal_id"] == "" and rows[0]["cat"] == "201" and rows[0]["amount_kop"] == 0
