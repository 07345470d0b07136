import datetime as dt
import json

from farewatch.config import H10Config
from farewatch.operators.rules.bursts import h3_bursts
from farewatch.operators.rules.cash import h11_high_cash, h12_low_cash
from farewatch.operators.rules.categories import h7_night_school, h10_atypical_benefit, h17_zero_sum, h19_unknown_categories
from farewatch.operators.rules.frequency import h1_high_frequency, h20_duplicates
from farewatch.operators.rules.series import (
    h4_benefit_series, h4_benefit_sessions, h8_school_card_multiple, h8_school_sessions,
)
from farewatch.operators.rules.poisson import h21_poisson_deviation
from farewatch.schemas import ANOMALY_COLUMNS
from tests.helpers import at, tx


def sev(df):
    return sorted((r["severity"], r["threshold_value"]) for r in df.collect())


def test_h1_exactly_twelve(spark):  # M7
    rows = [{"dt": at(600 * i)} for i in range(12)]
    assert sev(h1_high_frequency(tx(spark, rows))) == [("raw", "6"), ("strong", "12")]


def test_h1_service_card_dropped(spark):  # M8
    day2 = dt.datetime(2024, 1, 9, 8, 0, 0)
    rows = [{"dt": at(600 * i)} for i in range(13)] + [{"dt": at(600 * i, day2)} for i in range(6)]
    assert h1_high_frequency(tx(spark, rows)).count() == 0


def test_h3_layers(spark):  # M9
    three = [{"dt": at(0), "card": c} for c in "ABC"]
    five = [{"dt": at(50), "card": c} for c in "DEFGH"]
    out = h3_bursts(tx(spark, three + five)).collect()
    assert sorted((r["anomaly_date"][-2:], r["severity"]) for r in out) == [("00", "raw"), ("50", "raw"), ("50", "strong")]
    d = json.loads([r for r in out if r["anomaly_date"].endswith("50")][0]["details"])
    assert d == {"unique_cards": 5, "sample_cards": ["D", "E", "F", "G", "H"]}


def test_h3_one_card_and_empty(spark):  # M10, M11
    same = [{"dt": at(0), "card": "A"}] * 3
    assert h3_bursts(tx(spark, same)).count() == 0
    out = h3_bursts(tx(spark, [{"dt": at(0)}]))
    assert out.count() == 0 and out.columns == ANOMALY_COLUMNS


def test_h4_interval_is_strict(spark):  # M12
    night = dt.datetime(2024, 1, 8, 22, 0, 0)
    rows = [{"dt": at(s, night), "card": f"K{i}"} for i, s in enumerate((0, 59, 118, 178))]
    assert h4_benefit_series(tx(spark, rows)).count() == 0


def test_h4_parity_merges_runs_sessions_do_not(spark):  # M13
    night = dt.datetime(2024, 1, 8, 23, 0, 0)
    rows = [{"dt": at(s, night), "card": f"K{i}"} for i, s in enumerate((0, 10, 20, 1000, 1010, 1020))]
    parity = h4_benefit_series(tx(spark, rows)).collect()
    assert len(parity) == 1 and parity[0]["metric_value"] == 4.0
    assert h4_benefit_sessions(tx(spark, rows)).count() == 0


def test_h7_night_hours(spark):  # M14
    rows = [{"dt": dt.datetime(2024, 1, 8, 5, 59, 59), "cat": 203}, {"dt": dt.datetime(2024, 1, 8, 6, 0, 0), "cat": 203}]
    out = h7_night_school(tx(spark, rows)).collect()
    assert [r["anomaly_date"] for r in out] == ["2024-01-08T05:59:59"]


def test_h8_first_validator(spark):  # M15
    rows = [{"dt": at(s), "cat": 203} for s in (0, 30, 55)] + [{"dt": at(70), "cat": 203, "trm": "V2"}]
    out = h8_school_card_multiple(tx(spark, rows)).collect()
    assert len(out) == 1 and out[0]["metric_value"] == 2.0 and json.loads(out[0]["details"]) == {"validator": "V1"}
    assert h8_school_sessions(tx(spark, rows)).count() == 1


def test_h10_threshold_strict(spark):  # M16
    peak = dt.datetime(2024, 1, 8, 8, 0, 0)
    rows = [{"dt": at(60 * i, peak), "cat": 203} for i in range(3)] + [{"dt": at(60 * i), "cat": 203} for i in range(7)]
    assert h10_atypical_benefit(tx(spark, rows), H10Config()).filter("entity_id = 'school'").count() == 0


def test_h11_min_transactions(spark):  # M17
    rows = [{"dt": at(60 * i), "cat": 151} for i in range(9)]
    assert h11_high_cash(tx(spark, rows)).count() == 0


def test_h12_no_cash(spark):  # M18
    rows = [{"dt": at(60 * i), "cat": 201} for i in range(10)]
    assert sev(h12_low_cash(tx(spark, rows))) == [("raw", "0.07"), ("strong", "0.0")]


def test_h17_only_bank_cards_with_zero(spark):  # M19
    rows = [{"dt": at(0), "cat": 91, "summ": 0}, {"dt": at(60), "cat": 201, "summ": 0},
            {"dt": at(120), "cat": 91, "summ": None}]
    assert h17_zero_sum(tx(spark, rows)).count() == 1


def test_h19_integer_id_and_three_samples(spark):  # M20
    rows = [{"dt": at(60 * i), "cat": 301, "card": f"Z{i}"} for i in range(4)] + [{"dt": at(999), "cat": None}]
    out = h19_unknown_categories(tx(spark, rows)).collect()
    assert len(out) == 1 and out[0]["entity_id"] == "301" and out[0]["metric_value"] == 4.0
    assert json.loads(out[0]["details"]) == {"sample_cards": ["Z0", "Z1", "Z2"]}


def test_h20_single_severity(spark):  # M21
    rows = [{"dt": at(0)}] * 2 + [{"dt": at(100)}] * 5
    assert sev(h20_duplicates(tx(spark, rows))) == [("raw", "2"), ("strong", "5")]


def test_h21_stub(spark):
    out = h21_poisson_deviation(tx(spark, [{"dt": at(0)}])).collect()
    assert len(out) == 1 and out[0]["severity"] == "info" and out[0]["anomaly_date"] == "2024-01"


def test_rules_are_shuffle_invariant(spark):
    rows = [{"dt": at(s), "card": c, "cat": cat} for s in range(0, 300, 7) for c, cat in (("A", 203), ("B", 201))]
    a = h8_school_sessions(tx(spark, rows)).collect()
    b = h8_school_sessions(tx(spark, list(reversed(rows))).repartition(3)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
