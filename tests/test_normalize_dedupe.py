from pyspark.sql import functions as F

from farewatch.operators.dedupe import remove_near_duplicates
from farewatch.operators.normalize import normalize_transactions
from tests.helpers import at, tx

RAW = "` date ` string, `Card` string, `trm_id ` string, CAT string, SUMM string"


def test_header_and_embedded_header_row(spark):  # M1
    raw = spark.createDataFrame([("09.05.2023 05:08:48", "1", "V1", "0201", "100"),
                                 ("DATE", "CARD", "TRM_ID", "CAT", "SUMM")], RAW)
    out = normalize_transactions(raw).collect()
    assert len(out) == 1 and out[0]["card"] == "1"


def test_date_parsing(spark):  # M2
    raw = spark.createDataFrame([(d, "1", "V1", "201", "1") for d in
                                 ["09.05.2023 05:08:48", "9.5.2023 5:08:48", "32.05.2023 00:00:00", "",
                                  "09.05.2023 05:08:48x", None]], RAW)
    got = sorted(r["dt"].isoformat() for r in normalize_transactions(raw).collect())
    assert got == ["2023-05-09T05:08:48", "2023-05-09T05:08:48"]


def test_null_cards_dropped(spark):  # M3
    raw = spark.createDataFrame([("09.05.2023 05:08:48", c, "V1", "201", "1") for c in ["", "nan", "None", "NULL", "7"]], RAW)
    assert [r["card"] for r in normalize_transactions(raw).collect()] == ["7"]


def test_category_coercion(spark):  # M4
    raw = spark.createDataFrame([("09.05.2023 05:08:48", "1", "V1", c, "1") for c in ["0201", "201.0", "x", ""]], RAW)
    got = sorted([r["cat_num"] for r in normalize_transactions(raw).collect()], key=lambda v: (v is None, v))
    assert got == [201, 201, None, None]


def test_near_duplicate_chain(spark):  # M5, M6
    rows = [{"dt": at(s)} for s in (0, 2, 4, 7)] + [{"dt": at(0), "trm": "V2"}]
    out = remove_near_duplicates(tx(spark, rows)).orderBy("trm_id", "dt").collect()
    assert [(r["trm_id"], r["second"]) for r in out] == [("V1", 0), ("V1", 7), ("V2", 0)]


def test_exact_copies_keep_first_source_row(spark):
    rows = [{"dt": at(0), "route": "R9"}, {"dt": at(0), "route": "R1"}, {"dt": at(0), "route": "R9"}]
    out = remove_near_duplicates(tx(spark, rows)).collect()
    assert len(out) == 1 and out[0]["route_num"] == "R9" and out[0]["src_row"] == 0


def test_dedupe_idempotent_and_copy_invariant(spark):
    rows = [{"dt": at(s), "card": c} for s in (0, 1, 3, 10, 11, 30) for c in ("A", "B")]
    base = remove_near_duplicates(tx(spark, rows))
    doubled = remove_near_duplicates(tx(spark, rows + rows))
    key = lambda df: sorted((r["card"], r["dt"]) for r in df.collect())
    assert key(base) == key(doubled) == key(remove_near_duplicates(base))


def test_normalize_plan_has_no_shuffle(spark):
    raw = spark.createDataFrame([("09.05.2023 05:08:48", "1", "V1", "0201", "100")], RAW)
    plan = normalize_transactions(raw)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_missing_required_column_raises(spark):  # B4
    import pytest
    raw = spark.createDataFrame([("09.05.2023 05:08:48", "V1")], "DATE string, TRM_ID string")
    with pytest.raises(ValueError, match="CARD"):
        normalize_transactions(raw)


def test_na_tokens_in_other_columns(spark):
    raw = spark.createDataFrame([("09.05.2023 05:08:48", "1", "V1", "0201", "NA", "N/A")],
                                "DATE string, CARD string, TRM_ID string, CAT string, SUMM string, VEHICLE string")
    r = normalize_transactions(raw).collect()[0]
    assert r["summ_num"] is None and r["vehicle"] == ""
