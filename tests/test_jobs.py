import glob
import io
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from farewatch.__main__ import with_settings
from farewatch.config import RulesConfig
from farewatch.plans.jobs import run_full_pipeline
from farewatch.sources.dump_fixture import dump_rows, write_dump

SF = "/root/testdata/sf0.001"


def test_full_pipeline_from_raw_dumps(spark):
    raw = write_dump(spark, SF, tempfile.mkdtemp(prefix="fw-dump-"))
    out_dir = tempfile.mkdtemp(prefix="fw-pipe-")
    out = run_full_pipeline(spark, raw, out_dir)
    m = out["ml_ml_summary"].collect()[0]
    assert m["labels"] == m["features"] and m["inference"]["scored_cards"] == m["features"]
    s = out["ml_summary"].collect()[0]
    assert s["scored_cards"] > 0 and s["top_cards"] == max(1, round(s["scored_cards"] * 0.01))
    assert s["known_fraud_excluded"] + s["new_pattern_candidates"] == s["top_cards"]
    rules = out["summary"].collect()[0]
    assert sum(rules["hypotheses"].values()) == rules["total_anomalies"] and len(rules["hypotheses"]) == 13
    full = json.loads(out["full_summary"].toJSON().collect()[0])
    assert full["rules"]["total_anomalies"] == rules["total_anomalies"] and full["ml"]["labels"] == m["labels"]
    rejects = out["rejects"].collect()                                       # two members in each of two archives, and rows by their width
    assert sum(not r["error"].startswith("row:") for r in rejects) == 4
    odd = dump_rows(spark, SF).groupBy("_fields").count().collect()
    assert sum(r["error"].startswith("row:") for r in rejects) == sum(r["count"] for r in odd if r["_fields"] != 8) > 0
    # exports: one file each, byte-order mark and header once, risk order
    import csv
    for name, frame in (("fraud_report", out["report"]), ("action_validators", out["report"].where("entity_type = 'validator'"))):
        data = open(f"{out_dir}/rules/{name}.csv", encoding="utf-8", newline="").read()
        assert data.startswith("\ufeff") and data.count("\ufeff") == 1 and data.count("risk_score") == 1
        risks = [float(r["risk_score"]) for r in csv.DictReader(io.StringIO(data, newline=""))]
        assert risks == sorted(risks, reverse=True) and len(risks) == frame.count() > 0
    for day in glob.glob(out_dir + "/tables/tx_norm/date=*"):
        assert len(glob.glob(day + "/part-*")) == 1
    assert os.path.isfile(out_dir + "/ml/new_candidates.csv") and os.path.isdir(out_dir + "/tables/raw")


def test_settings():
    c = with_settings(RulesConfig(), ["h1.threshold_raw=8", "H11.threshold_strong=0.5"])
    assert (c.h1.threshold_raw, c.h11.threshold_strong) == (8, 0.5)
    for bad in ("h1.nothing=3", "h99.x=1", "x"):
        with pytest.raises(ValueError):
            with_settings(RulesConfig(), [bad])


def test_rules_do_not_depend_on_the_session_zone(spark):
    """Same rows in a zone with clock changes; the setting stays the caller's."""
    from farewatch.operators.dedupe import remove_near_duplicates
    from farewatch.operators.normalize import normalize_transactions
    from farewatch.operators.rules import run_rules
    from farewatch.sources.fixture import events_raw

    def rows():
        tx = remove_near_duplicates(normalize_transactions(events_raw(spark, SF)))
        return sorted(str(r) for df in run_rules(tx, ["H1", "H3", "H4s", "H8s", "H21k"]).values() for r in df.collect()), \
            sorted(map(str, tx.select("card", "trm_id", "dt", "date", "hour").collect()))
    zone = spark.conf.get("spark.sql.session.timeZone")
    utc = rows()
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
        assert rows() == utc
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        assert rows() == utc and spark.conf.get("spark.sql.session.timeZone") == "Europe/Berlin"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_missing_artifact_is_empty(spark):
    from farewatch.plans.jobs import read_artifact
    df = read_artifact(spark, tempfile.mkdtemp() + "/nothing", "card_id string, is_fraud int")
    assert df.count() == 0 and df.columns == ["card_id", "is_fraud"]


def test_summary_exact_and_approx(spark):
    from farewatch.plans import tables
    from farewatch.plans.jobs import transaction_summary
    tx = tables.tx(spark, SF)
    exact = transaction_summary(tx).collect()[0]
    approx = transaction_summary(tx, approx=True).collect()[0]
    assert exact["transactions"] == approx["transactions"]
    assert abs(approx["cards"] - exact["cards"]) <= max(1, 0.05 * exact["cards"])


def test_one_file_keeps_order_and_text(spark, tmp_path):
    import pandas as pd

    from farewatch.sources.one_file import write_one_csv
    rows = [(k, [f"text {k}", 'say "hi"; there, you', "two\nlines", "", None, "C:\\", "Ünï"][k % 7], k / 4) for k in range(500)]
    df = spark.createDataFrame(rows, "a int, b string, c double").repartition(7).orderBy(F.desc("a"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_one_csv(df, str(tmp_path / "new" / "out.csv"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    got = pd.read_csv(tmp_path / "new" / "out.csv", keep_default_na=False)
    assert [tuple(r) for r in got.itertuples(index=False)] == [(a, b or "", c) for a, b, c in reversed(rows)]
    write_one_csv(df.limit(0), str(tmp_path / "empty.csv"))
    assert open(tmp_path / "empty.csv", encoding="utf-8").read() == "\ufeffa,b,c\n"
