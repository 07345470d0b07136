"""The fitted model against NumPy: standardisation, tree walks, offset; saved and loaded."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from farewatch.operators import model_bundle as B
from farewatch.operators.scoring import ForestConfig, average_path

COLUMNS = ("a", "b", "c", "flat")
CFG = ForestConfig(n_trees=15, max_samples=64, seed=3, features=COLUMNS, excluded_cats=("999",))


def cards(spark, n=400):
    rnd = np.random.default_rng(5)
    x = rnd.normal([10, -3, 0], [1000, 0.01, 5], (n, 3))
    x[:5] *= 30
    rows = [(f"c{k}", "999" if k % 10 == 9 else None if k % 10 == 8 else "201", *map(float, x[k]), 7.0) for k in range(n)]
    rows[20] = ("c20", "201", None, float("nan"), float("inf"), None)
    return spark.createDataFrame(rows, "card_id string, dominant_cat string, a double, b double, c double, flat double")


def walk(nodes, row):
    total = 0.0
    for tree in nodes.values():
        at = 0
        while tree[at]["feature"] >= 0:
            at = tree[at]["left"] if row[tree[at]["feature"]] < tree[at]["threshold"] else tree[at]["right"]
        total += tree[at]["depth"] + average_path(tree[at]["size"])
    return total / len(nodes)


def test_score_is_the_offset_less_score_samples(spark, tmp_path):
    df = cards(spark)
    fitted = B.fit(df, CFG, str(tmp_path / "m"), contamination=0.05)
    model = B.load(spark, str(tmp_path / "m"))
    assert model.cfg == CFG and model.offset == fitted.offset and model.psi == 64
    pdf = df.toPandas()
    used = pdf[pdf["dominant_cat"] != "999"].reset_index(drop=True)
    x = used[list(COLUMNS)].replace([np.inf, -np.inf], np.nan).fillna(0).to_numpy(float)
    x = np.floor(x * 1e6 + 0.5) / 1e6
    mean, scale = x.mean(axis=0), x.std(axis=0)
    got = model.scaler.orderBy("position").toPandas()
    assert np.allclose(got["mean"], mean, atol=1e-6) and np.allclose(got["scale"], np.where(scale < 1e-6, 1, scale), atol=1e-6)
    z = (x - got["mean"].to_numpy()) / got["scale"].to_numpy()
    z = np.floor(z * 1e6 + 0.5) / 1e6
    nodes = {}
    for r in model.nodes.collect():
        nodes.setdefault(r["tree"], {})[r["node"]] = r
    samples = np.array([-(2 ** (-walk(nodes, row) / average_path(64))) for row in z])
    assert np.isclose(model.offset, np.percentile(samples, 5), atol=1e-7)
    out = {r["card_id"]: r for r in B.score(df, model).collect()}
    assert set(out) == set(used["card_id"])                       # a missing category is no excluded one
    want = dict(zip(used["card_id"], -(samples - model.offset), strict=True))
    assert all(abs(out[c]["anomaly_score"] - want[c]) < 1e-7 for c in out)
    assert abs(sum(r["anomaly_score"] > 0 for r in out.values()) / len(out) - 0.05) < 0.01
    assert sorted(out, key=lambda c: out[c]["rank"])[:3] == sorted(want, key=lambda c: (-want[c], c))[:3]


def test_scores_do_not_change_with_the_unit_of_a_column(spark, tmp_path):
    """Standardised inputs: a column in other units gives the same model and the same scores."""
    df = cards(spark)
    a = B.fit(df, CFG, str(tmp_path / "a"))
    b = B.fit(df.withColumn("a", F.col("a") * 1024), CFG, str(tmp_path / "b"))
    x = {r["card_id"]: r["anomaly_score"] for r in B.score(df, a).collect()}
    y = {r["card_id"]: r["anomaly_score"] for r in B.score(df.withColumn("a", F.col("a") * 1024), b).collect()}
    assert max(abs(x[c] - y[c]) for c in x) < 0.02


def test_missing_columns_and_empty_tables(spark, tmp_path):
    df = cards(spark, 60)
    model = B.fit(df, CFG, str(tmp_path / "m"))
    with pytest.raises(ValueError, match="flat"):
        B.score(df.drop("flat"), model)
    assert B.score(df.limit(0), model).count() == 0
    assert B.fit(df.limit(0), CFG, str(tmp_path / "e")).offset == B.NO_EVIDENCE


def test_the_scoring_job_loads_the_model(spark, tmp_path):
    from farewatch.plans.jobs import fit_model, run_bundle_inference
    df = cards(spark).withColumns({c: F.lit(1) for c in ("tx_count", "active_days")})
    fit_model(spark, df, str(tmp_path / "m"), CFG)
    labels = df.select("card_id", (F.col("card_id") == "c0").cast("int").alias("is_fraud"))
    out = run_bundle_inference(spark, df, labels, str(tmp_path / "m"), str(tmp_path / "out"), 0.02)
    s = out["summary"].collect()[0]
    assert s["scored_cards"] == 360 and s["top_cards"] == 7 and s["known_fraud_excluded"] == 7 - out["candidates"].count()
