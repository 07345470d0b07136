"""The model-dependent queries against a brute-force re-computation from the trained node table: naive per-row tree walks, then rank / top share / candidates in pandas."""

import math

import __spark_entry__ as E
from farewatch.operators.scoring import average_path
from farewatch.plans.queries import FOREST, TOP_PERCENT, card_labels, features, forest

SF = "/root/testdata/sf0.001"


def walk(tree: dict, x: dict, cols: list[str]) -> float:
    node, depth = tree[0], 0
    while node["feature"] >= 0:
        node = tree[node["left"]] if x[cols[node["feature"]]] < node["threshold"] else tree[node["right"]]
        depth += 1
    return depth + average_path(node["size"])


def test_scores_ranks_top_and_candidates(spark):
    cols = list(FOREST.features)
    nodes = forest(spark, SF).toPandas()
    trees = {t: {int(r.node): r._asdict() for r in g.itertuples()} for t, g in nodes.groupby("tree")}
    psi = int(nodes.loc[nodes["node"] == 0, "size"].max())
    feats = features(spark, SF).toPandas()
    want = {}
    for row in feats.to_dict("records"):
        x = {c: (0.0 if row[c] is None or (isinstance(row[c], float) and not math.isfinite(row[c]))
                 else math.floor(float(row[c]) * 1e6 + 0.5) / 1e6) for c in cols}
        eh = sum(math.floor(walk(t, x, cols) * 1e9 + 0.5) for t in trees.values()) / 1e9 / len(trees)
        want[row["card_id"]] = 2.0 ** (-eh / average_path(psi)) - 0.5
    got = {r["card_id"]: (r["anomaly_score"], r["rank"]) for r in E.queries()["anomaly_scores"](spark, SF).collect()}
    assert set(got) == set(want)
    assert all(abs(round(want[c], 6) - got[c][0]) < 2e-6 for c in want)
    order = sorted(want, key=lambda c: (-want[c], c))
    assert [got[c][1] for c in order] == list(range(1, len(order) + 1))
    k = max(1, round(len(order) * TOP_PERCENT))
    top = {r["card_id"] for r in E.queries()["score_topk"](spark, SF).collect()}
    assert top == set(order[:k])
    fraud = {r["card_id"] for r in card_labels(spark, SF).filter("is_fraud = 1").collect()}
    cands = {r["card_id"] for r in E.queries()["new_candidates"](spark, SF).collect()}
    assert cands == top - fraud
    s = E.queries()["inference_summary"](spark, SF).collect()[0]
    assert (s["scored_cards"], s["top_cards"], s["new_pattern_candidates"]) == (len(want), k, len(cands))


def test_histogram_and_forest_structure(spark):
    scores = [r["anomaly_score"] for r in E.queries()["anomaly_scores"](spark, SF).collect()]
    lo, hi = min(scores), max(scores)
    width = (hi - lo) / 14
    want = {}
    for s in scores:
        b = min(int((s - lo) // width), 13) if width > 0 else 0
        want[b] = want.get(b, 0) + 1
    got = {r["bin"]: r["cards"] for r in E.queries()["score_histogram"](spark, SF).collect()}
    assert got == want
    nodes = E.queries()["forest_nodes"](spark, SF).toPandas()
    assert nodes["tree"].nunique() == FOREST.n_trees
    height = math.ceil(math.log2(FOREST.max_samples))
    for _, t in nodes.groupby("tree"):
        by_id = t.set_index("node")
        assert by_id.loc[0, "size"] <= FOREST.max_samples and t["depth"].max() <= height
        inner = t[t["feature"] >= 0]
        for r in inner.itertuples():
            assert by_id.loc[r.left, "size"] + by_id.loc[r.right, "size"] == r.size
