"""Plan checks: the physical plans keep the properties the design relies on."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as E
from farewatch.operators import features as FE
from farewatch.operators.dedupe import remove_near_duplicates
from farewatch.operators.features import build_features
from farewatch.operators.rules import RULES, run_rules
from farewatch.plans import tables
from farewatch.plans.queries import card_labels

SF = "/root/testdata/sf0.001"
PYTHON_NODES = ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "PythonUDF")
PYTHON_ALLOWED = {"anomaly_scores", "score_topk", "new_candidates", "inference_summary", "score_histogram",
                  "forest_nodes", "segment_counts"}


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def tree(df):
    """(depth, node text) of the initial physical plan, top down."""
    out = []

    def walk(node, depth):
        out.append((depth, node.nodeName(), node.simpleString(200)))
        kids = node.children()
        for i in range(kids.size()):
            walk(kids.apply(i), depth + 1)
    plan = df._jdf.queryExecution().executedPlan()
    walk(plan.initialPlan() if plan.nodeName().startswith("AdaptiveSparkPlan") else plan, 0)
    return out


def single_partition_consumers(df) -> list[str]:
    """The operators that read a single-partition exchange (through sorts)."""
    nodes = tree(df)
    out = []
    for k, (depth, _, text) in enumerate(nodes):
        if "Exchange SinglePartition" in text:
            d = depth
            for j in range(k - 1, -1, -1):
                if nodes[j][0] < d:
                    d = nodes[j][0]
                    if not nodes[j][1].startswith(("Sort", "WholeStageCodegen", "InputAdapter", "Project")):
                        out.append(nodes[j][1])
                        break
    return out


def transactions(spark):
    return tables.tx_norm(spark, SF)


def test_checker_sees_a_global_window(spark):
    bad = transactions(spark).withColumn("n", F.row_number().over(Window.orderBy("dt")))
    assert single_partition_consumers(bad) == ["Window"]


def test_operators_gather_only_global_aggregates(spark):
    tx = transactions(spark)
    frames = [remove_near_duplicates(tx), build_features(tx, card_labels(spark, SF)), *run_rules(tx, list(RULES)).values()]
    for df in frames:
        for node in single_partition_consumers(df):
            assert "Aggregate" in node or "Limit" in node or "TakeOrdered" in node, node
        assert "CartesianProduct" not in physical(df)


def test_stray_python(spark):
    for name, fn in E.queries().items():
        if name in PYTHON_ALLOWED or name.startswith(("op", "pipeline")):
            continue
        assert not any(node in physical(fn(spark, SF)) for node in PYTHON_NODES), name


def full_row_exchanges(plan):
    return sum("Exchange hashpartitioning" in line or "Exchange rangepartitioning" in line for line in plan.splitlines())


@pytest.mark.parametrize("hot", [False, True])
def test_previous_row_shuffles_its_input_once(spark, tmp_path, hot, monkeypatch):
    """With broadcasts off, the whole plan, joins included: every row is exchanged once. Without a hot
    key that is all; with one, the frame is written and only its buckets' borders are joined."""
    from farewatch.functions import ordered
    path = str(tmp_path / "t")
    tx = transactions(spark)
    if hot:
        tx = tx.withColumn("card", F.when(F.col("src_row") % 3 == 0, "HOT").otherwise(F.col("card")))
    else:
        # no card holds a share worth splitting
        tx = tx.withColumn("card", F.concat("card", F.lit("-"), (F.col("src_row") % 97).cast("string")))
    tx.write.parquet(path)
    seen, keep = [], ordered.written
    monkeypatch.setattr(ordered, "written", lambda df, label: seen.append(df) or keep(df, label))
    before = set(threshold(spark, "-1"))
    try:
        source = spark.read.parquet(path)
        for fn in (lambda: ordered.with_previous(source, ["card"], "dt", ["src_file", "src_row"], ["trm_id"], bucket_seconds=86_400 * 3),
                   lambda: ordered.carry_forward_last(source, ["card"], "dt", ["src_file", "src_row"], F.col("hour") > 12, F.col("hour"), "h",
                                                              bucket_seconds=86_400 * 3)):
            seen.clear()
            out = fn()
            if not hot:
                plan = physical(out)
                assert not seen and full_row_exchanges(plan) == 1 and plan.count("FileScan") == 1
                continue
            first = physical(seen[0])
            assert len(seen) == 1 and full_row_exchanges(first) == 1 and first.count("FileScan") == 1
            plan = physical(out)
            assert path not in plan                                        # the input is not read again
            assert plan.startswith(("AdaptiveSparkPlan", "Union")) and "Exchange" not in plan.split("FileScan")[0]   # the big branch
            # what is exchanged afterwards: the rows at the borders, and one row per bucket of the hot key
            inner = keep(seen[0], "again")
            n = inner.count()
            assert inner.where("_edge").count() < n / 5 and inner.where("_b is not null").select("_b").distinct().count() < n / 5
    finally:
        threshold(spark, next(iter(before)))


def threshold(spark, value):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", value)
    return [old]


def test_feature_aggregates_never_cluster_by_card_alone_before_the_fold(spark):
    rows = FE.feature_rows(transactions(spark))
    plan = physical(FE._dim_features(FE.card_grain(rows)))
    # grain, (card, dim, value), (card, dim), then one small row per (card, dim) by card
    keys = [line.split("hashpartitioning(")[1] for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(keys) == 4 and sum(k.startswith("card_id") and k.count("#") <= 2 and "dim" not in k for k in keys) == 1, keys
    assert "REPARTITION" not in plan


def test_all_rules_together_read_the_table_five_times(spark, tmp_path):
    """Two shared passes, H3, H4 and H20; everything else comes from what the passes wrote."""
    from farewatch.functions import ordered
    from farewatch.operators.rules import taps, union_anomalies
    path = str(tmp_path / "tx")
    transactions(spark).write.parquet(path)
    executed, keep = [], ordered.written

    def recorded(df, label):
        out = keep(df, label)
        executed.append(df)
        return out
    ordered.written = taps.written = recorded
    try:
        result = union_anomalies(run_rules(spark.read.parquet(path), list(RULES)))
        result.collect()
    finally:
        ordered.written = taps.written = keep
    scans = 0
    for df in [*executed, result]:
        if df is not result:
            df.collect()
        plan = physical(df)
        final = plan.split("== Initial Plan ==")[0]
        scans += sum("FileScan" in line and path in line for line in final.splitlines())
    assert scans <= 5, scans


def test_exploded_dimensions_never_leave_their_task(spark, monkeypatch):
    """The feature table counts fifteen rows a tap where the card's taps are: no exchange and no sort of them."""
    from farewatch.operators import features as FE
    seen = {}

    def keep(df, label):
        seen[label] = df
        return df
    monkeypatch.setattr(FE, "written", keep)
    rows = tables.tx_norm(spark, SF)
    FE.build_features(rows, rows.select(F.col("card").alias("card_id")).distinct())
    plan = physical(seen["card-features"])
    assert "Generate explode" in plan and "hashpartitioning(card_id" in plan
    assert not [line for line in plan.splitlines() if ("Exchange" in line or "Sort" in line) and " dim#" in line.replace("[", " ").replace(",", " ").replace("(", " ")]
