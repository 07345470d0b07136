"""Time the whole pipeline (tx -> rules -> report -> labels -> features -> scores) on the driver's
events replicated FACTOR times. Usage: python tools/scale_run.py SF_DIR FACTOR [CPUS] [SHUFFLE_PARTITIONS]"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from farewatch.operators import scoring as S  # noqa: E402
from farewatch.operators.dedupe import remove_near_duplicates  # noqa: E402
from farewatch.operators.features import build_features  # noqa: E402
from farewatch.operators.labels import build_card_labels  # noqa: E402
from farewatch.operators.report import aggregate_results  # noqa: E402
from farewatch.operators.rules import run_rules, union_anomalies  # noqa: E402
from farewatch.plans.tables import materialize  # noqa: E402
from farewatch.session import build_session  # noqa: E402
from farewatch.sources.fixture import replicated_events, tx_from_events  # noqa: E402


def main() -> None:
    sf_dir, factor = sys.argv[1], int(sys.argv[2])
    cpus = int(sys.argv[3]) if len(sys.argv) > 3 else 8
    partitions = int(sys.argv[4]) if len(sys.argv) > 4 else cpus * 2
    spark = build_session(f"local[{cpus}]", partitions)
    times, counts = {}, {}

    def stage(name, build):
        t0 = time.perf_counter()
        df = materialize(spark, build(), f"scale_x{factor}/{name}")
        counts[name] = df.count()
        times[name] = round(time.perf_counter() - t0, 2)
        return df

    tx_norm = stage("tx_norm", lambda: tx_from_events(replicated_events(spark, sf_dir, factor)))
    tx = stage("tx", lambda: remove_near_duplicates(tx_norm))
    anomalies = stage("anomalies", lambda: union_anomalies(run_rules(tx)))
    report = stage("report", lambda: aggregate_results(anomalies))
    labels = stage("labels", lambda: build_card_labels(tx, report))
    features = stage("features", lambda: build_features(tx_norm, labels))
    cfg = S.ForestConfig()
    nodes = stage("forest", lambda: S.train_forest(S.prepare_matrix(features, cfg.features), cfg))
    scored = stage("scored", lambda: S.score_features(features, nodes, cfg))
    stage("top", lambda: S.select_top_percent(scored))
    per_rule = {r["hypothesis"]: r["n"] for r in anomalies.groupBy("hypothesis").agg(F.count(F.lit(1)).alias("n")).collect()}
    print(json.dumps({"sf_dir": sf_dir, "factor": factor, "cpus": cpus, "shuffle_partitions": partitions,
                      "seconds": times,
                      "total_seconds": round(sum(times.values()), 2), "rows": counts, "rule_rows": per_rule}))
    spark.stop()


if __name__ == "__main__":
    main()
