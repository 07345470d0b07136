"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line.

Each query is timed from DataFrame construction to the end of a full write-free action
(``count`` over all result rows after forcing every column through ``sum(hash(*))``), in
pipeline order, so shared stages (de-duplicated transactions, anomalies, report, labels,
features) are paid once, by the first query that needs them, as in a real run. A trivial
untimed job warms the JVM first; session start-up is not timed."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from farewatch.plans.queries import QUERIES  # noqa: E402
from farewatch.session import build_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(f"local[{cpus}]", max(cpus, 4))
    # untimed JVM warm-up on a trivial job (class loading, first codegen); all real work is timed
    spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count().collect()
    names = sys.argv[1:] or list(QUERIES)
    times: dict[str, float] = {}
    rows: dict[str, int] = {}
    for name in names:
        t0 = time.perf_counter()
        df = QUERIES[name](spark, sf_dir)
        r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.hash(*df.columns)).alias("h")).collect()[0]
        times[name] = round(time.perf_counter() - t0, 3)
        rows[name] = int(r["n"])
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "rows": rows,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
