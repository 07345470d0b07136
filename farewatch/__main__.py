"""``python -m farewatch RAW_DIR OUT_DIR [--master local[8]]``: run the whole batch job
(ingest -> rules -> report -> labels -> features -> scores) and print the summary. Rules are chosen
with ``--rules H1,H3`` and their thresholds set with ``--set h1.threshold_raw=8``."""

from __future__ import annotations

import argparse
import ast
import dataclasses
import json

from farewatch.config import RulesConfig
from farewatch.plans.jobs import run_full_pipeline
from farewatch.session import build_session, remove_scratch


def with_settings(config: RulesConfig, settings: list[str]) -> RulesConfig:
    """``rule.parameter=value`` settings on top of a configuration; unknown names are errors."""
    for text in settings:
        name, _, value = text.partition("=")
        rule, _, key = name.strip().lower().partition(".")
        section = getattr(config, rule, None)
        if section is None or key not in {f.name for f in dataclasses.fields(section)}:
            raise ValueError(f"unknown setting: {text}")
        config = dataclasses.replace(config, **{rule: dataclasses.replace(section, **{key: ast.literal_eval(value.strip())})})
    return config


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="farewatch", description=__doc__)
    p.add_argument("raw_dir", help="folder of CSV / ZIP transaction dumps")
    p.add_argument("out_dir", help="output folder on the shared file system")
    p.add_argument("--master", default=None, help="Spark master (default: from spark-submit)")
    p.add_argument("--shuffle-partitions", type=int, default=None)
    p.add_argument("--rules", default=None, help="comma-separated rule names (default: all)")
    p.add_argument("--set", action="append", default=[], metavar="RULE.PARAMETER=VALUE", dest="settings")
    args = p.parse_args(argv)
    config = with_settings(RulesConfig(), args.settings)
    spark = build_session(args.master, args.shuffle_partitions)
    out = run_full_pipeline(spark, args.raw_dir, args.out_dir, args.rules.split(",") if args.rules else None, config)
    for row in out["full_summary"].toJSON().collect():  # one row
        print(json.dumps(json.loads(row), ensure_ascii=False))
    remove_scratch(spark)
    spark.stop()


if __name__ == "__main__":
    main()
