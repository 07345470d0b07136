"""Registered queries: one per operator family, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the driver tables (through ``plans.tables``) over whole tables. Outputs use
plain column types (text for timestamps) so they compare cleanly with the SQL oracle."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farewatch.config import H1Config, RulesConfig
from farewatch.functions.time import iso_text
from farewatch.operators import model_bundle
from farewatch.operators import presentation as P
from farewatch.operators import scoring as S
from farewatch.operators.features import DOUBLE_FEATURES, FAMILIES, build_features, feature_rows_raw
from farewatch.operators.labels import build_card_labels, load_labels
from farewatch.operators.normalize import normalize_transactions
from farewatch.operators.report import aggregate_results, export_anomalies, hypothesis_stats, top_entities
from farewatch.operators.rules import RULES, run_rules, union_anomalies
from farewatch.operators.rules.frequency import h20_duplicates, service_cards
from farewatch.plans import tables
from farewatch.session import prepare, scratch_folder
from farewatch.sources.dump_fixture import write_dump
from farewatch.sources.raw_files import read_raw_with_rejects
from farewatch.streaming.bursts import run_burst_rule_stream, run_burst_stream
from farewatch.streaming.rules import run_daily_trips, run_near_dedup, run_school_sessions

Query = Callable[[SparkSession, str], DataFrame]
CFG = RulesConfig()


def _tx_view(df: DataFrame) -> DataFrame:
    return df.select(
        "card", "trm_id", "route_num", "trc_id", "cat", "cat_num", F.col("summ_num").cast("bigint").alias("summ_num"),
        iso_text("dt").alias("dt"), F.col("date").cast("string").alias("date"),
        "hour", "minute", "second", "weekday", "src_row",
    )


def q_tx_normalize(spark, sf):
    return _tx_view(normalize_transactions(tables.raw(spark, sf)))


def q_tx_near_dedup(spark, sf):
    return _tx_view(tables.tx(spark, sf))


def q_tx_summary(spark, sf):
    t = tables.tx(spark, sf)
    return t.agg(
        F.count(F.lit(1)).alias("transactions"),
        iso_text(F.min("dt")).alias("period_start"),
        iso_text(F.max("dt")).alias("period_end"),
        F.countDistinct("card").alias("cards"),
        F.countDistinct("trm_id").alias("validators"),
        F.countDistinct("route_num").alias("routes"),
        F.countDistinct("cat_num").alias("categories"),
    )


def q_service_cards(spark, sf):
    return service_cards(tables.tx(spark, sf), H1Config().service_card_threshold)


def _rule(name: str) -> Query:
    def q(spark, sf):
        return run_rules(tables.tx(spark, sf), [name], CFG)[name]
    q.__name__ = f"rule_{name.lower()}"
    return q


def q_rule_h20_raw(spark, sf):
    """H20 on normalised rows before de-duplication (where same-second copies still exist)."""
    return h20_duplicates(tables.tx_norm(spark, sf), CFG.h20).withColumn("hypothesis", F.lit("H20r"))


def anomalies_all(spark, sf) -> DataFrame:
    return tables.shared(spark, sf, "anomalies",
                         lambda: union_anomalies(run_rules(tables.tx(spark, sf), None, CFG)))


def risk_report(spark, sf) -> DataFrame:
    return tables.shared(spark, sf, "report", lambda: aggregate_results(anomalies_all(spark, sf)))


def q_anomalies_all(spark, sf):
    return export_anomalies(anomalies_all(spark, sf))


def q_anomaly_stats(spark, sf):
    return hypothesis_stats(spark, anomalies_all(spark, sf), list(RULES))


def q_risk_levels(spark, sf):
    return P.risk_level_counts(spark, risk_report(spark, sf))


def q_risk_histogram(spark, sf):
    return P.risk_histogram(spark, risk_report(spark, sf))


def q_entities_per_rule(spark, sf):
    return P.entities_per_rule(risk_report(spark, sf))


def q_kpi(spark, sf):
    return P.kpi(risk_report(spark, sf), anomalies_all(spark, sf))


def q_top_cards(spark, sf):
    return top_entities(risk_report(spark, sf), ["card"])


def q_top_validators(spark, sf):
    return top_entities(risk_report(spark, sf), ["validator"])


def q_top_filtered(spark, sf):
    """Top-20 per type after filtering by rules H1 / H3 (dashboard filter + tables)."""
    return top_entities(P.filter_by_rules(risk_report(spark, sf), ["H1", "H3"]))


def q_action_high(spark, sf):
    return P.action_list(risk_report(spark, sf), "high")


def q_action_medium(spark, sf):
    return P.action_list(risk_report(spark, sf), "medium")


def q_action_validators(spark, sf):
    return P.action_list(risk_report(spark, sf), "validators")


def q_filter_by_rules(spark, sf):
    return P.filter_by_rules(risk_report(spark, sf), ["H4", "H8"])


QUERIES: dict[str, Query] = {
    "tx_normalize": q_tx_normalize,
    "tx_near_dedup": q_tx_near_dedup,
    "tx_summary": q_tx_summary,
    "service_cards": q_service_cards,
    **{f"rule_{n.lower()}": _rule(n) for n in RULES},
    "rule_h2_daily": _rule("H2d"),
    "rule_h4_sessions": _rule("H4s"),
    "rule_h8_sessions": _rule("H8s"),
    "rule_h20_raw": q_rule_h20_raw,
    "rule_h21_ks": _rule("H21k"),
    "anomalies_all": q_anomalies_all,
    "anomaly_stats": q_anomaly_stats,
    "risk_report": risk_report,
    "risk_levels": q_risk_levels,
    "risk_histogram": q_risk_histogram,
    "entities_per_rule": q_entities_per_rule,
    "kpi": q_kpi,
    "top_cards": q_top_cards,
    "top_validators": q_top_validators,
    "top_filtered": q_top_filtered,
    "action_list_high": q_action_high,
    "action_list_medium": q_action_medium,
    "action_list_validators": q_action_validators,
    "filter_by_rules": q_filter_by_rules,
}


# ---- labels and features --------------------------------------------------------------------


def card_labels(spark, sf) -> DataFrame:
    return tables.shared(spark, sf, "labels", lambda: build_card_labels(tables.tx(spark, sf), risk_report(spark, sf)))


def features(spark, sf) -> DataFrame:
    return tables.shared(spark, sf, "features",
                         lambda: build_features(tables.tx_norm(spark, sf), card_labels(spark, sf)))


def _family(cols: list[str]) -> Query:
    def q(spark, sf):
        f = features(spark, sf)
        return f.select(*[F.round(F.col(c).cast("double"), 6).alias(c) if c in DOUBLE_FEATURES else F.col(c)
                          for c in cols])
    return q


def q_labels_loaded(spark, sf):
    """A label file with padded ids and a second, contradicting row per card, loaded: the first row counts."""
    twice = F.explode(F.array(F.col("is_fraud"), 1 - F.col("is_fraud")))
    return load_labels(card_labels(spark, sf).select(F.concat(F.lit(" "), "card_id").alias("card_id"), twice.alias("is_fraud")))


def q_feat_raw_view(spark, sf):
    """The feature loader's rows of raw text in which every 97th tap has no validator and every
    89th no card: such rows stay, with an empty id."""
    raw = tables.raw(spark, sf)
    blank = lambda c, n: F.when(F.col("_src_row") % n != 0, F.col(f"`{c}`")).alias(c)
    raw = raw.select(*[blank(c, {"TRM_ID ": 97, "Card": 89}[c]) if c in ("TRM_ID ", "Card") else F.col(f"`{c}`") for c in raw.columns])
    return feature_rows_raw(raw).select("card_id", "terminal_id", "route_num", "carrier_id", "cat", "amount_kop", iso_text("date").alias("dt"),
                                        F.col("day").cast("string").alias("day"), "hour", "weekday", "src_row")


QUERIES["card_labels"] = card_labels
QUERIES["labels_loaded"] = q_labels_loaded
QUERIES["feat_raw_view"] = q_feat_raw_view
for _name, _cols in FAMILIES.items():
    QUERIES[_name] = _family(_cols)


# ---- scoring ----------------------------------------------------------------------------------

FOREST = S.ForestConfig()
TOP_PERCENT = 0.01
SCORE_BINS = 14
TOP_SEGMENTS = 8


def forest(spark, sf) -> DataFrame:
    return tables.shared(spark, sf, "forest",
                         lambda: S.train_forest(S.prepare_matrix(features(spark, sf), FOREST.features), FOREST))


def scored(spark, sf) -> DataFrame:
    return tables.shared(spark, sf, "scored", lambda: S.score_features(features(spark, sf), forest(spark, sf), FOREST))


_BUNDLES: dict = {}
BUNDLE_EXCLUDED = ("207",)


def bundle(spark, sf) -> model_bundle.Bundle:
    """The fitted model of a folder's cards, saved and loaded once per session."""
    key = (spark.sparkContext.applicationId, sf.rstrip("/"))
    if key not in _BUNDLES:
        cfg = replace(FOREST, excluded_cats=BUNDLE_EXCLUDED, model_name="isolation_forest_bundle")
        _BUNDLES[key] = model_bundle.fit(features(spark, sf), cfg, scratch_folder(spark, "model"), TOP_PERCENT)
    return _BUNDLES[key]


def q_bundle_scores(spark, sf):
    """Scores of a loaded bundle: standardised inputs, offset at the top share's quantile."""
    out = model_bundle.score(features(spark, sf), bundle(spark, sf))
    return _score_view(out).withColumn("flagged", F.col("anomaly_score") > 0)


def q_model_bundle(spark, sf):
    """What the bundle holds: mean and scale of each column, the offset."""
    out = model_bundle.summary(bundle(spark, sf))
    return out.withColumn("offset", F.round("offset", 6))


def top_cards_ml(spark, sf) -> DataFrame:
    return S.select_top_percent(scored(spark, sf), TOP_PERCENT)


def candidates(spark, sf) -> DataFrame:
    return S.new_pattern_candidates(top_cards_ml(spark, sf), card_labels(spark, sf))


def _score_view(df: DataFrame) -> DataFrame:
    cols = ["card_id", "rank", "anomaly_score", "tx_count", "active_days", "unique_routes", "unique_terminals",
            "segment", "model"] + (["ml_fraud_flag"] if "ml_fraud_flag" in df.columns else [])
    return df.select(*[F.round("anomaly_score", 6).alias(c) if c == "anomaly_score" else F.col(c) for c in cols])


def q_scores(spark, sf):
    return _score_view(scored(spark, sf))


def q_score_topk(spark, sf):
    return _score_view(top_cards_ml(spark, sf))


def q_new_candidates(spark, sf):
    """Candidate export projection (top share minus cards the rules already label)."""
    return _score_view(candidates(spark, sf))


def q_inference_summary(spark, sf):
    s = scored(spark, sf)
    top = top_cards_ml(spark, sf)
    return S.inference_summary(s, top, S.new_pattern_candidates(top, card_labels(spark, sf)), FOREST, TOP_PERCENT)


def q_segment_counts(spark, sf):
    """Scored cards per segment, largest first, at most eight segments."""
    c = scored(spark, sf).groupBy("segment").agg(F.count(F.lit(1)).alias("cards"))
    return c.orderBy(F.desc("cards"), F.asc("segment")).limit(TOP_SEGMENTS)


def q_score_histogram(spark, sf):
    """``SCORE_BINS`` equal-width bins between the lowest and highest score."""
    s = scored(spark, sf)
    lo = s.agg(F.min("anomaly_score")).scalar()
    hi = s.agg(F.max("anomaly_score")).scalar()
    width = (hi - lo) / SCORE_BINS
    b = F.when(width > 0, F.least(F.floor((F.col("anomaly_score") - lo) / width), F.lit(SCORE_BINS - 1))) \
        .otherwise(F.lit(0)).cast("int")
    return s.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("cards"),
                                         F.round(F.min("anomaly_score"), 6).alias("bin_min"),
                                         F.round(F.max("anomaly_score"), 6).alias("bin_max"))


def q_forest_nodes(spark, sf):
    return forest(spark, sf)


QUERIES.update({
    "anomaly_scores": q_scores,
    "score_topk": q_score_topk,
    "new_candidates": q_new_candidates,
    "inference_summary": q_inference_summary,
    "segment_counts": q_segment_counts,
    "score_histogram": q_score_histogram,
    "forest_nodes": q_forest_nodes,
    "bundle_scores": q_bundle_scores,
    "model_bundle": q_model_bundle,
})


# ---- raw file ingest --------------------------------------------------------------------------


_DUMPS: dict = {}


def raw_dump(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of the fixture's raw dump folder, written and read once per session."""
    key = (spark.sparkContext.applicationId, sf.rstrip("/"))
    if key not in _DUMPS:
        _DUMPS[key] = read_raw_with_rejects(spark, write_dump(spark, sf, scratch_folder(spark, "raw-dump")))
    return _DUMPS[key]


def q_raw_csv_ingest(spark, sf):
    """One folder of mixed charsets, separators, duplicate files and archives, normalised."""
    tx = normalize_transactions(raw_dump(spark, sf)[0])
    return tx.select("card", "trm_id", "route_num", "trc_id", "cat", "cat_num", F.col("summ_num").cast("double").alias("summ_num"),
                     iso_text("dt").alias("dt"), F.col("date").cast("string").alias("date"), "hour", "minute", "second",
                     "weekday", "vehicle")


def q_raw_rejects(spark, sf):
    """What the dump's files and archives did not deliver as it stood: rows by their width, members."""
    rejects = raw_dump(spark, sf)[1]
    suffix = F.lower(F.substring_index("archive", ".", -1))
    source = F.when(suffix.startswith("zip"), "zip").otherwise("csv")          # split files carry an offset after the path
    error = F.when(F.col("error").startswith("row:"), F.col("error")).otherwise(F.split_part("error", F.lit(":"), F.lit(1)))
    return rejects.groupBy(source.alias("source"), "member", error.alias("error")).agg(F.count(F.lit(1)).alias("n"))


QUERIES["raw_csv_ingest"] = q_raw_csv_ingest
QUERIES["raw_rejects"] = q_raw_rejects


# ---- streaming ---------------------------------------------------------------------------------


def q_stream_bursts(spark, sf):
    """Bursts found by the streaming replay of the events folder, completed at its end."""
    out = run_burst_stream(spark, sf, name=_stream_name("x1", sf))
    return out.withColumn("time_window", iso_text("time_window"))


def q_stream_bursts_rule(spark, sf):
    """The whole burst rule from its streams: service cards withdrawn, first five cards."""
    out = run_burst_rule_stream(spark, sf, _stream_name("x1r", sf))
    return out.select("trm_id", iso_text("time_window").alias("time_window"), "tx_count", "unique_cards", F.array_join("sample_cards", ",").alias("sample_cards"))


QUERIES["stream_bursts"] = q_stream_bursts
QUERIES["stream_bursts_rule"] = q_stream_bursts_rule


def _stream_name(kind: str, sf: str) -> str:
    return f"{kind}_{hashlib.sha1(sf.encode()).hexdigest()[:8]}"


def q_stream_daily_trips(spark, sf):
    """X2: card-days with at least the raw H1 threshold, from the event stream."""
    return run_daily_trips(spark, sf, _stream_name("x2", sf)).withColumn("date", F.col("date").cast("string"))


def q_stream_near_dedup(spark, sf):
    """X3: taps kept by the stateful 2-second rule (equals ``tx_near_dedup`` keys)."""
    return run_near_dedup(spark, sf, _stream_name("x3", sf)).withColumn("dt", iso_text("dt"))


def q_stream_school_sessions(spark, sf):
    """X4: school-card sessions per (card, validator) from ``session_window``."""
    return run_school_sessions(spark, sf, _stream_name("x4", sf)).withColumn("start_time", iso_text("start_time"))


QUERIES.update({
    "stream_daily_trips": q_stream_daily_trips,
    "stream_near_dedup": q_stream_near_dedup,
    "stream_school_sessions": q_stream_school_sessions,
})


def _prepared(fn: Query) -> Query:
    def run(spark, sf):
        prepare(spark)
        return fn(spark, sf)
    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


QUERIES = {name: _prepared(fn) for name, fn in QUERIES.items()}
