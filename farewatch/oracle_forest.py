"""DuckDB SQL that grows and applies the isolation forest by itself, level by level, from its own
feature table: the same md5 draws choose the samples, split features and thresholds."""

from __future__ import annotations

import math
from dataclasses import replace

from farewatch.operators.scoring import ForestConfig

TREES_AT_MOST_DEEP = 8      # ceil(log2(256)), the configured sample size


def _unit(*parts: str) -> str:
    text = " || '|' || ".join(parts)
    return f"CAST(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE"


def forest_ctes(cfg: ForestConfig, features: str = "features") -> str:
    """CTEs ``nodes`` (the node table) and ``scored`` (features, score, rank), after ``features``."""
    assert math.ceil(math.log2(cfg.max_samples)) <= TREES_AT_MOST_DEEP
    seed = f"'{cfg.seed}'"
    x = ", ".join(map(clean, cfg.features))
    path = "CASE WHEN size <= 1 THEN 0.0::DOUBLE WHEN size = 2 THEN 1.0::DOUBLE ELSE " \
           "2.0::DOUBLE * (ln(size - 1.0::DOUBLE) + 0.5772156649015329::DOUBLE) - 2.0::DOUBLE * (size - 1.0::DOUBLE) / size END"
    out = [f"""
mx AS MATERIALIZED (SELECT card_id, [{x}] AS x FROM {features}),
pn AS MATERIALIZED (SELECT n, psi, p, least(1.0::DOUBLE, {cfg.n_trees} * p) AS q FROM (
  SELECT n, psi, CASE WHEN n > psi THEN least(1.0::DOUBLE, 2.0::DOUBLE * psi / n) ELSE 1.0::DOUBLE END AS p FROM (
    SELECT count(*) AS n, least({cfg.max_samples}, greatest(count(*), 1)) AS psi FROM mx))),
hl AS MATERIALIZED (SELECT CAST(ceil(log2(greatest(psi, 2))) AS INTEGER) AS deep FROM pn),
a0 AS MATERIALIZED (SELECT tree, card_id, 0 AS node, x FROM (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY h, card_id) AS rn FROM (
    SELECT t.tree, m.card_id, m.x, {_unit(seed, "CAST(t.tree AS VARCHAR)", "m.card_id")} AS h
    FROM mx m, (SELECT unnest(range({cfg.n_trees})) AS tree) t, pn
    WHERE {_unit(seed, "'-1'", "m.card_id")} <= pn.q)
  WHERE h <= (SELECT p / q FROM pn)) WHERE rn <= (SELECT psi FROM pn))"""]
    for d in range(TREES_AT_MOST_DEEP + 1):
        out.append(f"""
c{d} AS MATERIALIZED (SELECT tree, node, count(*) AS size FROM a{d} GROUP BY tree, node),
s{d} AS MATERIALIZED (
  SELECT tree, node, sp[1 + CAST(floor({_unit(seed, "CAST(tree AS VARCHAR)", "CAST(node AS VARCHAR)", "'f'")} * len(sp)) AS INTEGER)] AS s,
         {_unit(seed, "CAST(tree AS VARCHAR)", "CAST(node AS VARCHAR)", "'t'")} AS u
  FROM (SELECT tree, node, list({{'i': i, 'lo': lo, 'hi': hi}} ORDER BY i) AS sp FROM (
    SELECT tree, node, i, min(v) AS lo, max(v) AS hi
    FROM (SELECT tree, node, unnest(range({len(cfg.features)})) AS i, unnest(x) AS v FROM a{d}) GROUP BY tree, node, i)
    WHERE hi > lo GROUP BY tree, node)
  WHERE {d} < (SELECT deep FROM hl)),
t{d} AS MATERIALIZED (SELECT tree, node, s.i AS feature, s.lo + u * (s.hi - s.lo) AS threshold FROM s{d}),
n{d} AS MATERIALIZED (
  SELECT c.tree, c.node, coalesce(t.feature, -1) AS feature, coalesce(t.threshold, 0.0::DOUBLE) AS threshold,
         CASE WHEN t.feature IS NULL THEN -1 ELSE 2 * c.node + 1 END AS "left",
         CASE WHEN t.feature IS NULL THEN -1 ELSE 2 * c.node + 2 END AS "right", c.size, {d} AS depth
  FROM c{d} c LEFT JOIN t{d} t USING (tree, node)),
a{d + 1} AS MATERIALIZED (
  SELECT a.tree, a.card_id, CASE WHEN a.x[t.feature + 1] < t.threshold THEN 2 * a.node + 1 ELSE 2 * a.node + 2 END AS node, a.x
  FROM a{d} a JOIN t{d} t USING (tree, node))""")
    every = " UNION ALL ".join(f"SELECT * FROM n{d}" for d in range(TREES_AT_MOST_DEEP + 1))
    out.append(f"""
nodes AS MATERIALIZED (SELECT CAST(tree AS INTEGER) AS tree, CAST(node AS INTEGER) AS node, CAST(feature AS INTEGER) AS feature, threshold,
                              CAST("left" AS INTEGER) AS "left", CAST("right" AS INTEGER) AS "right", CAST(size AS INTEGER) AS size,
                              CAST(depth AS INTEGER) AS depth FROM ({every})),
w0 AS MATERIALIZED (SELECT card_id, x, tree, 0 AS node FROM mx, (SELECT DISTINCT tree FROM nodes))""")
    for d in range(TREES_AT_MOST_DEEP):
        out.append(f"""
w{d + 1} AS MATERIALIZED (
  SELECT w.card_id, w.x, w.tree, CASE WHEN n.feature < 0 THEN w.node WHEN w.x[n.feature + 1] < n.threshold THEN n."left" ELSE n."right" END AS node
  FROM w{d} w JOIN nodes n USING (tree, node))""")
    out.append(f"""
e AS (SELECT card_id, sum(CAST(floor((n.depth + {path}) * 1e9::DOUBLE + 0.5::DOUBLE) AS BIGINT)) AS units
      FROM w{TREES_AT_MOST_DEEP} w JOIN nodes n USING (tree, node) GROUP BY card_id),
cn AS (SELECT {path} AS c FROM (SELECT max(size) AS size FROM nodes WHERE node = 0)),
scored AS MATERIALIZED (
  SELECT f.*, CASE WHEN c > 0 THEN pow(2.0::DOUBLE, -(CAST(units AS DOUBLE) / 1e9::DOUBLE / {cfg.n_trees}) / c) ELSE 0.5::DOUBLE END - 0.5::DOUBLE AS anomaly_score,
         row_number() OVER (ORDER BY units, f.card_id) AS rank, '{cfg.model_name}' AS model
  FROM {features} f JOIN e USING (card_id), cn)""")
    return ",".join(out)


def clean(c: str) -> str:
    return (f"CASE WHEN {c} IS NULL OR isnan(CAST({c} AS DOUBLE)) OR isinf(CAST({c} AS DOUBLE)) THEN 0.0::DOUBLE "
            f"ELSE floor(CAST({c} AS DOUBLE) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE END")


def bundle_ctes(cfg: ForestConfig, contamination: float, features: str = "features") -> str:
    """CTEs ``fitted`` (one row: m and s of each column), ``scaled``, the forest on it, and ``cut`` (the offset)."""
    six = "floor({} * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE"
    stats = ", ".join(f"coalesce({six.format(f'avg({clean(c)})')}, 0.0::DOUBLE) AS m{k}, "
                      f"coalesce(nullif({six.format(f'stddev_pop({clean(c)})')}, 0.0::DOUBLE), 1.0::DOUBLE) AS s{k}" for k, c in enumerate(cfg.features))
    scaled = ", ".join(f"(({clean(c)}) - m{k}) / s{k} AS {c}" for k, c in enumerate(cfg.features))
    out = "', '".join(map(str, cfg.excluded_cats))
    return f"""
outside AS MATERIALIZED (SELECT * FROM {features} WHERE NOT coalesce(CAST(dominant_cat AS VARCHAR) IN ('{out}'), false)),
fitted AS MATERIALIZED (SELECT {stats} FROM outside),
scaled AS MATERIALIZED (SELECT card_id, {scaled} FROM outside, fitted),
{forest_ctes(cfg, "scaled")},
cut AS MATERIALIZED (SELECT quantile_cont(-(anomaly_score + 0.5::DOUBLE), {contamination}::DOUBLE) AS off FROM scored)"""


VIEW = ("card_id, rank, round(anomaly_score, 6) AS anomaly_score, tx_count, active_days, unique_routes, unique_terminals, segment, model")


def queries(features: str, cfg: ForestConfig, top_percent: float, bins: int) -> dict[str, str]:
    """SQL of the model-dependent queries; ``features`` are the CTEs up to ``features`` and ``labels``."""
    base = features + "," + forest_ctes(cfg)
    top = base + f""",
tops AS (SELECT *, 1 AS ml_fraud_flag FROM scored
         WHERE rank <= (SELECT greatest(1, CAST(round_even(count(*) * {top_percent}::DOUBLE, 0) AS BIGINT)) FROM scored)),
news AS (SELECT * FROM tops WHERE card_id NOT IN (SELECT card_id FROM labels WHERE is_fraud = 1))"""
    fit = replace(cfg, excluded_cats=("207",), model_name="isolation_forest_bundle")
    fitted = features + "," + bundle_ctes(fit, top_percent)
    columns = " UNION ALL ".join(f"SELECT {k} AS position, '{c}' AS feature, m{k} AS mean, s{k} AS scale FROM fitted" for k, c in enumerate(cfg.features))
    return {
        "anomaly_scores": base + f" SELECT {VIEW} FROM scored",
        "bundle_scores": fitted + """
SELECT f.card_id, rank, round(anomaly_score + 0.5::DOUBLE + off, 6) AS anomaly_score, f.tx_count, f.active_days, f.unique_routes, f.unique_terminals,
       f.segment, model, round(anomaly_score + 0.5::DOUBLE + off, 6) > 0 AS flagged
FROM scored JOIN features f USING (card_id), cut""",
        "model_bundle": fitted + f" SELECT position, feature, mean, scale, round(off, 6) AS \"offset\" FROM ({columns}), cut",
        "score_topk": top + f" SELECT {VIEW}, ml_fraud_flag FROM tops",
        "new_candidates": top + f" SELECT {VIEW}, ml_fraud_flag FROM news",
        "inference_summary": top + f"""
SELECT '{cfg.model_name}' AS model_name, (SELECT count(*) FROM scored) AS scored_cards, {top_percent}::DOUBLE AS top_percent,
       (SELECT count(*) FROM tops) AS top_cards, (SELECT count(*) FROM tops) - (SELECT count(*) FROM news) AS known_fraud_excluded,
       (SELECT count(*) FROM news) AS new_pattern_candidates""",
        "score_histogram": base + f""",
r AS (SELECT min(anomaly_score) AS lo, (max(anomaly_score) - min(anomaly_score)) / {bins} AS width FROM scored),
b AS (SELECT anomaly_score, CAST(CASE WHEN width > 0 THEN least(floor((anomaly_score - lo) / width), {bins - 1}) ELSE 0 END AS INTEGER) AS bin FROM scored, r)
SELECT bin, count(*) AS cards, round(min(anomaly_score), 6) AS bin_min, round(max(anomaly_score), 6) AS bin_max FROM b GROUP BY bin""",
        "forest_nodes": base + " SELECT * FROM nodes",
    }
