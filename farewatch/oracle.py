"""Independent DuckDB SQL for every registered query (the correctness oracle).

Each rule is a self-contained ``WITH ... SELECT`` over the CTEs ``tx`` (normalised) and ``dd``
(de-duplicated, reference formulation: exact distinct, then ``lag``) from ``oracle_ctes``."""

from __future__ import annotations

from farewatch.operators.features import DOUBLE_FEATURES, FAMILIES
from farewatch.operators.scoring import ForestConfig
from farewatch.oracle_ctes import with_tx
from farewatch.oracle_forest import forest_ctes
from farewatch.oracle_forest import queries as forest_queries

BENEFIT = "201, 202, 203, 204, 205, 206, 207, 208, 209, 210, 303, 304"
SCHOOL = "203, 208, 209, 303"
KNOWN = "91, 92, 93, 151, 201, 202, 203, 204, 205, 206, 207, 208, 209, 210, 303, 304"


def iso(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%dT%H:%M:%S')"


def day(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d')"


def jstr(x: str) -> str:
    return f"'\"' || {x} || '\"'"


def jlist(x: str) -> str:
    return f"'[' || array_to_string(list_transform({x}, lambda v: '\"' || v || '\"'), ',') || ']'"


def cols(h, et, eid, adate, sdate, metric, value, thr, sev, det) -> str:
    return (f"'{h}' AS hypothesis, {et} AS entity_type, CAST({eid} AS VARCHAR) AS entity_id, {adate} AS anomaly_date, "
            f"{sdate} AS seen_date, '{metric}' AS metric_name, CAST({value} AS DOUBLE) AS metric_value, "
            f"CAST({thr} AS VARCHAR) AS threshold_value, {sev} AS severity, {det} AS details")


RULE_SQL: dict[str, str] = {}

RULE_SQL["H1"] = f"""
WITH daily AS (SELECT card, date, count(*) AS n FROM dd GROUP BY card, date),
svc AS (SELECT card FROM daily GROUP BY card HAVING max(n) > 12),
lv AS (SELECT * FROM (VALUES ('raw', 6), ('strong', 12)) t(sev, thr))
SELECT {cols('H1', "'card'", 'card', day('date'), day('date'), 'trips_per_day', 'n', 'thr', 'sev',
             "'{\"card\":' || " + jstr('card') + " || '}'")}
FROM daily JOIN lv ON n >= thr WHERE NOT EXISTS (SELECT 1 FROM svc WHERE svc.card = daily.card)
"""

RULE_SQL["H2"] = f"""
WITH flow AS (SELECT route_num, weekday, hour, count(*) AS flow FROM dd WHERE route_num IS NOT NULL GROUP BY ALL),
base AS (SELECT route_num, weekday, hour, median(flow::DOUBLE) AS med FROM flow GROUP BY ALL),
r AS (SELECT f.*, b.med, f.flow / b.med AS excess FROM flow f JOIN base b USING (route_num, weekday, hour)),
lv AS (SELECT * FROM (VALUES ('raw', 3), ('strong', 5)) t(sev, thr))
SELECT {cols('H2', "'route'", 'route_num', "'weekday=' || weekday || ', hour=' || hour",
             "'weekday=' || weekday || ', hour=' || hour", 'flow_excess', 'round_even(excess * 100, 0) / 100',
             'thr', 'sev', "'{\"flow\":' || flow || ',\"median\":' || CAST(round_even(med, 0) AS BIGINT) || '}'")}
FROM r JOIN lv ON excess >= thr AND med > 0
"""

RULE_SQL["H2d"] = f"""
WITH cells AS (SELECT route_num, date, weekday, hour, count(*) AS flow FROM dd WHERE route_num IS NOT NULL GROUP BY ALL),
r AS (SELECT *, median(flow::DOUBLE) OVER (PARTITION BY route_num, weekday, hour) AS med FROM cells),
lv AS (SELECT * FROM (VALUES ('raw', 3), ('strong', 5)) t(sev, thr))
SELECT {cols('H2d', "'route'", 'route_num', iso("CAST(date AS TIMESTAMP) + to_hours(hour)"), day('date'),
             'flow_excess', 'round_even(flow / med * 100, 0) / 100', 'thr', 'sev',
             "'{\"flow\":' || flow || ',\"median\":\"' || printf('%.1f', med) || '\"}'")}
FROM r JOIN lv ON flow / med >= thr AND med > 0
"""

RULE_SQL["H3"] = f"""
WITH daily AS (SELECT card, date, count(*) AS n FROM dd GROUP BY card, date),
svc AS (SELECT DISTINCT card FROM daily WHERE n > 12),
t AS (SELECT * FROM dd WHERE NOT EXISTS (SELECT 1 FROM svc WHERE svc.card = dd.card)),
b AS (SELECT trm_id, dt AS tw, count(*) AS tx_count, count(DISTINCT card) AS unique_cards,
             list_sort(list_distinct(list(card)))[1:5] AS sample
      FROM t GROUP BY trm_id, dt HAVING count(*) >= 3 AND count(DISTINCT card) >= 2),
lv AS (SELECT * FROM (VALUES ('raw', 3), ('strong', 5)) t(sev, thr))
SELECT {cols('H3', "'validator'", 'trm_id', iso('tw'), day('tw'), 'tx_per_sec', 'tx_count', 'thr', 'sev',
             "'{\"unique_cards\":' || unique_cards || ',\"sample_cards\":' || " + jlist('sample') + " || '}'")}
FROM b JOIN lv ON tx_count >= thr
"""

_H4_STEPS = f"""
s AS (SELECT trm_id, card, dt, hour, cat_num IN ({BENEFIT}) AS b FROM dd),
l AS (SELECT *, lag(b) OVER w AS pb, lag(dt) OVER w AS pdt FROM s WINDOW w AS (PARTITION BY trm_id ORDER BY dt, card)),
st AS (SELECT *, coalesce(b AND pb AND date_diff('second', pdt, dt) < 60 AND (hour >= 22 OR hour < 6), false) AS q FROM l)
"""


def _h4_out(name: str, keys: str) -> str:
    return f"""
g AS (SELECT {keys}, count(*) AS n, min(dt) AS st FROM qq GROUP BY {keys} HAVING count(*) >= 3),
fc AS (SELECT {keys}, card, min(dt) AS fdt FROM qq GROUP BY {keys}, card),
cs AS (SELECT {keys}, list(card ORDER BY fdt, card)[1:5] AS cards FROM fc GROUP BY {keys})
SELECT {cols(name, "'validator'", 'trm_id', iso('st'), day('st'), 'benefit_series_length', 'n', "'3'", "'strong'",
             "'{\"cards\":' || " + jlist('cards') + " || '}'")}
FROM g JOIN cs USING ({keys})
"""


RULE_SQL["H4"] = "WITH " + _H4_STEPS + ", qq AS (SELECT * FROM st WHERE q)," + _h4_out("H4", "trm_id")
RULE_SQL["H4s"] = ("WITH " + _H4_STEPS + """,
sess AS (SELECT *, sum(CASE WHEN q THEN 0 ELSE 1 END) OVER (PARTITION BY trm_id ORDER BY dt, card
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM st),
qq AS (SELECT * FROM sess WHERE q),""" + _h4_out("H4s", "trm_id, sid"))

RULE_SQL["H7"] = f"""
SELECT {cols('H7', "'card'", 'card', iso('dt'), day('dt'), 'night_trip', '1', "'night'", "'strong'",
             "'{\"validator\":' || " + jstr('trm_id') + " || ',\"route\":' || " + jstr('route_num') + " || '}'")}
FROM dd WHERE cat_num IN ({SCHOOL}) AND hour >= 0 AND hour < 6
"""

_H8_STEPS = f"""
s AS (SELECT card, trm_id, dt FROM dd WHERE cat_num IN ({SCHOOL})),
l AS (SELECT *, lag(trm_id) OVER w AS ptrm, lag(dt) OVER w AS pdt FROM s WINDOW w AS (PARTITION BY card ORDER BY dt, trm_id)),
st AS (SELECT *, coalesce(trm_id = ptrm AND date_diff('second', pdt, dt) < 60, false) AS q FROM l)
"""


def _h8_out(name: str, keys: str) -> str:
    return f"""
g AS (SELECT {keys}, count(*) AS n, min(dt) AS st, first(trm_id ORDER BY dt, trm_id) AS v
      FROM qq GROUP BY {keys} HAVING count(*) >= 2)
SELECT {cols(name, "'card'", 'card', iso('st'), day('st'), 'consecutive_uses', 'n', "'2'", "'raw'",
             "'{\"validator\":' || " + jstr('v') + " || '}'")}
FROM g
"""


RULE_SQL["H8"] = "WITH " + _H8_STEPS + ", qq AS (SELECT * FROM st WHERE q)," + _h8_out("H8", "card")
RULE_SQL["H8s"] = ("WITH " + _H8_STEPS + """,
sess AS (SELECT *, sum(CASE WHEN q THEN 0 ELSE 1 END) OVER (PARTITION BY card ORDER BY dt, trm_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM st),
qq AS (SELECT * FROM sess WHERE q),""" + _h8_out("H8s", "card, sid"))

RULE_SQL["H10"] = f"""
WITH a AS (SELECT count(*) FILTER (WHERE cat_num IN ({SCHOOL})) AS st,
                  count(*) FILTER (WHERE cat_num IN ({SCHOOL}) AND hour IN (7, 8, 9, 17, 18, 19)) AS sp,
                  count(*) FILTER (WHERE cat_num IN (207)) AS nt,
                  count(*) FILTER (WHERE cat_num IN (207) AND hour IN (7, 8, 9, 17, 18, 19)) AS np,
                  strftime(min(dt), '%Y-%m') AS period FROM dd),
g AS (SELECT 'school' AS grp, st AS total, sp AS peak, 30.0 AS thr, '30' AS thr_text, period FROM a
      UNION ALL SELECT 'senior', nt, np, 20.0, '20', period FROM a),
p AS (SELECT *, CASE WHEN total > 0 THEN peak * 100.0 / total ELSE 0.0 END AS pct FROM g)
SELECT {cols('H10', "'category'", 'grp', 'period', 'period', 'peak_hour_share', 'round_even(pct, 1)', 'thr_text',
             "'strong'", "'{\"total_trips\":' || total || ',\"peak_trips\":' || peak || '}'")}
FROM p WHERE pct > thr
"""

_CASH = """
WITH s AS (SELECT trm_id, count(*) AS total_tx, count(*) FILTER (WHERE cat_num = 151) AS cash_tx FROM dd GROUP BY trm_id),
r AS (SELECT *, cash_tx / total_tx AS share FROM s WHERE total_tx >= 10),
lv AS (SELECT * FROM (VALUES ('raw', {raw}, '{raw_t}'), ('strong', {strong}, '{strong_t}')) t(sev, thr, thr_t))
"""

for _name, _op, _raw, _strong in (("H11", ">=", "0.21", "0.47"), ("H12", "<=", "0.07", "0.0")):
    RULE_SQL[_name] = _CASH.format(raw=_raw, raw_t=_raw, strong=_strong, strong_t=_strong) + f"""
SELECT {cols(_name, "'validator'", 'trm_id', '(SELECT month FROM period)', '(SELECT month FROM period)', 'cash_share',
             'round_even(share * 1000, 0) / 1000', 'thr_t', 'sev', "'{\"total_tx\":' || total_tx || '}'")}
FROM r JOIN lv ON share {_op} thr
"""

RULE_SQL["H17"] = f"""
SELECT {cols('H17', "'transaction'", 'card', iso('dt'), day('dt'), 'zero_sum', '1', "'0'", "'strong'",
             "'{\"cat\":' || cat_num || ',\"validator\":' || " + jstr('trm_id') + " || ',\"route\":' || "
             + jstr('route_num') + " || '}'")}
FROM dd WHERE cat_num IN (91, 92, 93) AND summ_num = 0
"""

RULE_SQL["H19"] = f"""
WITH u AS (SELECT * FROM dd WHERE cat_num IS NOT NULL AND cat_num NOT IN ({KNOWN})),
c AS (SELECT cat_num, count(*) AS n, list(card ORDER BY card, trm_id, dt)[1:3] AS sample FROM u GROUP BY cat_num)
SELECT {cols('H19', "'category'", 'cat_num', '(SELECT month FROM period)', '(SELECT month FROM period)',
             'unknown_category', 'n', "'not_in_known'", "'raw'",
             "'{\"sample_cards\":' || " + jlist('sample') + " || '}'")}
FROM c
"""


def _h20(name: str, table: str) -> str:
    return f"""
WITH g AS (SELECT card, trm_id, dt, count(*) AS n FROM {table} GROUP BY ALL HAVING count(*) >= 2)
SELECT {cols(name, "'transaction'", 'card', iso('dt'), day('dt'), 'duplicate_count', 'n',
             "CASE WHEN n >= 5 THEN '5' ELSE '2' END", "CASE WHEN n >= 5 THEN 'strong' ELSE 'raw' END",
             "'{\"validator\":' || " + jstr('trm_id') + " || '}'")}
FROM g
"""


RULE_SQL["H20"] = _h20("H20", "dd")
RULE_SQL["H20r"] = _h20("H20r", "tx")

RULE_SQL["H21"] = f"""
SELECT {cols('H21', "'validator'", "'all'", 'month', 'month', 'poisson_p_value', '0.0', "'0.05'", "'info'",
             "'{\"note\":\"statistical test needs 30+ days of data\"}'")}
FROM period
"""

RULE_SQL["H21k"] = f"""
WITH l AS (SELECT trm_id, dt, lag(dt) OVER (PARTITION BY trm_id ORDER BY dt, card) AS pdt FROM dd),
g AS (SELECT trm_id, date_diff('second', pdt, dt) AS gap FROM l WHERE pdt IS NOT NULL),
per AS (SELECT trm_id, count(*) AS n, avg(gap) AS mean_gap FROM g GROUP BY trm_id),
o AS (SELECT g.trm_id, gap, n, mean_gap, row_number() OVER (PARTITION BY g.trm_id ORDER BY gap) AS i
      FROM g JOIN per USING (trm_id)),
f AS (SELECT *, CASE WHEN mean_gap > 0 THEN 1 - exp(-gap / mean_gap) ELSE 1.0 END AS cdf FROM o),
ks AS (SELECT trm_id, n, max(greatest(i / n - cdf, cdf - (i - 1) / n)) AS d FROM f GROUP BY trm_id, n),
days AS (SELECT trm_id, count(DISTINCT date) AS days FROM dd GROUP BY trm_id),
lam AS (SELECT ks.*, days.days, (sqrt(n) + 0.12 + 0.11 / sqrt(n)) * d AS lam FROM ks JOIN days USING (trm_id)),
pv AS (SELECT trm_id, n, d, days,
              CASE WHEN lam < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0,
                2 * (SELECT sum(pow(-1.0, k - 1) * exp(-2.0 * k * k * lam * lam)) FROM range(1, 101) r(k)))) END AS p
       FROM lam)
SELECT {cols('H21k', "'validator'", 'trm_id', '(SELECT month FROM period)', '(SELECT month FROM period)',
             'poisson_p_value', 'round_even(p, 6)', "'0.05'", "'raw'",
             "'{\"ks_distance\":\"' || printf('%.6f', d) || '\",\"gaps\":' || n || ',\"days\":' || days || '}'")}
FROM pv WHERE days >= 30 AND p < 0.05
"""

DEFAULT_RULES = ["H1", "H2", "H3", "H4", "H7", "H8", "H10", "H11", "H12", "H17", "H19", "H20", "H21"]


def _rule_query(name: str) -> str:
    return with_tx(f", r AS ({RULE_SQL[name]}) SELECT * FROM r")


def _with_anomalies(body: str) -> str:
    ctes = ", ".join(f"r_{n.lower()} AS ({RULE_SQL[n]})" for n in DEFAULT_RULES)
    union = " UNION ALL ".join(f"SELECT * FROM r_{n.lower()}" for n in DEFAULT_RULES)
    return with_tx(f", {ctes}, anomalies AS ({union}){body}")


_REPORT = """,
ent AS (SELECT entity_type, entity_id, count(*) AS total_violations,
               list_sort(list_distinct(list(hypothesis))) AS rules,
               max(CASE WHEN severity = 'strong' THEN 1 ELSE 0 END) AS strong,
               coalesce(min(CASE WHEN seen_date <> '' THEN seen_date END), '') AS first_seen,
               coalesce(max(CASE WHEN seen_date <> '' THEN seen_date END), '') AS last_seen
        FROM anomalies GROUP BY entity_type, entity_id),
w AS (SELECT entity_type, quantile_cont(total_violations::DOUBLE, 0.95) AS p FROM ent GROUP BY entity_type),
wt AS (SELECT entity_type, least(10.0, greatest(0.01, CASE WHEN p <= 0 THEN 1.0 ELSE 75.0 / p END)) AS weight FROM w),
report AS (
  SELECT entity_type, entity_id, CAST(len(rules) AS INTEGER) AS total_unique_hypotheses,
         CAST(total_violations AS BIGINT) AS total_violations, array_to_string(rules, ', ') AS hypotheses,
         CASE WHEN strong = 1 THEN 'strong' ELSE 'raw' END AS max_severity,
         round_even(least(100.0, total_violations * coalesce(weight, 1.0)) * 10, 0) / 10 AS risk_score,
         first_seen, last_seen
  FROM ent LEFT JOIN wt USING (entity_type)),
cardrows AS (SELECT * FROM report WHERE entity_type = 'card' OR NOT EXISTS (SELECT 1 FROM report WHERE entity_type = 'card'))
"""

_READABLE = """
SELECT CASE WHEN entity_type = 'card' THEN 'card' ELSE 'validator' END AS object_type, entity_id AS object_id,
       total_violations, total_unique_hypotheses, hypotheses, risk_score,
       CASE WHEN fs = '—' AND ls = '—' THEN '—' WHEN fs = ls OR ls = '—' THEN fs WHEN fs = '—' THEN ls
            ELSE fs || ' — ' || ls END AS period
FROM (SELECT *, {fs} AS fs, {ls} AS ls FROM report WHERE {cond})
"""


def _short(x: str) -> str:
    d = f"coalesce(try_strptime({x}, '%Y-%m-%d'), try_strptime({x}, '%Y-%m'))"
    return f"CASE WHEN coalesce({x}, '') = '' THEN '—' WHEN {d} IS NOT NULL THEN strftime({d}, '%d.%m') ELSE {x} END"


def _readable(cond: str) -> str:
    return _with_anomalies(_REPORT + _READABLE.format(fs=_short("first_seen"), ls=_short("last_seen"), cond=cond))


_TOP = """
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY entity_type ORDER BY risk_score DESC, total_violations DESC,
               entity_type, entity_id) AS INTEGER) AS rank FROM report WHERE {cond}) WHERE rank <= 20
"""

_TX_VIEW = """
SELECT card, trm_id, route_num, trc_id, {cat} AS cat, cat_num, summ_num,
       strftime(dt, '%Y-%m-%dT%H:%M:%S') AS dt, strftime(date, '%Y-%m-%d') AS date, hour,
       CAST(minute(dt) AS INTEGER) AS minute, CAST(second(dt) AS INTEGER) AS second, weekday, src_row FROM {t}
"""

ORACLE: dict[str, str] = {
    # raw text keeps the zero-padded category code
    "tx_normalize": with_tx(_TX_VIEW.format(t="tx", cat="lpad(CAST(cat_num AS VARCHAR), 4, '0')")),
    "tx_near_dedup": with_tx(_TX_VIEW.format(t="dd", cat="CAST(cat_num AS VARCHAR)")),
    "tx_summary": with_tx("""
SELECT count(*) AS transactions, strftime(min(dt), '%Y-%m-%dT%H:%M:%S') AS period_start,
       strftime(max(dt), '%Y-%m-%dT%H:%M:%S') AS period_end, count(DISTINCT card) AS cards,
       count(DISTINCT trm_id) AS validators, count(DISTINCT route_num) AS routes, count(DISTINCT cat_num) AS categories
FROM dd"""),
    "service_cards": with_tx(" SELECT DISTINCT card FROM (SELECT card, date, count(*) n FROM dd GROUP BY ALL) WHERE n > 12"),
    **{f"rule_{n.lower()}": _rule_query(n) for n in DEFAULT_RULES},
    "rule_h2_daily": _rule_query("H2d"),
    "rule_h4_sessions": _rule_query("H4s"),
    "rule_h8_sessions": _rule_query("H8s"),
    "rule_h20_raw": _rule_query("H20r"),
    "rule_h21_ks": _rule_query("H21k"),
    "anomalies_all": _with_anomalies("""
SELECT hypothesis, entity_type, entity_id, anomaly_date AS date, metric_name, metric_value, threshold_value,
       severity, details FROM anomalies"""),
    "anomaly_stats": _with_anomalies(""",
names AS (SELECT * FROM (VALUES """ + ", ".join(f"('{n}', {i})" for i, n in enumerate(DEFAULT_RULES)) + """) t(hypothesis, rule_order))
SELECT hypothesis, CAST(rule_order AS INTEGER) AS rule_order, CAST(coalesce(rows, 0) AS BIGINT) AS rows
FROM names LEFT JOIN (SELECT hypothesis, count(*) AS rows FROM anomalies GROUP BY hypothesis) USING (hypothesis)"""),
    "risk_report": _with_anomalies(_REPORT + " SELECT * FROM report"),
    "risk_levels": _with_anomalies(_REPORT + """,
lv AS (SELECT * FROM (VALUES ('low', 0), ('medium', 1), ('high', 2)) t(risk_level, position)),
c AS (SELECT CASE WHEN risk_score >= 70 THEN 'high' WHEN risk_score >= 40 THEN 'medium' ELSE 'low' END AS risk_level,
             count(*) AS n FROM cardrows GROUP BY 1)
SELECT risk_level, CAST(position AS INTEGER) AS position, CAST(coalesce(n, 0) AS BIGINT) AS entities
FROM lv LEFT JOIN c USING (risk_level)"""),
    "risk_histogram": _with_anomalies(_REPORT + """,
lv AS (SELECT (i * 10) || '-' || (i * 10 + 10) AS risk_bucket, CAST(i AS INTEGER) AS position FROM range(10) t(i)),
c AS (SELECT least(floor(least(greatest(risk_score, 0.0), 100.0) / 10), 9) AS b, count(*) AS n FROM cardrows GROUP BY 1)
SELECT risk_bucket, position, CAST(coalesce(n, 0) AS BIGINT) AS entities FROM lv LEFT JOIN c ON c.b = lv.position"""),
    "entities_per_rule": _with_anomalies(_REPORT + """
SELECT hypothesis, count(*) AS entities FROM (SELECT trim(unnest(string_split(hypotheses, ','))) AS hypothesis FROM report)
WHERE hypothesis <> '' GROUP BY hypothesis"""),
    "kpi": _with_anomalies(_REPORT + """
SELECT (SELECT count(*) FROM anomalies) AS total_anomalies,
       count(*) FILTER (WHERE entity_type = 'card') AS suspicious_cards,
       count(*) FILTER (WHERE entity_type = 'validator') AS suspicious_validators,
       count(*) FILTER (WHERE risk_score >= 70) AS high_risk_entities FROM report"""),
    "top_cards": _with_anomalies(_REPORT + _TOP.format(cond="entity_type = 'card'")),
    "top_validators": _with_anomalies(_REPORT + _TOP.format(cond="entity_type = 'validator'")),
    "top_filtered": _with_anomalies(_REPORT + _TOP.format(
        cond="entity_type IN ('card', 'validator') AND list_has_any(list_transform(string_split(hypotheses, ','), lambda x: trim(x)), ['H1', 'H3'])")),
    "action_list_high": _readable("entity_type = 'card' AND risk_score >= 70"),
    "action_list_medium": _readable("entity_type = 'card' AND risk_score >= 40 AND risk_score < 70"),
    "action_list_validators": _readable("entity_type = 'validator'"),
    "filter_by_rules": _with_anomalies(_REPORT + """
SELECT * FROM report WHERE list_has_any(list_transform(string_split(hypotheses, ','), lambda x: trim(x)), ['H4', 'H8'])"""),
}


# ---------------------------------------------------------------------------------------------
# labels and features
_LABELS = _REPORT + """,
labels AS (SELECT c.card AS card_id, CAST(CASE WHEN f.entity_id IS NULL THEN 0 ELSE 1 END AS INTEGER) AS is_fraud
           FROM (SELECT DISTINCT card FROM dd) c
           LEFT JOIN (SELECT DISTINCT entity_id FROM report WHERE entity_type = 'card') f ON f.entity_id = c.card)
"""

_FEATURES = _LABELS + """,
fr AS (SELECT card AS card_id, dt, coalesce(trm_id, '') AS terminal_id, coalesce(route_num, '') AS route_num,
              coalesce(trc_id, '') AS carrier_id, ltrim(coalesce(CAST(cat_num AS VARCHAR), ''), '0') AS cat,
              coalesce(summ_num, 0) AS kop, src_row, CAST(dt AS DATE) AS day, hour, weekday,
              epoch(dt)::BIGINT AS ep
       FROM tx WHERE card IN (SELECT card_id FROM labels)),
base AS (SELECT card_id, count(*) AS tx_count, count(DISTINCT day) AS active_days,
                count(DISTINCT route_num) AS unique_routes, count(DISTINCT terminal_id) AS unique_terminals,
                count(DISTINCT carrier_id) AS unique_carriers, count(DISTINCT cat) AS unique_cats,
                sum(kop) / count(*) / 100.0 AS mean_amount, sum(kop) / 100.0 AS sum_amount,
                count(DISTINCT kop) AS unique_amounts, avg(CASE WHEN kop = 0 THEN 1.0 ELSE 0.0 END) AS zero_amount_share,
                avg(CASE WHEN hour BETWEEN 0 AND 4 THEN 1.0 ELSE 0.0 END) AS night_share,
                avg(CASE WHEN weekday >= 5 THEN 1.0 ELSE 0.0 END) AS weekend_share,
                count(DISTINCT hour) AS active_hours_count, count(DISTINCT weekday) AS active_weekdays_count,
                avg(CASE WHEN cat = '201' THEN 1.0 ELSE 0.0 END) AS cat_201_share,
                avg(CASE WHEN cat = '203' THEN 1.0 ELSE 0.0 END) AS cat_203_share,
                avg(CASE WHEN cat = '204' THEN 1.0 ELSE 0.0 END) AS cat_204_share
         FROM fr GROUP BY card_id),
lg AS (SELECT *, lag(dt) OVER w AS pdt, lag(terminal_id) OVER w AS ptrm, lag(route_num) OVER w AS proute
       FROM fr WINDOW w AS (PARTITION BY card_id ORDER BY dt, src_row)),
gg AS (SELECT card_id, date_diff('second', pdt, dt) AS gap, coalesce(terminal_id = ptrm, false) AS st,
              ptrm IS NOT NULL AND terminal_id <> ptrm AS dtm, proute IS NOT NULL AND route_num <> proute AS drt
       FROM lg WHERE pdt IS NOT NULL),
gaps AS (SELECT card_id, min(gap) AS min_gap_sec, median(gap::DOUBLE) AS median_gap_sec,
                count(*) FILTER (WHERE gap <= 60) AS gap_le_1m_count,
                count(*) FILTER (WHERE gap <= 300) AS gap_le_5m_count,
                count(*) FILTER (WHERE gap <= 900) AS gap_le_15m_count,
                count(*) FILTER (WHERE st AND gap <= 60) AS same_terminal_gap_le_1m_count,
                count(*) FILTER (WHERE st AND gap <= 300) AS same_terminal_gap_le_5m_count,
                count(*) FILTER (WHERE st AND gap <= 900) AS same_terminal_gap_le_15m_count,
                count(*) FILTER (WHERE dtm AND gap <= 60) AS diff_terminal_gap_le_1m_count,
                count(*) FILTER (WHERE dtm AND gap <= 180) AS diff_terminal_gap_le_3m_count,
                count(*) FILTER (WHERE dtm AND gap <= 300) AS diff_terminal_gap_le_5m_count,
                count(*) FILTER (WHERE drt AND gap <= 60) AS diff_route_gap_le_1m_count,
                count(*) FILTER (WHERE drt AND gap <= 180) AS diff_route_gap_le_3m_count,
                count(*) FILTER (WHERE drt AND gap <= 300) AS diff_route_gap_le_5m_count,
                count(*) FILTER (WHERE dtm) AS terminal_switch_count,
                count(*) FILTER (WHERE drt) AS route_switch_count,
                min(gap) FILTER (WHERE dtm) AS min_gap_diff_terminal_sec,
                min(gap) FILTER (WHERE drt) AS min_gap_diff_route_sec
         FROM gg GROUP BY card_id),
dayc AS (SELECT card_id, day, count(*) AS n, date_diff('second', min(dt), max(dt)) AS span FROM fr GROUP BY ALL),
days AS (SELECT card_id, max(n) AS max_tx_per_day, sum(span) / count(*) / 3600.0 AS daily_span_hours_mean,
                max(span) / 3600.0 AS daily_span_hours_max
         FROM dayc GROUP BY card_id),
b1 AS (SELECT card_id, max(c) AS v FROM (SELECT card_id, ep // 3600 AS b, count(*) AS c FROM fr GROUP BY ALL) GROUP BY card_id),
b2 AS (SELECT card_id, max(c) AS v FROM (SELECT card_id, ep // 60 AS b, count(*) AS c FROM fr GROUP BY ALL) GROUP BY card_id),
b3 AS (SELECT card_id, max(c) AS v FROM (SELECT card_id, ep // 300 AS b, count(*) AS c FROM fr GROUP BY ALL) GROUP BY card_id),
b4 AS (SELECT card_id, max(c) AS v FROM (SELECT card_id, ep // 900 AS b, count(*) AS c FROM fr GROUP BY ALL) GROUP BY card_id),
b5 AS (SELECT card_id, max(c) AS v FROM (SELECT card_id, terminal_id, ep // 300 AS b, count(*) AS c FROM fr GROUP BY ALL) GROUP BY card_id),
b6 AS (SELECT card_id, max(c) AS v FROM (SELECT card_id, terminal_id, ep // 900 AS b, count(*) AS c FROM fr GROUP BY ALL) GROUP BY card_id),
tt AS (SELECT card_id, terminal_id AS val, count(*) AS c FROM fr GROUP BY ALL),
rr AS (SELECT card_id, route_num AS val, count(*) AS c FROM fr GROUP BY ALL),
cc AS (SELECT card_id, carrier_id AS val, count(*) AS c FROM fr GROUP BY ALL),
hh AS (SELECT card_id, CAST(hour AS VARCHAR) AS val, count(*) AS c FROM fr GROUP BY ALL),
tr AS (SELECT card_id, terminal_id, route_num, count(*) AS c FROM fr GROUP BY ALL),
ks AS (SELECT card_id, cat, count(*) AS c FROM fr GROUP BY ALL),
dimc AS (SELECT 'terminal' AS dim, * FROM tt UNION ALL SELECT 'route', * FROM rr UNION ALL SELECT 'carrier', * FROM cc
        UNION ALL SELECT 'hour', * FROM hh),
entc AS (SELECT dim, card_id, -sum((c / tot) * log2(c / tot)) AS h, max(c) / max(tot) AS top
         FROM (SELECT *, sum(c) OVER (PARTITION BY dim, card_id) AS tot FROM dimc) GROUP BY dim, card_id),
dom AS (SELECT card_id, arg_min(cat, (-c, cat)) AS dominant_cat FROM ks GROUP BY card_id),
trs AS (SELECT card_id, max(c) / sum(c) AS top_terminal_route_share FROM tr GROUP BY card_id),
f0 AS (
  SELECT b.card_id, b.tx_count, b.active_days, b.unique_routes, b.unique_terminals, b.unique_carriers, b.unique_cats,
         b.mean_amount, b.sum_amount, b.unique_amounts, b.zero_amount_share, b.night_share, b.weekend_share,
         b.active_hours_count, b.active_weekdays_count, b.tx_count / greatest(b.active_days, 1) AS tx_per_active_day,
         coalesce(g.min_gap_sec, 0) AS min_gap_sec, coalesce(g.median_gap_sec, 0) AS median_gap_sec,
         coalesce(g.gap_le_1m_count, 0) AS gap_le_1m_count, coalesce(g.gap_le_5m_count, 0) AS gap_le_5m_count,
         coalesce(g.gap_le_15m_count, 0) AS gap_le_15m_count,
         coalesce(g.same_terminal_gap_le_1m_count, 0) AS same_terminal_gap_le_1m_count,
         coalesce(g.same_terminal_gap_le_5m_count, 0) AS same_terminal_gap_le_5m_count,
         coalesce(g.same_terminal_gap_le_15m_count, 0) AS same_terminal_gap_le_15m_count,
         coalesce(g.diff_terminal_gap_le_1m_count, 0) AS diff_terminal_gap_le_1m_count,
         coalesce(g.diff_terminal_gap_le_3m_count, 0) AS diff_terminal_gap_le_3m_count,
         coalesce(g.diff_terminal_gap_le_5m_count, 0) AS diff_terminal_gap_le_5m_count,
         coalesce(g.diff_route_gap_le_1m_count, 0) AS diff_route_gap_le_1m_count,
         coalesce(g.diff_route_gap_le_3m_count, 0) AS diff_route_gap_le_3m_count,
         coalesce(g.diff_route_gap_le_5m_count, 0) AS diff_route_gap_le_5m_count,
         coalesce(g.terminal_switch_count, 0) AS terminal_switch_count,
         coalesce(g.route_switch_count, 0) AS route_switch_count,
         coalesce(g.min_gap_diff_terminal_sec, 0) AS min_gap_diff_terminal_sec,
         coalesce(g.min_gap_diff_route_sec, 0) AS min_gap_diff_route_sec,
         d.max_tx_per_day, b1.v AS max_tx_per_hour, b2.v AS max_tx_per_1m, b3.v AS max_tx_per_5m, b4.v AS max_tx_per_15m,
         b5.v AS max_same_terminal_tx_5m, b6.v AS max_same_terminal_tx_15m,
         et.top AS top_terminal_share, er.top AS top_route_share, trs.top_terminal_route_share,
         er.h AS route_entropy, et.h AS terminal_entropy, ec.h AS carrier_entropy, eh.h AS hour_entropy,
         dom.dominant_cat, d.daily_span_hours_mean, d.daily_span_hours_max,
         b.cat_201_share, b.cat_203_share, b.cat_204_share
  FROM base b LEFT JOIN gaps g USING (card_id) JOIN days d USING (card_id)
  JOIN b1 USING (card_id) JOIN b2 USING (card_id) JOIN b3 USING (card_id) JOIN b4 USING (card_id)
  JOIN b5 USING (card_id) JOIN b6 USING (card_id) JOIN trs USING (card_id) JOIN dom USING (card_id)
  JOIN entc et ON et.card_id = b.card_id AND et.dim = 'terminal'
  JOIN entc er ON er.card_id = b.card_id AND er.dim = 'route'
  JOIN entc ec ON ec.card_id = b.card_id AND ec.dim = 'carrier'
  JOIN entc eh ON eh.card_id = b.card_id AND eh.dim = 'hour'),
f1 AS (SELECT *, terminal_switch_count / greatest(tx_count - 1, 1) AS terminal_switch_rate,
              route_switch_count / greatest(tx_count - 1, 1) AS route_switch_rate FROM f0),
features AS (
  SELECT *,
""" + ",\n".join(
    f"  (rank() OVER (PARTITION BY dominant_cat ORDER BY {src}) + (count(*) OVER (PARTITION BY dominant_cat, {src}) - 1) / 2.0)"
    f" / count(*) OVER (PARTITION BY dominant_cat) AS {out}"
    for src, out in (("tx_count", "tx_count_percentile_in_cat"), ("unique_routes", "unique_routes_percentile_in_cat"),
                     ("unique_terminals", "unique_terminals_percentile_in_cat"), ("min_gap_sec", "min_gap_percentile_in_cat"),
                     ("same_terminal_gap_le_5m_count", "same_terminal_burst_percentile_in_cat"),
                     ("night_share", "night_share_percentile_in_cat"))) + """,
  CASE WHEN dominant_cat IN ('201', '203', '204') THEN dominant_cat ELSE 'other' END AS segment
  FROM f1)
"""


ORACLE["labels_loaded"] = _with_anomalies(_LABELS + " SELECT * FROM labels")
ORACLE["feat_raw_view"] = with_tx(f"""
SELECT CASE WHEN src_row % 89 = 0 THEN '' ELSE card END AS card_id, CASE WHEN src_row % 97 = 0 THEN '' ELSE trm_id END AS terminal_id,
       coalesce(route_num, '') AS route_num, coalesce(trc_id, '') AS carrier_id, ltrim(coalesce(CAST(cat_num AS VARCHAR), ''), '0') AS cat,
       CAST(coalesce(summ_num, 0) AS DOUBLE) AS amount_kop, {iso('dt')} AS dt, strftime(date, '%Y-%m-%d') AS day, hour, weekday, src_row FROM tx""")
ORACLE["card_labels"] = _with_anomalies(_LABELS + " SELECT * FROM labels")
for _fam, _cols in FAMILIES.items():
    _sel = ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" if c in DOUBLE_FEATURES else c for c in _cols)
    ORACLE[_fam] = _with_anomalies(_FEATURES + f" SELECT {_sel} FROM features")

# the forest is grown and applied in SQL, from the SQL's own features
for _name, _sql in forest_queries(_FEATURES, ForestConfig(), top_percent=0.01, bins=14).items():
    ORACLE[_name] = _with_anomalies(_sql)
ORACLE["segment_counts"] = _with_anomalies(_FEATURES + "," + forest_ctes(ForestConfig()) + """
SELECT segment, count(*) AS cards FROM scored GROUP BY segment ORDER BY cards DESC, segment LIMIT 8""")

# the dump's amounts of validator V4 end in .5 and its afternoon taps carry a Cyrillic vehicle
# the dump: rows with a field too many are rejected, rows without their last two fields are read
_DUMP = """,
dump AS (SELECT * REPLACE (
    CASE WHEN src_row % 223 <> 4 THEN CAST(summ_num AS DOUBLE) + CASE WHEN trm_id = 'V4' THEN 0.5 ELSE 0 END END AS summ_num),
    CASE WHEN src_row % 223 = 4 THEN '' WHEN src_row % 101 = 0 THEN 'bus "5"; line, 7' WHEN src_row % 101 = 1 THEN 'C:' || chr(92)
         WHEN src_row % 101 = 2 AND CAST(card AS BIGINT) % 4 <> 0 THEN 'two' || chr(10) || 'lines' WHEN hour >= 12 THEN 'Автобус' ELSE '' END AS vehicle
  FROM tx WHERE src_row % 211 <> 3)"""
ORACLE["raw_csv_ingest"] = with_tx(_DUMP + _TX_VIEW.format(t="dump", cat="lpad(CAST(cat_num AS VARCHAR), 4, '0')")
                                   .replace(", weekday, src_row FROM", ", weekday, vehicle FROM"))

# each archive (cards 2 and 3 modulo 4, and a file number) holds a damaged member and a spreadsheet
ORACLE["raw_rejects"] = with_tx(""",
f AS (SELECT *, CAST(card AS BIGINT) % 4 AS kind, (src_row // 10) % (SELECT 1 + count(*) // 50000 FROM tx) AS file FROM tx),
r AS (SELECT CASE WHEN kind >= 2 THEN 'zip' ELSE 'csv' END AS source, CASE WHEN kind >= 2 THEN 'taps.csv' ELSE '' END AS member,
        CASE WHEN src_row % 211 = 3 THEN 'row: 9 fields, the header has 8' ELSE 'row: 6 of 8 fields, the rest is missing' END AS error
      FROM f WHERE src_row % 211 = 3 OR src_row % 223 = 4)
SELECT source, member, error, count(*) AS n FROM r GROUP BY ALL
UNION ALL
SELECT 'zip', member, 'member', (SELECT count(DISTINCT (kind, file)) FROM f WHERE kind >= 2)
FROM (VALUES ('damaged.csv'), ('reports/summary.xlsx')) AS m(member)""")

# Streaming replays are completed at their end, so the oracle is the whole batch result.
ORACLE["stream_bursts"] = with_tx(f""",
b AS (SELECT trm_id, dt AS time_window, count(*) AS tx_count, count(DISTINCT card) AS unique_cards FROM tx
      GROUP BY trm_id, dt HAVING count(*) >= 3 AND count(DISTINCT card) >= 2)
SELECT trm_id, {iso('time_window')} AS time_window, tx_count, unique_cards FROM b""")

ORACLE["stream_bursts_rule"] = with_tx(f""",
svc AS (SELECT card FROM tx GROUP BY card, date HAVING count(*) > 12),
b AS (SELECT trm_id, dt AS time_window, count(*) AS tx_count, count(DISTINCT card) AS unique_cards,
             array_to_string(list_sort(list(DISTINCT card))[1:5], ',') AS sample_cards
      FROM tx WHERE card NOT IN (SELECT card FROM svc) GROUP BY trm_id, dt HAVING count(*) >= 3 AND count(DISTINCT card) >= 2)
SELECT trm_id, {iso('time_window')} AS time_window, tx_count, unique_cards, sample_cards FROM b""")

ORACLE["stream_daily_trips"] = with_tx(f""",
d AS (SELECT card, date, count(*) AS n FROM tx GROUP BY card, date)
SELECT card, strftime(date, '%Y-%m-%d') AS date, n, CASE WHEN n >= 12 THEN 'strong' ELSE 'raw' END AS severity,
       n > 12 AS service_day
FROM d WHERE n >= 6""")

ORACLE["stream_near_dedup"] = with_tx(f" SELECT card, trm_id, {iso('dt')} AS dt, src_row FROM dd")

ORACLE["stream_school_sessions"] = with_tx(f""",
s AS (SELECT card, trm_id, dt, src_row FROM tx WHERE cat_num IN ({SCHOOL})),
l AS (SELECT *, lag(dt) OVER (PARTITION BY card, trm_id ORDER BY dt, src_row) AS pdt FROM s),
k AS (SELECT *, sum(CASE WHEN pdt IS NULL OR date_diff('second', pdt, dt) > 59 THEN 1 ELSE 0 END)
                OVER (PARTITION BY card, trm_id ORDER BY dt, src_row ROWS UNBOUNDED PRECEDING) AS sid FROM l),
g AS (SELECT card, trm_id, sid, count(*) AS taps, min(dt) AS st FROM k GROUP BY card, trm_id, sid)
SELECT card, trm_id, {iso('st')} AS start_time, taps - 1 AS consecutive_count FROM g
WHERE taps - 1 >= 2""")
