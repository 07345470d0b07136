"""DuckDB building blocks for the independent SQL oracle.

The oracle re-derives everything from the raw driver tables with plain SQL (windows, joins,
aggregates). It deliberately follows the reference's row-at-a-time formulation (exact distinct,
then ``lag``) where the Spark code uses a different plan, so the two cross-check each other.
"""

TX_CTES = """
ev AS (
  SELECT event_id, ts, user_id, event_type, value,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
         CASE WHEN event_id % 40 = 0 THEN 'burst' WHEN event_id % 41 = 0 THEN 'dup'
              WHEN event_id % 43 = 0 THEN 'series' ELSE 'plain' END AS kind
  FROM events),
rep AS (
  SELECT ev.*, unnest(range(CASE kind WHEN 'burst' THEN 6 WHEN 'dup' THEN 5 WHEN 'series' THEN 8 ELSE 1 END)) AS i
  FROM ev),
tx0 AS (
  SELECT CAST(CASE WHEN kind = 'burst' THEN user_id + i ELSE user_id END AS VARCHAR) AS card,
         'V' || CAST(k % 10 AS VARCHAR) AS trm_id,
         'R' || CAST(k % 7 AS VARCHAR) AS route_num,
         'C' || CAST(k % 3 AS VARCHAR) AS trc_id,
         CAST(date_trunc('second', ts) + to_seconds(CASE WHEN kind = 'series' THEN 20 * i ELSE 0 END) AS TIMESTAMP) AS dt,
         CASE WHEN kind = 'series' THEN 203
              WHEN event_type = 'error' THEN CASE WHEN k < 5 THEN 999 ELSE 151 END
              WHEN event_type = 'view' THEN CASE WHEN k % 10 IN (5, 7) THEN 151 ELSE 201 END
              WHEN event_type = 'click' THEN CASE WHEN k % 10 = 5 THEN 151 ELSE 203 END
              WHEN event_type = 'signup' THEN 207
              WHEN event_type = 'purchase' THEN 91 END AS cat0,
         CAST(floor(value) * 100 AS BIGINT) AS summ_num,
         event_id * 10 + i AS src_row
  FROM rep),
tx AS (
  SELECT card, trm_id, route_num, trc_id, dt,
         CAST(CASE WHEN cat0 = 151 AND trm_id = 'V3' THEN 201 ELSE cat0 END AS INTEGER) AS cat_num,
         summ_num, src_row,
         CAST(dt AS DATE) AS date, CAST(hour(dt) AS INTEGER) AS hour, CAST(isodow(dt) - 1 AS INTEGER) AS weekday
  FROM tx0),
ex AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY card, trm_id, route_num, trc_id, dt, cat_num, summ_num
                                 ORDER BY src_row) AS rn FROM tx) WHERE rn = 1),
dd AS (
  SELECT * EXCLUDE (pdt) FROM (
    SELECT *, lag(dt) OVER (PARTITION BY card, trm_id ORDER BY dt, src_row) AS pdt FROM ex)
  WHERE pdt IS NULL OR date_diff('second', pdt, dt) > 2),
period AS (SELECT strftime(min(dt), '%Y-%m') AS month FROM dd)
"""


def with_tx(body: str) -> str:
    """Prefix a query body (which may start with more ``name AS (...)`` CTEs, comma-led) with the
    fixture CTEs."""
    return "WITH " + TX_CTES + body
