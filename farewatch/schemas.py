"""Column lists shared by operators, oracle SQL and tests.

Fixed values: these names and their order are the output contract."""

TX_COLUMNS = [
    "card", "trm_id", "route_num", "trc_id", "cat", "cat_type", "cat_num", "summ_num", "vehicle",
    "dt", "date", "hour", "minute", "second", "weekday", "src_file", "src_row",
]

# One row per rule hit. ``anomaly_date`` is the ISO rendering (export form); ``seen_date`` is the
# report form (calendar day for dated hits, the text itself for period labels such as '2024-01').
ANOMALY_COLUMNS = [
    "hypothesis", "entity_type", "entity_id", "anomaly_date", "seen_date", "metric_name",
    "metric_value", "threshold_value", "severity", "details",
]

REPORT_COLUMNS = [
    "entity_type", "entity_id", "total_unique_hypotheses", "total_violations", "hypotheses",
    "max_severity", "risk_score", "first_seen", "last_seen",
]
