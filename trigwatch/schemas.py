"""Column layouts of the tables the operators exchange."""

from __future__ import annotations

#: unified rule-trigger event; ``timestamp`` is wall-clock time in the deployment's zone
EVENT = (
    "hostname STRING, source_ip STRING, rule_id BIGINT, timestamp TIMESTAMP_NTZ, "
    "count BIGINT, source_label STRING, window_id STRING"
)
EVENT_REQUIRED = ("hostname", "rule_id", "timestamp", "count")

#: header names of exported trigger files (fixed values) -> our columns
TRIGGER_CSV_COLUMNS = {
    "sysmon_hostname (custom)": "hostname",
    "Custom Rule": "rule_id",
    "Log Source Time (Minimum)": "timestamp",
    "Count": "count",
}

#: one search result: {"events": [...]}
SEARCH_RESULT = (
    "events ARRAY<STRUCT<`sysmon_hostname (custom)`: STRING, `Source IP`: STRING, "
    "`source_ip`: STRING, `src_ip`: STRING, `Custom Rule`: STRING, "
    "`Log Source Time (Minimum)`: STRING, `Count`: STRING>>"
)

HOST_TRIGGERS = "MAP<STRING, STRUCT<total_triggers: BIGINT, rules: MAP<STRING, BIGINT>, source_ip: STRING>>"

WINDOW_DOC = (
    "_id STRING, window_start TIMESTAMP_NTZ, window_end TIMESTAMP_NTZ, query_time TIMESTAMP_NTZ, "
    f"feature_vector MAP<STRING, BIGINT>, host_triggers {HOST_TRIGGERS}, "
    "rule_counts MAP<STRING, BIGINT>, features MAP<STRING, BIGINT>, "
    "hostname STRING, source_ip STRING, "
    "total_triggers BIGINT, total_rules_triggered BIGINT, "
    "metadata STRUCT<source: STRING, data_type: STRING, window_size_minutes: INT>"
)

CATALOG_CSV = "id STRING, name STRING, type STRING, enabled STRING, origin STRING"

ID_MAP_CSV = "uat_rule_id STRING, prod_rule_id STRING, rule_name STRING"

JOBS_CSV = (
    "hostname STRING, start_time STRING, end_time STRING, output_dir STRING, db_name STRING, "
    "collection STRING, source_schema STRING, window_size_minutes STRING"
)

RESULT = (
    "window_id STRING, hostname STRING, predicted_label INT, confidence DOUBLE, "
    "prediction_time TIMESTAMP_NTZ"
)
