"""D / A6: queries over ``events`` seen as stored data points."""

from __future__ import annotations

from quarry.plans.catalog import query
from quarry.plans.views import event_points
from quarry.sources import store as D

EV = ["event_points"]
POINT_COLS = 'dataset_id, row_index, "timestamp", payload, is_valid, value'


def _pts(spark, sf):
    return event_points(spark, sf)


@query("time_range_query", f"""
SELECT {POINT_COLS} FROM event_points WHERE dataset_id = 'click'
  AND "timestamp" >= TIMESTAMP '2024-01-10 00:00:00' AND "timestamp" <= TIMESTAMP '2024-01-20 00:00:00'
ORDER BY "timestamp", row_index LIMIT 1000""", EV)
def q_time_range_query(spark, sf):
    return D.time_range(_pts(spark, sf), "click", "2024-01-10 00:00:00", "2024-01-20 00:00:00", 1000)


@query("payload_field_eq", f"""
SELECT {POINT_COLS} FROM event_points WHERE dataset_id = 'purchase' AND json_extract_string(payload, '$.k') = '42'
ORDER BY "timestamp", row_index LIMIT 100""", EV)
def q_payload_field_eq(spark, sf):
    return D.payload_field_equals(_pts(spark, sf), "purchase", "k", 42, 100)


@query("payload_contains", f"""
SELECT {POINT_COLS} FROM event_points WHERE CAST(json_extract(payload, '$.k') AS VARCHAR) = '7'""", EV)
def q_payload_contains(spark, sf):
    return D.payload_contains(_pts(spark, sf), {"k": 7})


@query("payload_numeric_agg", """
SELECT dataset_id, count(v) AS count, min(v) AS min, max(v) AS max, avg(v) AS avg
FROM (SELECT dataset_id, CAST(json_extract_string(payload, '$.k') AS DOUBLE) AS v FROM event_points
      WHERE regexp_matches(json_extract_string(payload, '$.k'), '^-?[0-9]+(\\.[0-9]+)?$')) t GROUP BY dataset_id""", EV)
def q_payload_numeric_agg(spark, sf):
    return D.payload_numeric_agg(_pts(spark, sf), "k")


REGISTRY = """
, per AS (SELECT dataset_id, min("timestamp") AS first_, max("timestamp") AS last_, count(*) AS row_count
          FROM event_points GROUP BY dataset_id),
cur AS (SELECT dataset_id AS id, dataset_id AS name, 'file' AS source_type, 'events/' || dataset_id AS source_path, row_count,
               'timestamp' AS datetime_column, 'success' AS status, CAST(NULL AS VARCHAR) AS error_message,
               first_ AS created_at, last_ AS updated_at FROM per)
"""


def _registry(spark, sf):
    return D.current_datasets(D.registry_log_from_points(_pts(spark, sf)))


@query("dataset_list", REGISTRY + "SELECT * FROM cur ORDER BY created_at DESC, id LIMIT 100 OFFSET 0", EV)
def q_dataset_list(spark, sf):
    return D.list_datasets(D.registry_log_from_points(_pts(spark, sf)), 100, 0)


@query("dataset_summary", REGISTRY + """
SELECT cur.*, coalesce(a.point_count, 0) AS point_count, a.first_point, a.last_point
FROM cur LEFT JOIN (SELECT dataset_id, count(*) AS point_count, min("timestamp") AS first_point, max("timestamp") AS last_point
                    FROM event_points GROUP BY dataset_id) a ON cur.id = a.dataset_id""", EV)
def q_dataset_summary(spark, sf):
    return D.dataset_summary(_registry(spark, sf), _pts(spark, sf))


@query("invalid_count", "SELECT dataset_id, count_if(NOT is_valid) AS invalid_points FROM event_points GROUP BY dataset_id", EV)
def q_invalid_count(spark, sf):
    return D.invalid_count(_pts(spark, sf))
