"""E / B7: data-quality queries.

Input: the descriptive columns of ``sales_fact`` (line keys and derived
measures dropped), as a user would upload them; it contains duplicate rows,
so E3-E6 are non-trivial.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import quality as Q
from quarry.plans.catalog import query
from quarry.plans.views import raw_orders, sales_fact

SF = ["sales_fact"]
DROP = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price", "cost", "stock", "production"]
BCOLS = ["date", "region", "location", "product", "category", "sales", "defect", "promo"]
BIZ = "biz AS (SELECT " + ", ".join(BCOLS) + " FROM sales_fact)"
NULLS = " + ".join(f"count_if({c} IS NULL)" for c in BCOLS)
DUPS = "(SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS duplicate_count, count(*) AS distinct_rows FROM (SELECT count(*) AS c FROM biz GROUP BY ALL_COLS) g)".replace(
    "ALL_COLS", ", ".join(BCOLS))


def _biz(spark, sf):
    return sales_fact(spark, sf).drop(*DROP)


@query("missing_ratio", f"""
, {BIZ}
SELECT count(*) AS total_rows, {len(BCOLS)} AS total_cols, {NULLS} AS missing_cells,
       CASE WHEN count(*) > 0 THEN ({NULLS}) / (count(*) * {len(BCOLS)}.0) ELSE 0.0 END AS missing_ratio,
       CASE WHEN count(*) > 0 THEN ({NULLS}) * 100.0 / (count(*) * {len(BCOLS)}) ELSE 0.0 END AS missing_pct
FROM biz""", SF)
def q_missing_ratio(spark, sf):
    return Q.missing_ratio(_biz(spark, sf))


@query("missing_per_column", ", " + BIZ + "\n" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count_if({c} IS NULL) AS missing, "
    f"CASE WHEN count(*) > 0 THEN count_if({c} IS NULL) * 100.0 / count(*) ELSE 0.0 END AS missing_pct FROM biz"
    for c in BCOLS), SF)
def q_missing_per_column(spark, sf):
    return Q.missing_per_column(_biz(spark, sf))


@query("duplicate_rows", f", {BIZ}\nSELECT * FROM {DUPS} d", SF)
def q_duplicate_rows(spark, sf):
    return Q.duplicate_rows(_biz(spark, sf))


RAW_COLS = ["order_id", "order_date", "updated_at", "status", "priority", "total_price", "total_eu", "discount", "is_final", "customer"]
RAW_NULLS = " + ".join(f"count_if({c} IS NULL)" for c in RAW_COLS)


@query("missing_ratio_raw", f"""
SELECT count(*) AS total_rows, {len(RAW_COLS)} AS total_cols, {RAW_NULLS} AS missing_cells,
       ({RAW_NULLS}) / (count(*) * {len(RAW_COLS)}.0) AS missing_ratio, ({RAW_NULLS}) * 100.0 / (count(*) * {len(RAW_COLS)}) AS missing_pct
FROM raw_orders""", ["raw_orders"])
def q_missing_ratio_raw(spark, sf):
    return Q.missing_ratio(raw_orders(spark, sf))


@query("missing_per_column_raw", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count_if({c} IS NULL) AS missing, count_if({c} IS NULL) * 100.0 / count(*) AS missing_pct FROM raw_orders"
    for c in RAW_COLS), ["raw_orders"])
def q_missing_per_column_raw(spark, sf):
    return Q.missing_per_column(raw_orders(spark, sf))


@query("duplicate_rows_raw", f"""
SELECT CAST(sum(c - 1) AS BIGINT) AS duplicate_count, count(*) AS distinct_rows
FROM (SELECT count(*) AS c FROM raw_orders GROUP BY {", ".join(RAW_COLS)}) g""", ["raw_orders"])
def q_duplicate_rows_raw(spark, sf):
    return Q.duplicate_rows(raw_orders(spark, sf))


@query("column_type_counts", """
SELECT type, columns FROM (VALUES ('Numeric', CAST(3 AS BIGINT)), ('DateTime', 1), ('Text', 4)) t(type, columns)
WHERE EXISTS (SELECT 1 FROM lineitem)""")
def q_column_type_counts(spark, sf):
    biz = _biz(spark, sf)
    return Q.column_type_counts(biz).where(biz.agg(F.count(F.lit(1)) > 0).scalar())


SNAP = f"""
, {BIZ},
m AS (SELECT count(*) AS total_rows, {len(BCOLS)} AS total_cols,
             CASE WHEN count(*) > 0 THEN ({NULLS}) * 100.0 / (count(*) * {len(BCOLS)}) ELSE 0.0 END AS missing_pct FROM biz),
d AS {DUPS},
snap AS (SELECT total_rows, total_cols, missing_pct, duplicate_count,
                CAST(3 AS BIGINT) AS numeric_cols, CAST(1 AS BIGINT) AS datetime_cols, CAST(0 AS BIGINT) AS boolean_cols,
                CAST(4 AS BIGINT) AS text_cols, CAST(0 AS BIGINT) AS other_cols FROM m, d)
"""


@query("quality_snapshot", SNAP + "SELECT * FROM snap", SF)
def q_quality_snapshot(spark, sf):
    return Q.quality_snapshot(_biz(spark, sf))


DUP_PCT = "CASE WHEN total_rows > 0 THEN duplicate_count * 100.0 / total_rows ELSE 0.0 END"


@query("quality_score", SNAP + f"""
SELECT *, {DUP_PCT} AS duplicate_pct,
       greatest(0, least(100, 100 - least(40, CAST(round_even(missing_pct, 0) AS INTEGER))
                                  - least(25, CAST(round_even({DUP_PCT}, 0) AS INTEGER)))) AS quality_score
FROM snap""", SF)
def q_quality_score(spark, sf):
    return Q.quality_score(Q.quality_snapshot(_biz(spark, sf)))


@query("quality_label", SNAP + """
SELECT *, CASE WHEN total_rows > 0 THEN duplicate_count / total_rows ELSE 0.0 END AS duplicate_ratio,
       (CASE WHEN missing_pct / 100.0 > 0.05 THEN 1 ELSE 0 END + CASE WHEN duplicate_count > 0 THEN 1 ELSE 0 END) AS issues,
       CASE WHEN (CASE WHEN missing_pct / 100.0 > 0.05 THEN 1 ELSE 0 END + CASE WHEN duplicate_count > 0 THEN 1 ELSE 0 END) = 0 THEN 'strong'
            WHEN (CASE WHEN missing_pct / 100.0 > 0.05 THEN 1 ELSE 0 END + CASE WHEN duplicate_count > 0 THEN 1 ELSE 0 END) = 1
                 AND missing_pct / 100.0 <= 0.20 THEN 'moderate' ELSE 'weak' END AS quality_label,
       CASE WHEN missing_pct < 2 AND duplicate_count = 0 THEN 'strong' WHEN missing_pct < 10 THEN 'acceptable'
            ELSE 'needs attention' END AS quality_summary
FROM snap""", SF)
def q_quality_label(spark, sf):
    return Q.quality_label(Q.quality_snapshot(_biz(spark, sf)))


STRS = ["region", "location", "product", "category"]


@query("column_types", ", " + BIZ + "\n" + " UNION ALL ".join(
    [f"SELECT '{c}' AS \"column\", '{t}' AS type" for c, t in
     [("date", "datetime"), ("sales", "numeric"), ("defect", "numeric"), ("promo", "numeric")]]
    + [f"SELECT '{c}' AS \"column\", CASE WHEN count({c}) > 0 AND count(DISTINCT {c}) / count({c}) < 0.5 THEN 'categorical' "
       f"WHEN count({c}) = 0 THEN 'categorical' ELSE 'text' END AS type FROM biz" for c in STRS]), SF)
def q_column_types(spark, sf):
    return Q.column_types(_biz(spark, sf))
