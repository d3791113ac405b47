"""A/B/C: profiling, schema detection and cleaning of ``raw_orders`` (orders rendered as text).

The oracle SQL is generated from the same fixed parse rules (layouts, tokens,
hints); the roles it assumes for ``raw_orders`` are exactly what ``detect_schema``
decides, so the SQL also checks the detection itself.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import parse as P
from quarry.operators import clean as C
from quarry.operators import profile as B
from quarry.plans.catalog import query
from quarry.plans.views import raw_orders

RV = ["raw_orders"]
COLS = ["order_id", "order_date", "updated_at", "status", "priority", "total_price", "total_eu", "discount", "is_final", "customer"]
DT_COL, DT_FMT = "order_date", "%Y-%m-%d"
NUMERIC = ["order_id", "total_price", "total_eu", "discount", "customer"]
BOOLEAN = ["is_final"]
TEXT = ["updated_at", "status", "priority"]
EURO_RE = P.EURO_PATTERN


# ------------------------------------------------------------------ SQL builders (oracle side)
def q(text: str) -> str:
    return text.replace("'", "''")


def s_body(c: str) -> str:
    return (f"regexp_replace(regexp_replace(trim({c}), '^[+\\-]?\\s*[{P.CURRENCY}]?\\s*', ''), '\\s*%$', '')")


def s_euro_row(c: str) -> str:
    b = s_body(c)
    return f"(regexp_matches({b}, '{EURO_RE}') AND (contains({b}, ',') OR regexp_matches({b}, '\\.\\d{{3}}\\.\\d{{3}}')))"


def s_parse(c: str, euro: str) -> str:
    b = s_body(c)
    cleaned = (f"CASE WHEN {euro} THEN CASE WHEN regexp_matches({b}, '{EURO_RE}') THEN replace(replace({b}, '.', ''), ',', '.') "
               f"ELSE {b} END ELSE replace({b}, ',', '') END")
    x = f"TRY_CAST({cleaned} AS DOUBLE)"
    fin = f"CASE WHEN isnan({x}) OR isinf({x}) THEN NULL ELSE {x} END"
    return f"(CASE WHEN starts_with(trim({c}), '-') THEN -({fin}) ELSE {fin} END)"


def s_flag(c: str) -> str:
    return f"(SELECT count_if({s_euro_row(c)}) > 0 FROM raw_orders)"


def s_bool_token(c: str) -> str:
    return f"lower(trim({c})) IN ({', '.join(repr(t) for t in P.BOOL_ALL)})"


def profile_sql() -> str:
    parts = []
    for i, c in enumerate(COLS):
        dts = [f"count(try_strptime({c}, '{f}'))" for _, f in P.DATETIME_FORMATS]
        best = f"greatest({', '.join(dts)})"
        any_ = "count(coalesce(" + ", ".join(f"try_strptime({c}, '{f}')" for _, f in P.DATETIME_FORMATS) + "))"
        fmt = "CASE " + " ".join(f"WHEN {d} = {best} THEN '{q(sf)}'" for d, (sf, _) in zip(dts, P.DATETIME_FORMATS)) + " END"
        parts.append(f"""
SELECT {i} AS ordinal, '{c}' AS "column", CAST({P.name_score(c)!r} AS DOUBLE) AS name_score, count_if({s_euro_row(c)}) > 0 AS european,
       count(*) AS total_count, count({c}) AS non_null, count(*) - count({c}) AS null_count,
       count(DISTINCT {c}) AS unique_count,
       CASE WHEN count(*) > 0 THEN (count(*) - count({c})) / count(*) ELSE 1.0 END AS null_ratio,
       CASE WHEN count({c}) > 0 THEN count(DISTINCT {c}) / count({c}) ELSE 0.0 END AS unique_ratio,
       (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM raw_orders WHERE {c} IS NOT NULL ORDER BY v LIMIT 5)) AS sample_values,
       CASE WHEN count({c}) > 0 THEN {any_} / count({c}) ELSE 0.0 END AS datetime_ratio,
       CASE WHEN {best} > 0 THEN {fmt} END AS datetime_format,
       CASE WHEN count({c}) > 0 THEN count(CASE WHEN count_if({s_euro_row(c)}) OVER () > 0 THEN 1 END) END AS _dummy,
       count_if({s_bool_token(c)}) AS bool_tokens,
       count({s_parse(c, 'TRUE')}) AS ne, count({s_parse(c, 'FALSE')}) AS np
FROM raw_orders""")
    # window in aggregate is not allowed; drop the dummy column
    parts = [p.replace(f"       CASE WHEN count({c}) > 0 THEN count(CASE WHEN count_if({s_euro_row(c)}) OVER () > 0 THEN 1 END) END AS _dummy,\n", "")
             for p, c in zip(parts, COLS)]
    base = " UNION ALL ".join(parts)
    return f""", prof0 AS ({base}),
prof AS (
  SELECT ordinal, "column", name_score, european, total_count, non_null, null_count, unique_count, null_ratio, unique_ratio,
         sample_values, datetime_ratio, datetime_format,
         CASE WHEN non_null > 0 THEN (CASE WHEN european THEN ne ELSE np END) / non_null ELSE 0.0 END AS numeric_ratio,
         non_null > 0 AND bool_tokens = non_null AS is_bool
  FROM prof0),
profile AS (
  SELECT * EXCLUDE (is_bool),
         CASE WHEN is_bool THEN 'boolean' WHEN datetime_ratio >= 0.6 THEN 'datetime' WHEN numeric_ratio >= 0.7 THEN 'numeric'
              ELSE 'text' END AS inferred_type
  FROM prof),
profile2 AS (
  SELECT *, CASE WHEN inferred_type = 'datetime' THEN datetime_ratio WHEN inferred_type = 'numeric' THEN numeric_ratio END AS parse_success_ratio,
         CASE WHEN datetime_ratio < 0.6 THEN 0.0 ELSE datetime_ratio + name_score END AS datetime_score
  FROM profile),
schema_ AS (
  SELECT *, CASE WHEN row_number() OVER (ORDER BY datetime_score DESC, ordinal) = 1 AND datetime_score > 0 THEN 'datetime'
                 WHEN inferred_type = 'boolean' THEN 'boolean'
                 WHEN inferred_type = 'numeric' OR numeric_ratio >= 0.7 THEN 'numeric' ELSE 'text' END AS role
  FROM profile2)
"""


PROFILE_COLS = ("ordinal, \"column\", name_score, european, total_count, non_null, null_count, unique_count, null_ratio, "
                "unique_ratio, sample_values, datetime_ratio, datetime_format, numeric_ratio, inferred_type, parse_success_ratio")


def _profile(spark, sf, with_distinct=False):
    return B.profile_columns(raw_orders(spark, sf), with_distinct).drop("native")


@query("column_profile", profile_sql() + f"SELECT {PROFILE_COLS} FROM profile2", RV)
def q_column_profile(spark, sf):
    return _profile(spark, sf, True)


UNITED_COLS = ("ordinal, \"column\", name_score, european, total_count, non_null, null_count, null_ratio, datetime_ratio, datetime_format, "
               "numeric_ratio, inferred_type, parse_success_ratio")


@query("united_profile", profile_sql() + f"SELECT {UNITED_COLS} FROM profile2", RV)
def q_united_profile(spark, sf):
    """B5 of three batches, each profiled apart and stored, united from the stored states."""
    import uuid

    from quarry.session import checkpoint_dir

    folder = f"{checkpoint_dir(spark)}/states-{uuid.uuid4().hex}"
    rows = raw_orders(spark, sf)
    for batch in range(3):
        own = rows.where(F.pmod(F.coalesce(F.col("order_id").try_cast("bigint"), F.lit(0)), F.lit(3)) == batch)
        B.column_state(own).withColumn("batch", F.lit(batch)).write.mode("append").parquet(folder)
    united = B.profile_of_state(B.unite_states(spark.read.parquet(folder)))
    return united.select(*[c.strip().strip('"') for c in UNITED_COLS.split(",")])


@query("datetime_ratio", profile_sql() + "SELECT \"column\", datetime_ratio, datetime_format FROM profile2", RV)
def q_datetime_ratio(spark, sf):
    return _profile(spark, sf).select("column", "datetime_ratio", "datetime_format")


@query("datetime_score", profile_sql() + "SELECT \"column\", name_score, datetime_ratio, datetime_score FROM profile2", RV)
def q_datetime_score(spark, sf):
    return B.datetime_score(_profile(spark, sf)).select("column", "name_score", "datetime_ratio", "datetime_score")


@query("schema_profile", profile_sql() + "SELECT \"column\", inferred_type, datetime_score, role FROM schema_", RV)
def q_schema_profile(spark, sf):
    return B.detect_schema(_profile(spark, sf)).select("column", "inferred_type", "datetime_score", "role")


@query("column_validity", profile_sql() + """
SELECT "column", datetime_ratio * non_null >= 3 AS valid_datetime, numeric_ratio * non_null >= 3 AS valid_numeric FROM profile2""", RV)
def q_column_validity(spark, sf):
    from quarry.sources.delimited import column_validity

    return column_validity(raw_orders(spark, sf))


@query("parse_numeric", ", raw_ AS (SELECT * FROM raw_orders)\nSELECT order_id AS raw_id, " + ", ".join(
    f"{s_parse(c, s_flag(c))} AS {c}" for c in ["total_price", "total_eu", "discount"]) + " FROM raw_orders", RV)
def q_parse_numeric(spark, sf):
    r = raw_orders(spark, sf)
    cols = ["total_price", "total_eu", "discount"]
    flags = {c: r.agg(F.count_if(P.euro_row(F.col(c))) > 0).scalar() for c in cols}
    return r.select(F.col("order_id").alias("raw_id"), *[P.parse_numeric(F.col(c), flags[c]).alias(c) for c in cols])


# ------------------------------------------------------------------ C: cleaning with the detected roles
NONEMPTY = "ne AS (SELECT * FROM raw_orders WHERE NOT (" + " AND ".join(f"{c} IS NULL" for c in COLS) + "))"


def s_typed(c: str) -> str:
    if c == DT_COL:
        return f"try_strptime({c}, '{DT_FMT}')"
    if c in NUMERIC:
        return s_parse(c, "TRUE" if c == "total_eu" else "FALSE")
    if c in BOOLEAN:
        return f"coalesce(lower(trim({c})) IN ({', '.join(repr(t) for t in P.BOOL_TRUTHY)}), FALSE)"
    return f"nullif(trim({c}), '')"


TYPED = ", " + NONEMPTY + ",\ntyped AS (SELECT " + ", ".join(f"{c} AS _raw_{c}, {s_typed(c)} AS {c}" for c in COLS) + " FROM ne),\n" + \
    "rec AS (SELECT *, " + DT_COL + " AS \"timestamp\", CAST(to_json(struct_pack(" + ", ".join(f"{c} := {c}" for c in COLS if c != DT_COL) + \
    ")) AS VARCHAR) AS payload, (" + " OR ".join(f"{c} IS NOT NULL" for c in COLS if c != DT_COL) + f") AND {DT_COL} IS NOT NULL AS is_valid, " + \
    f"_raw_{DT_COL} IS NOT NULL AND {DT_COL} IS NULL AS ts_failed FROM typed)\n"


def _raw(spark, sf):
    return raw_orders(spark, sf)


def _roles(spark, sf):
    return C.plan_roles(_raw(spark, sf))


@query("drop_empty_rows", ", " + NONEMPTY + """
SELECT (SELECT count(*) FROM raw_orders) AS rows_before, count(*) AS rows_after,
       (SELECT count(*) FROM raw_orders) - count(*) AS dropped_empty FROM ne""", RV)
def q_drop_empty_rows(spark, sf):
    r = _raw(spark, sf)
    before = r.agg(F.count(F.lit(1))).scalar()
    kept = C.drop_empty_rows(r).agg(F.count(F.lit(1)).alias("rows_after"))
    return kept.select(before.alias("rows_before"), "rows_after", (before - F.col("rows_after")).alias("dropped_empty"))


@query("numeric_failures", TYPED + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(_raw_{c}) AS non_null, count({c}) AS parsed, count(_raw_{c}) - count({c}) AS failures FROM typed"
    for c in NUMERIC), RV)
def q_numeric_failures(spark, sf):
    return C.numeric_failures(_raw(spark, sf), _roles(spark, sf))


@query("cast_boolean", TYPED + "SELECT order_id, is_final FROM typed", RV)
def q_cast_boolean(spark, sf):
    return C.typed(C.drop_empty_rows(_raw(spark, sf)), _roles(spark, sf)).select("order_id", "is_final")


@query("cast_datetime", TYPED + "SELECT order_id, _raw_order_date, order_date FROM typed", RV)
def q_cast_datetime(spark, sf):
    return C.typed(C.drop_empty_rows(_raw(spark, sf)), _roles(spark, sf)).select("order_id", "_raw_order_date", "order_date")


@query("sanitize", TYPED + "SELECT order_id, updated_at, status, priority FROM typed", RV)
def q_sanitize(spark, sf):
    return C.typed(C.drop_empty_rows(_raw(spark, sf)), _roles(spark, sf)).select("order_id", "updated_at", "status", "priority")


@query("build_payload", TYPED + "SELECT order_id, \"timestamp\", payload FROM rec", RV)
def q_build_payload(spark, sf):
    return C.records(_raw(spark, sf), _roles(spark, sf)).select("order_id", "timestamp", "payload")


@query("valid_split", TYPED + "SELECT is_valid, count(*) AS records FROM rec GROUP BY is_valid", RV)
def q_valid_split(spark, sf):
    return C.valid_split(C.records(_raw(spark, sf), _roles(spark, sf)))


REPORT = TYPED + ", rep AS (SELECT count(*) AS total_records, count_if(is_valid) AS valid_records, count_if(NOT is_valid) AS invalid_records, " + \
    "count_if(ts_failed) AS timestamp_failures, " + ", ".join(f"count(_raw_{c}) - count({c}) AS numeric_failures__{c}" for c in NUMERIC) + \
    ", (SELECT count(*) FROM raw_orders) - count(*) AS dropped_empty_rows, " + \
    "CASE WHEN count(*) > 0 THEN count_if(is_valid) / count(*) ELSE 0.0 END AS valid_ratio FROM rec)\n"


@query("transform_report", REPORT + "SELECT * FROM rep", RV)
def q_transform_report(spark, sf):
    r = _raw(spark, sf)
    return C.transformation_report(r, C.plan_roles(r))


@query("quality_flags", REPORT + """
SELECT 'TIMESTAMP_PARSE_FAILURES' AS flag, 'order_date' AS "column", timestamp_failures AS count, CAST(NULL AS DOUBLE) AS ratio FROM rep WHERE timestamp_failures > 0
UNION ALL SELECT 'LOW_VALID_RATIO', NULL, NULL, valid_ratio FROM rep WHERE valid_ratio < 0.9
UNION ALL SELECT 'EMPTY_ROWS_DROPPED', NULL, dropped_empty_rows, NULL FROM rep WHERE dropped_empty_rows > 0
""" + "\n".join(f"UNION ALL SELECT 'NUMERIC_COERCION_FAILURE', '{c}', numeric_failures__{c}, NULL FROM rep WHERE numeric_failures__{c} > 0"
                for c in NUMERIC) + "\n" + "\n".join(
    f"UNION ALL SELECT 'HIGH_NULL_RATIO', '{c}', NULL, (count(*) - count({c})) / count(*) FROM raw_orders HAVING (count(*) - count({c})) / count(*) > 0.5"
    for c in COLS), RV)
def q_quality_flags(spark, sf):
    r = _raw(spark, sf)
    roles = C.plan_roles(r)
    return C.quality_flags(C.transformation_report(r, roles), roles)


@query("normalize_columns", """
SELECT p_partkey AS p_partkey_col, p_name AS p_name_col, p_brand AS p_brand_col, p_type AS p_type_col, p_size AS p_size_col,
       p_retailprice AS p_retailprice_col FROM part""")
def q_normalize_columns(spark, sf):
    """A2 over a real table: the part table with upload-style headers renamed back to normalised names."""
    from quarry.sources.delimited import normalize_columns
    from quarry.sources.tables import table

    part = table(spark, sf, "part")
    messy = part.toDF(*[f" {c.replace('_', ' ').title()}-Col " for c in part.columns])
    return normalize_columns(messy)


MAPPING = {"order_date": "date", "total_price": "sales", "priority": "category", "status": "location"}


@query("map_columns", """
SELECT order_id, try_strptime(order_date, '%Y-%m-%d') AS date, updated_at, status AS location, priority AS category,
       total_price AS sales, total_eu, discount, is_final, customer
FROM raw_orders""", RV)
def q_map_columns(spark, sf):
    from quarry.sources.delimited import map_columns

    return map_columns(raw_orders(spark, sf), MAPPING, date_format="yyyy-MM-dd")


@query("preview", """
SELECT * FROM raw_orders ORDER BY TRY_CAST(order_id AS BIGINT) NULLS FIRST LIMIT 10""", RV)
def q_preview(spark, sf):
    from quarry.sources.delimited import preview

    r = raw_orders(spark, sf)
    return preview(r, 10, [F.col("order_id").try_cast("bigint").asc_nulls_first()])


def _role_kinds_sql(text: list[str], numbers: list[str]) -> str:
    parts = [f"SELECT {i} AS ordinal, '{c}' AS col, count({c}) AS v, count(TRY_CAST({c} AS DOUBLE)) AS n, count(try_strptime({c}, '%Y-%m-%d')) AS d FROM up"
             for i, c in enumerate(text)]
    parts += [f"SELECT {len(text) + i}, '{c}', count({c}), count({c}), 0 FROM up" for i, c in enumerate(numbers)]
    return " UNION ALL ".join(parts)


ROLE_TEXT, ROLE_NUMBERS = ["date", "region", "product", "category", "sales", "stock"], ["production", "defect"]
ROLE_NAMES = {"production": ("production", "output", "produced", "units_produced"), "stock": ("stock", "inventory", "closing_stock", "on_hand"),
              "defect": ("defect", "reject", "defect_rate", "quality"), "category": ("category", "sku", "product", "brand", "segment")}


def _named_sql(role: str) -> str:
    return "(" + " OR ".join(f"contains(col, '{h}')" for h in ROLE_NAMES[role]) + ")"


@query("suggest_columns", f"""
, up AS (SELECT strftime(date, '%Y-%m-%d') AS date, region, product, category, CAST(sales AS VARCHAR) AS sales, CAST(stock AS VARCHAR) AS stock,
                production, defect FROM sales_fact),
k AS ({_role_kinds_sql(ROLE_TEXT, ROLE_NUMBERS)}),
kinds AS (SELECT *, CASE WHEN v = 0 THEN 'empty' WHEN n >= 0.8 * v THEN 'number' WHEN d >= 0.8 * v THEN 'date' ELSE 'text' END AS kind FROM k)
SELECT 'sales' AS role, arg_min(col, ordinal) AS "column" FROM kinds WHERE kind = 'number'
""" + "".join(f"UNION ALL SELECT '{r}', arg_min(col, ordinal) FROM kinds WHERE kind = '{'text' if r == 'category' else 'number'}' AND {_named_sql(r)} HAVING count(*) > 0\n"
              for r in ROLE_NAMES) + "UNION ALL SELECT 'date', arg_min(col, ordinal) FROM kinds WHERE kind = 'date' HAVING count(*) > 0", ["sales_fact"])
def q_suggest_columns(spark, sf):
    """A9 over an upload of the sales fact whose dates and amounts are text: kinds are decided by all values."""
    from quarry.plans.views import sales_fact
    from quarry.sources.delimited import suggest_roles

    fact = sales_fact(spark, sf)
    as_text = {"date": F.date_format("date", "yyyy-MM-dd"), "sales": F.col("sales").cast("string"), "stock": F.col("stock").cast("string")}
    return suggest_roles(fact.select(*[as_text.get(c, F.col(c)).alias(c) for c in ROLE_TEXT + ROLE_NUMBERS]))


# ------------------------------------------------------------------ files written from raw_orders and read back
NOTE = "Note, as typed"      # header of a text field with quotes, separators and line breaks


def _upload(spark, sf) -> tuple[str, list[str]]:
    """raw_orders as delimited files with one awkward text field, in the shared folder: (folder, files)."""
    import uuid

    from quarry.session import checkpoint_dir

    folder = f"{checkpoint_dir(spark)}/upload-{uuid.uuid4().hex}"
    rows = raw_orders(spark, sf)
    note = F.when(F.col("status") == "O", F.concat(F.lit('said "'), F.col("customer"), F.lit('", twice\non two lines'))).otherwise(F.col("priority"))
    plain = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    rows.withColumn(NOTE, note).write.options(header="true", escape='"', **plain).csv(f"{folder}/in")
    files = [r["path"] for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(f"{folder}/in").select("path").collect()]
    return folder, sorted(files)


@query("read_delimited", f"""
SELECT *, CASE WHEN status = 'O' THEN 'said "' || customer || '", twice' || chr(10) || 'on two lines' ELSE priority END AS "{NOTE}" FROM raw_orders""", RV)
def q_read_delimited(spark, sf):
    from quarry.sources.delimited import read_delimited

    return read_delimited(spark, _upload(spark, sf)[1])


def _ingested(spark, sf):
    from quarry.sources.ingest import ingest

    folder, files = _upload(spark, sf)
    report = ingest(spark, files, f"{folder}/points", f"{folder}/registry", name="orders", dataset_id="orders")
    return folder, report


@query("ingested_points", """
SELECT 'orders' AS dataset_id, try_strptime(order_date, '%Y-%m-%d') AS "timestamp", try_strptime(order_date, '%Y-%m-%d') IS NOT NULL AS is_valid,
       CAST(order_id AS DOUBLE) AS order_id, CAST(customer AS DOUBLE) AS customer, status
FROM raw_orders WHERE order_id IS NOT NULL""", RV)
def q_ingested_points(spark, sf):
    """Points of a whole ingestion of files, read back from the store."""
    from quarry.sources import store

    points = store.read_points(spark, f"{_ingested(spark, sf)[0]}/points")
    number = lambda c: store.field_text(c).cast("double").alias(c)
    return points.select("dataset_id", "timestamp", "is_valid", number("order_id"), number("customer"), store.field_text("status").alias("status"))


@query("ingestion_report", REPORT + f"""
SELECT 'orders' AS name, 'success' AS status, 'order_date' AS datetime_column, '{",".join(NUMERIC)}' AS numeric_columns, '{",".join(BOOLEAN)}' AS boolean_columns,
       total_records, valid_records, invalid_records, dropped_empty_rows, timestamp_failures, valid_ratio,
       {" + ".join(f"numeric_failures__{c}" for c in NUMERIC)} AS numeric_failures
FROM rep""", RV)
def q_ingestion_report(spark, sf):
    """C11: the stored report of a whole ingestion of files."""
    report = _ingested(spark, sf)[1]
    failures = F.aggregate("numeric_coercion_failures", F.lit(0).cast("bigint"), lambda acc, f: acc + f["failures"])
    return report.select(
        "name", "status", "schema.datetime_column", F.array_join("schema.numeric_columns", ",").alias("numeric_columns"),
        F.array_join("schema.boolean_columns", ",").alias("boolean_columns"), "total_records", "valid_records", "invalid_records", "dropped_empty_rows",
        "timestamp_failures", "valid_ratio", failures.alias("numeric_failures"))


def _stored(spark, sf) -> str:
    """Two datasets stored as batches, one of them written again by a second attempt, the other published from staging."""
    import uuid

    from quarry.plans.views import event_points
    from quarry.session import checkpoint_dir
    from quarry.sources import store

    folder = f"{checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    points = event_points(spark, sf)
    for name in ("click", "purchase"):
        for batch, valid in ((0, False), (1, True), (1, True)):
            target = f"{folder}/staged" if name == "purchase" else f"{folder}/points"
            own = points.where((F.col("dataset_id") == name) & (F.col("is_valid") == valid))
            store.write_points(own.select("row_index", "timestamp", "payload", "is_valid"), target, name, batch=batch)
    store.publish_points(spark, f"{folder}/staged", f"{folder}/points", "purchase")
    return f"{folder}/points"


@query("stored_points", """
SELECT dataset_id, CAST(CASE WHEN is_valid THEN 1 ELSE 0 END AS BIGINT) AS batch, count(*) AS points, CAST(sum(row_index) AS BIGINT) AS row_index_sum,
       min("timestamp") AS first_point, max("timestamp") AS last_point
FROM event_points WHERE dataset_id IN ('click', 'purchase') GROUP BY ALL""", ["event_points"])
def q_stored_points(spark, sf):
    """A5: batches of two datasets, read back."""
    from quarry.sources import store

    return store.read_points(spark, _stored(spark, sf)).groupBy("dataset_id", F.col("batch").cast("bigint").alias("batch")).agg(
        F.count(F.lit(1)).alias("points"), F.sum("row_index").alias("row_index_sum"), F.min("timestamp").alias("first_point"), F.max("timestamp").alias("last_point"))


@query("stored_summaries", """
SELECT dataset_id, count(*) AS point_count, min("timestamp") AS first_point, max("timestamp") AS last_point,
       count_if(NOT is_valid) AS invalid_points, count(DISTINCT is_valid) AS batches
FROM event_points WHERE dataset_id IN ('click', 'purchase') GROUP BY dataset_id""", ["event_points"])
def q_stored_summaries(spark, sf):
    """D5, D6 from the row stored with every batch."""
    from quarry.sources import store

    return store.stored_summaries(spark, _stored(spark, sf))


@query("file_fingerprints", """
SELECT o_orderstatus AS status, md5(string_agg(o_orderkey || ' ' || o_orderpriority, chr(10) ORDER BY o_orderkey) || chr(10)) AS md5,
       CAST(length(string_agg(o_orderkey || ' ' || o_orderpriority, chr(10))) + 1 AS BIGINT) AS length
FROM orders GROUP BY o_orderstatus""")
def q_file_fingerprints(spark, sf):
    """A3: one file per order status, written and fingerprinted."""
    import uuid

    from quarry.session import checkpoint_dir
    from quarry.sources.delimited import file_fingerprints
    from quarry.sources.tables import table

    folder = f"{checkpoint_dir(spark)}/prints-{uuid.uuid4().hex}"
    lines = table(spark, sf, "orders").select("o_orderstatus", "o_orderkey", F.concat_ws(" ", "o_orderkey", "o_orderpriority").alias("line"))
    dealt = lines.repartition(F.col("o_orderstatus")).sortWithinPartitions("o_orderstatus", "o_orderkey")
    dealt.select("o_orderstatus", "line").write.partitionBy("o_orderstatus").text(folder)
    prints = file_fingerprints(spark, [f"{folder}/o_orderstatus=*"])
    return prints.select(F.regexp_extract("path", "o_orderstatus=([A-Z])", 1).alias("status"), "md5", "length")
