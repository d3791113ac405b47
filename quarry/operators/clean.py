"""Cleaning and record building (C1-C11): typed columns, payload JSON, validity, report and flags.

``plan_roles`` is the only driver step: it reads the schema profile (one row
per column) to decide how each column is cast.  Every other step is a lazy
column expression, and all counters of the report come from one aggregation.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import parse as P
from quarry.functions.common import spread
from quarry.operators.profile import detect_schema, profile_columns

# Fixed thresholds of the quality flags.
HIGH_NULL_RATIO = 0.5
LOW_VALID_RATIO = 0.9


@dataclass
class Roles:
    datetime: str | None = None
    datetime_format: str | None = None
    numeric: list[str] = field(default_factory=list)
    boolean: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    european: dict[str, bool] = field(default_factory=dict)
    null_ratio: dict[str, float] = field(default_factory=dict)


def plan_roles(df: DataFrame, profile: DataFrame | None = None) -> Roles:
    """Collect the schema profile's per-column rows (bounded by the column count); without one, run it (one job)."""
    if profile is None:
        profile = detect_schema(profile_columns(df, with_distinct=False))
    rows = profile.orderBy("ordinal").collect()
    r = Roles()
    for row in rows:
        r.european[row["column"]] = bool(row["european"])
        r.null_ratio[row["column"]] = float(row["null_ratio"])
        if row["role"] == "datetime":
            r.datetime, r.datetime_format = row["column"], row["datetime_format"]
        elif row["role"] == "numeric":
            r.numeric.append(row["column"])
        elif row["role"] == "boolean":
            r.boolean.append(row["column"])
        else:
            r.text.append(row["column"])
    return r


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Rows where every column is NULL are dropped (``na.drop("all")``)."""
    return df.na.drop("all")


def sanitize_text(c: Column) -> Column:
    """C5 for text: trimmed, empty -> NULL."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def typed(df: DataFrame, roles: Roles, null_as_false: bool = True, passthrough: list[str] | None = None) -> DataFrame:
    """Cast numeric / boolean / datetime columns, sanitize text; raw copies kept as ``_raw_<col>``."""
    passthrough = list(passthrough or [])
    cols = [F.col(f"`{c}`") for c in passthrough]
    for c in df.columns:
        if c in passthrough:
            continue
        src = F.col(f"`{c}`")
        cols.append(src.alias(f"_raw_{c}"))
        if c == roles.datetime:
            if isinstance(df.schema[c].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
                cols.append(src.cast("timestamp_ntz").alias(c))
            else:
                cols.append(P.parse_any_datetime(src, roles.datetime_format).alias(c))
        elif c in roles.numeric:
            cols.append(P.parse_numeric(src, roles.european.get(c, False)).alias(c))
        elif c in roles.boolean:
            cols.append(P.to_bool(src, null_as_false).alias(c))
        else:
            cols.append(sanitize_text(src).alias(c))
    return df.select(*cols)


def build_payload(t: DataFrame, roles: Roles, columns: list[str]) -> Column:
    """Every column except the datetime one as JSON; NULL values are kept as null keys."""
    keep = [c for c in columns if c != roles.datetime]
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in keep]), {"ignoreNullFields": "false"})


def records(df: DataFrame, roles: Roles, null_as_false: bool = True, keep: list[str] | None = None, drop_empty: bool = True) -> DataFrame:
    """Records ``(timestamp, payload, is_valid, ts_failed)`` from the non-empty rows.

    Validity (C8, build rule): the payload has at least one non-null value and,
    when a datetime column exists, its timestamp parsed.
    """
    keep = list(keep or [])
    columns = [c for c in df.columns if c not in keep]
    source = spread(df)
    if drop_empty:
        source = source.na.drop("all", subset=columns)  # C1 on the data columns; kept columns pass through
    t = typed(source, roles, null_as_false, passthrough=keep)
    payload_cols = [c for c in columns if c != roles.datetime]
    has_value = F.lit(False)
    for c in payload_cols:
        has_value = has_value | F.col(f"`{c}`").isNotNull()
    if roles.datetime:
        ts = F.col(f"`{roles.datetime}`")
        ts_failed = F.col(f"`_raw_{roles.datetime}`").isNotNull() & ts.isNull()
        valid = has_value & ts.isNotNull()
    else:
        ts = F.lit(None).cast("timestamp_ntz")
        ts_failed = F.lit(False)
        valid = has_value
    return t.select("*", ts.alias("timestamp"), build_payload(t, roles, columns).alias("payload"),
                    valid.alias("is_valid"), ts_failed.alias("ts_failed"))


def valid_split(rec: DataFrame) -> DataFrame:
    """Counts of valid and invalid records (the split itself is ``where(is_valid)``)."""
    return rec.groupBy("is_valid").agg(F.count(F.lit(1)).alias("records"))


def transformation_report(df: DataFrame, roles: Roles) -> DataFrame:
    """One aggregation over raw + typed columns: totals, validity, drops, parse failures."""
    rec = records(df, roles, drop_empty=False)
    empty = F.lit(True)
    for c in df.columns:
        empty = empty & F.col(f"`_raw_{c}`").isNull()
    aggs = [
        F.count_if(~empty).alias("total_records"),
        F.count_if(F.col("is_valid") & ~empty).alias("valid_records"),
        F.count_if(~F.col("is_valid") & ~empty).alias("invalid_records"),
        F.count_if("ts_failed").alias("timestamp_failures"),
        F.count_if(empty).alias("dropped_empty_rows"),
    ]
    for c in roles.numeric:
        aggs.append((F.count(F.col(f"`_raw_{c}`")) - F.count(F.col(f"`{c}`"))).alias(f"numeric_failures__{c}"))
    return rec.agg(*aggs).select(
        "*",
        F.when(F.col("total_records") > 0, F.col("valid_records") / F.col("total_records")).otherwise(F.lit(0.0)).alias("valid_ratio"),
    )


def numeric_failures(df: DataFrame, roles: Roles) -> DataFrame:
    """Per numeric column: non-null before, parsed after, failures."""
    t = typed(drop_empty_rows(spread(df)), roles)
    wide = t.agg(*[F.struct(F.lit(c).alias("column"), F.count(F.col(f"`_raw_{c}`")).alias("non_null"),
                            F.count(F.col(f"`{c}`")).alias("parsed")).alias(f"s{i}") for i, c in enumerate(roles.numeric)])
    long = wide.select(F.explode(F.array(*[F.col(f"s{i}") for i in range(len(roles.numeric))])).alias("s")).select("s.*")
    return long.withColumn("failures", F.col("non_null") - F.col("parsed"))


def quality_flags(report: DataFrame, roles: Roles) -> DataFrame:
    """(flag, column, count, ratio) rows derived from the report row and the profile ratios."""
    flags = [
        F.when(F.lit(roles.datetime is None), F.struct(F.lit("NO_DATETIME_COLUMN").alias("flag"), F.lit(None).cast("string").alias("column"),
                                                        F.lit(None).cast("bigint").alias("count"), F.lit(None).cast("double").alias("ratio"))),
        F.when(F.col("timestamp_failures") > 0, F.struct(F.lit("TIMESTAMP_PARSE_FAILURES").alias("flag"), F.lit(roles.datetime).cast("string").alias("column"),
                                                          F.col("timestamp_failures").cast("bigint").alias("count"), F.lit(None).cast("double").alias("ratio"))),
        F.when(F.col("valid_ratio") < LOW_VALID_RATIO, F.struct(F.lit("LOW_VALID_RATIO").alias("flag"), F.lit(None).cast("string").alias("column"),
                                                                F.lit(None).cast("bigint").alias("count"), F.col("valid_ratio").alias("ratio"))),
        F.when(F.col("dropped_empty_rows") > 0, F.struct(F.lit("EMPTY_ROWS_DROPPED").alias("flag"), F.lit(None).cast("string").alias("column"),
                                                          F.col("dropped_empty_rows").cast("bigint").alias("count"), F.lit(None).cast("double").alias("ratio"))),
    ]
    for c in roles.numeric:
        fc = F.col(f"numeric_failures__{c}")
        flags.append(F.when(fc > 0, F.struct(F.lit("NUMERIC_COERCION_FAILURE").alias("flag"), F.lit(c).alias("column"),
                                              fc.cast("bigint").alias("count"), F.lit(None).cast("double").alias("ratio"))))
    for c, ratio in roles.null_ratio.items():
        if ratio > HIGH_NULL_RATIO:
            flags.append(F.struct(F.lit("HIGH_NULL_RATIO").alias("flag"), F.lit(c).alias("column"),
                                  F.lit(None).cast("bigint").alias("count"), F.lit(float(ratio)).alias("ratio")))
    return report.select(F.explode(F.array_compact(F.array(*flags))).alias("f")).select("f.*")
