"""Data-quality measures: missing cells, duplicates, column type summaries, score and label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.common import join_one_row

# Fixed thresholds of the quality rules.
MISSING_PENALTY_CAP, DUPLICATE_PENALTY_CAP = 40, 25


def missing_ratio(df: DataFrame) -> DataFrame:
    """Null cells / all cells (fraction and percent) in one aggregation pass."""
    cols = df.columns
    nulls = sum((F.count_if(F.col(f"`{c}`").isNull()) for c in cols), F.lit(0))
    out = df.agg(F.count(F.lit(1)).alias("total_rows"), nulls.alias("missing_cells"))
    cells = F.col("total_rows") * len(cols)
    return out.select(
        "total_rows", F.lit(len(cols)).alias("total_cols"), "missing_cells",
        F.when(cells > 0, F.col("missing_cells") / cells).otherwise(F.lit(0.0)).alias("missing_ratio"),
        F.when(cells > 0, F.col("missing_cells") * 100.0 / cells).otherwise(F.lit(0.0)).alias("missing_pct"),
    )


def missing_per_column(df: DataFrame, only_missing: bool = False) -> DataFrame:
    """Per column null count and percent; one aggregate row unpivoted to (column, ...)."""
    cols = df.columns
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"m_{i}") for i, c in enumerate(cols)])
    stacked = wide.select("_n", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"m_{i}").alias("missing")) for i, c in enumerate(cols)
    ])).alias("s"))
    out = stacked.select(
        "s.column", "s.missing",
        F.when(F.col("_n") > 0, F.col("s.missing") * 100.0 / F.col("_n")).otherwise(F.lit(0.0)).alias("missing_pct"),
    )
    return out.where(F.col("missing") > 0) if only_missing else out


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each full-row value (NULL equals NULL in grouping).

    One shuffle on all columns with map-side partial counts, so a hot group
    collapses before the exchange.
    """
    cols = [F.col(f"`{c}`") for c in df.columns]
    per_value = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_c"))
    return per_value.agg(
        F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).cast("bigint").alias("duplicate_count"),
        F.count(F.lit(1)).alias("distinct_rows"),
    )


def _type_label(t: T.DataType) -> str:
    """B8 vocabulary.  Booleans are reported as Boolean (the reference counted them Numeric)."""
    if isinstance(t, T.BooleanType):
        return "Boolean"
    if isinstance(t, T.NumericType):
        return "Numeric"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "DateTime"
    if isinstance(t, T.StringType):
        return "Text"
    return "Other"


def column_type_counts(df: DataFrame) -> DataFrame:
    """Label -> number of columns.  Schema only; the result is built from the schema."""
    labels = [_type_label(f.dataType) for f in df.schema.fields]
    counts = {k: labels.count(k) for k in ("Numeric", "DateTime", "Boolean", "Text", "Other")}
    return df.sparkSession.createDataFrame([(k, v) for k, v in counts.items() if v], "type string, columns bigint")


def column_types(df: DataFrame, approx: bool = False) -> DataFrame:
    """Boolean / numeric / datetime from the schema; strings are categorical when distinct/non-null < 0.5.

    Distinct counts for all string columns come from one unpivot + two-level
    group-by (exact), or from one HLL pass with ``approx=True``.
    """
    spark = df.sparkSession
    fixed = []
    strings = []
    for f in df.schema.fields:
        t = f.dataType
        if isinstance(t, T.BooleanType):
            fixed.append((f.name, "boolean"))
        elif isinstance(t, T.NumericType):
            fixed.append((f.name, "numeric"))
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            fixed.append((f.name, "datetime"))
        else:
            strings.append(f.name)
    out = spark.createDataFrame(fixed, "column string, type string") if fixed else None
    if strings:
        if approx:
            wide = df.agg(*[F.approx_count_distinct(f"`{c}`").alias(f"d_{i}") for i, c in enumerate(strings)],
                          *[F.count(f"`{c}`").alias(f"n_{i}") for i, c in enumerate(strings)])
            stats = wide.select(F.explode(F.array(*[
                F.struct(F.lit(c).alias("column"), F.col(f"d_{i}").alias("distinct"), F.col(f"n_{i}").alias("non_null"))
                for i, c in enumerate(strings)])).alias("s")).select("s.*")
        else:
            long = df.select(F.explode(F.array(*[
                F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v")) for c in strings
            ])).alias("s")).select("s.*").where(F.col("v").isNotNull())
            stats = long.groupBy("column", "v").agg(F.count(F.lit(1)).alias("_c")).groupBy("column").agg(
                F.count(F.lit(1)).alias("distinct"), F.sum("_c").alias("non_null"))
            # columns that are entirely null still get a row
            names = spark.createDataFrame([(c,) for c in strings], "column string")
            stats = names.join(stats, "column", "left").na.fill(0, ["distinct", "non_null"])
        ratio = F.when(F.col("non_null") > 0, F.col("distinct") / F.col("non_null")).otherwise(F.lit(0.0))
        typed = stats.select("column", F.when(ratio < 0.5, "categorical").otherwise("text").alias("type"))
        out = typed if out is None else out.unionByName(typed)
    return out


def quality_snapshot(df: DataFrame) -> DataFrame:
    """Rows, columns, missing %, duplicate rows and column type counts, one row."""
    labels = [_type_label(f.dataType) for f in df.schema.fields]
    base = join_one_row(missing_ratio(df), duplicate_rows(df).select("duplicate_count"))
    return base.select(
        "total_rows", "total_cols", "missing_pct", "duplicate_count",
        *[F.lit(labels.count(k)).cast("bigint").alias(f"{k.lower()}_cols") for k in ("Numeric", "DateTime", "Boolean", "Text", "Other")],
    )


def quality_score(snapshot: DataFrame) -> DataFrame:
    """E5: 100 - min(40, round(missing %)) - min(25, round(duplicate %)), clamped to 0..100 (half-even rounding)."""
    dup_pct = F.when(F.col("total_rows") > 0, F.col("duplicate_count") * 100.0 / F.col("total_rows")).otherwise(F.lit(0.0))
    score = (F.lit(100) - F.least(F.lit(MISSING_PENALTY_CAP), F.bround("missing_pct", 0).cast("int"))
             - F.least(F.lit(DUPLICATE_PENALTY_CAP), F.bround(dup_pct, 0).cast("int")))
    return snapshot.select("*", dup_pct.alias("duplicate_pct"), F.greatest(F.lit(0), F.least(F.lit(100), score)).alias("quality_score"))


def quality_label(snapshot: DataFrame) -> DataFrame:
    """strong/moderate/weak (issue count rule) and strong/acceptable/needs attention (overview rule)."""
    m = F.col("missing_pct") / 100.0
    dup_ratio = F.when(F.col("total_rows") > 0, F.col("duplicate_count") / F.col("total_rows")).otherwise(F.lit(0.0))
    issues = (F.when(m > 0.05, 1).otherwise(0) + F.when(F.col("duplicate_count") > 0, 1).otherwise(0))
    label = F.when(issues == 0, "strong").when((issues == 1) & (m <= 0.20), "moderate").otherwise("weak")
    short = (F.when((F.col("missing_pct") < 2) & (F.col("duplicate_count") == 0), "strong")
             .when(F.col("missing_pct") < 10, "acceptable").otherwise("needs attention"))
    return snapshot.select("*", dup_ratio.alias("duplicate_ratio"), issues.alias("issues"),
                           label.alias("quality_label"), short.alias("quality_summary"))


def business_columns(df: DataFrame, drop: Sequence[str]) -> DataFrame:
    return df.drop(*drop)
