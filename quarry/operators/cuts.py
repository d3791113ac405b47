"""Group-by cuts, pivot, value counts and filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.common import num


def sum_by(df: DataFrame, key: str, value: str = "sales") -> DataFrame:
    """L1: sum per key."""
    return df.groupBy(key).agg(F.sum(num(value)).alias("total"))


def share_by(df: DataFrame, key: str, value: str = "sales") -> DataFrame:
    """L2: sum per key and its share of the grand total (total is a scalar subquery)."""
    per = df.groupBy(key).agg(F.sum(num(value)).alias("total"))
    grand = per.agg(F.sum("total")).scalar()
    return per.withColumn("share", F.try_divide(F.col("total"), grand))


def pivot_sum(df: DataFrame, row: str, column: str, values: Sequence[str] | None = None, value: str = "sales") -> DataFrame:
    """L3: row x column sums, missing cells = 0.

    Without ``values`` the columns are all values found in the data (Spark reads
    them with a distinct job and refuses more than spark.sql.pivotMaxValues).
    """
    grouped = df.groupBy(row)
    out = (grouped.pivot(column) if values is None else grouped.pivot(column, list(values))).agg(F.sum(num(value)))
    return out.na.fill(0.0, subset=[c for c in out.columns if c != row])


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """L4: frequency per value, descending."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(), column)


def category_filter(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Keep rows whose text form is in ``values``; an empty list keeps everything."""
    if not values:
        return df
    return df.where(F.col(column).cast("string").isin([str(v) for v in values]))


def distinct_values(df: DataFrame, column: str, max_values: int = 50) -> DataFrame:
    """All sorted non-null distinct values plus whether the column qualifies as a filter (1 < n <= max)."""
    d = df.select(column).where(F.col(column).isNotNull()).distinct()
    n = d.agg(F.count(F.lit(1))).scalar()
    return d.orderBy(column).withColumns({"n_distinct": n, "selectable": (n > 1) & (n <= max_values)})
