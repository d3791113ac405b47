"""Small column-expression helpers shared by operators (all JVM-side)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def num(c: str | Column) -> Column:
    """Coerce to DOUBLE; text that is not a number becomes NULL, and so do NaN/Inf."""
    x = F.expr(f"try_cast(`{c}` AS DOUBLE)") if isinstance(c, str) else c.try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None).cast("double")).otherwise(x)


def safe_div(a: Column, b: Column) -> Column:
    """a / b, NULL when b is 0 or NULL (never raises under ANSI mode)."""
    return F.try_divide(a, b)


def pct(a: Column, b: Column) -> Column:
    return F.try_divide(a, b) * 100.0


def count_if(cond: Column) -> Column:
    return F.count_if(cond)


def maybe_round(c: Column, decimals: int | None) -> Column:
    """Half-even rounding (Python's ``round``) when ``decimals`` is given."""
    return c if decimals is None else F.bround(c, decimals)


def group(df: DataFrame, keys: Sequence[str]):
    """groupBy(keys) or a global aggregation when no keys are given."""
    return df.groupBy(*keys) if keys else df.groupBy()


def first_of(df: DataFrame, order: Sequence[Column], n: int = 1) -> DataFrame:
    """Top-n rows by an ordering (TakeOrderedAndProject: each task keeps n rows)."""
    return df.orderBy(*order).limit(n)


def join_keys(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys``; with no keys both sides are single aggregate rows."""
    return a.join(b, list(keys), how) if keys else join_one_row(a, b)


def join_one_row(a: DataFrame, b: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate ``b`` to ``a``.

    ``b`` is packed into one struct and inlined as a scalar subquery (computed
    once), so no join - and no cross join - appears in the plan.
    """
    packed = b.select(F.struct(*[F.col(f"`{c}`") for c in b.columns]).alias("_s")).scalar()
    return a.select("*", *[packed.getField(c).alias(c) for c in b.columns])


def spread(df: DataFrame) -> DataFrame:
    """Round-robin small inputs over all cores before CPU-heavy per-row work.

    Only applies when the input has fewer partitions than the default
    parallelism (a single small file); large inputs are left untouched.
    """
    sc = df.sparkSession.sparkContext
    try:
        parts = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - plan without an RDD view
        return df
    target = sc.defaultParallelism
    return df.repartition(target) if parts < target else df
