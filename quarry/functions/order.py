"""Row order for positional operators, without single-task windows.

pandas code relies on implicit row order; Spark has none.  Operators that are
positional therefore take an explicit ``order_by`` (which must be a unique
total order for deterministic results) and optional ``keys``.

``with_row_index`` numbers rows 0..n-1 inside each key, deterministically:

1. Spark deals the rows into ranges of (keys, order), sorts every range, and
   notes each row's range and place in it; that is checkpointed
   (``spark.checkpoint.dir``), so the plan behind it runs once and the ranges
   are fixed;
2. counts per (key, range), partially aggregated, give the number of earlier
   rows of the key;
3. index = that number + place in the range - the key's first place in it.

There are ``spark.sql.shuffle.partitions`` ranges; the numbering is the same
whatever their number.  A hot key spans several ranges, ties of prefixes spread
as well, and NULL keys are a key of their own.  No row is sent to the driver:
without keys it sees one count a range.

``rolling`` evaluates a row-count window (rowsBetween(-(w-1), 0)) with *halo
buckets*: rows are cut into buckets of ``bucket_rows`` consecutive rows per key
and the last w-1 rows of each bucket are copied into the next one, so each
window task holds at most bucket_rows + w - 1 rows whatever the key skew.
``neighbours`` does the same for functions that look back a number of rows, and
``earlier`` adds lags along a series that way.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import checkpoint_dir

DEFAULT_BUCKET_ROWS = 1 << 18
_PLACE_BITS = 33   # monotonically_increasing_id: the partition above, the place in it below


def _earlier_rows(counts: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Per (key, range): the sums of ``names`` over the key's earlier ranges."""
    if keys:
        prior = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        sums = [F.coalesce(F.sum(n).over(prior), F.lit(0)).cast("bigint").alias(f"_before{n}") for n in names]
        return counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_ob"), "_first", *sums)
    rows, seen = [], [0] * len(names)
    for r in sorted(counts.collect(), key=lambda r: r["_b"]):      # one row a range
        rows.append((r["_b"], r["_first"], *seen))
        seen = [total + r[n] for total, n in zip(seen, names)]
    schema = "_ob bigint, _first bigint, " + ", ".join(f"_before{n} bigint" for n in names)
    return F.broadcast(counts.sparkSession.createDataFrame(rows, schema))


def with_row_index(
    df: DataFrame,
    order_by: Sequence[str],
    keys: Sequence[str] = (),
    idx: str = "idx",
    buckets: int | None = None,
    running: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Adds ``idx``; ``running`` adds, per name, the number of earlier rows of the key that meet a condition.

    ``buckets`` is the number of ranges (``spark.sql.shuffle.partitions`` by default).
    """
    keys, order_by, running = list(keys), list(order_by), dict(running or {})
    spark = df.sparkSession
    checkpoint_dir(spark)
    ranges = buckets or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = df.repartitionByRange(ranges, *keys, *order_by).sortWithinPartitions(*keys, *order_by)
    base = ranged.withColumn("_at", F.monotonically_increasing_id()).checkpoint(eager=True)
    place = F.col("_at").bitwiseAND((1 << _PLACE_BITS) - 1)
    tagged = base.withColumn("_b", F.shiftright("_at", _PLACE_BITS))
    names = ["_rows", *[f"_{n}" for n in running]]
    counts = tagged.groupBy(*keys, "_b").agg(
        F.min(place).alias("_first"), F.count(F.lit(1)).alias("_rows"), *[F.count_if(c).alias(f"_{n}") for n, c in running.items()])
    same = F.col("_b") == F.col("_ob")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    numbered = tagged.join(_earlier_rows(counts, keys, names), same)
    numbered = numbered.withColumn(idx, F.col("_before_rows") + place - F.col("_first"))
    inside = Window.partitionBy(*keys, "_b").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    for n, c in running.items():
        numbered = numbered.withColumn(n, F.col(f"_before_{n}") + F.coalesce(F.count_if(c).over(inside), F.lit(0)))
    return numbered.drop("_at", "_b", "_ob", "_first", *[f"_before{n}" for n in names], *[f"_k{i}" for i in range(len(keys))])


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    idx: str,
    reach: int,
    make_columns: Callable[[Window], dict[str, Column]],
    bucket_rows: int = DEFAULT_BUCKET_ROWS,
) -> DataFrame:
    """Window functions that look back ``reach`` rows at most along a dense per-key index, evaluated in halo buckets.

    ``make_columns(w)`` receives the window of a bucket (no frame) and returns the new columns.
    """
    if reach >= bucket_rows:
        raise ValueError("window longer than a bucket; raise bucket_rows")
    bucket = F.floor(F.col(idx) / bucket_rows).cast("bigint")
    parts = df.withColumn("_bucket", bucket).withColumn("_halo", F.lit(False))
    if reach > 0:
        copy = (
            df.where(F.pmod(F.col(idx), F.lit(bucket_rows)) >= bucket_rows - reach)
            .withColumn("_bucket", bucket + 1)
            .withColumn("_halo", F.lit(True))
        )
        parts = parts.unionByName(copy)
    out = parts.withColumns(make_columns(Window.partitionBy(*keys, "_bucket").orderBy(idx)))
    return out.where(~F.col("_halo")).drop("_bucket", "_halo")


def rolling(
    df: DataFrame,
    keys: Sequence[str],
    idx: str,
    window: int,
    make_columns: Callable[[Window], dict[str, Column]],
    bucket_rows: int = DEFAULT_BUCKET_ROWS,
) -> DataFrame:
    """Row-count window over a dense per-key index, evaluated in halo buckets.

    ``make_columns(w)`` receives the window spec (rows -(window-1)..0) and
    returns the new columns, e.g. ``lambda w: {"ma": F.avg("x").over(w)}``.
    """
    halo = max(window - 1, 0)
    return neighbours(df, keys, idx, halo, lambda w: make_columns(w.rowsBetween(-halo, 0)), bucket_rows)


def positions(series: DataFrame, keys: Sequence[str], order: str = "date") -> DataFrame:
    """Adds ``_i`` (position from 0 in ``order``) and ``_n`` (points) per key.

    Keyed series number themselves in windows of their key; one series over
    the whole table goes through the distributed row index, so that points
    finer than days never meet in one task.
    """
    if keys:
        w = Window.partitionBy(*keys)
        return series.withColumns({"_i": (F.row_number().over(w.orderBy(order)) - 1).cast("bigint"), "_n": F.count(F.lit(1)).over(w)})
    idx = with_row_index(series, [order], idx="_i")
    return idx.withColumn("_n", idx.agg(F.count(F.lit(1))).scalar())


def rolling_by(series: DataFrame, keys: Sequence[str], window: int, make_columns: Callable[[Window], dict[str, Column]], order: str = "date") -> DataFrame:
    """Row-count window along ``order``: within the key, or over row index and halo buckets for one series."""
    if keys:
        return series.withColumns(make_columns(Window.partitionBy(*keys).orderBy(order).rowsBetween(-(window - 1), 0)))
    return rolling(with_row_index(series, [order], idx="_i"), [], "_i", window, make_columns).drop("_i")


def earlier(series: DataFrame, keys: Sequence[str], lags: Mapping[str, tuple[str, int]], order: str = "date", idx: str | None = None) -> DataFrame:
    """Adds, per name, the value that a column had a number of points before: ``{name: (column, points)}``.

    Keyed series look back in windows of their key; one series over the whole
    table goes through row index and halo buckets (``idx`` names an index it
    already has).
    """
    def columns(w: Window) -> dict[str, Column]:
        return {name: F.lag(c, k).over(w) for name, (c, k) in lags.items()}

    if keys:
        return series.withColumns(columns(Window.partitionBy(*keys).orderBy(order)))
    numbered = series if idx else with_row_index(series, [order], idx="_at_point")
    out = neighbours(numbered, [], idx or "_at_point", max(k for _, k in lags.values()), columns)
    return out if idx else out.drop("_at_point")


def with_enough_points(series: DataFrame, keys: Sequence[str], least: int) -> DataFrame:
    """The series with at least ``least`` points; without keys their number is a scalar subquery."""
    if keys:
        counted = series.withColumn("_points", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
        return counted.where(F.col("_points") >= least).drop("_points")
    return series.where(series.agg(F.count(F.lit(1))).scalar() >= least)
