"""Time-series preparation, descriptive statistics, rolling windows and trend.

A *series* is a DataFrame ``(keys..., date, value)``.  ``daily_series`` builds it
by summing raw rows per date, so its size is bounded by the calendar
(days x keys), never by the raw row count.  Windows on a series are therefore
partitioned by the series keys and stay small.  Operators that the reference
applies to *raw* rows in file order (``kpis``) take an explicit order and read
only the rows they need.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.common import group, join_keys, join_one_row, num
from quarry.functions.order import earlier, positions, rolling_by, with_enough_points
from quarry.functions.quantiles import exact_quantiles

# Fixed thresholds (they define the labels).
TREND_THRESHOLD_PCT = 2.0
CV_LOW, CV_MODERATE = 0.15, 0.40
TREND_WORDS = {
    "metrics": ("upward", "downward", "flat"),
    "trends": ("upward", "downward", "stable"),
    "overview": ("Increasing", "Declining", "Stable"),
}


# ---------------------------------------------------------------- F2, F17
def daily_series(df: DataFrame, date: str = "date", value: str = "sales", keys: Sequence[str] = (),
                 min_points: int = 0) -> DataFrame:
    """coerce, drop nulls, sum per timestamp.  Keys with fewer than ``min_points`` dates are dropped."""
    keys = list(keys)
    rows = df.select(*keys, F.col(date).alias("date"), num(value).alias("value")).dropna(subset=["date", "value"])
    out = rows.groupBy(*keys, "date").agg(F.sum("value").alias("value"))
    if min_points:
        out = with_enough_points(out, keys, min_points)
    return out


def daily_mean(df: DataFrame, date: str = "date", columns: Sequence[str] = ("stock",), keys: Sequence[str] = ()) -> DataFrame:
    """mean per date of one or several columns."""
    return df.groupBy(*keys, date).agg(*[F.avg(num(c)).alias(f"avg_{c}") for c in columns])


# ---------------------------------------------------------------- F1
QUARTILES = (0.25, 0.5, 0.75)


def describe_numeric(df: DataFrame, value: str, keys: Sequence[str] = (), quantiles: str = "exact") -> DataFrame:
    """min, max, mean, median, sample std, p25, p75 (linear interpolation).

    ``quantiles``: ``exact`` refines brackets, in bounded memory however many
    values a key has; ``buffered`` holds a key's distinct values in one
    aggregation buffer, for series whose length the calendar bounds; ``approx``
    is a bounded sketch.
    """
    v = num(value)
    measures = [F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.count(v).alias("count")]
    if quantiles == "exact":
        found = exact_quantiles(df, value, QUARTILES, keys).select(*[F.col(k).alias(f"_k{k}") for k in keys], F.col("quantiles").alias("_q"))
        out = group(df, keys).agg(*measures)
        if keys:
            out = out.join(found, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{k}")) for k in keys]), "left")
        else:
            out = join_one_row(out, found)
    elif quantiles == "buffered":
        out = group(df, keys).agg(*measures, F.percentile(v, list(QUARTILES)).alias("_q"))
    elif quantiles == "approx":
        out = group(df, keys).agg(*measures, F.percentile_approx(v, list(QUARTILES), 10000).alias("_q"))
    else:
        raise ValueError(f"unknown way to take quantiles {quantiles!r}")
    return out.select(*keys, "count", "min", "max", "mean",
                      F.col("_q")[1].cast("double").alias("median"), "std",
                      F.col("_q")[0].cast("double").alias("p25"), F.col("_q")[2].cast("double").alias("p75"))


# ---------------------------------------------------------------- F3-F5
def period_label(date: Column, freq: str) -> Column:
    """Right-labelled bins: the day, the Sunday ending a Monday-Sunday week, the month end.

    Computed on dates (no session time zone involved, unlike date_trunc on
    timestamps) and returned as TIMESTAMP_NTZ midnight.
    """
    d = F.to_date(date)
    if freq == "D":
        out = d
    elif freq == "W":
        out = F.date_add(F.trunc(d, "week"), 6)
    elif freq == "M":
        out = F.last_day(d)
    else:
        raise ValueError(f"unknown frequency {freq!r}")
    return out.cast("timestamp_ntz")


def resample_mean(series: DataFrame, freq: str | None = None, keys: Sequence[str] = (), min_points: int = 4) -> DataFrame:
    """optional resample by mean; empty bins are absent (no gap fill); keys with fewer than ``min_points`` points are left out."""
    known = with_enough_points(series.where(F.col("value").isNotNull()), keys, min_points)
    if not freq:
        return known
    return known.groupBy(*keys, period_label(F.col("date"), freq).alias("date")).agg(F.avg("value").alias("value"))


def resample_sum(series: DataFrame, freq: str, keys: Sequence[str] = ()) -> DataFrame:
    """sum per bin with empty bins = 0 between the first and last bin of each key.

    The bin calendar is generated per key with ``sequence`` (size = number of
    bins, bounded by the date range) and left-joined to the sums.
    """
    keys = list(keys)
    sums = series.groupBy(*keys, period_label(F.col("date"), freq).alias("period")).agg(F.sum("value").alias("value"))
    bounds = sums.groupBy(*keys).agg(F.min("period").alias("_lo"), F.max("period").alias("_hi"))
    step = {"D": "INTERVAL 1 DAY", "W": "INTERVAL 7 DAYS", "M": "INTERVAL 1 MONTH"}[freq]
    if freq == "M":
        # month ends are not evenly spaced: step over month starts, then take last_day
        lo, hi = F.trunc(F.to_date("_lo"), "month"), F.trunc(F.to_date("_hi"), "month")
        cal = bounds.select(*keys, F.explode(F.sequence(lo, hi, F.expr(step))).alias("_m"))
        cal = cal.select(*keys, F.last_day("_m").cast("timestamp_ntz").alias("period"))
    else:
        cal = bounds.select(*keys, F.explode(F.sequence("_lo", "_hi", F.expr(step))).alias("period"))
    return cal.join(sums, [*keys, "period"], "left").select(*keys, "period", F.coalesce("value", F.lit(0.0)).alias("value"))


def monthly_sum(df: DataFrame, date: str = "date", value: str = "sales", keys: Sequence[str] = ()) -> DataFrame:
    """calendar-month sums labelled ``yyyy-MM``; months without rows are absent."""
    return df.groupBy(*keys, F.date_format(date, "yyyy-MM").alias("month")).agg(F.sum(num(value)).alias("value"))


# ---------------------------------------------------------------- F6-F8
def rolling_stats(series: DataFrame, window: int = 7, min_periods: int = 1, keys: Sequence[str] = (),
                  std_min_periods: int = 2, std_fill_zero: bool = False) -> DataFrame:
    """rolling mean and sample std over the last ``window`` points (row frame)."""
    def columns(w: Window) -> dict[str, Column]:
        cnt = F.count("value").over(w)
        mean = F.when(cnt >= min_periods, F.avg("value").over(w))
        std = F.when(cnt >= std_min_periods, F.stddev_samp("value").over(w))
        return {"rolling_mean": mean, "rolling_std": F.coalesce(std, F.lit(0.0)) if std_fill_zero else std}

    return rolling_by(series, keys, window, columns)


def trend_band(series: DataFrame, window: int = 7, keys: Sequence[str] = ()) -> DataFrame:
    """F8: band = rolling mean +- rolling std (std of <2 points = 0), lower edge clipped at 0."""
    r = rolling_stats(series, window, 1, keys, std_min_periods=1, std_fill_zero=True)
    return r.withColumns({
        "upper": F.col("rolling_mean") + F.col("rolling_std"),
        "lower": F.greatest(F.lit(0.0), F.col("rolling_mean") - F.col("rolling_std")),
    })


# ---------------------------------------------------------------- F9-F13
def _indexed_from_end(series: DataFrame, keys: Sequence[str], order: str = "date") -> DataFrame:
    """ri = position counted from the last point (0 = last), n = points per key."""
    return positions(series.where(F.col("value").isNotNull()), keys, order).withColumn("_ri", F.col("_n") - 1 - F.col("_i")).drop("_i")


def _recent_vs_prior(indexed: DataFrame, keys: Sequence[str], rule: str) -> DataFrame:
    """Shared last-L vs previous-L comparison on rows indexed from the end (``_ri``, ``_n``)."""
    n = F.col("_n")
    ri = F.col("_ri")
    if rule == "lookback14":          # F9
        L = F.greatest(F.lit(2), F.least(F.lit(14), F.floor(n / 2)))
        minimum = 4
        prior_cond = (ri >= L) & (ri < 2 * L)
    elif rule == "window7":           # F10
        L = F.least(F.lit(7), F.greatest(F.lit(2), F.floor(n / 2)))
        minimum = 4
        prior_cond = (ri >= L) & (ri < 2 * L)
    elif rule == "growth7":           # F11
        L = F.least(F.lit(7), n)
        minimum = 6
        prior_cond = F.when(n >= 2 * L, (ri >= L) & (ri < 2 * L)).when(n > L, ri >= L).otherwise(ri < L)
    else:
        raise ValueError(rule)
    agg = group(indexed, keys).agg(
        F.first("_n").alias("n"),
        F.avg(F.when(ri < L, F.col("value"))).alias("recent_mean"),
        F.avg(F.when(prior_cond, F.col("value"))).alias("prior_mean"),
    )
    pct = F.when(F.col("n") < minimum, F.lit(0.0)).when(
        (F.col("prior_mean") == 0) | F.col("prior_mean").isNull(), F.lit(0.0)
    ).otherwise((F.col("recent_mean") - F.col("prior_mean")) / F.abs(F.col("prior_mean")) * 100.0)
    return agg.withColumn("pct_change", pct)


def recent_change(series: DataFrame, rule: str = "lookback14", keys: Sequence[str] = ()) -> DataFrame:
    """F9 (``lookback14``), F10 (``window7``), F11 (``growth7``): recent vs prior mean in %."""
    return _recent_vs_prior(_indexed_from_end(series, keys), keys, rule)


def trend_label(pct: Column, vocabulary: str = "trends", threshold: float = TREND_THRESHOLD_PCT) -> Column:
    """> threshold up, < -threshold down, else flat/stable."""
    up, down, flat = TREND_WORDS[vocabulary]
    return F.when(pct > threshold, up).when(pct < -threshold, down).otherwise(flat)


def variability(df: DataFrame, value: str = "value", keys: Sequence[str] = ()) -> DataFrame:
    """cv = std / |mean|; < 0.15 low, < 0.40 moderate, else high; mean 0 or < 2 points -> unknown."""
    v = num(value)
    agg = group(df, keys).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.count(v).alias("n"))
    known = (F.col("n") >= 2) & (F.col("mean") != 0)
    cv = F.when(known, F.col("std") / F.abs(F.col("mean"))).otherwise(F.lit(0.0))
    label = F.when(~known, "unknown").when(cv < CV_LOW, "low").when(cv < CV_MODERATE, "moderate").otherwise("high")
    return agg.select(*keys, "n", "mean", "std", cv.alias("cv"), label.alias("level"))


# ---------------------------------------------------------------- F14, F15
def trend_series(series: DataFrame, window: int = 7, keys: Sequence[str] = (), min_points: int = 4) -> DataFrame:
    """F14 (series part): rolling mean/std with min_periods=1 (std of one point = 0); keys with < 4 points dropped.

    The reference clamps the window to max(2, min(window, n)); for n < window a
    frame of ``window`` rows already covers the whole prefix, so only the lower
    clamp (2) changes anything.
    """
    s = with_enough_points(series.where(F.col("value").isNotNull()), keys, min_points)
    r = rolling_stats(s, max(2, window), 1, keys, std_min_periods=2, std_fill_zero=True)
    return r.select(*keys, "date", "value", "rolling_mean", "rolling_std")


def trend_summary(series: DataFrame, keys: Sequence[str] = (), min_points: int = 4) -> DataFrame:
    """F14 (summary part): F1 statistics + F10 change + F12 label + F13 variability, per key."""
    keys = list(keys)
    valid = series.where(F.col("value").isNotNull())
    stats = describe_numeric(valid, "value", keys, "buffered" if keys else "exact")
    change = recent_change(valid, "window7", keys).select(*keys, "pct_change")
    var = variability(valid, "value", keys).select(*keys, "cv", F.col("level").alias("variability"))
    out = join_keys(join_keys(stats, change, keys), var, keys)
    return out.where(F.col("count") >= min_points).withColumn("trend_dir", trend_label(F.col("pct_change"), "trends"))


def kpis(df: DataFrame, value: str, order_by: Sequence[str], lookback: int = 14) -> DataFrame:
    """total rows, missing fraction, trend direction/% (F9 on raw row order) and volatility.

    Only the last 2 x ``lookback`` rows are compared: a top-n by the reversed
    order (each task keeps that many), numbered from the end; the point count is
    a scalar subquery.
    """
    from quarry.operators.quality import missing_ratio

    vals = df.select(*order_by, num(value).alias("value")).where(F.col("value").isNotNull())
    total = vals.agg(F.count(F.lit(1))).scalar()
    newest = [F.col(c).desc() for c in order_by]
    tail = vals.orderBy(*newest).limit(2 * lookback)
    indexed = tail.withColumns({"_n": total, "_ri": F.row_number().over(Window.orderBy(*newest)) - 1})
    change = _recent_vs_prior(indexed, [], "lookback14").select("pct_change")
    vol = variability(vals, "value").select(F.col("cv").alias("volatility_cv"), F.col("level").alias("volatility_label"))
    base = missing_ratio(df).select("total_rows", F.col("missing_ratio").alias("missing_pct"))
    out = join_one_row(join_one_row(base, change), vol)
    return out.select(
        "total_rows", "missing_pct",
        trend_label(F.col("pct_change"), "metrics").alias("trend_direction"),
        F.col("pct_change").alias("trend_pct_change"), "volatility_label", "volatility_cv",
    )


# ---------------------------------------------------------------- F16
def mean_pct_change(series: DataFrame, last: int = 14, keys: Sequence[str] = ()) -> DataFrame:
    """F16: mean of the last ``last`` day-over-day % changes x 100; NULL when there are <= ``last`` days."""
    s = earlier(positions(series.where(F.col("value").isNotNull()), keys), keys, {"_prev": ("value", 1)}, idx="_i")
    s = s.withColumns({"_chg": F.try_divide(F.col("value") - F.col("_prev"), F.col("_prev")), "_ri": F.col("_n") - 1 - F.col("_i")})
    return group(s, keys).agg(
        F.when(F.first("_n") > last, F.avg(F.when(F.col("_ri") < last, F.col("_chg"))) * 100.0).alias("mean_pct_change"))
