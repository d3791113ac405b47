"""Forecasts (naive, moving average, exponential smoothing, linear trend), future index, backtest.

All forecasts run per series key on a daily series ``(keys..., date, value)``;
the last-L selections use a per-key position from the end, and exponential
smoothing uses its closed form (one weighted sum, no sequential fold):
level = (1-a)^(n-1) x_0 + sum_{i>=1} a (1-a)^(n-1-i) x_i.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.common import group, join_keys, num
from quarry.functions.order import earlier, positions, with_row_index
from quarry.functions.quantiles import exact_quantile
from quarry.operators.series import _indexed_from_end

# Fixed thresholds.
DIRECTION_UI_PCT, DIRECTION_TEXT_PCT = 1.0, 2.0
MAPE_HIGH, MAPE_MID, BIAS_SHARE = 20.0, 10.0, 0.10


# ---------------------------------------------------------------- H5
def future_index(series: DataFrame, horizon: int, keys: Sequence[str] = ()) -> DataFrame:
    """H5: future timestamps per key.

    Frequency, in order: month starts or month ends a constant number of months
    apart (months, quarters, years); constant step; business days (Mon-Fri,
    Friday->Monday); otherwise the median step when positive; otherwise one day.
    """
    keys = list(keys)
    d = earlier(series.select(*keys, "date"), keys, {"_prev": ("date", 1)})
    d = d.withColumn("_delta", F.unix_micros(F.col("date").cast("timestamp")) - F.unix_micros(F.col("_prev").cast("timestamp")))
    dd = F.to_date("date")
    wd = F.dayofweek(dd)  # 1 = Sunday .. 7 = Saturday
    months = F.year(dd) * 12 + F.month(dd)
    prev_months = F.year(F.to_date("_prev")) * 12 + F.month(F.to_date("_prev"))
    day = 86_400_000_000
    prev_wd = F.dayofweek(F.to_date("_prev"))
    # distinct steps of a keyed series are bounded by the calendar; one long series may hold any number of them
    median = F.percentile("_delta", 0.5) if keys else F.lit(None).cast("double")
    stats = group(d, keys).agg(
        F.max("date").alias("_last"),
        F.count(F.lit(1)).alias("_n"),
        F.min("_delta").alias("_dmin"), F.max("_delta").alias("_dmax"),
        median.alias("_dmed"),
        F.bool_and((F.dayofmonth(dd) == 1) & (F.hour("date") == 0)).alias("_ms"),
        F.bool_and((dd == F.last_day(dd)) & (F.hour("date") == 0)).alias("_me"),
        F.min(months - prev_months).alias("_mmin"), F.max(months - prev_months).alias("_mmax"),
        F.bool_and((wd >= 2) & (wd <= 6) & (F.col("_prev").isNull() | (F.col("_delta") == day) & (prev_wd != 6)
                                             | (F.col("_delta") == 3 * day) & (prev_wd == 6))).alias("_bd"),
    )
    if not keys:
        stats = stats.withColumn("_dmed", exact_quantile(d, "_delta", 0.5))
    k = F.col("_k")
    constant = (F.col("_n") >= 3) & (F.col("_dmin") == F.col("_dmax")) & (F.col("_dmin") > 0)
    lwd = F.dayofweek(F.to_date("_last")) - 2  # Monday = 0
    bday = F.timestamp_add("DAY", k + 2 * F.floor((lwd + k) / 5), F.col("_last"))
    step_us = F.when(constant, F.col("_dmin")).when(F.col("_n") >= 2, F.col("_dmed").cast("bigint"))
    by_step = F.timestamp_add("MICROSECOND", k * step_us, F.col("_last"))
    by_month = (F.col("_n") >= 3) & (F.col("_mmin") == F.col("_mmax")) & (F.col("_mmin") >= 1)
    ahead = (k * F.col("_mmin")).cast("int")
    nxt = (
        F.when(by_month & F.col("_ms"), F.timestamp_add("MONTH", ahead, F.col("_last")))
        .when(by_month & F.col("_me"), F.last_day(F.add_months(F.to_date("_last"), ahead)).cast("timestamp_ntz"))
        .when(constant, by_step)
        .when((F.col("_n") >= 3) & F.col("_bd"), bday)
        .when(step_us > 0, by_step)
        .otherwise(F.timestamp_add("DAY", k, F.col("_last")))
    )
    steps = stats.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return steps.select(*keys, F.col("_k").alias("step"), nxt.cast("timestamp_ntz").alias("date"))


# ---------------------------------------------------------------- H1-H3, H6
def _levels(series: DataFrame, keys: Sequence[str], ma_window: int = 7, alpha: float = 0.3) -> DataFrame:
    s = _indexed_from_end(series, keys)
    ri, n = F.col("_ri"), F.col("_n")
    wma = F.greatest(F.lit(2), F.least(F.lit(ma_window), n))
    ses_w = F.when(ri == n - 1, F.pow(F.lit(1 - alpha), n - 1)).otherwise(F.lit(alpha) * F.pow(F.lit(1 - alpha), ri))
    return group(s, keys).agg(
        F.first("_n").alias("n"),
        F.max_by("value", "date").alias("naive"),
        F.avg(F.when(ri < wma, F.col("value"))).alias("moving_average"),
        F.sum(ses_w * F.col("value")).alias("exponential_smoothing"),
        F.avg(F.when(ri < F.least(F.lit(14), n), F.col("value"))).alias("recent_mean"),
    )


METHODS = ("naive", "moving_average", "exponential_smoothing")


def forecast(series: DataFrame, horizon: int = 14, method: str = "moving_average", keys: Sequence[str] = (),
             min_points: int = 5) -> DataFrame:
    """H1-H3: flat forecast path over the H5 future index; keys with < 5 points give no rows."""
    if method not in METHODS:
        raise ValueError(f"unsupported method {method!r}")
    keys = list(keys)
    lv = _levels(series, keys).where(F.col("n") >= min_points).select(*keys, F.col(method).alias("forecast"))
    fut = future_index(series, horizon, keys)
    return join_keys(fut, lv, keys).select(*keys, "step", "date", "forecast")


def forecast_summary(series: DataFrame, horizon: int = 14, method: str = "moving_average", keys: Sequence[str] = (),
                     min_points: int = 5) -> DataFrame:
    """H6: recent mean (last min(14, n)), forecast mean and % change per key."""
    keys = list(keys)
    lv = _levels(series, keys).where(F.col("n") >= min_points)
    fm = F.col(method)
    pct = F.when(F.col("recent_mean") != 0, (fm - F.col("recent_mean")) / F.abs(F.col("recent_mean")) * 100.0).otherwise(F.lit(0.0))
    return lv.select(*keys, "n", F.lit(method).alias("method"), F.lit(horizon).alias("horizon"), "recent_mean",
                     fm.alias("forecast_mean"), pct.alias("pct_change"))


def forecast_direction(pct: Column, threshold: float = DIRECTION_UI_PCT) -> Column:
    """H7: up / down / flat around +-threshold (1 % in the dashboard, 2 % in the text summaries)."""
    return F.when(pct > threshold, "up").when(pct < -threshold, "down").otherwise("flat")


# ---------------------------------------------------------------- H4
def forecast_linear(series: DataFrame, horizon: int = 30, keys: Sequence[str] = (), z: float = 1.96,
                    min_points: int = 5) -> DataFrame:
    """H4: OLS on the point index 0..n-1, floored at 0; band +- z * sqrt(SSE / n); dates last + 1..h days.

    Slope/intercept come from one aggregation (regr_*), SSE = Syy - Sxy^2/Sxx
    (population residual std, as numpy's std of residuals).
    """
    keys = list(keys)
    s = positions(series.where(F.col("value").isNotNull()), keys).withColumn("_x", F.col("_i").cast("double")).drop("_i", "_n")
    fit = group(s, keys).agg(
        F.count(F.lit(1)).alias("n"), F.max("date").alias("_last"),
        F.regr_slope("value", "_x").alias("slope"), F.regr_intercept("value", "_x").alias("intercept"),
        F.regr_syy("value", "_x").alias("_syy"), F.regr_sxy("value", "_x").alias("_sxy"), F.regr_sxx("value", "_x").alias("_sxx"),
    ).where(F.col("n") >= min_points)
    sse = F.greatest(F.lit(0.0), F.col("_syy") - F.col("_sxy") * F.col("_sxy") / F.col("_sxx"))
    fit = fit.withColumn("std_err", F.sqrt(sse / F.col("n")))
    fut = fit.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    yhat = F.greatest(F.lit(0.0), F.col("intercept") + F.col("slope") * (F.col("n") - 1 + F.col("step")))
    return fut.select(
        *keys, "step", F.timestamp_add("DAY", F.col("step"), F.col("_last")).alias("date"),
        yhat.alias("forecast"), (yhat + z * F.col("std_err")).alias("upper"),
        F.greatest(F.lit(0.0), yhat - z * F.col("std_err")).alias("lower"),
    )


# ---------------------------------------------------------------- H8
def backtest_series(df: DataFrame, value: str, order_by: Sequence[str], train_share: float = 0.8, ma_window: int = 5,
                    min_points: int = 30) -> DataFrame:
    """H8 (rows): test rows with naive (previous value) and moving-average (last train window mean) predictions.

    Rows are numbered with the distributed row index; the naive prediction is
    an equi-join on idx - 1 (no window over raw rows); the split point and the
    MA level are scalar subqueries.
    """
    vals = df.select(*order_by, num(value).alias("actual")).where(F.col("actual").isNotNull())
    # (idx, actual) is read four times below (count, MA window, lag join, test rows): materialise it once
    idx = with_row_index(vals, order_by).select("idx", "actual").checkpoint(eager=True)
    n = idx.agg(F.count(F.lit(1))).scalar()
    split = F.floor(n * train_share).cast("bigint")
    ma = idx.where((F.col("idx") < split) & (F.col("idx") >= split - ma_window)).agg(
        F.when(F.count(F.lit(1)) == ma_window, F.avg("actual"))).scalar()
    prev = idx.where(F.col("idx") >= split - 1).select((F.col("idx") + 1).alias("idx"), F.col("actual").alias("naive_pred"))
    test = idx.where((F.col("idx") >= split) & (n >= min_points)).join(prev, "idx", "left")
    return test.select("idx", "actual", "naive_pred", ma.alias("ma_pred"), n.alias("n"))


def backtest_metrics(bt: DataFrame) -> DataFrame:
    """H8 (metrics): MAE, RMSE, MAPE (zero actuals excluded and counted), bias, best model and labels."""
    y = F.col("actual")

    def errs(p: str):
        e = y - F.col(p)
        return [F.avg(F.abs(e)), F.sqrt(F.avg(e * e)), F.avg(F.abs(F.try_divide(e, y))) * 100.0]

    nm, nr, np_ = errs("naive_pred")
    mm, mr, mp = errs("ma_pred")
    t = bt.agg(
        F.first("n").alias("n"), F.count(F.lit(1)).alias("test_points"), F.count_if(y == 0).alias("n_zero_actuals"),
        nm.alias("naive_mae"), nr.alias("naive_rmse"), np_.alias("naive_mape"),
        mm.alias("ma_mae"), mr.alias("ma_rmse"), mp.alias("ma_mape"),
        F.avg(y - F.col("ma_pred")).alias("bias"), F.avg(y).alias("test_mean"),
    ).where(F.col("test_points") > 0)  # too short a series (under min_points) has no test rows, hence no row here
    return t.withColumns({
        "best_model": F.when(F.col("ma_mae") < F.col("naive_mae"), "moving_average").otherwise("naive"),
        "mape_label": F.when(F.col("ma_mape") > MAPE_HIGH, "unreliable").when(F.col("ma_mape") > MAPE_MID, "improvable").otherwise("reliable"),
        "biased": F.abs("bias") > BIAS_SHARE * F.col("test_mean"),
    })
