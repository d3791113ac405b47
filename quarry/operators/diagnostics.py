"""Statistical diagnostics and regressions: trend test, ADF, ACF, moments, elasticity, grouped OLS.

All of them run per series key on the daily series (bounded by the calendar),
or per group on raw rows via aggregate functions (``regr_*``).  p-values and
the ADF lag search are expressions over one summary row per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.common import group, join_keys, join_one_row, num
from quarry.functions.order import earlier, positions
from quarry.functions.stats import adf_p_value, t_two_sided_p
from quarry.operators import _adf

# Fixed thresholds of the diagnostic labels.
P_SIGNIFICANT = 0.05
CV_HIGH, CV_MID = 0.50, 0.25
ACF_HIGH, ACF_MID = 0.50, 0.25
SKEW_HIGH = 1.0
ELASTIC = -1.0


def _indexed(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    return positions(series.where(F.col("value").isNotNull()), keys).withColumn("_x", F.col("_i").cast("double")).drop("_i", "_n")


def t_stat(r2: Column, n: Column, slope: Column) -> Column:
    """t of a simple regression slope: sign(slope) * sqrt(r2 (n - 2) / (1 - r2))."""
    return F.when(n > 2, F.signum(slope) * F.sqrt(F.try_divide(r2 * (n - 2), 1 - r2)))


# ---------------------------------------------------------------- I1
def trend_test(series: DataFrame, keys: Sequence[str] = (), min_points: int = 20, with_p: bool = False) -> DataFrame:
    """OLS of value on the point index: slope, intercept, R^2, t; plus n, mean, std, cv."""
    keys = list(keys)
    s = _indexed(series, keys)
    out = group(s, keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.regr_slope("value", "_x").alias("slope"), F.regr_intercept("value", "_x").alias("intercept"),
        F.regr_r2("value", "_x").alias("r2"),
    ).where(F.col("n") >= min_points)
    flat = F.col("std") == 0  # a constant series explains nothing: R2 0, t 0 (p 1)
    out = out.withColumn("r2", F.when(flat, F.lit(0.0)).otherwise(F.col("r2")))
    out = out.withColumns({
        "cv": F.when(F.col("mean") != 0, F.col("std") / F.col("mean")),
        "t_stat": F.when(flat, F.lit(0.0)).otherwise(t_stat(F.col("r2"), F.col("n"), F.col("slope"))),
    })
    if with_p:
        out = out.withColumn("trend_p", t_two_sided_p(F.col("t_stat"), F.col("n") - 2))
    return out


# ---------------------------------------------------------------- I3
def acf(series: DataFrame, keys: Sequence[str] = (), max_lags: int = 14) -> DataFrame:
    """Biased autocorrelation up to min(max_lags, n // 3); reports lag-1 and max |r_k|."""
    keys = list(keys)
    s = series.where(F.col("value").isNotNull())
    mean, n = F.avg("value"), F.count(F.lit(1))
    if keys:
        wk = Window.partitionBy(*keys)
        s = s.withColumns({"_d": F.col("value") - mean.over(wk), "_n": n.over(wk)})
    else:  # one series: scalar subqueries instead of a window over all its points
        s = s.withColumns({"_d": F.col("value") - s.agg(mean).scalar(), "_n": s.agg(n).scalar()})
    s = earlier(s, keys, {f"_l{k}": ("_d", k) for k in range(1, max_lags + 1)})
    agg = group(s, keys).agg(
        F.first("_n").alias("n"), F.sum(F.col("_d") * F.col("_d")).alias("_den"),
        *[F.sum(F.col("_d") * F.col(f"_l{k}")).alias(f"_c{k}") for k in range(1, max_lags + 1)],
    )
    nl = F.least(F.lit(max_lags), F.floor(F.col("n") / 3))
    rs = F.array(*[F.when(F.lit(k) <= nl, F.try_divide(F.col(f"_c{k}"), F.col("_den"))) for k in range(1, max_lags + 1)])
    agg = agg.withColumn("_r", rs)
    return agg.select(
        *keys, "n", nl.cast("int").alias("nlags"),
        F.when(nl >= 1, F.col("_r")[0]).alias("lag1_acf"),
        F.array_max(F.transform(F.array_compact("_r"), lambda x: F.abs(x))).alias("max_acf"),
    )


# ---------------------------------------------------------------- I4
def moments(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """I4: population skewness and excess kurtosis."""
    return group(series, keys).agg(F.skewness("value").alias("skewness"), F.kurtosis("value").alias("kurtosis"))


# ---------------------------------------------------------------- I2
def adf_test(series: DataFrame, keys: Sequence[str] = (), min_points: int = 20) -> DataFrame:
    """Augmented Dickey-Fuller test, constant only, lag length by AIC on a common sample, MacKinnon p-value.

    One aggregation per key gives the sums behind the cross products of the
    lagged differences; all lag orders are solved from them (``_adf``).  The
    differences come from lags of the values (halo buckets for one long
    series).  A series without variance has no statistic and no p-value.
    """
    from quarry.session import checkpoint_dir

    keys = list(keys)
    checkpoint_dir(series.sparkSession)
    rows = series.where(F.col("value").isNotNull()).select(*keys, "date", F.col("value").cast("double").alias("value"))
    placed = positions(rows, keys).where(F.col("_n") >= min_points).checkpoint(eager=True)   # the longest series decides the lags below
    longest = placed.agg(_adf.max_lag(F.max("_n"))).first()[0] or 0
    mean = F.avg("value").over(Window.partitionBy(*keys)) if keys else placed.agg(F.avg("value")).scalar()
    placed = earlier(placed.withColumn("value", F.col("value") - mean), keys, {f"_v{k}": ("value", k) for k in range(1, longest + 2)}, idx="_i")
    value = lambda k: F.col(f"_v{k}") if k else F.col("value")
    points = placed.select(*keys, "_i", "_n", F.col("_v1").alias("_lev"), *[(value(j) - value(j + 1)).alias(f"_d{j}") for j in range(longest + 1)])
    n, m = F.col("_n"), F.col("_m")
    totals = group(points.withColumn("_m", _adf.max_lag(n)), keys).agg(F.first("_n").alias("n"), F.first("_m").alias("_m"), *_adf.sums(m, longest))
    solved = totals.where(F.col("n") >= min_points).withColumn("_s", _adf.lag_products(m)).withColumn("used_lag", _adf.best_lag(m))
    solved = solved.withColumn("adf_stat", _adf.statistic(m, F.col("used_lag")))
    return solved.select(*keys, "n", "used_lag", (F.col("n") - 1 - F.col("used_lag")).alias("nobs"), "adf_stat",
                         adf_p_value(F.col("adf_stat")).alias("adf_p"))


# ---------------------------------------------------------------- I5
def diagnostic_labels(series: DataFrame, keys: Sequence[str] = (), min_points: int = 20) -> DataFrame:
    """Trend / stationarity / volatility / autocorrelation / skew labels per key."""
    from quarry.session import checkpoint_dir

    keys = list(keys)
    checkpoint_dir(series.sparkSession)
    series = series.checkpoint(eager=True)  # four tests read it: the rows behind it are aggregated once
    tt = trend_test(series, keys, min_points, with_p=True)
    ad = adf_test(series, keys, min_points).select(*keys, "adf_stat", "adf_p")
    out = join_keys(join_keys(tt, ad, keys), _shape(series, keys), keys)
    labels = F.array_compact(F.array(
        F.when(F.col("trend_p") < P_SIGNIFICANT, F.when(F.col("slope") > 0, "significant_uptrend").otherwise("significant_downtrend"))
         .otherwise("no_significant_trend"),
        F.when(F.col("adf_p").isNotNull(), F.when(F.col("adf_p") < P_SIGNIFICANT, "stationary").otherwise("non_stationary")),
        *_shape_labels(),
    ))
    return out.withColumn("labels", labels)


def _shape(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    return join_keys(acf(series, keys).select(*keys, "lag1_acf", "max_acf"), moments(series, keys), keys)


def _shape_labels() -> list[Column]:
    """Labels that need no p-value: volatility, autocorrelation, skew."""
    return [
        F.when(F.col("cv") > CV_HIGH, "high_volatility").when(F.col("cv") > CV_MID, "moderate_volatility").otherwise("stable"),
        F.when(F.col("lag1_acf").isNotNull(),
               F.when(F.abs("lag1_acf") > ACF_HIGH, "strong_autocorrelation")
               .when(F.abs("lag1_acf") > ACF_MID, "moderate_autocorrelation").otherwise("weak_autocorrelation")),
        F.when(F.abs("skewness") > SKEW_HIGH, "skewed"),
    ]


def shape_labels(series: DataFrame, keys: Sequence[str] = (), min_points: int = 20) -> DataFrame:
    """I5, the part without p-values: volatility, autocorrelation and skew labels per key, as one text."""
    keys = list(keys)
    out = join_keys(trend_test(series, keys, min_points).select(*keys, "n", "cv"), _shape(series, keys), keys)
    return out.select(*keys, "n", "cv", "lag1_acf", "skewness", F.array_join(F.array_compact(F.array(*_shape_labels())), ";").alias("labels"))


# ---------------------------------------------------------------- I6-I9
def price_elasticity(df: DataFrame, price: str = "price", sales: str = "sales", keys: Sequence[str] = (),
                     min_points: int = 10, with_p: bool = False) -> DataFrame:
    """Log-log OLS of sales on price over strictly positive pairs: elasticity (slope), R^2, t (and p)."""
    p, q = num(price), num(sales)
    rows = df.where((p > 0) & (q > 0)).select(*keys, F.ln(p).alias("_lp"), F.ln(q).alias("_lq"))
    out = group(rows, keys).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("_lq", "_lp").alias("elasticity"),
        F.regr_intercept("_lq", "_lp").alias("intercept"), F.regr_r2("_lq", "_lp").alias("r2"),
    ).where(F.col("n") >= min_points)
    out = out.withColumn("t_stat", t_stat(F.col("r2"), F.col("n"), F.col("elasticity")))
    if with_p:
        out = out.withColumn("p_value", t_two_sided_p(F.col("t_stat"), F.col("n") - 2))
    return out


def elasticity_label(e: Column) -> Column:
    """< -1 elastic, [-1, 0) inelastic, >= 0 atypical."""
    return F.when(e < ELASTIC, "elastic").when(e < 0, "inelastic").when(e >= 0, "atypical")


def simulate_price_change(df: DataFrame, elasticity: DataFrame, changes: Sequence[float], price: str = "price",
                          sales: str = "sales", keys: Sequence[str] = ()) -> DataFrame:
    """I8: old revenue = mean(p) mean(q); new = mean(p)(1+c) * mean(q)(1 + e c) for each change c.

    The scenario grid is a literal array exploded per key (no join).
    """
    keys = list(keys)
    base = group(df, keys).agg(F.avg(num(price)).alias("avg_price"), F.avg(num(sales)).alias("avg_sales"))
    base = base.join(elasticity.select(*keys, "elasticity"), keys) if keys else join_one_row(base, elasticity.select("elasticity"))
    grid = base.withColumn("price_change", F.explode(F.array(*[F.lit(float(c)) for c in changes])))
    old = F.col("avg_price") * F.col("avg_sales")
    new = F.col("avg_price") * (1 + F.col("price_change")) * F.col("avg_sales") * (1 + F.col("elasticity") * F.col("price_change"))
    return grid.select(*keys, "price_change", "elasticity", old.alias("old_revenue"), new.alias("new_revenue"),
                       (new - old).alias("impact"), F.try_divide(new - old, old).alias("_r")).withColumn(
        "impact_pct", F.col("_r") * 100.0).drop("_r")


def ols_by_group(df: DataFrame, x: str, y: str, keys: Sequence[str]) -> DataFrame:
    """OLS line per group (slope, intercept, R^2, n)."""
    return df.groupBy(*keys).agg(
        F.count(F.when(num(x).isNotNull() & num(y).isNotNull(), 1)).alias("n"),
        F.regr_slope(num(y), num(x)).alias("slope"), F.regr_intercept(num(y), num(x)).alias("intercept"),
        F.regr_r2(num(y), num(x)).alias("r2"),
    )
