"""G anomaly and H forecast / backtest queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import anomaly as G
from quarry.operators import forecast as H
from quarry.operators import series as S
from quarry.plans.catalog import query
from quarry.plans.views import SALES_ORDER, sales_fact

SF = ["sales_fact"]
DS = "ds AS (SELECT date, sum(sales) AS value FROM sales_fact WHERE date IS NOT NULL AND sales IS NOT NULL GROUP BY date)"
DSR = ("dsr AS (SELECT region, date, sum(sales) AS value FROM sales_fact "
       "WHERE date IS NOT NULL AND sales IS NOT NULL GROUP BY region, date)")
ORDER_SQL = "date, l_orderkey, l_linenumber, l_partkey, l_suppkey"


def _ds(spark, sf, keys=()):
    return S.daily_series(sales_fact(spark, sf), "date", "sales", keys)


ROLLZ = f"""
, {DSR},
r AS (SELECT region, date, value,
             CASE WHEN count(value) OVER w >= 14 THEN avg(value) OVER w END AS rolling_mean,
             CASE WHEN count(value) OVER w >= 14 THEN stddev_samp(value) OVER w END AS sd
      FROM dsr WINDOW w AS (PARTITION BY region ORDER BY date ROWS BETWEEN 27 PRECEDING AND CURRENT ROW)),
z AS (SELECT region, date, value, rolling_mean, CASE WHEN sd <> 0 THEN sd END AS rolling_std,
             coalesce((value - rolling_mean) / CASE WHEN sd <> 0 THEN sd END, 0.0) AS z_score FROM r),
scored AS (SELECT *, abs(z_score) >= 2.0 AS is_anomaly,
                  CASE WHEN z_score >= 2.0 THEN 'spike' WHEN z_score <= -2.0 THEN 'drop' ELSE 'normal' END AS anomaly_type FROM z)
"""


def _rolling(spark, sf):
    return G.rolling_zscore(_ds(spark, sf, ["region"]), 28, 2.0, ["region"])


@query("anomaly_rolling", ROLLZ + "SELECT * FROM scored", SF)
def q_anomaly_rolling(spark, sf):
    return _rolling(spark, sf)


@query("anomaly_summary", ROLLZ + """
SELECT region, points, anomaly_count, spike_count, drop_count, latest_status, anomaly_count / points AS anomaly_ratio,
       CASE WHEN anomaly_count / points >= 0.10 THEN 'high' WHEN anomaly_count / points >= 0.05 THEN 'medium' ELSE 'low' END AS risk_level
FROM (SELECT region, count(*) AS points, count_if(is_anomaly) AS anomaly_count, count_if(anomaly_type = 'spike') AS spike_count,
             count_if(anomaly_type = 'drop') AS drop_count, arg_max(anomaly_type, date) AS latest_status FROM scored GROUP BY region) t""", SF)
def q_anomaly_summary(spark, sf):
    return G.anomaly_summary(_rolling(spark, sf), ["region"])


GLOBAL = """
, g AS (SELECT l_orderkey, l_linenumber, stock,
               (stock - (SELECT avg(stock) FROM sales_fact)) / nullif((SELECT stddev_samp(stock) FROM sales_fact), 0) AS z_score
        FROM sales_fact),
gs AS (SELECT *, coalesce(abs(z_score) > 2.5, false) AS is_anomaly FROM g)
"""


def _global(spark, sf):
    return G.global_zscore(sales_fact(spark, sf).select("l_orderkey", "l_linenumber", "stock"), "stock", 2.5)


@query("anomaly_global", GLOBAL + "SELECT * FROM gs", SF)
def q_anomaly_global(spark, sf):
    return _global(spark, sf)


@query("anomaly_global_summary", GLOBAL + """
SELECT count(*) AS total_points, count_if(is_anomaly) AS anomalies,
       CASE WHEN count(*) > 0 THEN count_if(is_anomaly) / count(*) ELSE 0.0 END AS anomaly_ratio FROM gs""", SF)
def q_anomaly_global_summary(spark, sf):
    return G.anomaly_count_summary(_global(spark, sf))


GROUPED = """
, st AS (SELECT region, product, avg(stock) AS m, stddev_samp(stock) AS s FROM sales_fact GROUP BY region, product),
gz AS (SELECT f.region, f.product, l_orderkey, l_linenumber, stock,
              CASE WHEN s > 0 THEN (stock - m) / s ELSE 0.0 END AS z_score FROM sales_fact f JOIN st USING (region, product)),
gzs AS (SELECT *, abs(z_score) >= 2.0 AS is_anomaly FROM gz)
"""


def _grouped(spark, sf):
    rows = sales_fact(spark, sf).select("region", "product", "l_orderkey", "l_linenumber", "stock")
    return G.group_zscore(rows, "stock", ["region", "product"], 2.0)


@query("anomaly_grouped", GROUPED + "SELECT * FROM gzs", SF)
def q_anomaly_grouped(spark, sf):
    return _grouped(spark, sf)


@query("anomaly_list", GROUPED + "SELECT * FROM gzs WHERE is_anomaly ORDER BY abs(z_score) DESC", SF)
def q_anomaly_list(spark, sf):
    return G.anomaly_list(_grouped(spark, sf))


# ---------------------------------------------------------------- forecasts
FUT = f"""
, {DSR},
d AS (SELECT region, date, lag(date) OVER (PARTITION BY region ORDER BY date) AS prev FROM dsr),
d2 AS (SELECT *, epoch_us(date) - epoch_us(prev) AS delta, CAST(date AS DATE) AS dd FROM d),
fs AS (SELECT region, max(date) AS last_, count(*) AS n, min(delta) AS dmin, max(delta) AS dmax,
              quantile_cont(delta, 0.5) AS dmed,
              bool_and(coalesce(day(dd) = 1 AND hour(date) = 0 AND (prev IS NULL OR (year(dd) * 12 + month(dd)) - (year(prev) * 12 + month(prev)) = 1), false)) AS ms,
              bool_and(coalesce(dd = last_day(dd) AND hour(date) = 0 AND (prev IS NULL OR (year(dd) * 12 + month(dd)) - (year(prev) * 12 + month(prev)) = 1), false)) AS me,
              bool_and(isodow(dd) <= 5 AND (prev IS NULL OR (delta = 86400000000 AND isodow(prev) <> 5) OR (delta = 3 * 86400000000 AND isodow(prev) = 5))) AS bd
       FROM d2 GROUP BY region),
fk AS (SELECT fs.*, k, n >= 3 AND dmin = dmax AND dmin > 0 AS constant,
              CASE WHEN n >= 3 AND dmin = dmax AND dmin > 0 THEN dmin WHEN n >= 2 THEN CAST(dmed AS BIGINT) END AS step_us
       FROM fs, range(1, 15) t(k)),
fut AS (SELECT region, CAST(k AS INTEGER) AS step,
               CAST(CASE WHEN constant THEN last_ + to_microseconds(k * step_us)
                    WHEN n >= 3 AND ms THEN last_ + to_months(CAST(k AS INTEGER))
                    WHEN n >= 3 AND me THEN CAST(last_day(CAST(last_ AS DATE) + to_months(CAST(k AS INTEGER))) AS TIMESTAMP)
                    WHEN n >= 3 AND bd THEN last_ + to_days(CAST(k + 2 * floor((isodow(last_) - 1 + k) / 5) AS INTEGER))
                    WHEN step_us > 0 THEN last_ + to_microseconds(k * step_us)
                    ELSE last_ + to_days(CAST(k AS INTEGER)) END AS TIMESTAMP) AS date
        FROM fk)
"""
LEVELS = """,
li AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY date DESC) - 1 AS ri, count(*) OVER (PARTITION BY region) AS n
       FROM dsr WHERE value IS NOT NULL),
lv AS (SELECT region, max(n) AS n, arg_max(value, date) AS naive,
              avg(CASE WHEN ri < greatest(2, least(7, n)) THEN value END) AS moving_average,
              sum(CASE WHEN ri = n - 1 THEN pow(0.7, n - 1) ELSE 0.3 * pow(0.7, ri) END * value) AS exponential_smoothing,
              avg(CASE WHEN ri < least(14, n) THEN value END) AS recent_mean
       FROM li GROUP BY region HAVING max(n) >= 5)
"""


@query("future_index", FUT + "SELECT region, step, date FROM fut", SF)
def q_future_index(spark, sf):
    return H.future_index(_ds(spark, sf, ["region"]), 14, ["region"])


def _fc_sql(method: str) -> str:
    return FUT + LEVELS + f"SELECT fut.region, step, date, {method} AS forecast FROM fut JOIN lv ON fut.region = lv.region"


@query("forecast_naive", _fc_sql("naive"), SF)
def q_forecast_naive(spark, sf):
    return H.forecast(_ds(spark, sf, ["region"]), 14, "naive", ["region"])


@query("forecast_ma", _fc_sql("moving_average"), SF)
def q_forecast_ma(spark, sf):
    return H.forecast(_ds(spark, sf, ["region"]), 14, "moving_average", ["region"])


@query("forecast_ses", _fc_sql("exponential_smoothing"), SF)
def q_forecast_ses(spark, sf):
    return H.forecast(_ds(spark, sf, ["region"]), 14, "exponential_smoothing", ["region"])


SUMMARY = f", {DSR}" + LEVELS + """,
fsum AS (SELECT region, n, 'moving_average' AS method, 14 AS horizon, recent_mean, moving_average AS forecast_mean,
                CASE WHEN recent_mean <> 0 THEN (moving_average - recent_mean) / abs(recent_mean) * 100.0 ELSE 0.0 END AS pct_change
         FROM lv)
"""


@query("forecast_summary", SUMMARY + "SELECT * FROM fsum", SF)
def q_forecast_summary(spark, sf):
    return H.forecast_summary(_ds(spark, sf, ["region"]), 14, "moving_average", ["region"])


@query("forecast_direction", SUMMARY + """
SELECT region, pct_change,
       CASE WHEN pct_change > 1 THEN 'up' WHEN pct_change < -1 THEN 'down' ELSE 'flat' END AS direction,
       CASE WHEN pct_change > 2 THEN 'up' WHEN pct_change < -2 THEN 'down' ELSE 'flat' END AS direction_text
FROM fsum""", SF)
def q_forecast_direction(spark, sf):
    s = H.forecast_summary(_ds(spark, sf, ["region"]), 14, "moving_average", ["region"])
    return s.select("region", "pct_change", H.forecast_direction(F.col("pct_change"), 1.0).alias("direction"),
                    H.forecast_direction(F.col("pct_change"), 2.0).alias("direction_text"))


@query("forecast_linear", f"""
, {DS},
x AS (SELECT date, value, CAST(row_number() OVER (ORDER BY date) - 1 AS DOUBLE) AS x FROM ds WHERE value IS NOT NULL),
fit AS (SELECT count(*) AS n, max(date) AS last_, regr_slope(value, x) AS slope, regr_intercept(value, x) AS intercept,
               sqrt(greatest(0.0, regr_syy(value, x) - regr_sxy(value, x) * regr_sxy(value, x) / regr_sxx(value, x)) / count(*)) AS std_err
        FROM x),
f AS (SELECT *, greatest(0.0, intercept + slope * (n - 1 + k)) AS yhat, k FROM fit, range(1, 31) t(k) WHERE n >= 5)
SELECT CAST(k AS INTEGER) AS step, last_ + to_days(CAST(k AS INTEGER)) AS date, yhat AS forecast, yhat + 1.96 * std_err AS upper,
       greatest(0.0, yhat - 1.96 * std_err) AS lower
FROM f""", SF)
def q_forecast_linear(spark, sf):
    return H.forecast_linear(_ds(spark, sf), 30)


BT = f"""
, v AS (SELECT row_number() OVER (ORDER BY {ORDER_SQL}) - 1 AS idx, sales AS actual FROM sales_fact WHERE sales IS NOT NULL),
nn AS (SELECT count(*) AS n, CAST(floor(count(*) * 0.8) AS BIGINT) AS split FROM v),
ma AS (SELECT CASE WHEN count(*) = 5 THEN avg(actual) END AS ma_pred FROM v, nn WHERE idx < split AND idx >= split - 5),
bt AS (SELECT v.idx, v.actual, p.actual AS naive_pred, ma.ma_pred, nn.n
       FROM v CROSS JOIN nn CROSS JOIN ma LEFT JOIN v p ON p.idx + 1 = v.idx WHERE v.idx >= nn.split AND nn.n >= 30)
"""


def _bt(spark, sf):
    return H.backtest_series(sales_fact(spark, sf), "sales", SALES_ORDER)


@query("backtest_series", BT + "SELECT * FROM bt", SF)
def q_backtest_series(spark, sf):
    return _bt(spark, sf)


@query("backtest_metrics", BT + """,
m AS (SELECT max(n) AS n, count(*) AS test_points, count_if(actual = 0) AS n_zero_actuals,
             avg(abs(actual - naive_pred)) AS naive_mae, sqrt(avg((actual - naive_pred) ^ 2)) AS naive_rmse,
             avg(abs((actual - naive_pred) / nullif(actual, 0))) * 100.0 AS naive_mape,
             avg(abs(actual - ma_pred)) AS ma_mae, sqrt(avg((actual - ma_pred) ^ 2)) AS ma_rmse,
             avg(abs((actual - ma_pred) / nullif(actual, 0))) * 100.0 AS ma_mape,
             avg(actual - ma_pred) AS bias, avg(actual) AS test_mean FROM bt)
SELECT *, CASE WHEN ma_mae < naive_mae THEN 'moving_average' ELSE 'naive' END AS best_model,
       CASE WHEN ma_mape > 20 THEN 'unreliable' WHEN ma_mape > 10 THEN 'improvable' ELSE 'reliable' END AS mape_label,
       abs(bias) > 0.10 * test_mean AS biased
FROM m""", SF)
def q_backtest_metrics(spark, sf):
    return H.backtest_metrics(_bt(spark, sf))
