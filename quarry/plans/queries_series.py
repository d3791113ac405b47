"""F: series preparation, rolling windows, trend queries over ``sales_fact``."""

from __future__ import annotations

from quarry.operators import series as S
from quarry.plans.catalog import query
from quarry.plans.views import SALES_ORDER, sales_fact

SF = ["sales_fact"]
DS = "ds AS (SELECT date, sum(sales) AS value FROM sales_fact WHERE date IS NOT NULL AND sales IS NOT NULL GROUP BY date)"
DSR = ("dsr AS (SELECT region, date, sum(sales) AS value FROM sales_fact "
       "WHERE date IS NOT NULL AND sales IS NOT NULL GROUP BY region, date)")


def _ds(spark, sf, keys=()):
    return S.daily_series(sales_fact(spark, sf), "date", "sales", keys)


@query("daily_series", "SELECT region, date, sum(sales) AS value FROM sales_fact "
       "WHERE date IS NOT NULL AND sales IS NOT NULL GROUP BY region, date", SF)
def q_daily_series(spark, sf):
    return _ds(spark, sf, ["region"])


@query("describe_numeric", """
SELECT region, count(sales) AS count, min(sales) AS min, max(sales) AS max, avg(sales) AS mean,
       quantile_cont(sales, 0.5) AS median, stddev_samp(sales) AS std,
       quantile_cont(sales, 0.25) AS p25, quantile_cont(sales, 0.75) AS p75
FROM sales_fact GROUP BY region""", SF)
def q_describe_numeric(spark, sf):
    return S.describe_numeric(sales_fact(spark, sf), "sales", ["region"])


@query("resample_mean", f"""
, {DS}
SELECT CAST(CAST(date_trunc('week', date) AS DATE) + 6 AS TIMESTAMP) AS date, avg(value) AS value FROM ds GROUP BY 1""", SF)
def q_resample_mean(spark, sf):
    return S.resample_mean(_ds(spark, sf), "W")


def _resample_sql(label: str, step: str, start: str) -> str:
    return f"""
, {DS},
sums AS (SELECT {label} AS period, sum(value) AS value FROM ds GROUP BY 1),
cal AS (SELECT CAST(unnest(generate_series({start.format('min(period)')}, {start.format('max(period)')}, {step})) AS DATE) AS p0 FROM sums),
lab AS (SELECT CAST({'last_day(p0)' if 'MONTH' in step else 'p0'} AS TIMESTAMP) AS period FROM cal)
SELECT lab.period, coalesce(s.value, 0.0) AS value FROM lab LEFT JOIN sums s ON s.period = lab.period"""


@query("resample_daily", _resample_sql("CAST(CAST(date AS DATE) AS TIMESTAMP)", "INTERVAL 1 DAY", "CAST({} AS TIMESTAMP)"), SF)
def q_resample_daily(spark, sf):
    return S.resample_sum(_ds(spark, sf), "D")


@query("resample_weekly", _resample_sql("CAST(CAST(date_trunc('week', date) AS DATE) + 6 AS TIMESTAMP)", "INTERVAL 7 DAY", "CAST({} AS TIMESTAMP)"), SF)
def q_resample_weekly(spark, sf):
    return S.resample_sum(_ds(spark, sf), "W")


@query("resample_monthly", _resample_sql("CAST(last_day(CAST(date AS DATE)) AS TIMESTAMP)", "INTERVAL 1 MONTH",
                                         "CAST(date_trunc('month', {}) AS TIMESTAMP)"), SF)
def q_resample_monthly(spark, sf):
    return S.resample_sum(_ds(spark, sf), "M")


@query("monthly_sum", """
SELECT region, strftime(date, '%Y-%m') AS month, sum(sales) AS value FROM sales_fact GROUP BY 1, 2""", SF)
def q_monthly_sum(spark, sf):
    return S.monthly_sum(sales_fact(spark, sf), "date", "sales", ["region"])


ROLL = "OVER (ORDER BY date ROWS BETWEEN {p} PRECEDING AND CURRENT ROW)"


@query("rolling_mean", f"""
, {DS}
SELECT date, value,
       CASE WHEN count(value) {ROLL.format(p=6)} >= 1 THEN avg(value) {ROLL.format(p=6)} END AS rolling_mean,
       CASE WHEN count(value) {ROLL.format(p=6)} >= 2 THEN stddev_samp(value) {ROLL.format(p=6)} END AS rolling_std
FROM ds""", SF)
def q_rolling_mean(spark, sf):
    return S.rolling_stats(_ds(spark, sf), 7, 1)


@query("rolling_mean_full", f"""
, {DS}
SELECT date, value,
       CASE WHEN count(value) {ROLL.format(p=6)} >= 7 THEN avg(value) {ROLL.format(p=6)} END AS rolling_mean,
       CASE WHEN count(value) {ROLL.format(p=6)} >= 2 THEN stddev_samp(value) {ROLL.format(p=6)} END AS rolling_std
FROM ds""", SF)
def q_rolling_mean_full(spark, sf):
    return S.rolling_stats(_ds(spark, sf), 7, 7)


@query("rolling_std", f"""
, {DS}
SELECT date, value,
       CASE WHEN count(value) {ROLL.format(p=13)} >= 1 THEN avg(value) {ROLL.format(p=13)} END AS rolling_mean,
       coalesce(CASE WHEN count(value) {ROLL.format(p=13)} >= 1 THEN stddev_samp(value) {ROLL.format(p=13)} END, 0.0) AS rolling_std
FROM ds""", SF)
def q_rolling_std(spark, sf):
    return S.rolling_stats(_ds(spark, sf), 14, 1, std_min_periods=1, std_fill_zero=True)


RROLL = "OVER (PARTITION BY region ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"
BAND_MEAN = f"avg(value) {RROLL}"
BAND_STD = f"coalesce(stddev_samp(value) {RROLL}, 0.0)"


@query("trend_band", f"""
, {DSR}
SELECT region, date, value, {BAND_MEAN} AS rolling_mean, {BAND_STD} AS rolling_std,
       {BAND_MEAN} + {BAND_STD} AS upper, greatest(0.0, {BAND_MEAN} - {BAND_STD}) AS lower
FROM dsr""", SF)
def q_trend_band(spark, sf):
    return S.trend_band(_ds(spark, sf, ["region"]), 7, ["region"])


PCT = ("CASE WHEN n < {m} THEN 0.0 WHEN prior_mean = 0 OR prior_mean IS NULL THEN 0.0 "
       "ELSE (recent_mean - prior_mean) / abs(prior_mean) * 100.0 END")


def _recent_sql(L: str, prior: str, minimum: int, final: str | None = None) -> str:
    pct = PCT.format(m=minimum)
    final = final or f"SELECT region, n, recent_mean, prior_mean, {pct} AS pct_change FROM a"
    return f"""
, {DSR},
i AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY date DESC) - 1 AS ri,
             count(*) OVER (PARTITION BY region) AS n FROM dsr),
p AS (SELECT *, {L} AS L FROM i),
a AS (SELECT region, max(n) AS n, avg(CASE WHEN ri < L THEN value END) AS recent_mean,
             avg(CASE WHEN {prior} THEN value END) AS prior_mean FROM p GROUP BY region),
ch AS (SELECT *, {pct} AS pct_change FROM a)
{final}"""


L7 = "least(7, greatest(2, floor(n / 2)))"
PRIOR = "ri >= L AND ri < 2 * L"


@query("recent_change_14", _recent_sql("greatest(2, least(14, floor(n / 2)))", "ri >= L AND ri < 2 * L", 4), SF)
def q_recent_change_14(spark, sf):
    return S.recent_change(_ds(spark, sf, ["region"]), "lookback14", ["region"])


@query("recent_change_7", _recent_sql(L7, PRIOR, 4), SF)
def q_recent_change_7(spark, sf):
    return S.recent_change(_ds(spark, sf, ["region"]), "window7", ["region"])


@query("recent_growth", _recent_sql(
    "least(7, n)", "CASE WHEN n >= 2 * L THEN ri >= L AND ri < 2 * L WHEN n > L THEN ri >= L ELSE ri < L END", 6), SF)
def q_recent_growth(spark, sf):
    return S.recent_change(_ds(spark, sf, ["region"]), "growth7", ["region"])


@query("trend_label", _recent_sql(L7, PRIOR, 4, "SELECT region, pct_change, CASE WHEN pct_change > 2 THEN 'upward' "
                                   "WHEN pct_change < -2 THEN 'downward' ELSE 'stable' END AS trend_dir FROM ch"), SF)
def q_trend_label(spark, sf):
    r = S.recent_change(_ds(spark, sf, ["region"]), "window7", ["region"])
    return r.select("region", "pct_change", S.trend_label(r.pct_change, "trends").alias("trend_dir"))


VAR_SQL = """
SELECT {k}n, mean, std,
       CASE WHEN n >= 2 AND mean <> 0 THEN std / abs(mean) ELSE 0.0 END AS cv,
       CASE WHEN NOT (n >= 2 AND mean <> 0) THEN 'unknown' WHEN std / abs(mean) < 0.15 THEN 'low'
            WHEN std / abs(mean) < 0.40 THEN 'moderate' ELSE 'high' END AS level
FROM (SELECT {k}avg({v}) AS mean, stddev_samp({v}) AS std, count({v}) AS n FROM {t} {g}) t"""


@query("variability", ", " + DSR + VAR_SQL.format(k="region, ", v="value", t="dsr", g="GROUP BY region"), SF)
def q_variability(spark, sf):
    return S.variability(_ds(spark, sf, ["region"]), "value", ["region"])


@query("trend_series", f"""
, {DSR}
SELECT region, date, value, avg(value) {RROLL} AS rolling_mean,
       coalesce(stddev_samp(value) {RROLL}, 0.0) AS rolling_std
FROM dsr WHERE region IN (SELECT region FROM dsr GROUP BY region HAVING count(*) >= 4)""", SF)
def q_trend_series(spark, sf):
    return S.trend_series(_ds(spark, sf, ["region"]), 7, ["region"])


@query("trend_summary", _recent_sql(L7, PRIOR, 4, """
SELECT st.*, ch.pct_change,
       CASE WHEN ch.pct_change > 2 THEN 'upward' WHEN ch.pct_change < -2 THEN 'downward' ELSE 'stable' END AS trend_dir
FROM ch JOIN (
  SELECT region, count(value) AS count, min(value) AS min, max(value) AS max, avg(value) AS mean,
         quantile_cont(value, 0.5) AS median, stddev_samp(value) AS std,
         quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.75) AS p75,
         CASE WHEN count(value) >= 2 AND avg(value) <> 0 THEN stddev_samp(value) / abs(avg(value)) ELSE 0.0 END AS cv,
         CASE WHEN NOT (count(value) >= 2 AND avg(value) <> 0) THEN 'unknown'
              WHEN stddev_samp(value) / abs(avg(value)) < 0.15 THEN 'low'
              WHEN stddev_samp(value) / abs(avg(value)) < 0.40 THEN 'moderate' ELSE 'high' END AS variability
  FROM dsr GROUP BY region) st ON st.region = ch.region
WHERE st.count >= 4"""), SF)
def q_trend_summary(spark, sf):
    return S.trend_summary(_ds(spark, sf, ["region"]), ["region"])


@query("kpis", f"""
, v AS (SELECT sales AS value, row_number() OVER (ORDER BY date, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS i,
               count(*) OVER () AS n FROM sales_fact WHERE sales IS NOT NULL),
p AS (SELECT *, n - 1 - i AS ri, greatest(2, least(14, floor(n / 2))) AS L FROM v),
a AS (SELECT max(n) AS n, avg(CASE WHEN ri < L THEN value END) AS recent_mean,
             avg(CASE WHEN ri >= L AND ri < 2 * L THEN value END) AS prior_mean,
             avg(value) AS mean, stddev_samp(value) AS std FROM p),
c AS (SELECT *, CASE WHEN n < 4 THEN 0.0 WHEN prior_mean = 0 OR prior_mean IS NULL THEN 0.0
                     ELSE (recent_mean - prior_mean) / abs(prior_mean) * 100.0 END AS pct,
             CASE WHEN n >= 2 AND mean <> 0 THEN std / abs(mean) ELSE 0.0 END AS cv FROM a),
m AS (SELECT count(*) AS total_rows,
             (count_if(l_orderkey IS NULL) + count_if(l_linenumber IS NULL) + count_if(l_partkey IS NULL)
              + count_if(l_suppkey IS NULL) + count_if(date IS NULL) + count_if(region IS NULL) + count_if(location IS NULL)
              + count_if(product IS NULL) + count_if(category IS NULL) + count_if(sales IS NULL) + count_if(price IS NULL)
              + count_if(cost IS NULL) + count_if(stock IS NULL) + count_if(production IS NULL) + count_if(defect IS NULL)
              + count_if(promo IS NULL)) / (count(*) * 16.0) AS missing_pct FROM sales_fact)
SELECT total_rows, missing_pct,
       CASE WHEN pct > 2 THEN 'upward' WHEN pct < -2 THEN 'downward' ELSE 'flat' END AS trend_direction,
       pct AS trend_pct_change,
       CASE WHEN NOT (n >= 2 AND mean <> 0) THEN 'unknown' WHEN cv < 0.15 THEN 'low' WHEN cv < 0.40 THEN 'moderate' ELSE 'high' END
         AS volatility_label, cv AS volatility_cv
FROM c, m""", SF)
def q_kpis(spark, sf):
    return S.kpis(sales_fact(spark, sf), "sales", SALES_ORDER)


@query("mean_pct_change", f"""
, {DS},
c AS (SELECT date, (value - lag(value) OVER (ORDER BY date)) / nullif(lag(value) OVER (ORDER BY date), 0) AS chg,
             row_number() OVER (ORDER BY date DESC) - 1 AS ri, count(*) OVER () AS n FROM ds)
SELECT CASE WHEN max(n) > 14 THEN avg(CASE WHEN ri < 14 THEN chg END) * 100.0 END AS mean_pct_change FROM c""", SF)
def q_mean_pct_change(spark, sf):
    return S.mean_pct_change(_ds(spark, sf), 14)


@query("daily_mean", """
SELECT date, avg(stock) AS avg_stock, avg(production) AS avg_production FROM sales_fact GROUP BY date""", SF)
def q_daily_mean(spark, sf):
    return S.daily_mean(sales_fact(spark, sf), "date", ["stock", "production"])
