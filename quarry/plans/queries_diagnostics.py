"""I: statistical diagnostics (per-region daily series) and price regressions (per category, raw rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import diagnostics as D
from quarry.operators import series as S
from quarry.plans.catalog import query
from quarry.plans.views import sales_fact

SF = ["sales_fact"]
DSR = ("dsr AS (SELECT region, date, sum(sales) AS value FROM sales_fact "
       "WHERE date IS NOT NULL AND sales IS NOT NULL GROUP BY region, date)")
CHANGES = [-0.2, -0.1, -0.05, 0.05, 0.1, 0.2]


def _dsr(spark, sf):
    return S.daily_series(sales_fact(spark, sf), "date", "sales", ["region"])


def t_tail_sql(t: str, df: str, panels: int = 4000) -> str:
    """Two-sided p of Student's t by Simpson's rule over the angle atan(t / sqrt(df)), to 9 decimals."""
    area = (f"list_sum([(CASE WHEN i IN (0, {panels}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) "
            f"* pow(cos(i * atan(abs({t}) / sqrt({df})) / {panels}), {df} - 1) FOR i IN range(0, {panels + 1})]) * atan(abs({t}) / sqrt({df})) / {3 * panels}")
    return f"round(greatest(0.0, 1 - 2 * exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt(pi()) * {area}), 9)"


def normal_sql(z: str, panels: int = 2000) -> str:
    """Normal distribution function by Simpson's rule from 0."""
    return (f"(0.5 + list_sum([(CASE WHEN i IN (0, {panels}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) "
            f"* exp(-pow(i * ({z}) / {panels}, 2) / 2) FOR i IN range(0, {panels + 1})]) * ({z}) / {3 * panels} / sqrt(2 * pi()))")


TREND = f"""
, {DSR},
x AS (SELECT *, CAST(row_number() OVER (PARTITION BY region ORDER BY date) - 1 AS DOUBLE) AS x FROM dsr WHERE value IS NOT NULL),
t AS (SELECT region, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS std, regr_slope(value, x) AS slope,
             regr_intercept(value, x) AS intercept, regr_r2(value, x) AS r2 FROM x GROUP BY region HAVING count(*) >= 20),
tt AS (SELECT *, CASE WHEN mean <> 0 THEN std / mean END AS cv,
       CASE WHEN n > 2 THEN sign(slope) * sqrt(r2 * (n - 2) / nullif(1 - r2, 0)) END AS t_stat
FROM t)"""

# ADF as defined: design columns cut from the series, their cross products, Gaussian elimination step by step
ADF = """
, ys AS (SELECT region, count(*) AS n, list(value ORDER BY date) AS raw, avg(value) AS mean FROM dsr WHERE value IS NOT NULL
         GROUP BY region HAVING count(*) >= 20),
yd AS (SELECT region, n, [v - mean FOR v IN raw] AS y, [raw[i + 1] - raw[i] FOR i IN range(1, n)] AS d,
              CAST(greatest(0, least(ceil(12 * pow(n / 100.0, 0.25)), n // 2 - 2)) AS INTEGER) AS m FROM ys),
zc AS (SELECT region, n, m, [[1.0::DOUBLE FOR i IN range(m + 1, n)], y[m + 1:n - 1]]
              || [d[m + 1 - j:n - 1 - j] FOR j IN range(1, m + 1)] || [d[m + 1:n - 1]] AS z FROM yd),
search AS (
  SELECT region, n - 1 - m AS nobs, m, 0 AS k, [[list_dot_product(u, v) FOR v IN z] FOR u IN z] AS g FROM zc
  UNION ALL
  SELECT region, nobs, m, k + 1, [[CASE WHEN i <= k + 1 THEN g[i][j] ELSE g[i][j] - g[i][k + 1] * g[k + 1][j] / g[k + 1][k + 1] END
                                   FOR j IN range(1, m + 4)] FOR i IN range(1, m + 4)]
  FROM search WHERE k < m + 2),
chosen AS (SELECT region, arg_min(p, (aic, p)) AS p FROM (
  SELECT region, k - 2 AS p, nobs * (ln(2 * pi()) + ln(greatest(g[m + 3][m + 3], 1e-300) / nobs) + 1) + 2.0 * k AS aic FROM search WHERE k >= 2)
  GROUP BY region),
zf AS (SELECT region, n, p, [[1.0::DOUBLE FOR i IN range(p + 1, n)]] || [d[p + 1 - j:n - 1 - j] FOR j IN range(1, p + 1)]
              || [y[p + 1:n - 1], d[p + 1:n - 1]] AS z FROM yd JOIN chosen USING (region)),
final AS (
  SELECT region, n, p, 0 AS k, [[list_dot_product(u, v) FOR v IN z] FOR u IN z] AS g FROM zf
  UNION ALL
  SELECT region, n, p, k + 1, [[CASE WHEN i <= k + 1 THEN g[i][j] ELSE g[i][j] - g[i][k + 1] * g[k + 1][j] / g[k + 1][k + 1] END
                                FOR j IN range(1, p + 4)] FOR i IN range(1, p + 4)]
  FROM final WHERE k < p + 1),
st AS (SELECT region, n, p AS used_lag, n - 1 - p AS nobs,
              g[p + 2][p + 3] / g[p + 2][p + 2]
              / sqrt((g[p + 3][p + 3] - pow(g[p + 2][p + 3], 2) / g[p + 2][p + 2]) / (n - 1 - p - (p + 2)) / g[p + 2][p + 2]) AS adf_stat
       FROM final WHERE k = p + 1),
sf AS (SELECT *, CASE WHEN adf_stat <= -1.61 THEN 2.1659 + 1.4412 * adf_stat + 0.038269 * pow(adf_stat, 2)
                      ELSE 1.7339 + 0.93202 * adf_stat - 0.12745 * pow(adf_stat, 2) - 0.010368 * pow(adf_stat, 3) END AS surface FROM st),
adf AS (SELECT region, n, CAST(used_lag AS INTEGER) AS used_lag, nobs, adf_stat,
               round(CASE WHEN adf_stat > 2.74 THEN 1.0 WHEN adf_stat < -18.83 THEN 0.0 ELSE """ + normal_sql("surface") + """ END, 9) AS adf_p FROM sf)"""


def _rounded(df, *columns):
    """p-values to 9 decimals, as the numerical integrals of the oracle give them."""
    return df.withColumns({c: F.round(c, 9) for c in columns})


@query("trend_test", TREND + "SELECT * FROM tt", SF)
def q_trend_test(spark, sf):
    return D.trend_test(_dsr(spark, sf), ["region"])


@query("trend_test_p", TREND + f"SELECT *, {t_tail_sql('t_stat', '(n - 2)')} AS trend_p FROM tt", SF)
def q_trend_test_p(spark, sf):
    return _rounded(D.trend_test(_dsr(spark, sf), ["region"], with_p=True), "trend_p")


@query("adf_test", f", {DSR}" + ADF + "SELECT * FROM adf", SF)
def q_adf_test(spark, sf):
    return _rounded(D.adf_test(_dsr(spark, sf), ["region"]), "adf_p")


LAGS = range(1, 15)
ACF_SQL = f"""
, {DSR},
c AS (SELECT *, value - avg(value) OVER (PARTITION BY region) AS d, count(*) OVER (PARTITION BY region) AS n
      FROM dsr WHERE value IS NOT NULL),
l AS (SELECT *, {", ".join(f"lag(d, {k}) OVER (PARTITION BY region ORDER BY date) AS l{k}" for k in LAGS)} FROM c),
a AS (SELECT region, max(n) AS n, sum(d * d) AS den, {", ".join(f"sum(d * l{k}) AS c{k}" for k in LAGS)} FROM l GROUP BY region),
r AS (SELECT region, n, CAST(least(14, floor(n / 3)) AS INTEGER) AS nlags,
             {", ".join(f"CASE WHEN {k} <= least(14, floor(n / 3)) THEN c{k} / nullif(den, 0) END AS r{k}" for k in LAGS)} FROM a)
"""


@query("acf", ACF_SQL + f"""
SELECT region, n, nlags, CASE WHEN nlags >= 1 THEN r1 END AS lag1_acf,
       greatest({", ".join(f"abs(r{k})" for k in LAGS)}) AS max_acf
FROM r""", SF)
def q_acf(spark, sf):
    return D.acf(_dsr(spark, sf), ["region"])


@query("shape_labels", ACF_SQL + """,
s AS (SELECT r.region, r.n, m.cv, CASE WHEN nlags >= 1 THEN r1 END AS lag1_acf, m.skewness
      FROM r JOIN (SELECT region, stddev_samp(value) / nullif(avg(value), 0) AS cv, avg(d * d * d) / pow(avg(d * d), 1.5) AS skewness
                   FROM c GROUP BY region) m ON m.region = r.region WHERE r.n >= 20)
SELECT region, n, cv, lag1_acf, skewness,
       concat_ws(';', CASE WHEN cv > 0.50 THEN 'high_volatility' WHEN cv > 0.25 THEN 'moderate_volatility' ELSE 'stable' END,
                 CASE WHEN lag1_acf IS NULL THEN NULL WHEN abs(lag1_acf) > 0.50 THEN 'strong_autocorrelation'
                      WHEN abs(lag1_acf) > 0.25 THEN 'moderate_autocorrelation' ELSE 'weak_autocorrelation' END,
                 CASE WHEN abs(skewness) > 1 THEN 'skewed' END) AS labels
FROM s""", SF)
def q_shape_labels(spark, sf):
    return D.shape_labels(_dsr(spark, sf), ["region"])


@query("moments", f"""
, {DSR},
c AS (SELECT region, value - avg(value) OVER (PARTITION BY region) AS d FROM dsr WHERE value IS NOT NULL)
SELECT region, avg(d * d * d) / pow(avg(d * d), 1.5) AS skewness, avg(d * d * d * d) / pow(avg(d * d), 2) - 3 AS kurtosis
FROM c GROUP BY region""", SF)
def q_moments(spark, sf):
    return D.moments(_dsr(spark, sf), ["region"])


@query("diagnostic_labels", TREND + ACF_SQL.replace(f", {DSR},", ",") + ADF + f""",
mo AS (SELECT region, avg(d * d * d) / pow(avg(d * d), 1.5) AS skewness, avg(d * d * d * d) / pow(avg(d * d), 2) - 3 AS kurtosis FROM c GROUP BY region),
al AS (SELECT tt.*, {t_tail_sql('t_stat', '(tt.n - 2)')} AS trend_p, adf_stat, adf_p, CASE WHEN nlags >= 1 THEN r.r1 END AS lag1_acf,
              greatest({", ".join(f"abs(r.r{k})" for k in LAGS)}) AS max_acf, skewness, kurtosis
       FROM tt JOIN adf USING (region) JOIN r USING (region) JOIN mo USING (region))
SELECT *, concat_ws(';', CASE WHEN trend_p < 0.05 THEN CASE WHEN slope > 0 THEN 'significant_uptrend' ELSE 'significant_downtrend' END
                              ELSE 'no_significant_trend' END,
                    CASE WHEN adf_p < 0.05 THEN 'stationary' WHEN adf_p >= 0.05 THEN 'non_stationary' END,
                    CASE WHEN cv > 0.50 THEN 'high_volatility' WHEN cv > 0.25 THEN 'moderate_volatility' ELSE 'stable' END,
                    CASE WHEN lag1_acf IS NULL THEN NULL WHEN abs(lag1_acf) > 0.50 THEN 'strong_autocorrelation'
                         WHEN abs(lag1_acf) > 0.25 THEN 'moderate_autocorrelation' ELSE 'weak_autocorrelation' END,
                    CASE WHEN abs(skewness) > 1 THEN 'skewed' END) AS labels
FROM al""", SF)
def q_diagnostic_labels(spark, sf):
    out = _rounded(D.diagnostic_labels(_dsr(spark, sf), ["region"]), "trend_p", "adf_p")
    return out.withColumn("labels", F.array_join("labels", ";"))


ELAST = """
, lg AS (SELECT category, ln(price) AS lp, ln(sales) AS lq FROM sales_fact WHERE price > 0 AND sales > 0),
e AS (SELECT category, count(*) AS n, regr_slope(lq, lp) AS elasticity, regr_intercept(lq, lp) AS intercept, regr_r2(lq, lp) AS r2
      FROM lg GROUP BY category HAVING count(*) >= 10),
el AS (SELECT *, CASE WHEN n > 2 THEN sign(elasticity) * sqrt(r2 * (n - 2) / nullif(1 - r2, 0)) END AS t_stat FROM e)
"""


def _elast(spark, sf, with_p=False):
    return D.price_elasticity(sales_fact(spark, sf), "price", "sales", ["category"], with_p=with_p)


@query("price_elasticity", ELAST + "SELECT * FROM el", SF)
def q_price_elasticity(spark, sf):
    return _elast(spark, sf)


@query("price_elasticity_test", ELAST + f"SELECT *, {t_tail_sql('t_stat', '(n - 2)')} AS p_value FROM el", SF)
def q_price_elasticity_test(spark, sf):
    return _rounded(_elast(spark, sf, with_p=True), "p_value")


@query("elasticity_label", ELAST + """
SELECT category, elasticity, CASE WHEN elasticity < -1 THEN 'elastic' WHEN elasticity < 0 THEN 'inelastic'
                                  WHEN elasticity >= 0 THEN 'atypical' END AS label FROM el""", SF)
def q_elasticity_label(spark, sf):
    e = _elast(spark, sf)
    return e.select("category", "elasticity", D.elasticity_label(F.col("elasticity")).alias("label"))


@query("price_scenarios", ELAST + f""",
b AS (SELECT category, avg(price) AS avg_price, avg(sales) AS avg_sales FROM sales_fact GROUP BY category),
g AS (SELECT b.category, CAST(c AS DOUBLE) AS price_change, el.elasticity, avg_price * avg_sales AS old_revenue,
             avg_price * (1 + c) * avg_sales * (1 + el.elasticity * c) AS new_revenue
      FROM b JOIN el ON b.category = el.category, unnest([{", ".join(str(c) for c in CHANGES)}]) t(c))
SELECT category, price_change, elasticity, old_revenue, new_revenue, new_revenue - old_revenue AS impact,
       (new_revenue - old_revenue) / nullif(old_revenue, 0) * 100.0 AS impact_pct FROM g""", SF)
def q_price_scenarios(spark, sf):
    df = sales_fact(spark, sf)
    return D.simulate_price_change(df, _elast(spark, sf), CHANGES, keys=["category"])


@query("ols_by_group", """
SELECT category, count(CASE WHEN price IS NOT NULL AND sales IS NOT NULL THEN 1 END) AS n,
       regr_slope(sales, price) AS slope, regr_intercept(sales, price) AS intercept, regr_r2(sales, price) AS r2
FROM sales_fact GROUP BY category""", SF)
def q_ols_by_group(spark, sf):
    return D.ols_by_group(sales_fact(spark, sf), "price", "sales", ["category"])
