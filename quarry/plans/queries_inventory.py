"""J: inventory / operations queries over ``sales_fact``."""

from __future__ import annotations

from quarry.functions.order import with_row_index
from quarry.operators import inventory as inv
from quarry.plans.catalog import query
from quarry.plans.views import SALES_FACT_SQL, SALES_ORDER, sales_fact, sales_month

ORDER_SQL = "date, l_orderkey, l_linenumber, l_partkey, l_suppkey"

CASE_SQL = f"""
case_base AS (
  SELECT date, region, product, sales, stock, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM sales_fact
  WHERE date IS NOT NULL AND region IS NOT NULL AND product IS NOT NULL AND sales IS NOT NULL AND stock IS NOT NULL
    AND sales > 0),
case_scored AS (
  SELECT *, stock / sales AS stock_ratio, abs(stock - sales) / sales AS risk_score,
         CASE WHEN stock / sales < 1 THEN 'stockout_risk' WHEN stock / sales <= 2 THEN 'balanced' ELSE 'excess' END AS stock_status,
         avg(sales) OVER (PARTITION BY region, product) AS m_, stddev_samp(sales) OVER (PARTITION BY region, product) AS s_
  FROM case_base),
inv_case AS (
  SELECT date, region, product, sales, stock, l_orderkey, l_linenumber, l_partkey, l_suppkey,
         stock_ratio, risk_score, stock_status,
         CASE WHEN s_ > 0 THEN (sales - m_) / s_ ELSE 0.0 END AS sales_zscore,
         CASE WHEN abs(CASE WHEN s_ > 0 THEN (sales - m_) / s_ ELSE 0.0 END) >= 2 THEN 'anomaly' ELSE 'normal' END AS anomaly_flag,
         avg(sales) OVER (PARTITION BY region, product ORDER BY {ORDER_SQL} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS rolling_demand_7
  FROM case_scored)
"""


def _case(spark, sf):
    """Case rows for summaries: one scan of the fact, no z-score and no rolling demand."""
    return inv.inventory_case(sales_fact(spark, sf), SALES_ORDER, with_score=False)


def _with_case(sql: str) -> str:
    return f"WITH sales_fact AS ({SALES_FACT_SQL}),\n{CASE_SQL}\n{sql}"


@query("stock_to_sales", """
SELECT avg(stock) AS avg_stock, min(stock) AS min_stock, max(stock) AS max_stock,
       count_if(stock <= 0) AS stockout_risk_days, count_if(stock <= 0) * 100.0 / count(stock) AS stockout_risk_pct,
       CASE WHEN avg(sales) > 0 THEN avg(stock) / avg(sales) END AS stock_to_sales_ratio
FROM sales_fact""", ["sales_fact"])
def q_stock_to_sales(spark, sf):
    return inv.stock_to_sales(sales_fact(spark, sf))


@query("defect_summary", """
SELECT region, avg(defect) AS mean, CAST(max(defect) AS DOUBLE) AS max, CAST(min(defect) AS DOUBLE) AS min, stddev_samp(defect) AS std,
       count_if(defect > 5.0) AS high_defect_periods
FROM sales_fact GROUP BY region""", ["sales_fact"])
def q_defect_summary(spark, sf):
    return inv.defect_summary(sales_fact(spark, sf), keys=["region"])


@query("production_summary", """
SELECT sum(production) AS total, avg(production) AS mean, max(production) AS max, min(production) AS min,
       CASE WHEN avg(sales) > 0 THEN avg(production) / avg(sales) END AS prod_to_sales_ratio
FROM sales_fact""", ["sales_fact"])
def q_production_summary(spark, sf):
    return inv.production_summary(sales_fact(spark, sf))


@query("ops_labels", """
SELECT region, stockout_pct, prod_to_sales_ratio, defect_pct,
       CASE WHEN stockout_pct <= 5 THEN 'low' WHEN stockout_pct <= 15 THEN 'moderate' ELSE 'high' END AS stockout_label,
       CASE WHEN prod_to_sales_ratio IS NULL THEN 'unknown' WHEN prod_to_sales_ratio < 0.95 THEN 'under_production'
            WHEN prod_to_sales_ratio > 1.30 THEN 'over_production' ELSE 'aligned' END AS production_label,
       CASE WHEN defect_pct > 5 THEN 'high' WHEN defect_pct > 2 THEN 'elevated' ELSE 'normal' END AS defect_label
FROM (SELECT region, count_if(stock <= 0) * 100.0 / count(stock) AS stockout_pct,
             CASE WHEN avg(sales) > 0 THEN avg(production) / avg(sales) END AS prod_to_sales_ratio,
             avg(defect) * 100.0 AS defect_pct
      FROM sales_fact GROUP BY region) t""", ["sales_fact"])
def q_ops_labels(spark, sf):
    return inv.ops_labels(sales_fact(spark, sf), keys=["region"])


@query("production_vs_sales", f"""
SELECT p.idx AS position, p.production, s.sales, p.production - s.sales AS gap
FROM (SELECT production, row_number() OVER (ORDER BY {ORDER_SQL}) - 1 AS idx FROM sales_fact WHERE production IS NOT NULL) p
JOIN (SELECT sales, row_number() OVER (ORDER BY {ORDER_SQL}) - 1 AS idx FROM sales_fact WHERE sales IS NOT NULL) s
  ON p.idx = s.idx""", ["sales_fact"])
def q_production_vs_sales(spark, sf):
    return inv.production_vs_sales(sales_fact(spark, sf), SALES_ORDER)


@query("stock_bands", """
SELECT band, count(*) AS rows FROM (
  SELECT CASE WHEN stock / (sales + 1) < 0.5 THEN 'critical' WHEN stock / (sales + 1) < 1.0 THEN 'low'
              WHEN stock / (sales + 1) <= 2.0 THEN 'optimal' WHEN stock / (sales + 1) > 2.0 THEN 'excess' END AS band
  FROM sales_fact WHERE stock IS NOT NULL AND sales IS NOT NULL) t GROUP BY band""", ["sales_fact"])
def q_stock_bands(spark, sf):
    return inv.stock_bands(sales_fact(spark, sf))


@query("dashboard_kpis", """
SELECT avg_sales, total_sales, avg_stock, avg_sales * 1.25 AS safety_stock,
       least(100.0, avg_stock / (avg_sales * 14) * 100.0) AS stock_availability,
       greatest(0.0, avg_stock - avg_sales * 1.25 * 1.3) AS excess_stock
FROM (SELECT avg(sales) AS avg_sales, sum(sales) AS total_sales, avg(stock) AS avg_stock FROM sales_fact) t""", ["sales_fact"])
def q_dashboard_kpis(spark, sf):
    return inv.dashboard_kpis(sales_fact(spark, sf))


@query("stock_risk_share", """
SELECT count_if(r < 0.5) AS critical, count_if(r >= 0.5 AND r < 1.0) AS low, count_if(r > 2.0) AS excess,
       count_if(r < 1.0) * 100.0 / count(*) AS risk_pct, avg(r) AS avg_stock_ratio
FROM (SELECT stock / (sales + 1) AS r FROM sales_fact WHERE stock IS NOT NULL AND sales IS NOT NULL) t""", ["sales_fact"])
def q_stock_risk_share(spark, sf):
    return inv.stock_risk_share(sales_fact(spark, sf))


@query("safety_stock", """
SELECT avg(daily_stock) * 0.3 AS safety_stock, count(*) AS days
FROM (SELECT date, avg(stock) AS daily_stock FROM sales_fact GROUP BY date) t""", ["sales_fact"])
def q_safety_stock(spark, sf):
    return inv.safety_stock(sales_fact(spark, sf))


@query("error_rate_daily", """
SELECT date, error_rate, error_rate * 100.0 AS error_pct, error_rate > 0.04 AS above_threshold
FROM (SELECT date, avg(defect) AS error_rate FROM sales_fact GROUP BY date) t""", ["sales_fact"])
def q_error_rate_daily(spark, sf):
    return inv.error_rate_daily(sales_fact(spark, sf))


@query("error_rate_rows", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, defect * 100.0 AS error_pct, defect * 100.0 > 5.0 AS above_threshold FROM sales_fact""",
       ["sales_fact"])
def q_error_rate_rows(spark, sf):
    return inv.error_rate_rows(sales_fact(spark, sf)).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "error_pct", "above_threshold")


@query("row_index", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, region,
       row_number() OVER (PARTITION BY region ORDER BY {ORDER_SQL}) - 1 AS idx FROM sales_fact""", ["sales_fact"])
def q_row_index(spark, sf):
    rows = sales_fact(spark, sf).select(*SALES_ORDER, "region")
    return with_row_index(rows, SALES_ORDER, keys=["region"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "region", "idx")


@query("inventory_case", _with_case("SELECT * FROM inv_case"))
def q_inventory_case(spark, sf):
    return inv.inventory_case(sales_fact(spark, sf), SALES_ORDER)


@query("inventory_kpis", _with_case("""
SELECT sum(sales) AS total_sales, avg(stock) AS avg_stock,
       avg(CASE WHEN stock_status = 'stockout_risk' THEN 1.0 ELSE 0.0 END) * 100 AS stockout_rate,
       avg(CASE WHEN stock_status = 'excess' THEN 1.0 ELSE 0.0 END) * 100 AS excess_rate,
       count_if(stock_status <> 'balanced') AS risky_count
FROM inv_case"""))
def q_inventory_kpis(spark, sf):
    return inv.inventory_kpis(_case(spark, sf))


RISK_SQL = """
SELECT region, product, sum(sales) AS total_sales, avg(stock) AS avg_stock, avg(stock_ratio) AS avg_stock_ratio,
       avg(risk_score) AS avg_risk_score, count_if(stock_status = 'stockout_risk') AS stockout_days,
       count_if(stock_status = 'excess') AS excess_days
FROM inv_case GROUP BY region, product"""


@query("risk_table", _with_case(RISK_SQL + " ORDER BY avg_risk_score DESC, region, product"))
def q_risk_table(spark, sf):
    return inv.risk_table(_case(spark, sf))


@query("top_risk", _with_case(RISK_SQL + " ORDER BY avg_risk_score DESC, region, product LIMIT 1"))
def q_top_risk(spark, sf):
    return inv.top_risk(_case(spark, sf))


@query("series_slice", """
SELECT * FROM sales_fact WHERE region = 'EUROPE' AND product = 'Brand#13'
ORDER BY date, l_orderkey, l_linenumber, l_partkey, l_suppkey""", ["sales_fact"])
def q_series_slice(spark, sf):
    return inv.series_slice(sales_fact(spark, sf), {"region": "EUROPE", "product": "Brand#13"}, SALES_ORDER)


@query("campaign_effect", """
SELECT CAST(promo AS VARCHAR) AS campaign, product, avg(sales) AS avg_sales FROM sales_fact GROUP BY 1, 2""", ["sales_fact"])
def q_campaign_effect(spark, sf):
    return inv.campaign_effect(sales_fact(spark, sf))


@query("transfer_suggestions", """
, rows_ AS (SELECT * FROM sales_month WHERE sales > 0 AND stock IS NOT NULL),
last_ AS (SELECT *, CASE WHEN stock / sales < 1 THEN 'stockout_risk' WHEN stock / sales <= 2 THEN 'balanced' ELSE 'excess' END AS st
          FROM rows_ WHERE date = (SELECT max(date) FROM rows_))
SELECT s.product, s.region AS from_region, d.region AS to_region,
       round_even(least(d.sales - d.stock, s.stock - s.sales), 0) AS transfer_qty
FROM last_ s JOIN last_ d ON s.product = d.product
WHERE s.st = 'excess' AND d.st = 'stockout_risk' AND least(d.sales - d.stock, s.stock - s.sales) > 0
ORDER BY transfer_qty DESC, product, from_region, to_region""", ["sales_fact", "sales_month"])
def q_transfer_suggestions(spark, sf):
    return inv.transfer_suggestions(sales_month(spark, sf))


@query("clip_p95", _with_case("""
SELECT region, product, date, l_orderkey, l_linenumber, l_partkey, l_suppkey, risk_score,
       least(risk_score, (SELECT quantile_cont(risk_score, 0.95) FROM inv_case)) AS risk_score_clipped
FROM inv_case"""))
def q_clip_p95(spark, sf):
    case = _case(spark, sf).select("region", "product", "date", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "risk_score")
    return inv.clip_at_quantile(case, "risk_score")
