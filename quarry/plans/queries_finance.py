"""K finance and L cut queries over ``sales_fact``."""

from __future__ import annotations

from quarry.operators import cuts as C
from quarry.operators import finance as K
from quarry.plans.catalog import query
from quarry.plans.views import sales_fact

SF = ["sales_fact"]
ROWS = """fin AS (
  SELECT *, sales * price AS revenue, sales * cost AS cogs, sales * price - sales * cost AS gross_profit,
         stock * cost AS inventory_value,
         CASE WHEN sales * price <> 0 THEN (sales * price - sales * cost) / (sales * price) * 100.0 END AS gross_margin_pct
  FROM sales_fact WHERE sales IS NOT NULL AND price IS NOT NULL AND cost IS NOT NULL AND stock IS NOT NULL)"""
TOTALS = """tot AS (
  SELECT total_revenue, gross_profit,
         CASE WHEN total_revenue <> 0 THEN gross_profit / total_revenue * 100.0 END AS gross_margin_pct, inventory_value,
         CASE WHEN s_ <> 0 THEN st_ / s_ END AS stock_to_sales, promo_sales, non_promo_sales,
         CASE WHEN non_promo_sales <> 0 THEN (promo_sales - non_promo_sales) / non_promo_sales * 100.0 END AS promo_lift
  FROM (SELECT sum(revenue) AS total_revenue, sum(gross_profit) AS gross_profit, sum(inventory_value) AS inventory_value,
               sum(stock) AS st_, sum(sales) AS s_, avg(CASE WHEN promo = 1 THEN sales END) AS promo_sales,
               avg(CASE WHEN promo = 0 THEN sales END) AS non_promo_sales FROM fin) t)"""


def _rows(spark, sf):
    return K.finance_rows(sales_fact(spark, sf))


@query("finance_rows", f", {ROWS} SELECT * FROM fin", SF)
def q_finance_rows(spark, sf):
    return _rows(spark, sf)


@query("finance_totals", f", {ROWS}, {TOTALS} SELECT * FROM tot", SF)
def q_finance_totals(spark, sf):
    return K.finance_totals(_rows(spark, sf))


@query("promo_lift", """
SELECT category, promo_sales, non_promo_sales,
       CASE WHEN non_promo_sales <> 0 THEN (promo_sales - non_promo_sales) / non_promo_sales * 100.0 END AS promo_lift
FROM (SELECT category, avg(CASE WHEN promo = 1 THEN sales END) AS promo_sales, avg(CASE WHEN promo = 0 THEN sales END) AS non_promo_sales
      FROM sales_fact GROUP BY category) t""", SF)
def q_promo_lift(spark, sf):
    return K.promo_lift(sales_fact(spark, sf), keys=["category"])


@query("finance_daily", f", {ROWS} SELECT date, sum(revenue) AS revenue, sum(gross_profit) AS gross_profit FROM fin GROUP BY date", SF)
def q_finance_daily(spark, sf):
    return K.finance_daily(_rows(spark, sf))


@query("finance_by_category", f""", {ROWS}
SELECT category, revenue, gross_profit, inventory_value, gross_profit / nullif(revenue, 0) * 100.0 AS gross_margin_pct
FROM (SELECT category, sum(revenue) AS revenue, sum(gross_profit) AS gross_profit, sum(inventory_value) AS inventory_value
      FROM fin GROUP BY category) t""", SF)
def q_finance_by_category(spark, sf):
    return K.finance_by_category(_rows(spark, sf))


@query("finance_labels", f""", {ROWS}, {TOTALS}
SELECT *, CASE WHEN gross_margin_pct < 20 THEN 'margin_low' WHEN gross_margin_pct < 35 THEN 'margin_medium' ELSE 'margin_healthy' END AS margin_label,
       CASE WHEN stock_to_sales > 3 THEN 'stock_high' ELSE 'stock_manageable' END AS stock_label,
       CASE WHEN promo_lift IS NULL THEN NULL WHEN promo_lift > 10 THEN 'promo_strong' WHEN promo_lift > 0 THEN 'promo_limited'
            ELSE 'promo_none' END AS promo_label,
       coalesce(nullif(concat_ws(',',
           CASE WHEN gross_margin_pct < 25 THEN 'margin_pressure' END,
           CASE WHEN inventory_value > total_revenue * 0.30 THEN 'inventory_heavy' END,
           CASE WHEN stock_to_sales > 3 THEN 'slow_turnover' END,
           CASE WHEN promo_lift IS NOT NULL AND promo_lift <= 0 THEN 'promo_ineffective' END), ''), 'balanced') AS notes
FROM tot""", SF)
def q_finance_labels(spark, sf):
    return K.finance_labels(K.finance_totals(_rows(spark, sf)))


@query("sales_by_category", "SELECT category, sum(sales) AS total FROM sales_fact GROUP BY category", SF)
def q_sales_by_category(spark, sf):
    return C.sum_by(sales_fact(spark, sf), "category")


@query("sales_share", """
SELECT location, total, total / (SELECT sum(sales) FROM sales_fact) AS share
FROM (SELECT location, sum(sales) AS total FROM sales_fact GROUP BY location) t""", SF)
def q_sales_share(spark, sf):
    return C.share_by(sales_fact(spark, sf), "location")


# The oracle names the columns that the test data has; the query takes them from the data.
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query("pivot_category_location", "SELECT category, " + ", ".join(
    f"coalesce(sum(CASE WHEN location = '{r}' THEN sales END), 0.0) AS \"{r}\"" for r in REGIONS)
    + " FROM sales_fact GROUP BY category", SF)
def q_pivot_category_location(spark, sf):
    return C.pivot_sum(sales_fact(spark, sf), "category", "location")


@query("value_counts", "SELECT product, count(*) AS count FROM sales_fact GROUP BY product ORDER BY count DESC, product", SF)
def q_value_counts(spark, sf):
    return C.value_counts(sales_fact(spark, sf), "product")


@query("category_filter", "SELECT * FROM sales_fact WHERE CAST(promo AS VARCHAR) IN ('1') AND category IN ('ECONOMY', 'STANDARD')", SF)
def q_category_filter(spark, sf):
    return C.category_filter(C.category_filter(sales_fact(spark, sf), "promo", [1]), "category", ["ECONOMY", "STANDARD"])


@query("distinct_values", """
SELECT product, n AS n_distinct, n > 1 AND n <= 50 AS selectable
FROM (SELECT DISTINCT product FROM sales_fact WHERE product IS NOT NULL) d, (SELECT count(DISTINCT product) AS n FROM sales_fact) c
ORDER BY product""", SF)
def q_distinct_values(spark, sf):
    return C.distinct_values(sales_fact(spark, sf), "product")
