"""Finance measures: revenue, COGS, gross profit/margin, inventory value, promotion lift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.common import group, num

# Fixed thresholds of the finance notes.
MARGIN_LOW, MARGIN_MID, MARGIN_NOTE = 20.0, 35.0, 25.0
STOCK_TO_SALES_HIGH = 3.0
LIFT_STRONG = 10.0
INVENTORY_SHARE_HIGH = 0.30


def finance_rows(df: DataFrame, sales: str = "sales", price: str = "price", cost: str = "cost", stock: str = "stock") -> DataFrame:
    """K1: drop rows missing any input; revenue, cogs, gross profit, margin % (NULL if revenue 0), inventory value."""
    rows = df.withColumns({sales: num(sales), price: num(price), cost: num(cost), stock: num(stock)}).dropna(subset=[sales, price, cost, stock])
    revenue = F.col(sales) * F.col(price)
    cogs = F.col(sales) * F.col(cost)
    return rows.withColumns({"revenue": revenue, "cogs": cogs}).withColumns({
        "gross_profit": F.col("revenue") - F.col("cogs"),
        "inventory_value": F.col(stock) * F.col(cost),
    }).withColumn("gross_margin_pct", F.when(F.col("revenue") != 0, F.col("gross_profit") / F.col("revenue") * 100.0))


def finance_totals(rows: DataFrame, sales: str = "sales", stock: str = "stock", promo: str | None = "promo",
                   keys: Sequence[str] = ()) -> DataFrame:
    """K2 + K3: totals, gross margin %, inventory value, stock/sales and promotion lift in one pass."""
    aggs = [
        F.sum("revenue").alias("total_revenue"),
        F.sum("gross_profit").alias("gross_profit"),
        F.sum("inventory_value").alias("inventory_value"),
        F.sum(stock).alias("_stock"), F.sum(sales).alias("_sales"),
    ]
    if promo:
        aggs += [F.avg(F.when(F.col(promo) == 1, F.col(sales))).alias("promo_sales"),
                 F.avg(F.when(F.col(promo) == 0, F.col(sales))).alias("non_promo_sales")]
    t = group(rows, keys).agg(*aggs)
    cols = [
        *keys, "total_revenue", "gross_profit",
        F.when(F.col("total_revenue") != 0, F.col("gross_profit") / F.col("total_revenue") * 100.0).alias("gross_margin_pct"),
        "inventory_value",
        F.when(F.col("_sales") != 0, F.col("_stock") / F.col("_sales")).alias("stock_to_sales"),
    ]
    if promo:
        cols += ["promo_sales", "non_promo_sales",
                 F.when(F.col("non_promo_sales") != 0,
                        (F.col("promo_sales") - F.col("non_promo_sales")) / F.col("non_promo_sales") * 100.0).alias("promo_lift")]
    return t.select(*cols)


def promo_lift(df: DataFrame, sales: str = "sales", promo: str = "promo", keys: Sequence[str] = ()) -> DataFrame:
    """K3: % difference of mean sales with promotion (=1) vs without (=0)."""
    s = num(sales)
    t = group(df, keys).agg(F.avg(F.when(F.col(promo) == 1, s)).alias("promo_sales"),
                           F.avg(F.when(F.col(promo) == 0, s)).alias("non_promo_sales"))
    return t.withColumn("promo_lift", F.when(F.col("non_promo_sales") != 0,
                        (F.col("promo_sales") - F.col("non_promo_sales")) / F.col("non_promo_sales") * 100.0))


def finance_daily(rows: DataFrame, date: str = "date") -> DataFrame:
    """K4: revenue and gross profit per date."""
    return rows.groupBy(date).agg(F.sum("revenue").alias("revenue"), F.sum("gross_profit").alias("gross_profit"))


def finance_by_category(rows: DataFrame, category: str = "category") -> DataFrame:
    """K5: revenue, profit, inventory value and margin % per category."""
    t = rows.groupBy(category).agg(F.sum("revenue").alias("revenue"), F.sum("gross_profit").alias("gross_profit"),
                                   F.sum("inventory_value").alias("inventory_value"))
    return t.withColumn("gross_margin_pct", F.try_divide(F.col("gross_profit"), F.col("revenue")) * 100.0)


def finance_labels(totals: DataFrame) -> DataFrame:
    """K6: commercial insight and decision-note codes from the totals row."""
    m, s2s, lift = F.col("gross_margin_pct"), F.col("stock_to_sales"), F.col("promo_lift")
    margin = F.when(m < MARGIN_LOW, "margin_low").when(m < MARGIN_MID, "margin_medium").otherwise("margin_healthy")
    stock = F.when(s2s > STOCK_TO_SALES_HIGH, "stock_high").otherwise("stock_manageable")
    promo = (F.when(lift.isNull(), F.lit(None)).when(lift > LIFT_STRONG, "promo_strong")
             .when(lift > 0, "promo_limited").otherwise("promo_none"))
    notes = F.array_compact(F.array(
        F.when(m < MARGIN_NOTE, F.lit("margin_pressure")),
        F.when(F.col("inventory_value") > F.col("total_revenue") * INVENTORY_SHARE_HIGH, F.lit("inventory_heavy")),
        F.when(s2s > STOCK_TO_SALES_HIGH, F.lit("slow_turnover")),
        F.when(lift.isNotNull() & (lift <= 0), F.lit("promo_ineffective")),
    ))
    notes = F.when(F.size(notes) == 0, F.array(F.lit("balanced"))).otherwise(notes)
    return totals.select("*", margin.alias("margin_label"), stock.alias("stock_label"), promo.alias("promo_label"),
                         F.array_join(notes, ",").alias("notes"))
