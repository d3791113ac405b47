"""Inventory and operations analytics (stock health, defects, production, case study).

All operators are aggregations or keyed windows over a sales-like table with
``date, region, product, sales, stock`` (and ``production``/``defect`` for
the operations views).  Optional ``keys`` produce one result row per key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.common import group, num
from quarry.functions.order import rolling, with_row_index
from quarry.functions.quantiles import exact_quantile
from quarry.functions.parse import parse_any_datetime

# Fixed thresholds and labels of the case study (values that define results).
STOCKOUT_THRESHOLD = 0.0
HIGH_DEFECT_THRESHOLD = 5.0
OPTIONAL_COLUMNS = ("temperature", "campaign")
STATUS_STOCKOUT, STATUS_BALANCED, STATUS_EXCESS = "stockout_risk", "balanced", "excess"


# ---------------------------------------------------------------- J1-J4
def _stockout_pct(stock: Column) -> Column:
    """Share of known stock values at or below the stock-out threshold, percent; 0 without values."""
    return F.coalesce(F.try_divide(F.count_if(stock <= STOCKOUT_THRESHOLD) * 100.0, F.count(stock)), F.lit(0.0))


def stock_to_sales(df: DataFrame, stock: str = "stock", sales: str | None = "sales", keys: Sequence[str] = ()) -> DataFrame:
    """Stock level statistics, stock/sales ratio of means and stock-out periods.

    Each column drops its own nulls (stock and sales are cleaned independently);
    without any stock value the statistics are 0 and the ratio NULL.
    """
    s, zero = num(stock), F.lit(0.0)
    aggs = [
        F.coalesce(F.avg(s), zero).alias("avg_stock"),
        F.coalesce(F.min(s), zero).alias("min_stock"),
        F.coalesce(F.max(s), zero).alias("max_stock"),
        F.count_if(s <= STOCKOUT_THRESHOLD).alias("stockout_risk_days"),
        _stockout_pct(s).alias("stockout_risk_pct"),
    ]
    if sales:
        avg_sales = F.avg(num(sales))
        aggs.append(F.when(avg_sales > 0, F.try_divide(F.avg(s), avg_sales)).alias("stock_to_sales_ratio"))
    return group(df, keys).agg(*aggs)


def defect_summary(df: DataFrame, defect: str = "defect", keys: Sequence[str] = ()) -> DataFrame:
    """Defect rate mean/max/min/sample std and periods above 5.0."""
    d = num(defect)
    return group(df, keys).agg(
        F.avg(d).alias("mean"),
        F.max(d).alias("max"),
        F.min(d).alias("min"),
        F.stddev_samp(d).alias("std"),
        F.count_if(d > HIGH_DEFECT_THRESHOLD).alias("high_defect_periods"),
    )


def production_summary(df: DataFrame, production: str = "production", sales: str | None = "sales", keys: Sequence[str] = ()) -> DataFrame:
    """Production totals and production-to-sales ratio of means."""
    p = num(production)
    aggs = [F.sum(p).alias("total"), F.avg(p).alias("mean"), F.max(p).alias("max"), F.min(p).alias("min")]
    if sales:
        avg_sales = F.avg(num(sales))
        aggs.append(F.when(avg_sales > 0, F.try_divide(F.avg(p), avg_sales)).alias("prod_to_sales_ratio"))
    return group(df, keys).agg(*aggs)


def stockout_level(pct: Column) -> Column:
    return F.when(pct <= 5, "low").when(pct <= 15, "moderate").otherwise("high")


def production_balance(ratio: Column) -> Column:
    return (F.when(ratio.isNull(), "unknown").when(ratio < 0.95, "under_production")
            .when(ratio > 1.30, "over_production").otherwise("aligned"))


def defect_level(mean_pct: Column) -> Column:
    return F.when(mean_pct > 5, "high").when(mean_pct > 2, "elevated").otherwise("normal")


def ops_labels(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Stock-out, production and defect labels from J1-J3 in one aggregation pass.

    Defect rates are fractions here and converted to percent before labelling.
    """
    s, q, p, d = num("stock"), num("sales"), num("production"), num("defect")
    out = group(df, keys).agg(
        _stockout_pct(s).alias("stockout_pct"),
        F.when(F.avg(q) > 0, F.try_divide(F.avg(p), F.avg(q))).alias("prod_to_sales_ratio"),
        (F.avg(d) * 100.0).alias("defect_pct"),
    )
    return out.select(
        *keys, "stockout_pct", "prod_to_sales_ratio", "defect_pct",
        stockout_level(F.col("stockout_pct")).alias("stockout_label"),
        production_balance(F.col("prod_to_sales_ratio")).alias("production_label"),
        defect_level(F.col("defect_pct")).alias("defect_label"),
    )


# ---------------------------------------------------------------- J5
def production_vs_sales(df: DataFrame, order_by: Sequence[str], production: str = "production", sales: str = "sales") -> DataFrame:
    """Align the non-null production and sales values by position.

    The rows are numbered once (distributed row index), with a running count of
    the non-null values of either column; the two numbered series are equi-joined
    on their counts: the inner join truncates to the shorter one.
    """
    rows = df.select(*order_by, num(production).alias("production"), num(sales).alias("sales"))
    idx = with_row_index(rows, order_by, running={"_p": F.col("production").isNotNull(), "_s": F.col("sales").isNotNull()})
    p = idx.where("production IS NOT NULL").select(F.col("_p").alias("position"), "production")
    s = idx.where("sales IS NOT NULL").select(F.col("_s").alias("position"), "sales")
    return p.join(s, "position").select(
        "position", "production", "sales",
        (F.col("production") - F.col("sales")).alias("gap"),
    )


# ---------------------------------------------------------------- J6-J10
def _cover(stock: Column, sales: Column) -> Column:
    """stock / (sales + 1); sales of -1 give an infinite ratio with the sign of the stock, NULL without stock."""
    inf = F.lit(float("inf"))
    return F.when(sales + 1 == 0, F.when(stock > 0, inf).when(stock < 0, -inf)).otherwise(F.try_divide(stock, sales + 1))


def _band(ratio: Column) -> Column:
    return (F.when(ratio < 0.5, "critical").when(ratio < 1.0, "low")
            .when(ratio <= 2.0, "optimal").when(ratio > 2.0, "excess"))


def stock_bands(df: DataFrame, stock: str = "stock", sales: str = "sales", keys: Sequence[str] = ()) -> DataFrame:
    """ratio = stock / (sales + 1) banded critical/low/optimal/excess; counts per band."""
    s, q = num(stock), num(sales)
    rows = df.where(s.isNotNull() & q.isNotNull()).select(*keys, _band(_cover(s, q)).alias("band"))
    return rows.groupBy(*keys, "band").agg(F.count(F.lit(1)).alias("rows"))


def dashboard_kpis(df: DataFrame, stock: str = "stock", sales: str = "sales", keys: Sequence[str] = ()) -> DataFrame:
    """average/total sales, safety stock, availability and excess stock."""
    q, s = num(sales), num(stock)
    base = group(df, keys).agg(F.avg(q).alias("avg_sales"), F.sum(q).alias("total_sales"), F.avg(s).alias("avg_stock"))
    safety = F.col("avg_sales") * 1.25
    return base.select(
        *keys, "avg_sales", "total_sales", "avg_stock",
        safety.alias("safety_stock"),
        F.least(F.lit(100.0), F.try_divide(F.col("avg_stock"), F.col("avg_sales") * 14) * 100.0).alias("stock_availability"),
        F.greatest(F.lit(0.0), F.col("avg_stock") - safety * 1.3).alias("excess_stock"),
    )


def stock_risk_share(df: DataFrame, stock: str = "stock", sales: str = "sales", keys: Sequence[str] = ()) -> DataFrame:
    """Share of critical+low rows, mean of the finite ratios and excess count (ratio = stock/(sales+1))."""
    s, q = num(stock), num(sales)
    r = _cover(s, q)
    rows = df.where(s.isNotNull() & q.isNotNull())
    return group(rows, keys).agg(
        F.count_if(r < 0.5).alias("critical"),
        F.count_if((r >= 0.5) & (r < 1.0)).alias("low"),
        F.count_if(r > 2.0).alias("excess"),
        F.try_divide(F.count_if(r < 1.0) * 100.0, F.count(F.lit(1))).alias("risk_pct"),
        F.avg(F.when(F.abs(r) < float("inf"), r)).alias("avg_stock_ratio"),
    )


def safety_stock(df: DataFrame, date: str = "date", stock: str = "stock", keys: Sequence[str] = ()) -> DataFrame:
    """0.3 x mean of the daily mean stock (two-level aggregation)."""
    daily = df.groupBy(*keys, date).agg(F.avg(num(stock)).alias("daily_stock"))
    return group(daily, keys).agg((F.avg("daily_stock") * 0.3).alias("safety_stock"), F.count(F.lit(1)).alias("days"))


def error_rate_daily(df: DataFrame, date: str = "date", error: str = "defect", threshold: float = 0.04) -> DataFrame:
    """Daily mean error rate in percent and a flag when the mean is above ``threshold``."""
    daily = df.groupBy(date).agg(F.avg(num(error)).alias("error_rate"))
    return daily.select(
        date, "error_rate", (F.col("error_rate") * 100.0).alias("error_pct"),
        (F.col("error_rate") > threshold).alias("above_threshold"),
    )


def error_rate_rows(df: DataFrame, error: str = "defect", threshold_pct: float = 5.0) -> DataFrame:
    """J10, per row: the error rate in percent and a flag when it is above ``threshold_pct``."""
    pct = num(error) * 100.0
    return df.withColumns({"error_pct": pct, "above_threshold": F.coalesce(pct > threshold_pct, F.lit(False))})


# ---------------------------------------------------------------- J11-J18 case study
def stock_status(ratio: Column) -> Column:
    return F.when(ratio < 1, STATUS_STOCKOUT).when(ratio <= 2, STATUS_BALANCED).otherwise(STATUS_EXCESS)


def inventory_case(
    df: DataFrame,
    order_by: Sequence[str],
    keys: Sequence[str] = ("region", "product"),
    window: int = 7,
    z_threshold: float = 2.0,
    with_rolling: bool = True,
    with_score: bool = True,
    aliases: Mapping[str, str] | None = None,
) -> DataFrame:
    """Clean rows, stock ratio / risk / status, z-score within key, 7-row rolling demand.

    ``aliases`` renames source columns first, text dates are parsed, and the
    optional columns (temperature, campaign) are carried along where present.

    Summaries (J12-J14, J18) read neither the z-score nor the rolling demand:
    ``with_score=False`` leaves out both, and with them the second scan.

    * z-score: per-key mean and sample std are aggregated once and joined back
      (AQE broadcasts the key table when it is small); std 0 or undefined -> z = 0.
    * rolling demand: the rows of each key are numbered in (order_by) order
      with the distributed row index and the window runs in halo buckets, so
      a key holding a large share of all rows is split across many tasks.
    """
    keys = list(keys)
    required = ["date", *keys, "sales", "stock"]
    df = df.withColumnsRenamed(dict(aliases or {}))
    if dict(df.dtypes)["date"] == "string":
        df = df.withColumn("date", parse_any_datetime(F.col("date")))
    optional = [c for c in OPTIONAL_COLUMNS if c in df.columns]
    base = df.select(*{c: None for c in [*required, *order_by, *optional]}.keys())
    clean = base.withColumn("sales", num("sales")).withColumn("stock", num("stock"))
    clean = clean.dropna(subset=required).where(F.col("sales") > 0)
    clean = clean.withColumns({
        "stock_ratio": F.col("stock") / F.col("sales"),
        "risk_score": F.abs(F.col("stock") - F.col("sales")) / F.col("sales"),
    }).withColumn("stock_status", stock_status(F.col("stock_ratio")))

    def score(rows: DataFrame) -> DataFrame:
        stats = rows.groupBy(*keys).agg(F.avg("sales").alias("_mean"), F.stddev_samp("sales").alias("_std"))
        z = F.when(F.col("_std") > 0, (F.col("sales") - F.col("_mean")) / F.col("_std")).otherwise(F.lit(0.0))
        out = rows.join(stats, keys).withColumn("sales_zscore", z).drop("_mean", "_std")
        return out.withColumn("anomaly_flag", F.when(F.abs("sales_zscore") >= z_threshold, "anomaly").otherwise("normal"))

    if not with_score:
        return clean
    if not with_rolling:
        return score(clean)
    # number the cleaned rows first (one pass of the input), then score and roll
    indexed = with_row_index(clean, order_by, keys=keys, idx="_idx")
    out = rolling(score(indexed), keys, "_idx", window, lambda w: {"rolling_demand_7": F.avg("sales").over(w)})
    return out.drop("_idx")


def inventory_kpis(case: DataFrame) -> DataFrame:
    """Totals and shares over the prepared case rows."""
    st = F.col("stock_status")
    return case.agg(
        F.sum("sales").alias("total_sales"),
        F.avg("stock").alias("avg_stock"),
        (F.avg(F.when(st == STATUS_STOCKOUT, 1.0).otherwise(0.0)) * 100).alias("stockout_rate"),
        (F.avg(F.when(st == STATUS_EXCESS, 1.0).otherwise(0.0)) * 100).alias("excess_rate"),
        F.count_if(st != STATUS_BALANCED).alias("risky_count"),
    )


def risk_table(case: DataFrame, keys: Sequence[str] = ("region", "product")) -> DataFrame:
    """Per key sums/means and status-day counts, ordered by mean risk (desc)."""
    keys = list(keys)
    st = F.col("stock_status")
    return (
        case.groupBy(*keys).agg(
            F.sum("sales").alias("total_sales"),
            F.avg("stock").alias("avg_stock"),
            F.avg("stock_ratio").alias("avg_stock_ratio"),
            F.avg("risk_score").alias("avg_risk_score"),
            F.count_if(st == STATUS_STOCKOUT).alias("stockout_days"),
            F.count_if(st == STATUS_EXCESS).alias("excess_days"),
        )
        .orderBy(F.col("avg_risk_score").desc(), *keys)
    )


def top_risk(case: DataFrame, keys: Sequence[str] = ("region", "product")) -> DataFrame:
    """The riskiest key (first row of J13; TakeOrderedAndProject keeps one row per task)."""
    return risk_table(case, keys).limit(1)


def series_slice(df: DataFrame, filters: dict, order_by: Sequence[str]) -> DataFrame:
    """Equality filter (pushed into the scan) ordered by the series order."""
    cond = F.lit(True)
    for k, v in filters.items():
        cond = cond & (F.col(k) == F.lit(v))
    return df.where(cond).orderBy(*order_by)


def campaign_effect(df: DataFrame, campaign: str = "promo", product: str = "product", sales: str = "sales") -> DataFrame:
    """Mean sales per (campaign, product); campaign compared as text."""
    return df.groupBy(F.col(campaign).cast("string").alias("campaign"), product).agg(F.avg(num(sales)).alias("avg_sales"))


def transfer_suggestions(df: DataFrame, date: str = "date", region: str = "region", product: str = "product") -> DataFrame:
    """Stock transfers from excess to stock-out regions of the same product on the latest date.

    The latest date is a scalar subquery (computed once, inlined), the
    rows of that date are summed per (region, product), split by status and
    equi-joined on product, so pairs per product are bounded by regions x
    regions whatever the input's grain.  Pairs are independent: a surplus is not
    consumed by earlier suggestions.
    """
    rows = df.select(date, region, product, num("sales").alias("sales"), num("stock").alias("stock"))
    rows = rows.dropna().where(F.col("sales") > 0)
    latest = rows.agg(F.max(date)).scalar()
    last = rows.where(F.col(date) == latest).groupBy(region, product).agg(F.sum("sales").alias("sales"), F.sum("stock").alias("stock"))
    status = stock_status(F.col("stock") / F.col("sales"))
    last = last.withColumn("_status", status)
    surplus = last.where(F.col("_status") == STATUS_EXCESS).select(
        F.col(product), F.col(region).alias("from_region"), (F.col("stock") - F.col("sales")).alias("_surplus"))
    deficit = last.where(F.col("_status") == STATUS_STOCKOUT).select(
        F.col(product), F.col(region).alias("to_region"), (F.col("sales") - F.col("stock")).alias("_need"))
    pairs = surplus.join(deficit, product)
    qty = F.least("_need", "_surplus")
    return (
        pairs.where(qty > 0)
        .select(product, "from_region", "to_region", F.bround(qty, 0).alias("transfer_qty"))
        .orderBy(F.col("transfer_qty").desc(), product, "from_region", "to_region")
    )


def clip_at_quantile(df: DataFrame, column: str, q: float = 0.95, out: str | None = None, approx: bool = False) -> DataFrame:
    """Cap a column at its q-quantile (linear interpolation); the cap is a scalar subquery.

    ``approx=True`` takes the cap from a sketch instead of the exact bracket search.
    """
    cap = df.agg(F.percentile_approx(num(column), q, 10000)).scalar() if approx else exact_quantile(df, column, q)
    return df.withColumn(out or f"{column}_clipped", F.least(num(column), cap))
