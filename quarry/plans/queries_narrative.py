"""N: per-region narrative built from quality, trend, variability and forecast summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.common import join_keys
from quarry.operators import forecast as H
from quarry.operators import narrative as N
from quarry.operators import series as S
from quarry.plans.catalog import query
from quarry.plans.views import sales_fact

SF = ["sales_fact"]
K = ["region"]
BCOLS = ["date", "region", "location", "product", "category", "sales", "defect", "promo"]


def summary(spark, sf):
    """One row per region: quality (business columns), F9 trend, F13 variability, H6 moving-average forecast."""
    fact = sales_fact(spark, sf)
    biz = fact.select(*BCOLS)
    # one pass: equal rows fold to a row with its count, which gives rows, empty cells and repeats together
    nulls = sum((F.col(c).isNull().cast("int") for c in BCOLS), F.lit(0))
    folded = biz.groupBy(*BCOLS).agg(F.count(F.lit(1)).alias("_c"))
    q = folded.groupBy("region").agg(
        F.sum("_c").alias("total_rows"), F.sum(nulls * F.col("_c")).alias("_nulls"),
        F.sum(F.col("_c") - 1).cast("bigint").alias("duplicate_count")).select(
        "region", "total_rows", F.lit(len(BCOLS)).alias("total_cols"), "duplicate_count",
        (F.col("_nulls") / (F.col("total_rows") * len(BCOLS))).alias("missing_ratio"),
        (F.col("_nulls") * 100.0 / (F.col("total_rows") * len(BCOLS))).alias("missing_pct"))
    ds = S.daily_series(fact, "date", "sales", K)
    tr = S.recent_change(ds, "lookback14", K).select(
        "region", "recent_mean", "prior_mean", F.col("pct_change").alias("trend_pct"), S.trend_label(F.col("pct_change"), "metrics").alias("trend_direction"))
    var = S.variability(ds, "value", K).select("region", F.col("level").alias("volatility_label"), F.col("cv").alias("volatility_cv"))
    fc = H.forecast_summary(ds, 14, "moving_average", K).select(
        "region", "forecast_mean", F.col("pct_change").alias("forecast_pct"))
    out = q
    for part in (tr, var, fc):
        out = join_keys(out, part, K)
    return out


SUMMARY_SQL = """
, biz AS (SELECT date, region, location, product, category, sales, defect, promo FROM sales_fact),
q AS (SELECT region, count(*) AS total_rows, 8 AS total_cols,
             (count_if(date IS NULL) + count_if(region IS NULL) + count_if(location IS NULL) + count_if(product IS NULL)
              + count_if(category IS NULL) + count_if(sales IS NULL) + count_if(defect IS NULL) + count_if(promo IS NULL)) AS nulls_
      FROM biz GROUP BY region),
q2 AS (SELECT region, total_rows, total_cols, nulls_ / (total_rows * 8.0) AS missing_ratio, nulls_ * 100.0 / (total_rows * 8) AS missing_pct FROM q),
dups AS (SELECT region, CAST(sum(c - 1) AS BIGINT) AS duplicate_count
         FROM (SELECT region, count(*) AS c FROM biz GROUP BY date, region, location, product, category, sales, defect, promo) g GROUP BY region),
dsr AS (SELECT region, date, sum(sales) AS value FROM sales_fact WHERE date IS NOT NULL AND sales IS NOT NULL GROUP BY region, date),
i AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY date DESC) - 1 AS ri, count(*) OVER (PARTITION BY region) AS n FROM dsr),
p AS (SELECT *, greatest(2, least(14, floor(n / 2))) AS L FROM i),
a AS (SELECT region, max(n) AS n, avg(CASE WHEN ri < L THEN value END) AS recent_mean,
             avg(CASE WHEN ri >= L AND ri < 2 * L THEN value END) AS prior_mean,
             avg(CASE WHEN ri < greatest(2, least(7, n)) THEN value END) AS forecast_mean,
             avg(CASE WHEN ri < least(14, n) THEN value END) AS recent14,
             avg(value) AS mean_, stddev_samp(value) AS std_, count(value) AS cnt_ FROM p GROUP BY region),
t AS (SELECT region, recent_mean, prior_mean, forecast_mean,
             CASE WHEN recent14 <> 0 THEN (forecast_mean - recent14) / abs(recent14) * 100.0 ELSE 0.0 END AS forecast_pct,
             CASE WHEN n < 4 THEN 0.0 WHEN prior_mean = 0 OR prior_mean IS NULL THEN 0.0
                  ELSE (recent_mean - prior_mean) / abs(prior_mean) * 100.0 END AS pct,
             CASE WHEN cnt_ >= 2 AND mean_ <> 0 THEN std_ / abs(mean_) ELSE 0.0 END AS volatility_cv,
             CASE WHEN NOT (cnt_ >= 2 AND mean_ <> 0) THEN 'unknown' WHEN std_ / abs(mean_) < 0.15 THEN 'low'
                  WHEN std_ / abs(mean_) < 0.40 THEN 'moderate' ELSE 'high' END AS volatility_label
      FROM a WHERE n >= 5),
summ AS (SELECT q2.*, dups.duplicate_count, t.recent_mean, t.prior_mean, t.pct AS trend_pct,
                CASE WHEN pct > 2 THEN 'upward' WHEN pct < -2 THEN 'downward' ELSE 'flat' END AS trend_direction,
                t.volatility_label, t.volatility_cv, t.forecast_mean, t.forecast_pct
         FROM q2 JOIN dups USING (region) JOIN t USING (region))
"""


LABELS_SQL = SUMMARY_SQL + """,
lab AS (SELECT *, CASE WHEN iss = 0 THEN 'strong' WHEN iss = 1 AND missing_ratio <= 0.20 THEN 'moderate' ELSE 'weak' END AS quality_label,
               CASE WHEN recent_mean = 0 THEN 'near_current' WHEN forecast_mean > recent_mean * 1.02 THEN 'increase'
                    WHEN forecast_mean < recent_mean * 0.98 THEN 'decrease' ELSE 'stable' END AS forecast_change
        FROM (SELECT *, (CASE WHEN missing_ratio > 0.05 THEN 1 ELSE 0 END)
                        + (CASE WHEN duplicate_count / total_rows > 0.10 OR duplicate_count > 0 THEN 1 ELSE 0 END) AS iss FROM summ) x)
"""


@query("executive_summary", LABELS_SQL + """
SELECT region, quality_label, trend_direction, volatility_label, forecast_change,
       'quality=' || quality_label || '; sales trend=' || trend_direction || '; volatility=' || volatility_label AS overall_verdict
FROM lab""", SF)
def q_executive_summary(spark, sf):
    return N.executive_labels(summary(spark, sf)).select(
        "region", "quality_label", "trend_direction", "volatility_label", "forecast_change", "overall_verdict")


@query("executive_summary_text", LABELS_SQL + """
SELECT region, quality_label,
       printf('%s: %d rows x %d columns, %.1f%% of cells empty, %d repeated rows', quality_label, total_rows, total_cols,
              missing_ratio * 100.0, duplicate_count) AS quality_sentence,
       printf('sales: %s, recent mean %.1f against %.1f before (%+.1f%%)', trend_direction, recent_mean, coalesce(prior_mean, 0.0),
              CASE WHEN prior_mean <> 0 THEN (recent_mean - prior_mean) / abs(prior_mean) * 100.0 ELSE 0.0 END) AS trend_sentence,
       printf('sales: %s spread, standard deviation %.2f of the mean', volatility_label, volatility_cv) AS volatility_sentence,
       printf('moving_average, 14 periods ahead: %s, mean %.1f (%+.1f%%)', forecast_change, forecast_mean,
              CASE WHEN recent_mean <> 0 THEN (forecast_mean - recent_mean) / abs(recent_mean) * 100.0 ELSE 0.0 END) AS forecast_sentence,
       'sales outlook: ' || CASE WHEN recent_mean = 0 THEN 'no baseline' WHEN (forecast_mean - recent_mean) / abs(recent_mean) * 100.0 > 2 THEN 'rising'
                                 WHEN (forecast_mean - recent_mean) / abs(recent_mean) * 100.0 < -2 THEN 'falling' ELSE 'level' END
         AS forecast_interpretation
FROM lab""", SF)
def q_executive_summary_text(spark, sf):
    s = N.executive_sentences(N.executive_labels(summary(spark, sf)))
    return s.select("region", "quality_label", "quality_sentence", "trend_sentence", "volatility_sentence",
                    "forecast_sentence", "forecast_interpretation")


@query("recommendations", SUMMARY_SQL + """,
r AS (SELECT *, volatility_label AS variability,
             CASE WHEN forecast_pct > 1 THEN 'upward' WHEN forecast_pct < -1 THEN 'downward' ELSE 'stable' END AS direction FROM summ)
SELECT region,
       'quality ' || CASE WHEN missing_pct < 2 AND duplicate_count = 0 THEN 'strong' WHEN missing_pct < 10 THEN 'acceptable'
                          ELSE 'needs attention' END
       || ', demand ' || CASE variability WHEN 'low' THEN 'steady' WHEN 'moderate' THEN 'uneven' WHEN 'high' THEN 'erratic' ELSE 'unknown' END
       || ', forecast ' || direction AS short_summary,
       concat_ws(';', CASE WHEN variability = 'low' THEN 'maintain_replenishment_cadence' END,
                      CASE WHEN variability = 'moderate' THEN 'review_safety_stock' END,
                      CASE WHEN variability NOT IN ('low', 'moderate') THEN 'escalate_variability' END,
                      CASE WHEN variability NOT IN ('low', 'moderate') THEN 'increase_buffer_monitoring' END,
                      CASE WHEN direction = 'upward' THEN 'increase_stock_positions' WHEN direction = 'downward' THEN 'review_procurement'
                           ELSE 'maintain_planning_assumptions' END) AS actions,
       CASE variability WHEN 'low' THEN 'Low' WHEN 'moderate' THEN 'Moderate' WHEN 'high' THEN 'High' ELSE 'N/A' END AS risk_label,
       CASE WHEN missing_pct = 0 AND duplicate_count = 0 THEN 'quality_strong' WHEN missing_pct > 10 THEN 'missing_material'
            ELSE 'cleanup_advisable' END AS quality_note,
       CASE variability WHEN 'low' THEN 'small_buffer' WHEN 'moderate' THEN 'check_safety_stock' WHEN 'high' THEN 'large_buffer'
                        ELSE 'undetermined' END AS variability_guidance,
       CASE direction WHEN 'upward' THEN 'increase_coverage' WHEN 'downward' THEN 'avoid_excess_stock' ELSE 'maintain_policy' END AS action_message,
       printf('%d rows, %d columns', total_rows, total_cols) AS size_insight,
       CASE WHEN trend_pct > 2 THEN 'upward' WHEN trend_pct < -2 THEN 'downward' ELSE 'stable' END AS trend_insight,
       CASE variability WHEN 'low' THEN 'stable' WHEN 'moderate' THEN 'moderate' WHEN 'high' THEN 'volatile' ELSE 'unknown' END AS stability_insight
FROM r""", SF)
def q_recommendations(spark, sf):
    s = summary(spark, sf).withColumns({
        "variability": F.col("volatility_label"),
        "direction": F.when(F.col("forecast_pct") > 1, "upward").when(F.col("forecast_pct") < -1, "downward").otherwise("stable"),
    })
    return N.recommendations(s).select("region", "short_summary", "actions", "risk_label", "quality_note", "variability_guidance",
                                       "action_message", "size_insight", "trend_insight", "stability_insight")
