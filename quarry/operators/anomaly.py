"""Anomaly detection: rolling z-score on a daily series, global z-score, z-score within groups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.common import group, num
from quarry.functions.order import rolling_by

# Fixed risk thresholds (anomaly ratio).
RISK_HIGH, RISK_MEDIUM = 0.10, 0.05


def rolling_zscore(series: DataFrame, window: int = 28, z: float = 2.0, keys: Sequence[str] = (),
                   raw: DataFrame | None = None) -> DataFrame:
    """G1: rolling mean/std including the current point, min_periods = max(5, window // 2).

    std 0 -> undefined -> z = 0; |z| >= z is an anomaly, typed spike / drop.
    ``series`` is a daily series (see ``daily_series``).  With ``raw`` (the
    rows it was built from) keys with fewer than window + 5 raw rows are left out.
    """
    if raw is not None:
        enough = group(raw, keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") >= window + 5)
        if keys:
            renamed = enough.select(*[F.col(k).alias(f"_e{i}") for i, k in enumerate(keys)])
            same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_e{i}")) for i, k in enumerate(keys)])
            series = series.join(renamed, same, "left_semi")
        else:
            series = series.where(raw.agg(F.count(F.lit(1))).scalar() >= window + 5)
    minp = max(5, window // 2)

    def columns(w: Window) -> dict[str, Column]:
        cnt = F.count("value").over(w)
        std = F.when(cnt >= minp, F.stddev_samp("value").over(w))
        return {"rolling_mean": F.when(cnt >= minp, F.avg("value").over(w)), "rolling_std": F.when(std != 0, std)}

    out = rolling_by(series, keys, window, columns)
    zs = F.coalesce((F.col("value") - F.col("rolling_mean")) / F.col("rolling_std"), F.lit(0.0))
    out = out.withColumn("z_score", zs)
    return out.withColumns({
        "is_anomaly": F.abs("z_score") >= z,
        "anomaly_type": F.when(F.col("z_score") >= z, "spike").when(F.col("z_score") <= -z, "drop").otherwise("normal"),
    })


def anomaly_summary(scored: DataFrame, keys: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """Counts, ratio, latest status and risk level (>= thresholds; ``strict`` uses >)."""
    t = group(scored, keys).agg(
        F.count(F.lit(1)).alias("points"),
        F.count_if("is_anomaly").alias("anomaly_count"),
        F.count_if(F.col("anomaly_type") == "spike").alias("spike_count"),
        F.count_if(F.col("anomaly_type") == "drop").alias("drop_count"),
        F.max_by("anomaly_type", "date").alias("latest_status"),
    )
    ratio = F.coalesce(F.try_divide(F.col("anomaly_count"), F.col("points")), F.lit(0.0))  # no points: ratio 0
    hi = ratio > RISK_HIGH if strict else ratio >= RISK_HIGH
    med = ratio > RISK_MEDIUM if strict else ratio >= RISK_MEDIUM
    return t.withColumn("anomaly_ratio", ratio).withColumn("risk_level", F.when(hi, "high").when(med, "medium").otherwise("low"))


def global_zscore(df: DataFrame, value: str, threshold: float = 3.0) -> DataFrame:
    """(x - mean) / std over the whole table, strict > threshold.

    mean and std are one aggregation each, inlined as scalar subqueries (no
    global window, no join).
    """
    v = num(value)
    stats = df.agg(F.avg(v).alias("m"), F.stddev_samp(v).alias("s"))
    mean = stats.select("m").scalar()
    std = stats.select("s").scalar()
    z = F.try_divide(v - mean, std)
    return df.withColumn("z_score", z).withColumn("is_anomaly", F.coalesce(F.abs("z_score") > threshold, F.lit(False)))


def anomaly_count_summary(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Total points, anomalies, ratio."""
    t = group(scored, keys).agg(F.count(F.lit(1)).alias("total_points"), F.count_if("is_anomaly").alias("anomalies"))
    return t.withColumn("anomaly_ratio", F.when(F.col("total_points") > 0, F.col("anomalies") / F.col("total_points")).otherwise(F.lit(0.0)))


def group_zscore(df: DataFrame, value: str, keys: Sequence[str], z: float = 2.0, out: str = "z_score") -> DataFrame:
    """Z-score within each key group; 0 when the group std is 0 or undefined; flag |z| >= z.

    Group mean/std are one aggregation joined back on the keys (a shuffle of
    the small key table, or a broadcast when AQE sees it is small), so a hot
    key is never gathered into one task.
    """
    keys = list(keys)
    names = [f"_g{i}" for i in range(len(keys))]
    stats = df.groupBy(*[F.col(k).alias(g) for k, g in zip(keys, names)]).agg(
        F.avg(num(value)).alias("_m"), F.stddev_samp(num(value)).alias("_s"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(g)) for k, g in zip(keys, names)])  # a NULL key is a group of its own
    zs = F.when(F.col("_s") > 0, (num(value) - F.col("_m")) / F.col("_s")).otherwise(F.lit(0.0))
    return df.join(stats, same).withColumn(out, zs).drop("_m", "_s", *names).withColumn("is_anomaly", F.abs(out) >= z)


def anomaly_list(scored: DataFrame, z_col: str = "z_score") -> DataFrame:
    """Anomalous rows ordered by |z| descending."""
    return scored.where("is_anomaly").orderBy(F.abs(z_col).desc())
