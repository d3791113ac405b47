"""One series over the whole table: same results as plain windows, without a window or a buffer over all its points."""

import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import order
from quarry.functions.quantiles import exact_quantile, exact_quantiles
from quarry.operators import anomaly, diagnostics, forecast
from quarry.operators import series as S

POINTS = 700


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(12)
    minutes = np.cumsum(rng.integers(1, 50, POINTS))
    return pd.DataFrame({"date": pd.Timestamp("2024-01-01") + pd.to_timedelta(minutes, "min"),
                         "value": np.round(100 + rng.normal(0, 9, POINTS).cumsum(), 3)})


@pytest.fixture(scope="module")
def series(spark, points):
    df = spark.createDataFrame(points.sample(frac=1, random_state=1)).repartition(5)
    return df.withColumn("date", F.col("date").cast("timestamp_ntz")).checkpoint()


@pytest.fixture(autouse=True)
def small_buckets(monkeypatch):
    monkeypatch.setattr(order, "DEFAULT_BUCKET_ROWS", 64)
    for f in (order.neighbours, order.rolling):
        defaults = list(f.__defaults__)
        monkeypatch.setattr(f, "__defaults__", tuple(64 if d == 1 << 18 else d for d in defaults))


def whole(df):
    return df.toPandas().sort_values("date").reset_index(drop=True)


def single_windows(df) -> list[str]:
    """Windows of the plan that are not cut into buckets: one of their partitions holds a whole series."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if re.search(r"\bWindow \[", line) and "_bucket#" not in line]


def test_the_plan_check_sees_a_plain_window(series):
    assert single_windows(series.withColumn("x", F.lag("value").over(Window.orderBy("date"))))


OPERATORS = {
    "F2": lambda s: S.daily_series(s, "date", "value", min_points=4),
    "F3": lambda s: S.resample_mean(s, "D"),
    "F14": lambda s: S.trend_series(s, 7),
    "F16": lambda s: S.mean_pct_change(s),
    "H5": lambda s: forecast.future_index(s, 3),
    "I3": lambda s: diagnostics.acf(s),
    "F6": lambda s: S.rolling_stats(s, 7),
    "F9": lambda s: S.recent_change(s),
    "G1": lambda s: anomaly.rolling_zscore(s),
    "H1": lambda s: forecast.forecast(s, 3),
    "H4": lambda s: forecast.forecast_linear(s, 3),
    "I1": lambda s: diagnostics.trend_test(s),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_no_window_holds_a_whole_series(series, name):
    assert single_windows(OPERATORS[name](series)) == []


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_series_equals_one_key(series, name):
    """The keyed path, in plain windows, is the yardstick."""
    keyed = series.withColumn("k", F.lit("a"))
    with_keys = {
        "F2": lambda s: S.daily_series(s, "date", "value", ["k"], min_points=4), "F3": lambda s: S.resample_mean(s, "D", ["k"]),
        "F14": lambda s: S.trend_series(s, 7, ["k"]), "F16": lambda s: S.mean_pct_change(s, keys=["k"]),
        "H5": lambda s: forecast.future_index(s, 3, ["k"]), "I3": lambda s: diagnostics.acf(s, ["k"]),
        "F6": lambda s: S.rolling_stats(s, 7, keys=["k"]), "F9": lambda s: S.recent_change(s, keys=["k"]),
        "G1": lambda s: anomaly.rolling_zscore(s, keys=["k"]), "H1": lambda s: forecast.forecast(s, 3, keys=["k"]),
        "H4": lambda s: forecast.forecast_linear(s, 3, ["k"]), "I1": lambda s: diagnostics.trend_test(s, ["k"]),
    }
    got, want = OPERATORS[name](series).toPandas(), with_keys[name](keyed).drop("k").toPandas()
    first = [c for c in ("date", "step") if c in got] or list(got.columns)
    got, want = (d[sorted(d.columns)].sort_values(first).reset_index(drop=True) for d in (got, want))
    pd.testing.assert_frame_equal(got, want, rtol=1e-9, check_dtype=False)


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_row_index_in_any_number_of_ranges(series, points, ranges):
    got = order.with_row_index(series, ["date"], buckets=ranges, running={"high": F.col("value") > 100}).toPandas().sort_values("idx")
    assert got["idx"].tolist() == list(range(POINTS))
    assert got["date"].tolist() == sorted(points["date"])
    high = (points.sort_values("date")["value"] > 100).to_numpy()
    assert got["high"].tolist() == (np.cumsum(high) - high).tolist()


def test_lags_cross_buckets(series, points):
    got = whole(order.earlier(series, [], {"a": ("value", 1), "b": ("value", 63)}))
    want = points.sort_values("date").reset_index(drop=True)["value"]
    assert got["a"].fillna(-1).tolist() == want.shift(1).fillna(-1).tolist()
    assert got["b"].fillna(-1).tolist() == want.shift(63).fillna(-1).tolist()


def test_too_few_points_give_no_rows(series):
    few = series.limit(3)
    assert S.daily_series(few, "date", "value", min_points=4).count() == 0
    assert S.resample_mean(few, "D").count() == 0 and S.trend_series(few).count() == 0
    assert S.mean_pct_change(few).first()["mean_pct_change"] is None
    nothing = series.limit(0)
    assert diagnostics.acf(nothing).first()["lag1_acf"] is None and forecast.future_index(nothing, 2).where("date IS NOT NULL").count() == 0


# ---------------------------------------------------------------- exact quantiles

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.95, 1.0]


def numbers():
    rng = np.random.default_rng(5)
    return {
        "spread": rng.normal(0, 1e6, 5000), "tied": np.repeat([3.0, 7.0, 7.5], [4000, 10, 3000]), "one": np.array([4.25]), "two": np.array([1.0, 2.0]),
        "tail": np.exp(rng.normal(0, 8, 3000)), "powers": 2.0 ** np.arange(-1000, 1000, 3), "edge": np.array([-1.7e308, 1.7e308, 0.0, 5e-324, -5e-324] * 3),
        None: rng.integers(0, 50, 900).astype(float),
    }


def test_quantiles_of_all_keys_equal_numpy(spark):
    data = numbers()
    rows = [(k, float(v)) for k, vs in data.items() for v in vs] + [("none", None), ("tied", None), ("none", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    got = {r["k"]: r for r in exact_quantiles(df, "v", PROBS, ["k"]).collect()}
    assert set(got) == set(data)
    for k, vs in data.items():
        assert got[k]["count"] == len(vs)
        for p, q in zip(PROBS, got[k]["quantiles"]):
            s = sorted(vs)
            at = (len(s) - 1) * p
            low, high = s[math.floor(at)], s[math.ceil(at)]
            assert q == pytest.approx(low + (high - low) * (at - math.floor(at)), rel=1e-12, abs=0), (k, p)


def test_quantiles_survive_a_wrong_sketch(spark, monkeypatch):
    """Brackets that miss the rank are replaced by the whole range."""
    from quarry.functions import quantiles

    monkeypatch.setattr(quantiles, "ACCURACY", 2)       # a very rough sketch
    monkeypatch.setattr(quantiles, "MARGIN", 1e-9)
    monkeypatch.setattr(quantiles, "BINS", 4)           # and many rounds
    vs = np.random.default_rng(1).gamma(0.3, 100, 2000)
    df = spark.createDataFrame([(float(v),) for v in vs], "v double").repartition(7)
    got = exact_quantiles(df, "v", PROBS).first()["quantiles"]
    assert got == pytest.approx(np.quantile(vs, PROBS).tolist(), rel=1e-12)


def test_quantiles_of_nothing_and_of_text(spark):
    df = spark.createDataFrame([(None,), ("x",)], "v string")
    assert exact_quantiles(df, "v", [0.5]).collect() == []
    assert df.select(exact_quantile(df, "v", 0.5).alias("q")).first()["q"] is None
    more = spark.createDataFrame([("1",), ("4",), ("x",)], "v string")
    assert more.select(exact_quantile(more, "v", 0.5).alias("q")).first()["q"] == 2.5
    stats = S.describe_numeric(df, "v").first()
    assert stats["count"] == 0 and stats["median"] is None
    by_key = S.describe_numeric(df.withColumn("k", F.lit(None).cast("string")), "v", ["k"]).collect()
    assert len(by_key) == 1 and by_key[0]["median"] is None


@pytest.mark.parametrize("way", ["exact", "buffered"])
def test_describe_numeric(spark, way):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 10.0), (None, 5.0), (None, 6.0)], "k string, v double")
    got = {r["k"]: r for r in S.describe_numeric(df, "v", ["k"], way).collect()}
    assert (got["a"]["p25"], got["a"]["median"], got["a"]["p75"], got["a"]["max"]) == (1.5, 2.0, 6.0, 10.0)
    assert (got[None]["p25"], got[None]["median"], got[None]["count"]) == (5.25, 5.5, 2)


def test_quantile_counts_never_sort_the_rows(spark):
    """Each row once met a copy of its key's brackets in a sort; the counts are hash-aggregated now, for a few hot keys too."""
    from quarry.functions import quantiles

    df = spark.range(20_000).select((F.col("id") % 2).alias("k"), (F.col("id") * 7919 % 20_011).cast("double").alias("v"))
    plans, kept = [], type(df).checkpoint

    def noted(self, *args, **kwargs):
        plans.append(self._jdf.queryExecution().executedPlan().toString())
        return kept(self, *args, **kwargs)

    type(df).checkpoint = noted
    try:
        got = {r["k"]: r["quantiles"] for r in quantiles.exact_quantiles(df, "v", [0.25, 0.95], ["k"]).collect()}
    finally:
        type(df).checkpoint = kept
    assert plans and not any("SortAggregate" in p or "SortMergeJoin" in p for p in plans[:3])
    values = {r["k"]: r["q"] for r in df.groupBy("k").agg(F.percentile("v", [0.25, 0.95]).alias("q")).collect()}
    assert got == values
