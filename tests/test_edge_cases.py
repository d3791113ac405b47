"""One bad group, NULL keys, short series: defined results instead of errors or false labels."""

import pytest
from pyspark.sql import functions as F

from quarry.functions.order import with_row_index
from quarry.operators import anomaly as A
from quarry.operators import cuts, diagnostics, forecast, inventory
from quarry.operators import series as S
from quarry.operators._adf import max_lag
from quarry.sources import store


def rows_of(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("buckets", [1, 5, 200, None])
def test_row_index_with_null_keys_and_tied_prefixes(spark, buckets):
    df = rows_of(spark, [(None if i % 4 == 0 else f"k{i % 3}", 7, "same", i) for i in range(400)], "k string, a int, b string, c int")
    got = with_row_index(df.repartition(7), ["a", "b", "c"], keys=["k"], buckets=buckets, running={"even": F.col("c") % 2 == 0}).collect()
    assert len(got) == 400
    for key in (None, "k0", "k1", "k2"):
        part = sorted((r["c"], r["idx"], r["even"]) for r in got if r["k"] == key)
        assert [i for _, i, _ in part] == list(range(len(part)))
        assert [e for *_, e in part] == [sum(c % 2 == 0 for c, *_ in part[:n]) for n in range(len(part))]


def test_row_index_of_nothing(spark):
    df = rows_of(spark, [], "k string, a int")
    assert with_row_index(df, ["a"], keys=["k"]).count() == 0


def test_stock_statistics_without_stock(spark):
    df = rows_of(spark, [("a", None, 1.0), ("b", 2.0, 4.0)], "g string, stock double, sales double")
    got = {r["g"]: r for r in inventory.stock_to_sales(df, keys=["g"]).collect()}
    assert (got["a"]["avg_stock"], got["a"]["stockout_risk_pct"], got["a"]["stock_to_sales_ratio"]) == (0.0, 0.0, None)
    assert got["b"]["stock_to_sales_ratio"] == 0.5
    labels = inventory.ops_labels(df.withColumns({"production": F.lit(1.0), "defect": F.lit(0.0)}), keys=["g"]).collect()
    assert {r["g"]: r["stockout_label"] for r in labels} == {"a": "low", "b": "low"}


def test_stock_cover_with_sales_of_minus_one(spark):
    df = rows_of(spark, [("a", 5.0, -1.0), ("a", 1.0, 1.0), ("a", 0.0, -1.0)], "g string, stock double, sales double")
    bands = {r["band"]: r["rows"] for r in inventory.stock_bands(df, keys=["g"]).collect()}
    assert bands == {"excess": 1, "low": 1, None: 1}
    share = inventory.stock_risk_share(df, keys=["g"]).first()
    assert share["excess"] == 1 and share["avg_stock_ratio"] == 0.5


def test_anomaly_summary_of_nothing(spark):
    scored = rows_of(spark, [], "date timestamp_ntz, is_anomaly boolean, anomaly_type string")
    r = A.anomaly_summary(scored).first()
    assert (r["points"], r["anomaly_ratio"], r["risk_level"]) == (0, 0.0, "low")


def test_group_zscore_keeps_null_keys(spark):
    df = rows_of(spark, [(None, 1.0), (None, 3.0), ("a", 2.0)], "k string, v double")
    assert A.group_zscore(df, "v", ["k"]).count() == 3


def test_rolling_zscore_needs_raw_rows(spark):
    raw = rows_of(spark, [("a", i, 1.0) for i in range(8)] + [("b", i, 1.0) for i in range(3)], "k string, date int, value double")
    out = A.rolling_zscore(raw, window=3, keys=["k"], raw=raw)
    assert {r["k"] for r in out.collect()} == {"a"}


def test_series_mean_needs_four_points(spark):
    s = rows_of(spark, [("a", d, 1.0) for d in range(4)] + [("b", 0, 1.0)], "k string, date int, value double")
    assert {r["k"] for r in S.resample_mean(s, None, ["k"]).collect()} == {"a"}


def test_backtest_of_a_short_series_has_no_verdict(spark):
    df = rows_of(spark, [(i, float(i)) for i in range(10)], "i int, v double")
    assert forecast.backtest_metrics(forecast.backtest_series(df, "v", ["i"])).count() == 0


def test_constant_series_has_no_trend(spark):
    s = spark.range(25).select(F.expr("timestamp_ntz '2024-01-01' + make_interval(0,0,0,int(id))").alias("date"), F.lit(3.0).alias("value"))
    r = diagnostics.trend_test(s, with_p=True).first()
    assert (r["r2"], r["t_stat"]) == (0.0, 0.0) and r["trend_p"] == pytest.approx(1.0)


def test_adf_lag_leaves_degrees_of_freedom(spark):
    df = rows_of(spark, [(20, 8), (21, 8), (25, 9), (200, 15), (3, 0), (1, 0)], "n long, most int")
    assert df.where(max_lag(F.col("n")) != F.col("most")).count() == 0


def test_pivot_and_distinct_values_are_complete(spark):
    df = rows_of(spark, [("a", f"x{i}", 1.0) for i in range(80)], "r string, c string, sales double")
    assert len(cuts.pivot_sum(df, "r", "c").columns) == 81
    got = cuts.distinct_values(df, "c")
    assert got.count() == 80 and not got.first()["selectable"]


def test_payload_containment(spark):
    docs = ['{"city": "K\\u00f6ln", "tags": ["a", "b"], "a.b": 1, "n": {"x": 2, "y": "q\'s"}}', '{"city": "Bonn"}', "not json", None]
    points = rows_of(spark, [("d", i, p) for i, p in enumerate(docs)], "dataset_id string, row_index int, payload string")
    hit = lambda obj: [r["row_index"] for r in store.payload_contains(points, obj).orderBy("row_index").collect()]
    assert hit({"city": "Köln"}) == [0] and hit({"tags": ["a"]}) == [0] and hit({"tags": ["c"]}) == []
    assert hit({"a.b": 1.0}) == [0] and hit({"n": {"x": 2}}) == [0] and hit({"n": {"y": "q's"}}) == [0] and hit({}) == [0, 1]
    timed = points.withColumn("timestamp", F.lit(None).cast("timestamp_ntz"))
    assert [r["row_index"] for r in store.payload_field_equals(timed, "d", "a.b", 1).collect()] == [0]


def test_exact_quantile(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    for values in (rng.normal(size=3000), rng.integers(0, 5, 1000).astype(float), np.array([3.0]), np.array([1.0, 2.0])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
        for q in (0.0, 0.05, 0.5, 0.95, 1.0):
            got = df.limit(1).select(inventory.exact_quantile(df, "v", q).alias("q")).first()["q"]
            assert got == pytest.approx(np.quantile(values, q)), (len(values), q)


@pytest.mark.parametrize("dates, following", [
    (["2023-01-01", "2023-04-01", "2023-07-01", "2023-10-01"], ["2024-01-01", "2024-04-01"]),
    (["2021-12-31", "2022-12-31", "2023-12-31"], ["2024-12-31", "2025-12-31"]),
    (["2023-11-30", "2023-12-31", "2024-01-31"], ["2024-02-29", "2024-03-31"]),
    (["2024-01-01", "2024-01-02", "2024-01-03"], ["2024-01-04", "2024-01-05"]),
])
def test_future_dates_follow_the_calendar(spark, dates, following):
    s = rows_of(spark, [(d, 1.0) for d in dates], "d string, value double").select(F.to_timestamp_ntz("d").alias("date"), "value")
    assert [str(r["date"])[:10] for r in forecast.future_index(s, 2).orderBy("step").collect()] == following


def test_one_series_finer_than_days_needs_no_single_task(spark):
    s = spark.range(300).select(F.expr("timestamp_ntz '2024-01-01' + make_interval(0,0,0,0,0,0,id*7)").alias("date"), (F.col("id") % 11).cast("double").alias("value"))
    got = {r["date"]: r["rolling_mean"] for r in S.rolling_stats(s, 7).collect()}
    values = [r["value"] for r in s.orderBy("date").collect()]
    want = [sum(values[max(0, i - 6): i + 1]) / len(values[max(0, i - 6): i + 1]) for i in range(300)]
    assert [got[k] for k in sorted(got)] == pytest.approx(want)
    flat = S.recent_change(s, "lookback14").first()
    assert flat["n"] == 300 and flat["recent_mean"] == pytest.approx(sum(values[-14:]) / 14)


def test_inventory_case_takes_aliases_dates_and_optional_columns(spark):
    df = rows_of(spark, [("03/01/2024", "r", "p", 2.0, 1.0, 20.5, 1), ("soon", "r", "p", 2.0, 1.0, 20.5, 1)],
                 "day string, region string, product string, sales double, stock double, temperature double, promo_run int")
    out = inventory.inventory_case(df, ["date"], with_score=False, aliases={"day": "date", "promo_run": "campaign"}).collect()
    assert [(str(r["date"])[:10], r["temperature"], r["campaign"], r["stock_status"]) for r in out] == [("2024-03-01", 20.5, 1, "stockout_risk")]
