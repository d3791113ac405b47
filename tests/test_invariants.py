"""Invariants: ordering helpers, transport methods, forecasts, plans."""

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions.order import rolling, with_row_index
from quarry.operators import diagnostics as D
from quarry.operators import forecast as H
from quarry.operators import series as S
from quarry.operators import transport as M
from quarry.plans.views import SALES_ORDER, sales_fact
from tests.conftest import SMALL


def test_row_index_is_dense_and_partition_independent(spark):
    df = sales_fact(spark, SMALL).select(*SALES_ORDER, "region", "sales")
    cols = [*SALES_ORDER, "region", "idx"]
    a = with_row_index(df.repartition(1), SALES_ORDER, keys=["region"]).select(*cols)
    b = with_row_index(df.repartition(7), SALES_ORDER, keys=["region"], buckets=5).select(*cols)
    pa, pb = a.toPandas().sort_values(SALES_ORDER), b.toPandas().sort_values(SALES_ORDER)
    assert pa["idx"].tolist() == pb["idx"].tolist()
    per = pa.groupby("region")["idx"].agg(["min", "max", "count"])
    assert (per["min"] == 0).all() and (per["max"] == per["count"] - 1).all()
    w = Window.partitionBy("region").orderBy(*SALES_ORDER)
    ref = df.withColumn("ref", F.row_number().over(w) - 1).select(*SALES_ORDER, "ref").toPandas()
    m = pa.merge(ref, on=SALES_ORDER)
    assert len(m) == len(pa)
    assert (m["idx"] == m["ref"]).all()


def test_halo_rolling_equals_plain_window(spark):
    df = sales_fact(spark, SMALL).select(*SALES_ORDER, "product", "sales")
    idx = with_row_index(df, SALES_ORDER, keys=["product"], idx="i")
    got = rolling(idx, ["product"], "i", 7, lambda w: {"m": F.avg("sales").over(w)}, bucket_rows=16)
    w = Window.partitionBy("product").orderBy("i").rowsBetween(-6, 0)
    want = idx.withColumn("m2", F.avg("sales").over(w))
    j = got.join(want.select("product", "i", "m2"), ["product", "i"]).toPandas()
    assert len(j) == df.count()
    assert (j["m"] - j["m2"]).abs().max() < 1e-9


def test_northwest_default_problem(spark):
    supply = spark.createDataFrame([("p", "s1", 120), ("p", "s2", 80), ("p", "s3", 100)], "problem string, src string, qty bigint")
    demand = spark.createDataFrame([("p", "d1", 70), ("p", "d2", 90), ("p", "d3", 60), ("p", "d4", 80)], "problem string, dst string, qty bigint")
    costs = [[8, 6, 10, 9], [9, 12, 13, 7], [14, 9, 16, 5]]
    cost = spark.createDataFrame([("p", f"s{i + 1}", f"d{j + 1}", costs[i][j]) for i in range(3) for j in range(4)],
                                 "problem string, src string, dst string, unit_cost bigint")
    s, d, c = M.balance(supply, demand, cost)
    nw = M.northwest_corner(s, d)
    alloc = {(r["src"], r["dst"]): r["qty"] for r in nw.collect()}
    assert alloc == {("s1", "d1"): 70, ("s1", "d2"): 50, ("s2", "d2"): 40, ("s2", "d3"): 40, ("s3", "d3"): 20, ("s3", "d4"): 80}
    assert M.allocation_cost(nw, c).first()["total_cost"] == 2580
    for method in ("least_cost", "vogel"):
        a = M.greedy_allocation(s, d, c, method).toPandas()
        assert a.groupby("src")["qty"].sum().to_dict() == {"s1": 120, "s2": 80, "s3": 100}
        assert a.groupby("dst")["qty"].sum().to_dict() == {"d1": 70, "d2": 90, "d3": 60, "d4": 80}
        assert (a["qty"] >= 0).all()
        total = M.allocation_cost(M.greedy_allocation(s, d, c, method), c).first()["total_cost"]
        assert total <= 2580
    comp = M.compare_methods(supply, demand, cost).toPandas()
    assert comp["best_cost"].iloc[0] == comp["total_cost"].min()


def test_unbalanced_gets_dummy(spark):
    supply = spark.createDataFrame([("p", "a", 10)], "problem string, src string, qty bigint")
    demand = spark.createDataFrame([("p", "x", 4), ("p", "y", 3)], "problem string, dst string, qty bigint")
    cost = spark.createDataFrame([("p", "a", "x", 1), ("p", "a", "y", 2)], "problem string, src string, dst string, unit_cost bigint")
    s, d, c = M.balance(supply, demand, cost)
    assert sorted((r["dst"], r["qty"]) for r in d.collect()) == [("x", 4), ("y", 3), ("~dummy", 3)]
    assert c.where(F.col("dst") == "~dummy").first()["unit_cost"] == 0


def _series(spark, values, start="2024-01-01"):
    dates = pd.date_range(start, periods=len(values), freq="D")
    return spark.createDataFrame(pd.DataFrame({"date": dates, "value": [float(v) for v in values]}))


def test_ses_closed_form_equals_fold(spark):
    vals = [5, 7, 3, 9, 11, 4, 6, 8]
    level = vals[0]
    for x in vals[1:]:
        level = 0.3 * x + 0.7 * level
    fc = H.forecast(_series(spark, vals), 3, "exponential_smoothing").toPandas()
    assert fc["forecast"].tolist() == pytest.approx([level] * 3)
    assert str(fc["date"].iloc[0])[:10] == "2024-01-09"


def test_business_day_future_index(spark):
    dates = pd.bdate_range("2024-01-03", periods=30)
    s = spark.createDataFrame(pd.DataFrame({"date": dates, "value": range(30)}).astype({"value": float}))
    fut = H.future_index(s, 3).toPandas()
    assert [str(d)[:10] for d in fut["date"]] == ["2024-02-14", "2024-02-15", "2024-02-16"]


def test_recent_change_rules(spark):
    s = _series(spark, [1, 1, 1, 1, 2, 2, 2, 2])
    r = S.recent_change(s, "window7").first()
    assert r["pct_change"] == pytest.approx(100.0)
    short = S.recent_change(_series(spark, [1, 2, 3]), "window7").first()
    assert short["pct_change"] == 0.0


def test_resample_totals_match(spark):
    df = sales_fact(spark, SMALL)
    ds = S.daily_series(df)
    total = ds.agg(F.sum("value")).first()[0]
    for freq in ("D", "W", "M"):
        assert S.resample_sum(ds, freq).agg(F.sum("value")).first()[0] == pytest.approx(total)


def test_adf_separates_stationary_from_random_walk(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    e = rng.standard_normal((2, 300))
    ar, rw = np.zeros(300), np.zeros(300)
    for t in range(1, 300):
        ar[t] = 0.5 * ar[t - 1] + e[0, t]
        rw[t] = rw[t - 1] + e[1, t]
    out = {}
    for name, x in (("ar", ar), ("rw", rw)):
        out[name] = D.adf_test(_series(spark, x)).first()
    assert out["ar"]["adf_p"] < 0.01 < out["rw"]["adf_p"]
    # stat equals an ordinary least-squares t for the chosen lag
    lag = out["ar"]["used_lag"]
    y = ar
    dy = np.diff(y)
    rows = range(lag, len(dy))
    X = np.array([[y[t], *[dy[t - j] for j in range(1, lag + 1)], 1.0] for t in rows])
    Y = np.array([dy[t] for t in rows])
    beta, res, *_ = np.linalg.lstsq(X, Y, rcond=None)
    resid = Y - X @ beta
    se = np.sqrt(resid @ resid / (len(Y) - X.shape[1]) * np.linalg.inv(X.T @ X)[0, 0])
    assert out["ar"]["adf_stat"] == pytest.approx(beta[0] / se, rel=1e-6)


def test_plans_have_no_cartesian_and_push_filters(spark):
    from quarry.plans import catalog

    catalog.load_all()
    qs = catalog.QUERIES
    for name in sorted(qs):  # every registered query
        plan = qs[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
    # summaries of the case read the fact once
    for name in ("risk_table", "inventory_kpis", "top_risk"):
        plan = qs[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("lineitem.parquet") == 1, name
    plan = qs["time_range_query"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters:" in plan and "EqualTo(event_type,click)" in plan and "TakeOrderedAndProject" in plan
