"""Distribution tails and the ADF search against printed tables, closed forms and plain least squares."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.functions.stats import adf_p_value, gamma_ratio_ln, normal_cdf, t_two_sided_p
from quarry.operators import diagnostics as D


def evaluated(spark, schema, rows, column):
    return [r["out"] for r in spark.createDataFrame(rows, schema).coalesce(1).withColumn("out", column).collect()]


def test_t_tails_agree_with_the_printed_table(spark):
    table = [(12.706, 1, 0.05), (4.303, 2, 0.05), (2.228, 10, 0.05), (3.169, 10, 0.01), (1.812, 10, 0.10), (2.042, 30, 0.05), (1.980, 120, 0.05)]
    got = evaluated(spark, "t double, df long", [(t, d) for t, d, _ in table], t_two_sided_p(F.col("t"), F.col("df")))
    assert got == pytest.approx([p for *_, p in table], rel=2e-3)


def test_t_tails_equal_the_closed_forms(spark):
    ts = [0.0, 1e-8, 0.3, 1.0, 2.5, 40.0, 1e6]
    one = evaluated(spark, "t double", [(t,) for t in ts], t_two_sided_p(F.col("t"), F.lit(1)))
    assert one == pytest.approx([2 / math.pi * math.atan2(1, t) for t in ts], rel=1e-12)
    two = evaluated(spark, "t double", [(t,) for t in ts], t_two_sided_p(F.col("t"), F.lit(2)))
    assert two == pytest.approx([1 - t / math.sqrt(2 + t * t) if t < 5 else 2 / (2 + t * t) / (1 + t / math.sqrt(2 + t * t)) for t in ts], rel=1e-11)
    # many degrees of freedom: the normal tail and its first correction
    for df, exact in ((1e6, 1e-9), (1e9, 1e-7)):
        for t in (0.5, 1.96, 4.0):
            got = evaluated(spark, "t double, df double", [(t, df)], t_two_sided_p(F.col("t"), F.col("df")))[0]
            normal, density = math.erfc(t / math.sqrt(2)), math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
            assert got == pytest.approx(normal + density * (t ** 3 + t) / (2 * df), rel=exact)


def test_t_tails_without_a_value(spark):
    rows = [(None, 5.0), (1.0, None), (1.0, 0.0), (1.0, -3.0), (float("nan"), 5.0), (float("inf"), 5.0), (-2.228, 10.0)]
    got = evaluated(spark, "t double, df double", rows, t_two_sided_p(F.col("t"), F.col("df")))
    assert got[:6] == [None] * 5 + [0.0] and got[6] == pytest.approx(0.05, rel=2e-3)


def test_gamma_ratio(spark):
    at = [0.5, 1.0, 1.5, 7.0, 60.5, 5e3, 1e9]
    got = evaluated(spark, "a double", [(a,) for a in at], gamma_ratio_ln(F.col("a")))
    assert got[:5] == pytest.approx([math.lgamma(a + 0.5) - math.lgamma(a) for a in at[:5]], rel=1e-12)
    assert got[5:] == pytest.approx([0.5 * math.log(a) - 1 / (8 * a) for a in at[5:]], rel=1e-12)


def test_normal_cdf(spark):
    zs = np.linspace(-12, 12, 193).tolist()
    got = evaluated(spark, "z double", [(z,) for z in zs], normal_cdf(F.col("z")))
    assert got == pytest.approx([0.5 * math.erfc(-z / math.sqrt(2)) for z in zs], rel=1e-12)


def test_adf_tails_agree_with_the_printed_critical_values(spark):
    got = evaluated(spark, "s double", [(-3.43,), (-2.86,), (-2.57,), (5.0,), (-30.0,), (None,), (float("nan"),)], adf_p_value(F.col("s")))
    assert got[:3] == pytest.approx([0.01, 0.05, 0.10], rel=0.03) and got[3:] == [1.0, 0.0, None, None]


def plain_adf(y):
    """(lag, observations, t statistic) by QR on scaled columns."""
    y = np.asarray(y, float) - np.mean(y)
    n, dy = len(y), np.diff(y)
    most = max(0, min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2))

    def fit(p, start):
        at = np.arange(start, n - 1)
        x = np.column_stack([y[at], *[dy[at - j] for j in range(1, p + 1)], np.ones(len(at))])
        x = x / np.abs(x).max(0)
        q, r = np.linalg.qr(x)
        beta = np.linalg.solve(r, q.T @ dy[at])
        left = dy[at] - x @ beta
        inverse = np.linalg.inv(r)
        return len(at), p + 2, left @ left, beta[0], (inverse @ inverse.T)[0, 0]

    def aic(p):
        rows, k, ssr, *_ = fit(p, most)
        return rows * (math.log(2 * math.pi) + math.log(ssr / rows) + 1) + 2 * k

    p = min(range(most + 1), key=lambda p: (aic(p), p))
    rows, k, ssr, slope, v = fit(p, p)
    return p, rows, slope / math.sqrt(ssr / (rows - k) * v)


@pytest.fixture(scope="module")
def made():
    rng = np.random.default_rng(3)
    out = {}
    for name, n, carry, scale, level in (("ar", 300, 0.5, 1, 0), ("walk", 300, 1.0, 1, 0), ("slow", 500, 0.97, 1e4, 5e5), ("short", 20, 0.4, 10, 3), ("odd", 57, 0.6, 1e-3, 1),
                                         ("null", 41, 0.2, 1, 1e6)):
        x = np.zeros(n)
        for t in range(1, n):
            x[t] = carry * x[t - 1] + rng.standard_normal() + (0.6 * (x[t - 1] - x[t - 2]) if name == "slow" and t > 1 else 0)
        out[None if name == "null" else name] = x * scale + level
    return out


def frame(spark, series):
    rows = [(k, d.to_pydatetime(), float(v)) for k, x in series.items() for d, v in zip(pd.date_range("2024-01-01", periods=len(x)), x)]
    return spark.createDataFrame(rows, "k string, date timestamp_ntz, value double").repartition(5)


def test_adf_of_all_keys_equals_least_squares(spark, made):
    got = {r["k"]: r for r in D.adf_test(frame(spark, made), ["k"]).collect()}
    assert set(got) == set(made)
    for k, x in made.items():
        lag, rows, stat = plain_adf(x)
        assert (got[k]["used_lag"], got[k]["nobs"], got[k]["n"]) == (lag, rows, len(x)), k
        assert got[k]["adf_stat"] == pytest.approx(stat, rel=1e-9), k
    assert got["ar"]["adf_p"] < 0.01 < got["walk"]["adf_p"] and any(r["used_lag"] > 0 for r in got.values())


def test_adf_of_one_series_and_of_odd_ones(spark, made):
    lag, rows, stat = plain_adf(made["slow"])
    one = D.adf_test(frame(spark, {"slow": made["slow"]}).drop("k")).collect()
    assert [(r["used_lag"], r["nobs"]) for r in one] == [(lag, rows)] and one[0]["adf_stat"] == pytest.approx(stat, rel=1e-9)
    odd = {"flat": np.full(30, 7.0), "few": np.arange(19.0), "ar": made["ar"]}
    got = {r["k"]: r for r in D.adf_test(frame(spark, odd), ["k"]).collect()}
    assert set(got) == {"flat", "ar"} and got["flat"]["adf_stat"] is None and got["flat"]["adf_p"] is None
    assert D.adf_test(frame(spark, {"few": np.arange(3.0)}), ["k"]).collect() == []
    assert D.adf_test(frame(spark, {"few": np.arange(3.0)}).drop("k")).collect() == []
    assert D.diagnostic_labels(frame(spark, odd), ["k"]).where("k = 'flat'").first()["labels"][0] == "no_significant_trend"


def test_statistics_run_no_python(spark, made):
    for df in (D.adf_test(frame(spark, made), ["k"]), D.trend_test(frame(spark, made), ["k"], with_p=True)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan
