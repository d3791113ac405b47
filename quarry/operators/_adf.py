"""Augmented Dickey-Fuller regressions of all lag orders from one aggregation per series.

With z = (1, y[i-1], dy[i-1], ..., dy[i-m], dy[i]) every regression of the lag
search is solved from the cross products of z over the points m+1..n-1.  Those
of two lagged differences depend on their distance but for the ends of the
series, so 3 m + 5 sums and the first and last m differences of a key determine
the whole matrix.  Eliminating 1, y[i-1] and the differences one by one leaves
in the last corner the squared residuals of each lag order in turn.  The chosen
order is solved again on its own, longer sample: the same sums plus a few first
points.

Everything is built-in expressions over one row per key; no series is gathered.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST_SSR = 1e-300


def max_lag(n: Column) -> Column:
    """Largest lag searched: 12 (n / 100)^(1/4), at most n // 2 - 2 so that the regression keeps its degrees of freedom."""
    wide = F.ceil(12.0 * F.pow(n / 100.0, F.lit(0.25)))
    return F.greatest(F.lit(0), F.least(wide, F.floor(n / 2) - 2)).cast("int")


def _upto(last: Column) -> Column:
    """0, 1, ..., last (nothing below 0)."""
    return F.when(last >= 0, F.sequence(F.lit(0), last.cast("int"))).otherwise(F.array().cast("array<int>"))


def _eliminate(matrix: Column, steps: Column, corner: Callable[[Column], Column]) -> Column:
    """Gaussian elimination of the first ``steps`` rows of a symmetric matrix: struct(m, found), ``found`` holding
    ``corner(m)`` after each step.  A pivot of zero (a column that adds nothing) is passed over."""
    def step(state: Column, k: Column) -> Column:
        m = state["m"]
        pivot = m[k]

        def row(r: Column, i: Column) -> Column:
            share = F.coalesce(F.try_divide(r[k], pivot[k]), F.lit(0.0))
            return F.when(i <= k, r).otherwise(F.zip_with(r, pivot, lambda x, y: x - share * y))

        after = F.transform(m, row)
        return F.struct(after.alias("m"), F.concat(state["found"], F.array(corner(after))).alias("found"))

    start = F.struct(matrix.cast("array<array<double>>").alias("m"), F.array().cast("array<double>").alias("found"))
    return F.aggregate(_upto(steps - 1), start, step)


def sums(m: Column, lags: int) -> list[Column]:
    """Aggregates over the points of a key: columns ``_i`` (place), ``_lev`` (y before, centred) and ``_d0``.. ``_d<lags>``.

    ``m`` is the key's own largest lag; lags beyond it are summed but never read.
    """
    common = F.col("_i") > m
    total = lambda x: F.sum(F.when(common, x))
    d = [F.col(f"_d{j}") for j in range(lags + 1)]
    edge = lambda near, place: F.transform(F.array_sort(F.collect_list(F.when(near, F.struct(place.alias("at"), F.col("_d0").alias("d"), F.col("_lev").alias("lev"))))),
                                           lambda e: F.struct(e["d"].alias("d"), e["lev"].alias("lev")))
    return [
        total(F.lit(1.0)).alias("_n0"), total(F.col("_lev")).alias("_s1"), total(F.col("_lev") * F.col("_lev")).alias("_s2"),
        F.array(*[total(x) for x in d]).alias("_a"), F.array(*[total(F.col("_lev") * x) for x in d]).alias("_b"),
        F.array(*[total(d[0] * x) for x in d]).alias("_c"),
        edge((F.col("_i") >= 1) & (F.col("_i") <= m), F.col("_i")).alias("_head"),                    # points 1..m
        edge((F.col("_i") >= 1) & (F.col("_n") - F.col("_i") <= m), F.col("_n") - F.col("_i")).alias("_tail"),   # points n-1, n-2, ..
    ]


def lag_products(m: Column) -> Column:
    """(m + 1) x (m + 1) cross products of the differences 0..m points back over the points m+1..n-1."""
    head, tail = F.col("_head"), F.col("_tail")

    def cell(j: Column, k: Column) -> Column:
        near, apart = F.least(j, k), F.abs(j - k)

        def shift(acc: Column, q: Column) -> Column:      # one point further back: one product enters, one leaves
            return F.when(q == 0, acc).otherwise(
                acc + F.get(head, m - q)["d"] * F.get(head, m - q - apart)["d"] - F.get(tail, q - 1)["d"] * F.get(tail, q + apart - 1)["d"])

        return F.aggregate(_upto(near), F.get(F.col("_c"), apart), shift)

    return F.transform(_upto(m), lambda j: F.transform(_upto(m), lambda k: cell(j, k)))


def best_lag(m: Column) -> Column:
    """Lag order with the least AIC on the common sample (the smaller one of equal ones)."""
    n, s, a, b = F.col("_n0"), F.col("_s"), F.col("_a"), F.col("_b")
    back = lambda x: F.concat(F.slice(x, 2, m), F.slice(x, 1, 1))  # noqa: E731  lags 1..m, then the difference itself
    rows = F.concat(
        F.array(F.concat(F.array(n, F.col("_s1")), back(a))), F.array(F.concat(F.array(F.col("_s1"), F.col("_s2")), back(b))),
        F.transform(F.concat(F.when(m >= 1, F.sequence(F.lit(1), F.greatest(m, F.lit(1)))).otherwise(F.array().cast("array<int>")), F.array(F.lit(0))),
                    lambda j: F.concat(F.array(F.get(a, j), F.get(b, j)), back(F.get(s, j)))))
    found = _eliminate(rows, m + 2, lambda x: F.element_at(F.element_at(x, -1), -1))["found"]
    aic = F.transform(F.slice(found, 2, m + 1), lambda ssr, p: F.struct(
        (n * (math.log(2 * math.pi) + F.ln(F.greatest(ssr, F.lit(LEAST_SSR)) / n) + 1) + 2.0 * (p + 2)).alias("aic"), p.alias("p")))
    return F.array_min(aic)["p"]


def statistic(m: Column, p: Column) -> Column:
    """t statistic of y[i-1] with ``p`` lagged differences, on the points p+1..n-1; NULL where it has no variance."""
    head, s = F.col("_head"), F.col("_s")
    extra = F.filter(_upto(m), lambda i: i > p)                       # points before the common sample
    diff = lambda i, j: F.get(head, i - j - 1)["d"]  # noqa: E731     dy[i - j]
    lev = lambda i: F.get(head, i - 1)["lev"]
    more = lambda start, term: F.aggregate(extra, start, lambda acc, i: acc + term(i))
    a = F.transform(_upto(p), lambda j: more(F.get(F.col("_a"), j), lambda i: diff(i, j)))
    b = F.transform(_upto(p), lambda j: more(F.get(F.col("_b"), j), lambda i: diff(i, j) * lev(i)))
    n, s1, s2 = more(F.col("_n0"), lambda i: F.lit(1.0)), more(F.col("_s1"), lev), more(F.col("_s2"), lambda i: lev(i) * lev(i))
    lags = F.transform(_upto(p), lambda j: F.transform(_upto(p), lambda k: more(F.get(F.get(s, j), k), lambda i: diff(i, j) * diff(i, k))))
    parts = F.struct(n.alias("n"), s1.alias("s1"), s2.alias("s2"), a.alias("a"), b.alias("b"), lags.alias("s"))

    def solve(x: Column) -> Column:
        # order: 1, lags 1..p, y[i-1], dy[i]
        row = lambda first, mid, last: F.concat(F.array(first), F.slice(mid, 2, p), F.array(last), F.slice(mid, 1, 1))
        at = F.concat(F.when(p >= 1, F.sequence(F.lit(1), F.greatest(p, F.lit(1)))).otherwise(F.array().cast("array<int>")))
        body = lambda j: row(F.get(x["a"], j), F.get(x["s"], j), F.get(x["b"], j))
        matrix = F.concat(F.array(row(x["n"], x["a"], x["s1"])), F.transform(at, body), F.array(row(x["s1"], x["b"], x["s2"])), F.array(body(F.lit(0))))
        left = _eliminate(matrix, p + 1, lambda m: F.lit(0.0))["m"]
        yy, ydy, dd = left[p + 1][p + 1], left[p + 1][p + 2], left[p + 2][p + 2]
        slope = F.try_divide(ydy, yy)
        variance = F.try_divide(F.try_divide(dd - slope * ydy, x["n"] - (p + 2)), yy)
        return F.when(variance > 0, slope / F.sqrt(variance))

    return F.transform(F.array(parts), solve)[0]
