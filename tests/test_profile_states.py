"""Profiles united from stored states of batches."""

import os
import tempfile

from pyspark.sql import functions as F

from quarry.operators import profile as B
from quarry.plans.views import raw_orders
from quarry.sources.ingest import ingest, stored_profile
from tests.conftest import SMALL

LEFT_OUT = ("unique_count", "unique_ratio", "sample_values")


def _by_column(df):
    return {r["column"]: {k: v for k, v in r.asDict().items() if k not in LEFT_OUT} for r in df.collect()}


def test_united_states_equal_the_profile_of_all_rows(spark):
    rows = raw_orders(spark, SMALL)
    states = None
    for k in range(3):
        own = rows.where(F.pmod(F.xxhash64(*rows.columns), F.lit(3)) == k)
        state = B.column_state(own).withColumn("batch", F.lit(k))
        states = state if states is None else states.unionByName(state)
    united = B.profile_of_state(B.unite_states(states))
    assert _by_column(united) == _by_column(B.profile_columns(rows, with_distinct=False))
    exact = {r["column"]: r["unique_count"] for r in B.profile_columns(rows).collect()}
    for r in united.collect():
        assert abs(r["unique_count"] - exact[r["column"]]) <= max(1, 0.05 * exact[r["column"]])


def test_batches_with_other_columns(spark):
    a = spark.createDataFrame([("1", "x"), ("2", None)], "n string, t string")
    b = spark.createDataFrame([("3", True)], "n string, flag boolean")
    empty = spark.createDataFrame([], "n string")
    states = None
    for k, df in enumerate((a, b, empty)):
        state = B.column_state(df).withColumn("batch", F.lit(k))
        states = state if states is None else states.unionByName(state)
    got = {r["column"]: r for r in B.profile_of_state(B.unite_states(states)).collect()}
    assert {c: (r["total_count"], r["non_null"], r["unique_count"]) for c, r in got.items()} == {"n": (3, 3, 3), "t": (3, 1, 1), "flag": (3, 1, 1)}
    assert got["n"]["inferred_type"] == "numeric" and got["flag"]["inferred_type"] == "boolean"


def test_a_second_ingest_updates_the_profile_without_the_first_files(spark):
    d = tempfile.mkdtemp(prefix="quarry-states-")
    files = []
    for name, low in (("one", 0), ("two", 100)):
        path = os.path.join(d, f"{name}.csv")
        with open(path, "w") as f:
            f.write("id,day\n" + "".join(f"{low + k},2024-01-{1 + k % 28:02d}\n" for k in range(50)))
        files.append(path)
        ingest(spark, [path], os.path.join(d, "points"), os.path.join(d, "registry"), dataset_id=name)
        os.remove(path)                                           # gone: only its state is left
    got = {r["column"]: r for r in stored_profile(spark, os.path.join(d, "registry_reports")).collect()}
    assert got["id"]["total_count"] == 100 and got["id"]["numeric_ratio"] == 1.0 and abs(got["id"]["unique_count"] - 100) <= 3
    assert got["day"]["datetime_ratio"] == 1.0 and abs(got["day"]["unique_count"] - 28) <= 1
