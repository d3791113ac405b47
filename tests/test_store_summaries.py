"""Summaries stored with every batch of points."""

import os
import tempfile

from pyspark.sql import functions as F

from quarry.sources import store


def _records(spark, low, high):
    return spark.range(low, high).select(
        F.col("id").alias("row_index"), F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("timestamp"),
        F.lit("{}").alias("payload"), (F.col("id") % 4 != 0).alias("is_valid"))


def _from_points(spark, path):
    points = store.read_points(spark, path)
    return points.groupBy("dataset_id").agg(F.count(F.lit(1)), F.min("timestamp"), F.max("timestamp"), F.count_if(~F.col("is_valid"))).collect()


def test_summaries_follow_the_batches(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="quarry-sums-"), "points")
    store.write_points(_records(spark, 0, 10), path, "a", batch=0)
    store.write_points(_records(spark, 10, 30), path, "a", batch=1)
    store.write_points(_records(spark, 0, 7), path, "b", batch=0)
    store.write_points(_records(spark, 10, 50), path, "a", batch=1)       # a second attempt with more rows
    store.write_points(_records(spark, 0, 0), path, "a", batch=2)         # nothing to store
    got = store.stored_summaries(spark, path)
    assert sorted(tuple(r)[:5] for r in got.collect()) == sorted(tuple(r) for r in _from_points(spark, path))
    assert {r["dataset_id"]: r["batches"] for r in got.collect()} == {"a": 2, "b": 1}
    assert store.read_points(spark, path).count() == 57                   # summaries are no points
    assert all("/_summary/" in f for f in got.inputFiles())               # and reading them reads no point


def test_summaries_move_with_published_points(spark):
    base = tempfile.mkdtemp(prefix="quarry-sums-")
    path = os.path.join(base, "points")
    store.write_points(_records(spark, 0, 10), path, "a")
    store.write_points(_records(spark, 0, 3), os.path.join(path, "_staging-a"), "a")
    assert store.stored_summaries(spark, path).first()["point_count"] == 10       # what is staged does not count yet
    store.publish_points(spark, os.path.join(path, "_staging-a"), path, "a")
    assert store.stored_summaries(spark, path).first()["point_count"] == 3


def test_summary_of_datasets_from_batches_equals_that_from_points(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="quarry-sums-"), "points")
    for batch in range(3):
        store.write_points(_records(spark, batch * 5, batch * 5 + 4), path, "a", batch=batch)
    datasets = spark.createDataFrame([("a",), ("none",)], "id string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    from_batches = store.dataset_summary(datasets, summaries=store.stored_summaries(spark, path))
    assert rows(from_batches) == rows(store.dataset_summary(datasets, store.read_points(spark, path)))


def test_a_stopped_attempt_leaves_no_summary_of_other_points(spark, monkeypatch):
    path = os.path.join(tempfile.mkdtemp(prefix="quarry-sums-"), "points")
    store.write_points(_records(spark, 0, 10), path, "a", batch=0)
    store.write_points(_records(spark, 10, 12), path, "a", batch=1)
    with monkeypatch.context() as m:
        m.setattr(store, "_write_summary", lambda *_: None)               # stopped after the points
        store.write_points(_records(spark, 0, 5), path, "a", batch=0)
    assert store.stored_summaries(spark, path).first()["point_count"] == 2
    store.write_points(_records(spark, 0, 5), path, "a", batch=0)         # the repeated attempt mends it
    assert store.stored_summaries(spark, path).first()["point_count"] == 7
