"""Stored data points and the dataset registry.

Layout: ``data_points`` is Parquet partitioned by ``dataset_id`` and ``batch`` with columns
``(row_index, timestamp, payload JSON text, is_valid, created_at)``; queries on
one dataset prune to its partition and push the time bounds into the Parquet
scan.  The registry is an append-only status log; the current state of a
dataset is its latest log row.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.common import group

# Columns of stored points and of the registry, and what counts as numeric text.
POINT_COLUMNS = ("dataset_id", "row_index", "timestamp", "payload", "is_valid", "created_at")
REGISTRY_COLUMNS = ("id", "name", "source_type", "source_path", "row_count", "datetime_column",
                    "status", "error_message", "created_at", "updated_at")
NUMERIC_TEXT = r"^-?[0-9]+(\.[0-9]+)?$"


# ---------------------------------------------------------------- A5
def write_points(records: DataFrame, path: str, dataset_id: str, batch: int = 0) -> None:
    """A5: store records ``(row_index, timestamp, payload, is_valid)`` as one batch of ``dataset_id``.

    A batch replaces what an earlier attempt at the same batch wrote (dynamic
    partition overwrite), so a repeated write never duplicates rows.  The
    batch's counts and time range are stored beside it (``stored_summaries``).
    """
    spark = records.sparkSession
    drop_folder(spark, _summary_folder(path, dataset_id, batch))      # none rather than one of other points, should this attempt stop
    out = records.select(
        F.lit(dataset_id).alias("dataset_id"), F.lit(int(batch)).cast("bigint").alias("batch"), F.col("row_index").cast("bigint"), F.col("timestamp").cast("timestamp_ntz"),
        F.col("payload").cast("string"), F.col("is_valid").cast("boolean"),
        F.current_timestamp().cast("timestamp_ntz").alias("created_at"),
    )
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset_id", "batch").parquet(path)
    _write_summary(spark, path, dataset_id, batch)


def _summary_folder(path: str, dataset_id: str, batch: int) -> str:
    return f"{path}/dataset_id={dataset_id}/_summary/{int(batch)}"      # hidden from reads of the points, moved with them


def _point_aggregates() -> list[Column]:
    return [F.count(F.lit(1)).alias("point_count"), F.min("timestamp").alias("first_point"), F.max("timestamp").alias("last_point"),
            F.count_if(~F.col("is_valid")).alias("invalid_points")]


def _write_summary(spark: SparkSession, path: str, dataset_id: str, batch: int) -> None:
    """One row for a batch, from its stored points (two of their columns are read); a batch without points has none."""
    folder = f"{path}/dataset_id={dataset_id}/batch={int(batch)}"
    if not _exists(spark, folder):
        return
    row = spark.read.parquet(folder).agg(*_point_aggregates())
    row.select(F.lit(dataset_id).alias("dataset_id"), F.lit(int(batch)).cast("bigint").alias("batch"), "*").coalesce(1).write.mode("overwrite").parquet(
        _summary_folder(path, dataset_id, batch))


def _exists(spark: SparkSession, folder: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def stored_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Per dataset of the store, its points counted and dated from one stored row a batch; no point is read."""
    rows = spark.read.parquet(f"{path}/dataset_id=*/_summary/*")
    return rows.groupBy("dataset_id").agg(
        F.sum("point_count").alias("point_count"), F.min("first_point").alias("first_point"), F.max("last_point").alias("last_point"),
        F.sum("invalid_points").alias("invalid_points"), F.count(F.lit(1)).alias("batches"))


def _move(fs, source, target) -> None:
    if not fs.rename(source, target):
        raise OSError(f"cannot move {source} to {target}")


def publish_points(spark: SparkSession, staged: str, path: str, dataset_id: str) -> None:
    """Move a staged dataset into the store, replacing an earlier one.

    The earlier data is set aside (in a hidden folder beside it, which no read
    of the store sees) and dropped only when the new data is in place; a move
    that fails puts it back, and a publish that was stopped in between is put
    back by the next one.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    source, target = (hadoop.Path(f"{p}/dataset_id={dataset_id}") for p in (staged, path))
    aside = hadoop.Path(f"{path}/_replaced-{dataset_id}")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(target.getParent())
    if fs.exists(aside):                       # left by a stopped publish
        if fs.exists(target):
            fs.delete(aside, True)
        else:
            _move(fs, aside, target)
    if not fs.exists(source):
        raise OSError(f"nothing staged at {source}")
    replaces = fs.exists(target)
    if replaces:
        _move(fs, target, aside)
    try:
        _move(fs, source, target)
    except Exception:
        if replaces:
            _move(fs, aside, target)
        raise
    if replaces:
        fs.delete(aside, True)
    drop_folder(spark, staged)


def drop_folder(spark: SparkSession, folder: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# ---------------------------------------------------------------- A6
def registry_entry(spark: SparkSession, **fields) -> DataFrame:
    """One registry log row (create or status update)."""
    row = {c: fields.get(c) for c in REGISTRY_COLUMNS}
    schema = ("id string, name string, source_type string, source_path string, row_count bigint, datetime_column string, "
              "status string, error_message string, created_at timestamp_ntz, updated_at timestamp_ntz")
    return spark.createDataFrame([tuple(row[c] for c in REGISTRY_COLUMNS)], schema)


def append_registry(entry: DataFrame, path: str) -> None:
    entry.write.mode("append").parquet(path)


def current_datasets(log: DataFrame) -> DataFrame:
    """Latest log row per dataset id (max_by over the update time; no sort of the whole log)."""
    latest = log.groupBy("id").agg(F.max_by(F.struct(*[c for c in REGISTRY_COLUMNS if c != "id"]), "updated_at").alias("s"))
    return latest.select("id", "s.*")


def list_datasets(log: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """Datasets newest first, paged."""
    return current_datasets(log).orderBy(F.col("created_at").desc(), "id").offset(offset).limit(limit)


def get_dataset(log: DataFrame, dataset_id: str) -> DataFrame:
    return current_datasets(log).where(F.col("id") == dataset_id)


def update_status(spark: SparkSession, registry_path: str, dataset_id: str, status: str, error_message: str | None = None) -> None:
    """Append a status row for an existing dataset; an unknown id raises."""
    current = get_dataset(spark.read.parquet(registry_path), dataset_id).first()  # at most one row
    if current is None:
        raise KeyError(f"unknown dataset {dataset_id}")
    fields = {c: current[c] for c in REGISTRY_COLUMNS if c in current.asDict()}
    fields.update(status=status, error_message=error_message)
    entry = registry_entry(spark, **fields).withColumn("updated_at", F.current_timestamp().cast("timestamp_ntz"))
    append_registry(entry, registry_path)


# ---------------------------------------------------------------- D1-D6
def _ts(v) -> Column:
    return F.lit(str(v)).cast("timestamp_ntz")


def time_range(points: DataFrame, dataset_id: str, start=None, end=None, limit: int = 1000) -> DataFrame:
    """Inclusive time range of one dataset, ordered by time (row index breaks ties), first ``limit``."""
    cond = F.col("dataset_id") == dataset_id
    if start is not None:
        cond = cond & (F.col("timestamp") >= _ts(start))
    if end is not None:
        cond = cond & (F.col("timestamp") <= _ts(end))
    return points.where(cond).orderBy("timestamp", "row_index").limit(limit)


def _path(field: str) -> str:
    """JSON path of one top-level key, whatever characters it holds."""
    return "$['" + field.replace("\\", "\\\\").replace("'", "\\'") + "']"


def field_text(field: str) -> Column:
    return F.get_json_object("payload", _path(field))


def payload_field_equals(points: DataFrame, dataset_id: str, field: str, value, limit: int = 100) -> DataFrame:
    """Text equality on one JSON key (values compared as text)."""
    return (points.where((F.col("dataset_id") == dataset_id) & (field_text(field) == str(value)))
            .orderBy("timestamp", "row_index").limit(limit))


def _holds(wanted):
    return lambda item: _contained(item, wanted)


def _contained(v: Column, wanted) -> Column:
    """Whether a JSON value (variant) contains ``wanted``: objects by key, arrays by element, scalars by value."""
    if isinstance(wanted, dict):
        parts = [_contained(F.try_variant_get(v, _path(k), "variant"), x) for k, x in wanted.items()]
        return reduce(and_, parts, F.schema_of_variant(v).startswith("OBJECT"))
    if isinstance(wanted, list):
        items = F.try_variant_get(v, "$", "array<variant>")
        return reduce(and_, [F.exists(items, _holds(x)) for x in wanted], items.isNotNull())
    text = F.to_json(v)
    if isinstance(wanted, (int, float)) and not isinstance(wanted, bool):
        return F.coalesce(text.try_cast("double") == float(wanted), F.lit(False))
    return text == json.dumps(wanted, ensure_ascii=False)


def payload_contains(points: DataFrame, obj: dict) -> DataFrame:
    """D3: JSON containment: every key of ``obj`` is there with a value that contains the wanted one."""
    return points.where(F.coalesce(_contained(F.try_parse_json("payload"), obj), F.lit(False)))


def payload_numeric_agg(points: DataFrame, field: str, dataset_id: str | None = None, keys: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """count/min/max/avg of a JSON field over values that look numeric."""
    p = points if dataset_id is None else points.where(F.col("dataset_id") == dataset_id)
    t = field_text(field)
    x = p.where(t.rlike(NUMERIC_TEXT)).withColumn("_v", t.cast("double"))
    return group(x, keys).agg(F.count("_v").alias("count"), F.min("_v").alias("min"), F.max("_v").alias("max"), F.avg("_v").alias("avg"))


def dataset_summary(datasets: DataFrame, points: DataFrame | None = None, summaries: DataFrame | None = None) -> DataFrame:
    """Datasets LEFT JOIN per-dataset point aggregates (aggregate before the join).

    The aggregates come from ``points``, or from ``summaries`` kept up to date
    with every stored batch (``stored_summaries``).
    """
    agg = summaries if summaries is not None else points.groupBy("dataset_id").agg(*_point_aggregates())
    agg = agg.select("dataset_id", "point_count", "first_point", "last_point")
    return datasets.join(agg, datasets.id == agg.dataset_id, "left").drop("dataset_id").withColumn(
        "point_count", F.coalesce("point_count", F.lit(0)))


def invalid_count(points: DataFrame, keys: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Invalid points per dataset."""
    return group(points, keys).agg(F.count_if(~F.col("is_valid")).alias("invalid_points"))


def registry_log_from_points(points: DataFrame) -> DataFrame:
    """A registry log derived from stored points: a 'pending' row at the first point, 'success' at the last."""
    per = points.groupBy("dataset_id").agg(F.min("timestamp").alias("_first"), F.max("timestamp").alias("_last"),
                                           F.count(F.lit(1)).alias("row_count"))
    entries = F.array(
        F.struct(F.lit("pending").alias("status"), F.col("_first").alias("updated_at")),
        F.struct(F.lit("success").alias("status"), F.col("_last").alias("updated_at")),
    )
    x = per.withColumn("_e", F.explode(entries))
    return x.select(
        F.col("dataset_id").alias("id"), F.col("dataset_id").alias("name"), F.lit("file").alias("source_type"),
        F.concat(F.lit("events/"), F.col("dataset_id")).alias("source_path"), "row_count",
        F.lit("timestamp").alias("datetime_column"), F.col("_e.status").alias("status"),
        F.lit(None).cast("string").alias("error_message"), F.col("_first").alias("created_at"), F.col("_e.updated_at").alias("updated_at"),
    )
