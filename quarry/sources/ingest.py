"""Ingest delimited files -> profile -> typed records -> stored points + registry + report.

Driver steps are limited to the profile collect (one row per column) and the
registry rows; records are numbered, built and written by Spark.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.common import spread
from quarry.functions.order import with_row_index
from quarry.operators import clean as C
from quarry.operators.profile import column_state, detect_schema, profile_of_state, unite_states
from quarry.sources import store
from quarry.sources.delimited import read_delimited


def numbered(df: DataFrame) -> DataFrame:
    """Dense 0-based row index in read order (file, then position of the row in its split).

    The scan-side id is stable for a given file layout, and numbering happens
    before empty rows are dropped, so the index is the row's original position.
    Rows that ``read_delimited`` gave their places keep those.
    """
    placed = {"_file", "_pos"} <= set(df.columns)
    tagged = df if placed else df.withColumns({"_file": F.input_file_name(), "_pos": F.monotonically_increasing_id()})
    return with_row_index(tagged, ["_file", "_pos"], idx="row_index").drop("_file", "_pos")


def ingestion_report(report: DataFrame, roles: C.Roles, profile: DataFrame, dataset_id: str, name: str, source_path: str) -> DataFrame:
    """C11: one row with the schema (roles and column profiles), the transformation counts, the quality flags and the time."""
    names = lambda cols: F.array(*[F.lit(c) for c in cols]).cast("array<string>")
    columns = profile.agg(F.sort_array(F.collect_list(F.struct("ordinal", *[c for c in profile.columns if c != "ordinal"])))).scalar()
    flags = C.quality_flags(report, roles)
    failures = [F.struct(F.lit(c).alias("column"), F.col(f"numeric_failures__{c}").alias("failures")) for c in roles.numeric]
    none = F.array().cast("array<struct<column:string,failures:bigint>>")
    return report.select(
        F.lit(dataset_id).alias("dataset_id"), F.lit(name).alias("name"), F.lit(source_path).alias("source_path"),
        F.current_timestamp().alias("generated_at"),
        F.struct(F.lit(roles.datetime).cast("string").alias("datetime_column"), names(roles.numeric).alias("numeric_columns"),
                 names(roles.boolean).alias("boolean_columns"), names(roles.text).alias("text_columns"),
                 columns.alias("column_profiles")).alias("schema"),
        "total_records", "valid_records", "invalid_records", "dropped_empty_rows", "timestamp_failures", "valid_ratio",
        (F.array(*failures) if failures else none).alias("numeric_coercion_failures"),
        flags.agg(F.collect_list(F.struct(*flags.columns))).scalar().alias("quality_flags"))


def ingest(spark: SparkSession, paths: list[str], points_path: str, registry_path: str, name: str | None = None,
           dataset_id: str | None = None, reports_path: str | None = None) -> DataFrame:
    """Run the whole ingestion for ``paths``; returns the one-row report (stored in ``reports_path``, default beside the registry).

    The numbered input is checkpointed once and every step reads that copy.
    Points and the report are staged (``status`` staged); the report's
    ``success`` row follows once the points are published, so no report claims
    points that are not there.  Each run has its own ``run_id``: a second run
    of the same dataset returns its own report.  A failed run leaves its staged
    report and its registry entry, and the points of an earlier run as they were.
    """
    dataset_id, run_id = dataset_id or uuid.uuid4().hex, uuid.uuid4().hex
    name = name or os.path.splitext(os.path.basename(paths[0]))[0]
    reports_path = reports_path or f"{registry_path.rstrip('/')}_reports"
    profiles_path = f"{reports_path.rstrip('/')}_profiles"
    staged = f"{points_path.rstrip('/')}/_staging-{dataset_id}"

    def log(**fields) -> None:
        now = F.current_timestamp().cast("timestamp_ntz")
        entry = store.registry_entry(spark, id=dataset_id, name=name, source_type="file", source_path=",".join(paths), **fields)
        store.append_registry(entry.withColumns({"created_at": now, "updated_at": now}), registry_path)

    try:
        idx = numbered(read_delimited(spark, paths, normalize=True, places=True))
        raw = idx.drop("row_index")
        state = column_state(spread(raw)).withColumns({"dataset_id": F.lit(dataset_id), "run_id": F.lit(run_id)})
        state.write.mode("append").parquet(profiles_path)
        profile = detect_schema(profile_of_state(spark.read.parquet(profiles_path).where(F.col("run_id") == run_id)))
        roles = C.plan_roles(raw, profile)
        rec = C.records(idx, roles, keep=["row_index"])
        store.write_points(rec.select("row_index", "timestamp", "payload", "is_valid"), staged, dataset_id)
        report = ingestion_report(C.transformation_report(raw, roles), roles, profile, dataset_id, name, ",".join(paths))
        report.withColumns({"status": F.lit("staged"), "run_id": F.lit(run_id)}).write.mode("append").parquet(reports_path)
        stored = spark.read.parquet(reports_path).where(F.col("run_id") == run_id)
        total = stored.select("total_records").first()[0]
        store.publish_points(spark, staged, points_path, dataset_id)
        done = stored.where("status = 'staged'").withColumn("status", F.lit("success"))
        done.write.mode("append").parquet(reports_path)
    except Exception as exc:  # the failed status is recorded, then re-raised
        store.drop_folder(spark, staged)
        log(status="failed", error_message=str(exc))
        raise
    log(row_count=int(total), datetime_column=roles.datetime, status="success", error_message=None)
    return spark.read.parquet(reports_path).where((F.col("run_id") == run_id) & (F.col("status") == "success"))


def stored_profile(spark: SparkSession, reports_path: str) -> DataFrame:
    """B5 over all datasets, each as its latest successful run read it, from the stored states; no file or point is read."""
    runs = current_reports(spark.read.parquet(reports_path)).select("run_id")
    states = spark.read.parquet(f"{reports_path.rstrip('/')}_profiles").join(runs, "run_id", "left_semi")
    return profile_of_state(unite_states(states, "run_id"))


def current_reports(reports: DataFrame) -> DataFrame:
    """The latest successful report of every dataset."""
    whole = F.struct(*[F.col(c) for c in reports.columns])
    return reports.where("status = 'success'").groupBy("dataset_id").agg(F.max_by(whole, "generated_at").alias("_r")).select("_r.*")
