"""Continuous ingestion of delimited files dropped into a folder (Structured Streaming).

The stream carries the names of new files only.  Each micro-batch reads its
files with the batch reader (separator and encoding per file, doubled quotes,
fields that span lines, headers in any order, normalised names, missing-value
tokens) inside ``foreachBatch``, applies the cleaning plan (roles, layouts,
European flags) fixed up front from a profiled sample, and stores the records as
the batch's own partition of the point store.  ``foreachBatch`` is at least
once: a replayed micro-batch reads the same files and replaces its partition, so
rows are stored once.  ``trigger(availableNow)`` drains what is there and stops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.functions import parse as P
from quarry.operators import clean as C
from quarry.sources import store
from quarry.sources.delimited import read_delimited
from quarry.sources.ingest import numbered

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
BATCH_ROWS = 1 << 40      # row indexes of a micro-batch start at its number times this


def _columns(spark: SparkSession, schema: str | StructType) -> list[str]:
    fields = schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema
    return [P.normalize_name(f.name) for f in fields]


def read_files(spark: SparkSession, paths: list[str], columns: list[str]) -> DataFrame:
    """The numbered rows of ``paths`` as text in the given columns: absent ones are NULL, others are left out."""
    idx = numbered(read_delimited(spark, paths, normalize=True, places=True))
    return idx.select("row_index", *[F.col(f"`{c}`") if c in idx.columns else F.lit(None).cast("string").alias(c) for c in columns])


def start(spark: SparkSession, source_dir: str, schema: str | StructType, roles: C.Roles, points_path: str, checkpoint: str,
          dataset_id: str, available_now: bool = True, max_files_per_trigger: int = 100, pattern: str = "*.{csv,tsv,txt}"):
    """Start the ingest stream over files of ``source_dir`` that match ``pattern``; returns the ``StreamingQuery``.

    ``schema`` names the columns to keep.  A micro-batch collects its file names
    (``max_files_per_trigger`` at most) and nothing else.
    """
    columns = _columns(spark, schema)
    found = (spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", pattern)
             .option("maxFilesPerTrigger", max_files_per_trigger).load(source_dir).select("path", "length"))   # contents are not read here

    def write_batch(batch: DataFrame, epoch: int) -> None:
        paths = sorted(r["path"] for r in batch.where("length > 0").collect())
        if not paths:
            return
        rows = read_files(batch.sparkSession, paths, columns).withColumn("row_index", F.col("row_index") + F.lit(epoch).cast("bigint") * BATCH_ROWS)
        rec = C.records(rows, roles, keep=["row_index"])
        store.write_points(rec.select("row_index", "timestamp", "payload", "is_valid"), points_path, dataset_id, batch=epoch)

    writer = found.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
