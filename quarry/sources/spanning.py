"""Records of delimited files whose quoted fields span lines, read by split (A1).

A line with an odd number of quotes opens or closes a quoted field.  The parity
of every split, added up over the earlier splits of its file, tells for each
line whether it begins inside a field, so the lines of a record are found
without reading a file from its start: windows hold one split, and only lines of
records that span lines are grouped.

Parity is right only where quotes stand as the format has them: at either end of
a field, doubled inside.  ``misquoted`` names the files where some quote does
not; those are left to the reader that takes a whole file.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _misplaced(line: Column, inside: Column, sep: str) -> Column:
    """Whether a quote of the line stands elsewhere than at an end of a quoted field (doubled ones aside)."""
    s = re.escape(sep)
    bare = F.replace(line, F.lit('""'), F.lit(""))
    bare = F.when(inside, F.regexp_replace(bare, rf'\A[^"]*("(?={s}|\z)|\z)', "")).otherwise(bare)
    return F.contains(F.regexp_replace(bare, rf'(\A|(?<={s}))"[^"]*("(?={s}|\z)|\z)', ""), F.lit('"'))


def placed_lines(spark: SparkSession, paths: Sequence[str], utf8: bool) -> DataFrame:
    """Lines with their file, split and place, whether they begin ``inside`` a field, their quotes' parity (``odd``),
    and how many records have ``begun`` in the split up to the line."""
    line = F.col("value") if utf8 else F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    quotes = F.length(F.regexp_replace("line", '[^"]', ""))
    lines = spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"),
        line.alias("line")).withColumn("odd", quotes % 2)
    earlier = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)    # one row a split
    before = lines.groupBy("path", "split").agg(F.sum("odd").alias("_n")).select(
        "path", "split", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    own = Window.partitionBy("path", "split").orderBy("at")
    inside = (F.col("_before") + F.coalesce(F.sum("odd").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) % 2 == 1
    told = lines.join(before, ["path", "split"]).withColumn("inside", inside).drop("_before")
    return told.withColumn("begun", F.count_if(~F.col("inside")).over(own.rowsBetween(Window.unboundedPreceding, 0)))


def misquoted(lines: DataFrame, sep: str) -> DataFrame:
    """Paths of files with a quote that is no end of a field, or with a first line that is empty or no whole record."""
    first = (F.col("split") == 0) & (F.col("begun") == 1) & ~F.col("inside")
    odd_header = first & ((F.col("odd") == 1) | (F.trim("line") == ""))
    return lines.groupBy("path").agg(F.bool_or(odd_header | _misplaced(F.col("line"), F.col("inside"), sep)).alias("bad")).where("bad").select("path")


def joined_records(lines: DataFrame) -> DataFrame:
    """(path, split, at, record): place of the record's first line, and its lines joined; headers and empty lines are left out."""
    whole = lines.where(~F.col("inside") & (F.col("odd") == 0) & ~((F.col("split") == 0) & (F.col("begun") == 1)) & (F.trim("line") != ""))
    # lines before the first beginning in a split belong to the last record of the nearest earlier split that has one
    earlier = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)    # one row a split
    last = lines.groupBy("path", "split").agg(F.max("begun").alias("_n"))
    open_record = F.last(F.when(F.col("_n") > 0, F.struct(F.col("split"), F.col("_n").alias("begun"))), ignorenulls=True).over(earlier)
    owner = last.select("path", "split", open_record.alias("_owner"))
    parts = lines.where(F.col("inside") | (F.col("odd") == 1)).join(owner, ["path", "split"])
    record = F.when(F.col("begun") > 0, F.struct("split", "begun")).otherwise(F.col("_owner"))
    spanning = parts.groupBy("path", record.alias("_record")).agg(F.array_sort(F.collect_list(F.struct("split", "at", "line"))).alias("_lines"))
    spanning = spanning.select("path", F.col("_lines")[0]["split"].alias("split"), F.col("_lines")[0]["at"].alias("at"),
                               F.array_join(F.transform("_lines", lambda x: x["line"]), "\n").alias("record"))
    return whole.select("path", "split", "at", F.col("line").alias("record")).unionByName(spanning)


def parsed(records: DataFrame, columns: Sequence[str], sep: str) -> DataFrame:
    """Records as text columns, read as the file reader reads a line, with the file and place of their first lines."""
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
    return records.select(F.from_csv("record", F.lit(schema), {"sep": sep, "quote": '"', "escape": '"'}).alias("_r"), F.col("path").alias("_file"), F.col("at").alias("_pos")).select("_r.*", "_file", "_pos")
