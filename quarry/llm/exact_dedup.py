"""Exact dedup by content sort (DataFrame functions only).

Normalised texts are range-partitioned by sampled splitters, each range is
sorted externally so that equal texts lie next to each other, and a window over
the full normalised text compares neighbours.  A large group of copies spans
several ranges (the splitter carries a hash of the id); its runs, at most a few
per range, are merged afterwards by their full texts.

Defined cases: null text counts as empty and all empty texts are equal; of
equal texts the row with the most code points, then the smallest id (null ids
last) stays; repeated rows are separate members of their group; an empty table
gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm._common import SPACE_CLASS, materialise, partitions, prepare

HEAD_CHARS = 32          # leading characters that order the ranges; ties go by a hash of the whole text
SAMPLE_PER_RANGE = 40    # sampled rows per splitter

SPLITTER = "array<struct<head:string,h:bigint,t:bigint>>"


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.select(
        F.col(id_col).alias("doc_id"),
        F.char_length(text).cast("long").alias("n"),
        F.regexp_replace(text, SPACE_CLASS, "").alias("norm"),
    )
    return out.select(
        "*",
        F.substring("norm", 1, HEAD_CHARS).alias("head"),
        F.xxhash64("norm").alias("h"),
        F.xxhash64("doc_id").alias("t"),
    )


def sampled_splitters(docs: DataFrame, id_col: str, text_col: str, ranges: int) -> list[tuple[str, int, int]]:
    """At most ``ranges - 1`` ordered splitters from a sample of about SAMPLE_PER_RANGE rows a range."""
    total = docs.count()
    if ranges < 2 or total == 0:
        return []
    fraction = min(1.0, ranges * SAMPLE_PER_RANGE / total)
    sample = docs.select(id_col, text_col).sample(False, fraction, seed=11)
    keys = sorted(tuple(r) for r in _keyed(sample, id_col, text_col).select("head", "h", "t").collect())
    picked = {keys[len(keys) * i // ranges] for i in range(1, ranges)} if keys else set()
    return sorted(picked)


def _range_of(splitters: list[tuple[str, int, int]]) -> tuple[Column, Column]:
    """(range number, whether a splitter has the row's own head and hash) by binary search."""
    if not splitters:
        return F.lit(0), F.lit(False)
    text = json.dumps([dict(zip(("head", "h", "t"), s)) for s in splitters], ensure_ascii=False)
    table = F.from_json(F.lit(text), SPLITTER)
    key = F.struct(F.col("head"), F.col("h"), F.col("t"))
    steps = math.ceil(math.log2(len(splitters) + 1)) + 1

    def step(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        open_, above = acc["lo"] < acc["hi"], F.get(table, mid) < key
        return F.struct(
            F.when(open_ & above, mid + 1).otherwise(acc["lo"]).alias("lo"),
            F.when(open_ & ~above, mid).otherwise(acc["hi"]).alias("hi"),
        )

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(splitters)).alias("hi"))
    lo = F.aggregate(F.array_repeat(F.lit(0), steps), start, step, lambda acc: acc["lo"])

    def same(i: Column) -> Column:
        s = F.get(table, i)
        return F.coalesce((s["h"] == F.col("h")) & (s["head"] == F.col("head")), F.lit(False))

    return lo, same(F.col("b")) | (F.col("b") > 0) & same(F.col("b") - 1)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    prepare(spark)
    ranges = ranges or partitions(spark)
    number, straddles = _range_of(sampled_splitters(docs, id_col, text_col, ranges))
    dealt = (
        _keyed(docs, id_col, text_col).withColumn("b", number).withColumn("straddles", straddles).drop("t")
        .repartition(ranges, "b")
    )
    # The repartitioning by range satisfies this window: one external sort per task, then
    # neighbours are compared on (range, head, hash, whole normalised text).
    run = Window.partitionBy("b", "head", "h", "norm")
    order = run.orderBy(F.desc("n"), F.col("doc_id").asc_nulls_last())
    runs = materialise(dealt.select(
        "doc_id", "straddles",
        F.first("doc_id").over(order).alias("keep_id"),
        F.first("n").over(order).alias("keep_n"),
        F.count(F.lit(1)).over(run).alias("group_size"),
        F.row_number().over(order).alias("nth"),
        F.sha2(F.col("norm"), 256).alias("text_sha256"),
        F.when(F.col("straddles") & (F.row_number().over(order) == 1), F.col("norm")).alias("edge_text"),
    ))
    # Runs of one text in several ranges: a run or two per range, merged by their full text.
    best = F.min(F.struct(-F.col("keep_n"), F.col("keep_id").isNull(), F.col("keep_id").alias("id")))
    merged = (
        runs.where("edge_text IS NOT NULL")
        .groupBy("edge_text").agg(best.alias("best"), F.sum("group_size").alias("whole_size"), F.first("text_sha256").alias("text_sha256"))
        .select("text_sha256", F.col("best.id").alias("whole_keep"), (-F.col("best.col1")).alias("whole_n"), "whole_size")
    )
    out = runs.join(F.broadcast(merged), "text_sha256", "left")  # at most about two rows per range
    joined = F.col("whole_size").isNotNull() & F.col("straddles")
    keep = F.when(joined, F.col("whole_keep")).otherwise(F.col("keep_id"))
    first_run = ~joined | (F.col("keep_id").eqNullSafe(F.col("whole_keep")) & (F.col("keep_n") == F.col("whole_n")))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.when(joined, F.col("whole_size")).otherwise(F.col("group_size")).cast("long").alias("group_size"),
        (F.col("doc_id").eqNullSafe(keep) & (F.col("nth") == 1) & first_run).alias("kept"),
        "text_sha256",
    )


ORACLE_SQL = r"""
SELECT doc_id, first_value(doc_id) OVER o AS keep_id, count(*) OVER g AS group_size,
       doc_id = first_value(doc_id) OVER o AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, length(coalesce(text, '')) AS n,
             regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents)
WINDOW g AS (PARTITION BY norm), o AS (PARTITION BY norm ORDER BY n DESC, doc_id)
"""
