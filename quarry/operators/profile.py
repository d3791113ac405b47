"""Schema detection and column profiling.

One wide aggregation computes, for every column at once: non-null count,
boolean-token test, match counts for each datetime layout and numeric parse
counts (both notations plus the European flag).  Exact distinct counts and
sample values come from one unpivot to (column, value) + group-by.  The result
is a small profile table (one row per column), and schema roles are assigned
by Spark over that table (no collect).

The counts of a batch of rows, with a sketch of each column's distinct values,
are a state that can be stored and united with the states of other batches
(``column_state``, ``unite_states``, ``profile_of_state``): a further batch
updates the profile without reading the earlier ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import parse as P
from quarry.functions.common import spread

SAMPLE_SIZE = 5
SAMPLE_BUCKETS = 64


def _kind(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, T.NumericType):
        return "numeric"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return "text"


def _long(df: DataFrame) -> DataFrame:
    """Unpivot to (ordinal, v) with v the text form of each cell (NULL kept)."""
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("ordinal"), P.text(F.col(f"`{f.name}`")).alias("v")) for i, f in enumerate(df.schema.fields)
    ])).alias("s")).select("s.*")


_SUMS = ("non_null", "bool_tokens", "_eu", "_ne", "_np", "dt_any")     # counts that add up over batches


def column_state(df: DataFrame, sketch: bool = True) -> DataFrame:
    """Per-column counts (and distinct-value sketch) that add up over batches: unpivot to (ordinal, text) and aggregate by ordinal.

    The aggregate list is the same whatever the number of columns (the plan
    does not grow with the table width) and partial aggregation runs map-side,
    so only (columns x partitions) partial rows are shuffled.
    """
    fields = df.schema.fields
    # which layouts a cell fits; the many layouts are tried only on cells that look like dates
    fits = F.when(P.looks_like_date(F.col("v")), F.array(*[P.parse_dated(F.col("v"), f).isNotNull() for f, _ in P.DATETIME_FORMATS]))
    x = _long(df).select("ordinal", "v", P.numeric_body(F.col("v")).alias("b"), P.is_negative(F.col("v")).alias("neg"), fits.alias("fits"))
    t, b, neg = F.col("v"), F.col("b"), F.col("neg")
    stats = x.groupBy("ordinal").agg(
        F.count(F.lit(1)).alias("total_count"),
        F.count(t).alias("non_null"),
        F.count_if(P.is_bool_token(t)).alias("bool_tokens"),
        F.count_if(P.euro_body(b)).alias("_eu"),
        F.count(P.parse_numeric_body(b, neg, True)).alias("_ne"),
        F.count(P.parse_numeric_body(b, neg, False)).alias("_np"),
        F.array(*[F.count_if(F.col("fits")[i]) for i in range(len(P.DATETIME_FORMATS))]).alias("dt_counts"),
        F.count_if(F.array_contains("fits", True)).alias("dt_any"),
        *([F.hll_sketch_agg(t).alias("sketch")] if sketch else []),
    )
    meta = df.sparkSession.createDataFrame(
        [(i, f.name, _kind(f.dataType), P.name_score(f.name)) for i, f in enumerate(fields)],
        "ordinal int, column string, native string, name_score double")
    return F.broadcast(meta).join(stats, "ordinal")  # meta has one row per column


def unite_states(states: DataFrame, batch: str = "batch") -> DataFrame:
    """State of all batches from the states of each (told apart by column ``batch``); columns meet by name.

    A column that a batch lacks counts as NULL in its rows.  Its place is the
    first one it has anywhere; a column whose type differs is text.
    """
    rows = states.groupBy(batch).agg(F.max("total_count").alias("_rows")).agg(F.sum("_rows")).scalar()
    layouts = len(P.DATETIME_FORMATS)
    one = states.groupBy("column").agg(
        F.min("ordinal").alias("ordinal"), F.max("name_score").alias("name_score"),
        F.when(F.min("native") == F.max("native"), F.min("native")).otherwise("text").alias("native"),
        *[F.sum(c).alias(c) for c in _SUMS],
        F.array(*[F.sum(F.col("dt_counts")[i]) for i in range(layouts)]).alias("dt_counts"),
        F.hll_union_agg("sketch").alias("sketch"))
    return one.withColumn("total_count", rows)


def _stats(state: DataFrame) -> DataFrame:
    """Counts of a state under the column's number notation."""
    sketched = [F.hll_sketch_estimate("sketch").alias("unique_count")] if "sketch" in state.columns else []
    return state.select(
        "ordinal", "column", "native", "name_score", "total_count", "non_null", "bool_tokens",
        (F.col("_eu") > 0).alias("european"),
        F.when(F.col("_eu") > 0, F.col("_ne")).otherwise(F.col("_np")).alias("numeric_ok"),
        "dt_counts", "dt_any", *sketched,
    )


def profile_of_state(state: DataFrame) -> DataFrame:
    """B5 from a (united) state: distinct counts are estimates of the sketch, and there are no samples."""
    return _profile(_stats(state).withColumn("sample_values", F.lit(None).cast("string")))


def distinct_and_samples(df: DataFrame) -> DataFrame:
    """Exact distinct non-null count and the SAMPLE_SIZE smallest distinct values per column.

    Values are unpivoted to (column, value) and de-duplicated by a group-by
    (partial aggregation first).  Samples are a two-level top-k: first within
    (column, hash bucket), then over the <= buckets x k survivors per column.
    """
    names = df.columns
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), P.text(F.col(f"`{c}`")).alias("v")) for c in names
    ])).alias("s")).select("s.*").where(F.col("v").isNotNull())
    distinct = long.groupBy("column", "v").agg(F.count(F.lit(1)).alias("_c"))
    counts = distinct.groupBy("column").agg(F.count(F.lit(1)).alias("unique_count"))
    b = F.pmod(F.xxhash64("v"), F.lit(SAMPLE_BUCKETS))
    w1 = Window.partitionBy("column", "_b").orderBy("v")
    cand = distinct.withColumn("_b", b).withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= SAMPLE_SIZE)
    w2 = Window.partitionBy("column").orderBy("v")
    top = cand.withColumn("_r2", F.row_number().over(w2)).where(F.col("_r2") <= SAMPLE_SIZE)
    samples = top.groupBy("column").agg(F.array_join(F.array_sort(F.collect_list("v")), "|").alias("sample_values"))
    names_df = df.sparkSession.createDataFrame([(c,) for c in names], "column string")
    return names_df.join(counts, "column", "left").join(samples, "column", "left").na.fill(0, ["unique_count"])


def profile_columns(df: DataFrame, with_distinct: bool | str = True) -> DataFrame:
    """Per column counts, ratios, samples, best datetime layout and inferred type.

    Type priority: boolean -> datetime (ratio >= 0.60) -> numeric (>= 0.70) -> text.
    Native typed columns keep their type (ratio 1.0).  ``with_distinct``: True
    for exact distinct counts and samples (shuffles every distinct cell),
    "approx" for a sketch's counts in the same pass and no samples, False for
    neither.
    """
    df = spread(df)
    if with_distinct == "approx":
        return profile_of_state(column_state(df))
    st = _stats(column_state(df, sketch=False))
    if with_distinct:
        st = st.join(distinct_and_samples(df), "column")
    else:  # role assignment needs neither distinct counts nor samples
        st = st.withColumns({"unique_count": F.lit(None).cast("bigint"), "sample_values": F.lit(None).cast("string")})
    return _profile(st)


def _profile(st: DataFrame) -> DataFrame:
    """Ratios, best layout and inferred type from the counts."""
    nn = F.col("non_null")
    dt_best = F.array_max(F.col("dt_counts"))
    fmt_idx = F.array_position(F.col("dt_counts"), dt_best)  # first layout on ties
    fmts = F.array(*[F.lit(f) for f, _ in P.DATETIME_FORMATS])
    native = F.col("native")
    dt_ratio = (F.when(native == "datetime", F.lit(1.0))
                .when(nn > 0, F.col("dt_any") / nn).otherwise(F.lit(0.0)))
    num_ratio = F.when(native == "numeric", F.lit(1.0)).when(nn > 0, F.col("numeric_ok") / nn).otherwise(F.lit(0.0))
    is_bool = (native == "boolean") | ((nn > 0) & (F.col("bool_tokens") == nn))
    out = st.select(
        "ordinal", "column", "native", "name_score", "european",
        "total_count", F.col("non_null"), (F.col("total_count") - nn).alias("null_count"), "unique_count",
        F.when(F.col("total_count") > 0, (F.col("total_count") - nn) / F.col("total_count")).otherwise(F.lit(1.0)).alias("null_ratio"),
        F.when(nn > 0, F.col("unique_count") / nn).otherwise(F.lit(0.0)).alias("unique_ratio"),
        "sample_values",
        dt_ratio.alias("datetime_ratio"),
        F.when((native != "datetime") & (dt_best > 0), fmts[fmt_idx - 1]).alias("datetime_format"),
        num_ratio.alias("numeric_ratio"),
        is_bool.alias("_is_bool"),
    )
    inferred = (F.when(F.col("_is_bool"), "boolean")
                .when(F.col("datetime_ratio") >= P.DATETIME_PARSE_THRESHOLD, "datetime")
                .when(F.col("numeric_ratio") >= P.NUMERIC_PARSE_THRESHOLD, "numeric").otherwise("text"))
    ratio = (F.when(inferred == "datetime", F.col("datetime_ratio"))
             .when(inferred == "numeric", F.col("numeric_ratio")))
    return out.withColumn("inferred_type", inferred).withColumn("parse_success_ratio", ratio).drop("_is_bool")


def datetime_score(profile: DataFrame) -> DataFrame:
    """0 when the parse ratio is below 0.60, else ratio + name score."""
    r = F.col("datetime_ratio")
    return profile.withColumn("datetime_score", F.when(r < P.DATETIME_PARSE_THRESHOLD, F.lit(0.0)).otherwise(r + F.col("name_score")))


def detect_schema(profile: DataFrame) -> DataFrame:
    """Roles per column: one datetime (highest score, first column on ties), booleans, numerics, text."""
    s = datetime_score(profile)
    w = Window.orderBy(F.col("datetime_score").desc(), F.col("ordinal"))  # over the profile: one row per column
    s = s.withColumn("_rank", F.row_number().over(w))
    is_dt = (F.col("_rank") == 1) & (F.col("datetime_score") > 0)
    role = (F.when(is_dt, "datetime")
            .when(F.col("inferred_type") == "boolean", "boolean")
            .when((F.col("inferred_type") == "numeric") | (F.col("numeric_ratio") >= P.NUMERIC_PARSE_THRESHOLD), "numeric")
            .otherwise("text"))
    return s.withColumn("role", role).drop("_rank")
