"""Exact quantiles of any number of values, for all keys at once, in bounded memory.

A sketch brackets every wanted rank between two values; one pass counts what
lies below each bracket and keeps the few rows inside it.  Each further round
cuts a bracket into BINS bins of equal width, counts them (partially
aggregated), and takes the bin that holds the rank, from its smallest to its
largest value, as the next bracket, until those are equal.  Nothing is
buffered, ordered or collected but BINS counts a bracket, whatever the number
of rows, distinct values or ties.  A bracket that the sketch placed wrongly is
replaced by the whole range, so its accuracy decides the time, not the result.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.common import col, num
from quarry.session import checkpoint_dir

BINS = 1024
ACCURACY = 10_000
MARGIN = 3 / ACCURACY    # bracket: the sketch's ranks this far (as a share of the rows) on both sides
FEW_KEYS = 10_000        # up to here the brackets go to the rows; above, Spark decides


def _on(keys: Sequence[str], prefix: str, more: Sequence[Column] = ()) -> Column:
    return reduce(lambda a, b: a & b, [*[F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in keys], *more])


def _renamed(df: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    return df.withColumnsRenamed({k: f"{prefix}{k}" for k in keys})


def exact_quantiles(df: DataFrame, value: str | Column, probs: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, count, quantiles): the ``probs``-quantiles (linear interpolation) of the non-null numbers, as an array.

    Keys without a number, and an input without one, give no row.  NULL keys are a key of their own.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    user_keys, keys = list(keys), list(keys) or ["_all"]
    rows = df.select(*user_keys, num(value).alias("_v")).where("_v IS NOT NULL")
    if not user_keys:
        rows = rows.withColumn("_all", F.lit(0))
    edges = [min(1.0, max(0.0, p + side * MARGIN)) for p in probs for side in (-1, 1)]
    facts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"),
                                    F.percentile_approx("_v", edges, ACCURACY).alias("_e"))
    # one bracket for each rank wanted: two a quantile
    wanted = []
    for i, p in enumerate(probs):
        for j, part in enumerate((F.floor, F.ceil)):
            wanted.append(F.struct(
                F.lit(2 * i + j).alias("t"), part((F.col("_n") - 1) * p).cast("bigint").alias("rank"),
                (F.col("_least") if p <= MARGIN else F.col("_e")[2 * i]).alias("lo"),
                (F.col("_most") if p >= 1 - MARGIN else F.col("_e")[2 * i + 1]).alias("hi")))
    facts = facts.select(*keys, "_n", "_least", "_most", F.array(*wanted).alias("_t")).checkpoint(eager=True)
    few = facts.limit(FEW_KEYS + 1).count() <= FEW_KEYS

    def by_key(of_keys: DataFrame) -> DataFrame:
        renamed = _renamed(of_keys, keys, "_f")
        return F.broadcast(renamed) if few else renamed     # a hot key's rows stay where they are

    # counts only: a buffer that held the brackets too would be aggregated by sorting the rows, each with a copy of them
    counts = rows.join(by_key(facts.select(*keys, "_t")), _on(keys, "_f")).groupBy(*keys).agg(
        *[F.count_if(F.col("_v") < F.col("_t")[t]["lo"]).alias(f"_below{t}") for t in range(2 * len(probs))],
        *[F.count_if(F.col("_v") <= F.col("_t")[t]["hi"]).alias(f"_upto{t}") for t in range(2 * len(probs))])
    tally = facts.join(_renamed(counts, keys, "_f"), _on(keys, "_f")).select(
        *keys, "_n", "_least", "_most", "_t",
        *[F.array(*[F.col(f"{name}{t}") for t in range(2 * len(probs))]).alias(name) for name in ("_below", "_upto")])

    def start(target: Column, i: Column) -> Column:
        held = (target["rank"] >= F.col("_below")[i]) & (target["rank"] < F.col("_upto")[i])
        return F.struct(target["t"].alias("t"), target["rank"].alias("rank"),
                        F.when(held, F.col("_below")[i]).otherwise(F.lit(0)).alias("below"),
                        F.when(held, target["lo"]).otherwise(F.col("_least")).alias("lo"),
                        F.when(held, target["hi"]).otherwise(F.col("_most")).alias("hi"))

    state = tally.select(*keys, "_n", F.inline(F.transform("_t", start))).checkpoint(eager=True)
    brackets = state.groupBy(*keys).agg(F.collect_list(F.struct("t", "lo", "hi")).alias("_t"))     # 2 * probs entries a key
    inside = rows.join(by_key(brackets), _on(keys, "_f")).select(
        *keys, "_v", F.explode(F.filter("_t", lambda b: (b["lo"] < b["hi"]) & (F.col("_v") >= b["lo"]) & (F.col("_v") <= b["hi"]))["t"]).alias("_vt"))
    inside = inside.checkpoint(eager=True)
    done, open_ = state.where("lo >= hi"), state.where("lo < hi")
    while not open_.isEmpty():
        share = F.try_divide(F.col("_v") / 2 - F.col("lo") / 2, F.col("hi") / 2 - F.col("lo") / 2)   # halves: no overflow
        spot = F.least(F.lit(BINS - 2), F.coalesce(F.floor(share * BINS), F.lit(0)))
        spot = F.when(F.col("_v") >= F.col("hi"), BINS - 1).otherwise(spot)                          # the largest value apart: every round cuts
        binned = inside.join(by_key(open_), _on(keys, "_f", [F.col("_vt") == F.col("t")])).where("_v BETWEEN lo AND hi")
        bins = binned.groupBy(*keys, "_n", "t", "rank", "below", spot.alias("_bin")).agg(
            F.count(F.lit(1)).alias("_c"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        before = F.coalesce(F.sum("_c").over(Window.partitionBy(*keys, "t").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        bins = bins.withColumn("_from", F.col("below") + before)
        state = bins.where((F.col("rank") >= F.col("_from")) & (F.col("rank") < F.col("_from") + F.col("_c"))).select(
            *keys, "_n", "t", "rank", F.col("_from").alias("below"), "lo", "hi").checkpoint(eager=True)
        done, open_ = done.unionByName(state.where("lo >= hi")), state.where("lo < hi")
    at = lambda t: F.max(F.when(F.col("t") == t, F.col("lo")))
    values = []
    for i, p in enumerate(probs):
        pos = (F.first("_n") - 1) * p
        values.append(at(2 * i) + (at(2 * i + 1) - at(2 * i)) * (pos - F.floor(pos)))
    return done.groupBy(*keys).agg(F.first("_n").alias("count"), F.array(*values).alias("quantiles")).select(*user_keys, "count", "quantiles")


def exact_quantile(df: DataFrame, column: str | Column, q: float) -> Column:
    """The exact q-quantile of a whole column as a scalar; NULL without values."""
    found = exact_quantiles(df.select(col(column).alias("_x")), "_x", [q]).first()   # one row
    return F.lit(found["quantiles"][0] if found else None).cast("double")
