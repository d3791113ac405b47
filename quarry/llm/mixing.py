"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets a share of all words by weight, at most ``max_repeat`` times
its own size (the excess goes to the others by weight).  Whole repeats cover
the target as far as they go; the rest is a subset-sum problem over the
histogram of document lengths: a proportional number of documents of each
length, then a bounded-knapsack dynamic programme over the lengths that are
left for the last few thousand words.  Which documents of a length are taken
follows a seeded hash.

Defined cases: null text has size 0; null source is a source of its own (last
in order); a document of size 0 takes 0 words; repeated rows are separate
documents; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm._common import WORD_CLASS, materialise, prepare, salted_rank

WEIGHTS = (5.0, 2.0, 1.0)   # by order of the source, repeating
MAX_REPEAT = 3
SEED = 20
# The dynamic programme works on about this many words; the proportional pass
# before it leaves less than one document.
WINDOW_WORDS = 4096


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``totals``: one row (source, source_size) per source -> adds weight and target.

    Sources in order of cap / weight: those whose cap lies below the water level
    get their cap, the others the level times their weight.  The windows see one
    row per source, never documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    nth = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    s = totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), nth.cast("int")))
    s = s.withColumn("cap", F.col("source_size").cast("double") * max_repeat)
    s = s.withColumn("ratio", F.col("cap") / F.col("weight"))
    up = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    s = s.withColumns({
        "cap_before": F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "weight_from": F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing)),
        "budget": F.sum(F.col("source_size").cast("double")).over(every) * share,
    })
    s = s.withColumn("full", F.col("cap_before") + F.col("ratio") * F.col("weight_from") <= F.col("budget"))
    spare = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(every)
    s = s.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(spare * F.col("weight") / open_weight))
    return s.select("source", "source_size", "weight", "target")


def fit_lengths(lengths: Sequence[int], counts: Sequence[int], budget: int, window: int = WINDOW_WORDS) -> list[int]:
    """How many documents of each length to take so that the words come as near to ``budget`` from below as possible."""
    have = {int(n): int(c) for n, c in zip(lengths, counts) if n > 0 and c > 0}
    total = sum(n * c for n, c in have.items())
    if budget <= 0 or not total:
        return [0] * len(lengths)
    budget = min(int(budget), total)
    take, carry = {}, 0.0
    for n in sorted(have, reverse=True):           # proportional, the rounding error carried to shorter documents
        carry += have[n] * n * (budget / total)
        take[n] = min(have[n], max(0, int(carry // n)))
        carry -= take[n] * n
    rest = budget - sum(n * k for n, k in take.items())
    while rest < 0:                                # floating point may have carried one word too many
        n = min(k for k in take if take[k])
        take[n] -= 1
        rest += n
    for n in sorted(have):                         # give a few documents back, short ones first, to widen the choice
        if rest >= window:
            break
        back = min(take[n], -(-(window - rest) // n)) if n <= window else 0
        take[n] -= back
        rest += back * n
    for n in sorted(have, reverse=True):           # more than the window is left: fill with long documents first
        if rest > 4 * window:
            extra = min(have[n] - take[n], (rest - window) // n)
            if extra > 0:
                take[n] += extra
                rest -= extra * n
    for n, k in _subset_sum({n: have[n] - take[n] for n in have if have[n] > take[n]}, rest).items():
        take[n] += k
    return [take.get(int(n), 0) if n > 0 else 0 for n in lengths]


def _subset_sum(free: dict[int, int], budget: int) -> dict[int, int]:
    """Bounded knapsack on a bit set of reachable sums; the largest sum not above ``budget``."""
    if budget <= 0:
        return {}
    mask, reach, steps = (1 << (budget + 1)) - 1, 1, []
    for n in sorted((n for n in free if n <= budget), reverse=True):
        left, k = min(free[n], budget // n), 1
        while left > 0:                            # k, 2k, 4k ... copies at once
            m = min(k, left)
            after = (reach | (reach << (n * m))) & mask
            if after != reach:
                steps.append((n, m, reach))
                reach = after
            left, k = left - m, k * 2
        if reach >> budget & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for n, m, before in reversed(steps):
        if not before >> at & 1:
            out[n] = out.get(n, 0) + m
            at -= n * m
    return out


def _fit_source(g: pd.DataFrame) -> pd.DataFrame:
    source_size, target = int(g["source_size"].iloc[0]), float(g["target"].iloc[0])
    goal = int(round(target))
    whole = min(goal // source_size, MAX_REPEAT) if source_size else 0
    g = g.sort_values("size")
    # one more copy of some documents; where that leaves a gap (a document larger than it), yet another of some
    sizes, counts, rest, passes = g["size"].tolist(), g["n"].tolist(), goal - whole * source_size, []
    for _ in range(MAX_REPEAT - whole):
        passes.append(fit_lengths(sizes, counts, rest))
        rest -= sum(n * k for n, k in zip(sizes, passes[-1]))
    return pd.DataFrame({"skey": g["skey"], "size": g["size"], "whole": whole, "extra": list(zip(*passes)) if passes else [()] * len(g),
                         "source_size": source_size, "target": target})


SALTS = 256


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: Sequence[float] = WEIGHTS, share: float = 1.0, seed: int = SEED) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken (words, repeats counted)."""
    prepare(docs.sparkSession)
    sized = materialise(docs.select(
        F.col(id_col).alias("doc_id"), _source_key(source_col).alias("skey"), F.col(source_col).cast("string").alias("source"),
        word_count(text_col).alias("size")))
    plan = _plan(sized.groupBy("skey", "source", "size").agg(F.count(F.lit(1)).alias("n")), weights, share)
    ranked = salted_rank(sized.select("doc_id", "skey", "size"), ["skey", "size"], [F.col("doc_id")], "nth", seed)
    return ranked.join(plan, ["skey", "size"]).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * _repeats()).cast("long").alias("taken"))


def _source_key(source_col: str) -> Column:
    source = F.col(source_col).cast("string")
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source))


def _repeats() -> Column:
    """How often the mix takes a document, from the plan of its length and its place among the documents of that length."""
    return F.col("whole") + F.size(F.filter("extra", lambda k: F.col("nth") < k))


def _plan(lengths: DataFrame, weights: Sequence[float], share: float) -> DataFrame:
    """Per source and length: whole repeats of all its documents and further ones of the first few (``lengths``: skey, source, size, n)."""
    totals = lengths.groupBy("skey", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = source_targets(totals, weights, share).select(_source_key("source").alias("skey"), "source_size", "target")
    # One group per source holds its length histogram: a row per distinct length, not per document.
    plan = (
        lengths.select("skey", "size", "n").join(targets, "skey")
        .groupBy("skey").applyInPandas(_fit_source, "skey string, size long, whole long, extra array<long>, source_size long, target double")
    )
    return materialise(plan)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    weights: Sequence[float] = WEIGHTS, share: float = 1.0, seed: int = SEED) -> DataFrame:
    """The mix itself: the input's rows and columns, each repeated as often as the mix takes it.

    Documents of size 0 cost no words and stay once.  Every row is decided on
    its own: rows that share an id, or have none, are told apart by their
    content, and equal rows are interchangeable.
    """
    spark = docs.sparkSession
    prepare(spark)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.col(id_col).alias("_id"), _source_key(source_col).alias("skey"), F.col(source_col).cast("string").alias("source"),
                       word_count(text_col).alias("size"), whole.alias("_doc"))
    # places in a seeded order, numbered apart in SALTS buckets; rows without an id take theirs by their content
    rows = rows.withColumn("_tie", F.xxhash64("_doc"))
    rows = rows.withColumn("_h", F.when(F.col("_id").isNull(), F.xxhash64(F.lit(seed), "_tie")).otherwise(F.xxhash64(F.lit(seed), "_id")))
    rows = rows.withColumn("_b", F.pmod("_h", F.lit(SALTS)).cast("int"))
    counts = materialise(rows.groupBy("skey", "source", "size", "_b").agg(F.count(F.lit(1)).alias("c")))
    plan = _plan(counts.groupBy("skey", "source", "size").agg(F.sum("c").alias("n")), weights, share)
    prior = Window.partitionBy("skey", "size").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    decided = counts.withColumn("_o", F.coalesce(F.sum("c").over(prior), F.lit(0))).drop("source", "c").join(plan, ["skey", "size"])
    inside = Window.partitionBy("skey", "size", "_b").orderBy("_h", "_id", "_tie")
    taken = rows.drop("source").join(decided, ["skey", "size", "_b"]).withColumn("nth", F.col("_o") + F.row_number().over(inside) - 1)
    taken = taken.withColumn("_times", F.when(F.col("size") > 0, _repeats()).otherwise(1).cast("int"))
    return taken.where("_times > 0").select("_doc", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_doc.*")
