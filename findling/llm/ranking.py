"""One ranking from scores of different scales.

A score is standardised within its group by median and median absolute deviation, squashed by the logistic
function, so that no outlier counts more than nearly 1, and floored where it is missing. Flags take one of
two fixed values. The combined score is the weighted geometric mean: what is to stand high must be good in
all of them. Scores with long tails are taken as logarithms of their positive values first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Value of a score that is missing, and of flags that are set or not.
FLOOR, SET, UNSET = 0.1, 0.9, 0.1
DIGITS = 4


@dataclass(frozen=True)
class Score:
    column: str
    weight: float = 1.0
    log: bool = False
    flag: bool = False
    unset: float = UNSET


RESULT_SCORES = (Score("similarity"), Score("score", log=True), Score("keyword", flag=True), Score("exact", weight=0.3, flag=True, unset=0.4))


def _value(s: Score) -> Column:
    """The score as it is standardised; null if missing."""
    x = F.col(s.column).cast("double")
    x = F.when(~F.isnan(x), x)
    return F.when(x > 0, F.ln(x)) if s.log else x


def combined(rows: DataFrame, group: str, item: str, scores: tuple[Score, ...] = RESULT_SCORES) -> DataFrame:
    """``group, item``, the scores and ``combined`` (0 to 1), one row per group and item.

    Of several rows of an item the greatest value of each score counts. Missing scores, and those not above
    0 where logarithms are taken, get the floor; a missing flag is not set. Where all values of a group are
    equal they are all average. Rows without an item are no items. Medians are taken from counts of values
    rounded to ``DIGITS`` that each task adds up first, so a group of any size fits; what is standardised by
    them is the score itself.
    """
    best = rows.where(F.col(item).isNotNull()).groupBy(group, item).agg(*[F.max(F.col(s.column).cast("int") if s.flag else F.col(s.column)).alias(s.column) for s in scores])
    scaled = [s for s in scores if not s.flag]
    x = best.select("*", *[_value(s).alias(f"__{s.column}") for s in scaled])
    if scaled:
        middle = x.groupBy(group).agg(*[F.percentile(F.round(f"__{s.column}", DIGITS), 0.5).alias(f"__m_{s.column}") for s in scaled])
        near = _same_group(x, middle, group)
        off = {s: F.abs(F.round(f"__{s.column}", DIGITS) - F.col(f"__m_{s.column}")) for s in scaled}
        spread = near.groupBy(group).agg(
            *[F.percentile(F.round(off[s], DIGITS + 2), 0.5).alias(f"__d_{s.column}") for s in scaled],
            *[F.avg(F.round(off[s], DIGITS + 2)).alias(f"__a_{s.column}") for s in scaled],
        )
        x = _same_group(near, spread, group)
    bounded = []
    for s in scores:
        if s.flag:
            bounded.append(F.when(F.col(s.column) == 1, SET).otherwise(s.unset))
            continue
        d, a = F.col(f"__d_{s.column}"), F.col(f"__a_{s.column}")
        unit = F.when(d > 0, d * 1.4826).when(a > 0, a * 1.2533).otherwise(1.0)
        z = (F.col(f"__{s.column}") - F.col(f"__m_{s.column}")) / unit
        bounded.append(F.coalesce(F.greatest(1 / (1 + F.exp(-z)), F.lit(1e-6)), F.lit(FLOOR)))
    total = sum(s.weight for s in scores)
    mean = F.exp(sum((F.ln(b) * s.weight for b, s in zip(bounded[1:], scores[1:])), F.ln(bounded[0]) * scores[0].weight) / total)
    return x.select(group, item, *[F.col(s.column) for s in scores], F.round(mean, 9).alias("combined"))


def _same_group(x: DataFrame, y: DataFrame, group: str) -> DataFrame:
    return x.join(y.withColumnRenamed(group, "__g"), F.col(group).eqNullSafe(F.col("__g"))).drop("__g")


def first_of_groups(ranked: DataFrame, group: str, item: str, k: int) -> DataFrame:
    """The first k items of every group; ties go to the smaller item. Tasks keep k rows before the shuffle."""
    order = Window.partitionBy(group).orderBy(F.desc("combined"), item)
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def full_order(ranked: DataFrame, group: str, item: str, steps: int = 1000) -> DataFrame:
    """Every item with its ``rank`` in its group, from 1.

    Ranks are counted by step of the combined score, so no task sorts more than a step of a group.
    """
    stepped = ranked.withColumn("__step", F.floor((1 - F.col("combined")) * steps))
    counts = stepped.groupBy(group, "__step").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(group).orderBy("__step").rowsBetween(Window.unboundedPreceding, -1)
    offset = counts.select(F.col(group).alias("__g"), F.col("__step").alias("__s"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy(group, "__step").orderBy(F.desc("combined"), item)
    numbered = stepped.withColumn("__r", F.row_number().over(within))
    joined = numbered.join(offset, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__step") == F.col("__s")))
    return joined.withColumn("rank", F.col("__before") + F.col("__r")).drop("__step", "__n", "__g", "__s", "__before", "__r")
