"""The N highest-scoring members of every group, exactly and in a fixed order, for groups of any size.

A histogram of scores per group (partial counts are combined before the shuffle, so a group costs at most one row per
bin and task) gives the highest bin above which N rows lie; only rows from that bin on are ranked exactly. Bins follow
the score's binary exponent and cut each doubling into equal steps, so no range is needed and one extreme score does not
widen the bins of the others. The thresholds are joined back with a salt, so a group that holds a third of all rows is
spread over tasks, and ranking starts with a limit inside each task before rows meet.

Defined cases: null and NaN scores and null groups are left out; equal scores go by the tie columns, ascending; groups
with fewer than N rows give all; rows equal in group, score and ties keep one place each; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graftwork.session import cut


def score_bin(score: Column, steps: int) -> Column:
    """A number that never falls as the score rises: its binary exponent, and which of ``steps`` its fraction is in. Where
    the logarithm is off by one at a power of two, the fraction makes up for it."""
    size = F.abs(score)
    exponent = F.floor(F.log2(size))
    place = (exponent + 1200) * steps + F.floor((size / F.pow(F.lit(2.0), exponent) - 1) * steps)
    place = F.when(size == 0, F.lit(0).cast("long")).when(size == float("inf"), F.lit(2400 * steps).cast("long")).otherwise(place)
    return F.when(score < 0, -place).otherwise(place)


def top_n(
    df: DataFrame, group: list[str], score: str, ties: list[str], n: int, steps: int = 64, salts: int = 16
) -> DataFrame:
    """The rows of ``df``, which are written once and so should hold no more columns than needed, with ``rank_no``
    1..n by ``score`` (high first) and ``ties`` (small first) per ``group``."""
    rows = df.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    for g in group:
        rows = rows.filter(F.col(g).isNotNull())
    rows = cut(rows.withColumn("_bin", score_bin(F.col(score).cast("double"), steps)))  # read by histogram and ranking
    above = Window.partitionBy(*group).orderBy(F.desc("_bin"))
    counts = rows.groupBy(*group, "_bin").agg(F.count("*").alias("_n"))
    thresholds = (
        counts.withColumn("_above", F.sum("_n").over(above) - F.col("_n"))
        .filter(F.col("_above") < n)
        .groupBy(*group)
        .agg(F.min("_bin").alias("_least"))
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    order = [F.desc(score), *[F.asc(t) for t in ties]]
    kept = (
        rows.withColumn("_salt", F.pmod(F.xxhash64(*ties), F.lit(salts)).cast("int"))
        .join(thresholds, [*group, "_salt"])
        .filter(F.col("_bin") >= F.col("_least"))
        .drop("_bin", "_least", "_salt")
    )
    ranked = kept.withColumn("rank_no", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.filter(F.col("rank_no") <= n)
