"""Cohort baselines with a ladder of ever wider keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ladder_baseline(trials: DataFrame, baseline: DataFrame, scope: list[str], ladder: list[list[str]], value: str) -> DataFrame:
    """``trials`` with the baseline mean and count of the first level of the ladder that has any baseline row.

    Adds level (from 0, -1 if no level has one), baseline_mean and baseline_n. ``scope`` belongs to every level; an empty
    level is the whole scope. The baseline is aggregated before each join, so a join adds at most one row per trial."""
    out = trials
    for i, keys in enumerate(ladder):
        means = baseline.groupBy(*scope, *keys).agg(F.avg(value).alias(f"_m{i}"), F.count(value).alias(f"_n{i}"))
        out = out.join(means.filter(F.col(f"_n{i}") > 0), [*scope, *keys], "left")
    n = len(ladder)
    hit = lambda i: F.col(f"_n{i}").isNotNull()
    level = reduce(lambda acc, i: acc.when(hit(i), F.lit(i)), range(1, n), F.when(hit(0), F.lit(0))).otherwise(F.lit(-1))
    return out.select(
        *trials.columns,
        level.alias("level"),
        F.coalesce(*[F.col(f"_m{i}") for i in range(n)]).alias("baseline_mean"),
        F.coalesce(*[F.col(f"_n{i}") for i in range(n)], F.lit(0)).alias("baseline_n"),
    )
