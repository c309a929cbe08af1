"""Beliefs about variants: folding an append-only journal of outcomes and merging related rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftwork.operators.ordering import numbered
from graftwork.session import cut


def fold_journal(portfolio: DataFrame, journal: DataFrame, key: str, success: str, cost: str) -> DataFrame:
    """``portfolio`` with alpha and beta raised by successes and failures, and the sums of trials and cost.

    The order of entries does not matter, so the fold is one aggregate; entries of unknown keys are ignored, null
    outcomes too."""
    outcomes = journal.filter(F.col(success).isNotNull()).groupBy(key).agg(
        F.count_if(F.col(success)).alias("_s"),
        F.count_if(~F.col(success)).alias("_f"),
        F.sum(cost).alias("_c"),
    )
    zero = F.lit(0)
    joined = portfolio.join(outcomes, key, "left")
    return joined.select(
        *[c for c in portfolio.columns if c not in ("alpha", "beta")],
        (F.col("alpha") + F.coalesce("_s", zero)).alias("alpha"),
        (F.col("beta") + F.coalesce("_f", zero)).alias("beta"),
        (F.coalesce("_s", zero) + F.coalesce("_f", zero)).alias("trials"),
        F.coalesce("_c", zero).alias("cost"),
    )


def merge_clusters(df: DataFrame, key: str, order: str, union: str, sums: list[str]) -> DataFrame:
    """(key, union, place, first_row, members, sums...): the members of each cluster's ordered union, numbered by their
    first sighting. Clusters may be few and large, so numbers come from a range of all rows, not from a task a cluster."""
    firsts = df.groupBy(key, union).agg(F.min(order).alias("first_row"), F.count("*").alias("members"), *[F.sum(c).alias(c) for c in sums])
    rows = cut(numbered(firsts, [key, "first_row", union], "_n"))
    begins = rows.groupBy(F.col(key).alias("_key")).agg(F.min("_n").alias("_begin"))
    joined = rows.join(begins, F.col(key).eqNullSafe(F.col("_key")))
    return joined.select(key, union, (F.col("_n") - F.col("_begin") + 1).alias("place"), "first_row", "members", *sums)
