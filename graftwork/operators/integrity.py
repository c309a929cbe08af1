"""Reference, coverage and consistency checks as joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unknown_references(child: DataFrame, parent: DataFrame, column: str, key: str) -> DataFrame:
    """Rows of ``child`` whose non-null ``column`` is no ``key`` of ``parent``."""
    known = parent.select(F.col(key).alias("_k")).distinct()
    return child.filter(F.col(column).isNotNull()).join(known, F.col(column) == F.col("_k"), "left_anti")


def coverage(expected: DataFrame, actual: DataFrame, group: str, member: str) -> DataFrame:
    """(group, missing, extra): members expected and not there, and there and not expected, sorted and joined by commas."""
    e = expected.select(group, member).distinct().withColumn("_e", F.lit(1))
    a = actual.select(group, member).distinct().withColumn("_a", F.lit(1))
    both = e.join(a, [group, member], "full").filter("_e is null or _a is null")
    listed = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(F.col(c).isNull(), F.col(member)))), ",")
    return both.groupBy(group).agg(listed("_a").alias("missing"), listed("_e").alias("extra"))


def repeated_keys(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(source, rows, keys, repeated): rows, distinct keys and keys on several rows of each table."""

    def one(name: str, df: DataFrame, key: str) -> DataFrame:
        per_key = df.groupBy(key).agg(F.count("*").alias("n"))
        return per_key.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
            F.count("*").alias("keys"),
            F.count_if(F.col("n") > 1).alias("repeated"),
        ).select(F.lit(name).alias("source"), "rows", "keys", "repeated")

    return reduce(DataFrame.unionByName, [one(n, df, k) for n, (df, k) in tables.items()])


def nested(parents: DataFrame, children: DataFrame, keys: list[str], order: str, label: str) -> DataFrame:
    """(keys..., n, labels): each parent's children in order, joined by commas; parents without children stay, with 0."""
    grouped = children.groupBy(*keys).agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(order, label))).alias("_c")
    )
    return parents.join(grouped, keys, "left").select(
        *keys,
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce(F.array_join(F.transform("_c", lambda x: x[label]), ","), F.lit("")).alias("labels"),
    )
