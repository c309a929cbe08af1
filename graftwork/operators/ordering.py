"""Deduplication, ranks, ordered lists, numbering and samples with an explicit total order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graftwork.session import cut


def one_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order``. Ranking starts inside each task, so a hot key is thinned before it moves."""
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_rn = 1").drop("_rn")


def once(df: DataFrame, key: str, at: str) -> DataFrame:
    """Each key's latest row by ``at``; re-sent rows repeat the whole row, so any of equal ones will do."""
    rows = F.struct(F.col(at).alias("_at"), *[F.col(c) for c in df.columns])
    return df.groupBy(F.col(key).alias("_k")).agg(F.max_by(rows, F.col(at)).alias("_r")).select(
        *[F.col("_r")[c].alias(c) for c in df.columns]
    )


def frequency_text(df: DataFrame, keys: list[str], token: str, order: str, k: int) -> DataFrame:
    """(keys..., summary): ``token(count), ...`` of the k most frequent tokens of each key, ties by first sighting."""
    counted = df.filter(F.col(token).isNotNull()).groupBy(*keys, token).agg(
        F.count("*").alias("_n"), F.min(order).alias("_first")
    )
    place = Window.partitionBy(*keys).orderBy(F.desc("_n"), "_first", token)
    top = counted.withColumn("_rn", F.row_number().over(place)).filter(F.col("_rn") <= k)
    text = F.concat(F.col(token), F.lit("("), F.col("_n").cast("string"), F.lit(")"))
    return top.groupBy(*keys).agg(_joined(F.struct("_rn", text.alias("t"))).alias("summary"))


def rank_text(df: DataFrame, keys: list[str], token: str, order: str, k: int) -> DataFrame:
    """(keys..., summary): ``token(rank=i), ...`` of the first k distinct tokens of each key in order."""
    seen = df.filter(F.col(token).isNotNull()).groupBy(*keys, token).agg(F.min(order).alias("_first"))
    place = Window.partitionBy(*keys).orderBy("_first", token)
    top = seen.withColumn("_rn", F.row_number().over(place)).filter(F.col("_rn") <= k)
    text = F.concat(F.col(token), F.lit("(rank="), F.col("_rn").cast("string"), F.lit(")"))
    return top.groupBy(*keys).agg(_joined(F.struct("_rn", text.alias("t"))).alias("summary"))


def _joined(pair: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda x: x["t"]), ", ")


def numbered(df: DataFrame, order: list[str], name: str = "row_no") -> DataFrame:
    """Rows numbered from 1 in a total order, without bringing them into one task.

    Rows are range-partitioned and written; a number is a row's place in its partition plus the sizes of those before.
    Broadcast: one row per partition."""
    placed = cut(
        df.repartitionByRange(*[F.asc_nulls_last(c) for c in order]).withColumn("_part", F.spark_partition_id())
    )
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(*[F.asc_nulls_last(c) for c in order])
    return (
        placed.withColumn("_rn", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_rn") + F.col("_before"))
        .drop("_part", "_rn", "_before")
    )


def round_robin(df: DataFrame, bucket: list[str], order: str, n: int) -> DataFrame:
    """n rows that take turns over the buckets: first each bucket's first row, then each one's second, and so on;
    buckets come in the order of their first row."""
    first = df.groupBy(*bucket).agg(F.min(order).alias("_seen"))
    turn = Window.partitionBy(*bucket).orderBy(order)
    turns = df.withColumn("_turn", F.row_number().over(turn)).filter(F.col("_turn") <= n)
    same = [turns[b].eqNullSafe(first[b]) for b in bucket]
    joined = turns.join(first, same).select(*[turns[c] for c in df.columns], "_turn", "_seen")
    return joined.orderBy("_turn", "_seen", order).limit(n).drop("_turn", "_seen")


def gated(counts: DataFrame, key: str, wave: str, n: str, threshold: int) -> DataFrame:
    """(key, wave, pending, emitted): a key's pending count grows wave by wave; at the threshold it is emitted and cleared.

    One row per key and wave comes in. A key's waves are folded in order, a batch of them at a time: what is carried from
    batch to batch is one number."""
    kinds = dict(counts.dtypes)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, pending = None, 0
        for pdf in batches:
            out = []
            for k, x in zip(pdf["k"], pdf["n"].tolist()):
                pending = (pending if k == last and pending < threshold else 0) + x
                last = k
                out.append(pending)
            yield pd.DataFrame({"k": pdf["k"], "wave": pdf["wave"], "pending": out, "emitted": [p >= threshold for p in out]})

    rows = counts.select(F.col(key).alias("k"), F.col(wave).alias("wave"), F.col(n).cast("long").alias("n"))
    sorted_rows = rows.repartition("k").sortWithinPartitions("k", "wave")
    folded = sorted_rows.mapInPandas(fold, f"k {kinds[key]}, wave {kinds[wave]}, pending long, emitted boolean")
    return folded.withColumnsRenamed({"k": key, "wave": wave})
