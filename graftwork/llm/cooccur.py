"""Items that appear together more often than chance: exact pair counts and lift over all baskets.

Heavy-light decomposition. At most ``heavy`` items, the most frequent ones, get a column of a bit matrix; each task packs
its baskets into it and counts pairs of heavy items by popcounts of and-ed columns. Pairs of rare items are counted by
hash, each basket giving its own pairs. For mixed pairs a rare item's list of baskets is probed against the bit rows of
those baskets, a batch of baskets at a time; the counts of batches are summed. Items that cannot reach the wanted support or lift are dropped first, which loses no pair: a pair occurs at
most as often as its rarer item, so lift >= l needs n(x) <= N / l for both.

Defined cases: null and void ids are no items; an id counts once a basket; baskets without items do not count; an empty
table gives no pairs. Broadcast: the heavy items only, at most ``heavy`` rows. No other item holds more than 1 / ``heavy``
of all memberships, so the joins on rare items need no salt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftwork.session import cut

HEAVY = 256
_BLOCK = 1 << 16


def _popcounts(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    """Counts of pairs of columns over the baskets of one task; a block of bits at a time, one result."""
    total = np.zeros((width, width), np.int64)

    def add(lists: list[np.ndarray]) -> None:
        bits = np.zeros((width, -(-len(lists) // 64) * 64), bool)
        bits[np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])] = True
        words = np.packbits(bits, axis=1).view(np.uint64)
        for i in range(width - 1):
            total[i, i + 1 :] += np.bitwise_count(words[i] & words[i + 1 :]).sum(axis=1, dtype=np.int64)

    held: list[np.ndarray] = []
    for pdf in batches:
        held.extend(pdf.hs)
        while len(held) >= _BLOCK:
            add(held[:_BLOCK])
            held = held[_BLOCK:]
    if held:
        add(held)
    i, j = np.nonzero(total)
    yield pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32), "n_ab": total[i, j]})


def _probed(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    """(x, i, n) of rare item x and heavy item i, a batch of baskets at a time."""
    for pdf in batches:
        heavy = np.zeros((len(pdf), width), bool)
        heavy[np.repeat(np.arange(len(pdf)), [len(h) for h in pdf.hs]), np.concatenate([*pdf.hs, np.zeros(0, np.int64)]).astype(int)] = True
        names, code = np.unique(np.concatenate([*pdf.ls, np.zeros(0, object)]).astype(str), return_inverse=True)
        row = np.repeat(np.arange(len(pdf)), [len(x) for x in pdf.ls])
        order = np.argsort(code, kind="stable")  # the lists of baskets, one after the other
        begins = np.searchsorted(code[order], np.arange(len(names)))
        if not len(names):
            continue
        for at in range(0, len(names), 4096):  # so many lists at a time that their bit rows stay small
            upto = begins[at + 4096] if at + 4096 < len(names) else len(order)
            own = begins[at : at + 4096]
            counts = np.add.reduceat(heavy[row[order[own[0] : upto]]], own - own[0], axis=0, dtype=np.int64)
            x, i = np.nonzero(counts)
            yield pd.DataFrame({"x_a": names[at + x], "i": i.astype(np.int32), "n_ab": counts[x, i]})


def lifted_pairs(
    baskets: DataFrame, key: str, items: str, min_count: int = 5, min_lift: float | None = None, heavy: int = HEAVY
) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, baskets, lift) with item_a < item_b, n_ab >= min_count and, where given,
    n_ab * N >= min_lift * n_a * n_b. ``items`` is an array of text, one row per basket."""
    full = baskets.select(F.col(key).alias("k"), F.array_distinct(F.array_compact(F.col(items))).alias("xs"))
    full = cut(full.filter(F.size("xs") > 0))
    total = full.count()
    counts = full.select(F.explode("xs").alias("x")).groupBy("x").agg(F.count("*").alias("n"))
    counts = counts.filter(F.col("n") >= min_count)
    if min_lift is not None:
        counts = counts.filter(F.col("n") * F.lit(min_lift) <= total)
    counts = cut(counts)
    top = counts.orderBy(F.desc("n"), "x").limit(heavy).collect()  # at most ``heavy`` rows
    spark = baskets.sparkSession
    named = spark.createDataFrame([(i, r.x, r.n) for i, r in enumerate(top)], "i int, x string, n long")
    rare = counts.join(F.broadcast(named.select("x")), "x", "left_anti")

    members = full.select("k", F.explode("xs").alias("x"))
    hot = members.join(F.broadcast(named.select("x", "i")), "x").select("k", "i", F.lit(None).cast("string").alias("x"))
    cold = (
        members.join(F.broadcast(named.select("x")), "x", "left_anti")
        .join(rare.select("x"), "x")
        .select("k", F.lit(None).cast("int").alias("i"), "x")
    )
    split = cut(
        hot.unionByName(cold)
        .groupBy("k")
        .agg(F.array_sort(F.collect_list("i")).alias("hs"), F.array_sort(F.collect_list("x")).alias("ls"))
    )

    width = max(len(top), 1)
    hh = (
        split.filter(F.size("hs") > 1)
        .select("hs")
        .mapInPandas(lambda it: _popcounts(it, width), "i int, j int, n_ab long")
        .groupBy("i", "j")
        .agg(F.sum("n_ab").alias("n_ab"))
        .filter(F.col("n_ab") >= min_count)
    )
    side = lambda i, s: F.broadcast(
        named.select(F.col("i").alias(i), F.col("x").alias(f"x_{s}"), F.col("n").alias(f"n_{s}"))
    )
    hh = hh.join(side("i", "a"), "i").join(side("j", "b"), "j").select("x_a", "x_b", "n_a", "n_b", "n_ab")

    ll = (
        split.filter(F.size("ls") > 1)
        .select("ls", F.posexplode("ls").alias("p", "x_a"))
        .select("x_a", F.explode(F.slice("ls", F.col("p") + 2, F.size("ls"))).alias("x_b"))
        .groupBy("x_a", "x_b")
        .agg(F.count("*").alias("n_ab"))
        .filter(F.col("n_ab") >= min_count)
    )
    n_of = lambda s: rare.select(F.col("x").alias(f"x_{s}"), F.col("n").alias(f"n_{s}"))
    ll = ll.join(n_of("a"), "x_a").join(n_of("b"), "x_b").select("x_a", "x_b", "n_a", "n_b", "n_ab")

    hl = (
        split.filter((F.size("ls") > 0) & (F.size("hs") > 0))
        .select("ls", "hs")
        .mapInPandas(lambda it: _probed(it, width), "x_a string, i int, n_ab long")
        .groupBy("x_a", "i")
        .agg(F.sum("n_ab").alias("n_ab"))
        .filter(F.col("n_ab") >= min_count)
        .join(n_of("a"), "x_a")
        .join(side("i", "b"), "i")
        .select("x_a", "x_b", "n_a", "n_b", "n_ab")
    )
    first = F.col("x_a") < F.col("x_b")
    out = hh.unionByName(ll).unionByName(hl).select(
        F.least("x_a", "x_b").alias("item_a"),
        F.greatest("x_a", "x_b").alias("item_b"),
        "n_ab",
        F.when(first, F.col("n_a")).otherwise(F.col("n_b")).alias("n_a"),
        F.when(first, F.col("n_b")).otherwise(F.col("n_a")).alias("n_b"),
        F.lit(total).cast("long").alias("baskets"),
    )
    wide = "decimal(20,0)"
    observed, chance = F.col("n_ab").cast(wide) * F.lit(total).cast("decimal(18,0)"), F.col("n_a").cast(wide) * F.col(
        "n_b"
    ).cast("decimal(18,0)")
    out = out.withColumn("lift", observed.cast("double") / chance.cast("double"))
    if min_lift is not None:
        out = out.filter(observed >= chance * F.lit(min_lift).cast("decimal(10,4)"))
    return out
