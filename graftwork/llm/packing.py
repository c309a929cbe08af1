"""Fixed-capacity containers filled with items of varying length, with little room left over.

Items larger than a container are cut at the capacity; full pieces are containers of their own, so only such items are
divided. Everything else is spread by hash over shards of about ``SHARD`` items, whose number grows with the data, and
each shard is packed by the sum-of-squares rule, largest items first: an item goes where the sum, over all gaps, of the
squared number of open containers with that gap becomes smallest. Shards are independent; each leaves at most a few
containers partly open, which at their size costs a few thousandths of the room.

Defined cases: an item without size (null or empty text) needs no container and has a null one; an id that is repeated
counts once, with its largest size; an item of exactly the capacity is one whole piece; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graftwork.session import cut, spread

SHARD = 20_000


def token_counts(df: DataFrame, id_col: str, text_col: str, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """(id, n_tokens) of every text by a byte-level BPE tokenizer; null and empty texts have none."""
    shared = df.sparkSession.sparkContext.broadcast((ranks, pattern))  # as large as the vocabulary

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        merges, words = shared.value
        encoding = tiktoken.Encoding("own", pat_str=words, mergeable_ranks=merges, special_tokens={})
        for pdf in batches:
            sizes = [len(encoding.encode_ordinary(t)) if t else 0 for t in pdf.text]
            yield pd.DataFrame({"id": pdf.id, "n_tokens": np.array(sizes, np.int64)})

    kind = dict(df.dtypes)[id_col]
    return spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id").mapInPandas(
        count, f"id {kind}, n_tokens long"
    )


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container number of each item, in the given order; sizes are 1 to capacity."""
    count = np.zeros(capacity + 1, np.int64)  # open containers by gap
    members: dict[int, list[int]] = {}
    out = np.empty(len(sizes), np.int64)
    used = 0
    for i, s in enumerate(sizes.tolist()):
        gaps = np.flatnonzero(count[s:capacity]) + s
        change, gap = (2 * count[capacity - s] + 1 if s < capacity else 0), capacity
        if len(gaps):
            delta = 2 * (count[gaps - s] - count[gaps]) + 2
            if gaps[0] == s:  # a perfect fit closes the container
                delta[0] = 1 - 2 * count[s]
            best = int(np.argmin(delta))
            if delta[best] <= change:
                gap = int(gaps[best])
        if gap == capacity:
            at, used = used, used + 1
        else:
            at = members[gap].pop()
            count[gap] -= 1
        out[i] = at
        if gap > s:
            members.setdefault(gap - s, []).append(at)
            count[gap - s] += 1
    return out


def _packed(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["n", "id", "piece_no"], ascending=[False, True, True], kind="stable")
    at = sum_of_squares(pdf.n.to_numpy(), int(pdf.capacity.iloc[0]))
    return pdf.assign(container=[f"{s}-{b}" for s, b in zip(pdf.shard, at)]).drop(columns=["shard", "capacity"])


def pack(items: DataFrame, id_col: str, size_col: str, capacities: dict[int, int], shard: int = SHARD) -> DataFrame:
    """(limit_id, container, id, piece_no, first, n): where each piece of each item goes, for every capacity.

    A piece holds the n units of its item from number ``first``; pieces and units count from 0."""
    sized = items.groupBy(F.col(id_col).alias("id")).agg(F.coalesce(F.max(size_col), F.lit(0)).cast("long").alias("size"))
    limits = F.array(*[F.struct(F.lit(k).alias("limit_id"), F.lit(int(c)).alias("capacity")) for k, c in capacities.items()])
    each = sized.select("id", "size", F.inline(limits))
    last = F.greatest(F.ceil(F.col("size") / F.col("capacity")), F.lit(1)).cast("int") - 1
    pieces = each.select("limit_id", "capacity", "id", "size", F.explode(F.sequence(F.lit(0), last)).alias("piece_no"))
    first: Column = F.col("piece_no").cast("long") * F.col("capacity")
    pieces = pieces.select(
        "limit_id", "capacity", "id", "piece_no", first.alias("first"), F.least("size", first + F.col("capacity")).alias("end")
    ).withColumn("n", F.col("end") - F.col("first"))
    pieces = cut(pieces.drop("end"))
    part = pieces.filter((F.col("n") > 0) & (F.col("n") < F.col("capacity")))
    counts = {r.limit_id: r.rows for r in part.groupBy("limit_id").agg(F.count("*").alias("rows")).collect()}
    shards = F.lit(1)
    for k, rows in counts.items():
        shards = F.when(F.col("limit_id") == k, F.lit(-(-rows // shard))).otherwise(shards)
    out = "limit_id int, id {}, piece_no int, first long, n long, container string".format(dict(sized.dtypes)["id"])
    placed = (
        part.withColumn("shard", F.pmod(F.xxhash64("id", "piece_no", "limit_id"), shards))
        .groupBy("limit_id", "shard")
        .applyInPandas(_packed, out)
    )
    columns = ["limit_id", "container", "id", "piece_no", "first", "n"]
    whole = pieces.filter(F.col("n") == F.col("capacity")).withColumn(
        "container", F.concat_ws("-", F.lit("full"), "id", "piece_no")
    )
    none = pieces.filter(F.col("n") == 0).withColumn("container", F.lit(None).cast("string"))
    return placed.select(columns).unionByName(whole.select(columns)).unionByName(none.select(columns))
