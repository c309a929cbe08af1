"""Streams over append-only folders; every form gives what its batch form gives, however late rows come.

Each run reads what is new since its checkpoint (``availableNow``) and writes to the shared folder; a run with the same
folder goes on where the last one ended. Counts and sums keep no state: a batch writes its own partial rows, and a read
merges them, so nothing is rewritten and a late row is one more partial row. A batch that is sent again after a failure
overwrites itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from graftwork.session import work_folder


def source(spark: SparkSession, folder: str, name: str, per_batch: int = 1000) -> DataFrame:
    """The parquet files of table ``name`` in ``folder`` as a stream."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", per_batch)
        .option("pathGlobFilter", "*.parquet")
        .parquet(path if _is_folder(spark, path) else f"{folder}/{name}.parquet*")
    )


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def _run(spark: SparkSession, stream: DataFrame, at: str | None, partial: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Runs an append-only stream to its end: all rows that its batches wrote, each batch put through ``partial``."""
    at = at or work_folder(spark, "stream")
    kind: dict = {}

    def write(batch: DataFrame, number: int) -> None:
        rows = partial(batch) if partial else batch
        kind["schema"] = rows.schema
        rows.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    query = (
        stream.writeStream.outputMode("append")
        .option("checkpointLocation", f"{at}/state")
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
    written = spark.read.option("basePath", f"{at}/out")
    if "schema" not in kind:  # nothing new
        return written.parquet(f"{at}/out/batch=*").drop("batch")
    return written.schema(kind["schema"]).parquet(f"{at}/out/batch=*").drop("batch")


def fold_stream(spark: SparkSession, events: DataFrame, key: str, success: Column, at: str | None = None) -> DataFrame:
    """(key, successes, failures, entries) of the journal so far."""

    def partial(batch: DataFrame) -> DataFrame:
        return batch.groupBy(key).agg(
            F.count_if(success).alias("successes"), F.count_if(~success).alias("failures"), F.count("*").alias("entries")
        )

    parts = _run(spark, events, at, partial)
    return parts.groupBy(key).agg(*[F.sum(c).alias(c) for c in ("successes", "failures", "entries")])


def windowed_stream(
    spark: SparkSession, events: DataFrame, time: str, width: str, keys: list[str], value: str, at: str | None = None
) -> DataFrame:
    """(start, keys..., n, total) per tumbling window; late rows count."""

    def partial(batch: DataFrame) -> DataFrame:
        window = F.window(F.col(time).cast("timestamp"), width).alias("w")
        counted = batch.groupBy(window, *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
        return counted.select(F.col("w.start").alias("start"), *keys, "n", "total")

    parts = _run(spark, events, at, partial)
    return parts.groupBy("start", *keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def ledger_stream(spark: SparkSession, events: DataFrame, key: str, at: str | None = None) -> DataFrame:
    """The rows without those re-sent: each key once, however late its rows come.

    The keys seen so far are state in the shared checkpoint folder, and stay there."""
    return _run(spark, events.dropDuplicates([key]), at)


def gate_stream(spark: SparkSession, events: DataFrame, key: str, threshold: int, at: str | None = None) -> DataFrame:
    """(key, emission, size): rows of a key wait until ``threshold`` of them are there; then they are let go together and
    the count starts anew. What waits is state: two numbers a key. Rows of a key come in batches of bounded size."""
    kind = events.schema[key].dataType.simpleString()

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, let_go = state.get if state.exists else (0, 0)
        waiting += sum(len(b) for b in batches)
        n = waiting // threshold
        state.update((waiting - n * threshold, let_go + n))
        yield pd.DataFrame({key: [k[0]] * n, "emission": range(let_go + 1, let_go + n + 1), "size": [threshold] * n})

    emitted = events.select(key).groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, emission long, size long", "waiting long, let_go long", "append", GroupStateTimeout.NoTimeout
    )
    return _run(spark, emitted, at)
