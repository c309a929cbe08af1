"""JSON lines and the serving table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftwork.functions.text import safe_name

SERVING = ["request_id", "user_id", "item_id", "copy"]


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of which each must be readable; a bad line raises when read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_lenient(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; unreadable lines and values that are no objects are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_journal(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_serving(df: DataFrame, path: str) -> None:
    """The four serving columns, as CSV with a header and as JSON lines, in parts."""
    rows = df.select(*[F.col(c).cast("string").alias(c) for c in SERVING])
    as_is = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.write.mode("overwrite").options(header=True, escape='"', **as_is).csv(f"{path}/csv")
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/jsonl")


def write_new(df: DataFrame, path: str) -> None:
    """Refuses a folder that holds something already."""
    df.write.mode("errorifexists").parquet(path)


def inventory(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, size, sha256) of the files of a folder and its subfolders."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def write_evidence(df: DataFrame, path: str) -> None:
    """Records in a folder per node, named fit for paths; a folder per request would be one per few rows."""
    df.withColumn("node_id", safe_name(F.col("node_id"))).write.mode("append").partitionBy("node_id").json(path)
