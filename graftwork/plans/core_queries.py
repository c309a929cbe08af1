"""Queries of the general problems: packed fields and nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graftwork.operators.packed import unpack
from graftwork.operators.shred import children_of_artifacts
from graftwork.session import table

PACKED = ["prefer_cat3_topk", "prefer_brand_topk", "seq_click_cat3_48h", "order_goods_id_list_topn"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per value of the four packed list columns; re-sent snapshots count once."""
    states = table(spark, sf_dir, "user_state").select("state_id", *PACKED).dropDuplicates(["state_id"])
    return unpack(states, ["state_id"], PACKED)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per child of the nested payloads."""
    return children_of_artifacts(table(spark, sf_dir, "artifact_log"), "record_id", "request_id", "payload")


QUERIES = {"p1_found": p1_found, "p4_found": p4_found}
ORACLES: dict[str, str] = {}
