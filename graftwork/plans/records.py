"""Queries for record handling: lifted fields, replaced records, enumerations, rules and line slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftwork.functions.text import first_rule, mapped, overlaps_or_any
from graftwork.plans.review import J, documents, judgments
from graftwork.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(
    """with a as (select distinct record_id, payload from artifact_log), v as (select record_id, payload from a where json_valid(payload))
    select record_id, coalesce(json_extract_string(payload, '$.scenario_id'), json_extract_string(payload, '$.metadata.scenario_id'), json_extract_string(payload, '$.scenario.scenario_id')) as scenario_id,
      coalesce(json_extract_string(payload, '$.request_id'), json_extract_string(payload, '$.metadata.request_id'), json_extract_string(payload, '$.scenario.request_id')) as request from v"""
)
def metadata_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF12, PF11, SC22: fields of a record at its top, or lifted from the object that wraps it."""
    a = table(spark, sf_dir, "artifact_log").select("record_id", "payload").distinct()
    v = a.select("record_id", F.try_parse_json("payload").alias("v")).filter("v is not null")
    lift = lambda f: F.coalesce(*[F.try_variant_get("v", f"$.{p}{f}", "string") for p in ("", "metadata.", "scenario.")])
    return v.select("record_id", lift("scenario_id").alias("scenario_id"), lift("request_id").alias("request"))


@query(
    """with a as (select distinct record_id, request_id, node_id, attempt, payload from artifact_log), r as (select *, coalesce(json_valid(payload), false) as ok from a),
    b as (select request_id, node_id, min(record_id) as record_id from r where attempt = 1 group by 1, 2),
    n as (select request_id, node_id, max(record_id) as record_id from r where attempt > 1 and ok group by 1, 2)
    select *, false as rerun from b where (request_id, node_id) not in (select (request_id, node_id) from n) union all select *, true from n"""
)
def rerun_replaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST5, RL3, JN10: first attempts and good reruns together, a rerun replacing its first attempt."""
    a = table(spark, sf_dir, "artifact_log").select("record_id", "request_id", "node_id", "attempt", "payload").distinct()
    r = a.withColumn("ok", F.try_parse_json("payload").isNotNull())
    slot = ["request_id", "node_id"]
    first = r.filter("attempt = 1").groupBy(*slot).agg(F.min("record_id").alias("record_id"))
    again = r.filter("attempt > 1 and ok").groupBy(*slot).agg(F.max("record_id").alias("record_id"))
    kept = first.join(again, slot, "left_anti").withColumn("rerun", F.lit(False))
    return kept.unionByName(again.withColumn("rerun", F.lit(True)))


_SURFACE = ["publishable_copy", "product_value_visible"]


@query(
    J
    + f"""select decision, coalesce(len(failure_tags), 0) = 0 or list_has_any(failure_tags, {_SURFACE}) as matches, count(*) as n,
      coalesce(array_to_string(list_sort(list_distinct(flatten(list(failure_tags)))), ','), '') as tags from j group by 1, 2"""
)
def surface_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF15, PF16, PF18, ST4: lists that are empty or share a member with the wanted ones, and the union of their members."""
    j = judgments(spark, sf_dir, "decision", "failure_tags")
    match = overlaps_or_any(F.col("failure_tags"), _SURFACE)
    tags = j.select("judgment_id", "decision", match.alias("matches"), F.explode_outer("failure_tags").alias("tag"))
    return tags.groupBy("decision", "matches").agg(
        F.count_distinct("judgment_id").alias("n"), F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags")
    )


@query(
    """with s as (select distinct state_id, gender, city_level, age, vip_level from user_state)
    select state_id, case gender when 1 then '男' when 2 then '女' end as gender, case when vip_level in ('金卡会员', '白金卡会员') then vip_level end as vip,
      case when age is not null then least(greatest(age, 0), 100) end as age from s"""
)
def humanized_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX6, NM14, PF3, PF32: codes as words, an allow-list, and clipped numbers; all of them parameters."""
    s = table(spark, sf_dir, "user_state").select("state_id", "gender", "vip_level", "age").distinct()
    vip = F.when(F.col("vip_level").isin("金卡会员", "白金卡会员"), F.col("vip_level"))
    age = F.when(F.col("age").isNotNull(), F.least(F.greatest("age", F.lit(0)), F.lit(100)))
    return s.select("state_id", mapped(F.col("gender"), {1: "男", 2: "女"}).alias("gender"), vip.alias("vip"), age.alias("age"))


#: Classes of errors and what their text holds, in the order in which they are tried; those worth a retry.
_RULES = [
    ("rate_limit", "rate limit|rate_limit|429"),
    ("auth", "401|402|403|insufficient balance|payment required|authentication|permission"),
    ("transient_provider", "timeout|deadline|connection reset|peer closed|chunked read|temporarily unavailable|502|503|504"),
    ("provider_response", "json"),
]
_RETRYABLE = ["rate_limit", "transient_provider", "provider_response"]


@query(
    "with k as (select kind, case "
    + " ".join(f"when regexp_matches(lower(text), '{p}') then '{name}'" for name, p in _RULES)
    + f" else 'unknown' end as category from documents) select kind, category, category in {tuple(_RETRYABLE)} as retryable, count(*) as n from k group by 1, 2"
)
def error_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX22, RL2: the class of a text by the first rule whose pattern it holds, and whether it is worth a retry."""
    d = documents(spark, sf_dir)
    k = d.groupBy("kind", first_rule(F.lower("text"), _RULES, "unknown").alias("category")).agg(F.count("*").alias("n"))
    return k.select("kind", "category", F.col("category").isin(*_RETRYABLE).alias("retryable"), "n")


@query(
    """with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from documents where text is not null)
    select doc_id, cast(line_no as integer) as line_no, line from l where line_no between 2 and 4"""
)
def line_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC16: numbered lines of texts, a slice of each (the slice is the feature)."""
    lines = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    return lines.select("doc_id", (F.col("at") + 1).alias("line_no"), "line").filter("line_no between 2 and 4")
