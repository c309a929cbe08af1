"""Queries for reports, ordered projections, sampling, journals and structured documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graftwork.functions.documents import apply_edits, parse_sections, render_sections
from graftwork.operators.ordering import once
from graftwork.plans.list_group import EXPOSURES, exposures
from graftwork.plans.review import C, CJ, EDIT, J, candidates, documents, judgments
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


def _filled(c: str):
    return F.coalesce(F.btrim(c, F.lit(" 　")) != "", F.lit(False))


@query(
    C
    + """, v as (select candidate_id, case when coalesce(trim(text, ' 　'), '') = '' then 'text' when coalesce(trim(product_id, ' 　'), '') = '' then 'product_id'
      when coalesce(trim(commercial_angle, ' 　'), '') = '' then 'commercial_angle' when coalesce(trim(product_binding, ' 　'), '') = '' then 'product_binding'
      when coalesce(trim(fact_binding, ' 　'), '') = '' then 'fact_binding' end as first_missing from c)
    select coalesce(first_missing, 'ok') as reason, first_missing is null as passed, count(*) as n, min(candidate_id) as first_candidate from v group by 1, 2"""
)
def output_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF24, PF26, PF31, AG6: the first field of a candidate that is missing or blank."""
    fields = ["text", "product_id", "commercial_angle", "product_binding", "fact_binding"]
    missing = F.coalesce(*[F.when(~_filled(f), F.lit(f)) for f in fields])
    v = candidates(spark, sf_dir, *fields).select("candidate_id", missing.alias("m"))
    return v.groupBy(F.coalesce("m", F.lit("ok")).alias("reason"), F.col("m").isNull().alias("passed")).agg(
        F.count("*").alias("n"), F.min("candidate_id").alias("first_candidate")
    )


@query(
    C
    + """, o as (select *, row_number() over (partition by request_id order by ord, candidate_id) - 1 as i from c)
    select request_id, i as candidate_index, coalesce(nullif(candidate_id, ''), 'candidate-' || i) as candidate, product_id, length(trim(text, ' 　')) as size from o"""
)
def rubric_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF5, PF6, PF9, TX8: a request's candidates in order with their index; a missing id is made of the index."""
    c = candidates(spark, sf_dir, "request_id", "ord", "product_id", "text")
    i = F.row_number().over(Window.partitionBy("request_id").orderBy("ord", "candidate_id")).cast("long") - 1
    rows = c.withColumn("candidate_index", i)
    fallback = F.concat(F.lit("candidate-"), F.col("candidate_index").cast("string"))
    return rows.select(
        "request_id",
        "candidate_index",
        F.coalesce(F.nullif("candidate_id", F.lit("")), fallback).alias("candidate"),
        "product_id",
        F.length(F.btrim("text", F.lit(" 　"))).cast("long").alias("size"),
    )


@query(
    """with a as (select distinct on (record_id) * from artifact_log), r as (select *, coalesce(json_valid(payload), false) as ok from a)
    select request_id, node_id, cast(count(*) filter (not ok) as bigint) as failures, string_agg(attempt, ',' order by attempt, record_id) filter (not ok) as failed_attempts,
      max(attempt) filter (ok) > max(attempt) filter (not ok) as recovered from r group by 1, 2 having count(*) filter (not ok) > 0"""
)
def failed_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK12, RL3, PF22, PF28: nodes with unreadable attempts, which they were, and whether a later one could be read."""
    a = once(table(spark, sf_dir, "artifact_log"), "record_id", "captured_at")
    ok = F.try_parse_json("payload").isNotNull()
    rows = a.select("request_id", "node_id", "attempt", "record_id", ok.alias("ok"))
    bad = F.collect_list(F.when(~F.col("ok"), F.struct("attempt", "record_id")))
    last = lambda good: F.max(F.when(F.col("ok") == good, F.col("attempt")))
    per = rows.groupBy("request_id", "node_id").agg(
        F.count_if(~F.col("ok")).alias("failures"),
        F.array_join(F.transform(F.array_sort(bad), lambda x: x.attempt.cast("string")), ",").alias("failed_attempts"),
        (last(True) > last(False)).alias("recovered"),
    )
    return per.filter("failures > 0")


@query(
    """with a as (select distinct on (record_id) * from artifact_log)
    select count(*) as records, count(distinct request_id) as requests, cast(count(*) filter (node_id = 'scenario') as bigint) as scenarios,
      cast(count(*) filter (attempt > 1) as bigint) as retries, cast(count(*) filter (payload is null) as bigint) as absent,
      cast(count(*) filter (not coalesce(json_valid(payload), false)) as bigint) as unreadable, max(attempt) as most_attempts from a"""
)
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK8: one row of totals over a run's records."""
    a = table(spark, sf_dir, "artifact_log").select("record_id", "request_id", "node_id", "attempt", "payload")
    return a.dropDuplicates(["record_id"]).agg(
        F.count("*").alias("records"),
        F.count_distinct("request_id").alias("requests"),
        F.count_if(F.col("node_id") == "scenario").alias("scenarios"),
        F.count_if(F.col("attempt") > 1).alias("retries"),
        F.count_if(F.col("payload").isNull()).alias("absent"),
        F.count_if(F.try_parse_json("payload").isNull()).alias("unreadable"),
        F.max("attempt").alias("most_attempts"),
    )


@query(
    J
    + """, k as (select *, case decision when 'reject' then 0 when 'hold' then 1 when 'admit' then 2 else 3 end as priority from j),
    r as (select *, row_number() over (partition by request_id order by priority, judgment_id) as place from k)
    select request_id, judgment_id, priority, cast(place as integer) as place from r where place <= 3"""
)
def severest_first(spark: SparkSession, sf_dir: str, n: int = 3) -> DataFrame:
    """WN11, NM26: a request's judgments, severest decisions first (n is the feature)."""
    order = F.create_map(F.lit("reject"), F.lit(0), F.lit("hold"), F.lit(1), F.lit("admit"), F.lit(2))
    k = judgments(spark, sf_dir, "request_id", "decision").withColumn(
        "priority", F.coalesce(F.try_element_at(order, F.col("decision")), F.lit(3))
    )
    place = F.row_number().over(Window.partitionBy("request_id").orderBy("priority", "judgment_id"))
    return k.withColumn("place", place).filter(F.col("place") <= n).select("request_id", "judgment_id", "priority", "place")


@query(
    EXPOSURES
    + """, r as (select request_id, max(exposed_at) as done, min(device_type) as device from e where request_id is not null group by 1),
    k as (select *, row_number() over (partition by device order by done desc, request_id) as rn from r)
    select device, request_id, done from k where rn <= 3"""
)
def latest_completions(spark: SparkSession, sf_dir: str, n: int = 3) -> DataFrame:
    """WN20: the last completions per device (n is the feature)."""
    e = exposures(spark, sf_dir, "request_id", "exposed_at", "device_type").filter("request_id is not null")
    r = e.groupBy("request_id").agg(F.max("exposed_at").alias("done"), F.min("device_type").alias("device"))
    rank = F.row_number().over(Window.partitionBy("device").orderBy(F.desc("done"), "request_id"))
    return r.withColumn("rn", rank).filter(F.col("rn") <= n).select("device", "request_id", "done")


@query(
    C
    + """select candidate_id, 'D_' || left(sha256(coalesce(request_id, '') || chr(31) || coalesce(product_id, '') || chr(31) || coalesce(commercial_angle, '')), 12) as stable_id from c"""
)
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX10, TX12: ids made of the content of some fields."""
    c = candidates(spark, sf_dir, "request_id", "product_id", "commercial_angle")
    key = F.concat_ws("\x1f", *[F.coalesce(f, F.lit("")) for f in ("request_id", "product_id", "commercial_angle")])
    return c.select("candidate_id", F.concat(F.lit("D_"), F.left(F.sha2(key, 256), F.lit(12))).alias("stable_id"))


@query(
    """select user_id, count(*) as entries, min(event_id) as first_entry from events where event_id > (select max(event_id) // 2 from events) group by 1"""
)
def journal_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK13, AG33, SS1: the entries of a journal after an offset."""
    e = table(spark, sf_dir, "events")
    offset = e.agg(F.max("event_id")).first()[0]
    rows = e.filter(F.col("event_id") > (offset or 0) // 2)
    return rows.groupBy("user_id").agg(F.count("*").alias("entries"), F.min("event_id").alias("first_entry"))


@query(
    CJ
    + """, m as (select c.commercial_angle as angle, c.source_user_factor_id as factor, count(*) filter (j.decision <> 'reject') as good, count(*) filter (j.decision = 'reject') as bad
      from j join c using (candidate_id) group by 1, 2)
    select angle, factor, cast(good as bigint) as successes, cast(bad as bigint) as failures, cast(rank() over (partition by angle order by good / (good + bad) desc, factor) as integer) as place from m"""
)
def success_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NM16, AG21: variants of a group ranked by their share of successes."""
    both = judgments(spark, sf_dir, "candidate_id", "decision").join(
        candidates(spark, sf_dir, "commercial_angle", "source_user_factor_id"), "candidate_id"
    )
    good = F.count_if(F.col("decision") != "reject")
    m = both.groupBy(F.col("commercial_angle").alias("angle"), F.col("source_user_factor_id").alias("factor")).agg(
        good.alias("successes"), F.count_if(F.col("decision") == "reject").alias("failures")
    )
    share = F.col("successes") / (F.col("successes") + F.col("failures"))
    return m.withColumn("place", F.rank().over(Window.partitionBy("angle").orderBy(F.desc(share), "factor")))


@query(None)
def edited_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX13, TX14: documents with headings as structures, each with the edits it holds itself applied or refused."""
    edits = F.regexp_extract_all("text", F.lit(EDIT), F.lit(0))
    d = documents(spark, sf_dir).filter(F.col("text").contains('{"op": '))
    as_json = F.to_json(F.struct(F.col("doc.preamble").alias("preamble"), F.col("doc.sections").alias("sections")))
    rows = d.select("doc_id", parse_sections(F.col("text")).alias("doc"), edits.alias("edits"))
    listed = F.concat(F.lit("["), F.array_join("edits", ","), F.lit("]"))
    out = rows.select("doc_id", F.size("doc.sections").alias("sections"), F.size("edits").alias("edits"), apply_edits(as_json, listed).alias("r"))
    return out.select("doc_id", "sections", "edits", F.sha2("r.result", 256).alias("result"), "r.error")


@query(
    r"""with d as (select doc_id, replace(text, chr(13) || chr(10), chr(10)) as t from documents where text is not null),
    r as (select doc_id, regexp_replace(t, '(?m)^(#{1,6}) +(\S(?:.*[^ \n])?) *$', '\1 \2', 'g') as r, regexp_matches(t, '(?:^|\n)#{1,6} +\S[^\n]*$') as ends from d)
    select doc_id, md5(case when ends then r || chr(10) else r end) as rendered, cast(len(regexp_extract_all(r, '(?m)^#{1,6} \S.*$')) as integer) as sections from r"""
)
def rendered_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX13: texts read as documents and rendered back: the same text but for the white space of headings."""
    d = documents(spark, sf_dir).filter("text is not null").select("doc_id", parse_sections(F.col("text")).alias("doc"))
    return d.select("doc_id", F.md5(render_sections(F.col("doc"))).alias("rendered"), F.size("doc.sections").alias("sections"))
