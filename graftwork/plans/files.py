"""Queries that write files to the shared folder and read them back: tables, journals, delimited text, evidence, indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftwork.functions.numeric import belief_mean, to_float
from graftwork.functions.predicates import is_void, strip
from graftwork.functions.text import safe_name
from graftwork.operators.beliefs import fold_journal
from graftwork.plans.features import _BLANKS
from graftwork.plans.ledger import R, _kind, records
from graftwork.plans.list_group import EXPOSURES, VOID, exposures
from graftwork.session import table, work_folder
from graftwork.sources import delimited, files

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
    """with o as (select distinct copy_id, request_id, user_id, item_id, copy from offline_copy where copy is not null and copy <> ''),
    g as (select request_id, nullif(user_id, '') as user_id, item_id, copy, count(*) as n from o group by all)
    select 'csv' as format, * from g union all select 'jsonl', * from g"""
)
def serving_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK1: the serving table as CSV and as JSON lines, written in parts and read back. Texts with line breaks and quotes
    keep them; an empty user id comes back as null from CSV, so it counts as null in both."""
    o = table(spark, sf_dir, "offline_copy").select("copy_id", *files.SERVING).distinct().filter("copy <> ''")
    at = work_folder(spark, "serving")
    files.write_serving(o, at)
    schema = "request_id string, user_id string, item_id string, copy string"
    from_csv = spark.read.schema(schema).csv(f"{at}/csv", header=True, escape='"', multiLine=True, lineSep="\n")
    from_json = files.read_strict(spark, f"{at}/jsonl", schema)

    def counted(df: DataFrame, name: str) -> DataFrame:
        user = F.nullif("user_id", F.lit("")).alias("user_id")
        rows = df.groupBy("request_id", user, "item_id", "copy").agg(F.count("*").alias("n"))
        return rows.select(F.lit(name).alias("format"), "*")

    return counted(from_csv, "csv").unionByName(counted(from_json, "jsonl"))


@query(
    "select user_id, cast(count(*) as bigint) as entries, cast(count(*) filter (value > 50) as bigint) as successes, min(event_id) as first_entry, max(event_id) as last_entry from events group by 1"
)
def journal_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK3, SK4, SC10, SC11: a journal of JSON lines appended to in two turns and read back strictly, then folded."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("value") > 50).alias("ok"))
    at = work_folder(spark, "journal")
    for turn in (0, 1):
        files.append_journal(e.filter(F.pmod("event_id", F.lit(2)) == turn), at)
    rows = files.read_strict(spark, at, "event_id long, user_id long, ok boolean")
    return rows.groupBy("user_id").agg(
        F.count("*").alias("entries"), F.count_if("ok").alias("successes"), F.min("event_id").alias("first_entry"), F.max("event_id").alias("last_entry")
    )


@query(
    R
    + """select record_id, json_extract_string(payload, '$.request_id') as request, json_exists(payload, '$.scenario_id') as has_scenario from r
    where ok and json_type(payload) = 'OBJECT'"""
)
def lenient_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC12, SC13: payloads written a line each and read back leniently: lines that are no whole JSON object are skipped."""
    r = records(spark, sf_dir, "payload").filter("payload is not null")
    at = work_folder(spark, "lines")
    # The record's number leads each line; a line break inside a payload is white space to JSON.
    flat = F.regexp_replace("payload", r"[\r\n]", " ")
    r.select(F.concat_ws("\t", F.col("record_id").cast("string"), flat).alias("value")).write.text(at)
    lines = spark.read.text(at).select(
        F.substring_index("value", "\t", 1).cast("long").alias("record_id"), F.expr("substring(value, instr(value, '\t') + 1)").alias("line")
    )
    v = lines.select("record_id", F.try_parse_json("line").alias("v")).filter(F.schema_of_variant("v").startswith("OBJECT"))
    return v.select(
        "record_id",
        F.try_variant_get("v", "$.request_id", "string").alias("request"),
        F.try_variant_get("v", "$.scenario_id", "string").isNotNull().alias("has_scenario"),
    )


@query(
    EXPOSURES
    + f""", j as (select distinct trim(request_id, {_BLANKS}) as request from judgments where request_id is not null)
    select exposure_id, trim(request_id, {_BLANKS}) as request, nullif(item_name, '') as item_name, case when not isnan(item_arriv_price) then item_arriv_price end as price, coalesce(is_new = 1, false) as is_new
    from e where not {VOID.format('request_id')} and trim(request_id, {_BLANKS}) in (select request from j)"""
)
def delimited_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC1-SC4, SC8: exposures written as delimited text, the delimiter found again from the header, names that hold the
    delimiter repaired, cells typed, and the rows of a set of requests picked by a semi join."""
    e = exposures(spark, sf_dir, "request_id", "item_name", "item_arriv_price", "is_new")
    at = work_folder(spark, "delimited")
    delimited.write_delimited(e, at, ["exposure_id", "request_id", "item_name", "item_arriv_price", "is_new"], "#", absorb="item_name")
    header = spark.read.text(f"{at}/header").first()[0]
    rows = delimited.read_delimited(spark, f"{at}/rows", absorb="item_name", header=header)
    done = table(spark, sf_dir, "judgments").select(strip(F.col("request_id")).alias("request")).distinct()
    typed = rows.filter(~is_void(F.col("request_id"))).select(
        F.col("exposure_id").cast("long").alias("exposure_id"),
        strip(F.col("request_id")).alias("request"),
        "item_name",
        to_float(F.col("item_arriv_price")).alias("price"),
        F.coalesce(to_float(F.col("is_new")) == 1.0, F.lit(False)).alias("is_new"),
    )
    return typed.join(done, "request", "left_semi").select("exposure_id", "request", "item_name", "price", "is_new")


@query(
    R
    + """select request_id, cast(count(*) as bigint) as records, max(attempt) as last_attempt from r where node_id = 'rubric_judge' and request_id in (select request_id from judgments) group by 1"""
)
def evidence_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK9, SC14: records as evidence in a folder per node, read back for one node, whose folder alone is listed, and for
    the requests that an index names."""
    at = work_folder(spark, "evidence")
    files.write_evidence(records(spark, sf_dir, "payload"), at)
    schema = "record_id long, request_id string, attempt int, payload string, node_id string"
    kept = spark.read.schema(schema).json(at).filter("node_id = 'rubric_judge'")
    index = table(spark, sf_dir, "judgments").select("request_id").distinct()
    return kept.join(index, "request_id", "left_semi").groupBy("request_id").agg(
        F.count("*").alias("records"), F.max("attempt").alias("last_attempt")
    )


@query(R + "select node_id as folder, true as filled, true as hashed from r where node_id is not null group by 1")
def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC17, SC21: the files below a folder by a pattern, with sizes and content hashes, summed per subfolder."""
    at = work_folder(spark, "inventory")
    rows = records(spark, sf_dir).filter("node_id is not null").select("record_id", "request_id", "attempt", safe_name(F.col("node_id")).alias("node_id"))
    rows.write.partitionBy("node_id").json(at)
    found = files.inventory(spark, at, "*.json").select(F.regexp_extract("path", "node_id=([^/]+)/", 1).alias("folder"), "size", "sha256")
    return found.groupBy("folder").agg((F.sum("size") > 0).alias("filled"), (F.min(F.length("sha256")) == 64).alias("hashed"))


@query(
    R
    + """select record_id, request_id, node_id, case when attempt > 1 then 'trial' else 'production' end as record_kind, ok as val_readable,
      coalesce(length(trim(payload, ' 　')), 0) > 0 as val_present, case when ok then 'ok' when payload is null then 'absent' else 'unreadable' end as failure_class from r"""
)
def index_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK7, PF24, PF26: one index row per record with its kind, checks and failure class, overwritten whole and read back."""
    rows = records(spark, sf_dir, "payload").select(
        "record_id",
        "request_id",
        "node_id",
        _kind().alias("record_kind"),
        F.col("ok").alias("val_readable"),
        (F.coalesce(F.length(F.btrim("payload", F.lit(" 　"))), F.lit(0)) > 0).alias("val_present"),
        F.when(F.col("ok"), "ok").when(F.col("payload").isNull(), "absent").otherwise("unreadable").alias("failure_class"),
    )
    at = work_folder(spark, "index")
    for _ in range(2):  # written again, it holds each row once
        rows.write.mode("overwrite").json(at)
    return spark.read.schema(rows.schema).json(at)


@query(
    """with o as (select user_id, count(*) filter (value > 50) as s, count(*) filter (value <= 50) as f from events where value is not null group by 1),
    b as (select c_custkey as user_id, 1 + coalesce(s, 0) as alpha, 1 + coalesce(f, 0) as beta, coalesce(s, 0) + coalesce(f, 0) as trials from customer left join o on c_custkey = user_id)
    select case when trials = 0 then 'untried' when alpha / (alpha + beta) >= 0.5 then 'active' else 'waiting' end as status, count(*) as n, cast(count(*) filter (trials > 0) as bigint) as updated, cast(sum(trials) as bigint) as trials from b group by 1"""
)
def portfolio_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK2, AG12, AG20: folded beliefs as JSON lines, overwritten whole and read back; rows per status, and how many were
    updated."""
    portfolio = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), F.lit(1).cast("long").alias("alpha"), F.lit(1).cast("long").alias("beta")
    )
    journal = table(spark, sf_dir, "events").select("user_id", (F.col("value") > 50).alias("ok"), "event_id")
    folded = fold_journal(portfolio, journal, "user_id", "ok", "event_id")
    at = work_folder(spark, "portfolio")
    for state in (portfolio, folded):
        state.write.mode("overwrite").json(at)
    b = files.read_strict(spark, at, "user_id long, alpha long, beta long, trials long, cost long")
    share = belief_mean(F.col("alpha"), F.col("beta"))
    status = F.when(F.col("trials") == 0, "untried").when(share >= 0.5, "active").otherwise("waiting")
    return b.groupBy(status.alias("status")).agg(
        F.count("*").alias("n"), F.count_if(F.col("trials") > 0).alias("updated"), F.sum("trials").alias("trials")
    )


@query(
    """with l as (select user_id, event_type, max_by(event_id, ts) as last_event, count(*) as n from events group by 1, 2)
    select user_id, cast(sum(n) as bigint) as entries, string_agg(event_type || '=' || last_event, ',' order by event_type) as last_events from l group by 1"""
)
def snapshot_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK11, AG14: events reduced to a snapshot per user, the last of each type counting, written as JSON and read back."""
    last = F.max_by("event_id", F.struct("ts", "event_id"))
    l = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(last.alias("last_event"), F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("event_type", "last_event")))  # one per type of event
    snapshot = l.groupBy("user_id").agg(F.sum("n").alias("entries"), entries.alias("last_events"))
    at = work_folder(spark, "snapshot")
    snapshot.write.mode("overwrite").json(at)
    back = files.read_strict(spark, at, "user_id long, entries long, last_events array<struct<event_type:string,last_event:long>>")
    text = F.array_join(F.transform("last_events", lambda x: F.concat_ws("=", x.event_type, x.last_event.cast("string"))), ",")
    return back.select("user_id", "entries", text.alias("last_events"))
