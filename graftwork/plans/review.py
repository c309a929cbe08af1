"""Queries over candidates, judgments, artifacts, documents and events: checks, reports, beliefs, samples, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftwork.functions.numeric import belief_mean, beta_above, wilson_low
from graftwork.functions.text import elapsed, has_any, overlap, redacted
from graftwork.operators.beliefs import fold_journal, merge_clusters
from graftwork.operators.cohorts import ladder_baseline
from graftwork.operators.integrity import coverage, nested, repeated_keys
from graftwork.operators.integrity import unknown_references as unknown
from graftwork.operators.ordering import gated, once, one_per_key, round_robin
from graftwork.plans.list_group import EXPOSURES, exposures
from graftwork.session import cut, table
from graftwork.streaming import journal as streams

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Candidates, judgments and copies with each key once, and the latest judgment of each candidate, in SQL.
C = "with c as (select distinct on (candidate_id) * from candidates) "
J = "with j as (select distinct on (judgment_id) * from judgments) "
CJ = C + ", j as (select distinct on (judgment_id) * from judgments) "
LATEST = CJ + ", l as (select * from (select *, row_number() over (partition by candidate_id order by judged_at desc, judgment_id desc) as rn from j) where rn = 1) "


def candidates(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "candidates").select("candidate_id", *columns).distinct()


def judgments(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "judgments").select("judgment_id", *columns).distinct()


def latest_judgments(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    rows = judgments(spark, sf_dir, *dict.fromkeys(["candidate_id", "judged_at", *columns]))
    return one_per_key(rows, ["candidate_id"], [F.desc("judged_at"), F.desc("judgment_id")])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


# Scores and checks


@query(
    J
    + """select judgment_id, total_score,
      cast(coalesce(list_sum(list_transform(axis_scores, lambda x: x.score)), 0) as bigint) as axis_total,
      coalesce(list_sum(list_transform(axis_scores, lambda x: x.score)), 0) = total_score as adds_up,
      cast(len(list_distinct(list_transform(axis_scores, lambda x: x.axis_id))) as integer) as axes,
      len(objective_checks) > 0 and coalesce(list_bool_and(list_transform(objective_checks, lambda x: x.passed)), false) as all_passed from j"""
)
def rubric_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG4, NM23, PF14: a judgment's axis scores against its total, and whether all its checks passed."""
    j = judgments(spark, sf_dir, "total_score", "axis_scores", "objective_checks")
    total = F.coalesce(
        F.aggregate("axis_scores", F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x.score, F.lit(0))), F.lit(0)
    )
    return j.select(
        "judgment_id",
        "total_score",
        total.alias("axis_total"),
        (total == F.col("total_score")).alias("adds_up"),
        F.size(F.array_distinct(F.transform("axis_scores", lambda x: x.axis_id))).alias("axes"),
        F.coalesce(
            (F.size("objective_checks") > 0) & F.forall("objective_checks", lambda x: F.coalesce(x.passed, F.lit(False))),
            F.lit(False),
        ).alias("all_passed"),
    )


@query(
    J
    + """, a as (select unnest(axis_scores) as a from j) select a.axis_id as axis_id, count(*) as n, round(avg(a.score), 6) as mean_score,
    cast(count(*) filter (a.diagnostic is not null) as bigint) as diagnosed from a group by 1"""
)
def axis_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG3: mean score per axis."""
    a = judgments(spark, sf_dir, "axis_scores").select(F.inline("axis_scores"))
    return a.groupBy("axis_id").agg(
        F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.count("diagnostic").alias("diagnosed")
    )


@query(
    J
    + """, k as (select judgment_id, unnest(objective_checks) as k from j) select k.check_id as check_id, cast(count(*) filter (k.passed) as bigint) as passed,
    cast(count(*) filter (not k.passed) as bigint) as failed, min(judgment_id) filter (not k.passed) as first_failure from k group by 1"""
)
def check_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG6: passes and failures per check."""
    k = judgments(spark, sf_dir, "objective_checks").select("judgment_id", F.inline("objective_checks"))
    return k.groupBy("check_id").agg(
        F.count_if("passed").alias("passed"),
        F.count_if(~F.col("passed")).alias("failed"),
        F.min(F.when(~F.col("passed"), F.col("judgment_id"))).alias("first_failure"),
    )


@query(
    J
    + """select request_id, case min(case decision when 'reject' then 0 when 'hold' then 1 when 'admit' then 2 else 3 end)
      when 0 then 'reject' when 1 then 'hold' when 2 then 'admit' else 'unknown' end as bucket,
      cast(count(*) filter (decision = 'reject') as bigint) as rejects, cast(count(*) filter (decision = 'hold') as bigint) as holds from j group by 1"""
)
def decision_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG5, AG21, AG34, NM26: a request's severest decision."""
    j = judgments(spark, sf_dir, "request_id", "decision")
    order = ["reject", "hold", "admit"]
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col("decision")), F.lit(0)), F.lit(4))
    worst = F.element_at(F.array(*map(F.lit, [*order, "unknown"])), F.min(place).cast("int"))
    return j.groupBy("request_id").agg(
        worst.alias("bucket"),
        F.count_if(F.col("decision") == "reject").alias("rejects"),
        F.count_if(F.col("decision") == "hold").alias("holds"),
    )


@query(
    J
    + """, t as (select judgment_id, unnest(case when len(failure_tags) > 0 then failure_tags else ['ok'] end) as tag from j)
    select coalesce(tag, 'ok') as tag, count(*) as n, count(distinct judgment_id) as judgments from t group by 1"""
)
def failure_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG7: judgments per failure tag, ``ok`` for none."""
    j = judgments(spark, sf_dir, "failure_tags")
    tags = F.when(F.size("failure_tags") > 0, F.col("failure_tags")).otherwise(F.array(F.lit("ok")))
    t = j.select("judgment_id", F.explode(tags).alias("tag"))
    return t.groupBy(F.coalesce("tag", F.lit("ok")).alias("tag")).agg(
        F.count("*").alias("n"), F.count_distinct("judgment_id").alias("judgments")
    )


# Joins


@query(
    LATEST
    + """select c.request_id, c.candidate_id, coalesce(nullif(l.product_id, ''), nullif(c.product_id, '')) as item_id,
      coalesce(nullif(trim(l.copy_text, ' 　'), ''), trim(c.text, ' 　')) as copy, l.total_score
    from l left join c using (candidate_id)
    where len(l.objective_checks) > 0 and list_bool_and(list_transform(l.objective_checks, lambda x: coalesce(x.passed, false))) and l.total_score >= 21
      and coalesce(nullif(trim(l.copy_text, ' 　'), ''), trim(c.text, ' 　'), '') <> ''"""
)
def offline_export(spark: SparkSession, sf_dir: str, least: int = 21) -> DataFrame:
    """JN1, PF14, SK1: the latest judgments that qualify, with their candidate's data; blank texts go."""
    judged = latest_judgments(spark, sf_dir, "product_id", "copy_text", "total_score", "objective_checks")
    passed = F.forall("objective_checks", lambda x: F.coalesce(x.passed, F.lit(False)))
    kept = judged.filter((F.size("objective_checks") > 0) & passed & (F.col("total_score") >= least))
    c = candidates(spark, sf_dir, "request_id", "product_id", "text").withColumnRenamed("product_id", "c_product")
    blank = F.lit(" 　")
    copy = F.coalesce(F.nullif(F.btrim("copy_text", blank), F.lit("")), F.btrim("text", blank))
    return (
        kept.join(c.withColumnRenamed("candidate_id", "c_id"), F.col("candidate_id") == F.col("c_id"), "left")
        .select(
            "request_id",
            F.col("c_id").alias("candidate_id"),
            F.coalesce(F.nullif("product_id", F.lit("")), F.nullif("c_product", F.lit(""))).alias("item_id"),
            copy.alias("copy"),
            "total_score",
        )
        .filter(F.coalesce("copy", F.lit("")) != "")
    )


@query(
    C
    + """, p as (select distinct request_id, source_user_factor_id as factor from c),
    r as (select request_id, source_user_factor_id as factor, count(*) as n, string_agg(candidate_id, ',' order by ord, candidate_id) as labels
      from c where text is not null and trim(text, ' 　') <> '' group by 1, 2)
    select p.request_id, p.factor, coalesce(r.n, 0) as n, coalesce(r.labels, '') as labels from p left join r on p.request_id = r.request_id and p.factor = r.factor"""
)
def factor_copy_nest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN3, SK10: each factor of a request with its candidates that have text, in order; factors without any stay."""
    c = candidates(spark, sf_dir, "request_id", "source_user_factor_id", "ord", "text")
    c = c.withColumnRenamed("source_user_factor_id", "factor")
    written = c.filter(F.btrim("text", F.lit(" 　")) != "").select("request_id", "factor", "ord", "candidate_id")
    return nested(c.select("request_id", "factor").distinct(), written, ["request_id", "factor"], "ord", "candidate_id")


@query(
    CJ
    + """select 'judgment' as kind, cast(judgment_id as varchar) as child, candidate_id as reference from j where candidate_id not in (select candidate_id from c)
    union all select 'candidate', candidate_id, product_id from c where product_id is not null and product_id not in (select item_id from exposure_log where item_id is not null)"""
)
def unknown_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN4: judgments of unknown candidates and candidates of products never shown."""
    c = candidates(spark, sf_dir, "product_id")
    j = unknown(judgments(spark, sf_dir, "candidate_id"), c, "candidate_id", "candidate_id")
    p = unknown(c, table(spark, sf_dir, "exposure_log").filter("item_id is not null"), "product_id", "item_id")
    return j.select(
        F.lit("judgment").alias("kind"), F.col("judgment_id").cast("string").alias("child"), F.col("candidate_id").alias("reference")
    ).unionByName(
        p.select(F.lit("candidate").alias("kind"), F.col("candidate_id").alias("child"), F.col("product_id").alias("reference"))
    )


@query(
    CJ
    + """, e as (select distinct request_id, candidate_id from c), a as (select distinct request_id, candidate_id from j),
    f as (select coalesce(e.request_id, a.request_id) as request_id, e.candidate_id as ec, a.candidate_id as ac from e full join a using (request_id, candidate_id))
    select request_id, coalesce(string_agg(ec, ',' order by ec) filter (ac is null), '') as missing,
      coalesce(string_agg(ac, ',' order by ac) filter (ec is null), '') as extra from f where ec is null or ac is null group by 1"""
)
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN5, ST1: a request's candidates without a judgment and judgments without a candidate."""
    c = candidates(spark, sf_dir, "request_id")
    return coverage(c, judgments(spark, sf_dir, "request_id", "candidate_id"), "request_id", "candidate_id")


@query(
    " union all ".join(
        f"select '{t}' as source, cast(sum(n) as bigint) as rows, count(*) as keys, cast(count(*) filter (n > 1) as bigint) as repeated from (select count(*) as n from {t} group by {k})"
        for t, k in (("candidates", "candidate_id"), ("judgments", "judgment_id"), ("offline_copy", "copy_id"), ("exposure_log", "exposure_id"))
    )
)
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN7: rows, keys and repeated keys per table."""
    keys = {"candidates": "candidate_id", "judgments": "judgment_id", "offline_copy": "copy_id", "exposure_log": "exposure_id"}
    return repeated_keys({t: (table(spark, sf_dir, t), k) for t, k in keys.items()})


@query(
    CJ
    + "select j.judgment_id, j.candidate_id, j.copy_text, c.text from j join c using (candidate_id) where j.copy_text <> c.text"
)
def text_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN6: judgments whose text is not their candidate's."""
    both = judgments(spark, sf_dir, "candidate_id", "copy_text").join(candidates(spark, sf_dir, "text"), "candidate_id")
    return both.filter(F.col("copy_text") != F.col("text")).select("judgment_id", "candidate_id", "copy_text", "text")


@query(
    CJ
    + """, s as (select request_id, avg(total_score) as score from j group by 1),
    e as (select distinct * from exposure_log),
    r as (select request_id, min(hour) as wave, mode() within group (order by item_cat1_name) as m, count(*) as n, max(is_clk_c) as clk, min(coalesce(item_cat1_name, 'unknown')) as cat from e where request_id is not null group by 1),
    q as (select request_id, wave % 4 as wave, cat, case when n <= 3 then 'few' else 'many' end as band, coalesce(clk, 0) = 1 as trial, score from r join s using (request_id)),
    t as (select * from q where trial), b as (select * from q where not trial),
    b0 as (select wave, cat, band, avg(score) m, count(*) n from b group by all), b1 as (select wave, cat, avg(score) m, count(*) n from b group by all), b2 as (select wave, avg(score) m, count(*) n from b group by all)
    select t.request_id, t.wave, t.cat, t.band, round(t.score, 6) as score,
      case when b0.n is not null then 0 when b1.n is not null then 1 when b2.n is not null then 2 else -1 end as level,
      round(coalesce(b0.m, b1.m, b2.m), 6) as baseline_mean, coalesce(b0.n, b1.n, b2.n, 0) as baseline_n,
      round(t.score - coalesce(b0.m, b1.m, b2.m), 6) as uplift, round(t.score, 6) > round(coalesce(b0.m, b1.m, b2.m), 6) as success
    from t left join b0 on t.wave = b0.wave and t.cat = b0.cat and t.band = b0.band left join b1 on t.wave = b1.wave and t.cat = b1.cat left join b2 on t.wave = b2.wave"""
)
def cohort_uplift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN8, NM24, AG19, AG30: requests with a click against the mean score of the nearest cohort without one."""
    score = judgments(spark, sf_dir, "request_id", "total_score").groupBy("request_id").agg(F.avg("total_score").alias("score"))
    e = exposures(spark, sf_dir, "request_id", "hour", "item_cat1_name", "is_clk_c").filter("request_id is not null")
    per = e.groupBy("request_id").agg(
        (F.min("hour") % 4).alias("wave"),
        F.min(F.coalesce("item_cat1_name", F.lit("unknown"))).alias("cat"),
        F.when(F.count("*") <= 3, "few").otherwise("many").alias("band"),
        F.coalesce(F.max("is_clk_c") == 1, F.lit(False)).alias("trial"),
    )
    rows = cut(per.join(score, "request_id"))  # one row per request, read once per level
    trials = rows.filter("trial").drop("trial")
    out = ladder_baseline(trials, rows.filter("not trial"), ["wave"], [["cat", "band"], ["cat"], []], "score")
    mean, own = F.round("baseline_mean", 6), F.round("score", 6)
    return out.select(
        "request_id", "wave", "cat", "band", own.alias("score"), "level", mean.alias("baseline_mean"), "baseline_n",
        F.round(F.col("score") - F.col("baseline_mean"), 6).alias("uplift"), (own > mean).alias("success"),
    )


# Reports


@query(
    C
    + """, r as (select request_id, count(distinct source_user_factor_id) as f, count(*) as n, count(*) filter (text is not null) = count(*) as complete from c group by 1)
    select round(median(f), 6) as median_factors, round(median(n), 6) as median_candidates, cast(count(*) filter (f < 3) as bigint) as underspecified,
      round(coalesce(avg(complete::int) filter (f < 3), 1.0), 6) as completion_rate from r"""
)
def behaviour_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG8, AG10, AG31: exact medians per request, and how many underspecified requests are complete."""
    per = candidates(spark, sf_dir, "request_id", "source_user_factor_id", "text").groupBy("request_id").agg(
        F.count_distinct("source_user_factor_id").alias("f"),
        F.count("*").alias("n"),
        (F.count("text") == F.count("*")).cast("int").alias("complete"),
    )
    few = F.col("f") < 3
    return per.agg(
        F.round(F.median("f"), 6).alias("median_factors"),
        F.round(F.median("n"), 6).alias("median_candidates"),
        F.count_if(few).alias("underspecified"),
        F.round(F.coalesce(F.avg(F.when(few, F.col("complete"))), F.lit(1.0)), 6).alias("completion_rate"),
    )


@query(
    C
    + """select commercial_angle, count(*) as n, count(distinct nullif(product_id, '')) as products, count(distinct nullif(product_binding, '')) as bindings from c group by 1"""
)
def distinct_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG11: rows and distinct non-empty values per group."""
    c = candidates(spark, sf_dir, "commercial_angle", "product_id", "product_binding")
    return c.groupBy("commercial_angle").agg(
        F.count("*").alias("n"),
        F.count_distinct(F.nullif("product_id", F.lit(""))).alias("products"),
        F.count_distinct(F.nullif("product_binding", F.lit(""))).alias("bindings"),
    )


@query(
    CJ
    + r""", p as (select j.judgment_id, list_distinct(string_split(regexp_replace(lower(coalesce(j.copy_text, '')), '[\s\p{Z}]+', '', 'g'), '')) as a,
      list_distinct(string_split(regexp_replace(lower(coalesce(c.text, '')), '[\s\p{Z}]+', '', 'g'), '')) as b from j join c using (candidate_id)),
    q as (select judgment_id, list_filter(a, lambda x: x <> '') as a, list_filter(b, lambda x: x <> '') as b from p)
    select judgment_id, case when len(a) > 0 and len(b) > 0 then round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) else 0.0 end as overlap from q"""
)
def codepoint_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX7, ST2: character overlap of a judged text and its candidate's."""
    both = judgments(spark, sf_dir, "candidate_id", "copy_text").join(candidates(spark, sf_dir, "text"), "candidate_id")
    return both.select("judgment_id", F.round(overlap(F.col("copy_text"), F.col("text")), 6).alias("overlap"))


@query(
    J
    + """, q as (select judgment_id, request_id, case when decision = 'reject' then 'rejected' when total_score = 0 then 'no score' when copy_text is null then 'no text' end as reason from j),
    r as (select *, row_number() over (order by judgment_id) as rn, count(*) over () as n from q where reason is not null)
    select judgment_id, reason from r where rn <= 29 union all select null, '<truncated: ' || (max(n) - 29) || ' more>' from r having max(n) > 29"""
)
def review_queue(spark: SparkSession, sf_dir: str, cap: int = 29) -> DataFrame:
    """WN10: the first judgments to look at, and a last line that tells how many more there are."""
    j = judgments(spark, sf_dir, "decision", "total_score", "copy_text")
    reason = F.when(F.col("decision") == "reject", "rejected").when(F.col("total_score") == 0, "no score")
    rows = j.select("judgment_id", reason.when(F.col("copy_text").isNull(), "no text").alias("reason")).filter("reason is not null")
    more = rows.agg(F.count("*").alias("n")).filter(F.col("n") > cap)
    left = (F.col("n") - cap).cast("string")
    note = more.select(F.lit(None).cast("long").alias("judgment_id"), F.concat(F.lit("<truncated: "), left, F.lit(" more>")).alias("reason"))
    return rows.orderBy("judgment_id").limit(cap).unionByName(note)


@query(
    CJ
    + """(select 'high' as side, judgment_id, total_score from j order by total_score desc, judgment_id limit 20)
    union all (select 'low' as side, judgment_id, total_score from j order by total_score, judgment_id limit 20)"""
)
def extreme_samples(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    """WN9: the k highest and lowest judgments (k is the feature)."""
    j = judgments(spark, sf_dir, "total_score").select("judgment_id", "total_score")
    high = j.orderBy(F.desc("total_score"), "judgment_id").limit(k).select(F.lit("high").alias("side"), "*")
    return high.unionByName(j.orderBy("total_score", "judgment_id").limit(k).select(F.lit("low").alias("side"), "*"))


@query(
    C
    + """, f as (select commercial_angle as angle, product_binding as binding, min(candidate_id) as first, count(*) as n, cast(sum(length(text)) as bigint) as size from c where product_binding is not null group by 1, 2)
    select angle, binding, row_number() over (partition by angle order by first, binding) as place, first as first_row, n as members, size from f"""
)
def cluster_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG24, AG25, ST3: the ordered union of a field over each cluster, a row per member with its place and counters."""
    c = candidates(spark, sf_dir, "commercial_angle", "product_binding", "text")
    rows = c.select(
        F.col("commercial_angle").alias("angle"), F.col("product_binding").alias("binding"), "candidate_id", F.length("text").cast("long").alias("size")
    )
    return merge_clusters(rows.filter("binding is not null"), "angle", "candidate_id", "binding", ["size"])


# Artifacts


@query(
    """with a as (select distinct on (record_id) * from artifact_log),
    r as (select *, row_number() over (partition by request_id, node_id order by attempt desc, captured_at desc, record_id desc) as rn, count(*) over (partition by request_id, node_id) as attempts from a)
    select request_id, node_id, record_id, attempts, coalesce(json_valid(payload), false) as readable from r where rn = 1"""
)
def latest_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN4, AG15, AG16, SC12: the last attempt of each node of a request, and whether it can be read."""
    a = once(table(spark, sf_dir, "artifact_log"), "record_id", "captured_at")
    best = F.max_by(F.struct("record_id", "payload"), F.struct("attempt", "captured_at", "record_id"))
    last = a.groupBy("request_id", "node_id").agg(best.alias("b"), F.count("*").alias("attempts"))
    readable = F.try_parse_json(F.col("b.payload")).isNotNull()
    return last.select("request_id", "node_id", "b.record_id", "attempts", readable.alias("readable"))


@query(
    """with a as (select distinct on (record_id) * from artifact_log),
    u as (select node_id, request_id, case when json_valid(payload) then try_cast(json_extract_string(payload, '$.usage.total_tokens') as bigint) end as tokens from a)
    select node_id, count(*) as turns, count(tokens) as counted, cast(coalesce(sum(tokens), 0) as bigint) as tokens, count(distinct request_id) as requests from u group by 1"""
)
def usage_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG13, AG17, AG18: token sums per node; what is no number is skipped."""
    a = table(spark, sf_dir, "artifact_log").dropDuplicates(["record_id"])
    tokens = F.try_variant_get(F.try_parse_json("payload"), "$.usage.total_tokens", "bigint")
    return a.withColumn("t", tokens).groupBy("node_id").agg(
        F.count("*").alias("turns"),
        F.count("t").alias("counted"),
        F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"),
        F.count_distinct("request_id").alias("requests"),
    )


# Documents

#: An edit in a text: its value, which may be missing, holds at most one level of braces.
EDIT = r'\{"op": "[a-z]+", "path": "[^"]*"(?:, "value": (?:[^{}]|\{[^{}]*\})*)?\}'
_TERMS = ["node=", "signal_basis", "todo", "trace"]


@query(
    "select kind, count(*) as n, cast(count(*) filter ("
    + " or ".join(f"coalesce(contains(lower(text), '{t}'), false)" for t in _TERMS)
    + ") as bigint) as flagged from documents group by 1"
)
def privacy_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF19: documents with any of the deny-listed terms."""
    d = documents(spark, sf_dir)
    return d.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(has_any(F.col("text"), _TERMS)).alias("flagged"))


@query("select doc_id, cast(position('status=ok' in text) as integer) as at from documents where contains(text, 'status=ok')")
def literal_grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC18: texts with a literal string and where it first stands."""
    d = documents(spark, sf_dir).filter(F.contains("text", F.lit("status=ok")))
    return d.select("doc_id", F.instr("text", "status=ok").alias("at"))


@query(
    r"select doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(?i)\b(?:bearer|token|secret|api[_-]?key|sk)[ :=_-]+[A-Za-z0-9._-]{8,}', '<key>', 'g'), '[A-Za-z0-9._-]+@[A-Za-z0-9.-]+', '<mail>', 'g'), '[0-9]{3,}', '<n>', 'g') as safe from documents"
)
def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX25: texts with keys, mail addresses and long numbers masked, whole; a cap on their length is an option."""
    return documents(spark, sf_dir).select("doc_id", redacted(F.col("text")).alias("safe"))


@query(
    "select sha256(coalesce(text, '')) as hash, count(*) as copies, min(doc_id) as first_doc, count(distinct source) as sources from documents group by 1"
)
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX11, TX12, RL4: one row per distinct text."""
    d = documents(spark, sf_dir)
    return d.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash")).agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"), F.count_distinct("source").alias("sources")
    )


@query(
    r"""with l as (select doc_id, unnest(string_split(replace(text, chr(13), ''), chr(10))) as line from documents where text is not null),
    h as (select doc_id, length(regexp_extract(line, '^(#{1,6}) +[^ ]', 1)) as level, regexp_extract(line, '^#{1,6} +(.*?) *$', 1) as heading from l where regexp_matches(line, '^#{1,6} +[^ ]'))
    select cast(level as integer) as level, heading, count(*) as n, count(distinct doc_id) as docs from h group by 1, 2"""
)
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX13: headings of structured documents with their level."""
    text = F.replace("text", F.lit("\r"), F.lit(""))
    lines = documents(spark, sf_dir).filter("text is not null").select("doc_id", F.explode(F.split(text, "\n")).alias("line"))
    heads = lines.filter(F.col("line").rlike(r"(?d)^#{1,6} +[^ ]")).select(
        "doc_id",
        F.length(F.regexp_extract("line", r"(?d)^(#{1,6}) +[^ ]", 1)).alias("level"),
        F.regexp_extract("line", r"(?d)^#{1,6} +(.*?) *$", 1).alias("heading"),
    )
    return heads.groupBy("level", "heading").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@query(
    rf"""with p as (select doc_id, unnest(regexp_extract_all(text, '{EDIT}')) as edit from documents)
    select json_extract_string(edit, '$.op') as op, json_extract_string(edit, '$.path') as path, json_extract_string(edit, '$.value') as value,
      regexp_extract(json_extract_string(edit, '$.path'), '([^/]*)$', 1) as leaf, regexp_matches(json_extract_string(edit, '$.path'), '^/sections/[0-9]+(/|$)') as numeric_section, count(*) as n from p where json_valid(edit) group by 1, 2, 3, 4, 5"""
)
def patch_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX17: the edits that documents hold, with or without a value, the last part of their pointer, and whether it names
    a section by number."""
    edits = documents(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit(EDIT), F.lit(0))).alias("edit"))
    v = F.try_parse_json("edit")
    got = lambda k: F.try_variant_get(v, f"$.{k}", "string")
    rows = edits.filter(v.isNotNull()).select(got("op").alias("op"), got("path").alias("path"), got("value").alias("value"))
    leaf, numeric = F.regexp_extract("path", r"([^/]*)$", 1), F.col("path").rlike("^/sections/[0-9]+(/|$)")
    return rows.groupBy("op", "path", "value", leaf.alias("leaf"), numeric.alias("numeric_section")).agg(F.count("*").alias("n"))


@query(
    """with d as (select min(doc_id) as doc_id, coalesce(lang, '') as lang, coalesce(kind, '') as kind from documents where text is not null group by md5(text), 2, 3),
    t as (select *, row_number() over (partition by lang, kind order by doc_id) as turn, min(doc_id) over (partition by lang, kind) as seen from d)
    select doc_id, lang, kind from t order by turn, seen, doc_id limit 500"""
)
def round_robin_sample(spark: SparkSession, sf_dir: str, n: int = 500) -> DataFrame:
    """WN8: n distinct texts that take turns over languages and kinds (n is the feature)."""
    d = documents(spark, sf_dir).filter("text is not null")
    lang, kind = F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("kind", F.lit("")).alias("kind")
    distinct = d.groupBy(F.md5("text").alias("h"), lang, kind).agg(F.min("doc_id").alias("doc_id"))
    return round_robin(distinct.select("doc_id", "lang", "kind"), ["lang", "kind"], "doc_id", n)


# Events


@query(
    """select user_id, event_type, max_by(event_id, ts) as last_event, round(max_by(value, ts), 6) as last_value, count(*) as n,
      strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_at from events group by 1, 2"""
)
def event_reducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG14: the last event of each type per user."""
    last = F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id"))
    rows = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(
        last.alias("l"), F.count("*").alias("n"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_at")
    )
    return rows.select(
        "user_id", "event_type", F.col("l.event_id").alias("last_event"), F.round("l.value", 6).alias("last_value"), "n", "last_at"
    )


@query(
    "select user_id, cast(json_extract_string(props, '$.k') as bigint) as k, count(*) as n from events group by 1, 2"
)
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC9, SC13: a typed field of JSON text."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return table(spark, sf_dir, "events").groupBy("user_id", k.alias("k")).agg(F.count("*").alias("n"))


_BELIEF = """with p as (select c_custkey as user_id, 1 as alpha, 1 as beta from customer),
    o as (select user_id, count(*) filter (value > 50) as s, count(*) filter (value <= 50) as f, sum(event_id) as c from events where value is not null group by 1),
    b as (select p.user_id, 1 + coalesce(s, 0) as alpha, 1 + coalesce(f, 0) as beta, coalesce(s, 0) + coalesce(f, 0) as trials, cast(coalesce(c, 0) as bigint) as cost from p left join o using (user_id)) """


@query(
    _BELIEF
    + """select user_id, cast(alpha as bigint) as alpha, cast(beta as bigint) as beta, cast(trials as bigint) as trials, cost, round(alpha / (alpha + beta), 6) as mean,
      round(least(list_sum(list_transform(range(0, alpha::bigint), lambda j: exp(lgamma(alpha + beta) - lgamma(j + 1) - lgamma(alpha + beta - j) + (alpha + beta - 1) * ln(0.5)))), 1.0), 6) as above_half,
      case when trials > 0 then round(((alpha - 1) / trials + 1.96 * 1.96 / (2 * trials) - 1.96 * sqrt((alpha - 1) / trials * (1 - (alpha - 1) / trials) / trials + 1.96 * 1.96 / (4 * trials * trials))) / (1 + 1.96 * 1.96 / trials), 6) else 0.0 end as wilson from b"""
)
def belief_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG12, AG23, JN9, NM16, NM17, NM19, NM27: beliefs folded from a journal, with their tails and bounds."""
    portfolio = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), F.lit(1).cast("long").alias("alpha"), F.lit(1).cast("long").alias("beta")
    )
    journal = table(spark, sf_dir, "events").select("user_id", (F.col("value") > 50).alias("ok"), "event_id")
    b = fold_journal(portfolio, journal, "user_id", "ok", "event_id")
    return b.select(
        "user_id", "alpha", "beta", "trials", "cost",
        F.round(belief_mean(F.col("alpha"), F.col("beta")), 6).alias("mean"),
        F.round(beta_above(F.col("alpha"), F.col("beta")), 6).alias("above_half"),
        F.round(wilson_low(F.col("alpha") - 1, F.col("trials")), 6).alias("wilson"),
    )


@query(
    """with recursive d as (select event_type, epoch(ts)::bigint // 86400 as day, count(*) as n from events group by 1, 2),
    o as (select *, row_number() over (partition by event_type order by day) as rn from d),
    r as (select event_type, day, rn, n as pending, n >= 40 as emitted from o where rn = 1
      union all select o.event_type, o.day, o.rn, case when r.emitted then 0 else r.pending end + o.n, case when r.emitted then 0 else r.pending end + o.n >= 40 from o join r on o.event_type = r.event_type and o.rn = r.rn + 1)
    select event_type, cast(day as bigint) as day, cast(pending as bigint) as pending, emitted from r"""
)
def threshold_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN12, WN18, SS2: counts that wait over the waves until a threshold lets them go."""
    e = table(spark, sf_dir, "events")
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000).cast("long")
    daily = e.groupBy("event_type", day.alias("day")).agg(F.count("*").alias("n"))
    return gated(daily, "event_type", "day", "n", 40)


@query(
    """with s as (select user_id, cast(date_diff('second', min(ts), max(ts)) as bigint) as secs from events group by 1)
    select user_id, secs, case when secs >= 3600 then printf('%02d:%02d:%02d', secs // 3600, secs % 3600 // 60, secs % 60) else printf('%02d:%02d', secs // 60, secs % 60) end as span from s"""
)
def elapsed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX24: spans of time as text."""
    stamp = lambda c: F.unix_seconds(c.cast("timestamp"))
    s = table(spark, sf_dir, "events").groupBy("user_id").agg((stamp(F.max("ts")) - stamp(F.min("ts"))).alias("secs"))
    return s.select("user_id", "secs", elapsed(F.col("secs")).alias("span"))


# Streams


@query(
    """select user_id, cast(count(*) filter (value > 50) as bigint) as successes, cast(count(*) filter (value <= 50) as bigint) as failures, count(*) as entries from events group by 1"""
)
def stream_journal_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SS1: the journal fold as a stream."""
    return streams.fold_stream(spark, streams.source(spark, sf_dir, "events"), "user_id", F.col("value") > 50)


@query(
    """select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2"""
)
def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SS5, SS7: daily windows as a stream."""
    w = streams.windowed_stream(spark, streams.source(spark, sf_dir, "events"), "ts", "1 day", ["event_type"], "value")
    return w.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("select distinct judgment_id, candidate_id, total_score from judgments")
def stream_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SS4: a stream of judgments in which re-sent rows count once."""
    rows = streams.ledger_stream(spark, streams.source(spark, sf_dir, "judgments"), "judgment_id")
    return rows.select("judgment_id", "candidate_id", "total_score")


@query(
    "with n as (select user_id, count(*) as n from events group by 1), e as (select user_id, unnest(range(1, n // 20 + 1)) as emission from n) select user_id, emission, cast(20 as bigint) as size from e"
)
def stream_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SS2: a stream whose rows wait per key and are let go by twenties."""
    return streams.gate_stream(spark, streams.source(spark, sf_dir, "events"), "user_id", 20)
