"""Queries over run records and judged texts: kinds, filters, aliases, validity, samples and typed cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graftwork.functions.predicates import is_void, strip
from graftwork.functions.text import canonical_category, has_any, overlap
from graftwork.operators.ordering import numbered, round_robin
from graftwork.plans.features import _BLANKS, _LIST, list_values
from graftwork.plans.list_group import EXPOSURES, VOID, exposures
from graftwork.plans.review import C, CJ, J, candidates, decision_bucket, judgments, latest_judgments
from graftwork.session import cut, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Records with each id once, and whether their payload can be read, in SQL.
R = """with r as (select record_id, request_id, node_id, attempt, captured_at, payload, coalesce(json_valid(payload), false) as ok
      from (select distinct record_id, request_id, node_id, attempt, captured_at, payload from artifact_log)) """


def records(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """(record_id, request_id, node_id, attempt, captured_at, ok, more...): each record once; ok: its payload is JSON."""
    columns = ["record_id", "request_id", "node_id", "attempt", "captured_at", "payload"]
    rows = table(spark, sf_dir, "artifact_log").select(*columns).distinct()
    return rows.withColumn("ok", F.try_parse_json("payload").isNotNull()).select(*columns[:-1], "ok", *more)


_KIND = "case when attempt > 1 then 'trial' else 'production' end"


def _kind() -> Column:
    return F.when(F.col("attempt") > 1, "trial").otherwise("production")


# Records


@query(
    R
    + f""", k as (select *, {_KIND} as kind, not ok as failed, min(attempt) over (partition by request_id, node_id) as least from r)
    select record_id, kind, kind = 'trial' and least > 1 as direct, failed, failed and (kind = 'production' or least > 1) as retryable from k"""
)
def record_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF21, PF22: production or trial record; a trial is direct if its slot has no production record; failed ones can be
    tried again unless they are trials of a slot that has one."""
    k = records(spark, sf_dir).withColumn("least", F.min("attempt").over(Window.partitionBy("request_id", "node_id")))
    trial, failed = _kind() == "trial", ~F.col("ok")
    return k.select(
        "record_id",
        _kind().alias("kind"),
        (trial & (F.col("least") > 1)).alias("direct"),
        failed.alias("failed"),
        (failed & (~trial | (F.col("least") > 1))).alias("retryable"),
    )


@query(
    R
    + """, b as (select request_id, min(case decision when 'reject' then 0 when 'hold' then 1 when 'admit' then 2 else 3 end) as p from (select distinct on (judgment_id) * from judgments) group by 1)
    select r.record_id, r.request_id, case p when 0 then 'reject' else 'hold' end as bucket, cast(p as integer) as priority from r join b using (request_id) where r.ok and p <= 1"""
)
def evidence_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF23: readable records of requests whose severest decision is reject or hold, with its priority."""
    buckets = decision_bucket(spark, sf_dir).filter(F.col("bucket").isin("reject", "hold"))
    rows = records(spark, sf_dir).filter("ok").select("record_id", "request_id")
    return rows.join(buckets.select("request_id", "bucket"), "request_id").select(
        "record_id", "request_id", "bucket", F.when(F.col("bucket") == "reject", 0).otherwise(1).alias("priority")
    )


@query(
    R
    + """, k as (select *, row_number() over (partition by request_id, node_id order by captured_at nulls first, record_id) as rn from r)
    select request_id, node_id, record_id, attempt from k where rn = 1 and request_id in (select request_id from exposure_log)"""
)
def first_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN5: the first record of each slot, of requests that were asked for."""
    asked = table(spark, sf_dir, "exposure_log").select("request_id").filter("request_id is not null").distinct()
    best = F.min_by(F.struct("record_id", "attempt"), F.struct("captured_at", "record_id"))
    first = records(spark, sf_dir).groupBy("request_id", "node_id").agg(best.alias("b"))
    return first.join(asked, "request_id", "left_semi").select("request_id", "node_id", "b.record_id", "b.attempt")


@query(
    EXPOSURES
    + f""", a as (select trim(request_id, {_BLANKS}) as request, min(exposure_id) as seen from e where not {VOID.format('request_id')} group by 1),
    m as (select * from a where request not in (select trim(request_id, {_BLANKS}) from artifact_log where request_id is not null))
    select request, row_number() over (order by seen, request) as place from m"""
)
def uncached_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN6: requests in order of their first sighting, each once, without those that have records already."""
    e = exposures(spark, sf_dir, "request_id").filter(~is_void(F.col("request_id")))
    asked = e.groupBy(strip(F.col("request_id")).alias("request")).agg(F.min("exposure_id").alias("seen"))
    known = table(spark, sf_dir, "artifact_log").select(strip(F.col("request_id")).alias("request")).distinct()
    missing = asked.join(known.filter("request is not null"), "request", "left_anti")
    return numbered(missing, ["seen", "request"], "place").select("request", "place")


@query(
    R
    + """, k as (select *, case when attempt > 1 then 'trial:' || attempt || ':' || request_id else request_id end as run_id from r)
    select record_id, run_id, starts_with(run_id, 'trial:') as is_trial, regexp_replace(run_id, '^trial:[0-9]+:', '') as original,
      array_to_string(list_sort(list_distinct([run_id, request_id, node_id])), ',') as aliases from k where request_id is not null and node_id is not null"""
)
def record_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX26: the run id of a record with the mark of trials, the id it stands for, and all ids it goes by."""
    r = records(spark, sf_dir).filter("request_id is not null and node_id is not null")
    trial = F.concat_ws(":", F.lit("trial"), F.col("attempt").cast("string"), "request_id")
    k = r.withColumn("run_id", F.when(F.col("attempt") > 1, trial).otherwise(F.col("request_id")))
    aliases = F.array_sort(F.array_distinct(F.array("run_id", "request_id", "node_id")))
    return k.select(
        "record_id",
        "run_id",
        F.col("run_id").startswith("trial:").alias("is_trial"),
        F.regexp_replace("run_id", "^trial:[0-9]+:", "").alias("original"),
        F.array_join(aliases, ",").alias("aliases"),
    )


_DENIED = ["total_score", "usage", "judgments", "self_score", "decision"]


@query(
    R
    + f""", k as (select record_id, node_id, unnest(json_keys(payload)) as key from r where ok and json_type(payload) = 'OBJECT')
    select node_id, key, count(*) as n, key in {tuple(_DENIED)} as denied from k group by 1, 2"""
)
def denied_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF20: the keys at the top of the payloads, and whether they are on the list of denied ones."""
    r = records(spark, sf_dir, "payload").filter("ok")
    keys = r.select("node_id", F.explode(F.json_object_keys("payload")).alias("key"))
    return keys.groupBy("node_id", "key").agg(F.count("*").alias("n")).withColumn("denied", F.col("key").isin(*_DENIED))


@query(
    R
    + """, u as (select node_id, record_id, unnest(json_keys(payload, '$.usage')) as key, payload from r where ok and json_type(payload, '$.usage') = 'OBJECT'),
    v as (select node_id, key, try_cast(json_extract_string(payload, '$.usage."' || key || '"') as bigint) as n from u)
    select node_id, key, count(*) as turns, cast(sum(n) as bigint) as total from v where n is not null group by 1, 2"""
)
def usage_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG13, AG18: every numeric counter of the usage objects summed per node; what is no number is skipped."""
    r = records(spark, sf_dir, "payload").filter("ok")
    usage = F.from_json(F.get_json_object("payload", "$.usage"), "map<string,string>")
    cells = r.select("node_id", F.explode(usage).alias("key", "value"))
    n = F.col("value").try_cast("bigint")
    return cells.filter(n.isNotNull()).groupBy("node_id", "key").agg(F.count("*").alias("turns"), F.sum(n).alias("total"))


@query(
    R
    + f"""select node_id, {_KIND} as kind, count(*) as records, cast(count(*) filter (not ok) as bigint) as failed, cast(count(*) filter (ok) as bigint) as done,
      round(count(*) filter (ok) / count(*), 6) as share from r group by 1, 2"""
)
def progress_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG22, SK8: production and trial records per node, how many failed and how many are done."""
    return records(spark, sf_dir).groupBy("node_id", _kind().alias("kind")).agg(
        F.count("*").alias("records"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.count_if("ok").alias("done"),
        F.round(F.count_if("ok") / F.count("*"), 6).alias("share"),
    )


# Judgments and candidates

#: The checks and axes of a whole judgment.
CHECKS = ["no_private_trace", "no_product_name_echo", "no_specific_numeric_claim", "product_value_visible", "publishable_copy"]
AXES = ["benefit_clarity", "conversion_pull", "copycraft", "distinctiveness", "motivation_fit", "product_value", "scene_texture"]


@query(
    J
    + f""", v as (select judgment_id, list_sort(list_transform(coalesce(objective_checks, []), lambda x: x.check_id)) as cs, list_sort(list_transform(coalesce(axis_scores, []), lambda x: x.axis_id)) as xs,
      len(list_filter(coalesce(objective_checks, []), lambda x: not coalesce(x.passed, false))) > 0 as failed, coalesce(list_bool_and(list_transform(axis_scores, lambda x: x.score between 0 and 5)), true) as in_range, total_score, decision from j)
    select judgment_id, case when cs <> {CHECKS} then 'checks' when failed and (coalesce(total_score, -1) <> 0 or len(xs) > 0 or coalesce(decision, '') <> 'reject') then 'failed check with a score'
      when not failed and xs <> {AXES} then 'axes' when not failed and not in_range then 'score range' else 'ok' end as verdict from v"""
)
def rubric_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NM23, PF24: whether a judgment has each check and each axis just once, scores in range, and neither axes nor total
    where a check failed."""
    j = judgments(spark, sf_dir, "objective_checks", "axis_scores", "total_score", "decision")
    none = F.array()
    ids = lambda c, f: F.array_sort(F.transform(F.coalesce(c, none.cast(dict(j.dtypes)[c])), lambda x: x[f]))
    cs, xs = ids("objective_checks", "check_id"), ids("axis_scores", "axis_id")
    listed = lambda names: F.array(*map(F.lit, names))
    failed = F.coalesce(F.exists("objective_checks", lambda x: ~F.coalesce(x.passed, F.lit(False))), F.lit(False))
    in_range = F.coalesce(F.forall("axis_scores", lambda x: x.score.between(0, 5)), F.lit(True))
    scored = (F.coalesce("total_score", F.lit(-1)) != 0) | (F.size(xs) > 0) | (F.coalesce("decision", F.lit("")) != "reject")
    verdict = (
        F.when(cs != listed(CHECKS), "checks")
        .when(failed & scored, "failed check with a score")
        .when(~failed & (xs != listed(AXES)), "axes")
        .when(~failed & ~in_range, "score range")
        .otherwise("ok")
    )
    return j.select("judgment_id", verdict.alias("verdict"))


_E = """, p as (select c.candidate_id, c.source_user_factor_id, length(trim(coalesce(c.text, ''), ' 　')) as size, r.n, c.request_id,
      list_filter(list_distinct(string_split(regexp_replace(lower(coalesce(c.text, '')), '[\\s\\p{Z}]+', '', 'g'), '')), lambda x: x <> '') as a,
      list_filter(list_distinct(string_split(regexp_replace(lower(coalesce(c.product_binding, '')), '[\\s\\p{Z}]+', '', 'g'), '')), lambda x: x <> '') as b
    from c join (select request_id, count(distinct source_user_factor_id) as n from c group by 1) r using (request_id)),
    q as (select *, case when len(a) > 0 and len(b) > 0 then round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) else 0.0 end as overlap from p) """


@query(
    C
    + _E
    + """(select 'E1' as view, candidate_id, cast(n as double) as measure from q order by n desc, candidate_id limit 20)
    union all (select 'E2', candidate_id, cast(size as double) from q order by size, candidate_id limit 20)
    union all (select 'E3', candidate_id, cast(size as double) from q order by size desc, candidate_id limit 20)
    union all (select 'E4', candidate_id, overlap from q order by overlap desc, candidate_id limit 20)"""
)
def extreme_views(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    """WN9, TX8: the k candidates with the most factors beside them, the shortest and longest text, and the text nearest
    to its product binding (k is the feature)."""
    c = candidates(spark, sf_dir, "request_id", "source_user_factor_id", "text", "product_binding")
    per = c.groupBy("request_id").agg(F.count_distinct("source_user_factor_id").alias("n"))
    q = cut(
        c.join(per, "request_id").select(
            "candidate_id",
            F.col("n").cast("double").alias("n"),
            F.length(F.btrim(F.coalesce("text", F.lit("")), F.lit(" 　"))).cast("double").alias("size"),
            F.round(overlap(F.col("text"), F.col("product_binding")), 6).alias("near"),
        )
    )  # read once per view
    view = lambda name, c, order: q.orderBy(order(c), "candidate_id").limit(k).select(
        F.lit(name).alias("view"), "candidate_id", F.col(c).alias("measure")
    )
    parts = [view("E1", "n", F.desc), view("E2", "size", F.asc), view("E3", "size", F.desc), view("E4", "near", F.desc)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


_PRIVATE = ["node=", "signal_basis", "todo", "trace", "user_id"]


@query(
    J
    + f""", f as (select min(judgment_id) as judgment_id, candidate_id, coalesce(total_score, -1) as total, coalesce(decision, '') as decision from j
      where not ({' or '.join(f"coalesce(contains(lower(copy_text), '{t}'), false)" for t in _PRIVATE)}) group by 2, 3, 4),
    b as (select *, decision || '/' || case when total = 0 then 'none' when total < 21 then 'low' when total < 29 then 'mid' else 'high' end as bucket from f),
    t as (select *, row_number() over (partition by bucket order by judgment_id) as turn, min(judgment_id) over (partition by bucket) as seen from b)
    select judgment_id, bucket from t order by turn, seen, judgment_id limit 300"""
)
def sediment_sample(spark: SparkSession, sf_dir: str, n: int = 300) -> DataFrame:
    """WN8: n judgments that take turns over buckets of outcome and score; texts with private terms are left out, and of
    judgments with one signature the first counts (n is the feature)."""
    j = judgments(spark, sf_dir, "candidate_id", "total_score", "decision", "copy_text")
    total, decision = F.coalesce("total_score", F.lit(-1)), F.coalesce("decision", F.lit(""))
    f = j.filter(~has_any(F.col("copy_text"), _PRIVATE)).groupBy("candidate_id", total.alias("total"), decision.alias("decision"))
    f = f.agg(F.min("judgment_id").alias("judgment_id"))
    band = F.when(F.col("total") == 0, "none").when(F.col("total") < 21, "low").when(F.col("total") < 29, "mid").otherwise("high")
    return round_robin(f.select("judgment_id", F.concat_ws("/", "decision", band).alias("bucket")), ["bucket"], "judgment_id", n)


@query(
    CJ
    + """, a as (select c.commercial_angle as angle, count(*) as eligible, count(distinct c.source_user_factor_id) as pipelines from j join c using (candidate_id) where j.decision in ('reject', 'hold') group by 1)
    select angle, eligible, cast(greatest(1, 5, ceil(eligible / ceil(40 / greatest(pipelines, 1)))) as bigint) as threshold,
      eligible >= greatest(1, 5, ceil(eligible / ceil(40 / greatest(pipelines, 1)))) as enough from a"""
)
def gate_thresholds(spark: SparkSession, sf_dir: str, calls: int = 40, least: int = 5) -> DataFrame:
    """WN18: how many waiting rows let a group go: at least ``least``, and so many that ``calls`` shared by its lines
    suffice for all."""
    both = judgments(spark, sf_dir, "candidate_id", "decision").join(
        candidates(spark, sf_dir, "commercial_angle", "source_user_factor_id"), "candidate_id"
    )
    a = both.filter(F.col("decision").isin("reject", "hold")).groupBy(F.col("commercial_angle").alias("angle")).agg(
        F.count("*").alias("eligible"), F.count_distinct("source_user_factor_id").alias("pipelines")
    )
    share = F.ceil(F.lit(calls) / F.greatest("pipelines", F.lit(1)))
    threshold = F.greatest(F.lit(1).cast("long"), F.lit(least).cast("long"), F.ceil(F.col("eligible") / share))
    return a.select("angle", "eligible", threshold.alias("threshold"), (F.col("eligible") >= threshold).alias("enough"))


@query(
    CJ
    + """, l as (select * from (select *, row_number() over (partition by candidate_id order by judged_at desc, judgment_id desc) as rn from j) where rn = 1),
    a as (select distinct c.request_id, c.product_id, c.text from c where c.text is not null), o as (select distinct copy_id, request_id, item_id, copy from offline_copy)
    select o.copy_id, o.copy from o where o.copy is not null and not exists (select 1 from a where a.request_id = o.request_id and a.product_id = o.item_id and a.text = o.copy)"""
)
def touched_up_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN6: served texts that equal no candidate of their request and product: touched up after judging."""
    o = table(spark, sf_dir, "offline_copy").select("copy_id", "request_id", "item_id", "copy").distinct().filter("copy is not null")
    c = candidates(spark, sf_dir, "request_id", "product_id", "text").select("request_id", F.col("product_id").alias("item_id"), F.col("text").alias("copy")).distinct()
    return o.join(c, ["request_id", "item_id", "copy"], "left_anti").select("copy_id", "copy")


@query(
    CJ
    + """, l as (select * from (select *, row_number() over (partition by candidate_id order by judged_at desc, judgment_id desc) as rn from j) where rn = 1),
    k as (select l.judgment_id, l.candidate_id, c.product_id from l join c using (candidate_id) where c.product_id in (select item_id from exposure_log))
    select k.product_id, count(*) as proposals, cast(count(*) filter (o.item_id is null) as bigint) as new_ones from k left join (select distinct item_id from offline_copy where item_id is not null) o on k.product_id = o.item_id group by 1"""
)
def new_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN10: judged candidates of allowed products, and how many are of products not served yet."""
    allowed = table(spark, sf_dir, "exposure_log").select(F.col("item_id").alias("product_id")).filter("product_id is not null").distinct()
    served = table(spark, sf_dir, "offline_copy").select(F.col("item_id").alias("product_id")).filter("product_id is not null").distinct()
    k = latest_judgments(spark, sf_dir).select("candidate_id").join(candidates(spark, sf_dir, "product_id"), "candidate_id")
    k = k.join(allowed, "product_id", "left_semi").groupBy("product_id").agg(F.count("*").alias("proposals"))
    new = k.join(served.withColumn("served", F.lit(True)), "product_id", "left")
    return new.select("product_id", "proposals", F.when(F.col("served"), F.lit(0).cast("long")).otherwise(F.col("proposals")).alias("new_ones"))


# Cells and categories


@query(
    f"""with s as (select distinct on (state_id) * from user_state), c as (select unnest([{{'field': 'vip_level', 'cell': vip_level}}, {{'field': 'register_days', 'cell': cast(register_days as varchar)}},
      {{'field': 'purchase_price_avg_30d', 'cell': cast(purchase_price_avg_30d as varchar)}}, {{'field': 'prefer_cat3_topk', 'cell': prefer_cat3_topk}}, {{'field': 'request_id', 'cell': request_id}}], recursive := true) from s),
    t as (select field, trim(cell, {_BLANKS}) as cell from c)
    select field, case when coalesce(cell, '') = '' then 'absent' when regexp_matches(field, 'topn|topk|_list$|^seq_') then 'list' when regexp_matches(cell, '^[\\[{{]') and json_valid(cell) then 'json'
      when regexp_matches(cell, '^[+-]?[0-9]+$') then 'int' when try_cast(cell as double) is not null and regexp_matches(cell, '^[+-]?([0-9]|\\.[0-9])[0-9.eE+-]*$') then 'float' else 'text' end as kind, count(*) as n from t group by 1, 2"""
)
def typed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC8, SC9: what each cell is read as: a list by the field's name; else JSON if bracketed, a whole number, a number,
    or text. Ids longer than 64 bits stay whole numbers as text."""
    columns = ["vip_level", "register_days", "purchase_price_avg_30d", "prefer_cat3_topk", "request_id"]
    s = table(spark, sf_dir, "user_state").select("state_id", *columns).distinct()
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("cell")) for c in columns])
    t = s.select(F.inline(pairs)).withColumn("cell", strip(F.col("cell")))
    cell = F.col("cell")
    kind = (
        F.when(F.coalesce(cell, F.lit("")) == "", "absent")
        .when(F.col("field").rlike("topn|topk|_list$|^seq_"), "list")
        .when(cell.rlike(r"^[\[{]") & F.try_parse_json(cell).isNotNull(), "json")
        .when(cell.rlike("^[+-]?[0-9]+$"), "int")
        .when(cell.try_cast("double").isNotNull() & cell.rlike(r"^[+-]?([0-9]|\.[0-9])[0-9.eE+-]*$"), "float")
        .otherwise("text")
    )
    return t.groupBy("field", kind.alias("kind")).agg(F.count("*").alias("n"))


#: Fixed values of this query: names that are of no category, names and patterns of the others, and one that counts as a part.
NEGATIVES = ["维生素饮料", "香水瓶"]
ALIASES = {"香水": "香水", "淡香水": "香水", "综合维生素": "维生素", "维生素": "维生素"}
PATTERNS = {"枕套": "(家用|便携|户外|车用|婴儿)枕套", "围裙": "(女士|男士|儿童|运动|家用|孕妇)围裙"}
PART = "护肩"


def _category_sql(c: str) -> str:
    n = f"regexp_replace({c}, '[\\s\\p{{Z}}]+', '', 'g')"
    names = ", ".join(f"'{x}'" for x in NEGATIVES)
    alias = " ".join(f"when {n} = '{a}' then '{b}'" for a, b in ALIASES.items())
    pats = " ".join(f"when regexp_full_match({n}, '{p}') then '{b}'" for b, p in PATTERNS.items())
    return f"case when {n} in ({names}) then null {alias} {pats} when list_contains(regexp_split_to_array({c}, '[/／、,，\\s]+'), '{PART}') then '{PART}' end"


@query(
    EXPOSURES
    + f", k as (select exposure_id, coalesce({_category_sql('item_cat3_name')}, {_category_sql('item_cat1_name')}) as category from e) select category, count(*) as n, min(exposure_id) as first_seen from k group by 1"
)
def row_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX2, TX3: the class of an exposure: the first of its category names that has one."""
    e = exposures(spark, sf_dir, "item_cat3_name", "item_cat1_name")
    of = lambda c: canonical_category(F.col(c), NEGATIVES, ALIASES, PATTERNS, PART)
    k = e.select("exposure_id", F.coalesce(of("item_cat3_name"), of("item_cat1_name")).alias("category"))
    return k.groupBy("category").agg(F.count("*").alias("n"), F.min("exposure_id").alias("first_seen"))


@query(
    f"""with s as (select distinct on (state_id) * from user_state), l as (select state_id, list_distinct(list_filter(list_transform({_LIST.format('prefer_cat3_topk')}, lambda v: {_category_sql('v')}), lambda v: v is not null)) as cs from s)
    select state_id, array_to_string(list_sort(cs), ',') as categories from l where len(cs) > 0"""
)
def preferred_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG28: the set of classes of a snapshot's preferred categories; snapshots without any are left out."""
    s = table(spark, sf_dir, "user_state").select("state_id", "prefer_cat3_topk").distinct()
    of = lambda v: canonical_category(v, NEGATIVES, ALIASES, PATTERNS, PART)
    sets = F.array_sort(F.array_distinct(F.array_compact(F.transform(list_values(F.col("prefer_cat3_topk")), of))))
    return s.select("state_id", sets.alias("cs")).filter(F.size("cs") > 0).select("state_id", F.array_join("cs", ",").alias("categories"))


@query(
    """with w as (select user_id, event_id, value, count(*) over r as n, avg(value) over r as mean from events window r as (partition by user_id order by event_id rows between 49 preceding and current row))
    select event_id, case when n < 5 or mean is null then 0.0 else round(least(1.0, greatest(0.0, mean / 80)), 8) end as pressure from w"""
)
def rolling_pressure(spark: SparkSession, sf_dir: str, budget: float = 80.0) -> DataFrame:
    """WN13: the mean of a user's last 50 values against a budget, between 0 and 1; 0 below 5 values. A user's events are
    sorted in one task, like those of ``rolling_signal``."""
    last = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-49, 0)
    n, mean = F.count("*").over(last), F.avg("value").over(last)
    share = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), mean / budget)), 8)
    pressure = F.when((n < 5) | mean.isNull(), F.lit(0.0)).otherwise(share)
    return table(spark, sf_dir, "events").select("event_id", pressure.alias("pressure"))


# Surfaces, failures and reports


@query(
    R
    + """, n as (select request_id, list(distinct node_id) as nodes from r where request_id is not null and node_id is not null group by 1),
    t as (select request_id, list(distinct tag) as tags from (select request_id, unnest(failure_tags) as tag from (select distinct on (judgment_id) * from judgments)) where tag is not null group by 1),
    u as (select n.request_id, list_sort(list_distinct(list_concat(nodes, coalesce(tags, [])))) as surfaces, tags from n left join t using (request_id))
    select request_id, array_to_string(surfaces, ',') as surfaces, tags is null or list_has_any(tags, ['publishable_copy', 'product_value_visible']) as target_matches from u"""
)
def applicable_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF16, PF18: the sorted union of a request's nodes and of the tags of its judgments, and whether the tags match the
    targets: no tags match all."""
    n = records(spark, sf_dir).filter("request_id is not null and node_id is not null").groupBy("request_id").agg(F.collect_set("node_id").alias("nodes"))
    tags = judgments(spark, sf_dir, "request_id", "failure_tags").select("request_id", F.explode("failure_tags").alias("tag"))
    t = tags.filter("tag is not null").groupBy("request_id").agg(F.collect_set("tag").alias("tags"))  # as many as there are kinds
    u = n.join(t, "request_id", "left")
    union = F.array_sort(F.array_distinct(F.concat("nodes", F.coalesce("tags", F.array().cast("array<string>")))))
    targets = F.array(F.lit("publishable_copy"), F.lit("product_value_visible"))
    return u.select(
        "request_id", F.array_join(union, ",").alias("surfaces"), (F.col("tags").isNull() | F.arrays_overlap("tags", targets)).alias("target_matches")
    )


@query(
    R
    + rf"""select record_id, request_id, node_id, {_KIND} as kind, case when payload is null then 'absent' when trim(payload, {_BLANKS}) = '' then 'blank'
      when regexp_matches(trim(payload, {_BLANKS}), '^[\[{{"]') then 'truncated' else 'no JSON' end as failure_class, coalesce(length(payload), 0) as size from r where not ok"""
)
def failure_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF28, PF22: the records that failed, as a report shows them: ids, kind, class of failure and size."""
    text = strip(F.col("payload"))
    failure = F.when(F.col("payload").isNull(), "absent").when(text == "", "blank").when(text.rlike(r'^[\[{"]'), "truncated").otherwise("no JSON")
    r = records(spark, sf_dir, "payload").filter("not ok")
    size = F.coalesce(F.length("payload"), F.lit(0)).cast("long")
    return r.select("record_id", "request_id", "node_id", _kind().alias("kind"), failure.alias("failure_class"), size.alias("size"))


@query(
    C
    + """, r as (select request_id, count(distinct source_user_factor_id) as f, count(*) as n, (count(text) = count(*))::int as complete from c group by 1),
    o as (select user_id, count(*) as trials from events where value is not null group by 1)
    select 'median_factors' as metric, cast(median(f) as double) as value from r union all select 'median_candidates', cast(median(n) as double) from r
    union all select 'completion_rate', round(coalesce(avg(complete) filter (f < 3), 1.0), 6) from r union all select 'angles', cast(count(distinct commercial_angle) as double) from c
    union all select 'belief_updates', cast(count(*) as double) from customer join o on c_custkey = user_id"""
)
def behaviour_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG31, AG8, AG10-AG12: the parts of the behaviour report, a row each."""
    c = candidates(spark, sf_dir, "request_id", "source_user_factor_id", "text", "commercial_angle")
    per = c.groupBy("request_id").agg(
        F.count_distinct("source_user_factor_id").alias("f"), F.count("*").alias("n"), (F.count("text") == F.count("*")).cast("int").alias("complete")
    )
    rate = F.round(F.coalesce(F.avg(F.when(F.col("f") < 3, F.col("complete"))), F.lit(1.0)), 6)
    metrics = {"median_factors": F.median("f"), "median_candidates": F.median("n"), "completion_rate": rate}
    one = per.agg(*[v.cast("double").alias(k) for k, v in metrics.items()])
    rows = one.unpivot([], list(metrics), "metric", "value")
    tried = table(spark, sf_dir, "events").filter("value is not null").select(F.col("user_id").alias("c_custkey")).distinct()
    updated = table(spark, sf_dir, "customer").join(tried, "c_custkey", "left_semi")
    count = lambda name, df, value: df.agg(value.cast("double").alias("value")).select(F.lit(name).alias("metric"), "value")
    return rows.unionByName(count("angles", c, F.count_distinct("commercial_angle"))).unionByName(count("belief_updates", updated, F.count("*")))


def _json_text(c: Column) -> Column:
    """A text as a JSON string, null as null."""
    return F.coalesce(F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1), F.lit("null"))


_ID_FIELDS = {"angle": "commercial_angle", "binding": "product_binding", "factor": "source_user_factor_id", "text": "text"}


@query(
    C
    + "select candidate_id, 'D_' || left(sha256('{' || "
    + " || ', ' || ".join(f"'\"{k}\": ' || coalesce(cast(to_json({v}) as varchar), 'null')" for k, v in _ID_FIELDS.items())
    + " || '}'), 12) as content_id from c"
)
def content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX10: ids made of four fields: a hash of their JSON, keys in order, with a space after each comma and colon."""
    c = candidates(spark, sf_dir, *_ID_FIELDS.values())
    cells = []
    for k, v in _ID_FIELDS.items():
        cells += [F.lit(f'"{k}": '), F.when(F.col(v).isNull(), "null").otherwise(_json_text(F.col(v))), F.lit(", ")]
    text = F.concat(F.lit("{"), *cells[:-1], F.lit("}"))
    return c.select("candidate_id", F.concat(F.lit("D_"), F.left(F.sha2(text, 256), F.lit(12))).alias("content_id"))


@query(
    "select doc_id, cast(case when text is null then 0 else len(list_distinct(string_split(lower(text), ''))) end as integer) as characters, md5(coalesce(text, '')) as key from documents where text is null or text <> ''"
)
def computed_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RL4: a costly result computed once per distinct content and joined back by its key; null has a key of its own."""
    d = table(spark, sf_dir, "documents").filter("text is null or text <> ''").select("doc_id", "text", F.md5(F.coalesce("text", F.lit(""))).alias("key"))
    distinct = d.groupBy("key").agg(F.first("text").alias("text"))
    result = distinct.select("key", F.coalesce(F.size(F.array_distinct(F.split(F.lower("text"), ""))), F.lit(0)).alias("n"))
    joined = d.select("doc_id", "key").join(result, "key")
    return joined.select("doc_id", F.greatest("n", F.lit(0)).alias("characters"), "key")
