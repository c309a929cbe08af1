"""Queries over the exposure log and user state: identities, list groups, summaries, alignment and bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graftwork.functions.numeric import banded, relative_to, to_flag
from graftwork.functions.predicates import filled_leaf, first_valid, is_void
from graftwork.functions.text import canonical_name, safe_name, signature
from graftwork.operators.ordering import frequency_text, numbered, one_per_key, rank_text
from graftwork.session import cut, table
from graftwork.sources.delimited import delimited_line, repaired_rows, unescaped

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: The void rule, and the exposure log with each exposure once, in SQL.
VOID = "coalesce(lower(trim({0}, ' \t\n\r　')) in ('', '0', '0.0', 'none', 'null', 'nan'), true)"
EXPOSURES = "with e as (select distinct * from exposure_log) "


def exposures(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Each exposure once, with the columns asked for. Re-sent rows repeat the whole row, so equal rows are merged by a
    hash aggregate; keeping one row per key would have to sort before the shuffle."""
    return table(spark, sf_dir, "exposure_log").select(*dict.fromkeys(["exposure_id", *columns])).distinct()


@query(
    EXPOSURES
    + f"""select exposure_id,
      case when not {VOID.format('request_id')} then trim(request_id, ' 　') when not {VOID.format('mid')} then trim(mid, ' 　') end as request,
      case when not {VOID.format('item_id')} then trim(item_id, ' 　') when not {VOID.format('spu_id')} then trim(spu_id, ' 　') end as product
    from e"""
)
def identity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF1, PF2, SC22: the request and product of an exposure from the first valid id."""
    e = exposures(spark, sf_dir, "request_id", "mid", "item_id", "spu_id")
    return e.select(
        "exposure_id",
        first_valid(F.col("request_id"), F.col("mid")).alias("request"),
        first_valid(F.col("item_id"), F.col("spu_id")).alias("product"),
    )


@query("select exposure_id, max(arrived_at) as arrived, count(*) as copies from exposure_log group by 1")
def latest_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN4, SS4: the latest copy of a re-sent row, and how many came."""
    log = table(spark, sf_dir, "exposure_log")
    return log.groupBy("exposure_id").agg(F.max("arrived_at").alias("arrived"), F.count("*").alias("copies"))


@query(
    EXPOSURES
    + """, r as (select request_id, min(exposure_id) as seen from e where request_id is not null group by 1 order by seen limit 200)
    select e.request_id, count(*) as n_rows, min(e.exposure_id) as first_row from e join r using (request_id) group by 1"""
)
def first_n_requests(spark: SparkSession, sf_dir: str, n: int = 200) -> DataFrame:
    """SC5, SC6: the rows of the first n requests in arrival order (n is the feature)."""
    e = exposures(spark, sf_dir, "request_id").filter("request_id is not null")
    first = e.groupBy("request_id").agg(F.min("exposure_id").alias("seen")).orderBy("seen").limit(n)
    rows = e.join(first.select("request_id"), "request_id", "left_semi")
    return rows.groupBy("request_id").agg(F.count("*").alias("n_rows"), F.min("exposure_id").alias("first_row"))


@query(
    EXPOSURES
    + """, r as (select request_id, count(*) as n_rows from e where request_id is not null group by 1)
    select request_id, n_rows, request_id in (select request_id from judgments) as completed from r"""
)
def pending_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN11, JN12: requests with their rows, and whether they are done, by a semi and an anti join."""
    e = exposures(spark, sf_dir, "request_id").filter("request_id is not null")
    per = e.groupBy("request_id").agg(F.count("*").alias("n_rows"))
    done = table(spark, sf_dir, "judgments").select("request_id").distinct()
    finished = per.join(done, "request_id", "left_semi").withColumn("completed", F.lit(True))
    return finished.unionByName(per.join(done, "request_id", "left_anti").withColumn("completed", F.lit(False)))


_PRODUCTS = f"""
    , p as (select request_id, exposure_id,
        case when goods_seq is null or goods_seq = 0 then exposure_id else goods_seq end as pos,
        case when not {VOID.format('item_id')} then 'id:' || trim(item_id, ' 　') when not {VOID.format('spu_id')} then 'id:' || trim(spu_id, ' 　') else 'name:' || coalesce(item_name, '') end as k
      from e where not {VOID.format('request_id')}),
    w as (select *, row_number() over (partition by request_id, k order by pos, exposure_id) as rn,
        min(exposure_id) over (partition by request_id, k) as slot from p),
    d as (select * from w where rn = 1)"""


@query(
    EXPOSURES
    + _PRODUCTS
    + """ select request_id, count(*) as n_products, string_agg(k, '|' order by pos, slot) as products,
      min(exposure_id) as first_exposure from d group by 1"""
)
def list_group_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN1, WN2, AG1, AG29: a request's products, each once by identity or name, in position order.

    The smallest position of a product wins; a position of 0 counts as the row's number; ties in the list go by the
    product's first sighting."""
    e = exposures(spark, sf_dir, "request_id", "goods_seq", "item_id", "spu_id", "item_name")
    identity = first_valid(F.col("item_id"), F.col("spu_id"))
    key = F.coalesce(F.concat(F.lit("id:"), identity), F.concat(F.lit("name:"), F.coalesce("item_name", F.lit(""))))
    pos = F.coalesce(F.nullif(F.col("goods_seq").cast("long"), F.lit(0).cast("long")), F.col("exposure_id"))
    rows = e.filter(~is_void(F.col("request_id"))).select("request_id", "exposure_id", pos.alias("pos"), key.alias("k"))
    # One aggregate finds the winning row and the first sighting together.
    product = rows.groupBy("request_id", "k").agg(
        F.min(F.struct("pos", "exposure_id")).alias("best"), F.min("exposure_id").alias("slot")
    )
    entry = F.struct(F.col("best.pos").alias("pos"), "slot", "k")
    return product.groupBy("request_id").agg(
        F.count("*").alias("n_products"),
        F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x.k), "|").alias("products"),
        F.min("best.exposure_id").alias("first_exposure"),
    )


@query(
    EXPOSURES
    + """select coalesce(i.cat1, '(skipped)') as category, count(*) as n, count(distinct e.item_cat3_name) as names
    from e left join cat3_cat1_index i on e.item_cat3_name = i.cat3 group by 1"""
)
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX2, TX3, AG2, PF13, JN7: rows per category by the dimension table; names it lacks are skipped but counted."""
    e = exposures(spark, sf_dir, "item_cat3_name")
    index = table(spark, sf_dir, "cat3_cat1_index").select(F.col("cat3").alias("item_cat3_name"), "cat1")
    joined = e.join(index, "item_cat3_name", "left")  # the planner broadcasts the dimension if it is small
    return joined.groupBy(F.coalesce("cat1", F.lit("(skipped)")).alias("category")).agg(
        F.count("*").alias("n"), F.count_distinct("item_cat3_name").alias("names")
    )


@query(
    EXPOSURES
    + r""", c as (select exposure_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(item_name,
        '^[\s\p{Z}]*[\[【(（「][^\]】)）」]*[\]】)）」]', ''), '\p{Nd}+', '', 'g'), '[\s\x0b\x{85}\p{Z}]+', '', 'g'),
        '^[^\p{L}\p{M}]+|[^\p{L}\p{M}]+$', '', 'g') as name from e where item_name is not null)
    select name, count(*) as n, min(exposure_id) as first_seen from c group by 1"""
)
def canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX1, TX4: product names without tags, digits, white space and edge punctuation."""
    e = exposures(spark, sf_dir, "item_name").filter("item_name is not null")
    named = e.select("exposure_id", canonical_name(F.col("item_name")).alias("name"))
    return named.groupBy("name").agg(F.count("*").alias("n"), F.min("exposure_id").alias("first_seen"))


@query(
    EXPOSURES
    + """select exposure_id, nullif(user_id, '') as user_id, nullif(item_name, '') as item_name, nullif(device_type, '') as device_type from e"""
)
def delimited_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC2: rows as delimited lines whose names hold the delimiter bare, read back with the surplus fields repaired."""
    columns = ["exposure_id", "user_id", "item_name", "device_type"]
    e = exposures(spark, sf_dir, *columns)
    lines = e.select(delimited_line(columns, "#", "item_name").alias("line"))
    rows = repaired_rows(lines, "line", columns, "#", "item_name")
    return rows.select(F.col("exposure_id").cast("long").alias("exposure_id"), *[unescaped(F.col(c)).alias(c) for c in columns[1:]])


_TOKENS = """, t as (select user_id, item_cat3_name as tok, count(*) as n, min(exposure_id) as first
      from e where user_id is not null and item_cat3_name is not null group by 1, 2)"""


@query(
    EXPOSURES
    + _TOKENS
    + """, r as (select *, row_number() over (partition by user_id order by n desc, first, tok) as rn from t)
    select user_id, string_agg(tok || '(' || n || ')', ', ' order by rn) as summary from r where rn <= 5 group by 1"""
)
def behaviour_topk_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG26, AG32: a user's five most frequent categories, ties by first sighting."""
    e = exposures(spark, sf_dir, "user_id", "item_cat3_name").filter("user_id is not null")
    return frequency_text(e, ["user_id"], "item_cat3_name", "exposure_id", 5)


@query(
    EXPOSURES
    + _TOKENS
    + """, r as (select *, row_number() over (partition by user_id order by first, tok) as rn from t)
    select user_id, string_agg(tok || '(rank=' || rn || ')', ', ' order by rn) as summary from r where rn <= 10 group by 1"""
)
def behaviour_rank_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN3: a user's first ten distinct categories."""
    e = exposures(spark, sf_dir, "user_id", "item_cat3_name").filter("user_id is not null")
    return rank_text(e, ["user_id"], "item_cat3_name", "exposure_id", 10)


@query(
    EXPOSURES
    + """, l as (select e.user_id, b.level, count(*) as n, min(e.exposure_id) as first from e join brand_level_index b
        on e.item_brand_name = b.brand where b.level is not null and e.user_id is not null group by 1, 2),
    r as (select *, row_number() over (partition by user_id order by n desc, first, level) as rn from l)
    select user_id, level, n from r where rn = 1"""
)
def typical_brand_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG27, JN7: the level of brand a user meets most, ties by first sighting."""
    e = exposures(spark, sf_dir, "user_id", "item_brand_name").filter("user_id is not null")
    index = table(spark, sf_dir, "brand_level_index").filter("level is not null")
    met = e.join(index, e.item_brand_name == index.brand)
    counted = met.groupBy("user_id", "level").agg(F.count("*").alias("n"), F.min("exposure_id").alias("first"))
    best = counted.groupBy("user_id").agg(F.min(F.struct(-F.col("n"), "first", "level", "n")).alias("b"))
    return best.select("user_id", "b.level", "b.n")


@query(
    EXPOSURES
    + """, c as (select distinct user_id, item_cat3_name as cat3 from e where is_clk_c = 1 and user_id is not null and item_cat3_name is not null),
    k as (select distinct c.user_id, i.cat1 from c join cat3_cat1_index i using (cat3) where i.cat1 is not null),
    b as (select distinct user_id, item_brand_name as brand from e where is_clk_c = 1 and user_id is not null and item_brand_name is not null)
    select e.exposure_id,
      case when e.item_cat3_name is null then 'unknown' when c.user_id is not null then 'aligned' when k.user_id is not null then 'adjacent' else 'mismatch' end as cat3_alignment,
      case when e.item_brand_name is null then 'unknown' when b.user_id is not null then 'aligned' else 'mismatch' end as brand_alignment
    from e left join c on e.user_id = c.user_id and e.item_cat3_name = c.cat3
    left join cat3_cat1_index i on e.item_cat3_name = i.cat3
    left join k on e.user_id = k.user_id and i.cat1 = k.cat1
    left join b on e.user_id = b.user_id and e.item_brand_name = b.brand"""
)
def alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NM9, NM10, PF15: how an exposure's category and brand fit what the user clicked."""
    e = cut(exposures(spark, sf_dir, "user_id", "is_clk_c", "item_cat3_name", "item_brand_name"))  # read four times
    index = table(spark, sf_dir, "cat3_cat1_index")
    clicked = e.filter("is_clk_c = 1 and user_id is not null")
    cats = clicked.filter("item_cat3_name is not null").select("user_id", F.col("item_cat3_name").alias("cat3")).distinct()
    tops = cats.join(index, "cat3").filter("cat1 is not null").select("user_id", "cat1").distinct()
    brands = clicked.filter("item_brand_name is not null").select("user_id", F.col("item_brand_name").alias("brand")).distinct()
    flag = lambda df, name: df.withColumn(name, F.lit(True))
    rows = e.select("exposure_id", "user_id", F.col("item_cat3_name").alias("cat3"), F.col("item_brand_name").alias("brand"))
    rows = rows.join(index, "cat3", "left").join(flag(cats, "c"), ["user_id", "cat3"], "left")
    rows = rows.join(flag(tops, "k"), ["user_id", "cat1"], "left").join(flag(brands, "b"), ["user_id", "brand"], "left")
    fit = F.when(F.col("cat3").isNull(), "unknown").when(F.col("c"), "aligned").when(F.col("k"), "adjacent")
    brand = F.when(F.col("brand").isNull(), "unknown").when(F.col("b"), "aligned")
    return rows.select(
        "exposure_id",
        fit.otherwise("mismatch").alias("cat3_alignment"),
        brand.otherwise("mismatch").alias("brand_alignment"),
    )


@query(
    EXPOSURES
    + """, m as (select user_id, avg(item_arriv_price) as base from e where is_clk_c = 1 and item_arriv_price is not null and not isnan(item_arriv_price) group by 1),
    r as (select e.exposure_id, case when m.base > 0 then (e.item_arriv_price - m.base) / m.base end as ratio, e.review_cnt, e.ctr_7d, e.is_new
      from e left join m using (user_id))
    select exposure_id, round(ratio, 6) as ratio,
      case when ratio is null or isnan(ratio) then 'unknown' when ratio < -0.5 then 'far below' when ratio < 0.5 then 'near' else 'far above' end as price_band,
      case when review_cnt is null or isnan(review_cnt) then 'none' when review_cnt < 100 then 'few' when review_cnt < 1000 then 'some' else 'many' end as review_band,
      coalesce(is_new = 1, false) as is_new
    from r"""
)
def baseline_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NM2, NM7: a price against the user's own mean, and banded numbers; cuts and labels are parameters. All eleven
    features of the survey: ``derived_features``."""
    e = exposures(spark, sf_dir, "user_id", "is_clk_c", "item_arriv_price", "review_cnt", "is_new")
    priced = e.filter((F.col("is_clk_c") == 1) & F.col("item_arriv_price").isNotNull() & ~F.isnan("item_arriv_price"))
    means = priced.groupBy("user_id").agg(F.avg("item_arriv_price").alias("base"))
    ratio = relative_to(F.col("item_arriv_price"), F.col("base"))
    rows = e.join(means, "user_id", "left").withColumn("r", ratio)
    return rows.select(
        "exposure_id",
        F.round("r", 6).alias("ratio"),
        banded(F.col("r"), [-0.5, 0.5], ["far below", "near", "far above"], "unknown").alias("price_band"),
        banded(F.col("review_cnt"), [100, 1000], ["few", "some", "many"], "none").alias("review_band"),
        to_flag(F.col("is_new")).alias("is_new"),
    )


_LEAVES = [
    "user_id", "age", "gender", "city_level", "vip_level", "is_svip", "register_days", "click_cnt_30d", "cart_cnt_30d", "order_cnt_30d",
    "order_cnt_90d", "coupon_use_cnt_30d", "purchase_price_avg_30d", "fav_price_avg_30d", "active_days_30d", "prefer_cat3_topk",
    "prefer_brand_topk", "seq_click_cat3_48h", "order_goods_id_list_topn", "day_of_week", "hour", "device_type",
]
_LISTS = ["addcart_goods_id_list_topn", "collect_goods_id_list_topn"]


@query(
    "with s as (select distinct on (state_id) * from user_state), d as (select state_id, (0"
    + "".join(f" + coalesce((cast({c} as varchar) <> '')::int, 0)" for c in _LEAVES)
    + "".join(f" + coalesce(len(list_filter({c}, lambda x: x <> '')), 0)" for c in _LISTS)
    + ")::int as leaves from s) select state_id, leaves, case when leaves <= 2 then 'sparse' when leaves <= 6 then 'medium' else 'rich' end as band from d"
)
def state_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NM7 and the leaf rule of section 1.3: how many leaves of a snapshot are filled, members of lists too; 0 and false
    count."""
    states = table(spark, sf_dir, "user_state").select("state_id", *_LEAVES, *_LISTS).distinct()
    return states.select("state_id", leaves().alias("leaves")).withColumn("band", density_band(F.col("leaves")))


def leaves() -> Column:
    members = [F.size(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x != "")) for c in _LISTS]
    return sum([filled_leaf(F.col(c)) for c in _LEAVES] + members, F.lit(0))


def density_band(c: Column) -> Column:
    return banded(c, [3, 7], ["sparse", "medium", "rich"], "sparse")


@query(
    "with s as (select distinct on (state_id) * from user_state where user_id is not null), "
    "r as (select *, row_number() over (partition by user_id order by logged_at desc, state_id desc) as rn from s) "
    "select user_id, state_id, logged_at, vip_level from r where rn = 1"
)
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN4: a user's latest snapshot."""
    states = table(spark, sf_dir, "user_state").select("user_id", "state_id", "logged_at", "vip_level")
    known = states.filter("user_id is not null").dropDuplicates(["state_id"])
    return one_per_key(known, ["user_id"], [F.desc("logged_at"), F.desc("state_id")])


@query(
    EXPOSURES
    + """, r as (select request_id, string_agg(distinct item_cat3_name, ',' order by item_cat3_name) as sig, count(distinct item_id) as n
        from e where request_id is not null group by 1),
    k as (select request_id, coalesce(sig, 'unknown') as category, case when n <= 1 then '1' when n <= 3 then '2-3' when n <= 6 then '4-6' else '7+' end as band from r)
    select request_id, category, band, 'cat=' || category || '|count=' || band as wide_key, 'cat=' || category as cat_key, 'count=' || band as count_key from k"""
)
def similarity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX20, TX21, NM7: a request's category signature, count band and composed keys."""
    e = exposures(spark, sf_dir, "request_id", "item_cat3_name", "item_id").filter("request_id is not null")
    per = e.groupBy("request_id").agg(
        signature(F.collect_set("item_cat3_name")).alias("category"), F.count_distinct("item_id").alias("n")
    )
    band = banded(F.col("n"), [2, 4, 7], ["1", "2-3", "4-6", "7+"], "1")
    per = per.select("request_id", "category", band.alias("band"))
    cat, count = F.concat(F.lit("cat="), "category"), F.concat(F.lit("count="), "band")
    return per.select("*", F.concat_ws("|", cat, count).alias("wide_key"), cat.alias("cat_key"), count.alias("count_key"))


@query(
    EXPOSURES
    + """select case when coalesce(regexp_replace(translate(trim(device_type), '/\\:', '___'), '^\\.+', ''), '') = '' then 'node'
      else regexp_replace(translate(trim(device_type), '/\\:', '___'), '^\\.+', '') end as name, count(*) as n from e group by 1"""
)
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF25, TX27: names fit for paths."""
    e = exposures(spark, sf_dir, "device_type")
    return e.groupBy(safe_name(F.col("device_type")).alias("name")).agg(F.count("*").alias("n"))


@query(
    EXPOSURES
    + """, r as (select request_id, min(exposure_id) as seen from e where request_id is not null group by 1),
    n as (select request_id, row_number() over (order by seen) as slot from r)
    select request_id, slot, ((slot - 1) // 50)::bigint as wave from n"""
)
def slot_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN19: requests numbered in order and cut into waves of 50, without one task that sees all."""
    e = exposures(spark, sf_dir, "request_id").filter("request_id is not null")
    first = e.groupBy("request_id").agg(F.min("exposure_id").alias("seen"))
    rows = numbered(first, ["seen"], "slot")
    return rows.select("request_id", "slot", F.floor((F.col("slot") - 1) / 50).alias("wave"))


@query(
    EXPOSURES
    + """, w as (select user_id, exposure_id, count(*) over r as n, sum((is_clk_c = 1)::int) over r as clicks from e where user_id is not null
      window r as (partition by user_id order by exposure_id rows between 49 preceding and current row))
    select exposure_id, user_id, n, case when n < 10 then 0.0 else round(coalesce(clicks, 0) / n, 6) end as click_rate from w"""
)
def rolling_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN13, SS3: a user's click rate over the last 50 exposures, 0 below 10."""
    e = exposures(spark, sf_dir, "user_id", "is_clk_c").filter("user_id is not null")
    last = Window.partitionBy("user_id").orderBy("exposure_id").rowsBetween(-49, 0)
    n, clicks = F.count("*").over(last), F.sum((F.col("is_clk_c") == 1).cast("int")).over(last)
    rate = F.when(n < 10, F.lit(0.0)).otherwise(F.round(F.coalesce(clicks, F.lit(0)) / n, 6))
    return e.select("exposure_id", "user_id", n.alias("n"), rate.alias("click_rate"))
