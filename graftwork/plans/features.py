"""Queries over exposures and their request's snapshot: derived features, attributes, profiles, scenarios, node inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graftwork.functions.numeric import banded, relative_to, to_flag
from graftwork.functions.predicates import clean_tokens, first_valid, is_void, list_values, strip
from graftwork.functions.text import canonical_name, mapped
from graftwork.plans.list_group import _LEAVES, _LISTS, EXPOSURES, VOID, density_band, exposures, leaves, similarity_keys
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


#: Levels of brands from the highest, cuts and labels of bands, words of codes, caps of numbers.
BRAND_LEVELS = ["国际A", "国际B", "国际C", "国内A", "国内B", "国内C", "国内D"]
PRICE_CUTS, PRICE_LABELS = [-0.5, -0.15, 0.15, 0.5, 2.0], ["远低于", "略低于", "持平", "略高于", "远高于", "远超出"]
NO_PRICE = "无基线"
REVIEW_CUTS, REVIEW_LABELS = [51, 415, 1980, 12100], ["cold", "low", "normal", "popular", "hot"]
CTR_CUTS, CTR_LABELS = [0.069, 0.179, 0.302], ["low", "mid", "high", "very_high"]
ACTIVITY_CUTS, ACTIVITY_LABELS = [400, 1260, 1626], ["低", "中", "高", "极高"]
GENDERS = {0: "未知", 1: "男", 2: "女", 3: "未知"}
CITIES = {1: "一线城市", 2: "二线城市", 3: "三线城市", 4: "四线城市", 5: "五线城市", 6: "下沉城市"}
VIPS = ["金卡会员", "银卡会员", "白金卡会员"]
DEVICES = {"shop_android": "Android", "shop_iphone": "iPhone"}
CAPS = {"ctr_7d": 1.0, "item_satisfy": 1.0, "return_rate_30d": 1.0, "discount_rate": 1.0}

_BLANKS = "' \t\n\r　'"
#: A plainly delimited list of column {0}, and the first snapshot of each request, in SQL.
_LIST = (
    f"list_filter(list_transform(string_split(coalesce({{0}}, ''), ','), lambda x: trim(split_part(x, '(', 1), {_BLANKS})), "
    f"lambda x: lower(x) not in ('', '0', '0.0', 'none', 'null', 'nan'))"
)
_FIRST = f""", s as (select * from (select *, row_number() over (partition by request_id order by logged_at nulls first, state_id) as rn from user_state
      where not {VOID.format('request_id')}) where rn = 1)"""


def first_states(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """(request_id, columns...): the first snapshot of each request, by an aggregate that combines before the shuffle."""
    rows = table(spark, sf_dir, "user_state").filter(~is_void(F.col("request_id")))
    best = F.min_by(F.struct(*columns), F.struct("logged_at", "state_id"))
    return rows.groupBy("request_id").agg(best.alias("b")).select("request_id", *[F.col(f"b.{c}").alias(c) for c in columns])


def _case(value: str, cuts: list, labels: list[str]) -> str:
    """A band in SQL."""
    steps = " ".join(f"when {value} < {c} then '{x}'" for c, x in zip(cuts, labels))
    return f"{steps} else '{labels[-1]}' end"


_RANK = "list_position([" + ", ".join(f"'{x}'" for x in BRAND_LEVELS) + "], {0})"
_DERIVED = (
    EXPOSURES
    + _FIRST
    + f""", t as (select request_id, purchase_price_avg_30d as base, active_days_30d as days, {_LIST.format('prefer_cat3_topk')} as cats,
      {_LIST.format('prefer_brand_topk')} as brands, {_LIST.format('seq_click_cat3_48h')} as recent from s),
    k as (select distinct user_id, item_cat3_name as cat3 from e where is_clk_c = 1 and user_id is not null and item_cat3_name is not null),
    kc as (select distinct k.user_id, i.cat1 from k join cat3_cat1_index i using (cat3) where i.cat1 is not null),
    pc as (select request_id, list(distinct cat1) as tops from (select request_id, unnest(cats) as cat3 from t) join cat3_cat1_index using (cat3) where cat1 is not null group by 1),
    rc as (select request_id, list(distinct cat1) as tops from (select request_id, unnest(recent) as cat3 from t) join cat3_cat1_index using (cat3) where cat1 is not null group by 1),
    bl as (select request_id, level, count(*) as n, min(place) as place from (select request_id, unnest(brands) as brand, generate_subscripts(brands, 1) as place from t)
      join brand_level_index using (brand) where level is not null group by 1, 2),
    ty as (select request_id, level from (select *, row_number() over (partition by request_id order by n desc, place, level) as rn from bl) where rn = 1),
    j as (select e.*, t.base, t.days, t.cats, t.brands, t.recent, k.cat3 is not null as touched, kc.cat1 is not null as touched_top,
        coalesce(list_contains(pc.tops, e.item_cat1_name), false) as cats_top, coalesce(list_contains(rc.tops, e.item_cat1_name), false) as recent_top,
        coalesce(ty.level, case when list_contains(t.brands, e.item_brand_name) and {_RANK.format('e.brand_level')} > 0 then e.brand_level end) as typical,
        case when t.base > 0 and not isnan(t.base) and not isnan(e.item_arriv_price) then (e.item_arriv_price - t.base) / t.base end as ratio
      from e left join t using (request_id) left join k on e.user_id = k.user_id and e.item_cat3_name = k.cat3
      left join kc on e.user_id = kc.user_id and e.item_cat1_name = kc.cat1 left join pc using (request_id) left join rc using (request_id) left join ty using (request_id)),
    f as (select exposure_id, round(ratio, 4) as price_ratio, case when ratio is null then '{NO_PRICE}' {_case('ratio', PRICE_CUTS, PRICE_LABELS)} as price_bucket,
      case when coalesce(list_contains(cats, item_cat3_name), false) then 'aligned' when coalesce(list_contains(recent, item_cat3_name), false) then 'recent_searched'
        when touched then 'recent_touched' when cats_top or touched_top then 'adjacent' else 'mismatch' end as cat3_alignment,
      case when coalesce(item_brand_name, '') = '' then 'unknown' when coalesce(list_contains(brands, item_brand_name), false) then 'aligned' else 'mismatch' end as brand_alignment,
      typical as typical_level, case when typical is null or coalesce({_RANK.format('brand_level')}, 0) = 0 then 'unknown' when {_RANK.format('brand_level')} < {_RANK.format('typical')} then 'upgrade'
        when {_RANK.format('brand_level')} > {_RANK.format('typical')} then 'downgrade' else 'same' end as level_vs_history,
      case when review_cnt is null or isnan(review_cnt) then 'cold' {_case('review_cnt', REVIEW_CUTS, REVIEW_LABELS)} as review_band,
      case when ctr_7d is null or isnan(ctr_7d) then 'low' {_case('least(ctr_7d, 1.0)', CTR_CUTS, CTR_LABELS)} as ctr_band,
      coalesce(is_new = 1, false) and (review_cnt is null or isnan(review_cnt) or review_cnt < 415) as cold_start,
      case when coalesce(len(recent), 0) = 0 then 'no_recent_search' when coalesce(list_contains(recent, item_cat3_name), false) then 'same' when recent_top then 'adjacent' else 'mismatch' end as search_distance,
      case when days is null or isnan(days) then '中' {_case('days', ACTIVITY_CUTS, ACTIVITY_LABELS)} as activity from j)"""
)


def _level_rank(c: Column) -> Column:
    """1 for the highest level, 0 for none of them."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, BRAND_LEVELS)), c), F.lit(0).cast("long"))


def with_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each exposure's derived features; see ``derived_features``."""
    e = cut(
        exposures(
            spark, sf_dir, "request_id", "user_id", "is_clk_c", "item_cat1_name", "item_cat3_name", "item_brand_name",
            "brand_level", "item_arriv_price", "review_cnt", "ctr_7d", "is_new",
        )
    )  # read for the clicked categories and for the features
    index = table(spark, sf_dir, "cat3_cat1_index").filter("cat1 is not null").select("cat3", "cat1")
    levels = table(spark, sf_dir, "brand_level_index").filter("level is not null").select("brand", "level")
    s = first_states(
        spark, sf_dir, "purchase_price_avg_30d", "active_days_30d", "prefer_cat3_topk", "prefer_brand_topk", "seq_click_cat3_48h"
    )
    t = cut(
        s.select(
            "request_id",
            F.col("purchase_price_avg_30d").alias("base"),
            F.col("active_days_30d").alias("days"),
            list_values(F.col("prefer_cat3_topk")).alias("cats"),
            list_values(F.col("prefer_brand_topk")).alias("brands"),
            list_values(F.col("seq_click_cat3_48h")).alias("recent"),
        )
    )
    tops = lambda c: (
        t.select("request_id", F.explode(c).alias("cat3")).join(index, "cat3").groupBy("request_id").agg(F.collect_set("cat1").alias(f"{c}_tops"))
    )
    met = t.select("request_id", F.posexplode("brands").alias("at", "brand")).join(levels, "brand")
    met = met.groupBy("request_id", "level").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    typical = met.groupBy("request_id").agg(F.min(F.struct(-F.col("n"), "at", "level")).alias("b"))
    t = t.join(tops("cats"), "request_id", "left").join(tops("recent"), "request_id", "left")
    t = t.join(typical.select("request_id", F.col("b.level").alias("history")), "request_id", "left")
    clicked = e.filter("is_clk_c = 1 and user_id is not null and item_cat3_name is not null")
    k = clicked.select("user_id", "item_cat3_name").distinct()
    kc = k.join(index, k.item_cat3_name == index.cat3).select("user_id", F.col("cat1").alias("item_cat1_name")).distinct()
    rows = (
        e.join(t, "request_id", "left")
        .join(k.withColumn("touched", F.lit(True)), ["user_id", "item_cat3_name"], "left")
        .join(kc.withColumn("touched_top", F.lit(True)), ["user_id", "item_cat1_name"], "left")
    )
    has = lambda xs, x: F.coalesce(F.array_contains(xs, F.col(x)), F.lit(False))
    in_brands, rank = has("brands", "item_brand_name"), _level_rank(F.col("brand_level"))
    base, price = F.col("base"), F.col("item_arriv_price")
    ratio = F.when(~F.isnan(base) & ~F.isnan(price), relative_to(price, base))
    rows = rows.select("*", ratio.alias("ratio"), F.coalesce("history", F.when(in_brands & (rank > 0), F.col("brand_level"))).alias("typical"))
    own = _level_rank(F.col("typical"))
    alignment = (
        F.when(has("cats", "item_cat3_name"), "aligned")
        .when(has("recent", "item_cat3_name"), "recent_searched")
        .when(F.col("touched"), "recent_touched")
        .when(has("cats_tops", "item_cat1_name") | F.coalesce("touched_top", F.lit(False)), "adjacent")
        .otherwise("mismatch")
    )
    distance = (
        F.when(F.coalesce(F.size("recent"), F.lit(0)) <= 0, "no_recent_search")
        .when(has("recent", "item_cat3_name"), "same")
        .when(has("recent_tops", "item_cat1_name"), "adjacent")
        .otherwise("mismatch")
    )
    review = banded(F.col("review_cnt"), REVIEW_CUTS, REVIEW_LABELS, "cold")
    return rows.select(
        "exposure_id",
        F.round("ratio", 4).alias("price_ratio"),
        banded(F.col("ratio"), PRICE_CUTS, PRICE_LABELS, NO_PRICE).alias("price_bucket"),
        alignment.alias("cat3_alignment"),
        F.when(F.coalesce("item_brand_name", F.lit("")) == "", "unknown").when(in_brands, "aligned").otherwise("mismatch").alias("brand_alignment"),
        F.col("typical").alias("typical_level"),
        F.when((own == 0) | (rank == 0), "unknown").when(rank < own, "upgrade").when(rank > own, "downgrade").otherwise("same").alias("level_vs_history"),
        review.alias("review_band"),
        banded(F.when(F.col("ctr_7d").isNotNull(), F.least("ctr_7d", F.lit(1.0))), CTR_CUTS, CTR_LABELS, "low").alias("ctr_band"),
        (to_flag(F.col("is_new")) & review.isin("cold", "low")).alias("cold_start"),
        distance.alias("search_distance"),
        banded(F.col("days"), ACTIVITY_CUTS, ACTIVITY_LABELS, "中").alias("activity"),
    )


@query(_DERIVED + " select * from f")
def derived_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NM1-NM6, NM8-NM13, AG27, TX5: the eleven features of an exposure against its request's first snapshot.

    Lists come from the snapshot; the categories a user clicked come from the log, as the tables hold no click list, and
    the recent clicks stand for the searches, which they lack too."""
    return with_features(spark, sf_dir)


_WINNERS = f""", p as (select trim(request_id, {_BLANKS}) as request, exposure_id, coalesce(case when not {VOID.format('item_id')} then trim(item_id, {_BLANKS}) end,
        case when not {VOID.format('spu_id')} then trim(spu_id, {_BLANKS}) end, 'row-' || exposure_id) as product,
        case when goods_seq is null or goods_seq = 0 then exposure_id else goods_seq end as pos from e where not {VOID.format('request_id')}),
    w as (select * from (select *, row_number() over (partition by request, product order by pos, exposure_id) as rn from p) where rn = 1)"""


def products_of_requests(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """(request, product, pos, exposure_id, columns...): each product of a request once, from its best position."""
    e = exposures(spark, sf_dir, "request_id", "item_id", "spu_id", "goods_seq", *columns)
    pos = F.coalesce(F.nullif(F.col("goods_seq").cast("long"), F.lit(0).cast("long")), F.col("exposure_id"))
    identity = F.coalesce(first_valid(F.col("item_id"), F.col("spu_id")), F.concat(F.lit("row-"), F.col("exposure_id").cast("string")))
    rows = e.filter(~is_void(F.col("request_id"))).select(
        strip(F.col("request_id")).alias("request"), identity.alias("product"), F.struct(pos.alias("pos"), "exposure_id").alias("o"), *columns
    )
    best = F.min_by(F.struct("o", *columns), F.col("o"))
    kept = rows.groupBy("request", "product").agg(best.alias("b"))
    return kept.select("request", "product", F.col("b.o.pos").alias("pos"), F.col("b.o.exposure_id").alias("exposure_id"), *[F.col(f"b.{c}").alias(c) for c in columns])


@query(
    _DERIVED
    + _WINNERS
    + " select w.request, w.product, w.pos, f.price_ratio, f.price_bucket, f.cat3_alignment, f.level_vs_history, f.activity from w join f using (exposure_id)"
)
def derived_for_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN2, PF6: the features of each product of a request, by the exposure that won its place."""
    won = products_of_requests(spark, sf_dir).select("request", "product", "pos", "exposure_id")
    names = ["price_bucket", "cat3_alignment", "level_vs_history", "activity"]
    return won.join(with_features(spark, sf_dir), "exposure_id").select(
        "request", "product", "pos", "price_ratio", *names
    )


_TEXT_ATTRIBUTES = ["item_name", "item_cat1_name", "item_cat3_name", "item_brand_name", "brand_level", "item_gender_tag"]
_NUMBER_ATTRIBUTES = [
    "item_arriv_price", "tag_price", "discount_rate", "ctr_7d", "item_satisfy", "review_cnt", "return_rate_30d", "is_new", "p_ctr", "p_cvr",
]


@query(
    EXPOSURES
    + ", a as (select exposure_id, unnest(["
    + ", ".join(
        f"{{'attribute': '{c}', 'value': "
        + (f"case when coalesce(brand_level, '') <> '' then coalesce(case when {_RANK.format('brand_level')} > 0 then brand_level end, '未知') end" if c == "brand_level" else f"nullif({c}, '')")
        + "}"
        for c in _TEXT_ATTRIBUTES
    )
    + ", "
    + ", ".join(
        f"{{'attribute': '{c}', 'value': cast(cast(case when not isnan(cast({c} as double)) then "
        + (f"least({c}, {CAPS[c]})" if c in CAPS else c)
        + " end as decimal(18,4)) as varchar)}"
        for c in _NUMBER_ATTRIBUTES
    )
    + "], recursive := true) from e) select exposure_id, attribute, value from a where value is not null"
)
def product_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF4, TX6, NM14: the attributes an exposure's product has, a row each: those of the allowed list that are present,
    unknown levels by their word, shares clipped at 1. NaN counts as absent. Narrow but for the removal of re-sent rows."""
    e = exposures(spark, sf_dir, *_TEXT_ATTRIBUTES, *_NUMBER_ATTRIBUTES)
    known = F.when(_level_rank(F.col("brand_level")) > 0, F.col("brand_level")).otherwise("未知")
    texts = {c: F.nullif(F.col(c), F.lit("")) for c in _TEXT_ATTRIBUTES}
    texts["brand_level"] = F.when(texts["brand_level"].isNotNull(), known)
    there = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    number = lambda c: F.when(there(c), F.least(c, F.lit(CAPS[c])) if c in CAPS else F.col(c))
    numbers = {c: number(c).cast("decimal(18,4)").cast("string") for c in _NUMBER_ATTRIBUTES}
    pairs = F.array(*[F.struct(F.lit(c).alias("attribute"), v.alias("value")) for c, v in {**texts, **numbers}.items()])
    return e.select("exposure_id", F.inline(pairs)).filter("value is not null")


def _by_frequency(xs: Column, k: int) -> Column:
    """``token(count), ...`` of the k most frequent members of a list, ties by place."""
    counted = F.transform(
        F.array_distinct(xs),
        lambda x: F.struct(-F.size(F.filter(xs, lambda y: y == x)).alias("n"), F.array_position(xs, x).alias("p"), x.alias("x")),
    )
    top = F.slice(F.array_sort(counted), 1, k)
    return F.array_join(F.transform(top, lambda t: F.concat(t.x, F.lit("("), (-t["col1"]).cast("string"), F.lit(")"))), ", ")


def _by_rank(xs: Column, k: int) -> Column:
    """``token(rank=i), ...`` of the first k distinct members of a list."""
    return F.array_join(
        F.transform(F.slice(F.array_distinct(xs), 1, k), lambda x, i: F.concat(x, F.lit("(rank="), (i + 1).cast("string"), F.lit(")"))), ", "
    )


_FREQUENCY = {"seq_click_cat3_48h": 5, "order_goods_id_list_topn": 5, "addcart_goods_id_list_topn": 5, "collect_goods_id_list_topn": 5}
_RANKED = {"prefer_cat3_topk": 10, "prefer_brand_topk": 10}
_ARRAYS = ("addcart_goods_id_list_topn", "collect_goods_id_list_topn")


def _sql_list(c: str) -> str:
    if c not in _ARRAYS:
        return _LIST.format(c)
    return f"list_filter(list_transform(coalesce({c}, []), lambda x: trim(x, {_BLANKS})), lambda x: x is not null and lower(x) not in ('', '0', '0.0', 'none', 'null', 'nan'))"


@query(
    "with s as (select distinct on (state_id) * from user_state), x as (select state_id, "
    + ", ".join(f"{_sql_list(c)} as {c}" for c in [*_FREQUENCY, *_RANKED])
    + " from s), d as (select state_id, "
    + ", ".join(f"{c}, list_filter({c}, lambda x, i: list_position({c}, x) = i) as u_{c}" for c in [*_FREQUENCY, *_RANKED])
    + " from x) select state_id, "
    + ", ".join(
        f"coalesce(array_to_string(list_transform(list_sort(list_transform(u_{c}, lambda x: {{'n': -len(list_filter({c}, lambda y: y = x)), 'p': list_position({c}, x), 't': x}}))[1:{k}], "
        f"lambda z: z.t || '(' || (-z.n) || ')'), ', '), '') as {c}"
        for c, k in _FREQUENCY.items()
    )
    + ", "
    + ", ".join(f"coalesce(array_to_string(list_transform(u_{c}[1:{k}], lambda x, i: x || '(rank=' || i || ')'), ', '), '') as {c}" for c, k in _RANKED.items())
    + " from d"
)
def compact_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG32, AG26, WN3, TX5: a snapshot's lists as text, by frequency or by rank. Each list is counted inside its row: no
    shuffle but for the removal of re-sent rows."""
    columns = [*_FREQUENCY, *_RANKED]
    s = table(spark, sf_dir, "user_state").select("state_id", *columns).distinct()
    none = F.array().cast("array<string>")
    lists = {c: F.coalesce(clean_tokens(F.col(c)) if c in _ARRAYS else list_values(F.col(c)), none) for c in columns}
    s = s.select("state_id", *[v.alias(c) for c, v in lists.items()])
    return s.select(
        "state_id",
        *[_by_frequency(F.col(c), k).alias(c) for c, k in _FREQUENCY.items()],
        *[_by_rank(F.col(c), k).alias(c) for c, k in _RANKED.items()],
    )


def _words(column: str, words: dict) -> str:
    return f"case {column} " + " ".join(f"when {repr(k)} then '{v}'" for k, v in words.items()) + " else '未知' end"


_VIP_SQL = "case when vip_level in (" + ", ".join(f"'{v}'" for v in VIPS) + ") then vip_level else '未知' end"


@query(
    f"""with s as (select distinct on (state_id) * from user_state), p as (select state_id, request_id, user_id, unnest([
        {{'grp': 'profile', 'field': 'age', 'value': cast(age as varchar)}}, {{'grp': 'profile', 'field': 'gender', 'value': case when gender is not null then {_words('gender', GENDERS)} end}},
        {{'grp': 'profile', 'field': 'city_level', 'value': case when city_level is not null then {_words('city_level', CITIES)} end}},
        {{'grp': 'profile', 'field': 'vip_level', 'value': case when coalesce(vip_level, '') <> '' then {_VIP_SQL} end}},
        {{'grp': 'profile', 'field': 'register_days', 'value': case when register_days is not null then cast(least(register_days, 18000) as varchar) end}},
        """
    + ", ".join(f"{{'grp': 'profile', 'field': '{c}', 'value': nullif(cast({c} as varchar), '')}}" for c in ("is_svip", "click_cnt_30d", "cart_cnt_30d", "order_cnt_30d", "order_cnt_90d", "coupon_use_cnt_30d"))
    + """, {'grp': 'profile', 'field': 'purchase_price_avg_30d', 'value': cast(cast(case when not isnan(purchase_price_avg_30d) then purchase_price_avg_30d end as decimal(18,4)) as varchar)},
        {'grp': 'profile', 'field': 'fav_price_avg_30d', 'value': cast(cast(case when not isnan(fav_price_avg_30d) then fav_price_avg_30d end as decimal(18,4)) as varchar)},
        {'grp': 'context', 'field': 'day_of_week', 'value': cast(day_of_week as varchar)}, {'grp': 'context', 'field': 'hour', 'value': cast(hour as varchar)},
        {'grp': 'context', 'field': 'device_type', 'value': case when coalesce(device_type, '') <> '' then """
    + _words("device_type", DEVICES)
    + """ end}], recursive := true) from s) select state_id, grp, field, value from p where value is not null"""
)
def user_state_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF3, PF32, TX6, NM14: the profile and context of a snapshot, a row per field that is present; codes as words, vip
    levels by an allow-list, days clipped."""
    names = ["is_svip", "click_cnt_30d", "cart_cnt_30d", "order_cnt_30d", "order_cnt_90d", "coupon_use_cnt_30d"]
    prices = ["purchase_price_avg_30d", "fav_price_avg_30d"]
    columns = ["age", "gender", "city_level", "vip_level", "register_days", *names, *prices, "day_of_week", "hour", "device_type"]
    s = table(spark, sf_dir, "user_state").select("state_id", *columns).distinct()
    text = lambda c: F.col(c).cast("string")
    coded = lambda c, words: F.when(F.nullif(text(c), F.lit("")).isNotNull(), F.coalesce(mapped(F.col(c), words), F.lit("未知")))
    vip = F.when(F.col("vip_level").isin(*VIPS), F.col("vip_level")).otherwise("未知")
    profile = {
        "age": text("age"),
        "gender": coded("gender", GENDERS),
        "city_level": coded("city_level", CITIES),
        "vip_level": F.when(F.coalesce("vip_level", F.lit("")) != "", vip),
        "register_days": F.when(F.col("register_days").isNotNull(), F.least("register_days", F.lit(18000))).cast("string"),
        **{c: F.nullif(text(c), F.lit("")) for c in names},
        **{c: F.when(~F.isnan(c), F.col(c)).cast("decimal(18,4)").cast("string") for c in prices},
    }
    context = {"day_of_week": text("day_of_week"), "hour": text("hour"), "device_type": coded("device_type", DEVICES)}
    cells = [("profile", k, v) for k, v in profile.items()] + [("context", k, v) for k, v in context.items()]
    entries = F.array(*[F.struct(F.lit(g).alias("grp"), F.lit(k).alias("field"), v.alias("value")) for g, k, v in cells])
    return s.select("state_id", F.inline(entries)).filter("value is not null")


_CATEGORY = "coalesce(i.cat1, '')"


@query(
    EXPOSURES
    + f""", p as (select trim(e.request_id, {_BLANKS}) as request, e.*, coalesce(case when not {VOID.format('item_id')} then trim(item_id, {_BLANKS}) end,
        case when not {VOID.format('spu_id')} then trim(spu_id, {_BLANKS}) end, 'row-' || exposure_id) as product,
        cast(case when goods_seq is null or goods_seq = 0 then exposure_id else goods_seq end as bigint) as pos, i.cat1 from e left join cat3_cat1_index i on e.item_cat3_name = i.cat3 where not {VOID.format('request_id')}),
    w as (select * from (select *, row_number() over (partition by request, product order by pos, exposure_id) as rn from p where cat1 is not null) where rn = 1),
    g as (select request, count(*) as n, to_json(list({{'product_id': product, 'category': cat1, 'group_key': item_cat3_name, 'observed': {{'is_clicked': coalesce(is_clk_c = 1, false),
        'is_addcart': coalesce(is_addcart_c = 1, false), 'is_order': coalesce(is_exp_order_c = 1, false), 'goods_seq': pos}}}} order by pos, exposure_id)) as products from w group by 1),
    c as (select request, item_cat3_name as cat3, count(*) as n, cat1 is null as skipped from p where coalesce(item_cat3_name, '') <> '' group by 1, 2, 4),
    h as (select request, coalesce(to_json(list({{'cat3': cat3, 'n': n}} order by cat3)), '[]') as source_counts, coalesce(to_json(list({{'cat3': cat3, 'n': n}} order by cat3) filter (skipped)), '[]') as skipped_counts from c group by 1),
    r as (select distinct request from p)
    select request, coalesce(n, 0) as n_products, coalesce(cast(products as varchar), '[]') as products, coalesce(cast(source_counts as varchar), '[]') as source_counts,
      coalesce(cast(skipped_counts as varchar), '[]') as skipped_counts from r left join g using (request) left join h using (request)"""
)
def scenario_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG29, AG2, PF4, PF13: a request as a nested document: its products in order with what was observed of them, and the
    counts of its categories, those without a class apart. Written as JSON text.

    A product comes from its best position; rows of no known category give none, but are counted. As long as the
    request's own rows, by definition."""
    doc = scenarios(spark, sf_dir)
    as_json = lambda c: F.coalesce(F.to_json(c, {"ignoreNullFields": "false"}), F.lit("[]")).alias(c)
    return doc.select("request", F.coalesce("n_products", F.lit(0)).alias("n_products"), *map(as_json, ("products", "source_counts", "skipped_counts")))


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request, n_products, products array<struct>, source_counts, skipped_counts array<struct<cat3, n>>)."""
    index = table(spark, sf_dir, "cat3_cat1_index")
    columns = ["item_id", "spu_id", "goods_seq", "item_cat3_name", "is_clk_c", "is_addcart_c", "is_exp_order_c"]
    e = exposures(spark, sf_dir, "request_id", *columns).filter(~is_void(F.col("request_id")))
    identity = F.coalesce(first_valid(F.col("item_id"), F.col("spu_id")), F.concat(F.lit("row-"), F.col("exposure_id").cast("string")))
    pos = F.coalesce(F.nullif(F.col("goods_seq").cast("long"), F.lit(0).cast("long")), F.col("exposure_id"))
    p = e.join(index, e.item_cat3_name == index.cat3, "left").select(
        strip(F.col("request_id")).alias("request"), identity.alias("product"), F.struct(pos.alias("pos"), "exposure_id").alias("o"), "cat1",
        F.col("item_cat3_name").alias("cat3"), *[to_flag(F.col(c)).alias(c) for c in ("is_clk_c", "is_addcart_c", "is_exp_order_c")],
    )
    p = cut(p)  # read for the products, the counts and the list of requests
    best = F.min_by(F.struct("o", "cat1", "cat3", "is_clk_c", "is_addcart_c", "is_exp_order_c"), F.col("o"))
    won = p.filter("cat1 is not null").groupBy("request", "product").agg(best.alias("b"))
    observed = F.struct(
        F.col("b.is_clk_c").alias("is_clicked"), F.col("b.is_addcart_c").alias("is_addcart"), F.col("b.is_exp_order_c").alias("is_order"),
        F.col("b.o.pos").alias("goods_seq"),
    )
    entry = F.struct(
        F.col("product").alias("product_id"), F.col("b.cat1").alias("category"), F.col("b.cat3").alias("group_key"), observed.alias("observed")
    )
    placed = F.array_sort(F.collect_list(F.struct(F.col("b.o").alias("o"), entry.alias("entry"))))
    products = won.groupBy("request").agg(F.count("*").alias("n_products"), F.transform(placed, lambda x: x.entry).alias("products"))
    counts = p.filter("cat3 <> ''").groupBy("request", "cat3", F.col("cat1").isNull().alias("skipped")).agg(F.count("*").alias("n"))
    listed = lambda c: F.array_sort(F.collect_list(c))
    pair = F.struct("cat3", "n")
    per = counts.groupBy("request").agg(listed(pair).alias("source_counts"), listed(F.when(F.col("skipped"), pair)).alias("skipped_counts"))
    return p.select("request").distinct().join(products, "request", "left").join(per, "request", "left")


@query(
    EXPOSURES
    + _FIRST
    + """, r as (select request_id, coalesce(string_agg(distinct item_cat3_name, ',' order by item_cat3_name), 'unknown') as category, count(distinct item_id) as n from e where request_id is not null group by 1),
    k as (select request_id, category, case when n <= 1 then '1' when n <= 3 then '2-3' when n <= 6 then '4-6' else '7+' end as band from r),
    d as (select request_id, (0"""
    + "".join(f" + coalesce((cast({c} as varchar) <> '')::int, 0)" for c in _LEAVES)
    + "".join(f" + coalesce(len(list_filter({c}, lambda x: x <> '')), 0)" for c in _LISTS)
    + """) as leaves from s)
    select request_id, unnest(['cat=' || category || '|count=' || band || '|user=' || case when coalesce(leaves, 0) <= 2 then 'sparse' when leaves <= 6 then 'medium' else 'rich' end,
      'cat=' || category || '|count=' || band, 'cat=' || category, 'count=' || band]) as key, generate_subscripts([1, 2, 3, 4], 1) as level from k left join d using (request_id)"""
)
def cohort_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX21, NM7: the four keys of a request from the narrowest cohort to the widest; the first holds how much is known of
    its user."""
    known = first_states(spark, sf_dir, *_LEAVES, *_LISTS).select("request_id", leaves().alias("leaves"))
    k = similarity_keys(spark, sf_dir).join(known, "request_id", "left")
    user = F.concat(F.lit("user="), density_band(F.col("leaves")))
    keys = F.array(F.concat_ws("|", "cat_key", "count_key", user), "wide_key", "cat_key", "count_key")
    return k.select("request_id", F.posexplode(keys).alias("at", "key")).select("request_id", "key", (F.col("at") + 1).cast("long").alias("level"))


#: The counts and lists of a snapshot that the first node gets; context and products are withheld.
_PROFILE_KEYS = ["age", "gender", "vip_level", "register_days", "click_cnt_30d", "cart_cnt_30d", "order_cnt_30d", "order_cnt_90d", "purchase_price_avg_30d"]
_BEHAVIOUR_KEYS = [
    "prefer_cat3_topK", "prefer_brand_topK", "seq_click_cat3_48h", "order_goods_id_list_topN", "order_brand_id_list_topN",
    "addcart_cat3_id_list_topN", "collect_goods_id_list_topN",
]
_PATHS = [("profile", k) for k in _PROFILE_KEYS] + [("behavior", k) for k in _BEHAVIOUR_KEYS]


@query(
    """with r as (select * from (select record_id, request_id, payload, row_number() over (partition by request_id order by attempt desc, captured_at desc, record_id desc) as rn
      from (select distinct record_id, request_id, node_id, attempt, captured_at, payload from artifact_log) where node_id = 'scenario' and json_valid(payload)) where rn = 1),
    u as (select record_id, request_id, json_extract_string(payload, '$.scenario_id') as scenario_id, json_extract_string(payload, '$.user_state') as us from r),
    v as (select record_id, request_id, scenario_id, case when json_valid(us) then us end as us from u),
    f as (select record_id, request_id, scenario_id, unnest(["""
    + ", ".join(f"{{'part': '{g}', 'key': '{k}', 'value': json_extract_string(us, '$.{g}.{k}')}}" for g, k in _PATHS)
    + "], recursive := true) from v) select record_id, request_id, scenario_id, part, key, value from f where coalesce(value, '') <> ''"
)
def user_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF7, PF32: what the first node gets of each request's last readable scenario: counts and lists of the snapshot, a
    row each; a snapshot may be an object or its text. Request context and products are withheld."""
    columns = ["record_id", "request_id", "node_id", "attempt", "captured_at", "payload"]
    a = table(spark, sf_dir, "artifact_log").select(*columns).distinct().filter("node_id = 'scenario'")
    a = a.filter(F.try_parse_json("payload").isNotNull())
    best = F.max_by(F.struct("record_id", "payload"), F.struct("attempt", "captured_at", "record_id"))
    last = a.groupBy("request_id").agg(best.alias("b")).select("request_id", "b.record_id", "b.payload")
    us = F.get_json_object("payload", "$.user_state")
    rows = last.select("record_id", "request_id", F.get_json_object("payload", "$.scenario_id").alias("scenario_id"), us.alias("us"))
    cells = F.array(
        *[F.struct(F.lit(g).alias("part"), F.lit(k).alias("key"), F.get_json_object("us", f"$.{g}.{k}").alias("value")) for g, k in _PATHS]
    )
    return rows.select("record_id", "request_id", "scenario_id", F.inline(cells)).filter("value <> ''")


@query(
    EXPOSURES
    + _WINNERS
    + f""", c as (select trim(request_id, {_BLANKS}) as request, source_user_factor_id as factor, count(*) as n from (select distinct on (candidate_id) * from candidates) where request_id is not null and not {VOID.format('source_user_factor_id')} group by 1, 2),
    pr as (select request, count(*) as n_products, string_agg(product, ',' order by pos, exposure_id) as products from w group by 1),
    f as (select request, count(*) as n_factors, string_agg(factor, ',' order by factor) as factors, cast(sum(n) as bigint) as n_candidates from c group by 1)
    select request, n_products, products, coalesce(n_factors, 0) as n_factors, coalesce(factors, '') as factors, coalesce(n_candidates, 0) as n_candidates from pr left join f using (request)"""
)
def copy_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF8, PF11: what the second node gets: a request's products in order and the factors found for it, by their ids
    alone. As long as the request's own rows, by definition."""
    w = products_of_requests(spark, sf_dir)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "exposure_id", "product"))), lambda x: x["product"]), ",")
    p = w.groupBy("request").agg(F.count("*").alias("n_products"), listed.alias("products"))
    c = table(spark, sf_dir, "candidates").select("candidate_id", "request_id", "source_user_factor_id").distinct()
    c = c.filter(F.col("request_id").isNotNull() & ~is_void(F.col("source_user_factor_id")))
    per = c.groupBy(strip(F.col("request_id")).alias("request"), F.col("source_user_factor_id").alias("factor")).agg(F.count("*").alias("n"))
    f = per.groupBy("request").agg(
        F.count("*").alias("n_factors"), F.array_join(F.array_sort(F.collect_list("factor")), ",").alias("factors"), F.sum("n").alias("n_candidates")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return p.join(f, "request", "left").select(
        "request", "n_products", "products", zero("n_factors"), F.coalesce("factors", F.lit("")).alias("factors"), zero("n_candidates")
    )
