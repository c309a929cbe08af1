"""Queries of the problems tagged llm, over whole tables with production parameters."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftwork.functions.predicates import clean_tokens, is_void
from graftwork.llm.bpe import PATTERN, encode_corpus, read_ranks
from graftwork.llm.cooccur import lifted_pairs
from graftwork.llm.mojibake import repair
from graftwork.llm.neardup import duplicate_pairs, near_duplicates
from graftwork.llm.packing import pack, token_counts
from graftwork.llm.topn import top_n
from graftwork.operators.packed import packed_values
from graftwork.session import table


#: Where the vocabulary files of public tokenizers lie.
TOKENIZERS = os.environ.get("GRAFTWORK_TOKENIZERS", "/opt/tokenizers")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records of one table whose texts are at least 0.6 alike in runs of 3 characters."""
    candidates = table(spark, sf_dir, "candidates").select(
        F.lit("candidates").alias("src"), F.col("candidate_id").alias("id"), "text"
    )
    copies = table(spark, sf_dir, "offline_copy").select(
        F.lit("offline_copy").alias("src"), F.col("copy_id").cast("string").alias("id"), F.col("copy").alias("text")
    )
    links, members = near_duplicates(candidates.unionByName(copies), "src", "id", "text", threshold=0.6, width=3)
    pairs = duplicate_pairs(links, members)
    number = lambda c: F.col(c).try_cast("long")
    by_number = F.col("grp") == "offline_copy"
    swap = F.when(by_number, number("id_a") > number("id_b")).otherwise(F.col("id_a") > F.col("id_b"))
    return pairs.select(
        F.col("grp").alias("src"),
        F.when(swap, F.col("id_b")).otherwise(F.col("id_a")).alias("id_a"),
        F.when(swap, F.col("id_a")).otherwise(F.col("id_b")).alias("id_b"),
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best judged candidates of each product and the five most promising exposures of each item."""
    candidates = table(spark, sf_dir, "candidates").select("candidate_id", "product_id").dropDuplicates(["candidate_id"])
    latest = (
        table(spark, sf_dir, "judgments")
        .select("candidate_id", "total_score", "judged_at", "judgment_id")
        .groupBy("candidate_id")
        .agg(F.max_by("total_score", F.struct("judged_at", "judgment_id")).alias("total_score"))
    )
    judged = candidates.join(latest, "candidate_id")
    exposures = (
        table(spark, sf_dir, "exposure_log")
        .select("exposure_id", "item_id", "p_ctr")
        .filter(~is_void(F.col("item_id")) & F.col("p_ctr").isNotNull() & ~F.isnan("p_ctr"))
        .dropDuplicates(["exposure_id"])
    )
    shape = lambda df, kind, group, member: df.select(
        F.lit(kind).alias("grouping_kind"),
        F.col(group).alias("group_id"),
        F.col("rank_no").cast("int").alias("rank_no"),
        F.col(member).cast("string").alias("member_id"),
    )
    products = top_n(judged, ["product_id"], "total_score", ["candidate_id"], 5)
    items = top_n(exposures, ["item_id"], "p_ctr", ["exposure_id"], 5)
    return shape(products, "product", "product_id", "candidate_id").unionByName(
        shape(items, "item", "item_id", "exposure_id")
    )


def goods_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(state_id, goods): the ordered, carted and collected goods of each snapshot."""
    lists = ["order_goods_id_list_topn", "addcart_goods_id_list_topn", "collect_goods_id_list_topn"]
    states = table(spark, sf_dir, "user_state").select("state_id", *lists).dropDuplicates(["state_id"])
    none = F.array().cast("array<string>")
    goods = F.concat(
        F.coalesce(packed_values(F.col(lists[0])), none), *[F.coalesce(clean_tokens(F.col(c)), none) for c in lists[1:]]
    )
    return states.select("state_id", goods.alias("goods"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of goods that occur together at least 5 times and at least 5 times as often as by chance."""
    pairs = lifted_pairs(goods_baskets(spark, sf_dir), "state_id", "goods", min_count=5, min_lift=5)
    return pairs.select(F.col("item_a").alias("goods_a"), F.col("item_b").alias("goods_b"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document by byte_bpe_50k."""
    ranks = read_ranks(f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
    return encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text", ranks).withColumnRenamed("id", "doc_id")


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, sized in tokens, in containers of each capacity of pack_limits."""
    limits = table(spark, sf_dir, "pack_limits").collect()  # a fixed table of three rows
    documents, parts = table(spark, sf_dir, "documents"), []
    for name in sorted({r.tokenizer for r in limits}):
        ranks = read_ranks(f"{TOKENIZERS}/{name}.tiktoken")
        sizes = token_counts(documents, "doc_id", "text", ranks, PATTERN)
        parts.append(pack(sizes, "id", "n_tokens", {r.limit_id: r.capacity for r in limits if r.tokenizer == name}))
    packed = reduce(DataFrame.unionByName, parts)
    return packed.select(
        "limit_id",
        "container",
        F.col("id").alias("doc_id"),
        "piece_no",
        F.col("first").alias("first_token"),
        F.col("n").alias("n_tokens"),
    )


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with passages read in a wrong encoding, and the MD5 of the restored text ('' if it is lost)."""
    found = repair(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", F.coalesce(F.md5(F.encode("restored", "utf-8")), F.lit("")).alias("restored_md5"))


QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p5_found": p5_found, "p6_ids": p6_ids, "p7_packed": p7_packed, "p8_found": p8_found}
_VOID = "lower(trim({0}, ' \t\n\r\u3000')) in ('', '0', '0.0', 'none', 'null', 'nan')"
ORACLES: dict[str, str] = {
    "p2_found": r"""
with t as (
  select distinct 'candidates' as src, candidate_id as id, 0 as num, text from candidates
  union all select distinct 'offline_copy', cast(copy_id as varchar), copy_id, copy from offline_copy),
z as (select src, id, num, regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') as z from t),
i as (select src, id, num, z, unnest(range(1, length(z) - 1)) as i from z where length(z) >= 3),
g as (select distinct src, id, num, substring(z, i, 3) as g from i),
n as (select src, id, count(*) as n from g group by 1, 2),
p as (select a.src, a.id as a, b.id as b, count(*) as c from g a join g b on a.src = b.src and a.g = b.g
      and case when a.src = 'candidates' then a.id < b.id else a.num < b.num end group by 1, 2, 3)
select p.src, p.a as id_a, p.b as id_b from p join n x on p.src = x.src and p.a = x.id join n y on p.src = y.src and p.b = y.id
where p.c >= 0.6 * (x.n + y.n - p.c)""",
    "p3_found": f"""
with k as (select distinct candidate_id, product_id from candidates),
l as (select candidate_id, arg_max(total_score, (judged_at, judgment_id)) as s from judgments group by 1),
a as (select 'product' as grouping_kind, product_id as group_id, candidate_id as member_id,
  row_number() over (partition by product_id order by s desc, candidate_id) as r from k join l using (candidate_id) where product_id is not null),
e as (select distinct exposure_id, item_id, p_ctr from exposure_log
  where p_ctr is not null and not isnan(p_ctr) and item_id is not null and not {_VOID.format("item_id")}),
b as (select 'item', item_id, cast(exposure_id as varchar),
  row_number() over (partition by item_id order by p_ctr desc, exposure_id) as r from e)
select grouping_kind, group_id, cast(r as integer) as rank_no, member_id from (from a union all from b) where r <= 5""",
    "p5_found": f"""
with s as (select distinct on (state_id) state_id, order_goods_id_list_topn as o, addcart_goods_id_list_topn as c, collect_goods_id_list_topn as d from user_state),
g as (select state_id, unnest(list_concat(coalesce(regexp_extract_all(o, '-?[0-9]+'), []), coalesce(c, []), coalesce(d, []))) as x from s),
b as (select distinct state_id, trim(x, ' \t\n\r\u3000') as x from g where x is not null and not {_VOID.format("x")}),
n as (select x, count(*) as n from b group by 1), t as (select count(distinct state_id) as t from b),
p as (select l.x as a, r.x as b, count(*) as c from b l join b r on l.state_id = r.state_id and l.x < r.x group by 1, 2 having count(*) >= 5)
select p.a as goods_a, p.b as goods_b from p join n x on p.a = x.x join n y on p.b = y.x, t where p.c * t.t >= 5 * x.n * y.n""",
}
