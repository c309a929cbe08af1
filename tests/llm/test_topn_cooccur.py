import math
import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from graftwork.llm.cooccur import lifted_pairs
from graftwork.llm.topn import score_bin, top_n


def test_bins_never_fall(spark):
    rng = random.Random(4)
    values = [s * m * 2.0**e for s in (1, -1) for m in (1.0, 1 - 2**-53, 1 + 2**-52, 1.5) for e in range(-1070, 1022, 7)]
    values += [0.0, math.inf, -math.inf, 5e-324, 1.7976931348623157e308, 0.1, 1e300] + [rng.random() for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in sorted(values)], "v double").coalesce(1)
    for steps in (1, 7, 64):
        got = [r.b for r in df.select("v", score_bin(F.col("v"), steps).alias("b")).orderBy("v").collect()]
        assert got == sorted(got)


def test_one_extreme_score_does_not_widen_the_bins(spark):
    df = spark.createDataFrame([("g", 1 + k / 1000, k) for k in range(1000)] + [("g", 1e300, -1)], "g string, s double, i long")
    assert df.select(F.count_distinct(score_bin(F.col("s"), 64)).alias("n")).first().n >= 60


@pytest.mark.parametrize("steps", [1, 7, 64])
def test_top_n_equals_brute_force(spark, steps):
    rng = random.Random(steps)
    rows = [(rng.choice(["hot", "hot", "a", "b", None]), rng.choice([None, math.nan, 1.0, 2.0, rng.random()]), i) for i in range(3_000)]
    rows.append(("only", 5.0, 1))
    df = spark.createDataFrame(rows, "g string, s double, i long")
    got = {(r.g, r.rank_no): (r.s, r.i) for r in top_n(df, ["g"], "s", ["i"], 5, steps=steps).collect()}
    want = {}
    for g in ("hot", "a", "b", "only"):
        own = sorted((-s, i) for x, s, i in rows if x == g and s is not None and not math.isnan(s))
        want |= {(g, k + 1): (-s, i) for k, (s, i) in enumerate(own[:5])}
    assert got == want


def test_top_n_of_equal_scores_and_empty_tables(spark):
    df = spark.createDataFrame([("g", 3, i, "x") for i in range(5_000)], "g string, s int, i long, rank_total string")
    assert sorted(r.i for r in top_n(df, ["g"], "s", ["i"], 3).collect()) == [0, 1, 2]
    assert top_n(df.limit(0), ["g"], "s", ["i"], 3).count() == 0
    wide = spark.createDataFrame([("g", -math.inf, 1), ("g", 1.0, 2), ("g", math.inf, 3)], "g string, s double, i long")
    assert [r.i for r in top_n(wide, ["g"], "s", ["i"], 2).orderBy("rank_no").collect()] == [3, 2]


def baskets(seed):
    rng = random.Random(seed)
    items = [f"i{k:02}" for k in range(60)]
    out = [[x for x in rng.sample(items, rng.randrange(0, 8))] + ["hot"] * rng.randrange(2) for _ in range(600)]
    return out + [["p", "q", "i00", "p"]] * 12 + [None, [], [None]]


@pytest.mark.parametrize("heavy", [0, 3, 20, 256])
def test_pairs_equal_brute_force(spark, heavy):
    rows = baskets(heavy)
    df = spark.createDataFrame([(k, b, "c") for k, b in enumerate(rows)], "k long, xs array<string>, lift string")
    sets = [{x for x in b if x} for b in rows if b and any(b)]
    n, pairs = Counter(), Counter()
    for s in sets:
        n.update(s)
        pairs.update(combinations(sorted(s), 2))
    for lift in (None, 2):
        got = {(r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.baskets) for r in lifted_pairs(df, "k", "xs", 5, lift, heavy).collect()}
        keep = lambda a, b, c: c >= 5 and (lift is None or c * len(sets) >= lift * n[a] * n[b])  # noqa: B023, E731
        assert got == {(a, b): (c, n[a], n[b], len(sets)) for (a, b), c in pairs.items() if keep(a, b, c)}


def test_no_baskets(spark):
    df = spark.createDataFrame([], "k long, xs array<string>")
    assert lifted_pairs(df, "k", "xs").count() == 0
