import math

import pytest
from pyspark.sql import functions as F

from graftwork.functions import numeric, predicates, text


def one(spark, values, kind, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_null_rules_differ(spark):
    cases = [None, "", " ", "　0 ", "0.0", "None", "nan", "a", "-1", "2"]
    assert one(spark, cases, "string", predicates.is_void) == [True] * 7 + [False] * 3
    assert one(spark, cases, "string", predicates.present) == [False, False] + [True] * 8
    assert one(spark, cases, "string", predicates.meaningful) == [False] * 7 + [True, False, True]
    assert one(spark, cases, "string", predicates.filled_leaf) == [0, 0] + [1] * 8


def test_tolerant_casts(spark):
    assert one(spark, [" 1.5 ", "x", "NaN", None, "1e3"], "string", numeric.to_float) == [1.5, None, None, None, 1000.0]
    assert one(spark, ["1", "1.0", "2", None, "yes"], "string", numeric.to_flag) == [True, True, False, False, False]


def test_bands(spark):
    band = lambda c: numeric.banded(c, [1.0, 2.0], ["low", "mid", "high"], "none")
    assert one(spark, [0.5, 1.0, 2.0, None, math.nan], "double", band) == ["low", "mid", "high", "none", "none"]
    with pytest.raises(ValueError):
        numeric.banded(F.col("v"), [1.0], ["a"], "b")


def test_beta_tail(spark):
    pairs = [(3, 5), (3, 4), (1, 1), (538, 538), (1050, 25), (1051, 25), (25, 1051), (1000, 1000)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a long, b long")
    got = [r.p for r in df.select("i", numeric.beta_above(F.col("a"), F.col("b")).alias("p")).orderBy("i").collect()]

    def exact(a, b):
        n = a + b - 1
        return sum(math.comb(n, j) for j in range(a)) / 2**n

    for (a, b), p in zip(pairs, got):
        assert p == pytest.approx(exact(a, b), abs=1e-9)
    assert round(got[0], 4) == 0.2266 and round(got[1], 4) == 0.3438


def test_wilson_and_mean(spark):
    df = spark.createDataFrame([(8, 10), (0, 0)], "s long, n long")
    got = [r.x for r in df.select(numeric.wilson_low(F.col("s"), F.col("n")).alias("x")).collect()]
    assert got[0] == pytest.approx(0.4902, abs=1e-4) and got[1] == 0
    assert one(spark, [0, 1], "long", lambda c: numeric.belief_mean(c, c)) == [0.5, 0.5]


def test_text(spark):
    assert one(spark, ["【会员】 ２０２５香水　3ml!", None, "ab"], "string", text.canonical_name) == ["香水ml", None, "ab"]
    assert one(spark, ["../a\\b:c", "", None, "..."], "string", text.safe_name) == ["_a_b_c", "node", "node", "node"]
    assert one(spark, ["call 12345 a@b.cn", None], "string", text.redacted) == ["call <n> <mail>", None]
    assert one(spark, ["token: abcd_1234efgh x"], "string", lambda c: text.redacted(c, 5)) == ["<key>"]
    assert one(spark, ["a b", "", None], "string", lambda c: text.overlap(c, F.lit("B　C"))) == [1 / 3, 0.0, 0.0]
    assert one(spark, [59, 3600, 3599], "long", text.elapsed) == ["00:59", "01:00:00", "59:59"]
    assert one(spark, ["A Todo", "x", None], "string", lambda c: text.has_any(c, ["todo"])) == [True, False, False]


def test_plain_lists_and_categories(spark):
    got = one(spark, ["a(3), b ,,nan, c(x)(y)", "", None, "　d　"], "string", predicates.list_values)
    assert got == [["a", "b", "c"], [], None, ["d"]]
    of = lambda c: text.canonical_category(c, ["香水瓶"], {"淡香水": "香水"}, {"枕套": "(家用|车用)枕套"}, "护肩")
    names = ["香水瓶", " 淡 香水", "车用枕套", "车用枕套盒", "护肩/护肘", "护肩套", None]
    assert one(spark, names, "string", of) == [None, "香水", "枕套", None, "护肩", None, None]


def test_beta_tail_of_large_and_missing_counts(spark):
    pairs = [(10**9, 10**9), (10**9, 1), (1, 10**9), (None, 3), (0.5, 0.5), (2000, 1)]
    df = spark.createDataFrame([(i, *map(lambda v: v if v is None else float(v), p)) for i, p in enumerate(pairs)], "i int, a double, b double")
    got = [r.p for r in df.select("i", numeric.beta_above(F.col("a"), F.col("b")).alias("p")).orderBy("i").collect()]
    assert got[0] == pytest.approx(0.5) and got[1] == 1 and got[2] == 0 and got[3] is None and got[4] == pytest.approx(0.5) and got[5] == pytest.approx(1)
