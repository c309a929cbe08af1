import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from graftwork.operators.packed import unpack


def values(spark, cells):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "k long, c string")
    got = {i: [] for i in range(len(cells))}
    for r in unpack(df, ["k"], ["c"]).collect():
        got[r.k].append((r.pos, r.value))
    for v in got.values():
        assert [p for p, _ in sorted(v)] == list(range(1, len(v) + 1))
    return [[x for _, x in sorted(v)] for v in got.values()]


def test_shapes(spark):
    cases = {
        'a,b;c|d、e，f；g\th': list("abcdefgh"),
        ' "茶具、酒具"|　运动雨靴 |　家用凉席 ': ["茶具、酒具", "运动雨靴", "家用凉席"],
        '"Triu ""Lab""",O\'Lansi|"a,b;c 实验"': ['Triu "Lab"', "O'Lansi", "a,b;c 实验"],
        "'餐垫, 杯垫','O'Lansi','x'": ["餐垫, 杯垫", "O'Lansi", "x"],
        "「茶具、酒具」,「香水」": ["茶具、酒具", "香水"],
        '["\\u6c90\\u6849", "a\\"b, c", "x\\\\y"]': ["沐桉", 'a"b, c', "x\\y"],
        "[5497519711060190608, -12]": ["5497519711060190608", "-12"],
        '"鞋垫“抗菌”款";护肩/护肘套组,收纳-大件, 家纺 (四件套) ,T恤&卫衣,灯具+灯泡,ZEN.dop': [
            "鞋垫“抗菌”款", "护肩/护肘套组", "收纳-大件", "家纺 (四件套)", "T恤&卫衣", "灯具+灯泡", "ZEN.dop",
        ],
        "a,,NULL, 0.0 ,nan,0,None,b,a": ["a", "b", "a"],
        '"None","x"': ["x"],
        '"open, never': ['"open', "never"],
        "[a],[b]": ["[a]", "[b]"],
        "x\x01y,\"p\x010\x01,q\",\x01": ["x\x01y", "p\x010\x01,q", "\x01"],
        "": [], " 　": [], ",;|": [], "[]": [], "null": [],
    }
    assert values(spark, list(cases)) == list(cases.values())


def test_null_and_long_cells_and_clashing_columns(spark):
    long = ",".join(f"v{i}" for i in range(20_000))
    rows = [(1, None, 7, "p"), (1, long, 7, "p"), (None, "a,b", None, None)]
    df = spark.createDataFrame(rows, "k long, c string, pos int, field string")
    got = unpack(df, ["k"], ["c"])
    assert got.columns == ["k", "field", "pos", "value"]
    assert got.filter("k = 1").count() == 20_000 and got.filter("k is null").count() == 2
    assert unpack(df.limit(0), ["k"], ["c"]).count() == 0


TOKEN = st.text(st.characters(codec="utf-8", exclude_categories=["Cc", "Cs", "Zs", "Zl", "Zp"]), min_size=1, max_size=8)
VOID = {"0", "0.0", "none", "null", "nan"}


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(TOKEN.filter(lambda t: t.lower() not in VOID), min_size=1, max_size=6))
def test_round_trips(spark, tokens):
    quoted = ";".join('"' + t.replace("\\", "\\\\").replace('"', '""') + '"' for t in tokens)
    assert values(spark, [quoted, json.dumps(tokens), json.dumps(tokens, ensure_ascii=False)]) == [tokens] * 3
