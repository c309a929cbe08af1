import json
import math

import pytest
from pyspark.sql import functions as F

from graftwork.functions import numeric
from graftwork.functions.documents import EditError, apply_edits, edited, parse_sections, render_sections, rendered, sections_of

DOC = {"title": "t", "sections": [{"heading": "A", "body": "1"}, {"heading": "B/x~", "body": "2"}, {"heading": "C", "body": "3"}]}


def test_sections():
    got = sections_of("intro\r\n# One \nbody\n\n####### no\n## Two\n")
    assert got == {
        "front": [],
        "preamble": "intro\n",
        "sections": [
            {"level": 1, "heading": "One", "body": "body\n\n####### no\n"},
            {"level": 2, "heading": "Two", "body": ""},
        ],
    }


@pytest.mark.parametrize(
    "edit, path, want",
    [
        ({"op": "replace", "path": "/sections/by_heading/A/body", "value": "new"}, ("sections", 0, "body"), "new"),
        ({"op": "replace", "path": "/sections/by_heading/B~1x~0/body", "value": 5}, ("sections", 1, "body"), 5),
        ({"op": "add", "path": "/sections/1", "value": {}}, ("sections", 2, "heading"), "B/x~"),
        ({"op": "add", "path": "/sections/-", "value": 1}, ("sections", 3), 1),
        ({"op": "add", "path": "/more", "value": [1]}, ("more", 0), 1),
        ({"op": "remove", "path": "/sections/0"}, ("sections", 0, "heading"), "B/x~"),
        ({"op": "add", "path": "/by_heading", "value": 1}, ("by_heading",), 1),
    ],
)
def test_edits(edit, path, want):
    out = edited(DOC, [edit])
    for p in path:
        out = out[p]
    assert out == want and DOC["sections"][0] == {"heading": "A", "body": "1"}


@pytest.mark.parametrize(
    "edit",
    [
        {"op": "add", "path": "/title", "value": 1}, {"op": "replace", "path": "/none", "value": 1},
        {"op": "remove", "path": "/sections/9"}, {"op": "replace", "path": "/sections/by_heading/Z", "value": 1},
        {"op": "move", "path": "/title"}, {"op": "replace", "path": "title", "value": 1},
        {"op": "replace", "path": "/title/x", "value": 1}, {"op": "replace", "path": "/none/x", "value": 1}, {"op": "remove", "path": ""},
        {"op": "replace", "path": "", "value": {}}, {"op": "replace", "path": "/by_heading/title", "value": 1},
    ],
)
def test_edits_that_do_not_fit(edit):
    with pytest.raises((EditError, TypeError)):
        edited(DOC, [edit])


def test_ambiguous_heading():
    with pytest.raises(EditError):
        edited({"sections": [{"heading": "A"}, {"heading": "A"}]}, [{"op": "remove", "path": "/sections/by_heading/A"}])


def test_columns(spark):
    rows = [(1, json.dumps(DOC), '[{"op": "replace", "path": "/title", "value": "你"}]'), (2, "{}", '[{"op": "remove", "path": "/x"}]'), (3, None, "[]"), (4, "no", "[]")]
    df = spark.createDataFrame(rows, "i int, d string, e string")
    got = {r.i: r.r for r in df.select("i", apply_edits(F.col("d"), F.col("e")).alias("r")).collect()}
    assert json.loads(got[1].result)["title"] == "你" and got[1].error is None
    assert got[2].result is None and got[2].error and got[3] is None and got[4].error
    parsed = df.select("i", parse_sections(F.concat(F.lit("# H\n"), "d")).alias("p")).orderBy("i").collect()
    assert parsed[1].p.sections[0].heading == "H" and parsed[2].p is None


def test_rounding_and_tails(spark):
    values = [2.675, 0.5, 1.5, 2.5, -1.005, None, 1e16, 0.285]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r.x for r in df.select("i", numeric.rounded(F.col("v"), 2).alias("x")).orderBy("i").collect()]
    assert got == [v if v is None else round(v, 2) for v in values]
    b = spark.createDataFrame([(1, 3000.5, 2900.5), (2, 10.0, 10.0)], "i int, a double, b double")
    tails = [r.x for r in b.select("i", numeric.beta_above_normal(F.col("a"), F.col("b")).alias("x")).orderBy("i").collect()]
    z = (0.5 - 3000.5 / 5901) / math.sqrt(3000.5 * 2900.5 / (5901**2 * 5902))
    assert tails == [pytest.approx(0.5 * math.erfc(z / math.sqrt(2))), pytest.approx(0.5)]


def test_rendering_is_the_inverse_of_reading(spark):
    texts = ["---\na: 1\nb:  x: y \nno field\n---\nlead\n# A\nbody\n\n##  B  \n", "no heading", "# H", "\r\n# H\r\nx", "", "---\nopen", "#no\n ## no"]
    want = ["---\na: 1\nb: x: y\n---\nlead\n# A\nbody\n\n## B\n", "no heading", "# H\n", "\n# H\nx", "", "---\nopen", "#no\n ## no"]
    assert [rendered(sections_of(t)) for t in texts] == want
    assert [rendered(sections_of(t)) for t in want] == want
    df = spark.createDataFrame(list(enumerate([*texts, None])), "i int, t string")
    got = df.select("i", render_sections(parse_sections(F.col("t"))).alias("r")).orderBy("i").collect()
    assert [r.r for r in got] == [*want, None]
