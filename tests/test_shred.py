import json

from graftwork.operators.shred import children_of_artifacts, shred

SCHEMA = "record_id long, request_id string, payload string"


def children(spark, payloads):
    df = spark.createDataFrame([(i, "R", p) for i, p in enumerate(payloads)], SCHEMA)
    return {tuple(r) for r in children_of_artifacts(df, "record_id", "request_id", "payload").collect()}


def test_one_content_in_several_shapes(spark):
    factors = [{"user_factor_id": "U1", "expression_hooks": ["a", None, "b"]}, {"user_factor_id": "U2", "expression_hooks": "c"}]
    shapes = [
        {"user_factors": factors},
        {"artifact": {"user_factors": json.dumps(factors)}},
        {"final_artifact": {"artifact": {"user_factors": [[factors[0]], None, [factors[1]]]}}},
    ]
    want = [
        ("user_factor", "R", "U1", 1), ("user_factor", "R", "U2", 2),
        ("expression_hook", "U1", "a", 1), ("expression_hook", "U1", "b", 2), ("expression_hook", "U2", "c", 1),
    ]
    got = children(spark, [json.dumps(s) for s in shapes])
    assert got == {(i, *w) for i in range(3) for w in want}


def test_grouped_candidates_and_judgments(spark):
    grouped = {"candidates": [{"source_user_factor_id": "U1", "candidates": [{"candidate_id": "C1"}, {"candidate_id": "C2", "text": "[1]"}]}]}
    judged = {"judgments": {"candidate_id": "C1", "objective_checks": [[{"check_id": "k1"}], [{"check_id": "k2"}]], "axis_scores": None}}
    assert children(spark, [json.dumps(grouped), json.dumps(judged)]) == {
        (0, "candidate", "U1", "C1", 1), (0, "candidate", "U1", "C2", 2), (1, "judgment", "R", "C1", 1),
        (1, "objective_check", "C1", "k1", 1), (1, "objective_check", "C1", "k2", 2),
    }


def test_user_state_fields(spark):
    state = {"user_id": "7", "profile": {"age": 0, "vip": "", "x": None}, "behavior": '{"seen": [], "liked": [null], "n": {}}', "context": {"hour": False}}
    got = children(spark, [json.dumps({"metadata": {"user_state": state, "products": {"product_id": 5}}})])
    assert got == {
        (0, "user_state", "R", c, 0) for c in ("user_id", "profile.age", "behavior.n", "context.hour")
    } | {(0, "product", "R", "5", 1)} | ({(0, "user_state", "R", "behavior.liked", 0)} & got)


def test_unreadable_and_empty(spark):
    bad = [None, "", "  ", "{", '{"user_factors": [{"user_factor_id": "U"', "NaN", "[" * 100_000, "7", "{}", "[]"]
    assert children(spark, bad) == set()
    assert children(spark, []) == set()


def test_repeated_records_count_once(spark):
    row = (1, "R", json.dumps({"products": [{"product_id": "p"}]}), "x")
    df = spark.createDataFrame([row, row], SCHEMA + ", entity string")
    assert children_of_artifacts(df, "record_id", "request_id", "payload").count() == 1


def test_adjacency(spark):
    doc = {"a": [{"b": 1}, [{"b": "two"}], None], "c": "t"}
    df = spark.createDataFrame([(1, json.dumps(doc))], "rec long, doc string")
    rows = {(r.node, r.parent, r.label, r.ordinal, r.is_object, r.scalar) for r in shred(df, "rec", "doc").collect()}
    objects = {r[0]: r for r in rows if r[4]}
    assert {r[2:4] for r in objects.values()} == {("", 0), ("a", 1), ("a", 2)}
    assert {(objects[r[1]][3], r[2], r[5]) for r in rows if not r[4]} == {(1, "b", "1"), (2, "b", "two"), (0, "c", "t")}
