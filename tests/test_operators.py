import os
import random

import pytest
from pyspark.sql import functions as F

from graftwork.operators import beliefs, cohorts, integrity, ordering
from graftwork.sources import delimited, files
from graftwork.streaming import journal


def test_one_per_key_and_once(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 5, None), (2, 5, None)], "k int, t int, v string")
    assert {tuple(r) for r in ordering.one_per_key(df, ["k"], [F.asc("t")]).collect()} == {(1, 1, "a"), (2, 5, None)}
    assert {tuple(r) for r in ordering.once(df, "k", "t").collect()} == {(1, 2, "b"), (2, 5, None)}
    assert ordering.once(df.limit(0), "k", "t").count() == 0


def test_summaries_break_ties_by_first_sighting(spark):
    rows = [("u", i, t) for i, t in enumerate(["b", "a", "b", "a", None, "c"])]
    df = spark.createDataFrame(rows, "u string, i long, t string")
    assert ordering.frequency_text(df, ["u"], "t", "i", 2).first().summary == "b(2), a(2)"
    assert ordering.rank_text(df, ["u"], "t", "i", 9).first().summary == "b(rank=1), a(rank=2), c(rank=3)"


def test_numbered_is_a_total_order(spark):
    values = random.Random(1).sample(range(10_000), 3_000)
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(7)
    rows = sorted((r.v, r.row_no) for r in ordering.numbered(df, ["v"]).collect())
    assert [n for _, n in rows] == list(range(1, 3_001))
    assert ordering.numbered(df.limit(0), ["v"]).count() == 0


def test_round_robin(spark):
    rows = [(i, "a" if i < 5 else None) for i in range(7)]
    df = spark.createDataFrame(rows, "i long, b string")
    assert [r.i for r in ordering.round_robin(df, ["b"], "i", 5).orderBy("i").collect()] == [0, 1, 2, 5, 6]


def test_gate_emits_and_clears(spark):
    df = spark.createDataFrame([("k", d, n) for d, n in enumerate([3, 4, 9, 1, 5])], "k string, d long, n long")
    got = [(r.d, r.pending, r.emitted) for r in ordering.gated(df, "k", "d", "n", 7).orderBy("d").collect()]
    assert got == [(0, 3, False), (1, 7, True), (2, 9, True), (3, 1, False), (4, 6, False)]


def test_coverage_and_references(spark):
    e = spark.createDataFrame([("r", "b"), ("r", "a"), ("s", "x")], "g string, m string")
    a = spark.createDataFrame([("r", "c"), ("r", "a"), ("s", "x"), ("s", "x")], "g string, m string")
    assert [tuple(r) for r in integrity.coverage(e, a, "g", "m").collect()] == [("r", "b", "c")]
    child = spark.createDataFrame([("p",), (None,), ("q",)], "ref string")
    parent = spark.createDataFrame([("p", 1), (None, 2)], "ref string, x int")
    assert [r.ref for r in integrity.unknown_references(child, parent, "ref", "ref").collect()] == ["q"]


def test_ladder_falls_back_level_by_level(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(2), rng.choice("ab"), rng.choice("xyz"), float(rng.randrange(9))) for i in range(60)]
    trials = [(i, rng.randrange(3), rng.choice("abc"), rng.choice("xyzw")) for i in range(40)]
    b = spark.createDataFrame(rows, "i int, w int, c string, n string, v double")
    t = spark.createDataFrame(trials, "id int, w int, c string, n string")
    got = {r.id: r for r in cohorts.ladder_baseline(t, b, ["w"], [["c", "n"], ["c"], []], "v").collect()}
    for i, w, c, n in trials:
        for level, keep in enumerate((lambda r: r[2:4] == (c, n), lambda r: r[2] == c, lambda r: True)):
            hit = [r[4] for r in rows if r[1] == w and keep(r)]
            if hit:
                assert (got[i].level, got[i].baseline_n) == (level, len(hit))
                assert got[i].baseline_mean == pytest.approx(sum(hit) / len(hit))
                break
        else:
            assert got[i].level == -1 and got[i].baseline_n == 0 and got[i].baseline_mean is None


def test_fold_does_not_depend_on_order(spark):
    entries = [("a", True, 5), ("a", False, 1), ("b", True, None), ("zz", True, 1), ("a", None, 9)]
    p = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, 1)], "d string, alpha long, beta long")
    results = []
    for seed in range(3):
        j = spark.createDataFrame(random.Random(seed).sample(entries, 5), "d string, ok boolean, cost long")
        rows = beliefs.fold_journal(p, j, "d", "ok", "cost").collect()
        results.append({(r.d, r.alpha, r.beta, r.trials, r.cost) for r in rows})
    assert results[0] == results[1] == results[2] == {("a", 2, 2, 2, 6), ("b", 2, 1, 1, 0), ("c", 1, 1, 0, 0)}


def test_clusters_keep_the_order_of_first_sighting(spark):
    rows = [("k", 3, "x", 1), ("k", 1, "y", 2), ("k", 2, "x", 3), ("k", 4, None, 4)]
    df = spark.createDataFrame(rows, "k string, o int, s string, n long")
    got = {tuple(r) for r in beliefs.merge_clusters(df, "k", "o", "s", ["n"]).filter("s is not null").collect()}
    assert {(r[0], r[1], r[2]) for r in got} == {("k", "y", 1), ("k", "x", 2)}


def test_delimited_repair(spark, tmp_path):
    assert delimited.detect_delimiter("a#b#c,d") == "#" and delimited.detect_delimiter("a") == ","
    lines = ["id,item_name,n", "1,a,b,c,5", "2,short", '3,"q,""x""",7', "4,,8", "5,plain,"]
    (tmp_path / "in.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    df = delimited.read_delimited(spark, str(tmp_path / "in.csv"), "item_name", "line")
    got = {r.id: (r.item_name, r.n) for r in df.collect()}
    assert got == {"1": ("a,b,c", "5"), "3": ('q,"x"', "7"), "4": (None, "8"), "5": ("plain", None)}
    assert [r.id for r in df.orderBy("line").collect()] == ["1", "3", "4", "5"]


def test_delimited_round_trip(spark, tmp_path):
    names = ["a#b", 'say "hi"', 'x#"y"', "line\nbreak\r", "back\\slash\\n", '"', "", None, "plain"]
    df = spark.createDataFrame([(str(i), n, "k#v" if i % 2 else None) for i, n in enumerate(names)], "id string, item_name string, more string")
    delimited.write_delimited(df, str(tmp_path / "d"), df.columns, "#", "item_name")
    header = spark.read.text(str(tmp_path / "d/header")).first()[0]
    back = delimited.read_delimited(spark, str(tmp_path / "d/rows"), "item_name", header=header)
    assert {tuple(r) for r in back.collect()} == {tuple(v or None for v in r) for r in df.collect()}


def test_json_lines(spark, tmp_path):
    (tmp_path / "j.jsonl").write_text('{"a": 1}\nnot json\n[1]\n{"a": 2}\n')
    assert [r.a for r in files.read_lenient(spark, str(tmp_path / "j.jsonl"), "a int").orderBy("a").collect()] == [1, 2]
    with pytest.raises(Exception):
        files.read_strict(spark, str(tmp_path / "j.jsonl"), "a int").collect()
    files.append_journal(spark.range(2), str(tmp_path / "out"))
    files.append_journal(spark.range(3), str(tmp_path / "out"))
    assert files.read_strict(spark, str(tmp_path / "out"), "id long").count() == 5
    with pytest.raises(Exception):
        files.write_new(spark.range(1), str(tmp_path / "out"))


def test_serving_table(spark, tmp_path):
    df = spark.createDataFrame([("r", None, "i", 'say "hi", you')], "request_id string, user_id string, item_id string, copy string")
    files.write_serving(df.withColumn("extra", F.lit(1)), str(tmp_path / "s"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "s/csv"))
    assert back.columns == files.SERVING and back.first().copy == 'say "hi", you'
    assert spark.read.json(str(tmp_path / "s/jsonl")).first().copy == 'say "hi", you'
    listed = files.inventory(spark, str(tmp_path / "s"), "*.csv").collect()
    assert listed and all(len(r.sha256) == 64 and r.size >= 0 for r in listed)


def test_streams_equal_batches_and_resume_files(spark, tmp_path):
    for part in range(3):
        rows = [(part * 10 + i, i % 3, float(i), f"2025-01-0{1 + i % 4} 00:00:00") for i in range(10)]
        df = spark.createDataFrame(rows + rows[:2], "id long, k long, v double, t string")
        df.withColumn("t", F.to_timestamp("t")).coalesce(1).write.mode("append").parquet(str(tmp_path / "log.parquet"))
    stream = lambda: journal.source(spark, str(tmp_path), "log", per_batch=1)
    batch = spark.read.parquet(str(tmp_path / "log.parquet"))
    folded = {tuple(r) for r in journal.fold_stream(spark, stream(), "k", F.col("v") > 4).collect()}
    want = batch.groupBy("k").agg(F.expr("count_if(v > 4)"), F.expr("count_if(v <= 4)"), F.count("*")).collect()
    assert folded == {tuple(r) for r in want}
    ledger = journal.ledger_stream(spark, stream(), "id").collect()
    assert sorted(r.id for r in ledger) == list(range(30))
    days = journal.windowed_stream(spark, stream(), "t", "1 day", [], "v")
    assert sum(r.n for r in days.collect()) == batch.count()
    gate = sorted(tuple(r) for r in journal.gate_stream(spark, stream(), "k", 5).collect())
    n = {r.k: r["count"] for r in batch.groupBy("k").count().collect()}
    assert gate == sorted((k, i + 1, 5) for k in n for i in range(n[k] // 5))


def test_streams_go_on_with_files_that_arrive_in_turn(spark, tmp_path):
    # The second file holds a row of a day long gone, the third one sent again.
    arriving = [[(1, "2025-03-01"), (2, "2025-03-09")], [(3, "2025-01-01"), (4, "2025-03-09")], [(1, "2025-03-01"), (5, "2025-06-01")]]
    at = {name: str(tmp_path / name) for name in ("days", "fold", "ledger", "gate")}
    sent = []
    for k, rows in enumerate(arriving):
        df = spark.createDataFrame(rows, "id long, t string").select("id", F.to_timestamp("t").alias("t"), F.lit("x").alias("k"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "log.parquet"))
        sent += rows
        stream = lambda: journal.source(spark, str(tmp_path), "log")
        days = journal.windowed_stream(spark, stream(), "t", "1 day", ["k"], "id", at["days"]).collect()
        assert {f"{r.start:%Y-%m-%d}": (r.n, r.total) for r in days} == {
            d: (sum(x == d for _, x in sent), sum(i for i, x in sent if x == d)) for _, d in sent
        }
        fold = journal.fold_stream(spark, stream(), "k", F.col("id") > 2, at["fold"]).collect()
        assert [tuple(r) for r in fold] == [("x", sum(i > 2 for i, _ in sent), sum(i <= 2 for i, _ in sent), len(sent))]
        assert sorted(r.id for r in journal.ledger_stream(spark, stream(), "id", at["ledger"]).collect()) == sorted({i for i, _ in sent})
        gate = journal.gate_stream(spark, stream(), "k", 3, at["gate"]).collect()
        assert sorted(r.emission for r in gate) == list(range(1, len(sent) // 3 + 1))


def test_ledger_keeps_late_rows_and_each_key_once(spark, tmp_path):
    # One file a batch, in the order written: late rows after a watermark, then a key sent again long after.
    sent = [[(1, "2025-03-01")], [(2, "2025-03-02")], [(3, "2025-01-01")] * 2, [(4, "2025-06-01")], [(1, "2025-06-02")]]
    for k, rows in enumerate(sent):
        df = spark.createDataFrame(rows, "id long, t string").withColumn("t", F.to_timestamp("t")).coalesce(1)
        df.write.mode("append").parquet(str(tmp_path / "log.parquet"))
        for f in (tmp_path / "log.parquet").glob("*.parquet"):
            if f.stat().st_mtime > 1_000_000_000:
                os.utime(f, (900_000_000 + k * 1_000,) * 2)
    ledger = journal.ledger_stream(spark, journal.source(spark, str(tmp_path), "log", per_batch=1), "id")
    assert sorted(r.id for r in ledger.collect()) == [1, 2, 3, 4]


def test_evidence_folders(spark, tmp_path):
    df = spark.createDataFrame([("a/b", "..n", 1), ("c", None, 2)], "request_id string, node_id string, x int")
    files.write_evidence(df, str(tmp_path / "e"))
    got = {tuple(r) for r in spark.read.json(str(tmp_path / "e")).select("request_id", "node_id", "x").collect()}
    assert got == {("a/b", "n", 1), ("c", "node", 2)}
