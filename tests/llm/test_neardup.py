import random
from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from graftwork.llm import neardup
from graftwork.llm.neardup import _runs, bands_for, duplicate_pairs, near_duplicates, one_permutation, star_edges

SCHEMA = "g string, id string, t string, norm string, cid string"


def brute(rows, threshold):
    norm = {(g, i): "".join(c for c in t.lower() if c.isalnum()) for g, i, t in rows if t}
    runs = {k: {z[i : i + 3] for i in range(len(z) - 2)} for k, z in norm.items() if len(z) >= 3}
    out = set()
    for (g, a), (h, b) in combinations(sorted(runs), 2):
        x, y = runs[g, a], runs[h, b]
        if g == h and len(x & y) / len(x | y) >= threshold:
            out.add((g, a, b))
    return out


def found(spark, records, **more):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in records], SCHEMA)
    links, members = near_duplicates(df, "g", "id", "t", **more)
    got = [(r.grp, *sorted((r.id_a, r.id_b))) for r in duplicate_pairs(links, members).collect()]
    assert len(got) == len(set(got))
    return set(got)


def edited(rng, text, n):
    t = list(text)
    for _ in range(n):
        t[rng.randrange(len(t))] = rng.choice("甲乙丙丁ABCdef")
    return "".join(t)


def test_bands():
    assert [bands_for(0.6, r) for r in (3, 4, 5, 6)] == [48, 83, 143, 241] and bands_for(1.0, 3) == 1
    assert all((1 - 0.6**r) ** bands_for(0.6, r) <= 1e-5 for r in (3, 4, 5, 6))


@pytest.mark.parametrize("plan", [{}, {"rows": 4}, {"rows": 6}, {"few": 2, "tile": 5}, {"few": 1}])
def test_equals_brute_force(spark, plan):
    rng = random.Random(5)
    rows = []
    for k in range(40):
        base = "".join(rng.choice("春夏秋冬山川湖海abcdefgh风花雪月") for _ in range(rng.randrange(20, 70)))
        for j in range(rng.randrange(1, 9)):
            rows.append((rng.choice("xy"), f"{k:02}-{j}", edited(rng, base, rng.randrange(0, 6))))
    assert found(spark, rows, **plan) == brute(rows, 0.6)


def test_hot_copies_and_odd_texts(spark):
    rows = [("x", f"c{i:03}", "一模一样的文案。" if i % 2 else "一模一样的 文案") for i in range(60)]
    rows += [("x", "n", None), ("x", "e", ""), ("x", "b", "!?"), ("x", "s", "ab"), ("y", "o", "一模一样的文案")]
    rows += [("x", "long", "长文" * 20_000), ("x", "c001", "一模一样的文案。")]
    got = found(spark, rows)
    assert got == brute(list(dict.fromkeys(rows)), 0.6) and len(got) == 60 * 59 // 2


def test_stars_of_hot_and_other_buckets(spark):
    rng = random.Random(3)
    rows = [(rng.choice([7, 7, 7, 8, 9, 10 + k]), n) for k in range(40) for n in range(30)]
    rows = list(dict.fromkeys(rows))
    df = spark.createDataFrame(rows, "bucket long, num long").repartition(3)
    want = set()
    for b in {b for b, _ in rows}:
        own = sorted((n for x, n in rows if x == b), key=lambda n: n ^ b)
        want |= {(min(c, n), max(c, n)) for c in own[:2] for n in own if n != c}
    for hot in (10, 10**9):
        got = [tuple(r) for r in star_edges(df, hot_members=hot).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_stars_over_batches():
    rng = np.random.default_rng(2)
    bucket = np.sort(rng.integers(0, 40, 300))
    pdf = pd.DataFrame({"bucket": bucket, "num": np.arange(300)})
    whole = pd.concat(neardup._stars(iter([pdf])))
    parts = pd.concat(neardup._stars(pdf.iloc[k : k + 7] for k in range(0, 300, 7)))
    assert sorted(map(tuple, whole.to_numpy())) == sorted(map(tuple, parts.to_numpy()))
    assert len(whole) == sum(max(2 * n - 3, 0) if n > 1 else 0 for n in np.bincount(bucket))


def test_no_join_broadcasts_what_grows(spark):
    df = spark.createDataFrame([("x", str(i), f"文案{i % 7}号很长很长", "clash", "clash") for i in range(50)], SCHEMA)
    links, members = near_duplicates(df, "g", "id", "t")
    for plan in (links, duplicate_pairs(links, members)):
        plan.collect()
        assert "Broadcast" not in plan._jdf.queryExecution().executedPlan().toString()


def test_copies_are_paired_over_parts(spark, monkeypatch):
    monkeypatch.setattr(neardup, "PARTS", 3)
    rows = [("x", f"{i:03}", "同一段文案同一段文案") for i in range(40)] + [("x", f"b{i}", "同一段文案同一段文案呀") for i in range(9)]
    assert found(spark, rows) == brute(rows, 0.6)


def test_empty_table(spark):
    assert found(spark, []) == set()


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    words = ["".join(chr(0x4E00 + c) for c in rng.integers(0, 500, 60)) for _ in range(50)]
    pairs = [w + w[:20][::-1] for w in words]
    owner, code = _runs(words + pairs, 3)
    sig = one_permutation(owner, code, 100, 256)
    sets = [set(code[owner == i].tolist()) for i in range(100)]
    true = [len(sets[i] & sets[i + 50]) / len(sets[i] | sets[i + 50]) for i in range(50)]
    guess = [(sig[i] == sig[i + 50]).mean() for i in range(50)]
    assert abs(np.mean(true) - np.mean(guess)) < 0.03
