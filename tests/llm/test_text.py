import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from graftwork.llm import bpe, mojibake, packing
from graftwork.llm.queries import TOKENIZERS


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library(ranks):
    import tiktoken

    return tiktoken.Encoding("t", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_of_odd_texts(spark, ranks, library):
    texts = [
        "", None, " ", "\n\n  x\t", "a" * 3_000, "ab" * 1_500, "x1!" * 300, "Hello, world's 123  end ", "　全角　空格",
        "中文没有空格的很长很长的句子" * 60, "👨‍👩‍👧🏳️‍🌈 𝓯𝓪𝓷𝓬𝔂 ①②㎏", "العربية русский 한국어 日本語", "\x00\x01\x1f\x7f\x85\xa0", "<|endoftext|>",
        "lowercase DON'T we'll 'S", "base64" + "QWxhZGRpbjpvcGVuIHNlc2FtZQ" * 40, "​‍﻿", "\U000e0001\U0010ffff",
        "".join(np.random.default_rng(3).choice(list("abcdefghijklmnopqrstuvwxyz"), 100_000)),
    ]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "i long, t string, word string")
    got = {r.id: r.ids for r in bpe.encode_corpus(df.union(df.limit(3)), "i", "t", ranks).collect()}
    assert got == {i: library.encode_ordinary(t or "") for i, t in enumerate(texts)}
    rows = spark.createDataFrame([(i, ids) for i, ids in got.items()], "i long, ids array<int>")
    back = {r.id: r.text for r in bpe.decode_corpus(rows, "i", "ids", ranks).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.encode_corpus(df.limit(0), "i", "t", ranks).count() == 0


def test_words_beyond_the_frequent_ones(spark, ranks, library, monkeypatch):
    monkeypatch.setattr(bpe, "FREQUENT", 2)
    df = spark.createDataFrame([(1, "the cat the dog"), (2, "the end of it")], "i long, t string")
    got = {r.id: r.ids for r in bpe.encode_corpus(df, "i", "t", ranks).collect()}
    assert got == {1: library.encode_ordinary("the cat the dog"), 2: library.encode_ordinary("the end of it")}


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(max_size=40), min_size=1, max_size=20))
def test_round_trip(spark, ranks, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    ids = bpe.encode_corpus(df, "i", "t", ranks)
    back = {r.id: r.text for r in bpe.decode_corpus(ids, "id", "ids", ranks).collect()}
    assert back == dict(enumerate(texts))


def test_sum_of_squares_follows_its_rule():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 31, 400)
    capacity, gaps, at = 30, {}, packing.sum_of_squares(sizes, 30)
    for s, b in zip(sizes.tolist(), at.tolist()):
        count = np.bincount([g for g in gaps.values() if g], minlength=capacity + 1)

        def after(gap, s=s, count=count):
            new = count.copy()
            if gap < capacity:
                new[gap] -= 1
            if gap > s:
                new[gap - s] += 1
            return int((new[1:capacity] ** 2).sum())

        options = [after(g) for g in {*gaps.values(), capacity} if g >= s]
        assert after(gaps.get(b, capacity)) == min(options)
        gaps[b] = gaps.get(b, capacity) - s
        assert gaps[b] >= 0


def test_packing_cases(spark):
    rows = [(1, 0), (2, None), (3, 10), (4, 25), (5, 10), (5, 10), (6, 3), (7, 7), (8, 20)]
    df = spark.createDataFrame(rows, "i long, size long")
    got = packing.pack(df, "i", "size", {1: 10}).collect()
    pieces = {(r.id, r.piece_no): (r.first, r.n, r.container) for r in got}
    assert len(pieces) == len(got) == 11
    assert pieces[1, 0][1:] == pieces[2, 0][1:] == (0, None)
    assert [pieces[4, k][:2] for k in range(3)] == [(0, 10), (10, 10), (20, 5)]
    assert pieces[6, 0][2] == pieces[7, 0][2] and len({c for *_, c in pieces.values()}) == 1 + 1 + 2 + 2 + 1 + 1 + 1
    assert packing.pack(df.limit(0), "i", "size", {1: 10}).count() == 0


CLEAN = [
    "质保527天；破损包赔，随手退换。旅人常说背包难隔开，我们把耐磨与结实放在一起。", "Größe 219, Übergang schön gelöst. Die Mütze ist früh am Morgen gedacht.",
    "Le texte n’évoque pas assez Noël ; l’idée reste préférée. « Çà et là »", "Оценка 296: добавьте сцену «на прогулке». Этот крем очень свежий.",
    "通勤に軽やかな手ぬぐいを。評価は93点、昼休みの場面がもう少し欲しい。", "평가는 317점, 주말 장면이 부족합니다. 출근길에 어울리는 부드러운 선크림.",
    "وسادة لطيفة لكل يوم. وشاح خفيف جدا. التقييم 16", "We’d rather show a plain rain boot – for £632 or €611, naïve baseline excluded.",
    "ÀÉÎÕÜ ñ ç ß Ø", "plain ascii only",
]
GARBLED = [
    (0, "utf-8", "latin-1"), (0, "gb18030", "latin-1"), (0, "utf-8", "gb18030"), (1, "utf-8", "cp1252"), (1, "utf-8", "mac_roman"),
    (2, "utf-8", "cp437"), (3, "utf-8", "cp1251"), (3, "cp1251", "latin-1"), (3, "koi8_r", "cp1251"), (4, "cp932", "latin-1"),
    (4, "euc_jp", "latin-1"), (5, "cp949", "latin-1"), (6, "cp1256", "latin-1"), (6, "utf-8", "latin-1"), (7, "utf-8", "latin-1"),
]


def test_planted_passages_are_restored(spark):
    rows = [(i, CLEAN[i % len(CLEAN)]) for i in range(2_000)]
    want = {}
    for k, (i, written, read) in enumerate(GARBLED):
        bad = CLEAN[i].encode(written, "ignore").decode(read, "ignore")
        good = CLEAN[i].encode(written, "ignore").decode(written)
        if bad.encode(read) != CLEAN[i].encode(written, "ignore"):
            continue
        rows += [(10_000 + k, bad), (20_000 + k, "status=ok\n" + bad + "\n" + CLEAN[7])]
        want |= {10_000 + k: good, 20_000 + k: "status=ok\n" + good + "\n" + CLEAN[7]}
    twice = CLEAN[2].encode().decode("latin-1").encode().decode("latin-1")
    lost = CLEAN[1].encode("latin-1").decode("utf-8", "replace")
    rows += [(1, twice), (3, lost), (5, "前锟斤拷锟斤拷后"), (7, None), (9, "")]
    rows = [r for r in rows if r[0] not in (1, 3, 5, 7, 9) or r[1] in (twice, lost, None, "", "前锟斤拷锟斤拷后")]
    want |= {1: CLEAN[2], 3: None, 5: None}
    df = spark.createDataFrame([(*r, "c") for r in rows], "i long, t string, restored string")
    got = {r.i: r.restored for r in mojibake.repair(df, "i", "t").collect()}
    assert {k: (got.get(k), v) for k, v in want.items() if k not in got or got[k] != v} == {}
    assert got.keys() == want.keys()


def test_short_passages_like_a_common_source_are_restored(spark):
    # A fifth of the rows is garbled alike: its characters pass as ordinary language until the second round's table.
    bad = lambda t: t.encode().decode("latin-1")
    french = "naïve élève à côté d'une forêt où le château brûlé ne gêne guère « la fenêtre déjà cassée après la fête » 20° été "
    rows = [(i, french + str(i), None) for i in range(200)]
    rows += [(1_000 + i, bad(french * 3 + str(i)), french * 3 + str(i)) for i in range(50)]
    rows += [(2_000 + i, bad(f"cafe {i}: thé"), f"cafe {i}: thé") for i in range(3)]
    df = spark.createDataFrame(rows, "i long, t string, original string")
    got = {r.i: r.restored for r in mojibake.repair(df, "i", "t").collect()}
    assert got == {i: original for i, _, original in rows if original}


def _model(chars, twos):
    return mojibake.Model({ord(c): n for c, n in chars.items()} | {mojibake._PAIR_AT + a * 16 + b: n for (a, b), n in twos.items()})


def test_passage_that_begins_rare_inside_a_word():
    chars = {"Â": 1000, "Å": 100, "ê": 10, "ì": 1, "×": 1, "Ô": 1, "é": 10**8, "的": 10**9, "觎": 10**7, "自": 10**6}
    model = _model(chars, {(10, 1): 10**7, (1, 1): 5 * 10**7, (10, 9): 10**6, (9, 9): 10**7, (1, 9): 1})
    text = "No" + "屡觎觎自".encode("gb18030").decode("latin-1")
    assert mojibake.restore(text, model) == "No屡觎觎自"
    spans = mojibake.label(text, model)
    model.gain = [[1e9] * 11] * 11  # nothing is given up
    assert mojibake.label(text, model) == spans


def test_text_garbled_six_times():
    text = once = "Добавьте сцену на прогулке. Этот крем очень свежий."
    model = _model({c: 10_000 for c in text if c > "\x7f"}, {(10, 4): 10_000, (4, 4): 400_000})
    for _ in range(6):
        text = text.encode().decode("latin-1")
    assert mojibake.restore(text, model) == once


def test_nothing_to_repair(spark):
    df = spark.createDataFrame([(1, "plain"), (2, None)], "i long, t string")
    assert mojibake.repair(df, "i", "t").count() == 0
    assert mojibake.repair(df.limit(0), "i", "t").count() == 0
