"""Byte-level BPE encoding of a whole corpus with a public tokenizer's ranks, in Spark expressions.

Texts are cut into words by the tokenizer's pattern; each distinct word is encoded once. A word is an array of its UTF-8
bytes, as the ids of the tokens of one byte; it is first cut between bytes that stand side by side in no token, as no
merge can cross such a place. Each piece is then folded: every step merges, from left to right, all places of the
adjacent pair with the smallest rank, until no pair has one. Ranks come from a literal: an array of small lists of pairs
and ranks, addressed by the pair, since a lookup in one large map would scan it.

The ``FREQUENT`` most frequent words of at most ``SHORT`` characters are a literal too, so a text looks up its own words
where it lies. Only its other words meet the dictionary, by a shuffle of (text, place, word), and come back to it.

Defined cases: null and empty texts give an empty list; a repeated row gives one row; rows with one id and different
texts give a row each; text of any script or none, and words of any length, are encoded whole.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graftwork.session import cut, spread

#: Fixed value: the pattern that splits text before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
FREQUENT, SHORT = 4096, 64
#: Lists of the rank literal (a prime), and what a pair's first token is multiplied by in its key, beyond all ranks.
_LISTS, _FIRST = 32_749, 1 << 20
_MAPS = 1 << 11


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a file of base64 tokens with their ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def _words_of(text: Column) -> Column:
    """The words of a text; Java's ``\\s`` knows no blanks beyond ASCII unless told to."""
    return F.regexp_extract_all(text, F.lit("(?U)" + PATTERN), F.lit(0))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _rank_literal(ranks: dict[bytes, int]) -> Column:
    """Lists of pair, rank, pair, rank...; a pair of token ids is one number above all ranks."""
    lists: list[list[int]] = [[] for _ in range(_LISTS)]
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                pair = (a + 1) * _FIRST + b
                lists[pair % _LISTS] += [pair, rank]
    return F.from_json(F.lit(json.dumps(lists, separators=(",", ":"))), "array<array<bigint>>")


def _pieces_pattern(ranks: dict[bytes, int]) -> str:
    """Matches the longest run of bytes of which each two neighbours stand side by side in some token."""
    after: dict[int, set[int]] = {}
    for token in ranks:
        for a, b in zip(token, token[1:]):
            after.setdefault(a, set()).add(b)
    alike: dict[tuple[int, ...], list[int]] = {}
    for a, bs in after.items():
        alike.setdefault(tuple(sorted(bs)), []).append(a)
    kind = lambda bs: "[" + "".join(f"\\x{b:02x}" for b in sorted(bs)) + "]"
    steps = sorted(alike.items(), key=lambda x: -len(x[0]))
    return "(?s)(?:" + "|".join(f"{kind(firsts)}(?={kind(bs)})" for bs, firsts in steps) + ")*+."


def encoded_word(word: Column, ranks: dict[bytes, int]) -> Column:
    """Token ids of one word."""
    literal = _rank_literal(ranks)
    byte_ids = F.from_json(F.lit(json.dumps([ranks[bytes([b])] for b in range(256)])), "array<bigint>")
    as_bytes = F.decode(F.encode(word, "utf-8"), "iso-8859-1")
    pieces = F.regexp_extract_all(as_bytes, F.lit(_pieces_pattern(ranks)), F.lit(0))

    def rank(a: Column, b: Column) -> Column:
        def found(pair: Column) -> Column:
            return _let(
                F.get(literal, (pair % _LISTS).cast("int")),
                lambda xs: F.get(xs, F.nullif(F.array_position(xs, pair), F.lit(0).cast("long")).cast("int")),
            )

        return _let((a + 1) * _FIRST + b, found)

    def step(state: Column, _: Column) -> Column:
        tokens = state.tokens

        def merged(p: Column) -> Column:
            # Of places side by side every second one merges, from the left.
            marks = F.array_join(F.transform(p.ranks, lambda r: F.when(r == p.best, "1").otherwise("0")), "")
            marks = F.split(F.replace(marks, F.lit("11"), F.lit("10")), "")
            put = lambda at: F.array_compact(
                F.transform(
                    tokens,
                    lambda x, i: F.when(F.get(at, i) == "1", p.best)
                    .when((i > 0) & (F.get(at, i - 1) == "1"), F.lit(None))
                    .otherwise(x),
                )
            )
            return F.when(p.best.isNull(), F.struct(tokens.alias("tokens"), F.lit(False).alias("open"))).otherwise(
                F.struct(_let(marks, put).alias("tokens"), F.lit(True).alias("open"))
            )

        def best_of(rs: Column) -> Column:
            return _let(F.struct(rs.alias("ranks"), F.array_min(rs).alias("best")), merged)

        pairs = F.zip_with(tokens, F.slice(tokens, 2, F.size(tokens)), rank)  # the last one has no second token
        return F.when(state.open, _let(pairs, best_of)).otherwise(state)

    def fold(piece: Column) -> Column:
        start = F.transform(F.split(piece, ""), lambda c: F.get(byte_ids, F.ascii(c)))
        first = F.struct(start.alias("tokens"), F.lit(True).alias("open"))
        merges = F.slice(F.sequence(F.lit(1), F.length(piece)), 2, F.length(piece))  # one less than bytes, at most
        return F.aggregate(merges, first, step, lambda s: s.tokens)

    return F.flatten(F.transform(pieces, fold)).cast("array<int>")


def _looked_up(dictionary: DataFrame) -> Callable[[Column], Column]:
    """A lookup of the most frequent words' ids, null for all others. Collected: at most ``FREQUENT`` short words."""
    often = dictionary.filter(F.length("word") <= SHORT).orderBy(F.desc("n"), "word").limit(FREQUENT)
    maps: list[dict[str, list[int]]] = [{} for _ in range(_MAPS)]
    for r in often.select("word", "ids").collect():
        maps[zlib.crc32(r.word.encode()) % _MAPS][r.word] = r.ids
    literal = F.from_json(F.lit(json.dumps(maps, separators=(",", ":"))), "array<map<string,array<int>>>")
    return lambda w: F.try_element_at(F.get(literal, (F.crc32(F.encode(w, "utf-8")) % _MAPS).cast("int")), w)


def encode_corpus(df: DataFrame, id_col: str, text_col: str, ranks: dict[bytes, int]) -> DataFrame:
    """(id, ids): the token ids of every text."""
    texts = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = spread(texts, "id")
    distinct = texts.select(F.explode(_words_of(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    dictionary = cut(distinct.withColumn("ids", encoded_word(F.col("word"), ranks)))
    ids_of = _looked_up(dictionary)
    # The ids of a text's frequent words; in place of any other word the number -1 - its place.
    words = texts.select(F.struct("id", F.xxhash64("text").alias("h")).alias("k"), _words_of(F.col("text")).alias("words"))
    filled = F.flatten(F.transform("words", lambda w, i: F.coalesce(ids_of(w), F.array(-1 - i))))
    placed = words.withColumn("ids", filled)
    rare = (
        placed.select("k", "words", F.explode(F.filter("ids", lambda x: x < 0)).alias("at"))
        .select("k", "at", F.get("words", -1 - F.col("at")).alias("word"))
        .join(dictionary.select("word", F.col("ids").alias("of_word")).hint("merge"), "word")
        .groupBy("k")
        .agg(F.collect_set(F.struct("at", "of_word")).alias("rest"))  # a repeated row's words once
    )
    whole = F.when(F.col("rest").isNull(), F.col("ids")).otherwise(
        _let(
            F.map_from_entries("rest"),
            lambda rest: F.flatten(F.transform("ids", lambda x: F.when(x < 0, F.element_at(rest, x)).otherwise(F.array(x)))),
        )
    )
    joined = placed.select("k", "ids").join(rare.hint("merge"), "k", "left").select("k", whole.alias("ids"))
    return joined.groupBy("k").agg(F.first("ids").alias("ids")).select("k.id", "ids")


def decode_corpus(df: DataFrame, id_col: str, ids_col: str, ranks: dict[bytes, int]) -> DataFrame:
    """(id, text): the texts of token ids, the pieces of bytes put together and read as UTF-8; unknown ids give null."""
    spark = df.sparkSession
    pieces = spark.createDataFrame([(r, bytearray(t)) for t, r in ranks.items()], "token int, piece binary")
    placed = df.select(F.col(id_col).alias("id"), F.posexplode_outer(ids_col).alias("pos", "token"))
    joined = placed.join(F.broadcast(pieces), "token", "left")  # as many rows as the vocabulary
    known = F.count_if(F.col("token").isNotNull() & F.col("piece").isNull()) == 0
    whole = F.expr("listagg(piece) within group (order by pos)")
    none = F.lit("").cast("binary")
    return (
        joined.groupBy("id")
        .agg(whole.alias("bytes"), known.alias("known"))
        .select("id", F.when(F.col("known"), F.decode(F.coalesce("bytes", none), "utf-8")).alias("text"))
    )
