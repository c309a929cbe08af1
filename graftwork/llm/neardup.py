"""Near-duplicate records with small edits: Jaccard similarity of character runs over a whole table.

Steps: texts that are equal after normalizing form one class; each class gets a one-permutation signature with optimal
densification; bands of the signature give buckets; every bucket links its members to two centres only (stars), so a
bucket of m classes costs at most 2m - 3 candidate edges; edges are checked exactly on the sets of runs. As two members
of a star may be alike without either being its centre, checked edges of a lower similarity are kept as bridges, and the
neighbours of each class are checked against each other in a second pass: those of a class with few neighbours by a
join, those of a hub in tiles of bounded size, of which each task compares two and gives back the alike pairs only.

No join here lets the planner broadcast: its guess of the size of arrays after Python is far too low, and all tables
grow with the data. Collected and broadcast: the buckets that hold 1 % of all texts or more, at most 100 a band.

Defined cases: null texts, and texts with fewer letters and digits than one run, belong to no pair; equal texts are one
class of similarity 1; ids that are re-sent count once; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graftwork.session import cut

#: Probability that a pair at the threshold shares no bucket.
MISSED = 1e-5
#: Rows of a band. A bucket's members that are there by chance grow with the texts and fall with the power of their
#: similarity that the rows are: more rows serve collections of many millions, at the price of more bands.
ROWS = 3
#: A bucket is hot from this share of all bucket rows and this many members on; counters that find such buckets.
HOT_SHARE, HOT_MEMBERS, COUNTERS = 1 / 5000, 100_000, 1 << 17
#: Neighbours of a class up to which they are paired by a join, and about how many of a hub's make a tile.
FEW, TILE = 64, 1000
#: Keys over which the copies of one text are spread.
PARTS = 64
#: Similarity from which a checked star edge serves as a bridge to its neighbours.
BRIDGE = 0.35
_U = np.uint64


def normalized(text: Column) -> Column:
    """Lower case, letters and digits of any script only."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _runs(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, exact code) of each distinct run of ``width`` characters; width is at most 3."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(_U)
    lengths = np.array([len(t) for t in texts])
    owner = np.repeat(np.arange(len(texts)), lengths)
    if len(points) < width:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    last = len(points) - width + 1
    inside = owner[:last] == owner[width - 1 :]
    # Characters as their rank among those that occur, so that owner and run mostly fit one number, which sorts faster.
    seen = np.zeros(0x110000, bool)
    seen[points] = True
    chars = np.flatnonzero(seen).astype(_U)
    rank = np.cumsum(seen)[points].astype(_U) - _U(1)
    bits = max(len(chars) - 1, 1).bit_length()
    run = np.zeros(last, _U)
    for i in range(width):
        run = (run << _U(bits)) | rank[i : i + last]
    owner, run = owner[:last][inside], run[inside]
    if bits * width + max(len(texts) - 1, 1).bit_length() <= 64:
        key = np.sort((owner.astype(_U) << _U(bits * width)) | run)
        key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
        owner, run = (key >> _U(bits * width)).astype(np.int64), key & _U((1 << bits * width) - 1)
    else:
        order = np.lexsort((run, owner))
        owner, run = owner[order], run[order]
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (run[1:] != run[:-1])
        owner, run = owner[new], run[new]
    code = np.zeros(len(run), _U)
    for i in range(width):
        part = (run >> _U(bits * (width - 1 - i))) & _U((1 << bits) - 1)
        code = (code << _U(21)) | chars[part.astype(np.int64)]
    return owner, code


def one_permutation(owner: np.ndarray, code: np.ndarray, n: int, bins: int) -> np.ndarray:
    """n x bins signatures. One hash of each run picks a bin and its value; an empty bin borrows from the bins that a
    hash of (bin, attempt) names, the first filled one wins. Every text must have a run."""
    h = _mix(code + _U(0x9E3779B97F4A7C15))
    key = owner * bins + (h % _U(bins)).astype(np.int64)
    sig = np.full(n * bins, np.iinfo(_U).max, _U)
    full = np.zeros(n * bins, bool)
    np.minimum.at(sig, key, h)
    full[key] = True
    empty = np.flatnonzero(~full)
    bin_of, first = empty % bins, empty - empty % bins
    attempt = 0
    while len(empty):
        attempt += 1
        probe = _mix(np.arange(bins, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(attempt << 32))
        at = first + (probe % _U(bins)).astype(np.int64)[bin_of]
        hit = full[at]
        sig[empty[hit]] = sig[at[hit]]
        empty, bin_of, first = empty[~hit], bin_of[~hit], first[~hit]
    return sig.reshape(n, bins)


def _signed(batches: Iterator[pa.RecordBatch], width: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            n = part.num_rows
            owner, code = _runs(part.column("norm").to_pylist(), width)
            sig = one_permutation(owner, code, n, bands * rows).reshape(n, bands, rows)
            key = np.broadcast_to(np.arange(bands, dtype=_U) + _U(1), (n, bands))
            for i in range(rows):
                key = _mix(key * _U(0x9E3779B97F4A7C15) + sig[:, :, i])
            ends = np.searchsorted(owner, np.arange(n + 1))
            lists = lambda cuts, x: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x.astype(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [part.column("grp"), part.column("cid"), lists(ends, code), lists(np.arange(n + 1) * bands, key.reshape(-1))],
                names=["grp", "cid", "runs", "bands"],
            )


def bands_for(threshold: float, rows: int) -> int:
    """As many bands as ``MISSED`` asks for: 48 of 3 rows at 0.6, 83 of 4, 143 of 5, 241 of 6."""
    share = threshold**rows
    return 1 if share >= 1 else math.ceil(math.log(MISSED) / math.log1p(-share))


def _similarity(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def _side(classes: DataFrame, num: str, cid: str) -> DataFrame:
    return classes.select(
        F.col("num").alias(num), F.col("cid").alias(cid), F.col("runs").alias(f"runs_{cid}")
    ).hint("merge")


def _checked(edges: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """(m, n, a, b, similarity) of the edges (m, n), m < n, whose exact similarity reaches ``least``; a and b are class ids."""
    joined = edges.join(_side(classes, "m", "a"), "m").join(_side(classes, "n", "b"), "n")
    smaller, larger = F.least(F.size("runs_a"), F.size("runs_b")), F.greatest(F.size("runs_a"), F.size("runs_b"))
    return (
        joined.filter(smaller >= F.lit(least) * larger)
        .select("m", "n", "a", "b", _similarity(F.col("runs_a"), F.col("runs_b")).alias("similarity"))
        .filter(F.col("similarity") >= least)
    )


def star_edges(buckets: DataFrame, hot_members: int = HOT_MEMBERS) -> DataFrame:
    """(m, n), m < n: each member of a bucket with the bucket's centres. ``buckets``: bucket and num, both numbers.

    The centres are the two members whose numbers come first when xor-ed with the bucket's, so buckets of the same
    members have different centres. Members of one bucket meet by one shuffle; a hot one's stay where they are and get
    their centres by broadcast. What is hot is told by frequent-item counters; should they miss a bucket, its rows take
    the shuffle."""
    row = buckets.agg(F.count("*").alias("n"), F.call_function("approx_top_k", F.col("bucket"), F.lit(5000), F.lit(COUNTERS)).alias("top")).first()
    hot = [x.item for x in row.top or [] if x["count"] >= max(hot_members, row.n * HOT_SHARE)]
    placed = buckets.withColumn("place", F.col("num").bitwiseXOR(F.col("bucket")))
    rest = placed if not hot else placed.filter(~F.col("bucket").isin(*hot))
    edges = rest.repartition("bucket").sortWithinPartitions("bucket", "place").select("bucket", "num").mapInPandas(
        _stars, "num long, centre long"
    )
    if hot:
        own = placed.filter(F.col("bucket").isin(*hot))
        first = own.groupBy("bucket").agg(F.min("place").alias("p1"))
        second = own.join(F.broadcast(first), "bucket").filter("place > p1").groupBy("bucket", "p1").agg(F.min("place").alias("p2"))
        both = F.array(*[F.col(p).bitwiseXOR(F.col("bucket")) for p in ("p1", "p2")])
        met = own.join(F.broadcast(second.select("bucket", both.alias("centres"))), "bucket")
        edges = edges.unionByName(met.select("num", F.explode("centres").alias("centre")))
    return edges.filter("num <> centre").select(F.least("num", "centre").alias("m"), F.greatest("num", "centre").alias("n")).distinct()


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(num, centre) of rows sorted by bucket and place: a bucket's first two rows are its centres. Its rows may lie in
    several batches, so the first two of the last bucket are kept."""
    bucket = num = np.zeros(0, np.int64)
    for pdf in batches:
        known = len(bucket)
        bucket, num = np.concatenate([bucket, pdf.bucket.to_numpy()]), np.concatenate([num, pdf.num.to_numpy()])
        if not len(bucket):
            continue
        new = np.ones(len(bucket), bool)
        new[1:] = bucket[1:] != bucket[:-1]
        start = np.maximum.accumulate(np.where(new, np.arange(len(bucket)), 0))
        at = np.arange(len(bucket))
        late = at >= known
        one, two = np.flatnonzero(late & (at > start)), np.flatnonzero(late & (at > start + 1))
        yield pd.DataFrame({"num": num[np.concatenate([one, two])], "centre": num[np.concatenate([start[one], start[two] + 1])]})
        head = slice(start[-1], start[-1] + 2)
        bucket, num = bucket[head], num[head]


def _alike_across(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """The alike pairs of two tiles, or of one: common runs by products of bit columns where a run is frequent, by the
    pairs of its owners where it is rare."""
    one = int(pdf.i.iloc[0]) == int(pdf.j.iloc[0])
    left = pdf if one else pdf[pdf.tile == pdf.i]
    right = pdf if one else pdf[pdf.tile == pdf.j]
    sizes_a, sizes_b = left.runs.map(len).to_numpy(), right.runs.map(len).to_numpy()
    owner_a, owner_b = np.repeat(np.arange(len(left)), sizes_a), np.repeat(np.arange(len(right)), sizes_b)
    empty = pd.DataFrame({"m": [], "n": [], "a": [], "b": [], "similarity": []})
    if not len(owner_a) or not len(owner_b):
        return empty
    codes = np.concatenate([*left.runs, *right.runs])
    code = np.unique(codes, return_inverse=True)[1]
    code_a, code_b = code[: len(owner_a)], code[len(owner_a) :]
    often = np.bincount(code_b, minlength=code.max() + 1)
    common = np.zeros((len(left), len(right)), np.float32)
    frequent = np.flatnonzero(often >= 32)
    at = np.full(len(often), -1)
    for begin in range(0, len(frequent), 1024):
        part = frequent[begin : begin + 1024]
        at[:] = -1
        at[part] = np.arange(len(part))
        bits = []
        for rows, own, c in ((len(left), owner_a, code_a), (len(right), owner_b, code_b)):
            x, some = np.zeros((rows, len(part)), np.float32), at[c] >= 0
            x[own[some], at[c[some]]] = 1
            bits.append(x)
        common += bits[0] @ bits[1].T
    order = np.argsort(code_b, kind="stable")
    begins = np.concatenate([[0], np.cumsum(often)])
    rare = often[code_a] < 32
    n = often[code_a[rare]]
    a = np.repeat(owner_a[rare], n)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    b = owner_b[order[np.repeat(begins[code_a[rare]], n) + within]]
    common += np.bincount(a * len(right) + b, minlength=common.size).reshape(common.shape)
    both = common.astype(np.float64)
    similarity = both / (sizes_a[:, None] + sizes_b[None, :] - both)
    hit = similarity >= threshold
    x, y = np.nonzero(np.triu(hit, 1) if one else hit)
    p, q = left.num.to_numpy()[x], right.num.to_numpy()[y]
    ca, cb = left.cid.to_numpy()[x], right.cid.to_numpy()[y]
    swap = p > q
    return pd.DataFrame(
        {
            "m": np.where(swap, q, p),
            "n": np.where(swap, p, q),
            "a": np.where(swap, cb, ca),
            "b": np.where(swap, ca, cb),
            "similarity": similarity[x, y],
        }
    )


def _through_neighbours(bridges: DataFrame, classes: DataFrame, threshold: float, few: int, tile: int) -> DataFrame:
    """(m, n, a, b, similarity) of alike pairs of classes that are neighbours of one class."""
    ends = bridges.select(F.col("m").alias("x"), F.col("n").alias("y"))
    both = ends.union(ends.select("y", "x"))
    degree = both.groupBy("x").agg(F.count("*").alias("d")).filter("d > 1")
    both = cut(both.join(degree.hint("merge"), "x"))
    small = both.filter(F.col("d") <= few)
    pairs = (
        small.join(small.select("x", F.col("y").alias("z")).hint("merge"), "x")
        .filter("y < z")
        .select(F.col("y").alias("m"), F.col("z").alias("n"))
        .distinct()
        .join(bridges.select("m", "n").hint("merge"), ["m", "n"], "left_anti")
    )
    tiles = F.ceil(F.col("d") / tile).cast("int")
    own = F.pmod(F.xxhash64("y"), tiles).cast("int")
    # Each row goes to every pair of tiles that its own one is part of.
    spread_rows = (
        both.filter(F.col("d") > few)
        .join(classes.select(F.col("num").alias("y"), "cid", "runs").hint("merge"), "y")
        .select("x", F.col("y").alias("num"), "cid", "runs", own.alias("tile"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("k"))
        .select("x", "num", "cid", "runs", "tile", F.least("tile", "k").alias("i"), F.greatest("tile", "k").alias("j"))
    )
    hubs = spread_rows.groupBy("x", "i", "j").applyInPandas(
        lambda pdf: _alike_across(pdf, threshold), "m long, n long, a binary, b binary, similarity double"
    )
    return _checked(pairs, classes, threshold).unionByName(hubs)


def near_duplicates(
    df: DataFrame,
    group: str,
    id_col: str,
    text_col: str,
    threshold: float = 0.6,
    width: int = 3,
    bands: int | None = None,
    rows: int = ROWS,
    few: int = FEW,
    tile: int = TILE,
) -> tuple[DataFrame, DataFrame]:
    """(links, members). links: a, b, similarity of every pair of different texts of one group that are at least
    ``threshold`` alike, a and b being class ids; members: the group, id and class id (cid) of each record. Bands follow
    from the threshold and the rows unless given.

    A class id is the MD5 of group and normalized text. Candidates carry its first half as a number; should two classes
    share that, both are checked."""
    texts = df.select(F.col(group).alias("grp"), F.col(id_col).alias("id"), normalized(F.col(text_col)).alias("norm"))
    texts = texts.filter((F.length("norm") >= width) & F.col("id").isNotNull())
    texts = texts.withColumn("cid", F.unhex(F.md5(F.concat_ws("\0", F.coalesce("grp", F.lit("")), "norm"))))
    members = cut(texts.select("grp", "id", "cid").distinct())
    bands = bands or bands_for(threshold, rows)
    distinct = texts.select("grp", "cid", "norm").distinct()
    signed = distinct.mapInArrow(
        lambda it: _signed(it, width, bands, rows), "grp string, cid binary, runs array<bigint>, bands array<bigint>"
    )
    number = F.conv(F.substring(F.hex("cid"), 2, 15), 16, 10).cast("long")
    classes = cut(signed.withColumn("num", number))
    buckets = classes.select("num", "grp", F.explode("bands").alias("bucket"))
    edges = star_edges(buckets.select("num", F.xxhash64("grp", "bucket").alias("bucket")))
    bridges = cut(_checked(edges, classes, min(BRIDGE, threshold)))
    links = bridges.filter(F.col("similarity") >= threshold).unionByName(
        _through_neighbours(bridges, classes, threshold, few, tile)
    )
    return links.groupBy("a", "b").agg(F.max("similarity").alias("similarity")), members


def duplicate_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """(grp, id_a, id_b) of all pairs of records: those of linked classes and those of one class; ids in no order.

    A class is spread over ``PARTS`` keys, and each pair of parts is one key of the join, so the copies of a text that
    many records hold are paired in many tasks."""
    spread_out = members.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int"))
    parts = spread_out.groupBy("cid", "part").agg(F.count("*").alias("n"))
    side = lambda c, p, *more: parts.select(F.col("cid").alias(c), F.col("part").alias(p), *more).hint("merge")
    crossing = (
        links.select("a", "b").join(side("a", "i"), "a").join(side("b", "j"), "b").withColumn("same", F.lit(False))
    )
    copies = (
        side("a", "i", "n")
        .join(side("a", "j"), "a")
        .filter("i < j or (i = j and n > 1)")
        .select("a", "i", F.col("a").alias("b"), "j", (F.col("i") == F.col("j")).alias("same"))
    )
    left = spread_out.select("grp", F.col("cid").alias("a"), F.col("part").alias("i"), F.col("id").alias("id_a"))
    right = spread_out.select(F.col("cid").alias("b"), F.col("part").alias("j"), F.col("id").alias("id_b"))
    pairs = crossing.select("a", "i", "b", "j", "same").unionByName(copies)
    joined = pairs.join(left.hint("merge"), ["a", "i"]).join(right.hint("merge"), ["b", "j"])
    return joined.filter("not same or id_a < id_b").select("grp", "id_a", "id_b")
