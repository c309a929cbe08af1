"""Queries that SQL can express against DuckDB; the others against libraries and invariants, on whole small tables."""

import pytest

from graftwork.llm import queries as q


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_query_equals_its_sql(name, spark, sf_dir, same):
    same(q.QUERIES[name](spark, sf_dir), q.ORACLES[name], sf_dir)


def test_p6_equals_the_library(spark, sf_dir):
    import tiktoken

    from graftwork.llm import bpe

    ranks = bpe.read_ranks(f"{q.TOKENIZERS}/byte_bpe_50k.tiktoken")
    lib = tiktoken.Encoding("t", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r.ids for r in q.p6_ids(spark, sf_dir).collect()}
    assert got == {k: lib.encode_ordinary(t) for k, t in texts.items()}


def test_p7_holds_every_document(spark, sf_dir):
    limits = {r.limit_id: r.capacity for r in spark.read.parquet(f"{sf_dir}/pack_limits.parquet").collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    rows = q.p7_packed(spark, sf_dir).collect()
    for limit, capacity in limits.items():
        own = [r for r in rows if r.limit_id == limit]
        assert len({r.doc_id for r in own}) == docs
        filled, parts = {}, {}
        for r in own:
            if r.container is not None:
                filled[r.container] = filled.get(r.container, 0) + r.n_tokens
            parts.setdefault(r.doc_id, []).append(r)
        assert max(filled.values()) <= capacity
        for p in parts.values():
            size = sum(r.n_tokens for r in p)
            assert len(p) == max(1, -(-size // capacity))
            assert (size == 0) == (p[0].container is None)
        # A shard leaves at most a few containers partly open.
        assert len(filled) <= -(-sum(filled.values()) // capacity) + 3


def test_p7_sizes_are_those_of_p6(spark, sf_dir):
    from pyspark.sql import functions as F

    sizes = {r.doc_id: r.n for r in q.p6_ids(spark, sf_dir).select("doc_id", F.size("ids").alias("n")).collect()}
    packed = q.p7_packed(spark, sf_dir).filter("limit_id = 1").groupBy("doc_id").agg(F.sum("n_tokens").alias("n"))
    assert {r.doc_id: r.n for r in packed.collect()} == sizes


def test_p8_restores_garbled_documents_and_leaves_the_others(spark, sf_dir, tmp_path):
    import hashlib

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r.doc_id: r.restored_md5 for r in q.p8_found(spark, sf_dir).collect()}
    assert before and all(len(v) in (0, 32) for v in before.values())
    clean = [r for r in docs.filter("text is not null").collect() if r.doc_id not in before and not r.text.isascii()]
    plants, want = [], {}
    for k, r in enumerate(clean[:40]):
        read = ("latin-1", "cp1252", "mac_roman", "cp437")[k % 4]
        text = r.text if k % 2 else "order 7 - status=ok\n" + r.text
        try:
            bad = text.encode().decode(read)
        except UnicodeDecodeError:
            continue
        plants.append((10**9 + k, bad))
        want[10**9 + k] = hashlib.md5(text.encode()).hexdigest()
    assert len(plants) >= 20
    more = spark.createDataFrame(plants, "doc_id long, text string")
    docs.unionByName(more, allowMissingColumns=True).write.parquet(f"{tmp_path}/documents.parquet")
    after = {r.doc_id: r.restored_md5 for r in q.p8_found(spark, str(tmp_path)).collect()}
    right = [k for k in want if after.get(k) == want[k]]
    assert want.keys() <= after.keys() and len(right) >= 0.95 * len(want)
    assert {k for k in after if k < 10**9} == before.keys()
