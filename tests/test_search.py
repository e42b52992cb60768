"""Both arms send few rows from their tasks, however many blocks of chunks there are, and rank as plain joins do."""

import random

import pytest
from pyspark.sql import functions as F

from feldspar.operators import search


@pytest.fixture(scope="module")
def chunks(spark):
    rng = random.Random(3)
    rows = [(i, f"s{i % 3}" if i % 50 else None, " ".join(f"w{int(rng.random() ** 2 * 30)}" for _ in range(rng.randint(0, 20))) if i % 41 else None, [rng.random() - 0.5 for _ in range(4)]) for i in range(600)]
    return spark.createDataFrame(rows, "chunk_id bigint, doc_type string, content string, vector array<float>").repartition(2).cache()


@pytest.fixture(scope="module")
def terms(spark):
    return spark.createDataFrame([(q, f"w{(q * k) % 32}") for q in range(12) for k in (1, 2, 5)], "query_id bigint, term string").distinct()


@pytest.fixture()
def blocks(monkeypatch):
    for name, value in (("QUERY_BLOCK", 5), ("CHUNK_BLOCK", 64), ("QUERY_TILE", 2)):
        monkeypatch.setattr(search, name, value)


def test_text_by_blocks_is_the_join(chunks, terms, blocks):
    for rank_by in (["doc_type"], []):
        got = search.bm25_arm(chunks, terms, ["doc_type"], 10, rank_by)
        want = search._ranked(search._joined(chunks, terms, ["doc_type"]), rank_by, "bm25", "trank", 10)
        assert sorted(map(tuple, got.select("query_id", "chunk_id", "doc_type", "bm25", "trank").collect())) == sorted(map(tuple, want.select("query_id", "chunk_id", "doc_type", "bm25", "trank").collect()))
        assert got.count()


def test_few_rows_leave_many_blocks(chunks, terms, blocks):
    queries = chunks.where("chunk_id % 60 = 1").select(F.col("chunk_id").alias("query_id"), "vector")
    few = search.vector_scores(chunks.select("chunk_id", "vector"), queries, [], 4)
    assert few.groupBy("query_id").count().agg(F.max("count"), F.min("count")).first()[0] <= 2 * 4 + 10  # ten blocks
    assert few.count() < 10 * 10 * 4 / 2
    said = search.bm25_scores(chunks, terms, ["doc_type"], 4, [])
    assert said.count() < search._joined(chunks, terms, ["doc_type"]).count() / 5


def test_hybrid_is_the_fusion_of_both_arms(chunks, terms, blocks):
    queries = chunks.where("chunk_id < 12").select(F.col("chunk_id").alias("query_id"), "vector")
    known = chunks.where("doc_type is not null")
    got = search.hybrid(known, known, queries, terms, ["doc_type"], pool=7)
    want = search.fuse(search.vector_arm(known, queries, ["doc_type"]), search.bm25_arm(known, terms, ["doc_type"]), ["doc_type"], pool=7)
    columns = ["query_id", "chunk_id", "doc_type", "vrank", "trank", "rrf", "rank"]
    by = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(tuple, got.select(columns).collect()), key=by) == sorted(map(tuple, want.select(columns).collect()), key=by)


def joins_on_terms(query, spark, sf_dir):
    from feldspar.plans import registry

    plan = registry.queries()[query](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if "Join" in line and "term#" in line]


def test_pools_make_no_pairs_of_questions_and_words(spark, sf_dir):
    assert joins_on_terms("h06_pools", spark, sf_dir) == []


def test_pool_and_floor_read_their_candidates_once(spark, sf_dir):
    rows = spark.createDataFrame([(q, c, f"s{c % 4}", ((c * 7 + q) % 11) / 100) for q in range(3) for c in range(40)], "query_id bigint, chunk_id bigint, doc_type string, rrf double")
    top = rows.orderBy("query_id", F.desc("rrf"), "chunk_id").collect()
    pooled = spark.createDataFrame([r for q in range(3) for r in [x for x in top if x.query_id == q][:5]], rows.schema)
    assert sorted(map(tuple, search.pool_with_floor(rows, "doc_type", 5, 2).collect())) == sorted(map(tuple, search.with_floor(pooled, rows, "doc_type", 2).collect()))
    assert joins_on_terms("h07_floor", spark, sf_dir) == []


def test_merged_pools_make_no_pairs_of_questions_and_words(spark, sf_dir):
    assert joins_on_terms("h09_merge_cap", spark, sf_dir) == []


def test_arms_without_a_source_make_no_pairs(spark, sf_dir):
    assert joins_on_terms("t09_arms_and_sabotage", spark, sf_dir) == []


def test_explained_pools_make_no_pairs(spark, sf_dir):
    assert joins_on_terms("t20_explained_items", spark, sf_dir) == []
