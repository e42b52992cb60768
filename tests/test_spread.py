"""Steps of searches that tell, send and make little, and rank as before."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from feldspar.operators import search
from feldspar.plans import registry


def table(n, name, groups=1, seed=1):
    vectors = pa.array(np.random.default_rng(seed).standard_normal(4 * n).astype(np.float32))
    return pa.table({name: pa.array(np.arange(n)), "vector": pa.ListArray.from_arrays(pa.array(np.arange(0, 4 * n + 1, 4, dtype=np.int32)), vectors), "doc_type": pa.array([f"s{i % groups}" for i in range(n)])})


def test_merged_pools_are_dealt_by_question_alone(spark, sf_dir):
    plan = registry.queries()["h09_merge_cap"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(query_id#\d+L?, (reading|chunk_id)", plan)


def test_pairs_meet_in_single_precision_and_are_ranked_in_double(spark, monkeypatch):
    chunks, queries = table(50, "chunk_id"), table(3, "query_id")
    assert search._by_vector(queries)(chunks)[1](queries).z.dtype == np.float32
    monkeypatch.setattr(search, "CHUNK_BLOCK", 16)
    rng = np.random.default_rng(4)
    base = rng.standard_normal(8)
    rows = [(i, f"s{i % 2}", [float(x) for x in base + rng.standard_normal(8) * 10.0 ** -rng.integers(2, 5)]) for i in range(300)]  # many cosines are a few millionths apart
    rows += [(300, "s0", [0.0] * 8), (301, "s1", [float("nan")] * 8), (302, "s0", [1e200] * 8), (303, None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "chunk_id bigint, doc_type string, vector array<double>").repartition(3)
    got = search.vector_arm(df.where("chunk_id <> 302"), spark.createDataFrame([(7, [float(x) for x in base])], "query_id bigint, vector array<double>"), ["doc_type"], 40)
    cosine = lambda v: round(float(np.dot(v, base) / np.sqrt(np.dot(v, v)) / np.sqrt(np.dot(base, base))), 6)
    want = []
    for g in ("s0", "s1", None):
        own = sorted((-cosine(np.array(v)), i) for i, t, v in rows if t == g and i not in (300, 301, 302))[:40]
        want += [(7, i, g, -s, r) for r, (s, i) in enumerate(own, 1)]
    assert {(r.query_id, r.chunk_id, r.doc_type, r.similarity, r.vrank) for r in got.collect()} == set(want)
    far = search.vector_arm(df, spark.createDataFrame([(7, [1.0] * 8)], "query_id bigint, vector array<double>"), [], 400).where("chunk_id = 302").collect()
    assert [r.similarity for r in far] == [0.0]  # its length is past the largest number, as before


def test_asked_terms_are_counted_in_arrow(spark, monkeypatch):
    texts = [(0, "a", "The cat, the CAT; ünder the-cat 7x"), (1, "a", None), (2, "b", ""), (3, None, "Kelvin cat" * 3), (4, "b", "none"), (5, "b", "cat")]
    df = spark.createDataFrame(texts, "chunk_id bigint, doc_type string, content string")
    words = {r.chunk_id: r.w for r in df.select("chunk_id", search.tokens(F.col("content")).alias("w")).collect()}
    monkeypatch.setattr(search, "tokens", lambda text: pytest.fail("words are rows"))
    asked = ["7x", "cat", "kelvin", "nder", "the"]
    got = search.asked_terms(df, pa.array(asked), ["doc_type"]).collect()
    assert {r.chunk_id: (r.length, dict(zip(r.terms, r.tfs, strict=True))) for r in got} == {i: (None if w is None else len(w), {k: w.count(t) for k, t in enumerate(asked) if w and t in w}) for i, w in words.items()}
def test_scores_are_told_by_tile_and_group():
    chunks, queries = table(4000, "chunk_id", 2), table(300, "query_id")
    told = list(search._meet(chunks, queries, search._by_vector(queries), ["doc_type"], search._tell(["doc_type"], 20)))
    assert sum(t.num_rows for t in told) == 2 * -(-300 // search.QUERY_TILE)
