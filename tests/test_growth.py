"""Steps whose shuffles, memory or work must grow no faster than the input."""

import re

import pyarrow as pa
from pyspark.sql import functions as F

from feldspar.operators import checks, health
from feldspar.plans import registry


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_arms_are_read_once(spark):
    ranked = spark.createDataFrame([("v", 1, 1, 1), ("v", 2, 2, 6), ("l", 1, 3, 5), ("l", 2, 2, 9)], "arm string, query_id int, chunk_id int, rank int")
    wanted = spark.createDataFrame([(1, 1), (2, 2)], "query_id int, chunk_id int")
    made = health.hits_at(ranked.withColumn("rank", F.col("rank") + F.lit(0)), wanted, 5)
    assert optimized(made).count("arm#") and optimized(made).count("LogicalRDD [arm#") == 1
    assert {tuple(r) for r in made.collect()} == {("v", 2, 1), ("l", 2, 0)}


def test_payloads_deal_lines_once(spark, sf_dir):
    assert executed(registry.queries()["t08_payload_health"](spark, sf_dir)).count("Exchange hashpartitioning") == 1


def test_best_scores_of_many_alike_chunks(spark):
    chunk = lambda t, s: (t, None, "x", None, s)
    rows = [(1, [chunk("a", 0.5), chunk("a", 0.9), chunk("b", 0.9), chunk("c", -1.0)], None), (2, [chunk("a", 0.3), chunk("a", 0.4)], None), (3, [chunk("a", None), chunk("b", -2.0)], None)]
    table = spark.createDataFrame(rows, f"payload_id int, chunks {health.CHUNKS}, legs {health.LEGS}")
    got = {r.payload_id: (r.top_gap, r.tie, r.duplicates) for r in health.payload_health(table).collect()}
    assert got == {1: (0.0, True, 1), 2: (None, None, 1), 3: (0.0, True, 0)}


def test_rules_meet_payloads_as_lists(spark, sf_dir):
    plan = executed(registry.queries()["t02_declared_checks"](spark, sf_dir))
    assert plan.index("Generate explode") < plan.index("Join")  # rules are parted after they met
    assert plan.count("Exchange hashpartitioning") == 2  # the keys, and the lines


def test_rules_of_one_check_are_counted_together(spark):
    payloads = spark.createDataFrame([(1, "ok", [2024], None, None, None, True, None, [("q", {"n": "nan", "v": "a"})], None)], checks.PAYLOAD)
    rules = [(1, "expect_status", None, ["ok"], None), (1, "expect_status", None, ["no"], None), (1, "expect_status", None, ["nay"], None), (1, "expected_rows", "q", ["v=A"], 1), (2, "allow", None, None, None)]
    got = {(r.item_id, r.check): (r.verdict, r.failed) for r in checks.run_checks(payloads, spark.createDataFrame(rules, checks.RULE)).collect()}
    assert got == {(1, "expect_status"): ("fail", 2), (1, "expected_rows"): ("pass", 0), (2, "allow"): ("skipped", 0)}


def test_newest_lines_are_dealt_in_a_stated_number(spark, sf_dir, tmp_path):
    plan = executed(registry.queries()["l06_newest_per_patient"](spark, sf_dir))
    assert plan.count("REPARTITION_BY_NUM") == 2 and "dense_rank" in plan  # equal rows have one place; none are kept to compare
    lines = [(k, f"2024-01-{d:02}") for k in (1, 2, 3) for d in (1, 2, 2, 2)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_shipdate string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "o_orderkey bigint, o_custkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    got = registry.queries()["l06_newest_per_patient"](spark, str(tmp_path)).collect()
    assert sorted((r.member_id, r.claim_id, r.service_date.day, r.r) for r in got) == [(7, 1, 1, 3), (7, 1, 2, 1), (7, 2, 1, 4), (7, 2, 2, 2), (8, 3, 1, 2), (8, 3, 2, 1)]


def test_planted_entities_travel_with_their_text(spark, sf_dir):
    assert "Join" not in optimized(registry.queries()["f09_deid_recall"](spark, sf_dir))


def test_shingles_of_one_set_are_sent_once(spark, monkeypatch):
    from feldspar.operators import near

    kept = []
    monkeypatch.setattr(near, "cut", lambda df: kept.append(df) or df)
    sets = spark.createDataFrame([(1, [1, 2, 3, 4, 5]), (2, [1, 2, 3, 4, 6]), (3, [1, 7]), (4, [8, 9]), (5, [1, 2, 3, 4, 5, 10])], "doc_id bigint, s array<bigint>")
    assert sorted(map(tuple, near.alike(sets, 0.6).collect())) == [(1, 2), (1, 5)]
    assert "LeftOuter" not in optimized(kept[0])


def test_shingles_are_those_of_every_document(spark, monkeypatch):
    from feldspar.operators import near

    monkeypatch.setattr(near, "BYTES_AT_ONCE", 9)  # batches are cut between documents
    rows = [(1, "a b c d"), (2, "A, b; c d!"), (3, "a b"), (4, None), (5, "a b c a b c a"), (6, "c b a d"), (7, "x y z " * 9), (8, "ab c d"), (9, "a bc d")]
    got = {r.doc_id: (r.s, r.key) for r in near.shingle_sets(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)).collect()}
    assert {k: len(s) for k, (s, _) in got.items()} == {1: 2, 2: 2, 5: 3, 6: 2, 7: 3, 8: 1, 9: 1}
    assert got[1] == got[2] and set(got[1][0]) & set(got[5][0]) and all(s == sorted(s) for s, _ in got.values())
    assert len({key for _, key in got.values()}) == 6
    assert len({v for s, _ in got.values() for v in s}) == 11  # two copies share two, and 1 and 5 one


def test_shingles_are_not_made_word_by_word(spark):
    from feldspar.operators import near

    from feldspar.operators.search import tokens

    texts = ["", "Ünï 1a2-b", "a", "b c", "É", "x" * 40 + " ab", "abc", "\u212aelvin \u0130x", "ab c", "a bc"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", F.lower("t").alias("t"), tokens(F.col("t")).alias("w")).orderBy("i").collect()
    h, doc = near._words(pa.array([r.t for r in df]))
    words = [(w, r.i) for r in df for w in r.w]
    assert doc.tolist() == [i for _, i in words] and len(set(h.tolist())) == len({w for w, _ in words})
    assert len(set(zip(h.tolist(), [w for w, _ in words], strict=True))) == len({w for w, _ in words})
    assert "lambdafunction" not in optimized(near.shingle_sets(spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")))


def test_scores_of_a_block_are_one_table():
    import tracemalloc

    import numpy as np

    from feldspar.operators import search

    def table(n, name):
        return pa.table({name: pa.array(np.arange(n)), "vector": pa.ListArray.from_arrays(pa.array(np.arange(0, 4 * n + 1, 4, dtype=np.int32)), pa.array(np.random.default_rng(1).standard_normal(4 * n).astype(np.float32)))})

    chunks, queries = table(8192, "chunk_id"), table(256, "query_id")
    tracemalloc.start()
    told = list(search._meet(chunks, queries, search._by_vector(queries), [], search._tell([], 10)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(told) == 1 and peak < 2 * 8192 * 256 * 8


def test_pools_are_explained_without_their_texts(spark, sf_dir):
    made = registry.queries()["t20_explained_items"](spark, sf_dir)
    whole = [line for line in optimized(made).splitlines() if "Project" in line and re.search(r"\btext#", line) and "substring(text#" not in line and "regexp_extract_all(" not in line]
    assert whole == []  # a text leaves its scan as what is shown


def test_texts_of_the_best_alone(spark):
    from feldspar.operators import runs

    pool = spark.createDataFrame([(1, 10, "t", "s", 2024, 2, 0.5), (1, 11, "t", "s", 2024, 1, 0.1), (2, 12, "u", "s", 2024, 1, 0.9), (2, 13, "t", "s", 2024, 2, 0.9)], "query_id int, chunk_id int, title string, doc_type string, year int, pool_rank int, score double")
    texts = spark.createDataFrame([(10, "abcdef"), (11, "ghi"), (12, "jkl")], "chunk_id int, text string")  # the best of 2 has none
    expected = spark.createDataFrame([(q, i, t, None, None) for q in (1, 2, 3) for i, t in ((1, "t"), (2, "none"))], "query_id int, spec_id int, title string, doc_type string, year int")
    got = sorted(map(tuple, runs.explained(runs.reranked(pool), expected, 3, texts).collect()))
    assert got == sorted(map(tuple, runs.explained(runs.reranked(pool.join(texts, "chunk_id", "left")), expected, 3).collect()))
    assert got[0] == (1, 1, True, 1, 1, 0.5, "abc") and got[2] == (2, 1, True, 2, 2, 0.9, None) and got[4] == (3, 1, False, None, None, None, None)
