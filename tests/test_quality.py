"""Recognisers with check digits and context, de-identification against a manifest, payload health, hits of arms."""

from pyspark.sql import functions as F

from feldspar.operators import deid, health


def found(spark, text):
    row = spark.createDataFrame([(text,)], "text string").select(deid.resolve(deid.recognised(F.col("text"))).alias("s")).first()
    return sorted((s.type, text[s.start : s.stop], round(s.score, 2)) for s in row.s)


def test_recognisers(spark):
    body = "04821733"
    total = sum(d if i % 2 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(map(int, reversed(body))))
    good, bad = body + str(-total % 10), body + str((1 - total) % 10)
    assert found(spark, f"Member M {good[:3]}-{good[3:6]}-{good[6:]} or M{bad}") == [("MEMBER_ID", f"M {good[:3]}-{good[3:6]}-{good[6:]}", 1.0)]
    assert found(spark, f"{good} and {bad}") == [("MEMBER_ID", good, 1.0)]
    assert found(spark, "mrn# 4408125") == [("MRN", "mrn# 4408125", 0.8)]
    assert found(spark, "medical record MRN 4408125") == [("MRN", "MRN 4408125", 1.0)]
    assert found(spark, "on 2/11/24, 2024-02-11") == [("DATE_TIME", "2/11/24", 0.6), ("DATE_TIME", "2024-02-11", 0.6)]
    assert found(spark, "fax 555-123-4567") == [("PHONE_NUMBER", "555-123-4567", 0.85)]
    assert found(spark, "fax one two three four five 555-123-4567") == [("PHONE_NUMBER", "555-123-4567", 0.5)]
    assert found(spark, "") == [] and found(spark, "é日本 no entities") == []


def test_recall_leakage_and_needless_replacements(spark):
    docs = spark.createDataFrame([(1, "a", "call 555-123-4567 or MRN 4408125"), (2, "a", "paid 555-000-1111"), (3, "b", None)], "doc_id int, source string, text string")
    rows = docs.withColumn("spans", deid.resolve(deid.recognised(F.col("text")))).withColumn("stored", deid.masked(F.col("text"), F.col("spans")))
    manifest = spark.createDataFrame([(1, "PHONE_NUMBER", "555-123-4567", "5551234567"), (1, "CLAIM_ID", "MRN 4408125", "MRN4408125"), (2, "NAME", "paid", "paid"), (9, "NAME", "x", "x")], "doc_id int, entity string, surface string, canonical string")
    got = {(r.source, r.entity): (r.n, r.found, r.leaked) for r in deid.evaluate(rows, manifest).collect()}
    assert got == {("a", "PHONE_NUMBER"): (1, 1, 0), ("a", "CLAIM_ID"): (1, 0, 0), ("a", "NAME"): (1, 0, 1), (None, "NAME"): (1, 0, 0)}
    over = {r.source: (r.applied, r.needless) for r in deid.over_redaction(rows.where("text is not null"), manifest).collect()}
    assert over == {"a": (3, 1)}


def test_payload_health(spark):
    chunk = lambda t, s, text="x", section=None, pages="1": (t, pages, text, section, s)
    rows = [
        (1, [chunk("a", 0.9), chunk("a", 0.9), chunk("b", 0.898)], [("doc_probe", None, ["x", "y"]), ("doc_probe", None, ["y", "x"])]),
        (2, [chunk("a", 0.9, "Do not rely  on this page"), chunk("b", 0.2, section="Table of Contents"), chunk("c", None)], [("member_query", "q", None), ("member_query", "p", None)]),
        (3, [], [("doc_probe", None, None)]),
        (4, None, None),
    ]
    table = spark.createDataFrame(rows, f"payload_id int, chunks {health.CHUNKS}, legs {health.LEGS}")
    got = {r.payload_id: tuple(r)[1:] for r in health.payload_health(table).collect()}
    assert got == {1: (0.002, True, 3, 1, 0, 2, True), 2: (0.7, False, 3, 0, 2, 2, False), 3: (None, None, 0, 0, 0, 1, False), 4: (None, None, 0, 0, 0, 0, False)}
    assert tuple(health.health_summary(health.payload_health(table)).first()) == (0.5, 0.167, 0.333, 0.5, 4)
    assert tuple(health.health_summary(health.payload_health(table.limit(0))).first()) == (None, None, None, None, 0)


def test_hits_of_arms(spark):
    ranked = spark.createDataFrame([("v", 1, 1, 1), ("v", 2, 9, 1), ("v", 2, 2, 6), ("l", 2, 2, 5), ("l", 2, 2, 5)], "arm string, query_id int, chunk_id int, rank int")
    wanted = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "query_id int, chunk_id int")
    assert {tuple(r) for r in health.hits_at(ranked, wanted, 5).collect()} == {("v", 3, 1), ("l", 3, 1)}


def test_drift_and_corpus_hash(spark):
    import hashlib

    from feldspar.operators import evaluation

    rows = lambda *vs: spark.createDataFrame(list(enumerate(vs)), "key bigint, vector array<float>")
    same = evaluation.drift(rows([1.0, 0.0], [0.0, 1.0]), rows([2.0, 0.0], [0.0, 2.0], None)).first()
    assert same.sample_size == 2 and same.norm_mean == 2.0 and abs(same.centroid_shift) < 1e-12 and not same.alert
    assert abs(evaluation.drift(rows([1.0, 0.0]), rows([0.0, 1.0])).first().centroid_shift - 1) < 1e-12
    for before in (rows(), rows([0.0, 0.0])):
        row = evaluation.drift(before, rows([0.0, 1.0])).first()
        assert row.centroid_shift is None and not row.alert
    few = evaluation.drift(rows(*[[float(i), 1.0] for i in range(30)]), rows(*[[float(i), 1.0] for i in range(30)]), sample=5).first()
    assert few.sample_size == 5 and abs(few.centroid_shift) < 1e-12
    docs = spark.createDataFrame([(i, f"h{i}") for i in range(30)], "id bigint, content_hash string")
    nodes = {i: f"h{i}" for i in range(30)}
    for _ in range(3):
        nodes = {j: hashlib.sha256(",".join(nodes[i] for i in sorted(nodes) if i // 4 == j).encode()).hexdigest() for j in {i // 4 for i in nodes}}
    assert [r.corpus_hash for r in evaluation.corpus_hash(docs.repartition(3), 3, 4).collect()] == list(nodes.values())
    assert evaluation.corpus_hash(docs.limit(0)).count() == 0


def test_metadata_and_csv_elements(spark, tmp_path):
    from feldspar.operators import ingest

    stored = spark.createDataFrame([(1, "a", None, 5), (2, None, "x", 6), (3, "c", "y", 7)], "k int, m string, n string, other int")
    fresh = spark.createDataFrame([(1, "a", None), (2, "b", None), (4, "d", "d")], "k int, m string, n string")
    assert sorted(map(tuple, ingest.refresh_metadata(stored, fresh, "k", ["m", "n"]).collect())) == [(1, "a", None, 5, False), (2, "b", None, 6, True), (3, "c", "y", 7, False)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "t.csv").write_text('a,b c,d\n1,"x, ""y""",\n,,\n2,"two\nlines",z\n')
    got = [(r.category, r.text) for r in ingest.csv_elements(spark, str(tmp_path / "in")).collect()]
    assert got == [("title", "Columns: a, b c, d"), ("text", 'a: 1; b c: x, "y"'), ("text", "a: 2; b c: two\nlines; d: z")]
    ingest.write_partitioned(stored, f"{tmp_path}/out", "k")
    ingest.write_partitioned(stored.where("k = 1"), f"{tmp_path}/out", "k")
    assert spark.read.parquet(f"{tmp_path}/out").groupBy("k").count().where("k = 1").first()["count"] == 2
