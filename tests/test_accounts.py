"""Re-identification, translated questions, released spans, recorded runs, explained items and readings of questions."""

import random
import re

from pyspark.sql import functions as F

from feldspar.operators import reading, reidentify, runs

VAULT = "entity string, original string, pseudonym string"


def test_reidentified_texts(spark):
    docs = spark.createDataFrame([(1, "a [MEMBER_ID-0001], [MEMBER_ID-0001] and [X-1]", "k"), (1, "again [PERSON-0002][PERSON-9999]", None), (2, None, "k"), (3, "", "k"), (None, "[PERSON-0002]", "k"), (4, "[sic] plain", "k")], "doc_id int, text string, original string")
    vault = spark.createDataFrame([("MEMBER_ID", "M$1\\", "[MEMBER_ID-0001]"), ("MEMBER_ID", "M2", "[MEMBER_ID-0001]"), ("PERSON", "Ann [X]", "[PERSON-0002]"), ("PERSON", None, "[PERSON-9999]"), ("PERSON", "x", None)], VAULT)
    got = reidentify.reidentified(docs, vault)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, "a M$1\\, M$1\\ and [X-1]"), (1, "again Ann [X][PERSON-9999]"), (2, None), (3, ""), (None, "[PERSON-0002]"), (4, "[sic] plain")], key=str)
    assert reidentify.reidentified(docs.limit(0), vault).count() == 0 and reidentify.reidentified(docs, vault.limit(0)).count() == 6


def plain_translation(question, persona, vault):
    types = set(reidentify.IDENTIFIER_TYPES) | (set(reidentify.NAMED_TYPES) if persona in reidentify.ENTITLED else set())
    rows = sorted({(o, p) for e, o, p in vault if e in types and o and len(o) >= 4}, key=lambda v: (-len(v[0]), v[0]))
    for original, pseudonym in rows:
        question = re.sub(rf"(?<!\w){re.escape(original)}(?!\w)", lambda _: pseudonym, question, flags=re.IGNORECASE)
    return question


def test_translated_questions_equal_a_search_of_the_whole_vault(spark):
    draw = random.Random(7)
    first, last = ["Ann", "Bo", "Søren", "Ann-Marie"], ["Lee", "O'Neil", "Ruiz", "Łuk"]
    vault = [("PERSON", f"{f} {x}", f"[PERSON-{i}0{j}]") for i, f in enumerate(first, 10) for j, x in enumerate(last)]
    vault += [("PERSON", "Lee", "[PERSON-0001]"), ("US_SSN", "123-45-6789", "[US_SSN-0001]"), ("PHONE_NUMBER", "(555) 123-4567", "[PHONE_NUMBER-0001]"), ("MRN", "MRN4408125", "[MRN-0001]"), ("DATE_TIME", "2026", "[DATE_TIME-0001]"), ("LOCATION", "Springfield", "[LOCATION-0001]"), ("ID", "a.b*c", "[ID-0001]"), ("ID", "....", "[ID-0002]"), ("ID", None, "[ID-0003]")]
    parts = [f"{f} {x}" for f in first for x in last] + ["ANN LEE", "ann  lee", "Lee", "123-45-6789", "123 45 6789", "(555) 123-4567", "mrn 4408125", "2026", "Springfield", "A.B*C", "aab*c", "....", "Annx Lee", "?", "of"]
    asked = [(i, ", ".join(draw.choices(parts, k=draw.randint(1, 6))), draw.choice(["admin", "care_team", "appeals", None])) for i in range(120)] + [(200, "", "admin"), (201, None, "admin"), (202, "?!", "admin")]
    table = spark.createDataFrame(asked, "question_id int, question string, persona string")
    rewritten = {r.question_id: r.q for r in table.select("question_id", reidentify.rewrite_identifiers(F.col("question")).alias("q")).collect()}
    searched = [v for v in vault if v[1] != "...."]  # an original without a word isn't found by words
    want = {i: None if q is None else plain_translation(rewritten[i], p, searched) for i, q, p in asked}
    got = {r.question_id: r.translated for r in reidentify.translated_questions(table, spark.createDataFrame(vault, VAULT)).collect()}
    assert got == want
    assert {r.question_id: r.translated for r in reidentify.translated_questions(table, spark.createDataFrame([], VAULT)).collect()} == rewritten


def test_spans_that_protect_nothing(spark):
    said = [("DATE_TIME", "Sept. 3rd", True), ("DATE_TIME", "3 sep 2024", True), ("DATE_TIME", "may", False), ("DATE_TIME", "2024", False), ("DATE_TIME", "02.11", True), ("PERSON", "Prior Auth", False), ("PERSON", "Prior Ann", True), ("NRP", "42", True), ("MRN", "prior", True)]
    rows = spark.createDataFrame([(i, t, kind) for i, (kind, t, _) in enumerate(said)], "i int, text string, kind string")
    span = F.struct(F.col("kind").alias("type"), F.lit(0).alias("start"), F.length("text").alias("stop"), F.lit(0.5).alias("score"))
    got = rows.select("i", F.size(reidentify.protecting(F.array(span), F.col("text"), ("prior", "auth"))).alias("n"), F.size(reidentify.protecting(F.array(span), F.col("text"), ())).alias("all")).collect()
    assert {r.i: r.n == 1 for r in got} == {i: worth for i, (_, _, worth) in enumerate(said)}
    assert [r.i for r in got if r["all"] == 0] == [2, 3]


def test_runs_are_replaced_and_read_beside_their_scores(spark, tmp_path):
    path = f"{tmp_path}/runs"
    table = lambda *ids: spark.createDataFrame([(i, f"run {i}") for i in ids], "run_id int, label string")
    scores = lambda *rows: spark.createDataFrame(list(rows), "run_id int, question_id string, metric string, value int, weight int")
    runs.record(path, table(1, 2, 3), scores((1, "a", "hit", 0, 1), (2, "a", "hit", 1, 1)))
    runs.record(path, table(1), scores((1, "a", "hit", 1, 3), (1, "b", "hit", 0, 1), (1, "c", "hit", None, 9), (1, "a", "seen", 1, 0)))
    got = sorted((r.run_id, r.label, r.metric, r.n, r.mean, r.weighted) for r in runs.trend(spark, path).collect() if r.metric)
    assert got == [(1, "run 1", "hit", 2, 0.5, 0.75), (1, "run 1", "seen", 1, 1.0, None), (2, "run 2", "hit", 1, 1.0, 1.0)]
    assert [(r.run_id, r.n, r.mean) for r in runs.trend(spark, path).where("metric is null").collect()] == [(3, 0, None)]
    assert [tuple(r) for r in runs.most_common(scores((1, "b", "x", 1, 1), (1, "a", "x", 1, 1), (2, "c", "y", 1, 1)), ["run_id", "metric"], 1).collect()] == [(1, "x", 2)]


def test_explained_items(spark):
    pool = spark.createDataFrame([(1, 10, "plan A 2024", "s1", 2024, 3, 0.2, "t" * 500), (1, 11, "plan A 2025", "s1", 2025, 1, 0.1, "short"), (1, 12, "plan B", "s2", None, 2, None, None), (2, 10, "plan A 2024", "s1", 2024, 1, 0.9, "x")], "query_id int, chunk_id int, title string, doc_type string, year int, pool_rank int, score double, text string")
    specs = spark.createDataFrame([(1, 1, "plan A", None, None), (1, 2, None, "s2", None), (1, 3, None, "s2", 2024), (1, 4, None, None, None), (2, 1, "plan A", "s1", 2024), (3, 1, "plan A", None, None)], "query_id int, spec_id int, title string, doc_type string, year int")
    got = {(r.query_id, r.spec_id): (r.in_pool, r.pool_rank, r.position, r.score, r.scored_text) for r in runs.explained(runs.reranked(pool), specs).collect()}
    lost = (False, None, None, None, None)
    assert got == {(1, 1): (True, 1, 1, 0.2, "t" * 400), (1, 2): (True, 2, 3, None, None), (1, 3): lost, (1, 4): lost, (2, 1): (True, 1, 1, 0.9, "x"), (3, 1): lost}


def test_readings(spark):
    q = ["high and standard option", "standard plan", "a high price", "Basic", "basic plus", "Basic Plus or Basic?", None, ""]
    rows = spark.createDataFrame(list(enumerate(q)), "i int, q string")
    options = reading.asked_options(F.col("q"), ("Basic", "Basic Plus", "High", "Standard"), ("High", "Standard"), (("High", "Standard"),))
    assert [r.o for r in rows.orderBy("i").select(options.alias("o")).collect()] == [["High", "Standard"], ["Standard"], [], ["Basic"], ["Basic Plus"], ["Basic", "Basic Plus"], [], []]
    years = [("in 2024, and 2019 (2019)?", [2019, 2024]), ("$2024 or 2,024 or 12024 or 2024.50 or 1999", []), ("2025.", [2025]), ("", [])]
    table = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(years)], "i int, q string")
    assert [r.y for r in table.orderBy("i").select(reading.said_years(F.col("q")).alias("y")).collect()] == [y for _, y in years]
    scope = reading.boundary(F.col("q"), "Own", ("Other Co",), 2021, 2026)
    table = spark.createDataFrame([(0, "other co in 2019"), (1, "Other Co against own"), (2, None), (3, "medicare penalty"), (4, "2020")], "i int, q string")
    assert [r.s for r in table.orderBy("i").select(scope["scope"].alias("s")).collect()] == ["other_carrier", "in_scope", "in_scope", "medicare_program", "out_of_year"]


def test_identities_and_served_requests(spark):
    from feldspar.operators import identity

    users = spark.createDataFrame([(1,), (2,), (3,)], "user_id int")
    members = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, "zz"), (2, None), (9, "a")], "user_id int, group string")
    groups = spark.createDataFrame([("a", "admin"), ("b", "care_team"), (None, "x")], "group string, persona string")
    known = identity.identities(users, members, groups)
    assert sorted(map(tuple, known.collect())) == [(1, "a", "admin"), (2, None, None), (3, None, None)]
    grants = spark.createDataFrame([("ask", "a", "m2"), ("ask", "a", "m1")], "surface string, group string, module string")
    asked = spark.createDataFrame([(1, 1, "ask", None), (2, 1, "desk", []), (3, 2, "ask", ["question"]), (4, 8, "ask", ["question"]), (5, None, "ask", ["Persona"]), (6, 1, None, None)], "request_id int, user_id int, surface string, fields array<string>")
    got = sorted(map(tuple, identity.served(asked, known, grants).collect()))
    assert got == [(1, 200, "m1", "admin"), (2, 403, None, None), (3, 403, None, None), (4, 401, None, None), (5, 400, None, None), (6, 403, None, None)]


def test_metadata_json(spark):
    from feldspar.operators import identity

    rows = spark.createDataFrame([(1, 'a "b"\n', [1, 2]), (2, None, None)], "k int, t string, l array<int>")
    got = identity.chunk_rows(rows, ["k"], {"t": F.col("t"), "l": F.col("l")}).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, '{"t":"a \\"b\\"\\n","l":[1,2]}'), (2, "{}")]
