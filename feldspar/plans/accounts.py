"""Queries of re-identification by entitlement, released spans, recorded runs, explained items, what questions say, who is
served, and what is stored beside a chunk."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions.lineage import fresh_folder
from ..operators import identity, ingest, reading, reidentify, runs, search
from . import adapters as a
from .lookup import DIGITS, spoken
from .registry import query
from .retrieval import HYBRID, HYBRID_TERMS, POSTINGS, query_vectors, question_terms


def _token(kind: str, number):
    """A pseudonym of six digits and more."""
    return F.concat(F.lit(f"[{kind}-"), (number + 100000).cast("string"), F.lit("]"))


@query(
    "f10_reidentified",
    f"""WITH {DIGITS}, c AS (SELECT doc_id AS j, 'CLM-' || c10 AS o FROM i WHERE doc_id % 3 > 0),
    t AS (SELECT doc_id, text, CASE WHEN wrong = 0 THEN 'M' || m9 ELSE '[MEMBER_ID-' || 100000 + doc_id || ']' END AS m, coalesce(o, '[CLAIM_ID-' || 100000 + doc_id % 7 || ']') AS o FROM i LEFT JOIN c ON doc_id % 7 = j)
    SELECT doc_id, md5('About ' || m || ' and ' || o || ', [sic] of ' || m || '. ' || coalesce(text, '')) AS text_md5 FROM t""",
)
def f10(spark, d):
    """Pseudonyms before every whole text as their originals: one a document, and seven that all documents share."""
    k, rows = F.col("doc_id"), spoken(spark, d).select("doc_id", "m9", "c10")
    members = rows.where(k % 5 > 0).select(F.lit("MEMBER_ID").alias("entity"), F.concat(F.lit("M"), "m9").alias("original"), _token("MEMBER_ID", k).alias("pseudonym"))
    claims = rows.where(k % 3 > 0).select(F.lit("CLAIM_ID").alias("entity"), F.concat(F.lit("CLM-"), "c10").alias("original"), _token("CLAIM_ID", k).alias("pseudonym"))
    m, c = _token("MEMBER_ID", k), _token("CLAIM_ID", k % 7)
    text = F.concat(F.lit("About "), m, F.lit(" and "), c, F.lit(", [sic] of "), m, F.lit(". "), F.coalesce("text", F.lit("")))
    docs = a.table(spark, d, "documents").select("doc_id", text.alias("text"))
    return reidentify.reidentified(docs, members.unionByName(claims)).select("doc_id", F.md5("text").alias("text_md5"))


PERSONAS = ["admin", "care_team", "member_services", "appeals"]


@query(
    "s11_translated_questions",
    f"""WITH {DIGITS}, names AS (SELECT doc_id % 97 AS x, doc_id % 211 AS y, min(100000 + doc_id) AS n FROM i WHERE doc_id % 3 > 0 GROUP BY ALL)
    SELECT doc_id AS question_id, 'Was ' || CASE WHEN wrong = 1 THEN 'clm ' || c10 WHEN doc_id % 7 > 0 THEN '[CLAIM_ID-' || 100000 + doc_id || ']' ELSE 'CLM-' || c10 END || ' of '
      || CASE WHEN doc_id % 4 < 2 AND n IS NOT NULL THEN '[PERSON-' || n || ']' ELSE 'first' || doc_id % 97 || ' LAST' || doc_id % 211 END || ' ('
      || CASE WHEN wrong = 0 THEN '[MEMBER_ID-' || 100000 + doc_id || ']' ELSE 'M ' || m9[1:3] || '-' || m9[4:6] || '-' || m9[7:9] END || ') paid in 2026?' AS translated
    FROM i LEFT JOIN names ON doc_id % 97 = x AND doc_id % 211 = y""",
)
def s11(spark, d):
    """A question for every document: identifiers for every persona, names for entitled ones; a date translates for nobody."""
    k, rows = F.col("doc_id"), spoken(spark, d).select("doc_id", "m9", "c10")
    entry = lambda kind, original: F.struct(F.lit(kind).alias("entity"), original.alias("original"), _token(kind, k).alias("pseudonym"))
    right = k % 5 > 0
    entries = F.array(
        F.when(right & (k % 7 > 0), entry("CLAIM_ID", F.concat(F.lit("CLM-"), "c10"))),
        F.when(right, entry("MEMBER_ID", F.concat(F.lit("M"), "m9"))),
        F.when(k % 3 > 0, entry("PERSON", F.concat(F.lit("First"), k % 97, F.lit(" Last"), k % 211))),
        entry("DATE_TIME", F.lit("2026")),
    )
    vault = rows.select(F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e")).select("e.*")
    grouped = F.concat(F.lit("M "), F.substring("m9", 1, 3), F.lit("-"), F.substring("m9", 4, 3), F.lit("-"), F.substring("m9", 7, 3))
    said = F.concat(F.lit("Was clm "), "c10", F.lit(" of first"), k % 97, F.lit(" LAST"), k % 211, F.lit(" ("), grouped, F.lit(") paid in 2026?"))
    return reidentify.translated_questions(rows.select(k.alias("question_id"), said.alias("question"), a.pick(PERSONAS, k % 4).alias("persona")), vault)


DATES, DATES_KEPT = ["30 day", "Feb 11 2024", "last week", "2026", "11th february", "2/11/24", "March, 2021", "6 months", "2024-02-11"], (1, 4, 5, 6, 8)
PLACES, PLACES_KEPT = ["PA", "Springfield", "Prior Auth", "CP-0005", "PA Springfield", "123"], (1, 4, 5)


@query(
    "f04_released_spans",
    f"SELECT doc_id, concat_ws(',', CASE WHEN doc_id % {len(DATES)} IN {DATES_KEPT} THEN 'DATE_TIME' END, CASE WHEN doc_id % {len(PLACES)} IN {PLACES_KEPT} THEN 'LOCATION' END, 'MRN') AS kept FROM documents",
)
def f04(spark, d):
    """Spans of dates, places and records before every whole text; the ones that protect nothing are released."""
    k = F.col("doc_id")
    date, place = a.pick(DATES, k % len(DATES)), a.pick(PLACES, k % len(PLACES))
    text = F.concat(date, F.lit(" near "), place, F.lit(" MRN. "), F.coalesce("text", F.lit("")))
    at = F.length(date) + 6
    span = lambda kind, start, stop: F.struct(F.lit(kind).alias("type"), start.cast("int").alias("start"), stop.cast("int").alias("stop"), F.lit(0.6).alias("score"))
    found = F.array(span("DATE_TIME", F.lit(0), F.length(date)), span("LOCATION", at, at + F.length(place)), span("MRN", at + F.length(place) + 1, at + F.length(place) + 4))
    rows = a.table(spark, d, "documents").select("doc_id", text.alias("text"), found.alias("found"))
    kept = reidentify.protecting(F.col("found"), F.col("text"), ("pa", "prior", "auth", "cp"))
    return rows.select("doc_id", F.array_join(F.transform(kept, lambda s: s["type"]), ",").alias("kept"))


@query(
    "b04_recorded_runs",
    """WITH s AS (SELECT year(l_shipdate::DATE) AS run_id, unnest(['filled', 'returned']) AS metric, unnest([l_linestatus = 'F', l_returnflag = 'R'])::INT AS value, l_linenumber AS weight FROM lineitem),
    r AS (SELECT DISTINCT run_id, 'year ' || run_id AS label FROM s UNION ALL SELECT 1900, 'empty')
    SELECT run_id, label, metric, count(value) AS n, round(avg(value), 6) AS mean, round(sum(value * weight)::DOUBLE / sum(weight), 6) AS weighted FROM r LEFT JOIN s USING (run_id) GROUP BY 1, 2, 3""",
)
def b04(spark, d):
    """A run for each year of lines, stored twice (first half of it), and read back beside its scores."""
    metric = lambda name, holds: F.struct(F.lit(name).alias("metric"), holds.cast("int").alias("value"))
    pair = F.array(metric("filled", F.col("l_linestatus") == "F"), metric("returned", F.col("l_returnflag") == "R"))
    scores = a.table(spark, d, "lineitem").select(F.year(F.to_date("l_shipdate")).alias("run_id"), "l_orderkey", F.col("l_linenumber").alias("weight"), F.explode(pair).alias("m")).select("run_id", F.concat_ws("-", "l_orderkey", "weight").alias("question_id"), "m.metric", "m.value", "weight")
    kept = scores.select("run_id").distinct().select("run_id", F.concat(F.lit("year "), "run_id").alias("label")).unionByName(spark.createDataFrame([(1900, "empty")], "run_id int, label string"))
    path = fresh_folder(spark, "runs")
    runs.record(path, kept, scores.where("weight % 2 = 0"))
    runs.record(path, kept, scores)
    return runs.trend(spark, path).select("run_id", "label", "metric", "n", "mean", "weighted")


@query(
    "j16_most_common",
    "SELECT l_returnflag, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL ORDER BY n DESC, l_returnflag NULLS FIRST, l_suppkey NULLS FIRST LIMIT 10",
)
def j16(spark, d):
    """The ten most frequent pairs (the report is a top ten)."""
    return runs.most_common(a.table(spark, d, "lineitem"), ["l_returnflag", "l_suppkey"], 10)


HASHED = "round(('0x' || substr(md5(query_id || ':' || chunk_id), 1, 4))::BIGINT / 65535.0::DOUBLE, 6)"


@query(
    "t20_explained_items",
    f"""WITH {a.CHUNKS}, {HYBRID}, {HYBRID_TERMS}, {POSTINGS},
    t AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, chunk_id) AS pool_rank FROM bm WHERE bm25 > 0),
    p AS (SELECT t.*, title, doc_type, year, content, {HASHED} AS score FROM t JOIN chunks USING (chunk_id) WHERE pool_rank <= 50),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS position FROM p),
    e AS (SELECT query_id, 1 AS spec_id, 'doc-' || query_id AS t, NULL AS y FROM hq UNION ALL SELECT query_id, 2, NULL, 2021 + query_id % 6 FROM hq UNION ALL SELECT query_id, 3, 'no such', 2021 FROM hq)
    SELECT e.query_id, spec_id, count(chunk_id) > 0 AS in_pool, min(pool_rank) AS pool_rank, min(position) AS position, arg_min(score, position) AS score, md5(arg_min(content, position)[1:400]) AS text_md5
    FROM e LEFT JOIN r ON r.query_id = e.query_id AND (t IS NULL OR contains(title, t)) AND (y IS NULL OR year = y) GROUP BY 1, 2""",
)
def t20(spark, d):
    """For every question's expected sources: whether they were found, at which rank, and what the reranker saw."""
    asked, chunks = query_vectors(spark, d), a.chunks(spark, d)
    best = search.bm25_arm(chunks, question_terms(spark, d, asked), ["doc_type"], 50, rank_by=[]).select("query_id", "chunk_id", F.col("trank").cast("bigint").alias("pool_rank"))
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("query_id").cast("string"), F.col("chunk_id").cast("string"))), 1, 4), 16, 10).cast("double")
    pool = best.join(chunks.select("chunk_id", "title", "doc_type", "year"), "chunk_id").withColumn("score", F.round(h / 65535.0, 6))
    k, none = F.col("query_id"), lambda t: F.lit(None).cast(t)
    specs = F.array(*[F.struct(F.lit(i).alias("spec_id"), t.alias("title"), none("string").alias("doc_type"), y.cast("int").alias("year")) for i, t, y in ((1, F.concat(F.lit("doc-"), k), none("int")), (2, none("string"), 2021 + k % 6), (3, F.lit("no such"), F.lit(2021)))])
    got = runs.explained(runs.reranked(pool), asked.select("query_id", F.explode(specs).alias("s")).select("query_id", "s.*"), texts=chunks.select("chunk_id", F.col("content").alias("text")))
    return got.select("query_id", "spec_id", "in_pool", "pool_rank", F.col("position").cast("bigint").alias("position"), "score", F.md5("scored_text").alias("text_md5"))


#: Questions by key, with the options, scope and value that are read from them.
ASKED = [
    ("What does High and Standard Option cover?", "High,Standard", "in_scope", ""),
    ("Is basic plus better than the Standard plan in 2025?", "Basic Plus,Standard", "in_scope", ""),
    ("Does Basic or Basic Plus cost a high premium?", "Basic,Basic Plus", "in_scope", ""),
    ("Is Umber Health's copay lower?", "", "other_carrier", "Umber Health"),
    ("Is Umber Health's copay lower than that of Larkspur Plans?", "", "in_scope", ""),
    ("What are Medicare Part B premiums?", "", "medicare_program", ""),
    ("How does the plan coordinate with Medicare costs?", "", "in_scope", ""),
    ("What was the deductible in 2019 and 2018?", "", "out_of_year", "2018"),
    ("Did it change from 2019 to 2024 for $2,019.50?", "", "in_scope", ""),
]
ASKED_SQL = "asked AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{o}', '{s}', '{v}')" for i, (_, o, s, v) in enumerate(ASKED)) + ") t(i, options, scope, value))"


@query(
    "p07_boundaries",
    f"WITH {ASKED_SQL} SELECT o_orderkey AS question_id, options, scope, value, CASE WHEN scope = 'out_of_year' THEN 'The corpus covers 2021 to 2026; 2018 is outside.' WHEN scope = 'other_carrier' THEN 'The corpus covers Larkspur Plans only; Umber Health is another carrier.' WHEN scope = 'medicare_program' THEN 'Medicare''s own rules are outside the corpus; how plans go together with Medicare is in it.' ELSE '' END AS note FROM orders JOIN asked ON o_orderkey % {len(ASKED)} = i",
)
def p07(spark, d):
    """What every order's question asks for and where it leaves the corpus."""
    k = F.col("o_orderkey")
    text = reduce(lambda c, x: c.when(k % len(ASKED) == x[0], F.lit(x[1][0])), list(enumerate(ASKED))[1:], F.when(k % len(ASKED) == 0, F.lit(ASKED[0][0])))
    rows = a.table(spark, d, "orders").select(k.alias("question_id"), text.alias("q"))
    got = rows.select("question_id", F.array_join(reading.asked_options(F.col("q"), ("Basic", "Basic Plus", "High", "Standard"), shy=("High", "Standard"), pairs=(("High", "Standard"),)), ",").alias("options"), reading.boundary(F.col("q"), "Larkspur Plans", ("Umber Health", "Teal Mutual"), 2021, 2026).alias("b"))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return got.select("question_id", "options", "b.scope", blank("b.value").alias("value"), blank("b.note").alias("note"))


GROUPS = [("1-URGENT", "admin"), ("2-HIGH", "care_team"), ("3-MEDIUM", "appeals")]
GRANTS = [("ask", "1-URGENT", "whole"), ("ask", "2-HIGH", "care"), ("ask", "3-MEDIUM", "appeals"), ("desk", "2-HIGH", "care"), ("desk", "1-URGENT", "whole")]
_VALUES = lambda rows: "(VALUES " + ", ".join(str(r) for r in rows) + ")"


@query(
    "s12_served_requests",
    f"""WITH g AS (SELECT * FROM {_VALUES(GROUPS)} t(grp, persona)), m AS (SELECT * FROM {_VALUES(GRANTS)} t(surface, grp, module)),
    u AS (SELECT o_custkey AS user_id, min(grp) AS grp FROM orders JOIN g ON grp = o_orderpriority GROUP BY 1), k AS (SELECT c_custkey AS user_id, grp, persona FROM customer LEFT JOIN u ON c_custkey = u.user_id LEFT JOIN g USING (grp)),
    r AS (SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 10 = 9 THEN -1 ELSE o_custkey END AS user_id, CASE WHEN o_orderkey % 3 = 0 THEN 'desk' ELSE 'ask' END AS surface, o_orderkey % 7 = 0 AS forged FROM orders),
    s AS (SELECT request_id, CASE WHEN forged THEN 400 WHEN k.user_id IS NULL THEN 401 WHEN module IS NULL THEN 403 ELSE 200 END AS status, module, persona FROM r LEFT JOIN k USING (user_id) LEFT JOIN m USING (surface, grp))
    SELECT request_id, status, CASE WHEN status = 200 THEN module END AS module, CASE WHEN status = 200 THEN persona END AS persona FROM s""",
)
def s12(spark, d):
    """A request for every order, by its customer: forged identities, unknown users and surfaces that aren't granted."""
    orders, k = a.table(spark, d, "orders"), F.col("o_orderkey")
    users = a.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    groups, grants = spark.createDataFrame(GROUPS, "group string, persona string"), spark.createDataFrame(GRANTS, "surface string, group string, module string")
    known = identity.identities(users, orders.select(F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("group")), groups)
    fields = F.when(k % 7 == 0, F.array(F.lit("question"), F.lit("Role"))).when(k % 2 == 0, F.array(F.lit("question")))
    requests = orders.select(k.alias("request_id"), F.when(k % 10 == 9, -1).otherwise(F.col("o_custkey")).alias("user_id"), F.when(k % 3 == 0, "desk").otherwise("ask").alias("surface"), fields.alias("fields"))
    return identity.served(requests, known, grants)


@query(
    "d09_chunk_metadata",
    f"""WITH {a.CHUNKS} SELECT chunk_id, year, plan_code, acl_tag, doc_type, '{{' || array_to_string(list_filter(['"title":"' || title || '"', '"program":"' || CASE WHEN plan_code LIKE '%P' THEN 'PSHB' WHEN plan_code IS NOT NULL THEN 'FEHB' END || '"',
      CASE WHEN len(section_options) > 0 THEN '"section_options":["' || array_to_string(section_options, '","') || '"]' END, '"effective_date":"' || effective_from || '"', CASE WHEN policy_id IS NOT NULL THEN '"record":{{"policy_id":"' || policy_id || '"}}' END], lambda x: x IS NOT NULL), ',') || '}}' AS metadata FROM chunks""",
)
def d09(spark, d):
    """Every chunk as it is stored: typed columns that filters use, and a JSON text of what describes it."""
    described = {
        "title": F.col("title"),
        "program": F.when(F.col("plan_code").endswith("P"), "PSHB").when(F.col("plan_code").isNotNull(), "FEHB"),
        "section_options": F.when(F.size("section_options") > 0, F.col("section_options")),
        "effective_date": F.col("effective_from").cast("string"),
        "record": F.when(F.col("policy_id").isNotNull(), F.struct("policy_id")),
    }
    return identity.chunk_rows(a.chunks(spark, d), ["chunk_id", "year", "plan_code", "acl_tag", "doc_type"], described)


@query(
    "a06_linked_encounters",
    """SELECT o_orderkey AS encounter_id, CASE WHEN o_orderkey % 4 = 3 THEN 'P' || o_orderkey % 50 WHEN o_orderkey % 3 > 0 THEN 'P' || o_orderkey % 60 END AS provider, CASE WHEN o_orderkey % 4 < 3 THEN 'said "O", ' || o_orderkey % 7 END AS organization, o_orderkey % 4 < 3 AS changed FROM orders""",
)
def a06(spark, d):
    """Encounters linked to providers and organizations by a file of links: its header is in another order, has a column that
    nobody declared, and empty cells; encounters that it doesn't name stay as they are."""
    k, path = F.col("o_orderkey"), fresh_folder(spark, "links")
    orders = a.table(spark, d, "orders")
    orders.where(k % 4 < 3).select(F.concat(F.lit('said "O", '), k % 7).alias("ORGANIZATION"), F.lit("x").alias("note"), F.when(k % 3 > 0, F.concat(F.lit("P"), k % 60)).alias("Provider"), k.alias("Id")).write.option("header", True).option("escape", '"').csv(path)
    links = ingest.read_declared_csv(spark, path, {"id": "bigint", "provider": "string", "organization": "string"}).withColumnRenamed("id", "encounter_id")
    stored = orders.select(k.alias("encounter_id"), F.concat(F.lit("P"), k % 50).alias("provider"), F.lit(None).cast("string").alias("organization"))
    return ingest.refresh_metadata(stored, links, "encounter_id", ["provider", "organization"])
