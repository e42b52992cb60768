"""Context of questions, reranking rules, payloads and de-identification queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import deid, payload, search
from ..operators.governance import Principal, visible
from . import adapters as a
from .adapters import ADJUDICATION, APPEALS, CHUNKS, ENROLLMENT
from .registry import query
from .retrieval import SCORES, SEEN, scores, seen

QUESTIONS = """questions AS (SELECT event_id AS question_id, CASE event_id % 4 WHEN 0 THEN 'why was claim CLM-' || (event_id % 15000) || ' denied' WHEN 1 THEN 'status of APL-' || (event_id % 15000) || '?'
  WHEN 2 THEN 'compare CLM-' || (event_id % 15000) || ' please' ELSE 'no identifier' END AS question FROM events)"""


def questions(spark, d):
    k = F.col("event_id") % 15000
    q = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("why was claim CLM-"), k, F.lit(" denied"))).when(F.col("event_id") % 4 == 1, F.concat(F.lit("status of APL-"), k, F.lit("?"))).when(F.col("event_id") % 4 == 2, F.concat(F.lit("compare CLM-"), k, F.lit(" please"))).otherwise("no identifier")
    return a.table(spark, d, "events").select(F.col("event_id").alias("question_id"), q.alias("question"))


@query(
    "h11_context",
    f"""WITH {APPEALS}, {QUESTIONS}, i AS (SELECT question_id, nullif(regexp_extract(question, 'CLM-([0-9]+)', 1), '')::BIGINT AS clm, nullif(regexp_extract(question, '(APL-[0-9]+)', 1), '') AS apl FROM questions),
    r AS (SELECT question_id, clm, apl, coalesce(clm, p.claim_id) AS claim FROM i LEFT JOIN appeals p ON p.case_id = i.apl)
    SELECT question_id, c.member_id AS member_key, c.policy_id, c.service_date AS as_of, (clm IS NOT NULL OR apl IS NOT NULL) AND c.claim_id IS NULL AS unresolved
    FROM r LEFT JOIN adjudication c ON c.claim_id = r.claim""",
)
def h11(spark, d):
    """Identifiers in many questions at once: a case leads to its claim, a claim to member, policy and date of service."""
    q = questions(spark, d).select("question_id", F.nullif(F.regexp_extract("question", "CLM-([0-9]+)", 1), F.lit("")).cast("bigint").alias("clm"), F.nullif(F.regexp_extract("question", "(APL-[0-9]+)", 1), F.lit("")).alias("case_id"))
    cases = a.appeals(spark, d).select("case_id", F.col("claim_id").alias("_of_case"))
    claims = a.adjudication(spark, d).select("claim_id", "member_id", "policy_id", "service_date")
    both = q.join(cases, "case_id", "left").withColumn("claim_id", F.coalesce("clm", "_of_case")).join(claims, "claim_id", "left")
    named = F.col("clm").isNotNull() | F.col("case_id").isNotNull()
    return both.select("question_id", F.col("member_id").alias("member_key"), "policy_id", F.col("service_date").alias("as_of"), (named & F.col("member_id").isNull()).alias("unresolved"))


@query(
    "h14_enrolled_plan",
    f"""WITH {ENROLLMENT}, b AS (SELECT member_id, plan_code FROM enrollment WHERE year IN (1999, 2000))
    SELECT c_custkey AS member_id, coalesce((SELECT string_agg(DISTINCT plan_code, ',' ORDER BY plan_code) FROM b WHERE member_id = c_custkey), 'all') AS plans FROM customer""",
)
def h14(spark, d):
    """Plan codes of the routed years bind a question that names no plan."""
    bound = a.enrollment(spark, d).where("year IN (1999, 2000)").groupBy("member_id").agg(F.array_join(F.array_sort(F.collect_set("plan_code")), ",").alias("plans"))
    people = a.table(spark, d, "customer").select(F.col("c_custkey").alias("member_id"))
    return people.join(bound, "member_id", "left").select("member_id", F.coalesce("plans", F.lit("all")).alias("plans"))


@query("h15_versions", f"WITH {CHUNKS} SELECT policy_id, string_agg(DISTINCT year(effective_from)::VARCHAR, ',' ORDER BY year(effective_from)::VARCHAR) AS years FROM chunks WHERE policy_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT year(effective_from)) >= 2")
def h15(spark, d):
    """A reading for each distinct version year of a policy, where there are two or more."""
    got = a.chunks(spark, d).where("policy_id IS NOT NULL").groupBy("policy_id").agg(F.array_sort(F.collect_set(F.year("effective_from"))).alias("y"))
    return got.where(F.size("y") >= 2).select("policy_id", F.array_join(F.col("y").cast("array<string>"), ",").alias("years"))


@query("h16_policy_title", f"WITH {CHUNKS} SELECT policy_id, regexp_replace(min(title || ' v' || year), ' v[0-9]+$', '') AS title FROM chunks WHERE policy_id IS NOT NULL GROUP BY 1")
def h16(spark, d):
    return a.chunks(spark, d).where("policy_id IS NOT NULL").groupBy("policy_id").agg(F.regexp_replace(F.min(F.concat("title", F.lit(" v"), "year")), " v[0-9]+$", "").alias("title"))


OVERLAP = "len(list_intersect(list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+')), ['the', 'that', 'with', 'una', 'und'])) / 5.0::DOUBLE"


@query(
    "h18_record_scores",
    f"""WITH t AS (SELECT conv_id, turn, text, CASE WHEN contains(text, chr(10)) THEN substr(text, position(chr(10) IN text) + 1) ELSE text END AS body FROM conversations)
    SELECT conv_id, turn, round(greatest({OVERLAP.format("text")}, {OVERLAP.format("body")}), 6) AS score FROM t""",
)
def h18(spark, d):
    """A lexical scorer (share of the question's words) of a record with and without its header line; the better counts."""
    asked = F.array(*[F.lit(w) for w in ("the", "that", "with", "una", "und")])
    score = lambda c: F.size(F.array_intersect(F.array_distinct(search.tokens(c)), asked)) / F.lit(5.0)
    body = F.when(F.col("text").contains("\n"), F.expr("substr(text, instr(text, '\\n') + 1)")).otherwise(F.col("text"))
    return a.table(spark, d, "conversations").select("conv_id", "turn", F.round(F.greatest(score(F.col("text")), score(body)), 6).alias("score"))


@query(
    "h23_records_first",
    f"""WITH {CHUNKS}, {SCORES}, o AS (SELECT s.query_id, s.chunk_id, s.score, member_scoped AS own, row_number() OVER (PARTITION BY query_id ORDER BY member_scoped DESC, s.score DESC, s.chunk_id) AS position FROM scores s JOIN chunks USING (chunk_id))
    SELECT * FROM o WHERE position <= 10""",
)
def h23(spark, d):
    """A leg at a member's records takes these first, then by score."""
    rows = scores(spark, d).join(a.chunks(spark, d).select("chunk_id", F.col("member_scoped").alias("own")), "chunk_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("own"), F.desc("score"), "chunk_id"))
    return rows.withColumn("position", place.cast("bigint")).where("position <= 10").select("query_id", "chunk_id", "score", "own", "position")


@query(
    "r01_payloads",
    f"""WITH {SEEN}, {SCORES}, v AS (SELECT s.query_id, s.chunk_id, s.score, acl_tag, row_number() OVER (PARTITION BY query_id ORDER BY s.score DESC, s.chunk_id) AS rank FROM scores s JOIN seen USING (chunk_id) WHERE acl_tag IN ('public', 'employee'))
    SELECT query_id, CASE WHEN max(score) >= 0.7 THEN 'ok' ELSE 'insufficient_evidence' END AS status, round(max(score), 4) AS confidence,
      string_agg(chunk_id || ':' || acl_tag, ',' ORDER BY rank) FILTER (WHERE rank <= 8) AS chunks FROM v GROUP BY 1""",
)
def r01(spark, d):
    """Payloads of many questions as one persona; the JSON is read back for the comparison."""
    rows = scores(spark, d).join(seen(spark, d).where(visible(Principal("employee"))).select("chunk_id", "acl_tag"), "chunk_id")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")))
    built = payload.build(ranked, search.abstain(ranked, F.lit(0.7)))
    got = F.from_json("payload", "struct<chunks:array<struct<chunk_id:bigint,acl_basis:string>>>")["chunks"]
    return built.select("query_id", "status", "confidence", F.array_join(F.transform(got, lambda c: F.concat_ws(":", c["chunk_id"].cast("string"), c["acl_basis"])), ",").alias("chunks"))


LEGS = """legs AS (SELECT user_id AS plan_id, 'leg' || event_id % 4 AS leg, CASE WHEN event_id % 3 = 0 THEN 'member_query' ELSE 'doc_probe' END AS kind, event_id % 2 = 0 AS required,
  CASE WHEN event_id % 40 = 7 THEN 'not_executed' WHEN event_id % 30 = 4 THEN 'insufficient_evidence' ELSE 'ok' END AS status, round(value, 4) AS confidence FROM events)"""


@query(
    "r02_compose",
    f"""WITH {LEGS} SELECT plan_id, coalesce(['not_executed','out_of_scope','insufficient_evidence','ok'][min(list_position(['not_executed','out_of_scope','insufficient_evidence','ok'], status)) FILTER (WHERE required)], 'ok') AS status,
      min(confidence) FILTER (WHERE kind = 'doc_probe') AS confidence, coalesce(string_agg(leg, ',' ORDER BY leg) FILTER (WHERE status <> 'ok'), '') AS missing FROM legs GROUP BY 1""",
)
def r02(spark, d):
    e = a.table(spark, d, "events")
    legs = e.select(F.col("user_id").alias("plan_id"), F.concat(F.lit("leg"), F.col("event_id") % 4).alias("leg"), F.when(F.col("event_id") % 3 == 0, "member_query").otherwise("doc_probe").alias("kind"), (F.col("event_id") % 2 == 0).alias("required"), F.when(F.col("event_id") % 40 == 7, "not_executed").when(F.col("event_id") % 30 == 4, "insufficient_evidence").otherwise("ok").alias("status"), F.round("value", 4).alias("confidence"))
    return payload.compose(legs)


@query(
    "r03_version_label",
    f"""WITH {CHUNKS} SELECT chunk_id, coalesce('v' || CASE WHEN chunk_id % 5 = 0 THEN chunk_id % 3 END, CASE WHEN chunk_id % 5 = 1 THEN 'CL-' || chunk_id END, 'decided ' || CASE WHEN chunk_id % 5 = 2 THEN effective_from END, 'edition ' || year, 'unversioned') AS label FROM chunks""",
)
def r03(spark, d):
    m = F.col("chunk_id") % 5
    label = payload.version_label(F.when(m == 0, F.col("chunk_id") % 3), F.when(m == 1, F.concat(F.lit("CL-"), "chunk_id")), F.when(m == 2, F.col("effective_from")), F.col("year"))
    return a.chunks(spark, d).select("chunk_id", label.alias("label"))


PATTERNS = {"CARD": (r"[0-9]{16}", 0.8), "IP": (r"[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}", 0.6), "DIGITS": (r"[0-9]{5,8}", 0.5), "LOW": (r"[0-9]+", 0.2)}


@query(
    "f05_resolved_spans",
    r"""WITH d AS (SELECT doc_id, text FROM documents WHERE regexp_matches(text, '[0-9]'))
    SELECT doc_id, len(regexp_extract_all(text, '[0-9]{16}')) AS cards, len(regexp_extract_all(text, '[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}')) AS ips FROM d""",
)
def f05(spark, d):
    """Spans after overlap resolution: a digit run inside a card number gives way to it, low scores go."""
    docs = a.table(spark, d, "documents").where(F.col("text").rlike("[0-9]"))
    kept = deid.resolve(deid.spans(F.col("text"), PATTERNS))
    count = lambda t: F.size(F.filter("s", lambda s: s["type"] == t)).cast("bigint")
    return docs.select("doc_id", kept.alias("s")).select("doc_id", count("CARD").alias("cards"), count("IP").alias("ips"))


@query(
    "f07_masked",
    r"""SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[0-9]{16}', '<CARD>', 'g'), '[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}', '<IP>', 'g')) AS h FROM documents""",
)
def f07(spark, d):
    both = {k: PATTERNS[k] for k in ("CARD", "IP")}
    return a.table(spark, d, "documents").select("doc_id", F.md5(deid.masked(F.col("text"), deid.resolve(deid.spans(F.col("text"), both)))).alias("h"))


@query("p06_year_neutral", r"""SELECT event_id, trim(regexp_replace(regexp_replace(event_type || ' cover in ' || (2020 + event_id % 6) || ' change', '\b20[0-9][0-9]\b|\bchange\b', ' ', 'g'), ' +', ' ', 'g')) AS subject FROM events""")
def p06(spark, d):
    """The subject of a question without years and change words, for the years before the latest."""
    q = F.concat("event_type", F.lit(" cover in "), 2020 + F.col("event_id") % 6, F.lit(" change"))
    return a.table(spark, d, "events").select("event_id", tx.year_neutral(q).alias("subject"))


assert ADJUDICATION in APPEALS


@query(
    "p04_coverage",
    r"""WITH q AS (SELECT event_id AS question_id, 2022 + event_id % 5 AS year, ['FEHB', 'postal', 'PSHB', ''][event_id % 4 + 1] || ' ' || ['High', 'Basic and High', ''][event_id % 3 + 1] || ' copay' AS q FROM events),
    o AS (SELECT * FROM (VALUES ('FEHB','High','104',2021),('FEHB','Standard','105',2021),('FEHB','Basic','106',2021),('PSHB','High','10P',2025),('PSHB','Standard','11P',2025),('PSHB','Basic','12P',2025)) t(program, option, plan_code, since)),
    s AS (SELECT question_id, year, CASE WHEN regexp_matches(q, 'postal|PSHB') THEN 'PSHB' WHEN contains(q, 'FEHB') THEN 'FEHB' END AS p, regexp_extract_all(q, 'High|Standard|Basic') AS os FROM q)
    SELECT question_id, CASE WHEN p IS NOT NULL AND len(any_value(os)) = 0 THEN 'program' WHEN len(any_value(os)) > 0 THEN 'option' ELSE 'all' END AS level, coalesce(string_agg(DISTINCT plan_code, ',' ORDER BY plan_code), '') AS plans
    FROM s LEFT JOIN o ON (p IS NULL OR program = p) AND (len(os) = 0 OR list_contains(os, option)) AND since <= year GROUP BY question_id, p""",
)
def p04(spark, d):
    from ..operators.routing import coverage

    k = F.col("event_id")
    q = F.concat(a.pick(["FEHB", "postal", "PSHB", ""], k % 4), F.lit(" "), a.pick(["High", "Basic and High", ""], k % 3), F.lit(" copay"))
    return coverage(a.table(spark, d, "events").select(k.alias("question_id"), q.alias("question"), (2022 + k % 5).alias("year")))
