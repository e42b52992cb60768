"""Smaller operators: sources, copies, labels, audit filters, interval joins, set operations and status reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import adapters as a
from .adapters import ADJUDICATION, APPEALS, CALLS, CHUNKS, CLAIM_LINES, ENROLLMENT
from .evaluation import SCORE_SQL, tidy
from .registry import query
from .retrieval import SCORES, scores


@query("a02_csv_rows", """SELECT n_nationkey, 'n_nationkey: ' || n_nationkey || '; n_name: ' || n_name || '; n_regionkey: ' || n_regionkey AS element FROM nation""")
def a02(spark, d):
    """Self-contained rows: every value beside its header."""
    t = a.table(spark, d, "nation")
    return t.select("n_nationkey", F.concat_ws("; ", *[F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in t.columns]).alias("element"))


@query("a12_cache_misses", """SELECT page_id, sha256(html || '|fast|1') AS key FROM pages WHERE page_id % 3 <> 0 AND sha256(html || '|fast|1') NOT IN (SELECT sha256(html || '|fast|1') FROM pages WHERE page_id % 3 = 0)""")
def a12(spark, d):
    """Files whose parse isn't in the cache, keyed by content, backend and version (here a third of the pages is in)."""
    keyed = a.table(spark, d, "pages").select("page_id", F.sha2(F.concat("html", F.lit("|fast|1")), 256).alias("key"))
    return keyed.where("page_id % 3 <> 0").join(keyed.where("page_id % 3 = 0").select("key"), "key", "left_anti")


@query("a13_registry", f"WITH {CHUNKS} SELECT doc_type, bool_or(versioned) AS versioned, bool_or(event) AS event, bool_or(member_scoped) AS member_scoped, count(*) AS chunks FROM chunks GROUP BY 1")
def a13(spark, d):
    return a.chunks(spark, d).groupBy("doc_type").agg(F.bool_or("versioned").alias("versioned"), F.bool_or("event").alias("event"), F.bool_or("member_scoped").alias("member_scoped"), F.count(F.lit(1)).alias("chunks"))


@query("a15_export", f"WITH {CLAIM_LINES} SELECT line_of_business, description, count(*) AS lines, sum(payer_coverage)::DECIMAL(20,2) AS covered FROM claim_lines GROUP BY ALL")
def a15(spark, d):
    """The export's rows with the derived line of business, counted as the load counts them back."""
    return a.claim_lines(spark, d).groupBy("line_of_business", "description").agg(F.count(F.lit(1)).alias("lines"), F.sum("payer_coverage").cast("decimal(20,2)").alias("covered"))


@query("b02_quarantine_replace", """SELECT doc_id, 'old' AS detail FROM documents WHERE doc_id % 7 = 0 AND doc_id % 5 <> 0 UNION ALL SELECT doc_id, CASE WHEN length(text) < 500 THEN 'min_chunks' ELSE 'median_size' END FROM documents WHERE doc_id % 5 = 0""")
def b02(spark, d):
    """A path's earlier failures go when it is gated again."""
    docs = a.table(spark, d, "documents")
    old = docs.where("doc_id % 7 = 0").select("doc_id", F.lit("old").alias("detail"))
    fresh = docs.where("doc_id % 5 = 0").select("doc_id", F.when(F.length("text") < 500, "min_chunks").otherwise("median_size").alias("detail"))
    return old.join(fresh.select("doc_id"), "doc_id", "left_anti").unionByName(fresh)


@query("c04_metadata_refresh", """SELECT count(*) FILTER (WHERE (CASE WHEN doc_id % 3 > 0 THEN source END) IS DISTINCT FROM (CASE WHEN doc_id % 6 > 0 THEN source END)) AS changed, count(*) AS documents FROM documents""")
def c04(spark, d):
    """Rows whose stored metadata differs from what the recipe gives now, nulls included."""
    stored, fresh = F.when(F.col("doc_id") % 3 > 0, F.col("source")), F.when(F.col("doc_id") % 6 > 0, F.col("source"))
    return a.table(spark, d, "documents").agg(F.count_if(~stored.eqNullSafe(fresh)).alias("changed"), F.count(F.lit(1)).alias("documents"))


@query("c09_default_copy", """SELECT doc_id, md5(coalesce(CASE WHEN doc_id % 2 = 0 THEN upper(source) END, text)) AS h FROM documents""")
def c09(spark, d):
    return a.table(spark, d, "documents").select("doc_id", F.md5(F.coalesce(F.when(F.col("doc_id") % 2 == 0, F.upper("source")), F.col("text"))).alias("h"))


@query("d08_section_options", """SELECT doc_id, array_to_string(list_filter(['High', 'Standard', 'Elevate Plus', 'Elevate'], lambda o: CASE o WHEN 'Elevate' THEN regexp_matches(heading, 'Elevate( |$)') AND NOT regexp_matches(heading, 'Elevate Plus') WHEN 'Elevate Plus' THEN contains(heading, o) ELSE regexp_matches(heading, o || ' Options?') END), ',') AS options
    FROM (SELECT doc_id, ['High Option benefits', 'Standard and High Options', 'Elevate Plus', 'Elevate', 'High deductible', 'none'][doc_id % 6 + 1] AS heading FROM documents)""")
def d08(spark, d):
    """Options a heading names: common names need the word option, a plain name must not be part of the longer one."""
    heading = a.pick(["High Option benefits", "Standard and High Options", "Elevate Plus", "Elevate", "High deductible", "none"], F.col("doc_id") % 6)
    has = {"High": heading.rlike("High Options?"), "Standard": heading.rlike("Standard Options?"), "Elevate Plus": heading.contains("Elevate Plus"), "Elevate": heading.rlike("Elevate(?! Plus)( |$)")}
    found = F.filter(F.array(*[F.when(c, o) for o, c in has.items()]), lambda x: x.isNotNull())
    return a.table(spark, d, "documents").select("doc_id", F.array_join(found, ",").alias("options"))


@query(
    "d10_search_copy",
    r"""WITH s AS (SELECT doc_id, source, unnest(list_filter(list_transform(string_split(replace(regexp_replace(text, '([.;!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(10), chr(1)), chr(1)), lambda s: trim(s)), lambda s: s <> '')) AS sentence FROM documents),
    b AS (SELECT sentence FROM (SELECT DISTINCT doc_id, sentence FROM s) GROUP BY 1 HAVING count(*) > greatest(2, 0.005 * (SELECT count(*) FROM documents)))
    SELECT doc_id, count(*) AS kept FROM s WHERE sentence NOT IN (SELECT sentence FROM b) GROUP BY 1""",
)
def d10(spark, d):
    """Search copies without boilerplate sentences; only sentences, not texts, meet the boilerplate list."""
    from ..operators.chunking import boilerplate

    docs = a.table(spark, d, "documents")
    common = boilerplate(docs, tx.sentences(F.col("text")), share=0.005).select("sentence")
    flat = docs.select("doc_id", F.explode(tx.sentences(F.col("text"))).alias("sentence"))
    return flat.join(common, "sentence", "left_anti").groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"))


@query("d17_row_keys", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE contains(text, ' | ')), k AS (SELECT doc_id, lower(trim(string_split(line, ' | ')[1])) AS key FROM l WHERE contains(line, ' | '))
    SELECT doc_id, count(DISTINCT key) AS keys FROM k WHERE length(key) >= 3 AND NOT regexp_matches(key, '^[0-9 .,%$-]+$') GROUP BY 1""")
def d17(spark, d):
    """Distinct first cells of table rows; short and numeric ones are no keys."""
    lines = a.table(spark, d, "documents").where(F.col("text").contains(" | ")).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").contains(" | "))
    keys = lines.select("doc_id", F.lower(F.trim(F.split("line", r" \| ")[0])).alias("key")).where((F.length("key") >= 3) & ~F.col("key").rlike("^[0-9 .,%$-]+$"))
    return keys.groupBy("doc_id").agg(F.countDistinct("key").alias("keys"))


@query("d20_ascii_names", """SELECT c_custkey, regexp_replace(translate('Zoé-' || c_name, 'éè#', 'ee '), '[0-9]', '', 'g') AS name FROM customer""")
def d20(spark, d):
    return a.table(spark, d, "customer").select("c_custkey", F.regexp_replace(F.translate(F.concat(F.lit("Zoé-"), "c_name"), "éè#", "ee "), "[0-9]", "").alias("name"))


@query("g11_audit_filter", """WITH log AS (SELECT event_id, user_id, ['doc-' || event_id % 50, 'Policy-' || event_id % 7] AS titles FROM events) SELECT event_id, user_id FROM log WHERE len(list_filter(titles, lambda t: t ILIKE '%POLICY-3%')) > 0 AND user_id < 40""")
def g11(spark, d):
    log = a.table(spark, d, "events").select("event_id", "user_id", F.array(F.concat(F.lit("doc-"), F.col("event_id") % 50), F.concat(F.lit("Policy-"), F.col("event_id") % 7)).alias("titles"))
    return log.where(F.exists("titles", lambda t: t.ilike("%POLICY-3%")) & (F.col("user_id") < 40)).select("event_id", "user_id")


@query("g12_optional_parameters", f"WITH {CALLS} SELECT count(*) FILTER (WHERE member_id = 17) AS by_member, count(*) FILTER (WHERE reason = 'error') AS by_reason, 0::BIGINT AS by_nothing FROM calls")
def g12(spark, d):
    """One of two parameters; with neither the condition is unknown and nothing is found."""
    calls = a.call_log(spark, d)
    by = lambda member, reason: F.col("member_id") == member if member is not None else F.col("reason") == F.lit(reason)
    return calls.agg(F.count_if(by(17, None)).alias("by_member"), F.count_if(by(None, "error")).alias("by_reason"), F.count_if(by(None, None)).alias("by_nothing"))


@query("g15_relevance_pages", f"WITH {CHUNKS} SELECT chunk_id, len(list_intersect([chunk_id % 12, chunk_id % 12 + 1], range(6, 9))) > 0 AS relevant FROM chunks WHERE plan_code = '104'")
def g15(spark, d):
    """Printed page 5 is page 7 of the file, give or take one."""
    pages = F.array(F.col("chunk_id") % 12, F.col("chunk_id") % 12 + 1)
    return a.chunks(spark, d).where("plan_code = '104'").select("chunk_id", F.arrays_overlap(pages, F.sequence(F.lit(6).cast("bigint"), F.lit(8).cast("bigint"))).alias("relevant"))


@query("h12_date_of_service", f"WITH {APPEALS} SELECT case_id, service_date FROM appeals JOIN adjudication USING (claim_id)")
def h12(spark, d):
    """A case's claim, and the claim's date."""
    return a.appeals(spark, d).join(a.adjudication(spark, d).select("claim_id", "service_date"), "claim_id").select("case_id", "service_date")


@query("h08_readings", f"WITH {CHUNKS}, {SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, year, plan_code ORDER BY score DESC, chunk_id) AS position FROM scores WHERE year IN (2025, 2026) AND plan_code IN ('104', '105')) SELECT query_id, year, plan_code, chunk_id, position FROM r WHERE position <= 5")
def h08(spark, d):
    """A full search for each covered plan and routed year, as a partition key of one plan."""
    rows = scores(spark, d).where("year IN (2025, 2026) AND plan_code IN ('104', '105')")
    place = F.row_number().over(Window.partitionBy("query_id", "year", "plan_code").orderBy(F.desc("score"), "chunk_id"))
    return rows.withColumn("position", place.cast("bigint")).where("position <= 5").select("query_id", "year", "plan_code", "chunk_id", "position")


@query("i07_appeal_candidates", f"WITH {ADJUDICATION}, {CALLS} SELECT a.claim_id, count(*) AS calls FROM calls c JOIN adjudication a ON a.claim_id = c.claim_id AND a.member_id % 150 = c.member_id WHERE a.status = 'denied' GROUP BY 1")
def i07(spark, d):
    """Denied claims with a call of the same member about the same claim: a composite key."""
    claims = a.adjudication(spark, d).where("status = 'denied'").select("claim_id", (F.col("member_id") % 150).alias("member_id"))
    return a.call_log(spark, d).join(claims, ["claim_id", "member_id"]).groupBy("claim_id").agg(F.count(F.lit(1)).alias("calls"))


@query("i19_version_in_force", f"WITH {CHUNKS}, v AS (SELECT policy_id, chunk_id, effective_from, effective_to FROM chunks WHERE policy_id IS NOT NULL AND effective_from IS NOT NULL), {ADJUDICATION}, c AS (SELECT claim_id, policy_id, DATE '2021-06-01' + (claim_id % 1500)::INTEGER AS day FROM adjudication WHERE policy_id IS NOT NULL) SELECT claim_id, count(*) AS versions, max(chunk_id) AS newest FROM c JOIN v USING (policy_id) WHERE effective_from <= day AND (effective_to IS NULL OR effective_to > day) GROUP BY 1")
def i19(spark, d):
    """Versions of a claim's policy in force on a day: equal policy, then the half-open window."""
    v = a.chunks(spark, d).where("policy_id IS NOT NULL AND effective_from IS NOT NULL").select("policy_id", "chunk_id", "effective_from", "effective_to")
    c = a.adjudication(spark, d).where("policy_id IS NOT NULL").select("claim_id", "policy_id", F.date_add(F.lit("2021-06-01").cast("date"), (F.col("claim_id") % 1500).cast("int")).alias("day"))
    inside = (F.col("effective_from") <= F.col("day")) & (F.col("effective_to").isNull() | (F.col("effective_to") > F.col("day")))
    return c.join(v, "policy_id").where(inside).groupBy("claim_id").agg(F.count(F.lit(1)).alias("versions"), F.max("chunk_id").alias("newest"))


@query("i20_span_overlap", """WITH s AS (SELECT event_id % 400 AS doc_id, event_id AS id, event_id * 7 % 300 AS start, event_id * 7 % 300 + 20 AS stop FROM events), r AS (SELECT * FROM s WHERE id % 2 = 0), e AS (SELECT * FROM s WHERE id % 2 = 1) SELECT e.id, count(r.id) AS hits FROM e LEFT JOIN r ON r.doc_id = e.doc_id - 1 AND r.start < e.stop AND e.start < r.stop GROUP BY 1""")
def i20(spark, d):
    """Found against labelled spans within a document: equal document, overlapping interval; no pair is made."""
    from ..operators.ranks import overlap_counts

    s = a.table(spark, d, "events").select((F.col("event_id") % 400).alias("doc_id"), F.col("event_id").alias("id"), (F.col("event_id") * 7 % 300).alias("start"), (F.col("event_id") * 7 % 300 + 20).alias("stop"))
    labelled = s.where("id % 2 = 0").select((F.col("doc_id") + 1).alias("doc_id"), "start", "stop")
    return overlap_counts(s.where("id % 2 = 1"), labelled, "doc_id")


@query("i21_evidence_pairs", """SELECT o_custkey AS member_id, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey::VARCHAR) AS claims FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' GROUP BY 1""")
def i21(spark, d):
    urgent = a.table(spark, d, "orders").where("o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
    return urgent.groupBy(F.col("o_custkey").alias("member_id")).agg(F.array_join(F.array_sort(F.collect_list(F.col("o_orderkey").cast("string"))), ",").alias("claims"))


@query("l06_newest_per_patient", f"WITH {CLAIM_LINES}, r AS (SELECT member_id, claim_id, service_date, row_number() OVER (PARTITION BY member_id ORDER BY service_date DESC, claim_id) AS r FROM (SELECT DISTINCT member_id, claim_id, service_date FROM claim_lines)) SELECT * FROM r WHERE r <= 4")
def l06(spark, d):
    """Lines are dealt by claim and then by member, in a stated number of parts, so that a task holds a share of the lines
    and nothing but one sort; equal rows have one place, and are made one after the cut."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = a.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("claim_id"), F.to_date("l_shipdate").alias("service_date")).repartition(parts, "claim_id")
    owners = a.table(spark, d, "orders").select(F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("member_id"))
    rows = lines.join(owners, "claim_id").select("member_id", "claim_id", "service_date").repartition(parts, "member_id")
    newest = F.dense_rank().over(Window.partitionBy("member_id").orderBy(F.desc("service_date"), "claim_id"))
    return rows.withColumn("r", newest.cast("bigint")).where("r <= 4").distinct()


@query("m05_missing_plans", f"WITH {ENROLLMENT} SELECT member_id, array_to_string(list_sort(list_filter(['104', '114', '124', '10P', '11P', '12P'], lambda p: NOT list_contains(held, p))), ',') AS missing FROM (SELECT member_id, list(DISTINCT plan_code) AS held FROM enrollment GROUP BY 1)")
def m05(spark, d):
    every = F.array(*[F.lit(p) for p in ("104", "114", "124", "10P", "11P", "12P")])
    held = a.enrollment(spark, d).groupBy("member_id").agg(F.collect_set("plan_code").alias("held"))
    return held.select("member_id", F.array_join(F.array_sort(F.array_except(every, "held")), ",").alias("missing"))


@query("o16_demo", f"WITH {CLAIM_LINES} SELECT claim_id, line_number, member_id, service_date, description, total_claim_cost, line_of_business FROM claim_lines ORDER BY service_date DESC, claim_id, line_number, total_claim_cost, description LIMIT 5")
def o16(spark, d):
    """The catalog's sample of the five latest lines."""
    return a.claim_lines(spark, d).orderBy(F.desc("service_date"), "claim_id", "line_number", "total_claim_cost", "description").limit(5).select("claim_id", "line_number", "member_id", "service_date", "description", "total_claim_cost", "line_of_business")


@query("p01_reading", r"""SELECT event_id, regexp_matches(q, 'PSHB|postal') AS pshb, regexp_matches(q, 'change|differ') AS change, coalesce(array_to_string(list_sort(regexp_extract_all(q, 'High|Standard')), ','), '') AS options
    FROM (SELECT event_id, ['PSHB High change in 2025', 'postal Standard plan', 'Standard against High: how do they differ', 'deductible'][event_id % 4 + 1] AS q FROM events)""")
def p01(spark, d):
    """What questions say, as columns."""
    q = a.pick(["PSHB High change in 2025", "postal Standard plan", "Standard against High: how do they differ", "deductible"], F.col("event_id") % 4)
    return a.table(spark, d, "events").select("event_id", q.rlike("PSHB|postal").alias("pshb"), q.rlike("change|differ").alias("change"), F.array_join(F.array_sort(F.regexp_extract_all(q, F.lit("High|Standard"), F.lit(0))), ",").alias("options"))


@query("t14_threshold", f"WITH {CHUNKS}, {SCORES}, l AS (SELECT s.doc_type, s.score, coalesce(b.quality, 0) AS good FROM scores s LEFT JOIN labels b ON b.doc_id = s.chunk_id WHERE query_id = 0) SELECT doc_type, round((min(score) FILTER (WHERE good = 1) + max(score) FILTER (WHERE good = 0)) / 2, 5) AS bar FROM l GROUP BY 1")
def t14(spark, d):
    """A bar between the least answered and the best trap score, by source."""
    good = a.table(spark, d, "labels").select(F.col("doc_id").alias("chunk_id"), "quality")
    rows = scores(spark, d).where("query_id = 0").join(good, "chunk_id", "left").withColumn("good", F.coalesce("quality", F.lit(0)))
    return rows.groupBy("doc_type").agg(F.round((F.min(F.when(F.col("good") == 1, F.col("score"))) + F.max(F.when(F.col("good") == 0, F.col("score")))) / 2, 5).alias("bar"))


@query("t17_trend", f"WITH {SCORE_SQL}, r AS (SELECT run_id, metric, avg(value) AS rate FROM eval GROUP BY ALL) SELECT run_id, metric, round(rate, 6) AS rate, round(rate - lag(rate) OVER (PARTITION BY metric ORDER BY run_id), 6) AS change FROM r")
def t17(spark, d):
    rates = tidy(spark, d).groupBy("run_id", "metric").agg(F.avg("value").alias("rate"))
    before = F.lag("rate").over(Window.partitionBy("metric").orderBy("run_id"))
    return rates.select("run_id", "metric", F.round("rate", 6).alias("rate"), F.round(F.col("rate") - before, 6).alias("change"))


@query("t19_status", """SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'embedded', count(*) FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings) UNION ALL SELECT 'labelled', count(DISTINCT doc_id) FROM labels""")
def t19(spark, d):
    docs = a.table(spark, d, "documents").select("doc_id")
    parts = {"documents": docs, "embedded": docs.join(a.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi"), "labelled": a.table(spark, d, "labels").select("doc_id").distinct()}
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("name"), "n") for k, df in parts.items()])
