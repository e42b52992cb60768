"""Search queries: filters, both arms, fusion, pools, seats and abstention, as many questions in one plan."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import filters, search
from ..operators.filters import Route
from ..operators.governance import CITATION_KIND, CITED_TIERS, PERSONA_TIERS, Principal, visible, with_citations
from . import adapters as a
from .adapters import CHUNKS, EVIDENCE
from .registry import query

TERMS = [(0, "the"), (0, "that"), (0, "bleer"), (1, "une"), (1, "laoué"), (1, "est"), (2, "idiot"), (2, "trash"), (3, "license"), (3, "apache")]
TERMS_SQL = "terms AS (SELECT * FROM (VALUES " + ", ".join(f"({q}, '{t}')" for q, t in TERMS) + ") t(query_id, term))"
VECTORS = "q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 20 = 0)"
#: exact scan for every stated query vector
SCORED = f"""{VECTORS}, scored AS (
  SELECT q.query_id, e.vec_id AS chunk_id, c.doc_type,
    round(list_dot_product(e.embedding::DOUBLE[], q.v::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.v::DOUBLE[], q.v::DOUBLE[]))), 6) AS similarity
  FROM embeddings e, q, chunks c WHERE c.chunk_id = e.vec_id)"""


def chunks_with_vectors(spark, d):
    vectors = a.table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    return a.chunks(spark, d).join(vectors, "chunk_id", "left")


def query_vectors(spark, d):
    """The stated query set: every embedding whose id is divisible by 20."""
    return a.table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def query_terms(spark):
    return spark.createDataFrame(TERMS, "query_id bigint, term string")


@query(
    "h01_vector_topk",
    f"""WITH {CHUNKS}, {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS vrank FROM scored)
    SELECT query_id, chunk_id, similarity, vrank FROM r WHERE vrank <= 100""",
)
def h01(spark, d):
    return search.vector_arm(chunks_with_vectors(spark, d), query_vectors(spark, d), []).withColumn("vrank", F.col("vrank").cast("bigint"))


POSTINGS = """split AS (SELECT chunk_id, doc_type, regexp_extract_all(lower(content), '[a-z0-9]+') AS t FROM chunks),
sizes AS (SELECT doc_type, count(*) AS docs, avg(len(t)) AS mean_length FROM split GROUP BY 1),
postings AS (SELECT chunk_id, doc_type, term, count(*) AS tf, any_value(n) AS length
  FROM (SELECT chunk_id, doc_type, len(t) AS n, unnest(t) AS term FROM split) WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
dfs AS (SELECT doc_type, term, count(*) AS df FROM postings GROUP BY ALL),
bm AS (SELECT query_id, chunk_id, doc_type,
  round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length))), 6) AS bm25
  FROM postings JOIN dfs USING (doc_type, term) JOIN sizes USING (doc_type) JOIN terms USING (term) GROUP BY ALL)"""
BM25 = f"{TERMS_SQL},\n{POSTINGS}"


@query(
    "h03_bm25",
    f"""WITH {CHUNKS}, {BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_type ORDER BY bm25 DESC, chunk_id) AS trank FROM bm WHERE bm25 > 0)
    SELECT query_id, chunk_id, doc_type, bm25, trank FROM r WHERE trank <= 100""",
)
def h03(spark, d):
    return search.bm25_arm(a.chunks(spark, d), query_terms(spark), ["doc_type"]).withColumn("trank", F.col("trank").cast("bigint"))


@query(
    "h04_merge_by_score",
    f"""WITH {CHUNKS}, {BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, chunk_id) AS trank FROM bm WHERE bm25 > 0)
    SELECT query_id, chunk_id, doc_type, bm25, trank FROM r WHERE trank <= 100""",
)
def h04(spark, d):
    """One ranking over the union of the sources' lists, each scored with its own statistics."""
    return search.bm25_arm(a.chunks(spark, d), query_terms(spark), ["doc_type"], rank_by=[]).withColumn("trank", F.col("trank").cast("bigint"))


#: Hybrid questions: every embedding whose id is divisible by 20, with the first eight words of the document of the same id.
QUESTION_WORDS = 8
HYBRID = "hq AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 20 = 0)"
HYBRID_TERMS = f"""terms AS (SELECT DISTINCT doc_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')[1:{QUESTION_WORDS}]) AS term
  FROM documents WHERE doc_id IN (SELECT query_id FROM hq))"""
ARMS = f"""{HYBRID}, {HYBRID_TERMS}, {POSTINGS},
vs AS (SELECT hq.query_id, e.vec_id AS chunk_id, c.doc_type,
    round(list_dot_product(e.embedding::DOUBLE[], hq.v::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(hq.v::DOUBLE[], hq.v::DOUBLE[]))), 6) AS similarity
  FROM embeddings e, hq, chunks c WHERE c.chunk_id = e.vec_id),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_type ORDER BY similarity DESC, chunk_id) AS vrank FROM vs),
tr AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_type ORDER BY bm25 DESC, chunk_id) AS trank FROM bm WHERE bm25 > 0),
fused AS (SELECT coalesce(v.query_id, t.query_id) AS query_id, coalesce(v.chunk_id, t.chunk_id) AS chunk_id, coalesce(v.doc_type, t.doc_type) AS doc_type, vrank, trank,
    round(coalesce(1.0::DOUBLE / (60 + vrank), 0) + coalesce(1.0::DOUBLE / (60 + trank), 0), 6) AS rrf
  FROM (SELECT * FROM vr WHERE vrank <= 100) v FULL JOIN (SELECT * FROM tr WHERE trank <= 100) t ON v.query_id = t.query_id AND v.chunk_id = t.chunk_id)"""


def question_terms(spark, d, questions):
    # the text up to the last word that is asked, so that the others aren't taken apart
    start = F.regexp_extract(F.lower("text"), f"^(?:[^a-z0-9]*+[a-z0-9]++){{1,{QUESTION_WORDS}}}", 0)
    words = search.tokens(start).alias("_words")
    docs = a.table(spark, d, "documents").where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), words)
    # an inner join: a semi join would be moved below the words, and whole texts be shuffled
    return docs.join(questions.select("query_id"), "query_id").select("query_id", F.explode("_words").alias("term")).distinct()


def _arms(spark, d, chunks=None):
    q = query_vectors(spark, d)
    vectors = a.table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    rows = chunks if chunks is not None else a.chunks(spark, d)
    vec = search.vector_arm(rows.join(vectors, "chunk_id", "left"), q, ["doc_type"])
    return vec, search.bm25_arm(rows, question_terms(spark, d, q), ["doc_type"])


def _fused(spark, d, pool=10_000):
    """Both arms of every question per source, fused."""
    q, rows = query_vectors(spark, d), a.chunks(spark, d)
    vectors = a.table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    return search.hybrid(rows, rows.select("chunk_id", "doc_type").join(vectors, "chunk_id"), q, question_terms(spark, d, q), ["doc_type"], pool=pool)


@query("h05_rrf", f"WITH {CHUNKS}, {ARMS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, chunk_id) AS rank FROM fused) SELECT query_id, chunk_id, doc_type, vrank, trank, rrf, rank FROM r WHERE rank <= 50")
def h05(spark, d):
    """The flagship: both arms per source, fused, the 50 best of each question."""
    own = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rrf"), "chunk_id"))
    fused = _fused(spark, d).drop("rank").withColumn("rank", own).where("rank <= 50")
    return fused.select("query_id", "chunk_id", "doc_type", F.col("vrank").cast("bigint").alias("vrank"), F.col("trank").cast("bigint").alias("trank"), "rrf", F.col("rank").cast("bigint").alias("rank"))


@query("h06_pools", f"WITH {CHUNKS}, {ARMS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_type ORDER BY rrf DESC, chunk_id) AS rank FROM fused) SELECT query_id, chunk_id, doc_type, rrf, rank FROM r WHERE rank <= 50")
def h06(spark, d):
    """A pool of 50 for each source."""
    return _fused(spark, d, search.POOL).select("query_id", "chunk_id", "doc_type", "rrf", F.col("rank").cast("bigint").alias("rank"))


@query(
    "h07_floor",
    f"""WITH {CHUNKS}, {ARMS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, chunk_id) AS rank,
      row_number() OVER (PARTITION BY query_id, doc_type ORDER BY rrf DESC, chunk_id) AS own FROM fused)
    SELECT query_id, chunk_id, doc_type, rrf, rank > 50 AS floor FROM r WHERE rank <= 50 OR own <= 3""",
)
def h07(spark, d):
    """One global pool of 50, and three of each source that it has too few of."""
    fused = _fused(spark, d).select("query_id", "chunk_id", "doc_type", "rrf")
    return search.pool_with_floor(fused, "doc_type", 50, 3)


@query(
    "h09_merge_cap",
    f"""WITH {CHUNKS}, {ARMS}, p AS (SELECT f.query_id, f.chunk_id, c.year AS reading, row_number() OVER (PARTITION BY f.query_id, c.year ORDER BY rrf DESC, f.chunk_id) AS position
      FROM fused f JOIN chunks c USING (chunk_id)
      UNION ALL SELECT f.query_id, f.chunk_id, 0, row_number() OVER (PARTITION BY f.query_id ORDER BY rrf DESC, f.chunk_id) FROM fused f),
    d AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY position, reading) AS f FROM p),
    m AS (SELECT query_id, chunk_id, reading, position, row_number() OVER (PARTITION BY query_id ORDER BY position, reading) AS merged_rank FROM d WHERE f = 1)
    SELECT * FROM m WHERE merged_rank <= 600""",
)
def h09(spark, d):
    """A reading per edition year and one over all years, merged turn by turn under the cap."""
    fused = _fused(spark, d).select("query_id", "chunk_id", "rrf")
    years = a.chunks(spark, d).select("chunk_id", F.explode(F.array(F.col("year"), F.lit(0))).alias("reading"))
    position = F.row_number().over(Window.partitionBy("query_id", "reading").orderBy(F.desc("rrf"), "chunk_id"))
    # dealt once, by question: all that is ranked after belongs to one
    pools = fused.join(years, "chunk_id").repartition("query_id").withColumn("position", position).where(F.col("position") <= search.MERGED_CAP)  # later ones are past the cap
    return search.round_robin(pools).select("query_id", "chunk_id", "reading", F.col("position").cast("bigint").alias("position"), F.col("merged_rank").cast("bigint").alias("merged_rank"))


#: A deterministic scorer: 16 bits of md5(query:chunk), as a share.
SCORES = """scores AS (SELECT q AS query_id, chunk_id, doc_type, plan_code, year, round(('0x' || substr(md5(q || ':' || chunk_id), 1, 4))::BIGINT / 65535.0::DOUBLE, 6) AS score
  FROM chunks, (SELECT unnest(range(0, 3)) AS q))"""


def scores(spark, d):
    """A stand-in for a reranker: any column of scores does."""
    rows = a.chunks(spark, d).withColumn("query_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))))
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("query_id").cast("string"), F.col("chunk_id").cast("string"))), 1, 4), 16, 10).cast("double")
    return rows.select("query_id", "chunk_id", "doc_type", "plan_code", "year", F.round(h / 65535.0, 6).alias("score"))


@query(
    "h19_plan_seats",
    f"""WITH {CHUNKS}, {SCORES}, s AS (SELECT *, plan_code IS NOT NULL AND row_number() OVER (PARTITION BY query_id, plan_code ORDER BY score DESC, chunk_id) = 1 AS seat FROM scores),
    l AS (SELECT *, min(CASE WHEN seat THEN score END) OVER (PARTITION BY query_id) AS lowest FROM s),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (seat OR (plan_code IS NULL AND score >= lowest)) DESC, score DESC, chunk_id) AS position FROM l)
    SELECT query_id, chunk_id, plan_code, score, seat, position FROM o WHERE position <= 10""",
)
def h19(spark, d):
    return search.plan_seats(scores(spark, d), 10).select("query_id", "chunk_id", "plan_code", "score", "seat", F.col("position").cast("bigint").alias("position"))


@query(
    "h20_plan_dedupe",
    f"""WITH {CHUNKS}, {SCORES}, s AS (SELECT *, row_number() OVER (PARTITION BY query_id, plan_code ORDER BY score DESC, chunk_id) AS own FROM scores),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS position FROM s WHERE plan_code IS NULL OR own <= 2)
    SELECT query_id, chunk_id, plan_code, score, position FROM o WHERE position <= 10""",
)
def h20(spark, d):
    return search.at_most_per_plan(scores(spark, d), 10).select("query_id", "chunk_id", "plan_code", "score", F.col("position").cast("bigint").alias("position"))


@query(
    "h21_year_lanes",
    f"""WITH {CHUNKS}, {SCORES}, s AS (SELECT *, row_number() OVER (PARTITION BY query_id, year ORDER BY score DESC, chunk_id) AS own FROM scores WHERE year IN (2025, 2026)),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (own <= 5) DESC, CASE WHEN own <= 5 THEN own END NULLS LAST, CASE WHEN own <= 5 THEN -year END, score DESC, chunk_id) AS position FROM s)
    SELECT query_id, chunk_id, year, score, position FROM o WHERE position <= 10""",
)
def h21(spark, d):
    return search.year_lanes(scores(spark, d), [2025, 2026], 10).select("query_id", "chunk_id", "year", "score", F.col("position").cast("bigint").alias("position"))


@query(
    "h22_abstain",
    f"""WITH {CHUNKS}, {SCORES}, s AS (SELECT s.*, CASE WHEN member_scoped THEN 0.1 ELSE 0.7 END AS bar, hash_group FROM scores s JOIN (SELECT chunk_id, member_scoped, chunk_id % 25 AS hash_group FROM chunks) USING (chunk_id))
    SELECT query_id * 100 + hash_group AS query_id, max(score) AS confidence, NOT bool_or(score >= bar) AS abstained FROM s GROUP BY 1""",
)
def h22(spark, d):
    """Each query's candidates split into 25 question slices; record sources have a lower bar."""
    rows = scores(spark, d).join(a.chunks(spark, d).select("chunk_id", "member_scoped"), "chunk_id").withColumn("query_id", F.col("query_id") * 100 + F.col("chunk_id") % 25)
    return search.abstain(rows, F.when(F.col("member_scoped"), 0.1).otherwise(0.7))


def _counts(name: str, sql_where: str, keep):
    @query(name, f"WITH {CHUNKS} SELECT doc_type, count(*) AS chunks FROM chunks WHERE {sql_where} GROUP BY 1")
    def run(spark, d):
        return a.chunks(spark, d).where(keep()).groupBy("doc_type").agg(F.count(F.lit(1)).alias("chunks"))

    return run


_counts("g01_record_filter", "policy_id IS NULL OR policy_id = 'CP-12'", lambda: filters.record_filter("policy_id", "CP-12"))
_counts("g02_record_list", "policy_id IS NULL OR policy_id IN ('CP-12', 'CP-3')", lambda: filters.record_filter("policy_id", ["CP-12", "CP-3"]))
_counts("g03_version_window", "NOT versioned OR (effective_from <= DATE '2024-06-30' AND (effective_to IS NULL OR effective_to > DATE '2024-06-30'))", lambda: filters.version_window("2024-06-30"))
_counts("g04_leaf_bypass", "NOT versioned OR policy_id = 'CP-12' OR (effective_from <= DATE '2022-01-31' AND (effective_to IS NULL OR effective_to > DATE '2022-01-31'))", lambda: filters.version_window("2022-01-31", F.coalesce(F.col("policy_id") == "CP-12", F.lit(False))))
_counts("g05_options", "section_options IS NULL OR len(section_options) = 0 OR list_has_any(section_options, ['Standard'])", lambda: filters.options(("Standard",)))
_counts("g06_edition", "year IN (2025, 2026) OR event", lambda: filters.edition((2025, 2026)))
_counts("g07_member_scope", "NOT member_scoped OR member_key = 17", lambda: filters.member_scope(17))
_counts("g07_no_member", "NOT member_scoped", lambda: filters.member_scope(None))
_counts("g08_plan_null_passes", "plan_code IS NULL OR plan_code IN ('104', '10P')", lambda: filters.plan(("104", "10P")))
_counts(
    "g09_all_filters",
    """(NOT versioned OR (effective_from <= DATE '2025-12-31' AND (effective_to IS NULL OR effective_to > DATE '2025-12-31'))) AND (NOT member_scoped OR member_key = 17)
       AND (policy_id IS NULL OR policy_id = 'CP-12') AND (year IN (2024, 2025) OR event) AND (plan_code IS NULL OR plan_code IN ('104', '105'))
       AND (section_options IS NULL OR len(section_options) = 0 OR list_has_any(section_options, ['High'])) AND doc_type IN ('src1', 'src5', 'src8', 'src12')""",
    lambda: filters.all_of(Route(years=(2024, 2025), plan_codes=("104", "105"), options=("High",), sources=("src1", "src5", "src8", "src12"), record={"policy_id": "CP-12"}, member_key=17)),
)


@query(
    "g10_identifier_shape",
    """SELECT conv_id, turn, len(list_filter(regexp_extract_all(text, '[A-Za-z0-9-]{7,}'), lambda r: length(regexp_replace(r, '[^0-9]', '', 'g')) >= 3)) > 0 AS shaped FROM conversations""",
)
def g10(spark, d):
    return a.table(spark, d, "conversations").select("conv_id", "turn", filters.identifier_shaped(F.col("text")).alias("shaped"))


def _visible(p: str) -> str:
    more = "".join(f" OR (acl_tag = '{t}' AND cited)" for t in CITED_TIERS.get(p, []))
    return f"SELECT '{p}' AS persona, acl_tag, count(*) AS chunks FROM seen WHERE acl_tag IN ({', '.join(repr(t) for t in PERSONA_TIERS[p])}){more} GROUP BY ALL"


SEEN = f"""{CHUNKS}, {EVIDENCE}, seen AS (SELECT *, EXISTS (SELECT 1 FROM evidence e WHERE e.document_title = c.title
  AND e.kind = CASE c.acl_tag WHEN 'care_team' THEN 'clinical_note' WHEN 'member_services' THEN 'call_note' END) AS cited FROM chunks c)"""


def seen(spark, d):
    return with_citations(a.chunks(spark, d), a.appeal_evidence(spark, d))


def readers():
    """The personas that may see a chunk (acl_tag, cited)."""
    return F.filter(F.array(*[F.when(F.coalesce(visible(Principal(p)), F.lit(False)), F.lit(p)) for p in PERSONA_TIERS]), lambda p: p.isNotNull())


@query("s01_visibility", f"WITH {SEEN} " + " UNION ALL ".join(_visible(p) for p in PERSONA_TIERS))
def s01(spark, d):
    """Every chunk is read once, and counts for each persona that may see it."""
    return seen(spark, d).select("acl_tag", F.explode(readers()).alias("persona")).groupBy("persona", "acl_tag").agg(F.count(F.lit(1)).alias("chunks"))


@query("s02_relational", f"WITH {SEEN} SELECT chunk_id, acl_tag, cited FROM seen")
def s02(spark, d):
    return seen(spark, d).select("chunk_id", "acl_tag", "cited")


@query(
    "c08_flag_drift",
    f"""WITH {SEEN} SELECT acl_tag, count(*) FILTER (WHERE cited IS DISTINCT FROM (chunk_id % 11 = 0)) AS drifted FROM seen GROUP BY 1""",
)
def c08(spark, d):
    """Stored flags (here: one chunk in eleven) against the recomputed truth."""
    stale = F.col("chunk_id") % 11 == 0
    return seen(spark, d).groupBy("acl_tag").agg(F.count_if(~F.col("cited").eqNullSafe(stale)).alias("drifted"))


@query(
    "s01_filter_before_rank",
    f"""WITH {SEEN}, {SCORES}, v AS (SELECT s.query_id, s.chunk_id, s.score, acl_tag, row_number() OVER (PARTITION BY query_id ORDER BY s.score DESC, s.chunk_id) AS rank
      FROM scores s JOIN seen USING (chunk_id) WHERE acl_tag IN ('public', 'employee', 'appeals') OR (cited AND acl_tag IN ('care_team', 'member_services')))
    SELECT * FROM v WHERE rank <= 8""",
)
def s01_rank(spark, d):
    """A limit counts what the persona sees: policy first, rank second."""
    rows = scores(spark, d).join(seen(spark, d).where(visible(Principal("appeals"))).select("chunk_id", "acl_tag"), "chunk_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return rows.withColumn("rank", rank.cast("bigint")).where("rank <= 8").select("query_id", "chunk_id", "score", "acl_tag", "rank")


assert set(CITATION_KIND) == {"care_team", "member_services"}
