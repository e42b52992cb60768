"""Evaluation and monitoring queries; labels play a scored run, and document parity makes two runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluation as ev
from . import adapters as a
from .adapters import CHUNKS
from .registry import query
from .retrieval import SCORES, scores

SCORE_SQL = """eval AS (
  SELECT doc_id % 2 AS run_id, doc_id // 2 AS question_id, 'cat' || doc_id % 9 AS category, 'quality' AS metric, quality::DOUBLE AS value FROM labels
  UNION ALL SELECT doc_id % 2, doc_id // 2, 'cat' || doc_id % 9, 'guardrail', CASE WHEN doc_id % 23 = 0 THEN NULL ELSE 1.0 - toxic END FROM labels)"""


def tidy(spark, d):
    rows = a.table(spark, d, "labels")
    guard = F.when(F.col("doc_id") % 23 == 0, None).otherwise(1.0 - F.col("toxic"))
    pairs = F.explode(F.array(F.struct(F.lit("quality").alias("metric"), F.col("quality").cast("double").alias("value")), F.struct(F.lit("guardrail").alias("metric"), guard.alias("value"))))
    return rows.select((F.col("doc_id") % 2).alias("run_id"), F.floor(F.col("doc_id") / 2).alias("question_id"), F.concat(F.lit("cat"), F.col("doc_id") % 9).alias("category"), pairs.alias("m")).select("run_id", "question_id", "category", "m.*")


@query(
    "t03_item_verdicts",
    f"""WITH {SCORE_SQL} SELECT run_id, question_id, CASE WHEN min(value) < 1 THEN 'failed' WHEN bool_or(value IS NULL) THEN 'unverified' ELSE 'passed' END AS verdict FROM eval GROUP BY ALL""",
)
def t03(spark, d):
    return ev.item_verdicts(tidy(spark, d))


@query(
    "t04_rate_table",
    f"""WITH {SCORE_SQL}, g AS (SELECT category, count(*) AS n, sum(value)::BIGINT AS passed FROM eval WHERE metric = 'quality' GROUP BY 1)
    SELECT category, n, passed, round(passed / n, 6) AS rate,
      round(greatest(0, ((passed / n) + 3.841458820694124 / (2 * n) - 1.959963984540054 * sqrt((passed / n) * (1 - passed / n) / n + 3.841458820694124 / (4.0 * n * n))) / (1 + 3.841458820694124 / n)), 6) AS low,
      round(least(1, ((passed / n) + 3.841458820694124 / (2 * n) + 1.959963984540054 * sqrt((passed / n) * (1 - passed / n) / n + 3.841458820694124 / (4.0 * n * n))) / (1 + 3.841458820694124 / n)), 6) AS high FROM g""",
)
def t04(spark, d):
    return ev.rate_table(tidy(spark, d).where("metric = 'quality'"), "category")


@query("t04_failing_items", f"""WITH {SCORE_SQL} SELECT category, question_id FROM eval WHERE metric = 'quality' AND value < 1""")
def t04_items(spark, d):
    return ev.failing_items(tidy(spark, d).where("metric = 'quality'"), "category")


@query(
    "t06_paired_diff",
    f"""WITH {SCORE_SQL}, p AS (SELECT coalesce(x.metric, y.metric) AS metric, x.value AS b, y.value AS a FROM (SELECT * FROM eval WHERE run_id = 0) x
      FULL JOIN (SELECT * FROM eval WHERE run_id = 1) y ON x.question_id = y.question_id AND x.metric = y.metric)
    SELECT metric, count(*) FILTER (WHERE b < 1 AND a >= 1) AS gained, count(*) FILTER (WHERE b >= 1 AND a < 1) AS lost, count(*) FILTER (WHERE a IS NULL) AS only_before, count(*) FILTER (WHERE b IS NULL) AS only_after FROM p GROUP BY 1""",
)
def t06(spark, d):
    rows = tidy(spark, d)
    return ev.paired_diff(rows.where("run_id = 0"), rows.where("run_id = 1"))


@query(
    "t07_ratchet",
    f"""WITH {SCORE_SQL}, v AS (SELECT run_id, question_id, CASE WHEN min(value) < 1 THEN 'failed' WHEN bool_or(value IS NULL) THEN 'unverified' ELSE 'passed' END AS verdict FROM eval GROUP BY ALL)
    SELECT b.question_id, coalesce(c.verdict, 'missing') AS verdict FROM v b LEFT JOIN v c ON c.run_id = 1 AND c.question_id = b.question_id
    WHERE b.run_id = 0 AND b.verdict = 'passed' AND c.verdict IS DISTINCT FROM 'passed'""",
)
def t07(spark, d):
    v = ev.item_verdicts(tidy(spark, d))
    return ev.ratchet(v.where("run_id = 0"), v.where("run_id = 1"))


RANKED = f"""{SCORES}, ranked AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scores)"""


def ranked(spark, d):
    return scores(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")))


@query(
    "t01_hit_metrics",
    f"""WITH {CHUNKS}, {RANKED}, l AS (SELECT unnest(range(0, 3)) AS query_id, doc_id AS chunk_id FROM labels WHERE quality = 1),
    w AS (SELECT query_id, count(*) AS wanted FROM l GROUP BY 1),
    h AS (SELECT r.query_id, r.rank, l.chunk_id IS NOT NULL AS hit FROM ranked r LEFT JOIN l USING (query_id, chunk_id))
    SELECT query_id, coalesce(max(hit::INTEGER) FILTER (WHERE rank <= 5), 0) AS hit5, round(count(*) FILTER (WHERE rank <= 5 AND hit) / 5, 6) AS precision5,
      round(count(*) FILTER (WHERE rank <= 10 AND hit) / any_value(wanted), 6) AS coverage10 FROM h JOIN w USING (query_id) GROUP BY 1""",
)
def t01(spark, d):
    labels = a.table(spark, d, "labels").where("quality = 1").select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))).alias("query_id"), F.col("doc_id").alias("chunk_id"))
    return ev.retrieval_metrics(ranked(spark, d).where("rank <= 10").select("query_id", "chunk_id", "rank"), labels)


@query(
    "t08_health",
    f"""WITH {CHUNKS}, {RANKED}, n AS (SELECT r.*, md5(content) AS h, lead(score) OVER (PARTITION BY query_id ORDER BY rank) AS nxt FROM ranked r JOIN chunks USING (chunk_id) WHERE rank <= 8)
    SELECT query_id, round(max(score - nxt) FILTER (WHERE rank = 1), 6) AS margin, max(score - nxt) FILTER (WHERE rank = 1) < 0.005 AS tied, round(1 - count(DISTINCT h) / count(*), 6) AS duplicate_share FROM n GROUP BY 1""",
)
def t08(spark, d):
    """Over what a payload holds: the best eight."""
    rows = ranked(spark, d).where("rank <= 8").join(a.chunks(spark, d).select("chunk_id", F.md5("content").alias("content_hash")), "chunk_id")
    return ev.payload_health(rows)


@query(
    "t11_drift",
    """WITH s AS (SELECT vec_id, embedding, label % 2 AS g FROM embeddings), f AS (SELECT g, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS p FROM s),
    m AS (SELECT g, p, avg(x) AS m FROM f GROUP BY ALL)
    SELECT round(1 - sum(x.m * y.m) / (sqrt(sum(x.m * x.m)) * sqrt(sum(y.m * y.m))), 5) AS shift, 1 - sum(x.m * y.m) / (sqrt(sum(x.m * x.m)) * sqrt(sum(y.m * y.m))) > 0.02 AS alert
    FROM m x JOIN m y USING (p) WHERE x.g = 0 AND y.g = 1""",
)
def t11(spark, d):
    """Cosine shift between the centroids of two snapshots (labels by parity)."""
    rows = a.table(spark, d, "embeddings").select((F.col("label") % 2).alias("g"), "embedding")
    m = ev.centroid(rows, "embedding", ["g"])
    two = m.where("g = 0").select("position", F.col("mean").alias("x")).join(m.where("g = 1").select("position", F.col("mean").alias("y")), "position")
    shift = 1 - F.sum(F.col("x") * F.col("y")) / (F.sqrt(F.sum(F.col("x") * F.col("x"))) * F.sqrt(F.sum(F.col("y") * F.col("y"))))
    return two.agg(F.round(shift, 5).alias("shift"), (shift > 0.02).alias("alert"))


@query("l04_sample_by_hash", """SELECT vec_id, label FROM embeddings ORDER BY md5('v:' || vec_id) LIMIT 500""")
def l04(spark, d):
    """The drift sample: the 500 lowest by md5."""
    return a.table(spark, d, "embeddings").orderBy(F.md5(F.concat(F.lit("v:"), F.col("vec_id").cast("string")))).limit(500).select("vec_id", "label")


@query("t18_corpus_hash", """SELECT doc_id // 256 AS leaf, sha256(string_agg(md5(text), ',' ORDER BY doc_id)) AS corpus_hash FROM documents GROUP BY 1""")
def t18(spark, d):
    """Content hashes in order, hashed by ranges of 256 ids: leaves that two snapshots compare without one large group."""
    hashes = a.table(spark, d, "documents").select(F.floor(F.col("doc_id") / 256).alias("leaf"), F.struct("doc_id", F.md5("text").alias("h")).alias("x"))
    return hashes.groupBy("leaf").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("x"))["h"], ","), 256).alias("corpus_hash"))


@query("j09_length_histogram", """SELECT CASE WHEN length(text) < 0 THEN 0 WHEN length(text) >= 2000 THEN 9 ELSE length(text) // 250 + 1 END AS bucket, count(*) AS chunks FROM documents GROUP BY 1""")
def j09(spark, d):
    return a.table(spark, d, "documents").groupBy(F.expr("width_bucket(length(text), 0, 2000, 8)").alias("bucket")).agg(F.count(F.lit(1)).alias("chunks"))


@query(
    "j12_percentiles",
    """SELECT event_type, median(value) AS median, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.5) AS p50 FROM events GROUP BY 1""",
)
def j12(spark, d):
    """Latency figures: the interpolated median and nearest-rank percentiles."""
    return ev.percentiles(a.table(spark, d, "events"), "event_type", "value", [95, 50])


@query(
    "j06_filtered_aggregates",
    """SELECT category, avg(value) FILTER (WHERE metric = 'quality') AS quality, sum(value) FILTER (WHERE metric = 'guardrail')::BIGINT AS guarded, count(*) FILTER (WHERE value IS NULL) AS skipped
    FROM (WITH """ + SCORE_SQL + """ SELECT * FROM eval) GROUP BY 1 HAVING count(*) >= 20""",
)
def j06(spark, d):
    got = tidy(spark, d).groupBy("category").agg(F.avg(F.when(F.col("metric") == "quality", F.col("value"))).alias("quality"), F.sum(F.when(F.col("metric") == "guardrail", F.col("value"))).cast("bigint").alias("guarded"), F.count_if(F.col("value").isNull()).alias("skipped"), F.count(F.lit(1)).alias("_n"))
    return got.where("_n >= 20").drop("_n")


@query(
    "k03_latest_per_item",
    f"""WITH {SCORE_SQL} SELECT question_id, run_id, category FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY run_id DESC) AS r FROM eval WHERE metric = 'quality') WHERE r = 1""",
)
def k03(spark, d):
    newest = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("run_id")))
    return tidy(spark, d).where("metric = 'quality'").withColumn("_r", newest).where("_r = 1").select("question_id", "run_id", "category")


@query(
    "k05_previous_run",
    """WITH m AS (SELECT o_custkey, o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY ALL)
    SELECT o_custkey, day, n, lag(n) OVER (PARTITION BY o_custkey ORDER BY day) AS before FROM m""",
)
def k05(spark, d):
    days = a.table(spark, d, "orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return days.withColumn("before", F.lag("n").over(Window.partitionBy("o_custkey").orderBy("day")))


@query(
    "k06_as_of_lookup",
    """SELECT e.event_id, max(p.ts) AS last_purchase FROM events e LEFT JOIN events p ON p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts <= e.ts GROUP BY 1""",
)
def k06(spark, d):
    """As-of join by a running maximum over one sorted union per key, instead of a range join."""
    own = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).over(own)
    return a.table(spark, d, "events").select("event_id", last.alias("last_purchase"))


@query("m03_set_difference", """SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def m03(spark, d):
    return a.table(spark, d, "documents").select("doc_id").exceptAll(a.table(spark, d, "labels").select("doc_id").distinct())


@query(
    "t09_ablation",
    f"""WITH {CHUNKS}, {SCORES}, l AS (SELECT doc_id AS chunk_id FROM labels WHERE quality = 1),
    arms AS (SELECT 'score' AS arm, query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scores
      UNION ALL SELECT 'id', query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) FROM scores
      UNION ALL SELECT 'length', query_id, s.chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY length(content) DESC, s.chunk_id) FROM scores s JOIN chunks USING (chunk_id))
    SELECT arm, count(*) FILTER (WHERE rank <= 5 AND chunk_id IN (SELECT chunk_id FROM l)) AS hits FROM arms GROUP BY 1""",
)
def t09(spark, d):
    """One candidate table under several orders."""
    from functools import reduce

    rows = scores(spark, d).join(a.chunks(spark, d).select("chunk_id", F.length("content").alias("length")), "chunk_id")
    good = a.table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("chunk_id"), F.lit(1).alias("good"))
    arms = {"score": [F.desc("score"), F.asc("chunk_id")], "id": [F.asc("chunk_id")], "length": [F.desc("length"), F.asc("chunk_id")]}
    tops = [rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*by))).where("rank <= 5").select(F.lit(arm).alias("arm"), "chunk_id") for arm, by in arms.items()]
    top = reduce(lambda x, y: x.unionByName(y), tops)
    return top.join(good, "chunk_id", "left").groupBy("arm").agg(F.count("good").alias("hits"))
