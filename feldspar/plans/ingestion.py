"""Sources, incremental maintenance and sinks; two snapshots are derived from the documents by their ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest
from . import adapters as a
from .registry import query

SNAPSHOTS = """old AS (SELECT 'doc-' || doc_id AS source_path, sha256(text || '|v1') AS content_hash FROM documents WHERE doc_id % 10 <> 3),
new AS (SELECT 'doc-' || doc_id AS source_path, sha256(CASE WHEN doc_id % 17 = 4 THEN text || ' changed' ELSE text END || '|v1') AS content_hash FROM documents WHERE doc_id % 13 <> 5)"""


def snapshots(spark, d):
    docs = a.table(spark, d, "documents").withColumn("source_path", F.concat(F.lit("doc-"), "doc_id"))
    old = docs.where("doc_id % 10 <> 3").select("source_path", ingest.fingerprint(F.col("text"), "v1").alias("content_hash"))
    text = F.when(F.col("doc_id") % 17 == 4, F.concat("text", F.lit(" changed"))).otherwise(F.col("text"))
    return old, docs.where("doc_id % 13 <> 5").select("source_path", ingest.fingerprint(text, "v1").alias("content_hash")), docs


@query("c01_fingerprint", """SELECT doc_id, sha256(text || '|v1') AS fingerprint FROM documents""")
def c01(spark, d):
    return a.table(spark, d, "documents").select("doc_id", ingest.fingerprint(F.col("text"), "v1").alias("fingerprint"))


@query(
    "c02_diff_actions",
    f"""WITH {SNAPSHOTS}, bad AS (SELECT 'doc-' || doc_id AS source_path FROM documents WHERE length(text) < 300)
    SELECT coalesce(o.source_path, n.source_path) AS source_path, CASE WHEN n.content_hash IS NULL THEN 'gone' WHEN o.content_hash = n.content_hash THEN 'skipped'
      WHEN coalesce(o.source_path, n.source_path) IN (SELECT source_path FROM bad) THEN 'quarantined' WHEN o.content_hash IS NULL THEN 'ingested' ELSE 'reingested' END AS action
    FROM old o FULL JOIN new n ON o.source_path = n.source_path""",
)
def c02(spark, d):
    old, new, docs = snapshots(spark, d)
    return ingest.diff_actions(old, new, docs.where(F.length("text") < 300).select("source_path"))


@query("c03_gone", f"WITH {SNAPSHOTS} SELECT source_path FROM old WHERE source_path NOT IN (SELECT source_path FROM new)")
def c03(spark, d):
    old, new, _ = snapshots(spark, d)
    return old.join(new, "source_path", "left_anti").select("source_path")


@query(
    "c05_rebuild_copies",
    """SELECT count(*) AS chunks, count(*) FILTER (WHERE doc_id % 4 = 0 AND text <> 'doc-' || doc_id || ': ' || text) AS same_copy,
      count(*) FILTER (WHERE doc_id % 4 = 0 AND v) AS vectors FROM (SELECT doc_id, text, doc_id IN (SELECT vec_id FROM embeddings) AS v FROM documents)""",
)
def c05(spark, d):
    """Only chunks whose stored copy is out of date (three of four) lose their vector."""
    new = F.concat(F.lit("doc-"), "doc_id", F.lit(": "), "text")
    stored = a.table(spark, d, "documents").withColumn("index_text", F.when(F.col("doc_id") % 4 == 0, new).otherwise(F.col("text")))
    stored = stored.join(a.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), "doc_id", "left")
    fresh = ingest.rebuild_copies(stored, new)
    return fresh.agg(F.count(F.lit(1)).alias("chunks"), F.count_if((F.col("doc_id") % 4 == 0) & (F.col("index_text") == new)).alias("same_copy"), F.count("vector").alias("vectors"))


@query("c06_to_embed", """SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)""")
def c06(spark, d):
    """Chunks without a vector: what a resumable embedding run takes next."""
    return a.table(spark, d, "documents").join(a.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti").select("doc_id")


@query("c10_backfill_source", """SELECT d.doc_id, k.source_id FROM documents d JOIN (SELECT source, dense_rank() OVER (ORDER BY source) AS source_id FROM (SELECT DISTINCT source FROM documents)) k USING (source)""")
def c10(spark, d):
    """Source numbers by name; the registry of sources is one row a source."""
    from pyspark.sql import Window

    docs = a.table(spark, d, "documents")
    keys = docs.select("source").distinct().withColumn("source_id", F.dense_rank().over(Window.orderBy("source")).cast("bigint"))
    return docs.join(keys, "source").select("doc_id", "source_id")


@query(
    "b05_insert_if_absent",
    """WITH existing AS (SELECT DISTINCT text FROM documents WHERE doc_id % 2 = 0) SELECT min(doc_id) AS doc_id, md5(text) AS h FROM documents WHERE doc_id % 2 = 1 AND text NOT IN (SELECT text FROM existing) GROUP BY text""",
)
def b05(spark, d):
    docs = a.table(spark, d, "documents").select("doc_id", F.md5("text").alias("h"))
    return ingest.insert_if_absent(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), ["h"])


@query(
    "b06_conditional_upsert",
    """SELECT doc_id, CASE WHEN toxic = 1 THEN 'model' ELSE 'new' END AS origin FROM labels UNION ALL
    SELECT doc_id, 'new' FROM documents WHERE doc_id % 5 = 0 AND doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def b06(spark, d):
    """Existing rows that a model made stay; all others are replaced."""
    existing = a.table(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "model").otherwise("rule").alias("origin"))
    rows = a.table(spark, d, "documents").select("doc_id").where("doc_id % 5 = 0").union(existing.select("doc_id")).distinct().withColumn("origin", F.lit("new"))
    return ingest.upsert_unless(existing, rows, ["doc_id"], "origin = 'model'")


@query("a07_manifest", """SELECT event_id, event_type AS stem, (props::JSON->>'$.k')::BIGINT AS k, year(ts)::INTEGER AS year FROM events""")
def a07(spark, d):
    """Manifest records: a stem, a typed field and the rest as a map."""
    rest = F.map_filter(F.from_json("props", "map<string,string>"), lambda k, _: k != F.lit("reserved"))
    return a.table(spark, d, "events").select("event_id", F.col("event_type").alias("stem"), rest["k"].cast("bigint").alias("k"), F.year("ts").alias("year"))


@query("a09_cells", """SELECT plan_code, y::INTEGER AS year FROM (SELECT unnest(['104','105','106','10P','11P','12P']) AS plan_code), (SELECT unnest(range(2021, 2027)) AS y) WHERE plan_code NOT LIKE '%P' OR y >= 2025""")
def a09(spark, d):
    """Brochure cells: every plan in the years that it is offered."""
    years = a.chunks(spark, d).select("year").distinct()
    cells = years.withColumn("plan_code", F.explode(F.array(*[F.lit(p) for p in a.PLAN_CODES])))
    return cells.where(~F.col("plan_code").endswith("P") | (F.col("year") >= 2025)).select("plan_code", "year")


@query("m02_union_first_wins", """SELECT doc_id, min(CASE WHEN src = 1 THEN 'labels' ELSE 'documents' END) FILTER (WHERE src = first) AS origin FROM (SELECT *, min(src) OVER (PARTITION BY doc_id) AS first FROM (SELECT doc_id, 1 AS src FROM labels UNION ALL SELECT doc_id, 2 FROM documents)) GROUP BY 1""")
def m02(spark, d):
    """A union in which the first list that has an id wins."""
    both = a.table(spark, d, "labels").select("doc_id", F.lit(1).alias("src")).union(a.table(spark, d, "documents").select("doc_id", F.lit(2)))
    return both.groupBy("doc_id").agg(F.min("src").alias("src")).select("doc_id", F.when(F.col("src") == 1, "labels").otherwise("documents").alias("origin"))
