"""Queries of what is kept up to date: flags that follow evidence, versions that arrive late, the vector index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.lineage import cut, fresh_folder
from ..operators import vector_index as vi
from ..operators.flags import FlagStore, chunk_flags
from ..operators.search import vector_arm, vector_scores
from ..streaming import propagation
from . import adapters as a
from .adapters import CHUNKS, EVIDENCE
from .registry import query
from .retrieval import chunks_with_vectors, query_vectors, readers, seen

#: Evidence after two batches of changes: of each seven cases one is deleted, one moves to another title, one changes kind.
CHANGED = f"""{EVIDENCE}, later AS (SELECT case_id, CASE WHEN case_id % 7 = 2 THEN 'doc-' || (case_id + 500) % 997 ELSE document_title END AS document_title,
  CASE WHEN case_id % 7 = 3 THEN CASE kind WHEN 'call_note' THEN 'clinical_note' ELSE 'call_note' END ELSE kind END AS kind FROM evidence WHERE case_id % 7 <> 1)"""


@query(
    "c07_incremental_flags",
    f"""WITH {CHUNKS}, {CHANGED} SELECT chunk_id, EXISTS (SELECT 1 FROM later e WHERE e.document_title = c.title
      AND e.kind = CASE c.acl_tag WHEN 'care_team' THEN 'clinical_note' WHEN 'member_services' THEN 'call_note' END) AS cited FROM chunks c""",
)
def c07(spark, d):
    """Flags after inserts, then deletes, then updates of evidence, each batch taken up alone; the twin recomputes all."""
    evidence, chunks = a.appeal_evidence(spark, d), a.chunks(spark, d)
    documents = chunks.select(F.col("chunk_id").alias("document_id"), "title", "acl_tag")
    store = FlagStore(spark, fresh_folder(spark, "flags"))
    case, none = F.col("case_id"), F.lit(None).cast("string")
    side = lambda title, kind: [title.alias("title"), kind.alias("kind")]
    old = [F.col("document_title").alias("old_title"), F.col("kind").alias("old_kind")]
    inserts = evidence.select(F.lit("insert").alias("op"), none.alias("old_title"), none.alias("old_kind"), *side(F.col("document_title"), F.col("kind")))
    deletes = evidence.where(case % 7 == 1).select(F.lit("delete").alias("op"), *old, *side(none, none))
    other = F.when(F.col("kind") == "call_note", "clinical_note").otherwise("call_note")
    moved = F.when(case % 7 == 2, F.concat(F.lit("doc-"), (case + 500) % 997)).otherwise(F.col("document_title"))
    updates = evidence.where((case % 7).isin(2, 3)).select(F.lit("update").alias("op"), *old, *side(moved, F.when(case % 7 == 3, other).otherwise(F.col("kind"))))
    for number, changes in enumerate((inserts, deletes, updates)):
        store.apply(documents, changes, number)
    return chunk_flags(chunks.withColumn("document_id", F.col("chunk_id")), store.flags()).select("chunk_id", "cited")


@query(
    "u05_version_intervals",
    f"""WITH {CHUNKS} SELECT policy_id AS key, chunk_id AS version, effective_from, lead(effective_from) OVER (PARTITION BY policy_id ORDER BY effective_from, chunk_id) AS effective_to
    FROM chunks WHERE policy_id IS NOT NULL AND effective_from IS NOT NULL""",
)
def u05(spark, d):
    """Versions of every policy as a stream over the documents' files, in whatever order these come."""
    documents = a.table(spark, d, "documents")
    out = fresh_folder(spark, "versions")
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(documents.schema).option("maxFilesPerTrigger", 1000).parquet(f"{d}/documents.parque[t]")  # a pattern stands for a file or a folder
        versions = a.chunk_columns(stream).where("policy_id is not null").select(F.col("policy_id").alias("key"), F.col("chunk_id").alias("version"), "effective_from")
        changes = propagation.version_intervals(versions)
        writing = changes.writeStream.outputMode("update").option("checkpointLocation", f"{out}/state").trigger(availableNow=True)
        writing.foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{out}/changes/batch={n}")).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    return propagation.held_intervals(spark.read.parquet(f"{out}/changes").drop("batch"))


def _index(spark, d):
    rows = chunks_with_vectors(spark, d).where("vector is not null").select("chunk_id", "vector", "title", "acl_tag")
    centroids = vi.fit_centroids(rows)
    path = fresh_folder(spark, "index")
    vi.write_index(rows, centroids, path)
    return rows, spark.read.parquet(path), centroids


#: Mean recall that an index must reach on its sample of queries.
TARGET = 0.92


@query("t12_index_recall")
def t12(spark, d):
    """Recall@10 of the partitioned index by the number of cells probed, for every stated query vector against all rows.

    ``chosen`` marks the least number that reaches the target on a sample of queries.
    """
    rows, index, centroids = _index(spark, d)
    queries = query_vectors(spark, d)
    chosen, _ = vi.calibrated_probes(rows, index, queries, centroids, 10, TARGET)
    exact = vector_arm(rows, queries, [], 10)
    numbers = sorted({max(1, len(centroids) // 8), max(1, len(centroids) // 3), chosen})
    measured = [vi.recall(exact, vi.probe(index, queries, centroids, n, 10), 10).withColumn("probes", F.lit(n)) for n in numbers]
    return vi.summary(reduce(lambda x, y: x.unionByName(y), measured), "probes").withColumn("chosen", F.col("probes") == chosen).withColumn("cells", F.lit(len(centroids)))


@query("t12_persona_recall")
def t12_personas(spark, d):
    """Recall@50 under each persona's policy: rows it may not see are gone before the rank, on both sides.

    Both sides score a row once for all personas: rows that the same personas may see are ranked together, and a persona's
    nearest are among those of the groups that it may see.
    """
    rows, index, centroids = _index(spark, d)
    queries = query_vectors(spark, d)
    chosen, _ = vi.calibrated_probes(rows, index, queries, centroids, 50, TARGET)
    cited = seen(spark, d).select("chunk_id", "cited")
    own = lambda t: t.join(cited, "chunk_id").withColumn("readers", F.array_join(readers(), ",")).where("readers <> ''").drop("title", "acl_tag", "cited")
    exact = vector_scores(own(rows), queries, ["readers"], 50)
    found = vi.probe_scores(cut(own(index)), queries, centroids, chosen, ["readers"], 50)
    return vi.summary(vi.recall(_by_reader(exact, 50), _by_reader(found, 50), 50, by=["persona"]), "persona")


def _by_reader(scores, top):
    """(query_id, chunk_id, similarity, persona, vrank): the nearest ``top`` of every question that each persona may see."""
    rank = lambda by: F.row_number().over(Window.partitionBy("query_id", by).orderBy(F.desc("similarity"), "chunk_id"))
    own = scores.repartition("query_id").withColumn("vrank", rank("readers")).where(F.col("vrank") <= top)  # before rows are made for each persona
    dealt = own.withColumn("persona", F.explode(F.split("readers", ","))).drop("readers")
    return dealt.withColumn("vrank", rank("persona")).where(F.col("vrank") <= top)


@query("h01_index_topk")
def h01_index(spark, d):
    """The vector arm through the index: the nearest 100 rows of every stated query vector in the probed cells."""
    rows, index, centroids = _index(spark, d)
    queries = query_vectors(spark, d)
    chosen, _ = vi.calibrated_probes(rows, index, queries, centroids, 10, TARGET)
    return vi.probe(index, queries, centroids, chosen, 100).withColumn("vrank", F.col("vrank").cast("bigint"))
