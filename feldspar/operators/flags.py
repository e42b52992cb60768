"""Flags that follow evidence: a change log of evidence rows becomes changes of the flags of the documents it touches.

Evidence is a multiset of (title, kind); what is stored are signed counts, a folder per batch, and the flags that a batch
changed. A batch reads the counts of the title buckets it touches, the documents of its titles, and the flags of these, and
appends what is different; nothing is recomputed for other documents. A batch that is delivered twice writes the same
folder again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .governance import CITATION_KIND

BUCKETS = 64
COUNTS = "title string, kind string, n bigint, bucket int, batch bigint"
FLAGS = "document_id bigint, title string, acl_tag string, cited boolean, bucket int, batch bigint"


def bucket_of(title: str = "title"):
    return F.pmod(F.hash(title), F.lit(BUCKETS))


def evidence_deltas(changes: DataFrame) -> DataFrame:
    """(title, kind, n) of a change log (op, old_title, old_kind, title, kind): +1 for each new row, -1 for each old one.

    Inserts have no old side, deletes no new one, updates both; a side with a null title or kind counts for nothing.
    Changes that undo each other leave no row.
    """
    side = lambda title, kind, n: F.struct(F.col(title).alias("title"), F.col(kind).alias("kind"), F.lit(n).cast("bigint").alias("n"))
    new = F.when(F.col("op").isin("insert", "update"), side("title", "kind", 1))
    old = F.when(F.col("op").isin("delete", "update"), side("old_title", "old_kind", -1))
    flat = changes.select(F.explode(F.filter(F.array(new, old), lambda s: s.isNotNull())).alias("s")).select("s.*")
    return flat.where("title is not null and kind is not null").groupBy("title", "kind").agg(F.sum("n").alias("n")).where("n <> 0")


class FlagStore:
    """Stored counts and flags under a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _read(self, name: str, schema: str, before: int | None) -> DataFrame:
        # a folder a batch: the partition filter prunes later ones
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")
        return rows if before is None else rows.where(F.col("batch") < before)

    def _write(self, rows: DataFrame, name: str, batch: int) -> None:
        # a file or a few in each bucket's folder
        rows.drop("batch").repartition("bucket", F.pmod(F.xxhash64("title", rows.columns[0]), F.lit(4))).write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")

    def flags(self, before: int | None = None) -> DataFrame:
        """(document_id, title, acl_tag, cited): the last flag of every document that ever had one."""
        last = F.max_by(F.struct("title", "acl_tag", "cited"), F.col("batch")).alias("s")
        return self._read("flags", FLAGS, before).groupBy("document_id").agg(last).select("document_id", "s.*")

    def counts(self, before: int | None = None) -> DataFrame:
        """(title, kind, n) of the evidence there is."""
        return self._read("counts", COUNTS, before).groupBy("title", "kind").agg(F.sum("n").alias("n")).where("n > 0")

    def apply(self, documents: DataFrame, changes: DataFrame, batch: int) -> DataFrame:
        """Takes a batch of changes up; returns the (document_id, title, acl_tag, cited) that it changed.

        ``documents`` is (document_id, title, acl_tag). The touched titles' buckets are looked up first, so stored counts
        and flags are pruned to their folders.
        """
        deltas = cut(evidence_deltas(changes).withColumn("bucket", bucket_of()))
        touched = [r.bucket for r in deltas.select("bucket").distinct().collect()]  # at most BUCKETS numbers
        titles = deltas.select("title", "bucket").distinct()
        stored = self._read("counts", COUNTS, batch).where(F.col("bucket").isin(touched)).join(titles, ["title", "bucket"], "left_semi")
        totals = stored.select("title", "kind", "n").union(deltas.select("title", "kind", "n")).groupBy("title", "kind").agg(F.sum("n").alias("n"))
        kind = F.create_map(*[F.lit(x) for kv in CITATION_KIND.items() for x in kv])[F.col("acl_tag")]
        own = documents.select("document_id", "title", "acl_tag", kind.alias("kind")).join(titles, "title")
        now = own.join(totals.where("n > 0"), ["title", "kind"], "left").select("document_id", "title", "acl_tag", F.col("n").isNotNull().alias("cited"), "bucket")
        before = self._read("flags", FLAGS, batch).where(F.col("bucket").isin(touched)).groupBy("document_id").agg(F.max_by("cited", "batch").alias("was"))
        changed = cut(now.join(before, "document_id", "left").where(F.col("cited") != F.coalesce("was", F.lit(False))).drop("was"))
        self._write(changed, "flags", batch)
        self._write(deltas, "counts", batch)
        return changed.drop("bucket")

    def apply_documents(self, documents: DataFrame, batch: int) -> DataFrame:
        """Flags of new documents, and of those whose title or tier changed, from the evidence there is."""
        own = documents.select("document_id", "title", "acl_tag").withColumn("bucket", bucket_of())
        kind = F.create_map(*[F.lit(x) for kv in CITATION_KIND.items() for x in kv])[F.col("acl_tag")]
        now = own.withColumn("kind", kind).join(self.counts(batch), ["title", "kind"], "left").select("document_id", "title", "acl_tag", F.col("n").isNotNull().alias("cited"), "bucket")
        changed = cut(now.join(self.flags(batch), ["document_id", "title", "acl_tag", "cited"], "left_anti"))
        self._write(changed, "flags", batch)
        return changed.drop("bucket")


def chunk_flags(chunks: DataFrame, flags: DataFrame) -> DataFrame:
    """``chunks`` with ``cited`` of their document; false where it has no flag."""
    own = flags.select("document_id", F.col("cited").alias("_cited"))
    return chunks.join(own, "document_id", "left").withColumn("cited", F.coalesce("_cited", F.lit(False))).drop("_cited")
