"""A duplicate index that outlives a run: stored signatures of originals, which later runs start from, and forget.

A record's signature is its set of three-word shingles without the header line; records of one source alone are compared.
What is stored are the originals of each run and the ids that were forgotten, both append-only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .near import first_seen, named_pairs
from .search import small

SIGNATURES = "source string, doc_id bigint, key string, s array<bigint>, run bigint"
FORGOTTEN = "doc_id bigint, run bigint, how string"


def record_sets(records: DataFrame) -> DataFrame:
    """(doc_id, source, s, key) of (doc_id, source, text): shingles of the text after its first line, in any script.

    A text of one line is taken whole; fewer than three words are one shingle, none (null too) the empty one, so empty
    records of a source are equal. Shingles belong to their source.
    """
    text = F.coalesce("text", F.lit(""))
    body = F.when(F.contains(text, F.lit("\n")), F.regexp_replace(text, r"\A[^\n]*\n", "")).otherwise(text)
    words = records.select("doc_id", "source", F.regexp_extract_all(F.lower(body), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)).alias("w"))
    hashed = lambda *cs: F.xxhash64("source", F.concat_ws(" ", *cs))
    three = F.arrays_zip(F.col("w").alias("x"), F.slice("w", 2, 1 << 30).alias("y"), F.slice("w", 3, 1 << 30).alias("z"))
    runs = F.transform(F.filter(three, lambda t: t["z"].isNotNull()), lambda t: hashed(t["x"], t["y"], t["z"]))
    s = F.array_sort(F.array_distinct(F.when(F.size("w") >= 3, runs).otherwise(F.array(hashed(F.array_join("w", " "))))))
    sets = words.select("doc_id", "source", s.alias("s"))
    return sets.withColumn("key", F.sha2(F.concat_ws(",", F.col("source"), F.array_join(F.col("s").cast("array<string>"), ",")), 256))


class DuplicateIndex:
    """The index under a folder that all executors share. Runs are numbered by the caller, in ascending order; a run that is
    repeated writes its folder again and reads only what earlier ones left."""

    def __init__(self, spark: SparkSession, path: str, least: float = 0.8) -> None:
        self.spark, self.path, self.least = spark, path, least

    def _read(self, name: str, schema: str, before: int | None) -> DataFrame:
        there = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not there.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(there):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")
        return rows if before is None else rows.where(F.col("run") < before)

    def originals(self, before: int | None = None) -> DataFrame:
        """(source, doc_id, key, s) of the originals that there are (before a run): stored, and not forgotten by a later run."""
        rows = self._read("originals", SIGNATURES, before)
        gone = self._read("forgotten", FORGOTTEN, None)
        if before is not None:  # what run ``before`` itself replaced isn't known yet, what was asked of it is
            gone = gone.where((F.col("run") < before) | ((F.col("run") == before) & (F.col("how") == "asked")))
        gone = gone.groupBy("doc_id").agg(F.max("run").alias("_gone"))
        return rows.join(small(gone), "doc_id", "left").where(F.col("_gone").isNull() | (F.col("_gone") <= F.col("run"))).select("source", "doc_id", "key", "s")

    def forget(self, ids: DataFrame, run: int) -> None:
        """Takes ids (doc_id) out that earlier runs stored, so that later copies point at rows that exist."""
        ids.select(F.col("doc_id").cast("bigint")).write.mode("overwrite").parquet(f"{self.path}/forgotten/run={run}/how=asked")

    def add(self, records: DataFrame, run: int) -> DataFrame:
        """(doc_id, duplicate_of) of ``records`` (doc_id, source, text) that repeat a stored original or an earlier new one.

        New records come in the order of their ids, after all stored ones; a duplicate isn't stored, so later ones match
        originals only. Of several alike originals the smallest id is named. A record whose id is stored replaces what was
        stored. Rows with null ids are left out; ids of a run must differ.
        """
        new = cut(record_sets(records.where("doc_id is not null")))  # the only copy of sets besides the index itself
        stored = self.originals(run)
        replaced = stored.select("doc_id").join(records.select("doc_id"), "doc_id", "left_semi")
        replaced.write.mode("overwrite").parquet(f"{self.path}/forgotten/run={run}/how=replaced")
        replaced = self.spark.read.schema("doc_id bigint").parquet(f"{self.path}/forgotten/run={run}/how=replaced")
        known = stored.join(small(replaced), "doc_id", "left_anti")
        # equal sets have one name, led by the first in order
        place = lambda fresh: F.struct(F.lit(fresh).alias("fresh"), F.col("doc_id").cast("bigint").alias("doc_id")).alias("_place")
        pairs, names = named_pairs(known.select(place(0), "s").unionByName(new.select(place(1), "s")), self.least)
        lead = cut(names.groupBy("name").agg(F.min("_place").alias("o")))
        both = pairs.join(lead.select(F.col("name").alias("a"), F.col("o").alias("oa")), "a").join(lead.select(F.col("name").alias("b"), F.col("o").alias("ob")), "b").where("oa.fresh = 1 or ob.fresh = 1")
        ordered = both.select(F.least("oa", "ob")["doc_id"].alias("a"), F.greatest("oa", "ob")["doc_id"].alias("b"))
        members = names.where("_place.fresh = 1").join(lead, "name").select(F.col("_place.doc_id").alias("doc_id"), F.col("o.doc_id").alias("first"))
        found = cut(first_seen(ordered, members))
        stays = new.join(small(found.select("doc_id")), "doc_id", "left_anti")
        stays.select("source", "doc_id", "key", "s").write.mode("overwrite").parquet(f"{self.path}/originals/run={run}")
        return found
