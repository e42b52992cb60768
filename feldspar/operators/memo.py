"""Memo tables of what is dear to compute: scores by (model, question, text), vectors by (model, text).

A table is keyed by model and content hash. A run reads what is known, computes each missing key once, appends it, and
answers from both. Two runs that meet may both append a key; readers take one of them, always the same.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut


def content_key(*parts: Column) -> Column:
    """sha256 of the parts, each after its length, so that no two lists of parts are one text; null differs from empty."""
    said = [F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]
    return F.sha2(F.concat(*said), 256)


class Memo:
    """A memo under a folder that all executors share; ``value`` is the SQL type of what is kept."""

    def __init__(self, spark: SparkSession, path: str, model: str, value: str = "double") -> None:
        self.spark, self.path, self.value = spark, f"{path}/model={model}", value

    def known(self) -> DataFrame:
        """(key, value): one value a key, that of the smallest run name."""
        there = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not there.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(there):
            return self.spark.createDataFrame([], f"key string, value {self.value}")
        rows = self.spark.read.schema(f"key string, value {self.value}, run string").option("basePath", self.path).parquet(self.path)
        return rows.groupBy("key").agg(F.min_by("value", "run").alias("value"))

    def lookup(self, requests: DataFrame, inputs: list[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``requests`` with ``value`` and ``cached`` (known before this run).

        ``compute`` gets (key, *inputs), a row for each key that isn't known, and gives (key, value). Values that are null
        or not a number answer this run but aren't kept, so the next run tries again. An input may be null.
        """
        keyed = requests.withColumn("_key", content_key(*[F.col(c).cast("string") for c in inputs]))
        known = cut(self.known())
        distinct = keyed.groupBy(F.col("_key").alias("key")).agg(*[F.first(c).alias(c) for c in inputs])
        fresh = cut(compute(distinct.join(known, "key", "left_anti")).select("key", "value"))
        kept = fresh.where("value is not null")
        if self.value in ("double", "float"):
            kept = kept.where(~F.isnan("value"))
        kept.write.parquet(f"{self.path}/run={uuid.uuid4().hex}")
        both = known.withColumn("cached", F.lit(True)).unionByName(fresh.withColumn("cached", F.lit(False)))
        return keyed.join(both.withColumnRenamed("key", "_key"), "_key", "left").drop("_key")
