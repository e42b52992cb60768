"""Global numbers and overlap counts without a task that holds a whole group's pairs or a whole sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut


def numbered(rows: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """``rows`` with their place (from 1) in the order of the columns: sorted by range, with the rows of the ranges before.

    Only a count for each range is summed in one place. Ties are numbered in an order that is fixed by the checkpoint.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    dealt = cut(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    per = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.join(F.broadcast(per.select("_part", "_first", before.alias("_before"))), "_part").withColumn(name, F.col("_at") - F.col("_first") + F.col("_before") + 1).drop("_part", "_at", "_first", "_before")


def overlap_counts(found: DataFrame, labelled: DataFrame, key: str) -> DataFrame:
    """(id, hits): for every row of ``found`` (key, id, start, stop) the rows of ``labelled`` (key, start, stop) of its key
    that overlap it: start < other stop and other start < stop.

    No pair is made: what overlaps is what starts before the stop less what stops by the start, both running sums over the
    key's positions. Labelled spans are counted per position first, and empty ones aren't counted; ``id`` must be unique.
    """
    real = labelled.where("start < stop")
    point = lambda t, at, place, **more: t.select(key, F.col(at).alias("_pos"), F.lit(place).alias("_place"), *[more.get(c, F.lit(None).cast("bigint")).cast("bigint").alias(c) for c in ("_starts", "_stops", "_id", "_sign")])
    starts = point(real.groupBy(key, "start").agg(F.count(F.lit(1)).alias("n")), "start", 1, _starts=F.col("n"))
    stops = point(real.groupBy(key, "stop").agg(F.count(F.lit(1)).alias("n")), "stop", 1, _stops=F.col("n"))
    # at one position: a stop's question comes before the starts, a start's question after the stops
    asks = point(found, "stop", 0, _id=F.col("id"), _sign=F.lit(1)).unionByName(point(found, "start", 2, _id=F.col("id"), _sign=F.lit(-1)))
    running = Window.partitionBy(key).orderBy("_pos", "_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = starts.unionByName(stops).unionByName(asks).withColumn("_s", F.coalesce(F.sum("_starts").over(running), F.lit(0))).withColumn("_t", F.coalesce(F.sum("_stops").over(running), F.lit(0)))
    part = F.when(F.col("_sign") == 1, F.col("_s")).otherwise(-F.col("_t"))
    return rows.where("_id is not null").groupBy(F.col("_id").alias("id")).agg(F.sum(part).alias("hits"))
