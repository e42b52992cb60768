"""Health of payloads: what pass and fail don't show, per payload and over many; and arms against sabotaged ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scores nearer than this are a tie, and what marks an index page.
TIE, INDEX_PAGE = 0.005, r"(?i)do not rely on this page|table of contents"
CHUNKS = "array<struct<title:string,pages:string,text:string,section:string,score:double>>"
LEGS = "array<struct<kind:string,query_name:string,sources:array<string>>>"


def _plain(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def payload_health(payloads: DataFrame) -> DataFrame:
    """(payload_id, top_gap, tie, chunks, duplicates, index_seats, legs, needless_split) of (payload_id, chunks, legs).

    Chunks of one title, pages and first 80 characters are one; the gap is between the two best distinct ones, so a chunk
    that is seated twice is no tie (null with fewer than two). Legs that ask the same of the same sources are a needless
    split. A payload's chunks and legs are few; null lists are empty.
    """
    chunks, legs = F.coalesce("chunks", F.array().cast(CHUNKS)), F.coalesce("legs", F.array().cast(LEGS))
    key = lambda c: F.concat_ws("\x01", F.coalesce(c["title"], F.lit("")), F.coalesce(c["pages"], F.lit("")), F.substring(_plain(c["text"]), 1, 80))
    # best first: of equal keys the first has the best score; keys are made once a chunk, as a column
    keyed = F.sort_array(F.transform(chunks, lambda c: F.struct(F.greatest(F.lit(0.0), F.coalesce(c["score"], F.lit(0.0))).alias("s"), key(c).alias("k"))), asc=False)
    payloads = payloads.select("payload_id", chunks.alias("chunks"), legs.alias("legs"), keyed.alias("_keyed"))
    distinct = F.array_distinct(F.transform("_keyed", lambda x: x["k"]))
    chunks, legs = F.col("chunks"), F.col("legs")
    # two scores are enough: the best, and the best of another key
    first = F.get("_keyed", F.lit(0))
    best = F.array(first["s"], F.get(F.filter("_keyed", lambda x: x["k"] != first["k"]), F.lit(0))["s"])
    index = F.filter(chunks, lambda c: F.coalesce(c["section"], F.lit("")).rlike(INDEX_PAGE) | _plain(c["text"]).rlike(INDEX_PAGE))
    asked = F.transform(legs, lambda x: F.concat_ws("\x01", F.coalesce(x["kind"], F.lit("")), F.coalesce(x["query_name"], F.lit("")), F.array_join(F.array_sort(F.coalesce(x["sources"], F.array().cast("array<string>"))), ",")))
    rows = payloads.select("payload_id", chunks.alias("c"), best.alias("b"), distinct.alias("d"), index.alias("i"), asked.alias("l"))
    gap = F.get("b", F.lit(0)) - F.get("b", F.lit(1))
    return rows.select("payload_id", F.round(gap, 4).alias("top_gap"), (gap < TIE).alias("tie"), F.size("c").alias("chunks"), (F.size("c") - F.size("d")).alias("duplicates"), F.size("i").alias("index_seats"), F.size("l").alias("legs"), ((F.size("l") > 1) & (F.size(F.array_distinct("l")) < F.size("l"))).alias("needless_split"))


def health_summary(health: DataFrame) -> DataFrame:
    """Rates over payloads: ties (of those with a gap), duplicate and index shares of all chunks, needless splits of those
    with two legs and more. Null where there is nothing to measure."""
    return health.agg(
        F.round(F.avg(F.col("tie").cast("double")), 3).alias("tie_rate"),
        F.round(F.sum("duplicates") / F.sum("chunks"), 3).alias("duplicate_share"),
        F.round(F.sum("index_seats") / F.sum("chunks"), 3).alias("index_seat_share"),
        F.round(F.avg(F.when(F.col("legs") > 1, F.col("needless_split").cast("double"))), 3).alias("needless_split_rate"),
        F.count(F.lit(1)).alias("n_payloads"),
    )


def hits_at(ranked: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(arm, questions, hits): of the questions of ``wanted`` (query_id, chunk_id), how many find a wanted chunk among the
    best k of each arm of ``ranked`` (arm, query_id, chunk_id, rank); arms without any row aren't there."""
    # one reading of the arms: each of their rows may be dear
    near = ranked.select("arm", F.when(F.col("rank") <= k, F.col("query_id")).alias("query_id"), "chunk_id")
    found = near.join(wanted.select("query_id", "chunk_id", F.col("query_id").alias("_hit")).distinct(), ["query_id", "chunk_id"], "left")
    asked = F.broadcast(wanted.agg(F.countDistinct("query_id").alias("questions")))  # one row
    return found.groupBy("arm").agg(F.countDistinct("_hit").alias("hits")).crossJoin(asked).select("arm", "questions", "hits")
