"""Payloads and the disclosure log: what is returned is written first."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPEC = "1.2.0"
MOST_CHUNKS = 8
#: From worst to best.
STATUSES = ["not_executed", "out_of_scope", "insufficient_evidence", "ok"]


def version_label(version: Column, letter: Column, decided: Column, year: Column) -> Column:
    """The first that is there of version, letter or bulletin, decision date and edition."""
    return F.coalesce(F.concat(F.lit("v"), version.cast("string")), letter, F.concat(F.lit("decided "), decided.cast("string")), F.concat(F.lit("edition "), year.cast("string")), F.lit("unversioned"))


def build(ranked: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(query_id, status, confidence, payload): the best chunks as JSON of the versioned contract; none on abstention."""
    one = F.struct(F.col("rank"), F.col("chunk_id"), F.col("acl_tag").alias("acl_basis"), F.round("score", 4).alias("score"))
    chunks = ranked.where(F.col("rank") <= MOST_CHUNKS).groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("chunks"))
    status = F.when(F.col("abstained"), "insufficient_evidence").otherwise("ok")
    rows = verdicts.join(chunks, "query_id", "left").withColumn("status", status)
    shown = F.when(F.col("status") == "ok", F.col("chunks")).otherwise(F.array().cast(dict(chunks.dtypes)["chunks"]))
    return rows.select("query_id", "status", F.round("confidence", 4).alias("confidence"), F.to_json(F.struct(F.lit(SPEC).alias("spec"), "status", F.round("confidence", 4).alias("confidence"), shown.alias("chunks"))).alias("payload"))


def compose(legs: DataFrame) -> DataFrame:
    """(plan_id, status, confidence, missing) of legs (plan_id, leg, kind, required, status, confidence).

    The worst of the required legs; the least confidence of document legs; legs that gave nothing are missing.
    """
    worth = F.array_position(F.array(*[F.lit(s) for s in STATUSES]), F.col("status"))
    got = legs.groupBy("plan_id").agg(F.min(F.when(F.col("required"), worth)).alias("_w"), F.min(F.when(F.col("kind") == "doc_probe", F.col("confidence"))).alias("confidence"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("status") != "ok", F.col("leg")))), ",").alias("missing"))
    return got.select("plan_id", F.element_at(F.array(*[F.lit(s) for s in STATUSES]), F.coalesce(F.col("_w"), F.lit(len(STATUSES))).cast("int")).alias("status"), "confidence", "missing")


def disclose(payloads: DataFrame, ranked: DataFrame, persona: str, log: str) -> DataFrame:
    """Appends who saw what, ids and hashes aligned, and only then gives the payloads back; a failed write raises.

    What is returned is read from the log, so nothing leaves that wasn't written.
    """
    run = uuid.uuid4().hex
    seen = ranked.where(F.col("rank") <= MOST_CHUNKS).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "content_hash", "title", "acl_tag"))).alias("s"))
    rows = payloads.join(seen, "query_id", "left").select(
        F.lit(run).alias("run"), F.lit(persona).alias("persona"), F.current_timestamp().alias("at"), "query_id", "status", "confidence", "payload", F.col("s")["chunk_id"].alias("chunk_ids"), F.col("s")["content_hash"].alias("content_hashes"), F.col("s")["title"].alias("titles"), F.array_distinct(F.col("s")["acl_tag"]).alias("acl_basis")
    )
    rows.write.mode("append").partitionBy("run").parquet(log)
    return payloads.sparkSession.read.parquet(f"{log}/run={run}").select("query_id", "status", "confidence", "payload")


def lineage(log: DataFrame, title_like: str | None = None, persona: str | None = None) -> DataFrame:
    """Disclosures of a document (any title like the pattern) or a persona, newest first."""
    rows = log
    if title_like:
        rows = rows.where(F.exists("titles", lambda t: t.ilike(title_like)))
    if persona:
        rows = rows.where(F.col("persona") == persona)
    return rows.orderBy(F.desc("at"), "query_id")
