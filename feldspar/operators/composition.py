"""Composing answers of many questions in one plan: legs fan out, slots are bound from context, member and document legs
run together, and every question comes back as one row that names what each leg gave or why it gave nothing."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .payload import compose

#: What a question's context may bind.
SLOTS = ("member_id", "claim_id", "case_id", "plan_code")
Runner = Callable[[DataFrame], DataFrame]
LEG = "question_id bigint, leg string, status string, reason string, confidence double, row_count bigint, chunk_ids array<bigint>"


def bind_slots(legs: DataFrame, contexts: DataFrame, required: dict[str, list[str]]) -> DataFrame:
    """Member legs with their slots, and ``reason`` where one can't run: an unknown query, or the slots it lacks.

    ``required`` says which slots a query needs; a leg's own value (columns of the same names, if it has any) stands over
    the context's. ``contexts`` is (question_id, member_id, claim_id, case_id, plan_code), a row a question at most.
    """
    unknown = set(sum(required.values(), [])) - set(SLOTS)
    if unknown:
        raise ValueError(f"no such slots: {sorted(unknown)}")
    own = [c for c in SLOTS if c in legs.columns]
    rows = legs.withColumnsRenamed({c: f"_{c}" for c in own}).join(contexts.select("question_id", *SLOTS), "question_id", "left")
    rows = rows.withColumns({c: F.coalesce(f"_{c}", c) for c in own}).drop(*[f"_{c}" for c in own])
    lacking = F.lit(None).cast("string")
    for name, slots in required.items():
        missing = F.array_join(F.filter(F.array(*[F.when(F.col(s).isNull(), F.lit(s)) for s in slots] or [F.lit(None).cast("string")]), lambda s: s.isNotNull()), ", ")
        lacking = F.when(F.col("query_name") == name, F.when(missing != "", F.concat(F.lit("not in context: "), missing))).otherwise(lacking)
    known = F.coalesce(F.col("query_name").isin(list(required)), F.lit(False))
    return rows.withColumn("reason", F.when(~known, F.concat(F.lit("no such query: "), F.coalesce("query_name", F.lit("")))).otherwise(lacking))


def member_legs(bound: DataFrame, runners: dict[str, Runner]) -> DataFrame:
    """The results of member legs, as LEG. A runner gets the bound legs of its query (question_id, leg, slots) and gives
    (question_id, leg) a row for each row found; a leg that finds none is executed, with no rows."""
    ready = bound.where("reason is null")
    found = [run(ready.where(F.col("query_name") == name)).select("question_id", "leg") for name, run in runners.items()]
    counts = reduce(DataFrame.unionByName, found).groupBy("question_id", "leg").agg(F.count(F.lit(1)).alias("row_count")) if found else None
    rows = bound.join(counts, ["question_id", "leg"], "left") if counts is not None else bound.withColumn("row_count", F.lit(None).cast("bigint"))
    status = F.when(F.col("reason").isNotNull(), "not_executed").when(F.coalesce("row_count", F.lit(0)) > 0, "ok").otherwise("insufficient_evidence")
    why = F.coalesce("reason", F.when(status == "insufficient_evidence", "no rows"))
    return rows.select("question_id", "leg", status.alias("status"), why.alias("reason"), F.lit(None).cast("double").alias("confidence"), F.coalesce("row_count", F.lit(0)).alias("row_count"), F.array().cast("array<bigint>").alias("chunk_ids"))


def document_legs(legs: DataFrame, search: Runner, bar: float, most: int = 8) -> DataFrame:
    """The results of document legs, as LEG. ``search`` gets (question_id, leg, ...) and gives (question_id, leg,
    chunk_id, score); the best ``most`` are kept, and a leg abstains if none clears ``bar``."""
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "chunk_id"))), 1, most)
    found = search(legs).groupBy("question_id", "leg").agg(best.alias("b"))
    rows = legs.select("question_id", "leg").join(found, ["question_id", "leg"], "left").withColumn("confidence", -F.col("b")[0]["s"])
    passed = F.coalesce(F.col("confidence") >= bar, F.lit(False))
    none = F.array().cast("array<bigint>")
    return rows.select("question_id", "leg", F.when(passed, "ok").otherwise("insufficient_evidence").alias("status"), F.when(~passed, F.when(F.col("b").isNull(), "no evidence").otherwise("no evidence over the bar")).alias("reason"), "confidence", F.lit(0).cast("bigint").alias("row_count"), F.when(passed, F.col("b")["chunk_id"]).otherwise(none).alias("chunk_ids"))


def compose_questions(questions: DataFrame, legs: DataFrame, required: dict[str, list[str]], runners: dict[str, Runner], search: Runner, bar: float = 0.7, provenance: dict[str, str] | None = None) -> DataFrame:
    """One row a question: status, confidence, missing legs, rows, chunks, reasons (leg: reason) and provenance.

    ``questions`` has question_id and SLOTS; ``legs`` is (question_id, leg, kind, query_name, required). A question's legs are
    few, so it is folded as one row; questions without legs are out of scope. Nothing is run twice: both kinds of legs are
    branches of one plan. A leg of another kind isn't executed. ``provenance`` (document version, recipe, model) is told
    beside the answer and never scored.
    """
    member = member_legs(bind_slots(legs.where("kind = 'member_query'"), questions, required), runners)
    document = document_legs(legs.where("kind = 'doc_probe'"), search, bar)
    other = legs.where("kind is null or kind not in ('member_query', 'doc_probe')")
    other = other.select("question_id", "leg", F.lit("not_executed").alias("status"), F.concat(F.lit("no such kind: "), F.coalesce("kind", F.lit(""))).alias("reason"), F.lit(None).cast("double").alias("confidence"), F.lit(0).cast("bigint").alias("row_count"), F.array().cast("array<bigint>").alias("chunk_ids"))
    results = member.unionByName(document).unionByName(other).join(legs.select("question_id", "leg", "kind", "required"), ["question_id", "leg"])
    whole = compose(results.withColumnRenamed("question_id", "plan_id")).withColumnRenamed("plan_id", "question_id")
    said = F.array_join(F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.concat("leg", F.lit(": "), "reason")))), "; ")
    more = results.groupBy("question_id").agg(F.sum("row_count").alias("row_count"), F.sum(F.size("chunk_ids")).alias("chunks"), said.alias("reasons"), F.count_if(F.col("status") == "ok").alias("_ok"))
    rows = questions.select("question_id").join(whole, "question_id", "left").join(more, "question_id", "left")
    # without an answered leg, nothing was answered, whatever was required
    status = F.when(F.col("_ok").isNull(), "out_of_scope").when((F.col("_ok") == 0) & (F.col("status") == "ok"), "insufficient_evidence").otherwise(F.col("status"))
    told = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in sorted((provenance or {}).items())])) if provenance else F.lit("{}")
    return rows.select("question_id", status.alias("status"), "confidence", F.coalesce("missing", F.lit("")).alias("missing"), F.coalesce("row_count", F.lit(0)).alias("row_count"), F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("reasons", F.lit("")).alias("reasons"), told.alias("provenance"))


def coverage_notes(asked: DataFrame, corpus: DataFrame, evidence: DataFrame) -> DataFrame:
    """(question_id, keys, in_corpus, with_evidence, missing_from_corpus, without_evidence), sorted arrays.

    ``asked`` is (question_id, key) of the plans (or others) a question covers, ``corpus`` the (key) there are documents
    of, ``evidence`` the (question_id, key) that gave some. Keys meet by joins; a question's keys are few.
    """
    rows = asked.distinct().join(corpus.select("key").distinct().withColumn("_in", F.lit(True)), "key", "left").join(evidence.select("question_id", "key").distinct().withColumn("_with", F.lit(True)), ["question_id", "key"], "left")
    have, shown = F.coalesce("_in", F.lit(False)), F.coalesce("_with", F.lit(False))
    some = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("key"))))
    return rows.groupBy("question_id").agg(F.array_sort(F.collect_list("key")).alias("keys"), some(have).alias("in_corpus"), some(shown).alias("with_evidence"), some(~have).alias("missing_from_corpus"), some(have & ~shown).alias("without_evidence"))
