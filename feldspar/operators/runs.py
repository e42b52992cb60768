"""Evaluation runs as a stored table of runs and a tidy one of scores; means by weight, and explanations of single items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def record(path: str, runs: DataFrame, scores: DataFrame) -> None:
    """Stores ``scores`` (run_id, ...) and then ``runs`` (run_id, ...), a folder a run.

    A run that is recorded again replaces what it stored before, other runs stay, so a repeated job doubles nothing. Runs
    come last: who reads a run finds its scores. A run recorded again without scores keeps its old ones. Rows go to as
    many tasks as a run's size asks for.
    """
    for name, rows in (("scores", scores), ("runs", runs)):
        rows.hint("rebalance", F.col("run_id")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{path}/{name}")


def weighted_mean(value: Column, weight: Column) -> Column:
    """sum(value * weight) / sum(weight) over rows that have both; null where the weights add up to nothing."""
    both = value.isNotNull() & weight.isNotNull()
    return F.sum(F.when(both, value * weight)) / F.nullif(F.sum(F.when(both, weight)), F.lit(0).cast("double"))


def trend(spark, path: str) -> DataFrame:
    """(run's columns, metric, n, mean, weighted): every recorded run beside its scores, a row a metric; a run without scores
    has one row of nulls and n 0. Scores have (run_id, metric, value, weight)."""
    runs, scores = spark.read.parquet(f"{path}/runs"), spark.read.parquet(f"{path}/scores")
    per = scores.groupBy("run_id", "metric").agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(weighted_mean(F.col("value").cast("double"), F.col("weight").cast("double")), 6).alias("weighted"))
    return runs.join(per, "run_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def most_common(rows: DataFrame, columns: list[str], n: int) -> DataFrame:
    """The ``n`` most frequent values of ``columns`` with their counts, ties by value (nulls first)."""
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *columns).limit(n)


def reranked(pool: DataFrame) -> DataFrame:
    """``pool`` (query_id, chunk_id, score, ...) with its position by score, from 1; a question's pool is bounded by search."""
    return pool.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "chunk_id")))


def explained(ranked: DataFrame, expected: DataFrame, shown: int = 400, texts: DataFrame | None = None) -> DataFrame:
    """(query_id, spec_id, in_pool, pool_rank, position, score, scored_text): where an expected source got lost.

    ``ranked`` is a reranked pool (query_id, chunk_id, title, doc_type, year, pool_rank, position, score, text). A
    specification of ``expected`` (query_id, spec_id, title, doc_type, year) fits chunks whose title contains its title and
    whose source and year equal its own; null asks for nothing, and one that asks for nothing fits none. ``pool_rank``
    is the best of all that fit, the other columns are of the one that was ranked best. With ``texts`` (chunk_id, text)
    the pool needs none: only the chunks that were ranked best get theirs.
    """
    spec = expected.select("query_id", "spec_id", *[F.col(c).alias(f"_{c}") for c in ("title", "doc_type", "year")]).where(F.coalesce("_title", "_doc_type", F.col("_year").cast("string")).isNotNull())
    asks = lambda c, holds: F.col(f"_{c}").isNull() | holds
    fits = asks("title", F.contains("title", "_title")) & asks("doc_type", F.col("doc_type") == F.col("_doc_type")) & asks("year", F.col("year") == F.col("_year"))
    own = F.substring("text", 1, shown).alias("scored_text")
    best = F.min_by(F.struct("position", "score", own if texts is None else "chunk_id"), "position")
    found = spec.join(ranked, "query_id").where(fits).groupBy("query_id", "spec_id").agg(F.min("pool_rank").alias("pool_rank"), best.alias("b")).select("query_id", "spec_id", "pool_rank", "b.*")
    if texts is not None:
        found = found.join(texts.select("chunk_id", own), "chunk_id", "left")
    rows = expected.select("query_id", "spec_id").join(found, ["query_id", "spec_id"], "left")
    return rows.select("query_id", "spec_id", F.col("pool_rank").isNotNull().alias("in_pool"), "pool_rank", "position", "score", "scored_text")
