"""Evaluation over a tidy table of scores (run_id, question_id, category, metric, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .search import small

Z = 1.959963984540054


def wilson(successes: Column, n: Column) -> tuple[Column, Column]:
    """The 95 % Wilson interval, clamped; (0, 1) where there is nothing."""
    p, z2 = successes / n, Z * Z
    centre = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    low = F.when(n > 0, F.greatest(F.lit(0.0), centre - half)).otherwise(0.0)
    high = F.when(n > 0, F.least(F.lit(1.0), centre + half)).otherwise(1.0)
    return F.round(low, 6), F.round(high, 6)


def rate_table(scores: DataFrame, by: str) -> DataFrame:
    """Items, passes, and the rate with its interval, per bucket."""
    got = scores.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").cast("bigint").alias("passed"))
    low, high = wilson(F.col("passed"), F.col("n"))
    return got.select(by, "n", "passed", F.round(F.col("passed") / F.col("n"), 6).alias("rate"), low.alias("low"), high.alias("high"))


def failing_items(scores: DataFrame, by: str) -> DataFrame:
    """The failing items of each bucket, a row each: a bucket may have any number of them."""
    return scores.where("value < 1").select(by, "question_id")


def item_verdicts(scores: DataFrame) -> DataFrame:
    """Passed where every gate metric is 1; unverified where one is missing; never a pass by skipping."""
    got = scores.groupBy("run_id", "question_id").agg(F.min("value").alias("_least"), F.bool_or(F.col("value").isNull()).alias("_skipped"))
    return got.select("run_id", "question_id", F.when(F.col("_least") < 1, "failed").when(F.col("_skipped"), "unverified").otherwise("passed").alias("verdict"))


def paired_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per metric: items gained, lost, and in one run only."""
    on = ["question_id", "metric"]
    both = before.select(*on, F.col("value").alias("b")).join(after.select(*on, F.col("value").alias("a")), on, "full_outer")
    return both.groupBy("metric").agg(F.count_if((F.col("b") < 1) & (F.col("a") >= 1)).alias("gained"), F.count_if((F.col("b") >= 1) & (F.col("a") < 1)).alias("lost"), F.count_if(F.col("a").isNull()).alias("only_before"), F.count_if(F.col("b").isNull()).alias("only_after"))


def ratchet(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Items verified before that don't pass now; an item without a current verdict is a failure as well."""
    held = baseline.where("verdict = 'passed'").select("question_id")
    return held.join(current.select("question_id", "verdict"), "question_id", "left").where(~F.coalesce(F.col("verdict") == "passed", F.lit(False))).select("question_id", F.coalesce("verdict", F.lit("missing")).alias("verdict"))


def retrieval_metrics(ranked: DataFrame, labels: DataFrame) -> DataFrame:
    """hit@5, precision@5 and coverage@10 of ranked (query_id, chunk_id, rank) against relevant (query_id, chunk_id)."""
    wanted = labels.groupBy("query_id").agg(F.count(F.lit(1)).alias("_wanted"))
    hits = ranked.join(labels.select("query_id", "chunk_id", F.lit(1).alias("_hit")), ["query_id", "chunk_id"], "left")
    got = hits.groupBy("query_id").agg(F.coalesce(F.max(F.when(F.col("rank") <= 5, F.col("_hit"))), F.lit(0)).alias("hit5"), (F.coalesce(F.sum(F.when(F.col("rank") <= 5, F.col("_hit"))), F.lit(0)) / 5).alias("_p5"), F.coalesce(F.sum(F.when(F.col("rank") <= 10, F.col("_hit"))), F.lit(0)).alias("_c10"))
    return got.join(wanted, "query_id", "left").select("query_id", "hit5", F.round("_p5", 6).alias("precision5"), F.round(F.col("_c10") / F.col("_wanted"), 6).alias("coverage10"))


def nearest_rank(values: Column, percent: int) -> Column:
    """The k-th smallest of a collected array, k = ceil(percent / 100 * n)."""
    return F.element_at(F.array_sort(values), F.ceil(F.lit(percent) / 100 * F.size(values)).cast("int"))


def percentiles(rows: DataFrame, by: str, value: str, percents: list[int], ranges: int = 64) -> DataFrame:
    """(by, median, p<percent>...): the interpolated median and nearest ranks, k = ceil(percent / 100 * n), per group.

    Equal values are counted before the shuffle. Each group's values lie in ``ranges`` ranges of about equal counts,
    ranked a range at a time, so that no task sorts a group. Ranges are only a matter of balance; ranks are exact.
    """
    own = rows.where(F.col(value).isNotNull()).select(F.col(by).alias("_by"), F.col(value).alias("_v"))
    cuts = own.groupBy(F.col("_by").alias("_b")).agg(F.percentile_approx("_v", [i / ranges for i in range(1, ranges)], 10 * ranges).alias("_cuts"))
    counts = own.groupBy("_by", "_v").agg(F.count(F.lit(1)).alias("_c")).join(small(cuts), F.col("_by").eqNullSafe(F.col("_b")))
    counts = counts.select("_by", "_v", "_c", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).alias("_r"))
    group = Window.partitionBy("_by")
    sums = counts.groupBy("_by", "_r").agg(F.sum("_c").alias("_s"))
    ahead = sums.select(F.col("_by").alias("_b"), F.col("_r").alias("_q"), (F.sum("_s").over(group.orderBy("_r")) - F.col("_s")).alias("_before"), F.sum("_s").over(group).alias("_n"))
    within = F.sum("_c").over(Window.partitionBy("_by", "_r").orderBy("_v"))
    ranked = counts.withColumn("_w", within).join(ahead, F.col("_by").eqNullSafe(F.col("_b")) & (F.col("_r") == F.col("_q"))).withColumn("_hi", F.col("_before") + F.col("_w"))
    at = lambda k: F.max(F.when((F.col("_hi") - F.col("_c") < k) & (k <= F.col("_hi")), F.col("_v")))
    low, high = at(F.floor((F.col("_n") + 1) / 2)), at(F.floor(F.col("_n") / 2) + 1)
    return ranked.groupBy(F.col("_by").alias(by)).agg((0.5 * low + 0.5 * high).alias("median"), *[at(F.ceil(F.lit(p) * F.col("_n") / 100)).alias(f"p{p}") for p in percents])


def payload_health(ranked: DataFrame, epsilon: float = 0.005) -> DataFrame:
    """Per query: whether the top two tie, their margin, and the share of repeated contents among the results."""
    nxt = F.lead("score").over(Window.partitionBy("query_id").orderBy("rank"))
    got = ranked.withColumn("_next", nxt).groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("score") - F.col("_next"))).alias("margin"), (1 - F.countDistinct("content_hash") / F.count(F.lit(1))).alias("duplicate_share"))
    return got.select("query_id", F.round("margin", 6).alias("margin"), (F.col("margin") < epsilon).alias("tied"), F.round("duplicate_share", 6).alias("duplicate_share"))


def centroid(vectors: DataFrame, vector: str, by: list[str]) -> DataFrame:
    """(by..., position, mean): element-wise means, combined before the shuffle."""
    return vectors.select(*by, F.posexplode(vector).alias("position", "x")).groupBy(*by, "position").agg(F.avg(F.col("x").cast("double")).alias("mean"))


#: The drift sample's size, and the cosine shift between centroids that alerts.
DRIFT_SAMPLE, DRIFT_ALERT = 500, 0.02


def drift(before: DataFrame, now: DataFrame, sample: int = DRIFT_SAMPLE) -> DataFrame:
    """One row: sample_size, norm_mean, centroid_shift, alert, of two snapshots (key, vector).

    Each snapshot is measured by the ``sample`` vectors that are lowest by md5 of their key, so rebuilt snapshots are
    measured by the same ones; rows without a vector aren't taken. Norms and sizes are those of ``now``. Without vectors
    before, or with a centroid of zeros, there is no shift and no alert.
    """
    lowest = lambda t: t.where("vector is not null").orderBy(F.md5(F.col("key").cast("string").cast("binary")), "key").limit(sample)
    old, new = lowest(before).withColumn("_side", F.lit("x")), lowest(now).withColumn("_side", F.lit("y"))
    means = centroid(old.unionByName(new), "vector", ["_side"]).groupBy("position").agg(F.max(F.when(F.col("_side") == "x", F.col("mean"))).alias("x"), F.max(F.when(F.col("_side") == "y", F.col("mean"))).alias("y"))
    square = lambda c: F.sqrt(F.sum(F.col(c) * F.col(c)))
    shift = 1 - F.sum(F.col("x") * F.col("y")) / F.nullif(square("x") * square("y"), F.lit(0.0))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    sizes = new.agg(F.count(F.lit(1)).alias("sample_size"), F.avg(norm).alias("norm_mean"))
    both = sizes.crossJoin(means.agg(shift.alias("centroid_shift")))  # a row each
    return both.select("sample_size", "norm_mean", "centroid_shift", F.coalesce(F.col("centroid_shift") > DRIFT_ALERT, F.lit(False)).alias("alert"))


def corpus_hash(documents: DataFrame, levels: int = 4, width: int = 256) -> DataFrame:
    """One row (corpus_hash) of (id, content_hash): hashes in the order of ids, hashed by ranges of ``width`` ids, and so on
    up ``levels`` times, so no group is longer than ``width``. Two corpora whose hashes differ are told apart by their
    leaves. Ids must be unique, from 0 to ``width ** levels``; an empty corpus has no row.
    """
    nodes = documents.select(F.col("id").alias("i"), F.col("content_hash").alias("h"))
    for _ in range(levels):
        ordered = F.array_sort(F.collect_list(F.struct("i", "h")))["h"]
        nodes = nodes.groupBy(F.floor(F.col("i") / width).alias("i")).agg(F.sha2(F.array_join(ordered, ","), 256).alias("h"))
    return nodes.select(F.col("h").alias("corpus_hash"))
