"""Mixing sources to target weights by Poisson replication, with SQL functions only.

Each document is repeated k times, k drawn by inverting a Poisson distribution at a uniform number that is hashed from
the seed and the document's id; the mean is the repetition rate that brings its source to its target share. The draw
depends on the row alone, so a lost task repeats it exactly. The copies are then dealt out globally by a hash order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import hidden, restored

#: Rates are compared with inverse tables of at most this many sources inline; more go through a salted join.
INLINE_SOURCES = 1000


def uniform(seed: str, key: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of md5(seed:key)."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def poisson_steps(rate: Column) -> Column:
    """The cumulative probabilities of 0, 1, 2, ... up to rate + 12 * sqrt(rate) + 30, beyond which doubles end."""
    top = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    zero = F.struct((-rate).alias("logp"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        logp = acc["logp"] + F.ln(rate) - F.ln(k.cast("double"))
        c = acc["c"] + F.exp(logp)
        return F.struct(logp.alias("logp"), c.alias("c"), F.concat(acc["all"], F.array(c)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), top), zero, step)["all"]


def source_rates(docs: DataFrame, weights: dict[str, float] | None, source: str, epoch: float) -> DataFrame:
    """(source, rate, steps): rate = epoch * share * all rows / the source's rows. Unnamed sources share what is left.

    Without weights, the target is proportional to the square root of each source's rows.
    """
    counts = docs.groupBy(F.col(source).alias("_m_source")).agg(F.count(F.lit(1)).cast("double").alias("_m_rows"))
    if weights:
        left = max(0.0, 1.0 - sum(weights.values()))
        named = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("_m_source")]
        unnamed = counts.where(named.isNull())
        part = F.coalesce(named, left * F.col("_m_rows") / F.lit(max(1.0, unnamed.agg(F.sum("_m_rows")).first()[0] or 1.0)))
    else:
        part = F.sqrt("_m_rows")
    # one row per source; the totals are two numbers
    total = counts.agg(F.sum("_m_rows").alias("rows"), F.sum(part).alias("parts")).first()
    rows, parts = total["rows"] or 1.0, total["parts"] or 1.0
    rate = F.lit(epoch) * (part / F.lit(parts)) * F.lit(rows) / F.col("_m_rows")
    return counts.select("_m_source", "_m_rows", rate.alias("_m_rate")).withColumn("_m_steps", poisson_steps(F.col("_m_rate")))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, seed: str = "mix-1", epoch: float = 1.0, id_col: str = "doc_id", source: str = "source", salts: int = 64, details: bool = True) -> DataFrame:
    """``docs`` with each row repeated by its draw, plus ``replica`` (0, 1, ...), ``rate`` and ``draw``, dealt globally.

    Null sources are a source of their own; a null id draws like an empty one; repeated ids draw alike. An empty table
    gives an empty table. Columns may have any names: where ``docs`` has one of the three names already, the new column
    gets an underscore more; without ``details`` none is added. A source that holds a third of all rows is salted in
    the join with the table of rates.
    """
    plain, (own_id, own_source) = hidden(docs, id_col, source)
    rates = source_rates(plain, weights, own_source, epoch)
    on = F.col(own_source).eqNullSafe(F.col("_m_source"))
    if rates.limit(INLINE_SOURCES + 1).count() <= INLINE_SOURCES:  # a proven bound: at most INLINE_SOURCES short rows
        joined = plain.join(F.broadcast(rates), on)
    else:
        salted = plain.withColumn("_m_salt", F.pmod(F.xxhash64(own_id), F.lit(salts)))
        spread = rates.withColumn("_m_salt2", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
        joined = salted.join(spread, on & (F.col("_m_salt") == F.col("_m_salt2")))
    u = uniform(seed, F.col(own_id))
    draw = F.size(F.filter("_m_steps", lambda c: c <= u))
    copies = joined.withColumn("_m_draw", draw).where("_m_draw > 0").withColumn("_m_replica", F.explode(F.sequence(F.lit(0), F.col("_m_draw") - 1)))
    order = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(own_id).cast("string"), F.lit("")), F.col("_m_replica").cast("string")))
    dealt = copies.withColumn("_m_order", order).repartition(F.col("_m_order")).sortWithinPartitions("_m_order")
    return restored(dealt, docs, **({"replica": "_m_replica", "rate": "_m_rate", "draw": "_m_draw"} if details else {}))
