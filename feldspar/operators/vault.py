"""A stored vault of pseudonyms, and the header line of member records that carries them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys of a record in the order of its header, the entity whose pseudonym stands for them, and their label.
RECORD_KEYS = (("case_id", "CASE_ID", "case"), ("member_id", "MEMBER_ID", "member"), ("claim_id", "CLAIM_ID", "claim"), ("call_id", None, "call"))
VAULT = "entity string, original_hash string, number bigint, pseudonym string"


def original_hash(entity: Column, canonical: Column) -> Column:
    return F.sha2(F.concat(entity, F.lit("|"), canonical), 256)


def extend(vault: DataFrame, originals: DataFrame) -> DataFrame:
    """``vault`` with a pseudonym for every (entity, canonical) of ``originals`` that has none yet.

    Known originals keep theirs; new ones are numbered after the entity's highest number, in the order of their hashes:
    ranks inside the 4,096 equal ranges of a hash, plus the ranges before, so no task sorts an entity. Nulls are left out;
    the same call on the result changes nothing.
    """
    hashed = originals.where("canonical is not null").select("entity", original_hash(F.col("entity"), F.col("canonical")).alias("original_hash")).distinct()
    new = hashed.join(vault.select("entity", "original_hash"), ["entity", "original_hash"], "left_anti").withColumn("_range", F.substring("original_hash", 1, 3))
    counts = new.groupBy("entity", "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("entity", "_range", F.coalesce(F.sum("_n").over(Window.partitionBy("entity").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    last = vault.groupBy("entity").agg(F.max("number").alias("_last"))
    own = F.row_number().over(Window.partitionBy("entity", "_range").orderBy("original_hash"))
    numbered = new.withColumn("_own", own).join(before, ["entity", "_range"]).join(last, "entity", "left")
    number = F.col("_own") + F.col("_before") + F.coalesce("_last", F.lit(0))
    pseudonym = F.concat(F.lit("["), "entity", F.lit("-"), F.lpad(number.cast("string"), 6, "0"), F.lit("]"))
    return vault.unionByName(numbered.select("entity", "original_hash", number.cast("bigint").alias("number"), pseudonym.alias("pseudonym")))


def record_headers(records: DataFrame, vault: DataFrame, mode: str = "tokenize") -> DataFrame:
    """(record_id, header): "record: case ...  member ...  claim ...  call ..." over the keys that a record has.

    ``mode``: "tokenize" puts the vault's pseudonyms in place of identifiers (a key that the vault doesn't know is left
    out), "mask" their type, "off" the values. A record without keys has an empty header. ``records`` has record_id and any
    of the four keys; empty and null ones count as absent.
    """
    if mode not in ("tokenize", "mask", "off"):
        raise ValueError(mode)
    have = [(i, *k) for i, k in enumerate(RECORD_KEYS) if k[0] in records.columns]
    pairs = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(entity).cast("string").alias("entity"), F.lit(label).alias("label"), F.nullif(F.col(key).cast("string"), F.lit("")).alias("value")) for i, key, entity, label in have])
    flat = records.select("record_id", F.explode(pairs).alias("p")).select("record_id", "p.*").where("value is not null")
    if mode == "mask":
        flat = flat.withColumn("value", F.when(F.col("entity").isNotNull(), F.concat(F.lit("["), "entity", F.lit("]"))).otherwise(F.col("value")))
    if mode == "tokenize":
        known = flat.withColumn("original_hash", original_hash(F.col("entity"), F.col("value"))).join(vault.select("original_hash", "pseudonym"), "original_hash", "left")
        flat = known.withColumn("value", F.when(F.col("entity").isNull(), F.col("value")).otherwise(F.col("pseudonym"))).where("value is not null")
    parts = F.array_sort(F.collect_list(F.struct("place", F.concat("label", F.lit(" "), "value").alias("part"))))["part"]
    headers = flat.groupBy("record_id").agg(F.concat(F.lit("record: "), F.array_join(parts, "  ")).alias("header"))
    return records.select("record_id").join(headers, "record_id", "left").select("record_id", F.coalesce("header", F.lit("")).alias("header"))
