"""Idempotent ingestion by fingerprint, and the maintenance steps around it, as joins of an old and a new snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fingerprint(content: Column, recipe: str | Column) -> Column:
    """sha256 of the content, a bar and the recipe."""
    return F.sha2(F.concat(content, F.lit("|"), F.lit(recipe) if isinstance(recipe, str) else recipe), 256)


def diff_actions(old: DataFrame, new: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """(source_path, action): ingested, reingested, skipped, gone, and quarantined where a gate failed.

    ``old`` and ``new`` have (source_path, content_hash); a quarantined update keeps the version before it.
    """
    both = old.select("source_path", F.col("content_hash").alias("_old")).join(new.select("source_path", F.col("content_hash").alias("_new")), "source_path", "full_outer")
    bad = F.lit(False)
    if failed is not None:
        both = both.join(failed.select("source_path", F.lit(True).alias("_bad")).distinct(), "source_path", "left")
        bad = F.coalesce("_bad", F.lit(False))
    action = F.when(F.col("_new").isNull(), "gone").when(F.col("_old").eqNullSafe(F.col("_new")), "skipped").when(bad, "quarantined").when(F.col("_old").isNull(), "ingested").otherwise("reingested")
    return both.select("source_path", action.alias("action"))


def insert_if_absent(existing: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """What an insert that ignores conflicts would append: the first of each new key."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c) for c in rows.columns]))
    return rows.withColumn("_first", first).where("_first = 1").drop("_first").join(existing.select(*keys), keys, "left_anti")


def upsert_unless(existing: DataFrame, rows: DataFrame, keys: list[str], keep: str) -> DataFrame:
    """The table after an upsert that leaves existing rows alone where ``keep`` holds for them."""
    kept = existing.where(keep).join(rows.select(*keys), keys, "left_semi")
    fresh = rows.join(kept.select(*keys), keys, "left_anti")
    return existing.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def rebuild_copies(chunks: DataFrame, index_text: Column) -> DataFrame:
    """Recomputes the search copy; the vector goes only where the copy changed."""
    changed = ~F.col("index_text").eqNullSafe(index_text)
    return chunks.withColumn("_changed", changed).withColumn("index_text", index_text).withColumn("vector", F.when(F.col("_changed"), None).otherwise(F.col("vector"))).drop("_changed")


def read_declared_csv(spark, path: str, declared: dict[str, str], multi_line: bool = False) -> DataFrame:
    """CSV by header: declared columns that the header has are cast, others are left out, missing ones and '' are null.

    A quote inside a quoted cell is doubled. Cells with line breaks need ``multi_line``, which reads each file in one task.
    """
    raw = spark.read.csv(path, header=True, escape='"', multiLine=multi_line)
    have = {c.lower(): c for c in raw.columns}
    value = lambda c: F.nullif(F.col(f"`{have[c]}`"), F.lit(""))
    return raw.select(*[(value(c) if c in have else F.lit(None)).try_cast(t).alias(c) for c, t in declared.items()])


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    """Appends by partition; a value with many rows is written by as many tasks as its rows fill."""
    df.repartition(F.col(by), F.pmod(F.xxhash64(*df.columns[:1]), F.lit(8))).write.mode("append").partitionBy(by).parquet(path)


def refresh_metadata(stored: DataFrame, fresh: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``stored`` with ``columns`` as ``fresh`` (key, columns) says now, and ``changed`` where one of them differs.

    For files whose content is unchanged: nothing else of a row is touched. Nulls are values: a value that becomes null is
    changed, two nulls aren't. Rows that ``fresh`` doesn't know stay as they are; rows that only it knows aren't added.
    """
    now = fresh.select(key, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_known"))
    rows = stored.join(now, key, "left")
    known = F.coalesce("_known", F.lit(False))
    differs = F.lit(False)
    for c in columns:
        differs |= ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    rows = rows.withColumn("changed", known & differs)
    return rows.withColumns({c: F.when(known, F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}).select(*stored.columns, "changed")


def csv_elements(spark, path: str) -> DataFrame:
    """Elements of CSV files with a header: (file, category, text), a title "Columns: a, b" a file, and each row as text that
    stands by itself, "a: 1; b: 2", without empty cells. All values are text; rows without any value give no element."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    columns = [c for c in rows.columns]
    cells = F.filter(F.array(*[F.when(F.coalesce(F.col(f"`{c}`"), F.lit("")) != "", F.concat(F.lit(f"{c}: "), F.col(f"`{c}`"))) for c in columns]), lambda x: x.isNotNull())
    named = rows.select(F.input_file_name().alias("file"), F.array_join(cells, "; ").alias("text"))
    titles = named.select("file").distinct().select("file", F.lit("title").alias("category"), F.lit("Columns: " + ", ".join(columns)).alias("text"))
    return titles.unionByName(named.where("text <> ''").select("file", F.lit("text").alias("category"), "text"))
