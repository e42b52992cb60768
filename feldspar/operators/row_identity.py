"""Lookup tables answer by having the row: chunks whose table is keyed by a phrase of the question take seats first.

Keys and phrases meet in one equi-join, so no question is compared with every chunk; a seat list is ranked per question.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables as tb


def chunk_keys(chunks: DataFrame, chunk_id: str = "chunk_id", content: str = "content") -> DataFrame:
    """(chunk_id, pos, key): the row keys of every chunk that holds a lookup table."""
    own = chunks.where(F.col(content).contains("|"))  # reaches the scan; most chunks have no table
    return own.select(F.col(chunk_id).alias("chunk_id"), F.posexplode(tb.table_keys(F.col(content))).alias("pos", "key"))


def row_hits(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, chunk_id, keys): the keys of a chunk that the question names exactly, in table order.

    ``questions`` is (question_id, question). A question has a bounded number of phrases, a key's chunks are those of the
    tables that list it. Null questions name nothing.
    """
    phrases = questions.select("question_id", F.explode(tb.row_phrases(F.col("question"))).alias("key"))
    met = chunk_keys(chunks).join(phrases, "key")
    named = F.array_sort(F.collect_list(F.struct("pos", "key")))["key"]
    return met.groupBy("question_id", "chunk_id").agg(F.array_distinct(named).alias("keys"))


def identity_seats(pool: DataFrame, hits: DataFrame, top_n: int) -> DataFrame:
    """(question_id, seat, chunk_id, score, by_identity, keys).

    ``pool`` is (question_id, chunk_id, score, rank): the candidates of each question, with the reranker's place (null:
    not seated). Candidates with a hit come first, by score; the reranker's seats follow. Scores stay what they were.
    Ties go to the smaller chunk_id; a null score counts as 0.
    """
    rows = pool.join(hits, ["question_id", "chunk_id"], "left").withColumn("by_identity", F.col("keys").isNotNull())
    rows = rows.where(F.col("by_identity") | F.col("rank").isNotNull())
    order = Window.partitionBy("question_id").orderBy(F.desc("by_identity"), F.when(F.col("by_identity"), -F.coalesce("score", F.lit(0.0))).otherwise(F.col("rank").cast("double")), "chunk_id")
    return rows.withColumn("seat", F.row_number().over(order)).where(F.col("seat") <= top_n).select("question_id", "seat", "chunk_id", "score", "by_identity", "keys")


def rows_intact(chunks: DataFrame, cells: DataFrame) -> DataFrame:
    """``cells`` (document_id, cell_id, value, row, column) with ``intact``: the cell is still part of its row in a chunk.

    Value and row label stand in one table row whose header names the column, or in one line with bars or tabs that names
    all three. ``chunks`` is (document_id, content); cells of documents without chunks aren't intact.
    """
    lines = F.transform(F.filter(F.split("content", "\n"), lambda s: s.rlike(r"[|\t]")), lambda s: F.struct(F.lit(None).cast("array<string>").alias("header"), s.alias("line")))
    flat = chunks.select("document_id", F.explode(F.concat(tb.table_rows(F.col("content")), lines)).alias("r")).select("document_id", "r.header", tb.plain(F.col("r.line")).alias("line"))
    wanted = [tb.plain(F.col(c)).alias(f"_{c}") for c in ("value", "row", "column")]
    asked = cells.select("document_id", "cell_id", *wanted)
    named = F.coalesce(F.exists("header", lambda h: F.contains(tb.plain(h), F.col("_column"))), F.contains("line", F.col("_column")))
    found = asked.join(flat, "document_id").where(F.contains("line", F.col("_value")) & F.contains("line", F.col("_row")) & named)
    hit = found.select("document_id", "cell_id").distinct().withColumn("_hit", F.lit(True))
    return cells.join(hit, ["document_id", "cell_id"], "left").withColumn("intact", F.coalesce("_hit", F.lit(False))).drop("_hit")

