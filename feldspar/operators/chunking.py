"""Chunks from ordered elements, gates and near-duplicate originals.

A document's elements are folded in Arrow batches; a document is one array, so a task holds one document at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sizes in characters.
HARD, SOFT, MERGE_UNDER = 2000, 1500, 250
ELEMENTS = "array<struct<text:string,category:string>>"
CHUNKS = "document_id bigint, chunk_index int, content string, section string, is_table boolean"


def split_prose(text: str, hard: int) -> list[str]:
    """Pieces of at most ``hard`` characters, cut at the last space inside them where there is one."""
    out = []
    while len(text) > hard:
        at = text.rfind(" ", 1, hard)
        at = hard if at < 0 else at
        out.append(text[:at])
        text = text[at:].lstrip()
    return [*out, text] if text else out


def split_table(text: str, limit: int) -> list[str]:
    """Pieces on row boundaries; a piece takes one row at least, and repeats the header where a rule follows the first line."""
    lines = text.split("\n")
    if len(text) <= limit:
        return [text]
    ruled = len(lines) > 2 and lines[1].strip().startswith("|") and not lines[1].strip().strip("|-: ")
    head = lines[:2] if ruled else []
    out, rows, size = [], [], sum(map(len, head)) + len(head)
    own = size
    for row in lines[len(head):]:
        if rows and size + len(row) > limit:
            out.append("\n".join(head + rows))
            rows, size = [], own
        rows.append(row)
        size += len(row) + 1
    return [*out, "\n".join(head + rows)] if rows else out


def fold(elements: list[tuple[str, str]], hard: int = HARD, soft: int = SOFT, merge_under: int = MERGE_UNDER, table_max: int | None = None) -> list[tuple[str, str | None, bool]]:
    """(text, section, is a table) of a document's chunks.

    Elements over ``hard`` are cut first, and their last piece goes on collecting. Prose closes a chunk that it would bring
    over ``soft``; a title closes one of ``merge_under`` and more. A table is a chunk of its own, or several of up to
    ``table_max`` characters.
    """
    chunks: list[tuple[str, str | None, bool]] = []
    held: list[str] = []
    section = own = None

    def size() -> int:
        return len("\n\n".join(held))

    def close() -> None:
        if held:
            chunks.append(("\n\n".join(held), own, False))
            held.clear()

    for text, category in elements:
        if category == "table":
            close()
            chunks += [(p, section, True) for p in split_table(text, min(hard, table_max or hard))]
            continue
        if category == "title":
            section = text
        for piece in [text] if category == "title" else split_prose(text, hard):
            if held and (size() >= merge_under if category == "title" else size() + len(piece) > soft):
                close()
            if not held:
                own = section
            held.append(piece)
    close()
    return merge_small(chunks, hard, merge_under)


def merge_small(chunks: list[tuple[str, str | None, bool]], hard: int, under: int) -> list[tuple[str, str | None, bool]]:
    """Small prose folds into the prose before it where both fit; a small first chunk folds forward into prose."""
    out: list[tuple[str, str | None, bool]] = []
    for text, section, table in chunks:
        if out and not table and not out[-1][2] and len(text) < under and len(out[-1][0]) + 2 + len(text) <= hard:
            out[-1] = (f"{out[-1][0]}\n\n{text}", out[-1][1], False)
        else:
            out.append((text, section, table))
    if len(out) > 1 and not out[1][2] and len(out[0][0]) < under and len(out[0][0]) + 2 + len(out[1][0]) <= hard:
        out[:2] = [(f"{out[0][0]}\n\n{out[1][0]}", out[1][1] or out[0][1], out[0][2])]
    return out


def record(elements: list[tuple[str, str]], hard: int = HARD, soft: int = SOFT, merge_under: int = MERGE_UNDER) -> list[tuple[str, str | None, bool]]:
    """A record is one chunk under its first title; one over ``hard`` characters falls back to section chunks."""
    whole = "\n\n".join(text for text, _ in elements if text.strip()).strip()
    if whole and len(whole) <= hard:
        return [(whole, next((t for t, c in elements if c == "title"), None), any(c == "table" for _, c in elements))]
    return fold(elements, hard, soft, merge_under)


def chunk_documents(elements: DataFrame, hard: int = HARD, soft: int = SOFT, merge_under: int = MERGE_UNDER, records: bool = False) -> DataFrame:
    """Chunks of rows (document_id, elements in order); ``records``: by the record profile."""
    cut = record if records else fold

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, i, text, section, table) for d, es in zip(pdf["document_id"], pdf["elements"], strict=True) for i, (text, section, table) in enumerate(cut([(e["text"], e["category"]) for e in (es if es is not None else [])], hard, soft, merge_under))]
            yield pd.DataFrame(rows, columns=["document_id", "chunk_index", "content", "section", "is_table"])

    return elements.select("document_id", "elements").mapInPandas(run, CHUNKS)


def markdown_elements(text: Column) -> Column:
    """Elements of Markdown lines, as an array: bars gather in tables, # starts a title, bullets are items, the rest
    joins into paragraphs with spaces; blank lines end an element."""
    lines = F.split(text, "\n")
    kind = lambda s: F.when(F.trim(s) == "", "blank").when(F.trim(s).startswith("|"), "table").when(F.trim(s).startswith("#"), "title").when(F.trim(s).rlike(r"^([-*]|\d+\.) "), "list_item").otherwise("text")
    clean = lambda s, k: F.when(k == "title", F.regexp_replace(F.trim(s), r"^#+\s*", "")).when(k == "list_item", F.regexp_replace(F.trim(s), r"^([-*]|\d+\.) +", "")).otherwise(F.trim(s))
    empty = F.lit(None).cast("string")
    start = F.struct(F.array().cast(ELEMENTS).alias("done"), empty.alias("text"), empty.alias("category"))

    def flush(acc: Column) -> Column:
        return F.when(acc["text"].isNotNull(), F.concat(acc["done"], F.array(F.struct(acc["text"].alias("text"), acc["category"].alias("category"))))).otherwise(acc["done"])

    def step(acc: Column, s: Column) -> Column:
        k = kind(s)
        goes_on = (k == acc["category"]) & k.isin("table", "text")
        joined = F.concat(acc["text"], F.when(k == "table", F.lit("\n")).otherwise(F.lit(" ")), clean(s, k))
        return F.when(goes_on, F.struct(acc["done"].alias("done"), joined.alias("text"), k.alias("category"))).otherwise(
            F.struct(flush(acc).alias("done"), F.when(k != "blank", clean(s, k)).alias("text"), F.when(k != "blank", k).alias("category"))
        )

    return F.aggregate(lines, start, step, flush)


def gates(chunks: DataFrame, min_chunks: int, low: int, high: int, terms: list[str]) -> DataFrame:
    """Per document the first gate that fails (null: all pass): too few chunks, a median size outside, a missing term."""
    body = F.lower(F.array_join(F.array_sort(F.collect_list("content")), "\n"))
    got = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.percentile(F.length("content"), 0.5).alias("median"), body.alias("_body"))
    missing = F.lit(False)
    for t in terms:
        missing |= ~F.col("_body").contains(t.lower())
    return got.select("document_id", "n", "median", F.when(F.col("n") < min_chunks, "min_chunks").when(~F.col("median").between(low, high), "median_size").when(missing, "expected_terms").alias("failed"))


def boilerplate(documents: DataFrame, sentences: Column, least: int = 2, share: float = 0.02, from_documents: int = 20) -> DataFrame:
    """Sentences in more than max(least, share of all) documents; none below ``from_documents`` documents."""
    n = documents.count()
    flat = documents.select(F.explode(F.array_distinct(sentences)).alias("sentence"))
    return flat.groupBy("sentence").agg(F.count(F.lit(1)).alias("documents")).where((F.col("documents") > max(least, share * n)) & F.lit(n >= from_documents))
