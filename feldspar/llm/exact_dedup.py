"""Exact deduplication by skew-safe combining.

Three stages, each comparing the full normalised content (the digest only routes rows):

1. local: within each task's buffer, equal texts of one salt fold into one row that lists its members;
2. salted: local winners meet by (digest, salt), so a digest that holds a third of all rows is spread;
3. global: the salts' winners, at most ``salts`` per text, meet by digest.

The salt is a hash of the row's id, and decisions travel back by digest, salt and content: nothing depends on the
order in which rows arrive, so a repeated task agrees with the first. Of equal texts the row with the most code points,
then the smallest id, stays.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import SPACE_CLASS, cells, hidden, restored, utf8

DROP = b" \t\n\x0b\x0c\r"
LOCAL = ["digest", "points", "members"]


def _fold(id_col: str, text_col: str, buffer_bytes: int):
    """Folds equal texts of a buffer and salt; keeps the winner's whole row, and the members' ids with the winner's first."""

    def folded(table: pa.Table):
        texts = utf8(table[text_col])
        ids, salts = table[id_col].to_pylist(), table["salt"].to_pylist()
        groups: dict[tuple, list[int]] = {}
        for i, x in enumerate(texts):
            groups.setdefault((salts[i], x.translate(None, DROP)), []).append(i)
        points = [len(x) - int(np.count_nonzero((np.frombuffer(x, np.uint8) & 0xC0) == 0x80)) for x in texts]
        win, members = [], []
        for rows in groups.values():
            rows.sort(key=lambda i: (-points[i], ids[i] is None, 0 if ids[i] is None else ids[i], i))
            win.append(rows[0])
            members.append([ids[i] for i in rows])
        digest = [hashlib.sha256(norm).hexdigest() for _, norm in groups]
        out = table.take(pa.array(win, pa.int64()))
        for name, values in zip(LOCAL, (pa.array(digest, pa.string()), pa.array([points[i] for i in win], pa.int64()), pa.array(members, pa.list_(table.schema.field(id_col).type))), strict=True):
            out = out.append_column(name, values)
        yield from out.to_batches()

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= buffer_bytes:
                yield from folded(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            yield from folded(pa.Table.from_batches(held))

    return run


def _content(text_col: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE_CLASS, "")


def _salted(docs: DataFrame, id_col: str, text_col: str, salts: int, buffer_bytes: int) -> DataFrame:
    """Local winners with their rank and the number of rows of their (digest, salt, content)."""
    salted = docs.withColumn("salt", F.pmod(F.xxhash64(id_col), F.lit(salts)).cast("int"))
    fields = ", ".join(f"{n} {t}" for n, t in salted.dtypes)
    local = salted.mapInArrow(_fold(id_col, text_col, buffer_bytes), f"{fields}, digest string, points bigint, members array<{dict(docs.dtypes)[id_col]}>")
    same = Window.partitionBy("digest", "salt", "norm").orderBy(F.desc("points"), F.asc_nulls_last(id_col))
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        local.repartition("digest", "salt")
        .withColumn("norm", _content(text_col))
        .withColumn("rank", F.row_number().over(same))
        .withColumn("rows", F.sum(F.size("members")).over(whole))
        # never null, so that no filter on it goes below the exchange and parts the two plans that read it
        .withColumn("group", F.concat_ws(":", "digest", "salt", F.xxhash64("norm")))
        .drop("norm")
    )


def _winners(salted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each salt's winner, with the salt and id of the row that stays and the whole group's size."""
    whole = Window.partitionBy("digest", "norm").orderBy(F.desc("points"), F.asc_nulls_last(id_col), "salt").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        salted.where("rank = 1")
        .repartition("digest")
        .withColumn("norm", _content(text_col))
        .withColumn("keep_salt", F.first("salt").over(whole))
        .withColumn("keep_id", F.first(id_col).over(whole))
        .withColumn("group_size", F.sum("rows").over(whole))
        .drop("norm")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, buffer_bytes: int = 32 << 20) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns (of any names), and nothing added.

    Null text counts as empty, and all empty texts are one group. Ids may be null (they lose ties) or repeat (one of
    equal rows stays). An empty table gives an empty table.
    """
    plain, (own_id, text) = hidden(docs, id_col, text_col)
    return restored(_winners(_salted(plain, own_id, text, salts, buffer_bytes), own_id, text).where("salt = keep_salt"), docs)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, buffer_bytes: int = 32 << 20) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Of repeated rows (same id and text) exactly one is kept. Both branches below read one shuffle of the local winners.
    """
    base = docs.select(F.col(cells(id_col)).cast("bigint").alias("doc_id"), F.col(cells(text_col)).cast("string").alias("text"))
    salted = _salted(base, "doc_id", "text", salts, buffer_bytes)
    final = _winners(salted, "doc_id", "text").select("group", "keep_salt", "keep_id", "group_size")
    rows = salted.select("group", "salt", "rank", "members").join(final, "group")
    rows = rows.select("*", F.posexplode("members").alias("place", "doc_id"))
    kept = (F.col("salt") == F.col("keep_salt")) & (F.col("rank") == 1) & (F.col("place") == 0)
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.substring("group", 1, 64).alias("text_sha256"))
