"""Hashed keys of document blocks met in buckets.

Documents are dealt to blocks of bounded bytes by the hash of their id; this is the only time texts are shuffled, and
all later steps read that one shuffle again. A block sends each bucket the keys that fall to it as packed arrays, the
bucket compares what all blocks sent, and answers each block in the order it sent. A key that is frequent everywhere
arrives once per block. There are as many buckets as blocks, each a task's work of its own, and a message for each pair;
so that messages stay in proportion to the input, blocks grow with its square root, from 8 MB up to 110 GB of input to
256 MB at 100 TB, where a message holds about a kilobyte.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cells, n_parts, text_bytes

#: The smallest block, the largest that grows by itself, and the input's bytes for each squared block byte.
BLOCK_BYTES, MOST_BYTES, GROWTH = 8 << 20, 256 << 20, 640
MESSAGE = "bucket int, block int, kind int, body binary"
MESSAGE_ARROW = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("kind", pa.int32()), ("body", pa.binary())])
#: Kinds of messages: keys to compare, and what a block keeps for its next step.
KEYS, STATE = 0, 1


def messages(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, MESSAGE_ARROW, strict=True)], schema=MESSAGE_ARROW)


def grown(total: int, least: int = BLOCK_BYTES) -> int:
    """Bytes of a block for an input of ``total`` bytes."""
    return max(least, min(MOST_BYTES, int((total * GROWTH) ** 0.5)))


def document_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int | None, *more) -> tuple[DataFrame, int]:
    """(doc_id, text, block, ...), dealt to a partition a block, and the number of blocks.

    Rows with one id share a block, null ids too. Without ``block_bytes`` blocks grow with the input.
    """
    base = docs.select(F.col(cells(id_col)).cast("bigint").alias("doc_id"), F.coalesce(F.col(cells(text_col)).cast("string"), F.lit("")).alias("text"), *more)
    total = text_bytes(base)
    n = n_parts(docs.sparkSession, total, block_bytes or grown(total))
    return base.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")).repartition(n, "block"), n


def ordered(table: pa.Table) -> tuple[list, list[bytes]]:
    """Ids and texts of a block, by id (null first), then text."""
    ids = table["doc_id"].to_pylist()
    texts = table["text"].cast(pa.large_binary()).to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i]))
    return [ids[i] for i in order], [texts[i] for i in order]


def met(sent: DataFrame, n: int, compare: Callable[[int, list], list[np.ndarray]], decode: Callable[[int, bytes], object]) -> DataFrame:
    """Answers to messages, bucket by bucket of ``n``; state messages pass.

    ``compare(kind, decoded)`` gets what the blocks sent of one kind, and returns one array for each.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        out = [(r["bucket"], r["block"], r["kind"], r["body"]) for r in rows if r["kind"] == STATE]
        for kind in sorted({r["kind"] for r in rows} - {STATE}):
            own = sorted((r for r in rows if r["kind"] == kind), key=lambda r: r["block"])
            answers = compare(kind, [decode(kind, r["body"]) for r in own])
            out += [(r["bucket"], r["block"], kind, a.tobytes()) for r, a in zip(own, answers, strict=True)]
        return messages(out)

    return sent.repartition(n, "bucket").groupBy("bucket").applyInArrow(run, MESSAGE)


def packed_counts(counts: np.ndarray) -> bytes:
    """A byte a count, and the full number of those of 255 and more after all the bytes."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<u8").tobytes()


def unpacked_counts(body: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(body[:n], dtype=np.uint8).astype(np.int64)
    big = out == 255
    out[big] = np.frombuffer(body[n : n + 8 * int(big.sum())], dtype="<u8")
    return out
