"""Document fingerprints from Lempel-Ziv phrases.

A text's UTF-8 bytes are parsed into dictionary phrases (LZ78: the longest known phrase plus one byte becomes a new
phrase). The set of phrases is hashed and its minimum hash in each of ``SLOTS`` classes is the signature (empty classes
take the next class's, marked by the distance). The share of equal slots is the likeness: texts that would compress well
together share phrases. Parsing costs one dictionary look-up a byte.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import U64, cells, mix, n_parts, shuffle_partitions

SLOTS = 64
LOWEST = -(1 << 63)


class Parse:
    """An LZ78 parse that can go on and be taken back to an earlier point. ``sizes`` has the phrases' lengths."""

    def __init__(self) -> None:
        self.known: dict[int, int] = {}
        self.node, self.sizes, self.length = 0, [], [0]

    def feed(self, data: bytes) -> list[int]:
        """Parses on; the dictionary keys that are new."""
        known, node, sizes, length, new = self.known, self.node, self.sizes, self.length, []
        get = known.get
        for b in data:
            key = node << 8 | b
            child = get(key)
            if child is None:
                known[key] = len(length)
                size = length[node] + 1
                length.append(size)
                sizes.append(size)
                new.append(key)
                node = 0
            else:
                node = child
        self.node = node
        return new

    def back(self, node: int, phrases: int, new: list[int]) -> None:
        for key in new:
            del self.known[key]
        del self.sizes[phrases:]
        del self.length[phrases + 1 :]
        self.node = node


_BASE = 0x9FB21C651E98DF25
_UP = np.ones(1, dtype=U64)
_DOWN = np.ones(1, dtype=U64)


def _ladders(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2 ** 64, and of its inverse."""
    global _UP, _DOWN
    if len(_UP) < n:
        for sign in (1, -1):
            k = np.full(n, U64(pow(_BASE, sign, 1 << 64)), dtype=U64)
            k[0] = 1
            if sign == 1:
                _UP = np.cumprod(k)
            else:
                _DOWN = np.cumprod(k)
    return _UP, _DOWN


def signatures(parsed: list[tuple[bytes, list[int]]]) -> list[np.ndarray]:
    """Minimum-hash signatures of parsed texts (bytes, phrase lengths); empty for an empty text.

    The last, unfinished phrase counts as one.
    """
    real = [i for i, (data, _) in enumerate(parsed) if data]
    out = [np.zeros(0, dtype=np.uint16)] * len(parsed)
    if not real:
        return out
    lengths = [parsed[i][1] + [len(parsed[i][0]) - sum(parsed[i][1])] for i in real]
    size = np.concatenate([np.array(x, dtype=np.int64) for x in lengths])
    doc = np.repeat(np.arange(len(real)), [len(x) for x in lengths])
    doc, size = doc[size > 0], size[size > 0]
    end = np.cumsum(size)
    raw = np.frombuffer(b"".join(parsed[i][0] for i in real), dtype=np.uint8).astype(U64) + U64(1)
    up, down = _ladders(len(raw) + 1)
    sums = np.concatenate((np.zeros(1, dtype=U64), np.cumsum(raw * up[: len(raw)])))
    h = mix((sums[end] - sums[end - size]) * down[end - size] ^ size.astype(U64))
    low = np.full(len(real) * SLOTS, np.iinfo(np.uint64).max, dtype=U64)
    cell = doc * SLOTS + (h % U64(SLOTS)).astype(np.int64)
    np.minimum.at(low, cell, h)
    low = low.reshape(-1, SLOTS)
    taken = np.bincount(cell, minlength=low.size).reshape(-1, SLOTS) > 0
    own = np.arange(SLOTS)
    far = np.where(np.concatenate((taken, taken), axis=1), np.arange(2 * SLOTS), 4 * SLOTS)
    source = np.minimum.accumulate(far[:, ::-1], axis=1)[:, ::-1][:, :SLOTS]  # the next taken class, around the end
    value = mix(np.take_along_axis(low, source % SLOTS, axis=1) + (source - own).astype(U64)) >> U64(48)
    for k, i in enumerate(real):
        out[i] = value[k].astype(np.uint16)
    return out


def text_of(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal slots; two empty texts are alike, an empty and another are not."""
    return float(len(a) == len(b)) if not len(a) or not len(b) else float((a == b).mean())


def parse_with_edit(text: str, following: str) -> tuple[int, tuple[bytes, list[int]], tuple[bytes, list[int]]]:
    """Code points of the text, and the parses of it and of its edited text; the common beginning is parsed once."""
    half = len(text) // 2
    keep = text[: len(text) - half].encode()
    rest, put = text[len(text) - half :].encode(), following[:half].encode()
    parse = Parse()
    parse.feed(keep)
    node, phrases = parse.node, len(parse.sizes)
    new = parse.feed(rest)
    own = list(parse.sizes)
    parse.back(node, phrases, new)
    parse.feed(put)
    return len(text), (keep + rest, own), (keep + put, parse.sizes)


def parse_whole(text: str) -> tuple[bytes, list[int]]:
    data, parse = text.encode(), Parse()
    parse.feed(data)
    return data, parse.sizes


def fingerprint(text: str) -> np.ndarray:
    return signatures([parse_whole(text)])[0]


#: Ids of the sample for each range, and the most ranges.
SAMPLE, MOST_RANGES = 100, 16_384


def with_next(docs: DataFrame, id_col: str, text_col: str, part_bytes: int) -> DataFrame:
    """Documents dealt to ranges of ids, each range followed by the first document of the next (the last by the first).

    Columns part, borrowed, key, doc_id, text; sorted by the first three and the text within a task. Range bounds are
    quantiles of a sample of the ids (about ``SAMPLE`` a range, chosen by hash; every document is dealt out). There are
    at most ``MOST_RANGES`` ranges whatever the input's size (tasks stream through theirs), so what is collected and
    broadcast, one short row a range, has a fixed bound.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(cells(id_col)).cast("bigint").alias("doc_id"), F.coalesce(F.col(cells(text_col)).cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("key", F.coalesce("doc_id", F.lit(LOWEST)))
    size = base.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    n = min(n_parts(spark, size["bytes"] or 0, part_bytes), max(MOST_RANGES, shuffle_partitions(spark)))
    every = max(1, size["rows"] // (n * SAMPLE))
    some = base.where(F.pmod(F.xxhash64("key", F.lit("ranges")), F.lit(every)) == 0)
    cuts = some.agg(F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], 100 * n)).first()[0] or [0]  # an empty table has none
    splits = [-float("inf"), *sorted({float(x) for x in cuts}), float("inf")]
    ranged = Bucketizer(splits=splits, inputCol="_f", outputCol="_p").transform(base.withColumn("_f", F.col("key").cast("double"))).withColumn("part", F.col("_p").cast("int")).drop("_f", "_p")
    firsts = ranged.groupBy("part").agg(F.min("key").alias("first")).collect()  # one row a range
    firsts = sorted((r["part"], r["first"]) for r in firsts)
    before = [(firsts[i][0], firsts[i][1], firsts[i - 1][0]) for i in range(len(firsts))]
    lend = F.broadcast(spark.createDataFrame(before, "part int, first bigint, lender int"))
    rows = ranged.join(lend, "part")
    to = F.array(F.struct(F.col("part").alias("p"), F.lit(0).alias("b")))
    to = F.when(F.col("key") == F.col("first"), F.concat(to, F.array(F.struct(F.col("lender").alias("p"), F.lit(1).alias("b"))))).otherwise(to)
    rows = rows.withColumn("_to", F.explode(to)).select(F.col("_to.p").alias("part"), F.col("_to.b").alias("borrowed"), "key", "doc_id", "text")
    return rows.repartitionById(n, F.col("part")).sortWithinPartitions("part", "borrowed", "key", "text")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = 12 << 20) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one with the next id; rows with one id are in order of their texts, null ids come first,
    and after the last comes the first. Null texts are empty; an empty text's fingerprint is an empty string. An empty
    table gives an empty table.
    """

    def run(batches):
        held: tuple | None = None  # (part, id, text), waiting for the next document
        done: set[int] = set()
        waiting: list[tuple] = []  # (part, id, code points, parse, edited parse or None for a lent document)
        carried: list[tuple] = []  # the last row, with its signatures
        size = 0

        def flush():
            nonlocal waiting, carried, size
            sigs = signatures([w[3] for w in waiting] + [w[4] or (b"", []) for w in waiting])
            rows = carried + [(w[0], w[1], w[2], hashlib.sha256(w[4][0]).hexdigest() if w[4] else None, sigs[i], sigs[len(waiting) + i], w[4] is None) for i, w in enumerate(waiting)]
            out = [(a[1], a[2], a[3], text_of(a[4]), text_of(a[5]), likeness(a[4], a[5]), likeness(a[4], b[4])) for a, b in zip(rows[:-1], rows[1:], strict=True) if not a[6]]
            carried, waiting, size = rows[-1:], [], 0
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            columns = zip(*out, strict=True) if out else [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], NAMES)

        for batch in batches:
            for part, borrowed, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("part", "borrowed", "doc_id", "text")), strict=True):
                if borrowed and part in done:
                    continue  # ties of the lent first document
                if held is not None:
                    waiting.append((held[0], held[1], *parse_with_edit(held[2], text)))
                    size += len(held[2])
                held = (part, doc_id, text)
                if borrowed:
                    done.add(part)
                    waiting.append((part, doc_id, len(text), parse_whole(text), None))
                    held = None
                if size > 1 << 19:
                    yield flush()
        if waiting:
            yield flush()

    dealt = with_next(docs, id_col, text_col, part_bytes).select("part", "borrowed", "doc_id", "text")
    return dealt.mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
