"""Helpers that several training-data operators share.

Texts are handled as UTF-8 bytes in numpy inside Arrow tasks; Spark does the partitioning, shuffling and joining.
A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
SPACE_CLASS = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local session may leave it unset."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(found)
    return found


def cells(name: str) -> str:
    """A column's name in back quotes, for names with dots and the like."""
    return "`" + name.replace("`", "``") + "`"


def hidden(docs: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with its columns called c0, c1, ... whatever their names are, and what the named ones are called now."""
    low = [c.lower() for c in docs.columns]
    return docs.toDF(*[f"c{i}" for i in range(len(low))]), [f"c{low.index(n.lower())}" for n in names]


def restored(rows: DataFrame, docs: DataFrame, **more: str) -> DataFrame:
    """The columns of ``docs`` under their own names again, then ``more`` (name = column).

    A name of ``more`` that ``docs`` has already gets as many underscores appended as it needs.
    """
    taken = {c.lower() for c in docs.columns}
    out = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]
    for name, column in more.items():
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(F.col(column).alias(name))
    return rows.select(*out)


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_parts(spark: SparkSession, total_bytes: int, part_bytes: int) -> int:
    return max(shuffle_partitions(spark), math.ceil((total_bytes or 0) / part_bytes), 1)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(F.col(text).cast("string"))).alias("b")).first()["b"] or 0


def utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The column's texts in UTF-8; null is empty."""
    got = column.cast(pa.large_binary()).to_pylist()
    return [x or b"" for x in got]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; equal numbers stay equal, near ones part."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def join_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of two neighbouring spans from theirs."""
    return mix(left * U64(3) + right * U64(0x9E3779B97F4A7C15))


_PARTS = np.array([x < 128 and not chr(x).isalnum() for x in range(256)])
_BASE = 0xD6E8FEB86659FD93
_POWERS = np.ones(1, dtype=U64)


def _powers(n: int, first: int = 0) -> np.ndarray:
    """The weights of byte positions ``first`` to ``first + n - 1`` of a word; those of short words are kept."""
    global _POWERS
    if first == 0 and n <= len(_POWERS):
        return _POWERS[:n]
    k = np.full(max(n, 256), U64(_BASE), dtype=U64)
    k[0] = U64(pow(_BASE, first, 1 << 64))
    weights = mix(np.cumprod(k)) | U64(1)
    if first == 0 and len(weights) <= 1 << 16:
        _POWERS = weights
    return weights[:n]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a byte array."""
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate(([1], gap.view(np.int8), [1])))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def _plain(data: np.ndarray, lower: bool, letters: bool) -> np.ndarray:
    if lower:
        data = data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)
    return np.where(_PARTS[data], np.uint8(32), data) if letters else data


def _sums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Weighted sums of the bytes of each word; sums of a word's parts add up to the word's."""
    length = ends - starts
    before = np.concatenate(([0], np.cumsum(length)[:-1]))
    inside = np.repeat(starts - before, length) + np.arange(int(length.sum()))
    weight = _powers(int(length.max()))[inside - np.repeat(starts, length)]
    return np.add.reduceat((data[inside].astype(U64) + U64(1)) * weight, before)


def _named(sums: np.ndarray, length: np.ndarray) -> np.ndarray:
    return mix(sums ^ (length.astype(U64) * U64(0x9E3779B97F4A7C15)))


def _long_hashes(text: bytes, lower: bool, letters: bool, step: int) -> np.ndarray:
    """Word hashes of one text in windows of ``step`` bytes; a word that a window cuts carries its sum into the next."""
    out, total, held = [], U64(0), 0  # the open word's sum and bytes so far
    for at in range(0, len(text), step):
        data = _plain(np.frombuffer(text, dtype=np.uint8, count=min(step, len(text) - at), offset=at), lower, letters)
        starts, ends = word_spans(data)
        if held and (not len(starts) or starts[0]):
            out.append(_named(np.array([total]), np.array([held])))
            total, held = U64(0), 0
        if not len(starts):
            continue
        if held:
            n = int(ends[0])
            total = np.append((data[:n].astype(U64) + U64(1)) * _powers(n, held), total).sum(dtype=U64)
            held += n
            starts, ends = starts[1:], ends[1:]
            if n == len(data):
                continue
            out.append(_named(np.array([total]), np.array([held])))
            total, held = U64(0), 0
        if len(starts):
            sums, length = _sums(data, starts, ends), ends - starts
            if ends[-1] == len(data):
                total, held, sums, length = sums[-1], int(length[-1]), sums[:-1], length[:-1]
            out.append(_named(sums, length))
    if held:
        out.append(_named(np.array([total]), np.array([held])))
    return np.concatenate(out) if out else np.zeros(0, dtype=U64)


def word_hashes(texts: list[bytes], lower: bool = False, letters: bool = False, step: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, in order, and the number of words of each text.

    ``letters``: ASCII other than letters and digits parts words as well. Works through pieces of about ``step`` bytes,
    inside a text and a word too, so that temporaries don't grow with the longest text.
    """
    hashes, counts, at = [], np.zeros(len(texts), dtype=np.int64), 0
    while at < len(texts):
        if len(texts[at]) > step:
            own = _long_hashes(texts[at], lower, letters, step)
            hashes.append(own)
            counts[at] = len(own)
            at += 1
            continue
        upto, size = at, 0
        while upto < len(texts) and (size == 0 or size + len(texts[upto]) <= step) and len(texts[upto]) <= step:
            size += len(texts[upto]) + 1
            upto += 1
        part = texts[at:upto]
        data = _plain(np.frombuffer(b" ".join(part) + b" ", dtype=np.uint8), lower, letters)
        starts, ends = word_spans(data)
        if len(starts):
            hashes.append(_named(_sums(data, starts, ends), ends - starts))
            ends_of = np.cumsum([len(x) + 1 for x in part])
            counts[at:upto] = np.bincount(np.searchsorted(ends_of, starts, side="right"), minlength=len(part))
        at = upto
    return (np.concatenate(hashes) if hashes else np.zeros(0, dtype=U64)), counts


def by_bucket(buckets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by bucket and the n + 1 bounds of the buckets in it."""
    order = np.argsort(buckets, kind="stable")
    return order, np.searchsorted(buckets[order], np.arange(n + 1))


def salted_representatives(rows: DataFrame, key: str, id_col: str, salts: int = 64) -> DataFrame:
    """Rows plus ``rep`` (smallest id of the rows with equal key) and ``group_size``.

    A key may hold a third of all rows: ids are combined by (key, salt) first, then by key over at most ``salts``
    partial rows, and the answer goes back to the (key, salt) groups, so no join key holds more than its salt's share.
    """
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(id_col), F.lit(salts)))
    part = rows.groupBy(key, "_salt").agg(F.min(id_col).alias("_m"), F.count(F.lit(1)).alias("_n"))
    whole = part.groupBy(key).agg(F.min("_m").alias("rep"), F.sum("_n").alias("group_size"), F.collect_list("_salt").alias("_salts"))
    back = whole.select(key, "rep", "group_size", F.explode("_salts").alias("_salt"))
    return rows.join(back, [key, "_salt"]).drop("_salt")


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) for every id in edges (a, b): component is the smallest id that can be reached.

    Alternates large-star and small-star steps (neighbours move to the smallest one they know), each a groupBy and a
    join on node ids; hubs are combined before the shuffle. Stops when a round changes nothing.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    pairs = cut(pairs)
    nodes = pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct()
    before = None
    for _ in range(rounds):
        both = pairs.union(pairs.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        pairs = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = pairs.groupBy("u").agg(F.min("v").alias("m"))
        pairs = pairs.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        pairs = cut(pairs)
        now = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("connected components did not settle")
    found = pairs.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
    return nodes.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
