"""A Merkle manifest of a dataset by time-forward processing.

Nodes are labelled (level, index). A priority queue ordered by label delivers each digest to the node's parent: a node is
worked off when it comes to the front, by when all its children have sent theirs. A reversed sweep then runs from the
root down and delivers the rest of the proof, from a node's parent up, to its children, until every leaf has its own.

The queue is external: inside a task it holds one block of ``ARITY ** HEIGHT`` consecutive nodes, and what goes on to
nodes beyond the block is a row of a table that Spark sorts by label. A source of n leaves takes log n / log of the block
rounds, each of them a shuffle of digests; texts are never shuffled, and a source that holds a third of all rows is as
many blocks as its leaves need. The position of a leaf comes from a sort by range and from counts of the ranges.
"""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cells, cut, shuffle_partitions

ARITY, HEIGHT = 3, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODES = "key string, idx bigint, count bigint, digest binary"
NODES_ARROW = pa.schema([("key", pa.string()), ("idx", pa.int64()), ("count", pa.int64()), ("digest", pa.binary())])
SUFFIXES = "key string, block bigint, subroot string, suffix string"
SUFFIXES_ARROW = pa.schema([("key", pa.string()), ("block", pa.int64()), ("subroot", pa.string()), ("suffix", pa.string())])
LEAVES = "doc_id bigint, leaf string, subroot string, proof_sha256 string, folded_root string"
LEAVES_ARROW = pa.schema([("doc_id", pa.int64()), *((n, pa.string()) for n in ("leaf", "subroot", "proof_sha256", "folded_root"))])


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def depth(n: int, arity: int) -> int:
    """Levels above n nodes until one remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // arity), levels + 1
    return levels


def sweep_up(digests: list[str], levels: int, arity: int = ARITY) -> dict[tuple[int, int], str]:
    """Digests by label; nodes leave the queue in the order of labels and send their digest to their parent."""
    nodes = {(0, i): d for i, d in enumerate(digests)}
    queue = [(1, i // arity, i, d) for i, d in enumerate(digests)] if levels else []
    while queue:
        label, got = queue[0][:2], []
        while queue and queue[0][:2] == label:
            got.append(heapq.heappop(queue)[3])
        level, i = label
        nodes[label] = own = h("".join(got))
        if level < levels:
            heapq.heappush(queue, (level + 1, i // arity, i, own))
    return nodes


def sweep_down(nodes: dict[tuple[int, int], str], levels: int, suffix: str, arity: int = ARITY) -> list[str]:
    """The proof suffix of every leaf, given that of the top.

    A suffix has a step a level, from the bottom up, each "digests to the left|digests to the right,".
    """
    found: dict[int, str] = {}
    queue = [(-levels, 0, suffix)]
    while queue:
        minus, i, own = heapq.heappop(queue)
        if minus == 0:
            found[-i] = own
            continue
        level, first = -minus - 1, -i * arity
        family = [c for c in range(first, first + arity) if (level, c) in nodes]
        for c in family:
            left, right = ("".join(nodes[level, o] for o in family if side(o, c)) for side in (int.__lt__, int.__gt__))
            heapq.heappush(queue, (-level, -c, f"{left}|{right},{own}"))
    return [found[i] for i in range(len(found))]


def fold(leaf: str, suffix: str) -> str:
    """The root that a leaf and its proof give."""
    for step in suffix.split(",")[:-1]:
        left, right = step.split("|")
        leaf = h(left + leaf + right)
    return leaf


def leaf_digest(fields: list[Column]) -> Column:
    """sha256 over each field's byte count, ":" and value, or "-" where it is null."""
    texts = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def indexed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``idx``, the place in the order within their ``key``, and ``count``, the key's rows.

    Rows are sorted by range; counts are taken of each (key, range), so no key passes one task.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(shuffle_partitions(spark), "key", *order).sortWithinPartitions("key", *order)
    dealt = cut(dealt.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    per = dealt.groupBy("key", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("key")
    per = per.select("key", "part", "first", F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.sum("n").over(own).alias("count"))
    return dealt.join(per, ["key", "part"]).withColumn("idx", F.col("at") - F.col("first") + F.coalesce("before", F.lit(0))).drop("part", "at", "first", "before")


def _in_order(table: pa.Table, arity: int, height: int) -> tuple[pa.Table, list[str], int]:
    """A block's nodes in order, their digests, and the levels to climb."""
    table, count = table.sort_by("idx"), table["count"][0].as_py()
    return table, [d.hex() for d in table["digest"].to_pylist()], depth(count, arity) if count <= arity**height else height


def up(nodes: DataFrame, arity: int, height: int) -> DataFrame:
    """The nodes ``height`` levels above (or the one top of a key that fits a block)."""
    size = arity**height

    def run(table: pa.Table) -> pa.Table:
        table, digests, levels = _in_order(table, arity, height)
        count = table["count"][0].as_py()
        top = sweep_up(digests, levels, arity)[levels, 0]
        row = {"key": table["key"][0].as_py(), "idx": table["idx"][0].as_py() // size, "count": -(-count // size), "digest": bytes.fromhex(top)}
        return pa.Table.from_pylist([row], schema=NODES_ARROW)

    blocks = nodes.select("key", "idx", "count", "digest", F.floor(F.col("idx") / size).alias("block"))
    return blocks.groupBy("key", "block").applyInArrow(run, NODES)


def climb(nodes: DataFrame, arity: int, height: int) -> list[DataFrame]:
    """Tables of nodes from the leaves to the tops of all keys, ``height`` levels apart."""
    tables = [nodes]
    most = nodes.agg(F.max("count")).first()[0] or 0
    while True:
        tables.append(cut(up(tables[-1], arity, height)))
        most = -(-most // arity**height)
        if most <= 1:
            return tables


def down(nodes: DataFrame, suffixes: DataFrame, arity: int, height: int, last: bool) -> DataFrame:
    """The suffixes of ``nodes`` from those of the blocks' tops; with ``last`` the nodes are leaves and get all their columns."""
    size = arity**height

    def run(table: pa.Table, tops: pa.Table) -> pa.Table:
        table, digests, levels = _in_order(table, arity, height)
        subroot, suffix = tops["subroot"][0].as_py(), tops["suffix"][0].as_py()
        own = sweep_down(sweep_up(digests, levels, arity), levels, suffix, arity)
        if not last:
            columns = [table["key"], table["idx"], pa.array([subroot] * len(own)), pa.array(own)]
            return pa.Table.from_arrays(columns, schema=SUFFIXES_ARROW)
        tampered = [d if t is None else t.hex() for d, t in zip(digests, table["tampered"].to_pylist(), strict=True)]
        proofs = [h(s.replace("|", "").replace(",", "")) for s in own]
        columns = [table["doc_id"], pa.array(digests), pa.array([subroot] * len(own)), pa.array(proofs), pa.array([fold(d, s) for d, s in zip(tampered, own, strict=True)])]
        return pa.Table.from_arrays(columns, schema=LEAVES_ARROW)

    blocks = nodes.withColumn("block", F.floor(F.col("idx") / size))
    return blocks.groupBy("key", "block").cogroup(suffixes.groupBy("key", "block")).applyInArrow(run, LEAVES if last else SUFFIXES)


def descend(tables: list[DataFrame], suffixes: DataFrame, arity: int, height: int, last: bool) -> DataFrame:
    """Carries the suffixes of the tops down to the first table."""
    for i in range(len(tables) - 2, -1, -1):
        suffixes = down(tables[i], suffixes, arity, height, last and i == 0)
    return suffixes


def merkle_manifest(docs: DataFrame, arity: int = ARITY, height: int = HEIGHT) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Leaves of a source ascend by doc_id (null first), rows of one id by their leaf; sources ascend bytewise, null first.
    Null fields are "-" and differ from empty ones; a null id counts as an empty one in the choice of the leaves that are
    tampered with. A tree of one leaf is that leaf, a proof without siblings the hash of nothing. Texts of any length are
    hashed where they lie. An empty table gives an empty table. Other columns aren't read, whatever their names are; a
    missing one of the five counts as null.
    """
    names = {c.lower(): c for c in docs.columns}
    own = {f: F.col(cells(names[f])) if f in names else F.lit(None).cast("string") for f in FIELDS}
    changed = own | {"text": F.replace(own["text"].cast("string"), F.lit("\n"), F.lit(""))}
    leaf, other = (leaf_digest([x[f] for f in FIELDS]) for x in (own, changed))
    chosen = F.crc32(F.coalesce(own["doc_id"].cast("string"), F.lit("")).cast("binary")) % 2 == 0
    source = own["source"].cast("string")
    key = F.coalesce(F.concat(F.lit("v"), source), F.lit("n"))  # null first
    rows = docs.select(key.alias("key"), own["doc_id"].cast("bigint").alias("doc_id"), F.unhex(leaf).alias("digest"), F.when(chosen & F.contains(own["text"].cast("string"), F.lit("\n")), F.unhex(other)).alias("tampered"))
    leaves = cut(indexed(rows, ["doc_id", "digest"]))
    tables = climb(leaves, arity, height)
    tops = tables[-1].select(F.lit("").alias("key"), F.col("key").alias("source"), "digest")
    over = climb(indexed(tops, ["source"]), arity, height)
    top = over[-1].first()
    root = top["digest"].hex() if top else ""
    start = over[-1].select("key", F.lit(0).cast("bigint").alias("block"), F.lit("").alias("subroot"), F.lit("").alias("suffix"))
    by_source = descend(over, start, arity, height, False).withColumnRenamed("block", "idx")
    named = by_source.drop("subroot").join(over[0].select("key", "idx", "source", "digest"), ["key", "idx"])
    named = named.select(F.col("source").alias("key"), F.lit(0).cast("bigint").alias("block"), F.lower(F.hex("digest")).alias("subroot"), "suffix")
    found = descend(tables, cut(named), arity, height, True)
    return found.select("doc_id", "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))
