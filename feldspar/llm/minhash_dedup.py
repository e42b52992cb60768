"""Near-duplicate detection from bottom-k sketches of one hash function.

1. Each text becomes its set of word shingles (64-bit hashes); the ``k`` smallest are its sketch. Texts with equal sets
   fold into one class, represented by the smallest id.
2. Inverted lists of the retained values. A value held by one class gives no list. Of the others a class enters only
   the lists of its rarest values: two sketches that overlap in at least ``c`` of their values must share one of the
   len - c + 1 rarest of each (prefix filter), so very common values need no lists.
3. Inside a list overlaps are counted and the union-sketch estimate drops pairs that are far below the threshold. What
   is left is kept as a spanning forest of candidate groups, never as all pairs.
4. Inside a candidate group exact intersections of the full sets confirm links.
5. Connected components of the links.

Lists and groups of up to ``block_rows`` rows (and ``block_bytes`` bytes) are compared in one task; longer ones are met
block against block, so no task holds more than two blocks, and only spanning edges leave a task. A list or group of n
classes that differ is read n / block_rows times: near copies that number in the millions stay quadratic in work, though
not in rows that leave tasks. Equal texts are one class and cost nothing.

For sets of at most ``k`` shingles steps 2 and 3 lose nothing. For longer ones a pair at the threshold is missed with a
probability of at most ``MISS``: ``least_shared`` is the number of shared values that fewer draws would reach.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import U64, cells, connected_components, cut, hidden, join_hash, restored, salted_representatives, shuffle_partitions, utf8, word_hashes

K = 48
BLOCK_ROWS = 384
BLOCK_BYTES = 32 << 20
#: Rows of lists with one smallest class that meet in one task, and the most rows of a task's forest.
ROUTE_ROWS = 4096
FOREST_ROWS = 1 << 20
MISS = 1e-6


def least_shared(threshold: float, k: int) -> int:
    """The largest c for which a pair at the threshold shares fewer than c of k values with a probability of at most MISS."""
    below, c = 0.0, 0
    while c <= k:
        below += math.comb(k, c) * threshold**c * (1 - threshold) ** (k - c)
        if below > MISS:
            break
        c += 1
    return c


def shared_values(n: np.ndarray, threshold: float, k: int) -> np.ndarray:
    """How many values the sketch of a set of ``n`` shingles shares at least with that of any set that it links with.

    A set of more than k: ``least_shared``. A smaller one shares ``threshold`` of its own values with another small set;
    of a partner's k values at most (1 - threshold) of the partner's n / threshold are foreign.
    """
    c = least_shared(threshold, k)
    small = np.ceil(threshold * n - 1e-9)
    larger = np.maximum(c, np.ceil(k - (1 - threshold) * n / threshold - 1e-9))
    return np.where(n > k, c, np.where(n > threshold * k, np.minimum(small, larger), small)).astype(np.int64)


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes; fewer words than ``words``: the whole sequence as one; none: empty."""
    hashes, counts = word_hashes(texts, lower=True)
    runs = hashes
    for j in range(1, words):
        runs = join_hash(runs[: len(hashes) - j], hashes[j:]) if len(hashes) > j else runs[:0]
    out, at = [], 0
    for n in counts.tolist():
        if n >= words:
            out.append(np.unique(runs[at : at + n - words + 1]))
        elif n:
            one = hashes[at : at + 1] ^ U64(n)
            for j in range(1, n):
                one = join_hash(one, hashes[at + j : at + j + 1])
            out.append(one)
        else:
            out.append(hashes[:0])
        at += n
    return out


def digest_of(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sketch(words: int, k: int):
    def run(batches):
        for batch in batches:
            texts, at = utf8(batch.column(1)), 0
            while at < len(texts):
                upto, size = at, 0
                while upto < len(texts) and size < 4 << 20:
                    size += len(texts[upto])
                    upto += 1
                sets = shingle_sets(texts[at:upto], words)
                columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array([digest_of(s) for s in sets], pa.binary()), pa.array([s[:k].tobytes() for s in sets], pa.binary()), pa.array([hashlib.md5(x).digest() for x in texts[at:upto]], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, upto - at), *columns], ["doc_id", "n", "digest", "sketch", "text"])
                at = upto

    return run


def _values(threshold: float, k: int):
    """The values of each sketch, with the length of the prefix that must meet a partner's."""

    def run(batches):
        for batch in batches:
            rep, n, sketch = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            if not len(rep):
                continue
            values = np.frombuffer(b"".join(sketch), dtype=np.int64)
            length = np.minimum(n, k)
            prefix = length - shared_values(n, threshold, k) + 1
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rep, length)), pa.array(values), pa.array(np.repeat(length, length).astype(np.int32)), pa.array(np.repeat(prefix, length).astype(np.int32))], ["rep", "v", "held", "prefix"])

    return run


class Forest:
    """Union-find over the rows of a block; keeps the edges that joined two trees."""

    def __init__(self, n: int) -> None:
        self.up, self.edges = list(range(n)), []

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def link(self, pairs: np.ndarray) -> None:
        for i, j in pairs.tolist():
            a, b = self.root(i), self.root(j)
            if a != b:
                self.up[max(a, b)] = min(a, b)
                self.edges.append((i, j))


def overlaps(sets: list[np.ndarray], tile: int = 2048) -> np.ndarray:
    """Sizes of all intersections of a block's sets; only values that two rows share are multiplied, tile by tile."""
    m = len(sets)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = column.reshape(-1)
    shared = times > 1
    number = np.cumsum(shared) - 1
    live = shared[column]
    row, column = row[live], number[column[live]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((m, m), dtype=np.float32)
    bounds = np.searchsorted(column, np.arange(0, int(shared.sum()) + tile, tile))
    for t in range(len(bounds) - 1):
        a = np.zeros((m, tile), dtype=np.float32)
        a[row[bounds[t] : bounds[t + 1]], column[bounds[t] : bounds[t + 1]] - t * tile] = 1
        out += a @ a.T
    return out


def maybe_linked(i: int, j: int, sizes: np.ndarray, own: list[np.ndarray], k: int, threshold: float) -> bool:
    """Whether the union-sketch estimate of a pair doesn't rule the threshold out; for two whole sets, whether it holds."""
    shared = np.intersect1d(own[i], own[j], assume_unique=True)
    if sizes[i] <= k and sizes[j] <= k:
        return len(shared) >= threshold * (sizes[i] + sizes[j] - len(shared)) - 1e-6
    both = np.union1d(own[i], own[j])[:k]
    return np.count_nonzero(shared <= both[-1]) >= least_shared(threshold, k)


def estimated_links(sizes: np.ndarray, sketches: list[bytes], k: int, threshold: float, forest: Forest) -> None:
    """Links pairs that may reach the threshold."""
    own = [np.frombuffer(s, dtype=U64) for s in sketches]
    if len(own) == 2:
        pairs = [(0, 1)]
    else:
        need = shared_values(sizes, threshold, k)
        near = (overlaps(own) >= np.maximum.outer(need, need) - 1e-6) & (np.minimum.outer(sizes, sizes) >= threshold * np.maximum.outer(sizes, sizes) - 1e-6)
        pairs = np.argwhere(np.triu(near, 1)).tolist()
    for i, j in pairs:
        if forest.root(i) != forest.root(j) and maybe_linked(i, j, sizes, own, k, threshold):
            forest.link(np.array([[i, j]]))


def exact_links(sizes: np.ndarray, sets: list[np.ndarray], percent: int, forest: Forest) -> None:
    """Links pairs with 100 * intersection >= percent * union."""
    c = np.rint(overlaps(sets)).astype(np.int64)
    linked = 100 * c >= percent * (sizes[:, None] + sizes[None, :] - c)
    forest.link(np.argwhere(np.triu(linked, 1)))


def _stream_groups(keys: list[str], work):
    """Runs ``work(table)`` for each run of equal keys in a sorted stream of batches, holding one group at a time.

    ``work`` gives edges; those inside a tree that the task knows are left out.
    """

    def run(batches):
        held: list[pa.RecordBatch] = []
        last = None
        out: list[tuple] = []
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while up.get(x, x) != x:
                up[x] = up.get(up[x], up[x])
                x = up[x]
            return x

        def fresh(edges: list[tuple]) -> list[tuple]:
            kept = []
            if len(up) > FOREST_ROWS:  # edges may then be told again, which does no harm
                up.clear()
            for a, b in edges:
                x, y = root(a), root(b)
                if x != y:
                    up[max(x, y)] = min(x, y)
                    kept.append((a, b))
            return kept

        def flush():
            nonlocal out
            rows, out = out, []
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            change = np.zeros(batch.num_rows, dtype=bool)
            for c in cols:
                change[1:] |= c[1:] != c[:-1]
            bounds = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                key = tuple(c[a] for c in cols)
                if held and key != last:
                    out += fresh(work(pa.Table.from_batches(held)))
                    held = []
                last = key
                held.append(batch.slice(a, b - a))
            if len(out) > 5000:
                yield flush()
        if held:
            out += fresh(work(pa.Table.from_batches(held)))
        if out:
            yield flush()

    return run


def _edges(rows: DataFrame, sizes: DataFrame, bodies: DataFrame | None, pairs) -> DataFrame:
    """Edges (a, b) among the rows (k, rep, ...) of each key.

    ``sizes`` has (k, leader, rows, blocks): the smallest rep, the number of rows and of blocks. Each row is repeated once
    per block of its key. ``bodies`` is joined by rep after the rows are dealt out. ``pairs(table)`` compares all rows of a
    table. Tasks are dealt by the leader, since keys with one leader mostly hold one group, which is then told once; the
    keys of a leader with many rows are spread.
    """
    load = sizes.groupBy("leader").agg(F.ceil(F.sum(F.col("rows") * F.col("blocks")) / ROUTE_ROWS).alias("spread"))
    dealt = rows.join(sizes.join(load, "leader"), "k").withColumn("own", F.pmod(F.xxhash64("rep"), "blocks")).withColumn("slot", F.pmod(F.xxhash64("k"), "spread"))
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    dealt = dealt.withColumn("other", F.explode(others)).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    dealt = dealt.drop("own", "other", "rows", "blocks", "spread")
    dealt = dealt if bodies is None else dealt.join(bodies, "rep")
    keyed = dealt.repartition(shuffle_partitions(rows.sparkSession), "leader", "slot", "i", "j").sortWithinPartitions("k", "i", "j", "rep")
    return keyed.mapInArrow(_stream_groups(["k", "i", "j"], pairs), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, k: int = K, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, class_id, component_id, kept, text_md5.

    Null and empty texts, and texts of white space, have no shingles and link with nothing. Equal texts are one class.
    Rows with a null id are returned unlinked with a null component. Ids may repeat: each row is its own document, and is
    marked kept when its id is the smallest of its component (several rows of that id may be). An empty table gives an
    empty table. ``percent`` must be high enough for ``k`` (24 and more for 48), or a ValueError is raised.
    """
    threshold = percent / 100
    if not 0 < threshold <= 1 or least_shared(threshold, k) < 1:
        raise ValueError(f"sketches of {k} values can't find pairs of {percent} per cent")
    base = docs.select(F.col(cells(id_col)).cast("bigint").alias("doc_id"), F.col(cells(text_col)).cast("string").alias("text"))
    sketched = base.mapInArrow(_sketch(words, k), "doc_id bigint, n bigint, digest binary, sketch binary, text binary")
    sketched = cut(sketched.withColumn("row", F.monotonically_increasing_id()))  # a few hundred bytes a row; numbers are fixed from here
    real = sketched.where("n > 0 and doc_id is not null")
    member = salted_representatives(real.select("row", "doc_id", "n", "digest", F.struct("doc_id", "row").alias("lead")), "digest", "lead")
    member = cut(member.select("row", "doc_id", "n", "digest", F.col("rep.row").alias("rep"), F.col("rep.doc_id").alias("class_id")))
    classes = member.where("row = rep").select("rep", "doc_id", "n", "digest")
    reps = real.select(F.col("row").alias("rep"), "n", "sketch").join(classes.select("rep"), "rep")

    values = reps.mapInArrow(_values(threshold, k), "rep bigint, v bigint, held int, prefix int")
    often = values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    held = values.join(often, "v")
    # values of one class only come first in the order by rarity, and take up their part of the prefix
    ranked = held.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("vs"), F.first("held").alias("held"), F.first("prefix").alias("prefix"))
    ranked = ranked.withColumn("take", F.col("prefix") - (F.col("held") - F.size("vs"))).where("take > 0")
    lists = cut(ranked.select("rep", F.explode(F.slice("vs", 1, F.col("take"))["v"]).alias("k")))
    sizes = lists.groupBy("k").agg(F.count(F.lit(1)).alias("rows"), F.min("rep").alias("leader")).where("rows > 1").withColumn("blocks", F.ceil(F.col("rows") / block_rows))

    def candidates(table: pa.Table) -> list[tuple]:
        ids, n = table["rep"].to_pylist(), table["n"].to_numpy()
        forest = Forest(len(ids))
        if len(ids) > 1:
            estimated_links(n, table["sketch"].to_pylist(), k, threshold, forest)
        return [(ids[i], ids[j]) for i, j in forest.edges]

    edges = _edges(lists, sizes, reps, candidates).distinct()
    return confirmed_components(base, sketched, member, classes, edges, words, percent, block_rows, block_bytes)


def confirmed_components(base: DataFrame, sketched: DataFrame, member: DataFrame, classes: DataFrame, edges: DataFrame, words: int, percent: int, block_rows: int, block_bytes: int) -> DataFrame:
    """The rows of ``near_duplicates``, from candidate ``edges`` between classes: exact links in each candidate group."""
    groups = cut(connected_components(edges).join(classes, F.col("id") == F.col("rep")).select("rep", "doc_id", "n", "digest", F.col("component").alias("k")))

    def full_sets(batches):
        for batch in batches:
            got = shingle_sets(utf8(batch.column("text")), words)
            same = [i for i, (s, d) in enumerate(zip(got, batch.column("digest").to_pylist(), strict=True)) if digest_of(s) == d]
            kept = batch.select(["rep", "k", "n"]).take(pa.array(same, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([got[i].tobytes() for i in same], pa.binary())], ["rep", "k", "n", "shingles"])

    # a repeated id has several texts: the one of the class is told by its digest
    texts = base.join(groups, "doc_id").dropDuplicates(["doc_id", "rep", "text"])
    sets = texts.select("rep", "k", "n", "digest", "text").mapInArrow(full_sets, "rep bigint, k bigint, n bigint, shingles binary")
    sized = groups.groupBy("k").agg(F.count(F.lit(1)).alias("rows"), F.min("rep").alias("leader"), F.sum("n").alias("total"))
    sized = sized.select("k", "leader", "rows", F.ceil(F.greatest(F.col("rows") / block_rows, F.col("total") * 8 / block_bytes)).alias("blocks")).where("rows > 1")

    def confirmed(table: pa.Table) -> list[tuple]:
        ids, n = table["rep"].to_pylist(), table["n"].to_numpy()
        forest = Forest(len(ids))
        if len(ids) > 1:
            exact_links(n, [np.frombuffer(s, dtype=U64) for s in table["shingles"].to_pylist()], percent, forest)
        return [(ids[i], ids[j]) for i, j in forest.edges]

    links = _edges(sets, sized, None, confirmed)
    found = connected_components(links)  # (id, component) of representatives' rows
    named = found.join(classes.select("rep", "doc_id"), F.col("id") == F.col("rep"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = named.join(least, "component").select("rep", "component_id")
    known = member.join(linked, "rep", "left").select("row", "class_id", F.coalesce("component_id", "class_id").alias("component_id"))
    rows = sketched.select("row", "doc_id", "n", "text").join(known, "row", "left")
    component = F.coalesce("component_id", "doc_id")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), F.hex("text").alias("text_md5"))


def near_dedup(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of near duplicates, with all their columns (of any names).

    Rows that repeat the id and text of the one that stays, stay too.
    """
    plain, (own_id, text) = hidden(docs, id_col, text_col)
    gone = near_duplicates(plain, words, percent, id_col=own_id, text_col=text).where("not kept").select(F.col("doc_id").alias("_n_id"), F.lower("text_md5").alias("_n_md5")).distinct()
    same = (F.col(own_id).cast("bigint") == F.col("_n_id")) & (F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")) == F.col("_n_md5"))
    return restored(plain.join(gone, same, "left_anti"), docs)
