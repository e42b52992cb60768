"""A Jaccard join of word n-gram sets through parity sketches.

1. Each text becomes its set of word shingles (64-bit hashes); equal sets fold into one class. A token flips (XOR) one bit
   of a sketch, so the Hamming distance of two sketches is at most the size of the sets' symmetric difference, and a pair
   at the threshold differs in at most ``differing`` of them.
2. Sizes are parted into bands. A band's sketches have one layout of ``parts`` words of 64 bits, a third more than a pair
   of the band may have different. A set is sketched in its own band, and in those that hold the largest sets it can link
   with, so a linked pair meets in the larger one's band.
3. Pigeonhole: of two linked sets' words at least parts - d are equal. In an order by bits set (most first: empty words
   say little) the first d + 1 words of each must share one. These are the keys of the join; one shuffle brings equal keys
   together, and keys of one set go.
4. Pairs of a list whose folded sketches (32 to 64 d bits, halves XORed until both are as wide) are too far apart drop
   out. What is left is kept as a spanning forest of candidate groups, never as all pairs.
5. Inside a group, exact intersections of the full sets confirm links; connected components of the links.

Nothing is missed, whatever the threshold: every step is a bound, and only hashes of shingles (64 bits) stand for words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import U64, cells, cut, mix, salted_representatives, shuffle_partitions, utf8
from .minhash_dedup import BLOCK_BYTES, BLOCK_ROWS, Forest, _edges, confirmed_components, digest_of, shingle_sets

#: A band's largest size over its smallest, and the parts of a layout over what a pair may have different.
RATIO, SPARE = 1.4, 4 / 3


def _bounds(most: int = 1 << 40) -> list[int]:
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, int(out[-1] * RATIO)))
    return out


BOUNDS = np.array(_bounds())


def band(n: int) -> int:
    return int(np.searchsorted(BOUNDS, n, side="right")) - 1


def differing(both: int, percent: int) -> int:
    """How many tokens two sets of ``both`` tokens together may have different at the threshold."""
    return both * (100 - percent) // (100 + percent)


def parts_of(g: int, percent: int) -> int:
    """Words of band ``g``'s layout; 0 where only equal sets link."""
    d = differing(2 * (int(BOUNDS[g + 1]) - 1), percent)
    return int(np.ceil((d + 1) * SPARE)) if d else 0


def parity(positions: np.ndarray, bits: int) -> np.ndarray:
    """A sketch in words of 64 bits: each position flips its bit."""
    odd = (np.bincount(positions, minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<u8")


def join_keys(tokens: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a set, at least one of which it shares with any set that it links with (but for an equal one)."""
    n, out = len(tokens), []
    most = 100 * n // percent
    for g in range(band(n), band(most) + 1) if n else ():
        parts = parts_of(g, percent)
        d = differing(n + min(most, int(BOUNDS[g + 1]) - 1), percent)
        if not parts or not d:
            continue
        place = (tokens >> U64(32)) % U64(parts)
        words = parity((place * U64(64) + (tokens & U64(63))).astype(np.int64), 64 * parts)
        first = np.argsort(-np.bitwise_count(words).astype(np.int64), kind="stable")[: d + 1]
        out.append(mix(words[first] ^ mix(first.astype(U64) + U64(g << 40) + U64(1))))
    return np.concatenate(out) if out else np.zeros(0, dtype=U64)


def fold_bits(n: int, percent: int) -> int:
    """A power of two, at least 64 and four times the tokens that may be different."""
    return max(64, 1 << (4 * (differing(n + 100 * n // percent, percent) + 1) - 1).bit_length())


def folded_sketch(tokens: np.ndarray, percent: int) -> np.ndarray:
    bits = fold_bits(len(tokens), percent)
    return parity(((tokens >> U64(6)) & U64(bits - 1)).astype(np.int64), bits)


def narrow(sketch: np.ndarray, words: int) -> np.ndarray:
    """The sketch of fewer bits: the upper half is XORed onto the lower one until it fits."""
    while len(sketch) > words:
        half = len(sketch) // 2
        sketch = sketch[:half] ^ sketch[half:]
    return sketch


def close_pairs(sizes: np.ndarray, sketches: list[bytes], percent: int, forest: Forest) -> None:
    """Links pairs whose sketches' distance doesn't rule the threshold out."""
    own = [np.frombuffer(s, dtype="<u8") for s in sketches]
    words = min(map(len, own))
    all_of = np.stack([narrow(s, words) for s in own])
    for i in range(len(own) - 1):
        distance = np.bitwise_count(all_of[i + 1 :] ^ all_of[i]).sum(axis=1, dtype=np.int64)
        small, large = np.minimum(sizes[i + 1 :], sizes[i]), np.maximum(sizes[i + 1 :], sizes[i])
        near = (distance * (100 + percent) <= (small + large) * (100 - percent)) & (100 * small >= percent * large)
        js = np.flatnonzero(near) + i + 1
        if len(js):
            forest.link(np.stack((np.full(len(js), i), js), axis=1))


def _sketch(words: int, percent: int, step: int = 4 << 20):
    def run(batches):
        for batch in batches:
            texts, at = utf8(batch.column(1)), 0
            while at < len(texts):
                upto, size = at, 0
                while upto < len(texts) and size < step:
                    size += len(texts[upto])
                    upto += 1
                sets = shingle_sets(texts[at:upto], words)
                bodies = [[digest_of(s) for s in sets], [join_keys(s, percent).tobytes() for s in sets], [folded_sketch(s, percent).tobytes() for s in sets], [hashlib.md5(x).digest() for x in texts[at:upto]]]
                columns = [pa.array([len(s) for s in sets], pa.int64()), *(pa.array(b, pa.binary()) for b in bodies)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, upto - at), *columns], ["doc_id", "n", "digest", "keys", "sketch", "text"])
                at = upto

    return run


def _spread(batches):
    """(k, rep) for each key."""
    for batch in batches:
        rep, keys = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(keys), dtype="<i8")), pa.array(np.repeat(rep, [len(k) // 8 for k in keys]))], ["k", "rep"])


def _shared(batches):
    """The rows of a sorted stream whose key stands in another row too."""
    last = held = None  # the last row's key, and its set where it was alone so far
    for batch in batches:
        k, rep = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(k):
            continue
        same = np.append(k[0] == last if last is not None else False, k[1:] == k[:-1])
        keep = same.copy()
        keep[:-1] |= same[1:]
        if held is not None and same[0]:
            yield pa.RecordBatch.from_arrays([pa.array(k[:1]), pa.array([held])], ["k", "rep"])
        last, held = k[-1], None if keep[-1] else rep[-1]
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(k[keep]), pa.array(rep[keep])], ["k", "rep"])


def ngram_join(docs: DataFrame, words: int = 4, percent: int = 85, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, class_id, component_id, kept, text_md5.

    Two texts link when ``100 * intersection >= percent * union`` of their shingle sets. Null and empty texts, and texts of
    white space, have no shingles and link with nothing. Rows with a null id are returned unlinked with a null component.
    Ids may repeat: each row is its own document. Texts of any length are read whole; a task holds the numbers of one
    text's words. An empty table gives an empty table. Other columns aren't read.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be over 0 and at most 100")
    base = docs.select(F.col(cells(id_col)).cast("bigint").alias("doc_id"), F.col(cells(text_col)).cast("string").alias("text"))
    sketched = base.mapInArrow(_sketch(words, percent), "doc_id bigint, n bigint, digest binary, keys binary, sketch binary, text binary")
    sketched = cut(sketched.withColumn("row", F.monotonically_increasing_id()))  # numbers are fixed from here
    real = sketched.where("n > 0 and doc_id is not null")
    member = salted_representatives(real.select("row", "doc_id", "n", "digest", F.struct("doc_id", "row").alias("lead")), "digest", "lead")
    member = cut(member.select("row", "doc_id", "n", "digest", F.col("rep.row").alias("rep"), F.col("rep.doc_id").alias("class_id")))
    classes = member.where("row = rep").select("rep", "doc_id", "n", "digest")
    reps = real.select(F.col("row").alias("rep"), "n", "keys", "sketch").join(classes.select("rep"), "rep")

    spread = reps.select("rep", "keys").mapInArrow(_spread, "k bigint, rep bigint")
    lists = cut(spread.repartition(shuffle_partitions(docs.sparkSession), "k").sortWithinPartitions("k").mapInArrow(_shared, "k bigint, rep bigint"))
    sizes = lists.groupBy("k").agg(F.count(F.lit(1)).alias("rows"), F.min("rep").alias("leader")).withColumn("blocks", F.ceil(F.col("rows") / block_rows))

    def candidates(table: pa.Table) -> list[tuple]:
        ids, n = table["rep"].to_pylist(), table["n"].to_numpy()
        forest = Forest(len(ids))
        if len(ids) > 1:
            close_pairs(n, table["sketch"].to_pylist(), percent, forest)
        return [(ids[i], ids[j]) for i, j in forest.edges]

    edges = _edges(lists, sizes, reps.select("rep", "n", "sketch"), candidates).distinct()
    return confirmed_components(base, sketched, member, classes, edges, words, percent, block_rows, block_bytes)
