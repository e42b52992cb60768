"""Packing token sequences by Karmarkar-Karp multiway differencing.

Documents are tokenised, ended with id 0 and cut at multiples of the capacity; a full cut is a sequence by itself.
The rests, in groups of bounded size, go to windows by multiway differencing: partial partitions are held as sorted
tuples of window sums, the two tuples with the largest spread are merged largest against smallest, until one is left.
The number of windows starts at ceil(tokens / capacity) and rises by one whenever a window would exceed the capacity.
"""

from __future__ import annotations

import heapq
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cells, shuffle_partitions

CAPACITY = 1024
GROUP = 192
#: Most pieces that a Python worker keeps between batches (about 200 bytes each); more cost memory and save encoding.
CACHE_PIECES = 250_000
#: Pieces of more bytes than this are encoded anew in each batch.
LONGEST_KEPT = 64
BATCH_BYTES = 3 << 20
PIECES = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary, sequence_id bigint, offset bigint"

#: White space in UTF-8, single bytes and longer ones.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_WIDE = re.compile(b"\xc2\x85|\xc2\xa0|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_ALNUM = np.array([chr(x).isalnum() and x < 128 for x in range(256)])
_STOP = np.array([chr(x) in ".,;:!?" for x in range(256)])


def safe_cuts(data: np.ndarray) -> np.ndarray:
    """Marks where a byte-level token surely begins: at a space or line break between two visible characters, and at a
    full stop, comma or the like after an ASCII letter or digit."""
    space = _SPACE[data]
    for m in _WIDE.finditer(data):
        space[m.start() : m.end()] = True
    cut = np.zeros(len(data), dtype=bool)
    cut[1:-1] = ((data[1:-1] == 32) | (data[1:-1] == 10)) & ~space[:-2] & ~space[2:]
    cut[1:] |= _STOP[data[1:]] & _ALNUM[data[:-1]]
    return cut


class Encoder:
    """Ids of texts by ``tokenizers``; each distinct piece of a text is encoded once while it is kept.

    Texts are cut where the byte-level pattern surely begins a token (``safe_cuts``), so a text has the ids of its
    pieces, one after another. Arrow finds a batch's distinct pieces. New ones that begin with a single space or line
    break are encoded many at a time, joined again, and told apart by the bytes that each id stands for. A text that
    holds one of the tokenizer's added tokens is one piece.
    """

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES) -> None:
        self.cache_pieces = cache_pieces
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        vocabulary = self.model.get_vocab()
        self.size = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.size[i] = len(token)  # byte-level: a character stands for a byte
        added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.added = re.compile(b"|".join(re.escape(t.encode()) for t in added)) if added else None
        self.joins = not any(c.isspace() for t in added for c in t)
        self.known: dict[bytes, int] = {}
        self.first = np.zeros(1, dtype=np.int64)  # where a piece's ids begin
        self.ids = np.zeros(0, dtype="<u4")

    def joinable(self, piece: str) -> bool:
        return self.joins and piece[0] in " \n" and len(piece) > 1 and not piece[1].isspace() and not piece[-1].isspace()

    def learn(self, new: list[bytes], step: int = 2000) -> None:
        """Encodes new pieces; long ones come last, so that they can be let go."""
        new.sort(key=lambda p: len(p) > LONGEST_KEPT)
        texts = [p.decode() for p in new]
        joined = [i for i, x in enumerate(texts) if len(new[i]) <= LONGEST_KEPT and self.joinable(x)]
        found: list[np.ndarray] = [self.ids[:0]] * len(new)
        groups = [joined[i : i + step] for i in range(0, len(joined), step)]
        for group, e in zip(groups, self.model.encode_batch_fast(["".join([texts[i] for i in group]) for group in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype="<u4")
            ends, upto = np.cumsum(self.size[ids]), np.cumsum([len(new[i]) for i in group])
            cuts = np.searchsorted(ends, upto, side="left") + 1
            if cuts[-1] != len(ids) or (ends[cuts - 1] != upto).any():
                raise ValueError("the tokenizer isn't byte-level")
            for i, own in zip(group, np.split(ids, cuts[:-1]), strict=True):
                found[i] = own
        apart = set(joined)
        alone = [i for i in range(len(new)) if i not in apart]
        for i, e in zip(alone, self.model.encode_batch_fast([texts[i] for i in alone], add_special_tokens=False), strict=True):
            found[i] = np.array(e.ids, dtype="<u4")
        n = len(self.known)
        self.known.update(zip(new, range(n, n + len(new)), strict=True))
        self.first = np.concatenate((self.first, self.first[-1] + np.cumsum([len(x) for x in found])))
        self.ids = np.concatenate((self.ids, *found))

    def forget(self, pieces: int) -> None:
        """Lets the newest pieces go until ``pieces`` are left: frequent ones come early."""
        while len(self.known) > pieces:
            self.known.popitem()
        self.first = self.first[: len(self.known) + 1].copy()
        self.ids = self.ids[: self.first[-1]].copy()

    def encode(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts (UTF-8 ``data``, cut at ``offsets``), each text ended by id 0, and each text's bounds in them."""
        if not len(data):
            return np.zeros(len(offsets) - 1, dtype="<u4"), np.arange(len(offsets))
        cut = safe_cuts(data)
        for m in self.added.finditer(data) if self.added else ():
            i = int(np.searchsorted(offsets, m.start(), side="right")) - 1
            cut[offsets[i] : offsets[i + 1]] = False
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        begins = np.flatnonzero(cut)
        bounds = np.append(begins, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        words = pieces.dictionary.to_pylist()
        new = [w for w in words if w not in self.known]
        if new:
            self.learn(new)
        at = np.array([self.known[w] for w in words])[pieces.indices.to_numpy()]
        low = self.first[at]
        count = self.first[at + 1] - low
        ends = np.cumsum(count)
        ids = self.ids[np.repeat(low - ends + count, count) + np.arange(ends[-1])]
        of_text = np.append(0, ends)[np.searchsorted(begins, offsets)]
        if new:
            kept = len(self.known) - sum(len(w) > LONGEST_KEPT for w in new)
            self.forget(kept if kept <= self.cache_pieces else self.cache_pieces * 7 // 8)
        return np.insert(ids, of_text[1:], 0), of_text + np.arange(len(of_text))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, cache_pieces: int = CACHE_PIECES) -> Encoder:
    """The worker process's encoder; its cache outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    _ENCODERS[path].cache_pieces = cache_pieces
    return _ENCODERS[path]


def differencing(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows (lists of indexes) of near-equal sums, none over the capacity; every length is at most the capacity."""
    if not lengths:
        return []
    k = max(1, -(-sum(lengths) // capacity))
    while k < len(lengths):
        heap = []
        for i, x in enumerate(lengths):
            sums = np.zeros(k, dtype=np.int64)
            sums[0] = x
            heap.append((-x, i, sums))
        heapq.heapify(heap)
        merges: list[tuple[int, int, np.ndarray]] = []  # the two nodes of each merge, and where the sorted sums were
        while len(heap) > 1:
            _, a, s1 = heapq.heappop(heap)
            _, b, s2 = heapq.heappop(heap)
            sums = s1 + s2[::-1]
            order = sums.argsort()[::-1]
            sums = sums[order]
            heapq.heappush(heap, (int(sums[-1] - sums[0]), len(lengths) + len(merges), sums))
            merges.append((a, b, order))
        if heap[0][2][0] <= capacity:
            labels: dict[int, np.ndarray] = {heap[0][1]: np.arange(k)}
            for i in range(len(merges) - 1, -1, -1):
                a, b, order = merges[i]
                own = np.empty(k, dtype=np.int64)
                own[order] = labels.pop(len(lengths) + i)
                labels[a], labels[b] = own, own[::-1]
            windows: list[list[int]] = [[] for _ in range(k)]
            for i in range(len(lengths)):
                windows[labels[i][0]].append(i)
            return [w for w in windows if w]
        k += 1
    return [[i] for i in range(len(lengths))]


def _cut(path: str, capacity: int, cache_pieces: int):
    def run(batches):
        own = encoder(path, cache_pieces)
        for batch in batches:
            texts = batch.column(1).fill_null("").cast(pa.large_binary())
            _, where, what = texts.buffers()
            offsets = np.frombuffer(where, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(what or b"", dtype=np.uint8)
            at = 0
            while at < len(texts):
                upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BATCH_BYTES, side="right")) - 1)
                ids, bounds = own.encode(offsets[at : upto + 1] - offsets[at], data[offsets[at] : offsets[upto]])
                tokens = np.diff(bounds)
                parts = -(-tokens // capacity)
                doc = np.repeat(np.arange(upto - at), parts)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)) * capacity
                length = np.minimum(capacity, tokens[doc] - start)
                cuts = np.append(0, np.cumsum(length) * 4).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(cuts), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, upto - at).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(tokens[doc]), packed], ["doc_id", "start", "length", "doc_tokens", "ids"])
                at = upto

    return run


def _place(capacity: int, group_rows: int):
    """Packs the rests of a sorted stream of pieces, ``group_rows`` at a time; sequence ids are unique by partition."""

    def run(batches):
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 36
        held: list[pa.RecordBatch] = []
        rows = 0

        def pack(table: pa.Table):
            nonlocal sequence
            lengths = table["length"].to_pylist()
            for at in range(0, len(lengths), group_rows):
                some = lengths[at : at + group_rows]
                ids, offsets = [0] * len(some), [0] * len(some)
                rests = [i for i, x in enumerate(some) if x < capacity]
                windows = differencing([some[i] for i in rests], capacity)
                for window in [[i] for i, x in enumerate(some) if x == capacity] + [[rests[j] for j in w] for w in windows]:
                    offset = 0
                    for i in window:
                        ids[i], offsets[i] = sequence, offset
                        offset += some[i]
                    sequence += 1
                out = table.slice(at, group_rows).append_column("sequence_id", pa.array(ids, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))
                yield from out.to_batches()

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 16 * group_rows:
                table = pa.Table.from_batches(held)
                whole = rows // group_rows * group_rows
                yield from pack(table.slice(0, whole))
                rest = table.slice(whole)
                held, rows = rest.to_batches(), rest.num_rows
        if rows:
            yield from pack(pa.Table.from_batches(held))

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, group_rows: int = GROUP, cache_pieces: int = CACHE_PIECES) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids (little-endian unsigned 32-bit), sequence_id, offset.

    Null and empty texts are the end id alone. Ids may be null or repeat; each row is packed as a document. Long texts
    are cut at multiples of the capacity. An empty table gives no pieces. Other columns may have any names; they are not
    read. The tokenizer's added tokens in a text are encoded as ``tokenizers`` does by default. The packing depends on the
    rows and the number of shuffle partitions, not on how the input is dealt or on which tasks are repeated.
    """
    base = docs.select(F.col(cells(id_col)).cast("bigint").alias("doc_id"), F.col(cells(text_col)).cast("string").alias("text"))
    cut = base.mapInArrow(_cut(tokenizer, capacity, cache_pieces), "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary")
    # a fixed number of partitions and an order inside each: a repeated task places its pieces as the first attempt did
    dealt = cut.repartition(shuffle_partitions(docs.sparkSession), F.xxhash64("doc_id", "start")).sortWithinPartitions("doc_id", "start", "ids")
    return dealt.mapInArrow(_place(capacity, group_rows), PIECES)
