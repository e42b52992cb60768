"""Substring deduplication by level-wise doubling.

A window of ``window`` words can only be repeated if the shorter windows inside it are. Level 1 takes windows of
``start`` words: of each full window one short window is picked by content alone (its smallest hash), so equal full
windows pick equal ones. Windows that are repeated at one length, and these alone, are extended to twice that length on
either side; the full windows around the survivors are compared last, by 96-bit hashes (and the bucket's number), and
the first of each, by document id and position, is left. Levels end early where no candidate survives.

Each level is one exchange of packed hashes between document blocks and hash buckets (``_blocks``).
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._blocks import KEYS, MESSAGE, STATE, document_blocks, messages, met, ordered
from ._common import U64, by_bucket, join_hash, mix, word_hashes

FULL = np.dtype([("h", "<u8"), ("g", "<u4"), ("d", "<i8")])
LAST = 2


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """The hash of each run of ``length`` words, by halves."""
    if length <= 1 or len(words) < length:
        return words if length <= 1 else words[:0]
    if length % 2:
        return join_hash(run_hashes(words, length - 1)[: len(words) - length + 1], words[length - 1 :])
    half = run_hashes(words, length // 2)
    return join_hash(half[: len(half) - length // 2], half[length // 2 :])


class Block:
    """Words of a block's documents in order, and what a level needs of them."""

    def __init__(self, table: pa.Table, window: int, start: int) -> None:
        self.window, self.start = window, start
        self.ids, self.texts = ordered(table)
        self.words, self.counts = word_hashes(self.texts)
        self.ends = np.cumsum(self.counts)
        self.end_of = np.repeat(self.ends, self.counts)
        self.first_of = np.repeat(self.ends - self.counts, self.counts)
        position = np.arange(len(self.words))
        self.full = position[position + window <= self.end_of]  # starts of full windows

    def anchors(self) -> np.ndarray:
        """For each full window the position of the short window it picks: the leftmost of the smallest hash."""
        h = run_hashes(self.words, self.start)
        if not len(self.full):
            return self.full
        best, at, span = h, np.arange(len(h)), self.window - self.start + 1
        reach = 1
        while reach < span:
            step = min(reach, span - reach)
            left = best[: len(best) - step] <= best[step:]
            at = np.where(left, at[: len(at) - step], at[step:])
            best = np.where(left, best[: len(best) - step], best[step:])
            reach += step
        return at[self.full]

    def inside(self, at: np.ndarray, length: int) -> np.ndarray:
        """Those positions from which ``length`` words lie in one document."""
        at = at[(at >= 0) & (at < len(self.words))]
        return at[at + length <= self.end_of[at]]


def _send(block: int, keys: np.ndarray, n: int, kind: int = KEYS) -> list[tuple]:
    """Distinct keys, dealt to buckets."""
    order, bounds = by_bucket((keys >> U64(40)) % U64(n), n)
    keys = keys[order]
    return [(b, block, kind, keys[bounds[b] : bounds[b + 1]].tobytes()) for b in range(n) if bounds[b + 1] > bounds[b]]


def _answers(table: pa.Table, keys: np.ndarray, n: int, kind: int = KEYS) -> np.ndarray:
    """The flags for distinct keys that ``_send`` dealt out, in the keys' order."""
    order, bounds = by_bucket((keys >> U64(40)) % U64(n), n)
    flags = np.zeros(len(keys), dtype=bool)
    for r in table.to_pylist():
        if r["kind"] == kind:
            a, b = bounds[r["bucket"]], bounds[r["bucket"] + 1]
            flags[order[a:b]] = np.frombuffer(r["body"], dtype=np.uint8).astype(bool)
    return flags


def _seen_elsewhere(kind: int, sent: list[np.ndarray]) -> list[np.ndarray]:
    """Of each block's distinct keys, those that another block sent too; full windows: those with an earlier document."""
    every = np.concatenate(sent)
    if kind == LAST:
        order = np.lexsort((every["d"], every["g"], every["h"]))
        h, g = every["h"][order], every["g"][order]
        later = np.zeros(len(every), dtype=np.uint8)
        later[order[1:]] = (h[1:] == h[:-1]) & (g[1:] == g[:-1])
    else:
        _, inverse, times = np.unique(every, return_inverse=True, return_counts=True)
        later = (times > 1)[inverse.reshape(-1)].astype(np.uint8)
    return np.split(later, np.cumsum([len(x) for x in sent])[:-1])


def _decoded(kind: int, body: bytes) -> np.ndarray:
    return np.frombuffer(body, dtype=FULL if kind == LAST else np.dtype("<u8"))


def _survivors(b: Block, at: np.ndarray, length: int, answers: pa.Table, n: int) -> np.ndarray:
    """Of candidate positions ``at``, those whose window of ``length`` words is repeated, here or in another block."""
    keys, inverse, times = np.unique(run_hashes(b.words, length)[at], return_inverse=True, return_counts=True)
    return at[((times > 1) | _answers(answers, keys, n))[inverse.reshape(-1)]]


def _state(table: pa.Table) -> np.ndarray:
    got = [r["body"] for r in table.to_pylist() if r["kind"] == STATE]
    return np.frombuffer(got[0], dtype=np.int64) if got else np.zeros(0, dtype=np.int64)


def _extended(b: Block, survivors: np.ndarray, length: int) -> np.ndarray:
    """Positions of windows of twice ``length`` words that extend a survivor to the right or to the left."""
    left = survivors[survivors - length >= b.first_of[survivors]] - length if len(survivors) else survivors
    return np.unique(np.concatenate((b.inside(survivors, 2 * length), b.inside(left, 2 * length))))


def _full_windows(b: Block, survivors: np.ndarray, level: int) -> np.ndarray:
    """Starts of full windows all of whose extended windows of this level survive."""
    at, length = b.anchors(), b.start << level
    alive = np.zeros(len(b.words) + 1, dtype=bool)
    alive[survivors] = True
    fits = np.ones(len(at), dtype=bool)
    for m in range(1 << level):
        q = at - m * b.start
        contained = (q >= b.full) & (q + length <= b.full + b.window)
        fits &= ~contained | alive[np.where(contained, q, 0)]
    return b.full[fits]


def _full_keys(b: Block, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First positions (in ``at``) of distinct full windows, the window number of each position, and records to send."""
    h = run_hashes(b.words, b.window)[at]
    g = (run_hashes(mix(b.words ^ U64(0x5851F42D4C957F2D)), b.window)[at] >> U64(32)).astype(np.uint32)
    keys, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    inverse = inverse.reshape(-1)
    odd = g != g[first][inverse]  # two windows with one 64-bit hash
    if odd.any():
        pair = np.stack((h, g.astype(U64)), axis=1)
        _, first, inverse = np.unique(pair, axis=0, return_index=True, return_inverse=True)
        inverse = inverse.reshape(-1)
    ids = np.array([-(1 << 63) if x is None else x for x in b.ids], dtype=np.int64)
    records = np.zeros(len(first), dtype=FULL)
    records["h"], records["g"] = h[first], g[first]
    records["d"] = ids[np.searchsorted(b.ends, at[first], side="right")]
    return first, inverse, records


def substring_dedup(docs: DataFrame, window: int = 20, start: int = 5, id_col: str = "doc_id", text_col: str = "text", block_bytes: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept (the words left, joined by one space).

    ``window`` must be ``start`` doubled some times. Null, empty and short texts lose nothing. Ids may be null (first
    in order) or repeat (ordered by text within an id). An empty table gives an empty table.
    """
    levels = 0
    while start << levels < window:
        levels += 1
    if start << levels != window or levels < 1:
        raise ValueError("window must be start doubled one or more times")
    blocks, n = document_blocks(docs, id_col, text_col, block_bytes)

    def first(table: pa.Table) -> pa.Table:
        b, block = Block(table, window, start), table["block"][0].as_py()
        keys = np.unique(run_hashes(b.words, start)[np.unique(b.anchors())])
        return messages(_send(block, keys, n))

    def extend(level: int):
        def run(table: pa.Table, answers: pa.Table) -> pa.Table:
            if not answers.num_rows or not table.num_rows:
                return messages([])
            b, block, length = Block(table, window, start), table["block"][0].as_py(), start << (level - 1)
            before = np.unique(b.anchors()) if level == 1 else _extended(b, _state(answers), length >> 1)
            alive = _survivors(b, before, length, answers, n)
            out = []
            if level < levels:
                at = _extended(b, alive, length)
                out = _send(block, np.unique(run_hashes(b.words, 2 * length)[at]), n)
            else:
                _, _, records = _full_keys(b, _full_windows(b, alive, level - 1))
                order, bounds = by_bucket((records["h"] >> U64(40)) % U64(n), n)
                records = records[order]
                out = [(i, block, LAST, records[bounds[i] : bounds[i + 1]].tobytes()) for i in range(n) if bounds[i + 1] > bounds[i]]
            return messages([*out, (block % n, block, STATE, alive.tobytes())] if out else [])

        return run

    def last(table: pa.Table, answers: pa.Table) -> pa.Table:
        b = Block(table, window, start)
        covered = np.zeros(len(b.words) + 1, dtype=np.int64)
        if answers.num_rows:
            at = _full_windows(b, _state(answers), levels - 1)
            lead, inverse, records = _full_keys(b, at)
            earlier = _answers(answers, records["h"], n, LAST)
            own_first = np.zeros(len(at), dtype=bool)
            own_first[lead] = True
            gone = at[~own_first | earlier[inverse]]
            np.add.at(covered, gone, 1)
            np.add.at(covered, gone + window, -1)
        covered = np.cumsum(covered)[:-1] > 0
        removed, kept, a = [], [], 0
        for text, k in zip(b.texts, b.counts.tolist(), strict=True):
            own = covered[a : a + k]
            a += k
            words = text.split()
            removed.append(int(own.sum()))
            kept.append(b" ".join(compress(words, (~own).tolist()) if removed[-1] else words))
        return pa.table({"doc_id": pa.array(b.ids, pa.int64()), "n_words": pa.array(b.counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    keyed = blocks.groupBy("block")
    answers = met(keyed.applyInArrow(first, MESSAGE), n, _seen_elsewhere, _decoded)
    for level in range(1, levels + 1):
        sent = keyed.cogroup(answers.groupBy("block")).applyInArrow(extend(level), MESSAGE)
        answers = met(sent, n, _seen_elsewhere, _decoded)
    return keyed.cogroup(answers.groupBy("block")).applyInArrow(last, "doc_id bigint, n_words bigint, n_removed bigint, kept string")
