"""Language-model scores by deleted interpolation.

Word counts and word-pair counts of all training documents are met in hash buckets (``_blocks``), so what a task holds
is bounded. Maximum-likelihood estimates of pair, word and uniform distribution are mixed with weights that depend on
how often the context was seen (buckets by powers of two). The weights are learned by expectation-maximisation on
held-out counts: every training token is held out in turn, its own occurrence deleted from the counts it is scored with
(deleted estimation), over a histogram of bounded size. Everything runs in one plan over one shuffle of the texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._blocks import MESSAGE, document_blocks, messages, met, packed_counts, unpacked_counts
from ._common import U64, by_bucket, join_hash, mix, word_hashes
from .toxicity import is_held_out

WORDS, PAIRS, WEIGHTS = 2, 3, 4
END, START = mix(np.array([11, 12], dtype=U64))
CONTEXTS, PAIR_BINS, WORD_BINS = 24, 48, 64


def context_bucket(count: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + the whole part of the logarithm to base 2."""
    return np.where(count > 0, 1 + np.log2(np.maximum(count, 1)).astype(np.int64), 0).clip(0, CONTEXTS - 1)


class Block:
    """Tokens of a block's documents: words in lower case, then one end each."""

    def __init__(self, table: pa.Table) -> None:
        self.ids = table["doc_id"].to_pylist()
        train = np.asarray(table["train"].to_pylist(), dtype=bool)
        words, counts = word_hashes(table["text"].cast(pa.large_binary()).to_pylist(), lower=True)
        self.counts = counts + 1
        self.ends = np.cumsum(self.counts)
        self.tokens = np.full(self.ends[-1], END, dtype=U64)
        self.tokens[np.arange(len(words)) + np.repeat(np.arange(len(counts)), counts)] = words
        self.context = np.concatenate(([START], self.tokens[:-1]))
        self.context[self.ends[:-1]] = START
        self.train = np.repeat(train, self.counts)
        self.doc_train = train
        self.words, self.at_word = np.unique(np.concatenate((self.tokens, [START])), return_inverse=True)
        self.at_word = self.at_word.reshape(-1)
        self.at_context = np.concatenate(([self.at_word[-1]], self.at_word[:-2]))
        self.at_context[self.ends[:-1]] = self.at_word[-1]
        self.pairs, self.at_pair = np.unique(join_hash(self.context, self.tokens), return_inverse=True)
        self.at_pair = self.at_pair.reshape(-1)

    def word_counts(self) -> np.ndarray:
        """Training counts of ``words``; the start's is the number of training documents."""
        c = np.bincount(self.at_word[:-1][self.train], minlength=len(self.words))
        c[self.at_word[-1]] = self.doc_train.sum()
        return c

    def pair_counts(self) -> np.ndarray:
        return np.bincount(self.at_pair[self.train], minlength=len(self.pairs))


def _send(b: Block, block: int, n: int) -> list[tuple]:
    """Every bucket gets both kinds, so that its totals come back to every block."""
    out = []
    for kind, keys, counts in ((WORDS, b.words, b.word_counts()), (PAIRS, b.pairs, b.pair_counts())):
        order, bounds = by_bucket((keys >> U64(44)) % U64(n), n)
        keys, counts = keys[order], counts[order]
        for i in range(n):
            own = slice(bounds[i], bounds[i + 1])
            k = keys[own]
            # pairs: 48 bits, which with the bucket's number tell them apart; column by column, which compresses
            packed = k.tobytes() if kind == WORDS else (k & U64(0xFFFFFFFF)).astype("<u4").tobytes() + ((k >> U64(32)) & U64(0xFFFF)).astype("<u2").tobytes()
            out.append((i, block, kind, np.array([len(k)], dtype="<u8").tobytes() + packed + packed_counts(counts[own])))
    return out


def _decoded(kind: int, body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts that a block sent."""
    n = int(np.frombuffer(body[:8], dtype="<u8")[0])
    if kind == WORDS:
        return np.frombuffer(body[8 : 8 + 8 * n], dtype="<u8"), unpacked_counts(body[8 + 8 * n :], n)
    low, high = np.frombuffer(body[8 : 8 + 4 * n], dtype="<u4"), np.frombuffer(body[8 + 4 * n : 8 + 6 * n], dtype="<u2")
    return low.astype(U64) | (high.astype(U64) << U64(32)), unpacked_counts(body[8 + 6 * n :], n)


def _sum(kind: int, sent: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Total counts of each block's keys; for words, first the bucket's tokens and distinct words in training."""
    keys, inverse = np.unique(np.concatenate([k for k, _ in sent]), return_inverse=True)
    inverse = inverse.reshape(-1)
    total = np.zeros(len(keys), dtype=np.int64)
    np.add.at(total, inverse, np.concatenate([c for _, c in sent]))
    cut = np.split(total[inverse], np.cumsum([len(k) for k, _ in sent])[:-1])
    head = b""
    if kind == WORDS:
        real = keys != START
        head = np.array([total[real].sum(), np.count_nonzero(total[real])], dtype="<i8").tobytes()
    return [np.frombuffer(head + packed_counts(x), dtype=np.uint8) for x in cut]


def _totals(b: Block, table: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Training counts of the block's words and pairs over all documents, tokens N and distinct words V."""
    found, tokens, distinct = {}, 0, 0
    rows = table.to_pylist()
    for kind, keys in ((WORDS, b.words), (PAIRS, b.pairs)):
        order, bounds = by_bucket((keys >> U64(44)) % U64(n), n)
        out = np.zeros(len(keys), dtype=np.int64)
        for r in rows:
            if r["kind"] == kind:
                body, own = r["body"], order[bounds[r["bucket"]] : bounds[r["bucket"] + 1]]
                if kind == WORDS:
                    head = np.frombuffer(body[:16], dtype="<i8")
                    tokens, distinct, body = tokens + int(head[0]), distinct + int(head[1]), body[16:]
                out[own] = unpacked_counts(body, len(own))
        found[kind] = out
    return found[WORDS], found[PAIRS], tokens, distinct


def _half_octaves(x: np.ndarray, bins: int) -> np.ndarray:
    """0 for 0, else 1 + twice the logarithm to base 2, rounded."""
    return np.where(x > 0, 1 + np.rint(2 * np.log2(np.maximum(x, 1e-30))), 0).astype(np.int64).clip(0, bins - 1)


def learn_weights(index: np.ndarray, count: np.ndarray, tokens: int, distinct: int, rounds: int = 60) -> np.ndarray:
    """Weights (context bucket x [pair, word, uniform]) by expectation-maximisation on the histogram of held-out tokens."""
    context, rest = np.divmod(index, PAIR_BINS * WORD_BINS)
    pair, word = np.divmod(rest, WORD_BINS)
    p2 = np.where(pair > 0, 2.0 ** (-(pair - 1) / 2), 0)
    p1 = np.where(word > 0, 2.0 ** ((word - 1) / 2), 0) / max(1, tokens - 1)
    p = np.stack((p2, np.minimum(p1, 1), np.full(len(p1), 1 / (distinct + 1))), axis=1)
    weights = np.full((CONTEXTS, 3), 1 / 3)
    weights[0] = (0, 0.5, 0.5)
    for _ in range(rounds):
        share = weights[context] * p
        share *= (count / np.maximum(share.sum(axis=1), 1e-300))[:, None]
        total = np.stack([np.bincount(context, weights=share[:, i], minlength=CONTEXTS) for i in range(3)], axis=1)
        seen = total.sum(axis=1) > 0
        weights[seen] = (total[seen] + [0, 0, 1e-3]) / (total[seen].sum(axis=1, keepdims=True) + 1e-3)
    weights[0] = (0, *(weights[0, 1:] / weights[0, 1:].sum()))
    return weights


def _histograms(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.Table:
    """One row a histogram: group, keys and counts; keys -1 and -2 hold the totals N and V."""
    return pa.table({"g": pa.array([r[0] for r in rows], pa.int32()), "k": pa.array([r[1].astype("<i8").tobytes() for r in rows], pa.binary()), "c": pa.array([r[2].astype("<i8").tobytes() for r in rows], pa.binary())})


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The sum of histograms, of bounded size; the totals are the same in all of them. Sorted by key: -2, -1, 0, ..."""
    k, c = (np.concatenate([np.frombuffer(x, dtype="<i8") for x in table[n].to_pylist()]) for n in ("k", "c"))
    keys, inverse = np.unique(k, return_inverse=True)
    counts = np.zeros(len(keys), dtype=np.int64)
    np.add.at(counts, inverse.reshape(-1), c)
    counts[:2] //= table.num_rows
    return keys, counts


def score_texts(docs: DataFrame, parts: int = 10, id_col: str = "doc_id", text_col: str = "text", block_bytes: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Trained on rows whose crc32 of the id as text has a remainder other than 0. Null and empty texts are one end token.
    Ids may be null (as an empty id) or repeat. Where there are no training rows every token is unknown. An empty table
    gives an empty table. Scores are log10 probabilities of the whole text.
    """
    blocks, n = document_blocks(docs, id_col, text_col, block_bytes, (~is_held_out(id_col, parts)).alias("train"))

    fold = max(1, round(n**0.5))  # histograms are summed in groups first, so no task gets one of every block

    def send(table: pa.Table) -> pa.Table:
        return messages(_send(Block(table), table["block"][0].as_py(), n))

    def histogram(table: pa.Table, answers: pa.Table) -> pa.Table:
        b = Block(table)
        words, pairs, tokens, distinct = _totals(b, answers, n)
        t = b.train
        seen = words[b.at_context][t] - 1
        p2 = (pairs[b.at_pair][t] - 1) / np.maximum(seen, 1)
        bins = np.where(p2 > 0, 1 + np.rint(-2 * np.log2(np.maximum(p2, 1e-30))), 0).astype(np.int64).clip(0, PAIR_BINS - 1)
        index = (context_bucket(seen) * PAIR_BINS + bins) * WORD_BINS + _half_octaves(words[b.at_word[:-1]][t] - 1, WORD_BINS)
        keys, counts = np.unique(index, return_counts=True)
        return _histograms([(table["block"][0].as_py() % fold, np.concatenate((keys, [-1, -2])), np.concatenate((counts, [tokens, distinct])))])

    def merged(table: pa.Table) -> pa.Table:
        return _histograms([(0, *_merged(table))])

    def weigh(table: pa.Table) -> pa.Table:
        keys, counts = _merged(table)
        of = dict(zip(keys[:2].tolist(), counts[:2].tolist(), strict=True))
        weights = learn_weights(keys[2:], counts[2:].astype(np.float64), of[-1], of[-2])
        return pa.table({"body": pa.array([weights.tobytes()], pa.binary())})

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        b = Block(table)
        words, pairs, tokens, distinct = _totals(b, answers, n)
        weights = np.frombuffer(next(r["body"] for r in answers.to_pylist() if r["kind"] == WEIGHTS), dtype=np.float64).reshape(CONTEXTS, 3)
        c, seen = words[b.at_word[:-1]], words[b.at_context]
        w = weights[context_bucket(seen)]
        p = w[:, 0] * np.minimum(1, pairs[b.at_pair] / np.maximum(seen, 1)) + w[:, 1] * c / max(1, tokens) + w[:, 2] / (distinct + 1)
        cuts = b.ends - b.counts
        base = np.add.reduceat(np.log10((c + 0.1) / (tokens + 0.1 * (distinct + 1))), cuts)
        return pa.table(
            {
                "doc_id": pa.array(b.ids, pa.int64()),
                "held_out": pa.array(~b.doc_train),
                "n_tokens": pa.array(b.counts, pa.int64()),
                "n_known": pa.array(np.add.reduceat((c > 0).astype(np.int64), cuts), pa.int64()),
                "train_tokens": pa.array(np.full(len(b.ids), tokens), pa.int64()),
                "base_score": pa.array(base, pa.float64()),
                "score": pa.array(np.add.reduceat(np.log10(np.maximum(p, 1e-300)), cuts), pa.float64()),
            }
        )

    keyed = blocks.groupBy("block")
    answers = met(keyed.applyInArrow(send, MESSAGE), n, _sum, _decoded)
    held = "g int, k binary, c binary"
    counted = keyed.cogroup(answers.groupBy("block")).applyInArrow(histogram, held)
    weights = counted.groupBy("g").applyInArrow(merged, held).groupBy("g").applyInArrow(weigh, "body binary")
    told = weights.select(F.lit(-1).alias("bucket"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"), F.lit(WEIGHTS).alias("kind"), "body")
    return keyed.cogroup(answers.unionByName(told).groupBy("block")).applyInArrow(score, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
