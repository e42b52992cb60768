"""Ranked lexical search, term at a time, with a limited number of accumulators.

1. One pass over the documents keeps, for each, its length and the frequencies of the asked terms (packed; no words).
2. From that: how many documents there are, how many terms, and in how many documents each asked term stands.
3. Blocks of documents are inverted inside tasks. For each item the terms are taken rarest first, and a document gets an
   accumulator when a term first meets it. Once what the terms to come can add at most (their largest contributions in
   the block) is less than the kth partial score, no new accumulators are made; those there are go on being updated by
   all remaining terms, so their scores are exact. The kth score of earlier blocks of the task counts as well.
4. A block's best k of each item are merged: by (item, salt), then by item.

All numbers but the terms' weights are 64-bit integers, so scores don't depend on the order in which they are added.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import cells, cut, shuffle_partitions, utf8, word_hashes

K = 50
#: (item, term) pairs that tasks get at a time, and the postings that a task inverts at a time.
PAIRS, POSTINGS = 1 << 20, 1 << 20
FOUND = "item_id bigint, doc_id bigint, score bigint"


def asked_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term): distinct term hashes of each item; rows with one id are one item."""

    def run(batches):
        for batch in batches:
            hashes, counts = word_hashes(utf8(batch.column(1)), lower=True, letters=True)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(counts)), counts)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(hashes.view(np.int64))], ["item_id", "term"])

    own = items.select(F.col(cells(id_col)).cast("bigint").alias("item_id"), F.col(cells(text_col)).cast("string").alias("text"))
    return own.mapInArrow(run, "item_id bigint, term bigint").distinct()


def _frequencies(terms: np.ndarray, step: int = 4 << 20):
    """Per document its length, and numbers and frequencies of the asked terms it holds; ``terms`` are sorted."""

    def run(batches):
        for batch in batches:
            texts, at = utf8(batch.column(1)), 0
            while at < len(texts):
                upto, size = at, 0
                while upto < len(texts) and size < step:
                    size += len(texts[upto])
                    upto += 1
                hashes, counts = word_hashes(texts[at:upto], lower=True, letters=True)
                doc = np.repeat(np.arange(upto - at), counts)
                place = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
                live = terms[place] == hashes
                pairs, tf = np.unique(doc[live] * len(terms) + place[live], return_counts=True)
                own, term = np.divmod(pairs, len(terms))
                bounds = np.searchsorted(own, np.arange(upto - at + 1))
                packed = [[x[a:b].astype("<u4").tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] for x in (term, tf)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, upto - at), pa.array(counts), *(pa.array(p, pa.binary()) for p in packed)], ["doc_id", "n", "terms", "tf"])
                at = upto

    return run


def _document_frequencies(n_terms: int):
    def run(batches):
        df = np.zeros(n_terms, dtype=np.int64)
        for batch in batches:
            own = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype="<u4")
            df += np.bincount(own, minlength=n_terms)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(df[held])], ["term", "df"])

    return run


class Block:
    """Documents with their postings in the order of terms; ``ids`` ascend, so a place stands for an id in ties."""

    def __init__(self, ids: list, n: np.ndarray, terms: np.ndarray, tf: np.ndarray, doc: np.ndarray, stats: tuple[int, int], n_terms: int) -> None:
        self.ids = ids
        total, length = stats
        m = 50 + (50 * n * total) // length
        order = np.argsort(terms, kind="stable")
        terms, tf, self.doc = terms[order], tf[order], doc[order]
        self.part = (1_000_000_000 * tf) // (1000 * tf + 20 * m[self.doc])
        self.bounds = np.searchsorted(terms, np.arange(n_terms + 1))

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the documents that may be among the best k; ``terms`` come rarest first.

        ``least`` is a score that the best k are known to reach already.
        """
        spans = [(self.bounds[t], self.bounds[t + 1], w) for t, w in zip(terms.tolist(), weights.tolist(), strict=True)]
        most = np.array([w * int(self.part[a:b].max()) if b > a else 0 for a, b, w in spans], dtype=np.int64)
        rest = np.append(np.cumsum(most[::-1])[::-1], 0)  # what the terms from here on can add
        score, live = np.zeros(len(self.ids), dtype=np.int64), np.zeros(len(self.ids), dtype=bool)
        making = True
        for i, (a, b, w) in enumerate(spans):
            reached = rest[0] - rest[i]
            if making and (rest[i] < least or rest[i] < reached and rest[i] < self.kth(score, live, k)):
                making = False
            own, add = self.doc[a:b], w * self.part[a:b]
            if making:
                live[own] = True
                score[own] += add
            else:
                some = live[own]
                score[own[some]] += add[some]
        found = np.flatnonzero(live & (score >= max(1, least)))
        if len(found) > k:
            found = found[np.lexsort((found, -score[found]))[:k]]
        return found, score[found]

    @staticmethod
    def kth(score: np.ndarray, live: np.ndarray, k: int) -> int:
        """The kth partial score, -1 with fewer accumulators."""
        own = score[live]
        return int(np.partition(own, len(own) - k)[len(own) - k]) if len(own) >= k else -1


def _search(items: list, bounds: np.ndarray, terms: np.ndarray, weights: np.ndarray, stats: tuple[int, int], n_terms: int, k: int, postings: int):
    """Each item's best k documents of each block of a task; later blocks know the kth score of earlier ones."""

    def run(batches):
        held: list[tuple] = []
        size = 0
        least = np.zeros(len(items), dtype=np.int64)
        tops: list[np.ndarray] = [np.zeros(0, dtype=np.int64) for _ in items]

        def search():
            nonlocal held, size
            rows = sorted((r for part in held for r in part), key=lambda r: (r[0] is not None, r[0] or 0))
            held, size = [], 0
            counts = np.array([len(r[2]) // 4 for r in rows])
            own, tf = (np.frombuffer(b"".join(r[c] for r in rows), dtype="<u4").astype(np.int64) for c in (2, 3))
            block = Block([r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.int64), own, tf, np.repeat(np.arange(len(rows)), counts), stats, n_terms)
            out: list[tuple] = []
            for i, item in enumerate(items):
                a, b = bounds[i], bounds[i + 1]
                found, score = block.best(terms[a:b], weights[a:b], k, int(least[i]))
                out += zip([item] * len(found), [block.ids[p] for p in found.tolist()], score.tolist(), strict=True)
                tops[i] = np.sort(np.concatenate((tops[i], score)))[::-1][:k]
                if len(tops[i]) == k:
                    least[i] = tops[i][-1]
            columns = list(zip(*out, strict=True)) if out else [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item_id", "doc_id", "score"])

        for batch in batches:
            rows = [r for r in zip(*(c.to_pylist() for c in batch.columns), strict=True) if r[2]]
            held.append(rows)
            size += sum(len(r[2]) // 4 + 1 for r in rows)
            if size >= postings:
                yield search()
        if size:
            yield search()

    return run


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K, pairs: int = PAIRS, postings: int = POSTINGS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", salts: int = 64) -> DataFrame:
    """Each item's ``k`` best documents with a score above 0: item_id, rank, doc_id, score.

    Terms are runs of letters and digits of any script, ASCII in lower case. Equal scores rank by ascending doc_id (null
    first). Null, empty and wordless texts have no terms; such items have no rows. Rows of items with one id (null too) are
    one item; each row of ``docs`` is a document, so rows that repeat an id may all rank. Texts of any length are read
    whole. An empty table on either side gives an empty table. Other columns aren't read. Items go to tasks in blocks of
    about ``pairs`` item terms, and each block of items is met by all documents; one item's terms must fit a task.
    """
    spark = docs.sparkSession
    wanted = cut(asked_terms(items, item_col, item_text))
    n_blocks = max(1, -(-wanted.count() // pairs))
    base = docs.select(F.col(cells(id_col)).cast("bigint").alias("doc_id"), F.col(cells(text_col)).cast("string").alias("text"))
    found = None
    for i in range(n_blocks):
        # about ``pairs`` rows: the stated query set in blocks
        rows = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == i).toArrow()
        if not rows.num_rows:
            continue
        asked = rows["term"].to_numpy().view(np.uint64)
        terms = np.unique(asked)
        kept = cut(base.mapInArrow(_frequencies(terms), "doc_id bigint, n bigint, terms binary, tf binary"))
        total = kept.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
        if not total["docs"]:
            continue
        counted = kept.select("terms").mapInArrow(_document_frequencies(len(terms)), "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
        df = np.zeros(len(terms), dtype=np.int64)
        for r in counted.collect():  # a row a term of this block of items
            df[r["term"]] = r["df"]
        weight = np.array([math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)
        place = np.searchsorted(terms, asked)
        null, item = rows["item_id"].is_null().to_numpy(), rows["item_id"].fill_null(0).to_numpy()
        order = np.lexsort((place, df[place], item, null))  # an item's terms rarest first
        place, null, item = place[order], null[order], item[order]
        starts = np.flatnonzero(np.append(True, (item[1:] != item[:-1]) | (null[1:] != null[:-1])))
        ids = [None if null[s] else int(item[s]) for s in starts]
        work = _search(ids, np.append(starts, len(item)), place, weight[place], (total["docs"], total["terms"]), len(terms), k, postings)
        own = kept.mapInArrow(work, FOUND)
        found = own if found is None else found.union(own)
    if found is None:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc("doc_id")))
    first = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts))).withColumn("rank", best("item_id", "salt")).where(F.col("rank") <= k)
    ranked = first.withColumn("rank", best("item_id")).where(F.col("rank") <= k)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
