"""Toxicity by a convolutional text classifier: hashed word embeddings, filters over 1 to 3 words, max pooling.

Trained in numpy on a bounded sample of labelled rows (``sample_rows``, the lowest by a hash of the id); every text is
then scored whole, in Arrow batches. A word's embedding is the sum of two rows, each chosen by its own hash, so that two
words rarely share both. Because a filter is linear, the product of the embedding table and the filter is tabulated
once and scoring adds looked-up rows. Thresholds are calibrated by language, guessed from the text's function words, on all labelled rows outside the held-out part:
the logit is shifted by the language's threshold, so 0.5 is the threshold of every language's score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import U64, cells, hidden, mix, restored, utf8, word_hashes

#: Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and to that with for was is".split(),
    "fr": "le la les des et que une dans est sur".split(),
    "de": "der die und das ist nicht mit den ein von".split(),
    "es": "el los las que del una con por para y".split(),
}
LANGUAGES = [*FUNCTION_WORDS, "other"]
BITS, DIM, FILTERS, WIDTHS = 15, 8, 4, (1, 2, 3)
PADS = max(WIDTHS)
#: Bins of a logit unit in the histogram for thresholds, and the logits of its ends.
BINS, EDGE = 64, 32


def is_held_out(id_col: str, parts: int):
    """crc32 of the id as text falls into remainder 0."""
    return (F.crc32(F.coalesce(F.col(cells(id_col)).cast("string"), F.lit("")).cast("binary")) % parts) == 0


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the texts, each followed by PADS pads (0), and each text's first position with the end.

    A text without words is its pads: as many as the widest filter reads, so no window reaches another text.
    """
    hashes, counts = word_hashes(texts, lower=True, letters=True)
    starts = np.concatenate(([0], np.cumsum(counts + PADS)))
    out = np.zeros(starts[-1], dtype=U64)
    out[np.arange(len(hashes)) + np.repeat(PADS * np.arange(len(texts)), counts)] = hashes
    return out, starts


def rows_of(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two embedding rows of each word; row 0 is the pad."""
    size = (1 << BITS) - 1
    pad = hashes == 0
    one = (hashes % U64(size)).astype(np.int64) + 1
    two = (mix(hashes ^ U64(0xA5A5A5A5A5A5A5A5)) % U64(size)).astype(np.int64) + 1
    one[pad] = 0
    two[pad] = 0
    return one, two


def guess_language(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Index into LANGUAGES: the most function words; the last where there are none."""
    counts = np.zeros((len(starts) - 1, len(LANGUAGES)), dtype=np.int64)
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    for i, words in enumerate(FUNCTION_WORDS.values()):
        own, _ = word_hashes([w.encode() for w in words])
        counts[:, i] = np.bincount(doc[np.isin(hashes, own)], minlength=len(starts) - 1)
    counts[:, -1] = counts.sum(axis=1) == 0
    return counts.argmax(axis=1)


class TextCNN:
    """Two hashed embedding tables, filters of several widths, max pooling over the text, one output."""

    def __init__(self, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        self.e = [r.normal(0, 0.05, (1 << BITS, DIM)).astype(np.float32) for _ in range(2)]
        self.w = {w: r.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
        for w in WIDTHS:
            self.w[w][:, 0, 0] = 1.0 / w  # one filter of each width starts as the mean of the seeded dimension
        self.c = {w: np.zeros(FILTERS, dtype=np.float32) for w in WIDTHS}
        self.o = np.full(FILTERS * len(WIDTHS), 0.1, dtype=np.float32)
        self.b = np.float32(-1.0)
        self.shift = np.zeros(len(LANGUAGES))
        self.tables: list[list[np.ndarray]] | None = None

    def seed(self, one: np.ndarray, two: np.ndarray, starts: np.ndarray, y: np.ndarray) -> None:
        """Starts dimension 0 of each row at the smoothed log odds of the texts that hold it."""
        doc = np.repeat(np.arange(len(y)), np.diff(starts))
        for e, rows in zip(self.e, (one, two), strict=True):
            pairs = np.unique(doc * (1 << BITS) + rows)
            d, row = pairs >> BITS, pairs & ((1 << BITS) - 1)
            toxic = np.bincount(row, weights=y[d], minlength=1 << BITS)
            clean = np.bincount(row, weights=1 - y[d], minlength=1 << BITS)
            odds = np.log((toxic + 1) / (y.sum() + 2)) - np.log((clean + 1) / ((1 - y).sum() + 2))
            e[:, 0] = (odds * (toxic + clean) / (toxic + clean + 4)).astype(np.float32) / 2
            e[0] = 0

    def fit(self, hashes: np.ndarray, starts: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 128, rate: float = 0.05, seeded: bool = True, drop: float = 0.5) -> None:
        one, two = rows_of(hashes)
        if seeded:
            self.seed(one, two, starts, y)
        r = np.random.default_rng(11)
        weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
        grown: dict[str, np.ndarray] = {}

        def step(name: str, value: np.ndarray, g: np.ndarray, at=slice(None)) -> None:
            if name not in grown:
                grown[name] = np.full_like(value, 1e-3)
            acc = grown[name]
            acc[at] += g * g
            value[at] -= rate * g / np.sqrt(acc[at])

        words = (one.astype(np.int32), two.astype(np.int32))
        for _ in range(epochs):
            gone = r.random(len(hashes)) < drop  # words left out of this round, so that no single one decides
            one, two = (np.where(gone, 0, x) for x in words)
            for docs in np.array_split(r.permutation(len(y)), max(1, len(y) // batch)):
                best, pooled = np.zeros((len(docs), len(self.o)), dtype=np.int64), np.zeros((len(docs), len(self.o)), dtype=np.float32)
                for k, d in enumerate(docs):
                    at, end = starts[d], starts[d + 1]
                    x = self.e[0][one[at:end]] + self.e[1][two[at:end]]
                    n = max(1, end - at - PADS)  # windows start at words, or at the first pad where there are none
                    for i, w in enumerate(WIDTHS):
                        z = sum(x[j : j + n] @ self.w[w][j] for j in range(w)) + self.c[w]
                        own = slice(i * FILTERS, (i + 1) * FILTERS)
                        best[k, own] = z.argmax(axis=0) + at
                        pooled[k, own] = z.max(axis=0)
                live = pooled > 0
                act = np.where(live, pooled, 0)
                p = 1 / (1 + np.exp(-np.clip(act @ self.o + self.b, -30, 30)))
                g = ((p - y[docs]) * weight[docs] / len(docs)).astype(np.float32)
                ga = np.outer(g, self.o) * live
                go = act.T @ g + 1e-4 * self.o
                for i, w in enumerate(WIDTHS):
                    own = slice(i * FILTERS, (i + 1) * FILTERS)
                    gz, pos = ga[:, own], best[:, own]
                    gw = np.zeros_like(self.w[w])
                    for j in range(w):
                        r1, r2 = one[pos + j], two[pos + j]
                        x = self.e[0][r1] + self.e[1][r2]
                        gw[j] = np.einsum("kf,kfd->df", gz, x)
                        gx = gz[:, :, None] * self.w[w][j].T[None]
                        for name, table, rows in (("e0", self.e[0], r1), ("e1", self.e[1], r2)):
                            flat, inverse = np.unique(rows, return_inverse=True)
                            total = np.zeros((len(flat), DIM), dtype=np.float32)
                            np.add.at(total, inverse.reshape(-1), gx.reshape(-1, DIM))
                            total[flat == 0] = 0
                            step(name, table, total, flat)
                    step(f"w{w}", self.w[w], gw)
                    step(f"c{w}", self.c[w], gz.sum(axis=0))
                step("o", self.o, go)
                b = np.array([self.b])
                step("b", b, np.array([g.sum()]))
                self.b = b[0]

    def tabulate(self) -> None:
        """Products of embeddings and filters: for word j of a window, the widths over j, side by side."""
        self.tables = [[np.concatenate([e @ self.w[w][j] for w in WIDTHS if w > j], axis=1) for e in self.e] for j in range(max(WIDTHS))]

    def logits(self, hashes: np.ndarray, starts: np.ndarray, step: int = 1 << 16) -> np.ndarray:
        if self.tables is None:
            self.tabulate()
        one, two = rows_of(hashes)
        bias = np.concatenate([self.c[w] for w in WIDTHS])
        first, stop = starts[:-1], np.maximum(starts[1:] - PADS, starts[:-1] + 1)  # where windows start in each text
        pooled = np.full((len(first), len(self.o)), -np.inf, dtype=np.float32)
        for a in range(0, len(hashes), step):  # pieces of ``step`` positions, inside long texts too
            b = min(a + step, len(hashes))
            z = np.full((b - a + 1, len(self.o)), -np.inf, dtype=np.float32)  # the last row is for reduceat's end
            z[:-1] = self.tables[0][0][one[a:b]] + self.tables[0][1][two[a:b]] + bias
            for j in range(1, max(WIDTHS)):
                t1, t2 = self.tables[j]
                upto = min(b + j, len(hashes))
                z[: upto - a - j, j * FILTERS :] += t1[one[a + j : upto]] + t2[two[a + j : upto]]
            held = np.arange(int(np.searchsorted(starts, a, side="right")) - 1, int(np.searchsorted(starts, b, side="left")))
            held = held[np.maximum(first[held], a) < np.minimum(stop[held], b)]
            if len(held):
                cuts = np.stack((np.maximum(first[held], a) - a, np.minimum(stop[held], b) - a), axis=1).reshape(-1)
                pooled[held] = np.maximum(pooled[held], np.maximum.reduceat(z, cuts, axis=0)[::2])
        return np.maximum(pooled, 0) @ self.o + self.b

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Scores from 0 to 1, and the guessed language."""
        hashes, starts = features(texts)
        lang = guess_language(hashes, starts)
        z = self.logits(hashes, starts) - self.shift[lang]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), lang


def pieces(texts: list[bytes], batch_bytes: int):
    """Runs of texts of about ``batch_bytes`` bytes; a longer text is one run."""
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and size < batch_bytes:
            size += len(texts[upto])
            upto += 1
        yield texts[at:upto]
        at = upto


def logit_bins(docs: DataFrame, model: TextCNN, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 4 << 20) -> DataFrame:
    """(id, lang, bin) of whole texts: index of the guessed language and the logit's bin."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            bins, langs = [], []
            for texts in pieces(utf8(batch.column("text")), batch_bytes):
                hashes, starts = features(texts)
                langs.append(guess_language(hashes, starts))
                bins.append(np.floor(np.clip(shared.value.logits(hashes, starts), -EDGE, EDGE) * BINS).astype(np.int32))
            if bins:
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.concatenate(langs).astype(np.int32)), pa.array(np.concatenate(bins))], ["id", "lang", "bin"])

    own = docs.select(F.col(cells(id_col)).alias("id"), F.col(cells(text_col)).alias("text"))
    return own.mapInArrow(run, f"id {dict(own.dtypes)['id']}, lang int, bin int")


def threshold(bins: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float:
    """Where F1 is best, midway between the bins that hold rows there."""
    bins, at = np.unique(bins, return_inverse=True)
    bins = bins[::-1]
    hit, miss = (np.cumsum(np.bincount(at, weights=n, minlength=len(bins))[::-1]) for n in (toxic, clean))
    k = int((2 * hit / (hit + miss + hit[-1])).argmax())
    return float(bins[k] + bins[k + 1] + 1) / 2 / BINS if k + 1 < len(bins) else float(bins[k]) / BINS


def calibrate(model: TextCNN, docs: DataFrame, own: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 20) -> None:
    """Sets each language's threshold where F1 on all rows of ``docs`` with a label in ``own`` (id, y) is best.

    Texts are scored where they lie; only ids and bins are joined, and the histogram has a fixed bound (languages x bins
    x labels). Languages with fewer than ``least`` toxic or clean rows take the threshold of all rows.
    """
    rows = logit_bins(docs, model, id_col, text_col).join(own, "id").groupBy("lang", "bin").agg(F.count_if(F.col("y") == 1).alias("toxic"), F.count_if(F.col("y") == 0).alias("clean"))
    got = np.array([tuple(r) for r in rows.collect()], dtype=np.int64).reshape(-1, 4)
    lang, bins, toxic, clean = got.T
    if toxic.sum() and clean.sum():
        model.shift[:] = threshold(bins, toxic, clean)
        for i in range(len(LANGUAGES)):
            at = lang == i
            if toxic[at].sum() >= least and clean[at].sum() >= least:
                model.shift[i] = threshold(bins[at], toxic[at], clean[at])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 6000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", parts: int = 5, seeded: bool = True, epochs: int = 8) -> TextCNN | None:
    """Fits on at most ``sample_rows`` labelled rows outside the held-out part; None where one class is missing.

    The sample: half of it from the toxic rows and the rest from the clean ones, lowest hash of the id first, whole
    texts of any length (of several texts of one id the smallest). One row in five of the sample isn't fetched or
    fitted, so that thresholds see rows that the network doesn't know. The driver holds the fitted rows: its memory
    bounds how long labelled texts may be. Thresholds are calibrated on all labelled rows outside the held-out part.
    Without ``seeded`` the network starts from random weights alone.
    """
    ids, y = F.col(cells(id_col)), F.col(cells(label_col))
    own = labels.where(y.isNotNull() & ids.isNotNull() & ~is_held_out(id_col, parts)).groupBy(ids.alias("id")).agg(F.max(y).alias("y"))
    lot = F.xxhash64(F.lit("toxicity"), F.col("id"))
    picked = [own.where(F.col("y") == v).orderBy(lot).limit(sample_rows // 2) for v in (1, 0)]
    few = picked[0].union(picked[1]).orderBy("id").collect()  # at most sample_rows ids
    known = F.broadcast(docs.sparkSession.createDataFrame([r for i, r in enumerate(few) if i % 5], own.schema))
    got = docs.select(ids.alias("id"), F.col(cells(text_col)).alias("text")).join(known, "id").groupBy("id", "y").agg(F.min("text").alias("text")).toPandas()
    if got.empty or got["y"].nunique() < 2:
        return None
    got = got.sort_values("id", kind="stable")
    model = TextCNN()
    hashes, starts = features([(x or "").encode() for x in got["text"]])
    model.fit(hashes, starts, got["y"].to_numpy(dtype=np.float64), epochs, seeded=seeded)
    model.tabulate()
    calibrate(model, docs.where(ids.isNotNull() & ~is_held_out(id_col, parts)), own, id_col, text_col)
    return model


def _scored(plain: DataFrame, text: str, model: TextCNN | None, batch_bytes: int) -> DataFrame:
    """``plain`` (columns c0, c1, ...) with _t_score, _t_predicted and _t_language."""
    shared = plain.sparkSession.sparkContext.broadcast(model)  # fixed size: 2 ** BITS rows a table

    def run(batches):
        cnn = shared.value
        for batch in batches:
            scores, langs = [np.zeros(0)], [np.zeros(0, dtype=np.int64)]
            for own in pieces(utf8(batch.column(text)), batch_bytes):
                s, g = (np.zeros(len(own)), np.full(len(own), len(LANGUAGES) - 1)) if cnn is None else cnn.score(own)
                scores.append(s)
                langs.append(g)
            s, g = np.concatenate(scores), np.concatenate(langs)
            more = [pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32()), pa.array([LANGUAGES[i] for i in g], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "_t_score", "_t_predicted", "_t_language"])

    fields = ", ".join(f"{n} {t}" for n, t in plain.dtypes)
    return plain.mapInArrow(run, f"{fields}, _t_score double, _t_predicted int, _t_language string")


def score_toxicity(docs: DataFrame, model: TextCNN | None, text_col: str = "text", batch_bytes: int = 4 << 20) -> DataFrame:
    """``docs`` with _t_score, _t_predicted (score of 0.5 or more) and _t_language appended; all other columns pass.

    Null and empty texts are scored as texts without words. Without a model (no labels, or one class only) every score
    is 0. Ids may be null or repeat. An empty table gives an empty table. Columns may have any names: where ``docs`` has
    one of the three names already, the new column gets an underscore more at its end.
    """
    plain, (text,) = hidden(docs, text_col)
    return restored(_scored(plain, text, model, batch_bytes), docs, _t_score="_t_score", _t_predicted="_t_predicted", _t_language="_t_language")


def clean_documents(docs: DataFrame, model: TextCNN | None, text_col: str = "text", batch_bytes: int = 4 << 20) -> DataFrame:
    """The rows of ``docs`` that aren't predicted to be toxic, with their own columns; cases as in ``score_toxicity``."""
    plain, (text,) = hidden(docs, text_col)
    return restored(_scored(plain, text, model, batch_bytes).where("_t_predicted = 0"), docs)
