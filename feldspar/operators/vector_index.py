"""A partitioned vector index: centroids from a bounded sample, every row in the cell of its nearest one, queries probe a
few cells; and its recall against the exact scan, for all rows and for what a persona may see.

Blocks of questions are sent past the index, whose rows stay where they lie; a block of rows scores those of its cells, and
only rows from a question's bound on leave a task, however many cells are probed. The policy's filter comes before the rank.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lineage import cut
from .search import CHUNK_BLOCK, QUERY_BLOCK, STREAMED_BLOCKS, _by_cell, _matrix, _nearest, _ranked, _streamed

#: At most so many rows are fitted on (the lowest by a hash of the id), and at most so many cells are made.
SAMPLE_ROWS, MOST_CELLS = 20_000, 4096
#: So many rows at once find their cells.
TILE = 1024


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; zeros stay zeros."""
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-30)


def fit_centroids(vectors: DataFrame, cells: int | None = None, sample_rows: int = SAMPLE_ROWS, rounds: int = 8) -> np.ndarray:
    """Spherical k-means over a sample of at most ``sample_rows`` rows (chunk_id, vector).

    Without ``cells`` there are as many as the square root of the rows, MOST_CELLS at most. Rows without a vector aren't
    taken; vectors must have one length. No rows give no centroids.
    """
    rows = vectors.where("vector is not null")
    n = rows.count()
    cells = max(1, min(cells or round(n**0.5), MOST_CELLS, n))
    got = rows.orderBy(F.xxhash64(F.lit("centroids"), "chunk_id"), "chunk_id").limit(sample_rows).select("vector").toArrow()
    if not got.num_rows:
        return np.zeros((0, 0))
    length = len(got["vector"][0])
    x, at = _matrix(got["vector"], length)
    if len(at) < got.num_rows:
        raise ValueError("vectors must have one length")
    x = unit(x)
    centroids = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)]
    for _ in range(rounds):
        own = (x @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        held = np.bincount(own, minlength=len(centroids)) > 0
        centroids[held] = unit(sums[held])  # an empty cell keeps its centroid
    return centroids


def with_cells(vectors: DataFrame, centroids: np.ndarray, probes: int = 1) -> DataFrame:
    """The rows of ``vectors`` (..., vector) that have a vector, and ``cells``: their ``probes`` nearest cells, best first."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)  # at most MOST_CELLS vectors
    many = max(1, min(probes, len(centroids)))
    rows = vectors.where("vector is not null")
    form = T.StructType([*rows.schema, T.StructField("cells", T.ArrayType(T.IntegerType()))])
    place = rows.columns.index("vector")

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, TILE):
                batch, own = whole.slice(i, TILE), shared.value
                x, at = _matrix(pa.chunked_array([batch.column(place)]), own.shape[1])
                best = np.argsort(-(unit(x) @ own.T), axis=1, kind="stable")[:, :many].astype(np.int32)
                cells = pa.ListArray.from_arrays(pa.array(np.arange(0, best.size + 1, many, dtype=np.int32)), pa.array(best.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at)).columns, cells], form.names)

    if not len(centroids):
        return rows.limit(0).withColumn("cells", F.lit(None).cast("array<int>"))
    return rows.mapInArrow(run, form)


def write_index(vectors: DataFrame, centroids: np.ndarray, path: str) -> None:
    """Every row of ``vectors`` (chunk_id, vector, ...) with its cell, a folder a cell, so that probes prune the others. Rows
    go to as many tasks as a cell's size asks for."""
    rows = with_cells(vectors, centroids).withColumn("cell", F.col("cells")[0]).drop("cells")
    rows.hint("rebalance", F.col("cell")).write.partitionBy("cell").mode("overwrite").parquet(path)


def probe(index: DataFrame, queries: DataFrame, centroids: np.ndarray, probes: int, top: int) -> DataFrame:
    """(query_id, chunk_id, similarity, vrank): the best ``top`` rows of the ``probes`` cells nearest to each query.

    ``index`` is what ``write_index`` wrote, filtered by whatever policy holds; ``queries`` is (query_id, vector).
    """
    return _ranked(probe_scores(index, queries, centroids, probes, [], top), [], "similarity", "vrank", top).select("query_id", "chunk_id", "similarity", "vrank")


def probe_scores(index: DataFrame, queries: DataFrame, centroids: np.ndarray, probes: int, by: list[str], top: int) -> DataFrame:
    """(query_id, chunk_id, by..., similarity), among them the best ``top`` rows of every query and ``by`` in its cells.

    Up to STREAMED_BLOCKS blocks of questions, these are sent past the index, as in ``vector_scores``; beyond, questions go
    to their cells, and cells of more than CHUNK_BLOCK rows are met block by block.
    """
    asked = with_cells(queries.select("query_id", "vector"), centroids, probes)
    wanted = [r.cell for r in asked.select(F.explode("cells").alias("cell")).distinct().collect()]  # at most MOST_CELLS numbers; prunes folders
    rows = index.where(F.col("cell").isin(wanted)).select("chunk_id", *by, "vector", "cell")
    blocks = -(-queries.count() // QUERY_BLOCK) or 1
    if blocks <= STREAMED_BLOCKS:
        return _streamed(rows, asked, blocks, _by_cell, by, by, "similarity", top)
    sizes = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CHUNK_BLOCK).alias("_blocks"))
    rows = rows.join(F.broadcast(sizes), "cell").withColumn("_block", F.pmod(F.xxhash64("chunk_id"), F.col("_blocks"))).drop("_blocks")
    asked = asked.withColumn("cell", F.explode("cells")).drop("cells").join(F.broadcast(sizes), "cell")
    asked = asked.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1))).drop("_blocks")
    form = T.StructType([queries.schema["query_id"], *[rows.schema[c] for c in ("chunk_id", *by)], T.StructField("similarity", T.DoubleType())])
    best = _nearest(by, top)
    return rows.groupBy("cell", "_block").cogroup(asked.groupBy("cell", "_block")).applyInArrow(lambda x, y: best(x, y) if x.num_rows and y.num_rows else form_table(form), form)


def form_table(form: T.StructType) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(form).empty_table()


def recall(exact: DataFrame, found: DataFrame, k: int, eps: float = 1e-9, by: Sequence[str] = ()) -> DataFrame:
    """(query_id, by..., recall, underfilled): the share of the k nearest that were found, by distance.

    ``exact`` and ``found`` are (query_id, by..., similarity, vrank); what is as near as the exact kth counts, whichever row it
    is. Queries with fewer than k exact rows are measured by these; without any their recall is 1.
    """
    own = ["query_id", *by]
    truth = exact.where(F.col("vrank") <= k).groupBy(*own).agg(F.min("similarity").alias("_kth"), F.count(F.lit(1)).alias("_n"))
    hits = found.where(F.col("vrank") <= k).join(truth, own, "right").groupBy(*own, "_n").agg(F.count_if(F.col("similarity") >= F.col("_kth") - eps).alias("_hit"), F.count("similarity").alias("_got"))
    return hits.select(*own, F.least(F.lit(1.0), F.col("_hit") / F.col("_n")).alias("recall"), (F.col("_got") < F.col("_n")).alias("underfilled"))


def summary(measured: DataFrame, *by: str) -> DataFrame:
    """Mean and least recall and the underfilled queries, of ``recall`` rows with the columns ``by``."""
    return measured.groupBy(*by).agg(F.round(F.avg("recall"), 4).alias("recall"), F.round(F.min("recall"), 4).alias("least_recall"), F.count_if("underfilled").alias("underfilled"), F.count(F.lit(1)).alias("queries"))


def calibrated_probes(rows: DataFrame, index: DataFrame, queries: DataFrame, centroids: np.ndarray, k: int, target: float, sample: int = 64, steps: int = 8) -> tuple[int, list[tuple[int, float]]]:
    """The least of ``steps`` numbers of probes whose mean recall@k reaches ``target``, and what was measured on the way.

    Measured on at most ``sample`` queries (the lowest by a hash of the id) against the exact scan of ``rows``. All cells are
    the last step, which is exact, so an answer always exists; vectors without structure need most cells.
    """
    from .search import vector_arm

    few = cut(queries.orderBy(F.xxhash64(F.lit("probes"), "query_id"), "query_id").limit(sample))
    exact = vector_arm(rows, few, [], k).cache()
    tried: list[tuple[int, float]] = []
    for step in range(1, steps + 1):
        probes = max(1, -(-len(centroids) * step // steps))
        mean = recall(exact, probe(index, few, centroids, probes, k), k).agg(F.avg("recall")).first()[0]
        tried.append((probes, 1.0 if mean is None else mean))
        if tried[-1][1] >= target:
            break
    exact.unpersist()
    return tried[-1][0], tried
