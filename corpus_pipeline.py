"""The corpus pipeline: toxicity, exact dedup, near dedup, mixing and packing, each on all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from feldspar.llm._common import shared_dir
from feldspar.llm.exact_dedup import exact_dedup
from feldspar.llm.minhash_dedup import near_dedup
from feldspar.llm.mixing import mix_sources
from feldspar.llm.packing import pack
from feldspar.llm.toxicity import clean_documents, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return clean_documents(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8) stays."""
    return near_dedup(docs, words=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat by their source's rate; a document that is drawn 0 times goes."""
    return mix_sources(docs, details=False)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences. Workers outlive a stage, so fewer encoded pieces are kept in them than packing alone keeps."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), cache_pieces=100_000)


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("near dedup", near), ("mixing", mixing), ("packing", packing)]

#: SQL can't express the classifier, so there is none.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each is written to the shared folder and read again."""
    import uuid

    out = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{out}/{i}")
        docs = spark.read.parquet(f"{out}/{i}")
    return docs
