"""Search copies: identifiers in canonical form, shorthand spelt out, boilerplate dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import rewrite_identifiers
from ..functions.text import expand_shorthand, sentences
from .chunking import boilerplate


def search_copies(documents: DataFrame, words: dict[str, str], share: float = 0.02, least: int = 2, from_documents: int = 20) -> DataFrame:
    """(doc_id, index_text) of ``documents`` (doc_id, text): the copy that is searched, not shown.

    Boilerplate is what stands in more than max(``least``, ``share`` of all) documents after the first two steps; it is
    counted in the form that is dropped. A document that loses a sentence keeps the others in order, a line each; one
    without boilerplate in a corpus that has some is lines of sentences too, and in a corpus without any (or under
    ``from_documents`` documents) the text stays as it is. Only sentences, not texts, meet the list of boilerplate. Null
    texts stay null.
    """
    own = documents.select("doc_id", expand_shorthand(rewrite_identifiers(F.col("text")), words).alias("text"))
    common = boilerplate(own, sentences(F.col("text")), least, share, from_documents).select("sentence")
    if not common.limit(1).count():
        return own.withColumnRenamed("text", "index_text")
    flat = own.select("doc_id", F.posexplode(sentences(F.col("text"))).alias("pos", "sentence")).join(common, "sentence", "left_anti")
    kept = flat.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("pos", "sentence")))["sentence"], "\n").alias("kept"))
    return own.join(kept, "doc_id", "left").select("doc_id", F.when(F.col("text").isNotNull(), F.coalesce("kept", F.lit(""))).alias("index_text"))
