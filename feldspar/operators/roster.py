"""Roster names in running text: member names as PERSON spans, by joins of a text's tokens with the roster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .search import small

#: What counts as a name's token, and the scores of full and of single names.
TOKEN = r"\b[A-Z][a-z]{2,}(?:['-][A-Z][a-z]+)?\b"
FULL, SINGLE = 0.85, 0.45
SPANS = "array<struct<type:string,start:int,stop:int,score:double>>"


def name_tokens(text: Column) -> Column:
    """array<struct<i, start, stop, word, gap>> of the capitalised words of a text; ``gap`` is what stands before the next."""
    gaps, hits = F.split(text, TOKEN, -1), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    none = F.array().cast("array<struct<start:int,stop:int,word:string,gap:string>>")

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["g"])
        stop = start + F.length(p["h"])
        one = F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"), p["h"].alias("word"), p["n"].alias("gap"))
        return F.struct(stop.cast("int").alias("at"), F.concat(acc["all"], F.array(one)).alias("all"))

    after = F.slice(gaps, 2, F.greatest(F.size(gaps) - 1, F.lit(0)))
    triples = F.filter(F.arrays_zip(gaps.alias("g"), hits.alias("h"), after.alias("n")), lambda p: p["h"].isNotNull())
    return F.aggregate(triples, F.struct(F.lit(0).alias("at"), none.alias("all")), step)["all"]


def roster_spans(documents: DataFrame, roster: DataFrame) -> DataFrame:
    """(doc_id, spans) of (doc_id, text): PERSON spans of names on the roster (first, last), characters from 0.

    From left to right: "First Last" of one member (at most two characters between) and "Last, First" score FULL and use
    both words up; any other first or last name on the roster scores SINGLE. Only words that the roster knows leave a
    text, and a text's hits come together again as one row. A roster of up to BROADCAST_ROWS names is broadcast, a larger
    one joined. Null texts and texts without names have no spans; null names on the roster are left out.
    """
    names = roster.where("first is not null and last is not null").select("first", "last").distinct()
    words = names.select(F.explode(F.array("first", "last")).alias("word")).distinct()
    tokens = documents.select("doc_id", F.posexplode(name_tokens(F.col("text"))).alias("i", "t")).select("doc_id", "i", "t.*")
    known = tokens.join(small(words), "word", "left_semi")
    after = known.select("doc_id", (F.col("i") - 1).alias("i"), F.col("word").alias("next"), F.col("stop").alias("next_stop"))
    pairs = known.join(after, ["doc_id", "i"], "left")
    straight, swapped = F.length("gap") <= 2, F.col("gap").isin(",", ", ")
    full = small(names.select("first", "last", F.lit(True).alias("_full")))
    pairs = pairs.join(full.withColumnsRenamed({"first": "word", "last": "next"}), ["word", "next"], "left").withColumn("_one", F.coalesce("_full", F.lit(False)) & straight).drop("_full")
    pairs = pairs.join(full.withColumnsRenamed({"last": "word", "first": "next"}), ["word", "next"], "left").withColumn("_two", F.coalesce("_full", F.lit(False)) & swapped).drop("_full")
    hits = F.array_sort(F.collect_list(F.struct("i", "start", "stop", "next_stop", (F.col("_one") | F.col("_two")).alias("both"))))
    none = F.array().cast(SPANS)

    def step(acc: Column, h: Column) -> Column:
        one = F.struct(F.lit("PERSON").alias("type"), h["start"].alias("start"), F.when(h["both"], h["next_stop"]).otherwise(h["stop"]).alias("stop"), F.when(h["both"], FULL).otherwise(SINGLE).alias("score"))
        taken = F.struct(F.when(h["both"], h["i"] + 1).otherwise(h["i"]).alias("used"), F.concat(acc["all"], F.array(one)).alias("all"))
        return F.when(h["i"] <= acc["used"], acc).otherwise(taken)

    found = pairs.groupBy("doc_id").agg(F.aggregate(hits, F.struct(F.lit(-1).alias("used"), none.alias("all")), step)["all"].alias("spans"))
    return documents.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))
