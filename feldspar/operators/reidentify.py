"""Between originals and pseudonyms, for those who may: texts re-identified for scoring, questions put into the vault's
words by what a persona is entitled to, and spans released whose masking protects nothing.

A vault here is (entity, original, pseudonym); it is joined, never collected, so it may be of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import rewrite_identifiers

#: Identifiers that every persona's questions translate, what entitled ones translate besides, and who they are.
IDENTIFIER_TYPES = ("MEMBER_ID", "MRN", "CLAIM_ID", "CASE_ID")
NAMED_TYPES = ("PERSON", "US_SSN", "PHONE_NUMBER", "US_DRIVER_LICENSE", "ID", "MEDICAL_LICENSE")
ENTITLED = ("admin", "care_team")
#: A pseudonym in a text, the shortest original that is looked for, and the types that shape alone suggests.
TOKEN, LEAST_LENGTH = r"\[[A-Z_]+-[0-9]{4,}\]", 4
GUESSED_TYPES = ("PERSON", "LOCATION", "NRP", "ORGANIZATION")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def reidentified(documents: DataFrame, vault: DataFrame) -> DataFrame:
    """``documents`` (doc_id, text, ...) with the pseudonyms of whole texts as their originals.

    Pseudonyms that the vault doesn't know stay; of several originals of one pseudonym the smallest is taken. Only texts
    that hold a pseudonym are joined. Null texts and ids stay as they are.
    """
    hits = F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))
    holds = F.coalesce(F.col("text").rlike(TOKEN), F.lit(False)) & F.col("doc_id").isNotNull()
    some = documents.where(holds)
    originals = vault.where("pseudonym is not null and original is not null").groupBy("pseudonym").agg(F.min("original").alias("original"))
    known = some.select("doc_id", F.explode(F.array_distinct(hits)).alias("pseudonym")).join(originals, "pseudonym")
    maps = known.groupBy("doc_id").agg(F.map_from_entries(F.collect_set(F.struct("pseudonym", "original"))).alias("_known"))
    put = F.zip_with(F.split("text", TOKEN, -1), hits, lambda g, h: F.concat(g, F.coalesce(F.try_element_at("_known", h), h, F.lit(""))))
    joined = some.join(maps, "doc_id", "left").withColumn("text", F.array_join(put, "")).select(*documents.columns)
    return documents.where(~holds).unionByName(joined)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def translated_questions(questions: DataFrame, vault: DataFrame) -> DataFrame:
    """(question_id, translated) of (question_id, question, persona).

    Identifiers are made canonical first. Then originals that stand in a question as whole words, in any case, become their
    pseudonyms, the longest first: identifiers for every persona, the named types for ``ENTITLED`` ones only. Originals
    of fewer than LEAST_LENGTH characters are left alone, and dates and places always, since questions share them. The
    words of a question, in runs as long as the vault's longest original, are joined with the originals' words, so no
    question is held against the whole vault. Question ids are unique; an unknown persona or a null one isn't entitled.
    """
    known = vault.where(F.length("original") >= LEAST_LENGTH).where(F.col("entity").isin(*IDENTIFIER_TYPES, *NAMED_TYPES))
    known = known.groupBy("entity", "original").agg(F.min("pseudonym").alias("pseudonym")).withColumn("_w", _words(F.col("original"))).where("size(_w) > 0")
    longest = known.agg(F.max(F.size("_w"))).first()[0] or 0
    known = known.withColumn("_key", F.array_join("_w", " ")).drop("_w")
    asked = questions.select("question_id", "persona", rewrite_identifiers(F.col("question")).alias("question"))
    words, place = F.col("_w"), F.sequence(F.lit(1), F.size("_w"))
    runs = F.flatten(F.transform(place, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("_w") - i + 1)), lambda n: F.array_join(F.slice(words, i, n), " "))))
    said = asked.withColumn("_w", _words(F.col("question"))).where("size(_w) > 0").select("question_id", "persona", "question", F.explode(F.array_distinct(runs)).alias("_key")) if longest else None
    if said is None:
        return asked.select("question_id", F.col("question").alias("translated"))
    entitled = F.col("entity").isin(*IDENTIFIER_TYPES) | F.coalesce(F.col("persona").isin(*ENTITLED), F.lit(False))
    pattern = F.concat(F.lit(r"(?iU)(?<!\w)"), F.regexp_replace("original", r"([^\w\s])", r"\\$1"), F.lit(r"(?!\w)"))
    hits = said.join(known, "_key").where(entitled).withColumn("_p", pattern).where(F.rlike(F.col("question"), F.col("_p")))
    literal = F.regexp_replace("pseudonym", r"([\\$])", r"\\$1")
    order = F.array_sort(F.collect_set(F.struct((-F.length("original")).alias("a"), F.col("original").alias("b"), literal.alias("to"), F.col("_p").alias("p"))))
    lists = hits.groupBy("question_id").agg(order.alias("_hits"))
    put = F.aggregate(F.col("_hits"), F.col("question"), lambda q, h: F.regexp_replace(q, h["p"], h["to"]))
    return asked.join(lists, "question_id", "left").select("question_id", F.when(F.col("_hits").isNull(), F.col("question")).otherwise(put).alias("translated"))


def specific_date(said: Column) -> Column:
    """Whether it names a day, or a month of a year: not a bare year, a duration or "last week"."""
    month, day = r"(?:" + "|".join(MONTHS) + r")[a-z]*\.?", r"[0-9]{1,2}(?:st|nd|rd|th)?"
    shapes = (rf"{month}\s+{day}", rf"{day}\s+{month}", rf"{month},?\s+[0-9]{{4}}", r"[0-9]{1,2}[./-][0-9]{1,2}(?:[./-](?:[0-9]{4}|[0-9]{2}))?", r"[0-9]{4}-[0-9]{2}-[0-9]{2}")
    return said.rlike(r"(?i)\b(?:" + "|".join(shapes) + r")\b")


def protecting(found: Column, text: Column, vocabulary: tuple[str, ...]) -> Column:
    """The spans of ``found`` that are worth masking: dates must be specific, and guessed names and places must hold a word
    that isn't in the domain's ``vocabulary`` (lower case), unless they have no words at all."""
    own = F.array(*[F.lit(w) for w in vocabulary]) if vocabulary else F.array().cast("array<string>")

    def worth(s: Column) -> Column:
        said = text.substr(s["start"] + 1, s["stop"] - s["start"])
        words = F.regexp_extract_all(F.lower(said), F.lit(r"[a-z][a-z_/&#]*"), F.lit(0))
        domain = (F.size(words) > 0) & F.forall(words, lambda w: F.array_contains(own, w))
        return F.when(s["type"] == "DATE_TIME", specific_date(said)).when(s["type"].isin(*GUESSED_TYPES), ~domain).otherwise(F.lit(True))

    return F.filter(found, worth)
