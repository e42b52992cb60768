"""De-identification by spans: pattern recognisers with scores, overlap resolution, masking, query translation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import canonical_identifier

LEAST_SCORE = 0.35


def spans(text: Column, patterns: dict[str, tuple[str, float]]) -> Column:
    """array<struct<type, start, stop, score>> of all matches; positions count characters from 0.

    Java's regular expressions give no positions, so they come from the lengths of what lies between the matches.
    """

    def of(kind: str, pattern: str, score: float) -> Column:
        none = F.array().cast("array<struct<type:string,start:int,stop:int,score:double>>")

        def step(acc: Column, p: Column) -> Column:
            start = acc["at"] + p["g"]
            one = F.struct(F.lit(kind).alias("type"), start.alias("start"), (start + p["h"]).alias("stop"), F.lit(score).alias("score"))
            return F.struct((start + F.coalesce(p["h"], F.lit(0))).alias("at"), F.when(p["h"].isNull(), acc["all"]).otherwise(F.concat(acc["all"], F.array(one))).alias("all"))

        def placed(hits: Column) -> Column:
            pairs = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.length).alias("g"), F.transform(hits, F.length).alias("h"))
            # a text without a match isn't split
            return F.when(F.size(hits) == 0, none).otherwise(F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("all")), step)["all"])

        return F.get(F.transform(F.array(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), placed), F.lit(0))

    return F.concat(*[of(k, p, s) for k, (p, s) in patterns.items()])


def resolve(found: Column, least: float = LEAST_SCORE) -> Column:
    """The spans that stay: highest score first, then longest, then leftmost; each disjoint from all before it."""
    keyed = F.transform(F.filter(found, lambda s: s["score"] >= least), lambda s: F.struct((-s["score"]).alias("a"), (s["start"] - s["stop"]).alias("b"), s["start"].alias("c"), s.alias("s")))
    none = F.array().cast("array<struct<type:string,start:int,stop:int,score:double>>")
    free = lambda kept, s: ~F.exists(kept, lambda k: (k["start"] < s["stop"]) & (s["start"] < k["stop"]))
    return F.aggregate(F.array_sort(keyed), none, lambda kept, x: F.when(free(kept, x["s"]), F.concat(kept, F.array(x["s"]))).otherwise(kept))


def masked(text: Column, kept: Column) -> Column:
    """The text with each span replaced by its type in angle brackets, right to left."""
    order = F.reverse(F.array_sort(F.transform(kept, lambda s: F.struct(s["start"], s["stop"], s["type"]))))
    put = lambda acc, s: F.concat(acc.substr(F.lit(1), s["start"]), F.lit("<"), s["type"], F.lit(">"), acc.substr(s["stop"] + 1, F.length(acc)))
    return F.aggregate(order, text, put)


def translated(question: Column, vault: list[tuple[str, str]], least: int = 4) -> Column:
    """A question with vault originals (longest first, whole words, any case) as pseudonyms. The vault slice is bound
    by the caller: the originals of one member or case."""
    rows = sorted((v for v in vault if len(v[0]) >= least), key=lambda v: (-len(v[0]), v[0], v[1]))
    return reduce(lambda q, v: F.regexp_replace(q, r"(?i)(?<!\w)\Q" + v[0] + r"\E(?!\w)", v[1].replace("\\", r"\\").replace("$", r"\$")), rows, question)


#: What is recognised by pattern, its score, the identifier whose check digit decides (if any), and the words
#: before it that make it likelier.
RECOGNISERS = (
    ("MEMBER_ID", r"(?i)\bM[\s-]?[0-9]{3}[\s-]?[0-9]{3}[\s-]?[0-9]{3}\b", 0.7, "member_id", ("member", "id", "subscriber", "mbr", "enrollee")),
    ("MEMBER_ID", r"\b[0-9]{9}\b", 0.3, "member_id", ("member", "id", "subscriber", "mbr", "enrollee")),
    ("MRN", r"(?i)\bMRN[\s#:-]*[0-9]{7}\b", 0.8, None, ("mrn", "record", "chart")),
    ("CLAIM_ID", r"(?i)\bCLM[\s-]?(?:[0-9]{10}|[0-9]{3}[\s-]?[0-9]{3}[\s-]?[0-9]{4})\b", 0.8, "claim_id", ("claim", "clm")),
    ("CASE_ID", r"(?i)\bAPL[\s-]?[0-9]{7}\b", 0.8, "case_id", ("appeal", "case", "grievance")),
    ("DATE_TIME", r"\b[0-9]{1,2}[./-][0-9]{1,2}[./-](?:[0-9]{4}|[0-9]{2})\b", 0.6, None, ()),
    ("DATE_TIME", r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b", 0.6, None, ()),
    ("PHONE_NUMBER", r"\(?\b[0-9]{3}\)?[\s.-]?[0-9]{3}[\s.-][0-9]{4}\b", 0.5, None, ("phone", "call", "contact", "tel", "cell", "fax", "office")),
)
#: What a word of context adds, and how many words before a span are looked at.
CONTEXT_GAIN, CONTEXT_WORDS = 0.35, 5
_BEFORE = 80  # characters that hold the words before a span


def with_context(text: Column, found: Column, context: dict[str, tuple[str, ...]]) -> Column:
    """``found`` with the scores of spans raised, to 1 at most, where one of their type's words is among the words before."""
    known = F.create_map(*[x for kind, words in context.items() for x in (F.lit(kind), F.array(*[F.lit(w) for w in words]))])

    def raised(s: Column) -> Column:
        before = F.lower(text.substr(F.greatest(s["start"] - _BEFORE, F.lit(0)) + 1, F.least(s["start"], F.lit(_BEFORE))))
        words = F.slice(F.reverse(F.regexp_extract_all(before, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))), 1, CONTEXT_WORDS)
        near = F.coalesce(F.arrays_overlap(words, F.element_at(known, s["type"])), F.lit(False))
        return F.struct(s["type"].alias("type"), s["start"].alias("start"), s["stop"].alias("stop"), F.when(near, F.least(F.lit(1.0), s["score"] + CONTEXT_GAIN)).otherwise(s["score"]).alias("score"))

    return F.transform(found, raised)


def _checked(text: Column, identifier: str):
    return lambda s: canonical_identifier(identifier, text.substr(s["start"] + 1, s["stop"] - s["start"])).isNotNull()


def _sure(s: Column) -> Column:
    return F.struct(s["type"].alias("type"), s["start"].alias("start"), s["stop"].alias("stop"), F.lit(1.0).alias("score"))


def recognised(text: Column) -> Column:
    """Spans of all recognisers: a right check digit scores 1, a wrong one drops the span, words of context raise the rest."""
    parts = []
    for kind, pattern, score, identifier, words in RECOGNISERS:
        own = spans(text, {kind: (pattern, score)})
        if identifier:
            parts.append(F.transform(F.filter(own, _checked(text, identifier)), _sure))
        else:
            parts.append(with_context(text, own, {kind: words}) if words else own)
    return F.concat(*parts)


def evaluate(documents: DataFrame, manifest: DataFrame) -> DataFrame:
    """(source, entity, n, found, leaked): type-correct recall and leakage of a manifest of planted entities.

    ``documents`` is (doc_id, source, text, spans, stored): resolved spans and the copy that is kept; ``manifest`` is
    (doc_id, entity, surface, canonical). An entity is found by a span of its type that covers its surface form, and leaks
    if its surface or canonical form survives in the stored copy. Entities of documents that aren't there count as leaked
    in nothing and found by nothing, under a null source.
    """
    planted = manifest.groupBy("doc_id").agg(F.collect_list(F.struct("entity", "surface", "canonical")).alias("planted"))
    return evaluate_listed(planted.join(documents, "doc_id", "left"))


def evaluate_listed(documents: DataFrame) -> DataFrame:
    """``evaluate`` of documents (source, text, spans, stored) that bring their entities (entity, surface, canonical) along
    in a list ``planted``: no text leaves its task."""
    said = lambda s: F.col("text").substr(s["start"] + 1, s["stop"] - s["start"])
    covered = lambda e: F.coalesce(F.exists("spans", lambda s: (s["type"] == e["entity"]) & F.contains(said(s), e["surface"])), F.lit(False))
    survives = lambda e: F.coalesce(F.contains("stored", e["surface"]) | F.contains("stored", e["canonical"]), F.lit(False))
    judged = F.transform("planted", lambda e: F.struct(e["entity"].alias("entity"), covered(e).alias("found"), survives(e).alias("leaked")))
    rows = documents.select("source", F.explode(judged).alias("e"))
    return rows.groupBy("source", F.col("e.entity").alias("entity")).agg(F.count(F.lit(1)).alias("n"), F.count_if("e.found").alias("found"), F.count_if("e.leaked").alias("leaked"))


def over_redaction(documents: DataFrame, manifest: DataFrame) -> DataFrame:
    """(source, applied, needless): replacements, and those whose text neither holds a manifest surface nor lies in one."""
    surfaces = manifest.groupBy("doc_id").agg(F.collect_set("surface").alias("_surfaces"))
    rows = documents.join(surfaces, "doc_id", "left")
    said = lambda s: F.col("text").substr(s["start"] + 1, s["stop"] - s["start"])
    protects = lambda s: F.exists(F.coalesce("_surfaces", F.array().cast("array<string>")), lambda x: F.contains(said(s), x) | F.contains(x, said(s)))
    return rows.groupBy("source").agg(F.sum(F.size("spans")).alias("applied"), F.sum(F.size(F.filter("spans", lambda s: ~protects(s)))).alias("needless"))
