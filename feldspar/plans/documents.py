"""Document transforms: elements, chunks, gates, copies, duplicates, de-identification and routing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.identifiers import luhn_valid
from ..operators import chunking
from ..operators.near import first_match, first_seen, similar_pairs
from . import adapters as a
from .registry import query

SHORT = {"a": "and", "th": "the", "is": "was", "of": "from", "la": "las"}


@query(
    "d11_sentences",
    r"""SELECT doc_id, len(list_filter(list_transform(string_split(replace(regexp_replace(text, '([.;!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(10), chr(1)), chr(1)), lambda s: trim(s)), lambda s: s <> '')) AS sentences FROM documents""",
)
def d11(spark, d):
    return a.table(spark, d, "documents").select("doc_id", F.size(tx.sentences(F.col("text"))).cast("bigint").alias("sentences"))


@query(
    "d12_boilerplate",
    r"""WITH s AS (SELECT DISTINCT doc_id, unnest(list_filter(list_transform(string_split(replace(regexp_replace(text, '([.;!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(10), chr(1)), chr(1)), lambda s: trim(s)), lambda s: s <> '')) AS sentence FROM documents)
    SELECT sentence, count(*) AS documents FROM s GROUP BY 1 HAVING count(*) > greatest(2, 0.005 * (SELECT count(*) FROM documents))""",
)
def d12(spark, d):
    return chunking.boilerplate(a.table(spark, d, "documents"), tx.sentences(F.col("text")), share=0.005)


@query(
    "d13_shorthand",
    r"""SELECT doc_id, md5(array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z0-9_/&]+|[^A-Za-z0-9_/&]+'), lambda w: CASE w """ + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SHORT.items()) + """ ELSE w END), '')) AS h
    FROM documents""",
)
def d13(spark, d):
    """Shorthand expansion over whole texts. A token of the twin is a longest run of what the look-arounds rule out."""
    return a.table(spark, d, "documents").select("doc_id", F.md5(tx.expand_shorthand(F.col("text"), SHORT)).alias("h"))


@query(
    "d05_record_chunks",
    """SELECT conv_id AS document_id, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS content, length(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) > 2000 AS falls_back
    FROM conversations GROUP BY 1""",
)
def d05(spark, d):
    """A record is one chunk, its turns in order, unless it is over the hard limit."""
    turns = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("line"))))
    whole = a.table(spark, d, "conversations").groupBy(F.col("conv_id").alias("document_id")).agg(F.array_join(turns["line"], "\n").alias("c"))
    return whole.select("document_id", F.md5("c").alias("content"), (F.length("c") > chunking.HARD).alias("falls_back"))


@query(
    "d06_gates",
    """WITH g AS (SELECT conv_id AS document_id, count(*) AS n, median(length(text)) AS median, lower(string_agg(text, chr(10))) AS body FROM conversations GROUP BY 1)
    SELECT document_id, n, median, CASE WHEN n < 2 THEN 'min_chunks' WHEN NOT median BETWEEN 100 AND 600 THEN 'median_size' WHEN NOT contains(body, 'e') OR NOT contains(body, 'on') THEN 'expected_terms' END AS failed FROM g""",
)
def d06(spark, d):
    turns = a.table(spark, d, "conversations").select(F.col("conv_id").alias("document_id"), F.col("text").alias("content"))
    return chunking.gates(turns, 2, 100, 600, ["e", "on"])


@query("d07_template_context", """SELECT doc_id, md5('This chunk is from doc-' || doc_id || CASE WHEN doc_id % 2 = 0 THEN ', section ''' || source || '''' ELSE '' END || '.' || chr(10) || chr(10) || text) AS h FROM documents""")
def d07(spark, d):
    docs = a.table(spark, d, "documents")
    section = F.when(F.col("doc_id") % 2 == 0, F.col("source"))
    return docs.select("doc_id", F.md5(tx.template_context(F.concat(F.lit("doc-"), "doc_id"), section, F.col("text"))).alias("h"))


@query(
    "d14_luhn",
    r"""WITH n AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{16}')) AS digits FROM documents),
    s AS (SELECT doc_id, digits, list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 1 THEN (CASE WHEN substr(digits, i, 1)::INT * 2 > 9 THEN substr(digits, i, 1)::INT * 2 - 9 ELSE substr(digits, i, 1)::INT * 2 END) ELSE substr(digits, i, 1)::INT END)) AS total FROM n)
    SELECT doc_id, digits, total % 10 = 0 AS valid FROM s""",
)
def d14(spark, d):
    found = a.table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9]{16}"), F.lit(0))).alias("digits"))
    return found.withColumn("valid", luhn_valid(F.col("digits")))


@query(
    "d18_question_phrases",
    """WITH w AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: true) AS w FROM benchmark),
    r AS (SELECT item_id, w[i:i + n - 1] AS r FROM w, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i), (SELECT unnest([1, 2, 3, 4]) AS n) WHERE i + n - 1 <= len(w))
    SELECT item_id, count(DISTINCT array_to_string(r, ' ')) AS phrases FROM r WHERE len(list_filter(r, lambda x: x NOT IN ('the', 'of', 'and', 'to'))) > 0 AND (len(r) > 1 OR length(r[1]) >= 3) GROUP BY 1""",
)
def d18(spark, d):
    phrases = tx.question_phrases(F.col("text"), ["the", "of", "and", "to"])
    return a.table(spark, d, "benchmark").select("item_id", F.size(phrases).cast("bigint").alias("phrases"))


@query(
    "d19_row_intact",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE contains(text, ' | '))
    SELECT doc_id, pos, len(string_split(line, ' | ')) AS cells FROM l WHERE contains(line, ' | ')""",
)
def d19(spark, d):
    """Table rows of documents, with their cells."""
    lines = a.table(spark, d, "documents").where(F.col("text").contains(" | ")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.where(F.col("line").contains(" | ")).select("doc_id", (F.col("pos") + 1).cast("bigint").alias("pos"), F.size(F.split("line", r" \| ")).cast("bigint").alias("cells"))


@query("d01_section_chunks")
def d01(spark, d):
    """Section chunks of every document's Markdown elements."""
    docs = a.table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), chunking.markdown_elements(F.coalesce("text", F.lit(""))).alias("elements"))
    return chunking.chunk_documents(docs)


@query(
    "a01_markdown_elements",
    r"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM documents),
    k AS (SELECT *, CASE WHEN line = '' THEN 'blank' WHEN line LIKE '|%' THEN 'table' WHEN line LIKE '#%' THEN 'title' WHEN regexp_matches(line, '^([-*]|[0-9]+\.) ') THEN 'list_item' ELSE 'text' END AS kind FROM l),
    s AS (SELECT *, CASE WHEN kind IN ('table', 'text') AND lag(kind) OVER (PARTITION BY doc_id ORDER BY pos) = kind THEN 0 ELSE 1 END AS starts FROM k)
    SELECT doc_id, kind AS category, sum(starts)::BIGINT AS elements FROM s WHERE kind <> 'blank' GROUP BY ALL""",
)
def a01(spark, d):
    flat = a.table(spark, d, "documents").select("doc_id", F.explode(chunking.markdown_elements(F.col("text"))).alias("e"))
    return flat.groupBy("doc_id", F.col("e.category").alias("category")).agg(F.count(F.lit(1)).alias("elements"))


PAIRS = r"""w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM w, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
    pairs AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE common >= 0.8 * (na.n + nb.n - common))"""
#: Originals in order of ids: step by step over the documents that have an earlier match.
ORIGINALS = """steps AS (SELECT b, list(a) AS before, row_number() OVER (ORDER BY b) AS i FROM pairs GROUP BY b),
    walk AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS dups UNION ALL
      SELECT w.i + 1, CASE WHEN len(list_filter(s.before, lambda x: NOT list_contains(w.dups, x))) > 0 THEN list_append(w.dups, s.b) ELSE w.dups END FROM walk w JOIN steps s ON s.i = w.i + 1),
    gone AS (SELECT unnest(dups) AS doc_id FROM walk WHERE i = (SELECT max(i) FROM walk))"""


@query("e01_exact_jaccard", f"WITH {PAIRS} SELECT b AS doc_id, min(a) AS first_match FROM pairs GROUP BY 1")
def e01(spark, d):
    """For each document the smallest earlier one with Jaccard similarity 0.8 or more over three-word shingles."""
    return first_match(*similar_pairs(a.table(spark, d, "documents")))


@query("e02_first_seen", f"WITH RECURSIVE {PAIRS}, {ORIGINALS} SELECT b AS doc_id, min(a) AS duplicate_of FROM pairs WHERE b IN (SELECT doc_id FROM gone) AND a NOT IN (SELECT doc_id FROM gone) GROUP BY 1")
def e02(spark, d):
    """Duplicates and the original each points to: a duplicate is never matched itself."""
    return first_seen(*similar_pairs(a.table(spark, d, "documents")))


@query("e04_originals_only", f"WITH RECURSIVE {PAIRS}, {ORIGINALS} SELECT source, count(*) AS documents, count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM gone)) AS searchable FROM documents GROUP BY 1")
def e04(spark, d):
    """Duplicates keep their row and have no chunks."""
    docs = a.table(spark, d, "documents").select("doc_id", "source", "text")
    gone = first_seen(*similar_pairs(docs)).select("doc_id", F.lit(1).alias("_gone"))
    return docs.select("doc_id", "source").join(gone, "doc_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("_gone").isNull()).alias("searchable"))


@query(
    "p05_as_of",
    r"""WITH q AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'covered on ' || strftime(ts, '%Y-%m-%d') || ' or not' WHEN 1 THEN 'as of ' || month(ts) || '/' || day(ts) || '/' || (year(ts) % 100)
       WHEN 2 THEN 'on ' || strftime(ts, '%B') || ' ' || day(ts) || ', ' || year(ts) ELSE 'no date here' END AS question, ts FROM events)
    SELECT event_id, CASE WHEN event_id % 4 < 3 THEN ts::DATE END AS as_of FROM q""",
)
def p05(spark, d):
    e = a.table(spark, d, "events")
    q = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("covered on "), F.date_format("ts", "yyyy-MM-dd"), F.lit(" or not"))).when(F.col("event_id") % 4 == 1, F.concat(F.lit("as of "), F.date_format("ts", "M/d/yy"))).when(F.col("event_id") % 4 == 2, F.concat(F.lit("on "), F.date_format("ts", "MMMM d, yyyy"))).otherwise("no date here")
    return e.select("event_id", tx.as_of_date(q).alias("as_of"))


@query(
    "p03_routed_years",
    """WITH q AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN [2024] WHEN 1 THEN [2023, 2025] WHEN 2 THEN [2019] ELSE []::INTEGER[] END AS said, event_id % 2 = 0 AS change FROM events)
    SELECT event_id, array_to_string(CASE WHEN said = [2019] THEN []::INTEGER[] WHEN said = [2024] AND change THEN [2023, 2024] WHEN len(said) > 0 THEN said WHEN change THEN [2025, 2026] ELSE [2026] END, ',') AS years FROM q""",
)
def p03(spark, d):
    e = a.table(spark, d, "events")
    q = F.when(F.col("event_id") % 5 == 0, "what about 2024").when(F.col("event_id") % 5 == 1, "2025 against 2023").when(F.col("event_id") % 5 == 2, "in 2019").otherwise("now")
    years = tx.routed_years(tx.years_said(q), F.col("event_id") % 2 == 0)
    return e.select("event_id", F.array_join(years.cast("array<string>"), ",").alias("years"))


@query(
    "f06_vault",
    """WITH e AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[0-9]{16}')) AS original FROM documents)
    SELECT sha256('CARD|' || original) AS original_hash, '[CARD-' || lpad(row_number() OVER (ORDER BY original)::VARCHAR, 6, '0') || ']' AS pseudonym FROM e""",
)
def f06(spark, d):
    """Vault pseudonyms numbered by type in order of the original: sorted by range, plus the rows of the ranges before."""
    from ..operators.ranks import numbered

    found = a.table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[0-9]{16}"), F.lit(0))).alias("original")).distinct()
    return numbered(found, "original").select(F.sha2(F.concat(F.lit("CARD|"), "original"), 256).alias("original_hash"), F.concat(F.lit("[CARD-"), F.lpad(F.col("number").cast("string"), 6, "0"), F.lit("]")).alias("pseudonym"))


@query(
    "f09_leakage",
    """WITH e AS (SELECT doc_id, source, unnest(regexp_extract_all(text, '[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}')) AS v FROM documents)
    SELECT source, count(*) AS entities, count(*) FILTER (WHERE contains(replace(text, 'the', ''), v)) AS leaked FROM e JOIN documents USING (doc_id, source) GROUP BY 1""",
)
def f09(spark, d):
    """Entities of a manifest that survive in their own document's stored copy, by source."""
    docs = a.table(spark, d, "documents")
    found = docs.select("doc_id", "source", F.replace("text", F.lit("the"), F.lit("")).alias("stored"), F.explode(F.regexp_extract_all("text", F.lit(r"[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}"), F.lit(0))).alias("v"))
    return found.groupBy("source").agg(F.count(F.lit(1)).alias("entities"), F.count_if(F.col("stored").contains(F.col("v"))).alias("leaked"))


@query("a04_html_blocks", r"""SELECT page_id, len(regexp_extract_all(html, '(?is)<p[^>]*>')) AS paragraphs, len(regexp_extract_all(html, '(?is)<a [^>]*>')) AS links FROM pages""")
def a04(spark, d):
    """The HTML document format's block counts; table conversion is ``functions.text.html_table_to_markdown``."""
    count = lambda p: F.size(F.regexp_extract_all("html", F.lit(p), F.lit(0))).cast("bigint")
    return a.table(spark, d, "pages").select("page_id", count("(?is)<p[^>]*>").alias("paragraphs"), count("(?is)<a [^>]*>").alias("links"))
