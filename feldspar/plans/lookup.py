"""Queries of lookup tables, identifiers in running text, search copies, the vault and record headers.

The driver's documents hold no Markdown tables and no member identifiers. Tables are made of ``part`` (eight parts a
chunk), identifiers are put before each document's whole text by its id.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.identifiers import canonical_identifier, luhn_digit, rewrite_identifiers

from ..operators import chunking, row_identity, search_copy, vault
from . import adapters as a
from .documents import SHORT
from .registry import query

PROSE = "Removal of all burrs and sharp edges from every outer surface"
#: Part k stands in chunk k div 8, under a first cell that is a name but for some k.
PARTS = f"""parts AS (SELECT p_partkey AS k, p_partkey // 8 AS chunk_id, p_type, p_size,
  CASE WHEN (p_partkey // 8) % 7 = 3 AND p_partkey % 2 = 0 OR p_partkey % 13 = 9 THEN '{PROSE}' WHEN p_partkey % 13 = 3 THEN '2026' WHEN p_partkey % 13 = 5 THEN 'High Option' WHEN p_partkey % 13 = 7 THEN 'No'
       ELSE p_name || ' (' || p_partkey || ')' END AS cell, p_name || ' ' || p_partkey AS name FROM part),
cells AS (SELECT *, cell LIKE '%(%' AS named, cell LIKE '%(%' OR cell = '{PROSE}' AS counted FROM parts),
tables AS (SELECT chunk_id, chunk_id % 6 <> 5 AND count(*) FILTER (WHERE named) >= 2 AND count(*) FILTER (WHERE named) >= 0.7 * count(*) FILTER (WHERE counted) AS lookup FROM cells GROUP BY 1),
keys AS (SELECT chunk_id, k, name FROM cells JOIN tables USING (chunk_id) WHERE lookup AND named)"""


def part_cell() -> Column:
    k = F.col("p_partkey")
    prose = (F.floor(k / 8) % 7 == 3) & (k % 2 == 0) | (k % 13 == 9)
    return F.when(prose, PROSE).when(k % 13 == 3, "2026").when(k % 13 == 5, "High Option").when(k % 13 == 7, "No").otherwise(F.concat("p_name", F.lit(" ("), k, F.lit(")")))


def part_tables(spark, d):
    """(chunk_id, content): Markdown tables of up to eight parts; one in six has no separator row."""
    row = F.concat(F.lit("| "), part_cell(), F.lit(" | "), "p_type", F.lit(" | "), "p_size", F.lit(" |"))
    rows = a.table(spark, d, "part").select(F.floor(F.col("p_partkey") / 8).alias("chunk_id"), F.col("p_partkey").alias("k"), row.alias("row"))
    body = rows.groupBy("chunk_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("k", "row")))["row"], "\n").alias("body"))
    rule = F.when(F.col("chunk_id") % 6 == 5, "").otherwise("|---|:--|---|\n")
    return body.select("chunk_id", F.concat(F.lit("Parts list\n| Part | Type | Size |\n"), rule, "body", F.lit("\n")).alias("content"))


@query("d17_table_keys", f"WITH {PARTS} SELECT chunk_id, lower(name) AS key FROM keys")
def d17_keys(spark, d):
    """Row keys of every lookup table."""
    return row_identity.chunk_keys(part_tables(spark, d)).select("chunk_id", "key")


#: Every fifth part is asked for; its chunk and eleven others are candidates, and the reranker seats four of these.
POOL = """n AS (SELECT max(p_partkey) // 8 + 1 AS n FROM part),
pool AS (SELECT p_partkey AS question_id, (p_partkey // 8 + 7 * j) % n AS chunk_id, max(((p_partkey * 31 + j * 17) % 100) / 100.0)::DOUBLE AS score
  FROM part, n, LATERAL (SELECT unnest(range(12)) AS j) WHERE p_partkey % 5 = 0 GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY CASE WHEN chunk_id = question_id // 8 THEN 1 ELSE 0 END, score DESC, chunk_id) AS rank FROM pool)"""


@query(
    "h24_row_identity",
    f"""WITH {PARTS}, {POOL}, hits AS (SELECT q.k AS question_id, keys.chunk_id FROM keys JOIN parts q ON q.k % 5 = 0 AND keys.k = q.k),
    s AS (SELECT r.*, h.chunk_id IS NOT NULL AS by_identity FROM ranked r LEFT JOIN hits h USING (question_id, chunk_id)),
    o AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY by_identity DESC, CASE WHEN by_identity THEN -score ELSE rank END, chunk_id) AS seat FROM s WHERE by_identity OR rank <= 4)
    SELECT question_id, seat, chunk_id, score, by_identity FROM o WHERE seat <= 4""",
)
def h24(spark, d):
    """Seats of every asked question: the table that has the row first, the reranker's seats after it."""
    from pyspark.sql import Window

    part = a.table(spark, d, "part").where("p_partkey % 5 = 0")
    questions = part.select(F.col("p_partkey").alias("question_id"), F.concat(F.lit("Which size is the "), "p_name", F.lit(" ("), "p_partkey", F.lit(")?")).alias("question"))
    n = a.table(spark, d, "part").agg(F.floor(F.max("p_partkey") / 8) + 1).first()[0] or 1
    k, j = F.col("p_partkey"), F.col("j")
    pool = part.select("p_partkey", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("j")).select(k.alias("question_id"), ((F.floor(k / 8) + 7 * j) % n).alias("chunk_id"), (((k * 31 + j * 17) % 100) / 100.0).alias("score"))
    pool = pool.groupBy("question_id", "chunk_id").agg(F.max("score").alias("score"))
    fell = (F.col("chunk_id") == F.floor(F.col("question_id") / 8)).cast("int")
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(fell, F.desc("score"), "chunk_id"))
    ranked = pool.withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= 4, F.col("rank")))
    seats = row_identity.identity_seats(ranked, row_identity.row_hits(part_tables(spark, d), questions), 4)
    return seats.select("question_id", F.col("seat").cast("bigint").alias("seat"), "chunk_id", "score", "by_identity")


@query(
    "d19_rows_intact",
    f"""WITH {PARTS}, c AS (SELECT k, chunk_id, p_size::VARCHAR AS value, cell AS label, CASE WHEN k % 3 = 0 THEN 'Colour' ELSE 'Size' END AS col FROM parts)
    SELECT k AS cell_id, col <> 'Colour' AND (k % 4 <> 1) AND EXISTS (SELECT 1 FROM parts p WHERE p.chunk_id = c.chunk_id AND contains(lower('| ' || p.cell || ' | ' || p.p_type || ' | ' || p.p_size || ' |'), lower(c.label)) AND contains('| ' || p.cell || ' | ' || p.p_type || ' | ' || p.p_size || ' |', c.value)) AS intact FROM c""",
)
def d19_intact(spark, d):
    """Is the size of every part still in its row, under its column? A third asks for a column that there isn't, a
    quarter for a value that the row hasn't."""
    k = F.col("p_partkey")
    value = F.when(k % 4 == 1, F.concat(F.lit("size "), "p_size")).otherwise(F.col("p_size").cast("string"))
    cells = a.table(spark, d, "part").select(F.floor(k / 8).alias("document_id"), k.alias("cell_id"), value.alias("value"), part_cell().alias("row"), F.when(k % 3 == 0, "Colour").otherwise("Size").alias("column"))
    chunks = part_tables(spark, d).select(F.col("chunk_id").alias("document_id"), "content")
    return row_identity.rows_intact(chunks, cells).select("cell_id", "intact")


#: A document's identifiers: digits from its id with a check digit that is right but for every fifth id, in four forms.
LUHN = "list_sum(list_transform(range(1, length({0}) + 1), lambda i: CASE WHEN (length({0}) - i) % 2 = 0 THEN ({0}[i]::INT * 2) // 10 + ({0}[i]::INT * 2) % 10 ELSE {0}[i]::INT END))"
DIGITS = f"""b AS (SELECT doc_id, source, text, lpad((doc_id * 7919 % 100000000)::VARCHAR, 8, '0') AS m, lpad((doc_id * 104729 % 1000000000)::VARCHAR, 9, '0') AS c, lpad((doc_id * 31 % 1000000)::VARCHAR, 6, '0') AS p,
  lpad((doc_id * 17 % 10000000)::VARCHAR, 7, '0') AS r, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS wrong FROM documents),
  i AS (SELECT *, m || (10 - {LUHN.format('m')} % 10 + wrong) % 10 AS m9, c || (10 - {LUHN.format('c')} % 10 + wrong) % 10 AS c10, p || (10 - {LUHN.format('p')} % 10 + wrong) % 10 AS p7 FROM b)"""


def _spoken(separator: str) -> str:
    """The SQL of the text before a document's own: a member, a claim, a case and a record, parted by ``separator``."""
    s = f"'{separator}'"
    return f"'Member M' || {s} || m9[1:3] || '-' || m9[4:6] || '-' || m9[7:9] || ', clm' || {s} || c10 || '; Apl' || {s} || p7 || ' and mrn# ' || r || '. Ref M12-345. '"


CANON = "'Member ' || CASE WHEN wrong = 0 THEN 'M' || m9 ELSE 'M ' || m9[1:3] || '-' || m9[4:6] || '-' || m9[7:9] END || ', ' || CASE WHEN wrong = 0 THEN 'CLM-' || c10 ELSE 'clm ' || c10 END || '; ' || CASE WHEN wrong = 0 THEN 'APL-' || p7 ELSE 'Apl ' || p7 END || ' and MRN' || r || '. Ref M12-345. '"


def spoken(spark, d):
    """(doc_id, source, text, ...): whole texts of documents with identifiers before them, as people write them."""
    k = F.col("doc_id")
    body = {n: F.lpad((k * f % 10**w).cast("string"), w, "0") for n, f, w in (("m9", 7919, 8), ("c10", 104729, 9), ("p7", 31, 6))}
    digit = lambda b: ((luhn_digit(b).cast("int") + F.when(k % 5 == 0, 1).otherwise(0)) % 10).cast("string")
    rows = a.table(spark, d, "documents").select("doc_id", "source", "text", *[b.alias(n) for n, b in body.items()], F.lpad((k * 17 % 10**7).cast("string"), 7, "0").alias("r"))
    rows = rows.select("doc_id", "source", "text", "r", *[F.concat(n, digit(F.col(n))).alias(n) for n in body])
    grouped = F.concat(F.substring("m9", 1, 3), F.lit("-"), F.substring("m9", 4, 3), F.lit("-"), F.substring("m9", 7, 3))
    said = F.concat(F.lit("Member M "), grouped, F.lit(", clm "), "c10", F.lit("; Apl "), "p7", F.lit(" and mrn# "), "r", F.lit(". Ref M12-345. "))
    return rows.withColumn("text", F.concat(said, F.coalesce("text", F.lit(""))))


@query("d15_identifiers", f"WITH {DIGITS} SELECT doc_id, md5({CANON} || coalesce(text, '')) AS text_md5, true AS idempotent FROM i")
def d15(spark, d):
    """Every valid identifier of every whole text in canonical form; a second pass changes nothing."""
    once = spoken(spark, d).select("doc_id", rewrite_identifiers(F.col("text")).alias("text"))
    return once.select("doc_id", F.md5("text").alias("text_md5"), (rewrite_identifiers(F.col("text")) == F.col("text")).alias("idempotent"))


@query("d14_canonical", f"WITH {DIGITS} SELECT doc_id, CASE WHEN wrong = 0 THEN 'M' || m9 END AS member, CASE WHEN wrong = 0 THEN 'CLM-' || c10 END AS claim, 'MRN' || r AS record FROM i")
def d14_canonical(spark, d):
    """Surface forms by kind: a bare member number, a claim in groups, a record without a check digit."""
    claim = F.concat(F.lit("clm "), F.substring("c10", 1, 3), F.lit(" "), F.substring("c10", 4, 3), F.lit("-"), F.substring("c10", 7, 4))
    return spoken(spark, d).select("doc_id", canonical_identifier("member_id", F.col("m9")).alias("member"), canonical_identifier("claim_id", claim).alias("claim"), canonical_identifier("mrn", F.concat(F.lit("MRN: "), "r")).alias("record"))


WORDS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SHORT.items())


@query(
    "d10_search_copies",
    rf"""WITH {DIGITS}, e AS (SELECT doc_id, array_to_string(list_transform(regexp_extract_all({CANON} || coalesce(text, ''), '[A-Za-z0-9_/&]+|[^A-Za-z0-9_/&]+'), lambda w: CASE w {WORDS} ELSE w END), '') AS text FROM i),
    s AS (SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS sentence FROM (SELECT doc_id, list_filter(list_transform(string_split(replace(regexp_replace(text, '([.;!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(10), chr(1)), chr(1)), lambda s: trim(s)), lambda s: s <> '') AS l FROM e)),
    common AS (SELECT sentence FROM (SELECT DISTINCT doc_id, sentence FROM s) GROUP BY 1 HAVING count(*) > greatest(2, 0.02 * (SELECT count(*) FROM documents)))
    SELECT doc_id, md5(coalesce(string_agg(sentence, chr(10) ORDER BY pos) FILTER (WHERE sentence NOT IN (SELECT sentence FROM common)), '')) AS index_md5 FROM s GROUP BY 1""",
)
def d10_copies(spark, d):
    """The search copy of every document itself: canonical identifiers, shorthand spelt out, boilerplate gone."""
    return search_copy.search_copies(spoken(spark, d).select("doc_id", "text"), SHORT).select("doc_id", F.md5("index_text").alias("index_md5"))


@query(
    "f06_vault_extended",
    f"""WITH {DIGITS}, o AS (SELECT doc_id, 'MEMBER_ID' AS entity, 'M' || m9 AS canonical FROM i UNION ALL SELECT doc_id, 'CLAIM_ID', 'CLM-' || c10 FROM i),
    h AS (SELECT entity, sha256(entity || '|' || canonical) AS original_hash, bool_or(doc_id % 2 = 0) AS old FROM o GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY old DESC, original_hash) AS number FROM h)
    SELECT entity, original_hash, number, '[' || entity || '-' || lpad(number::VARCHAR, 6, '0') || ']' AS pseudonym FROM n""",
)
def f06_extended(spark, d):
    """A vault of the even documents, extended by all: what it knew keeps its number."""
    rows = spoken(spark, d).select("doc_id", F.explode(F.array(F.struct(F.lit("MEMBER_ID").alias("entity"), F.concat(F.lit("M"), "m9").alias("canonical")), F.struct(F.lit("CLAIM_ID").alias("entity"), F.concat(F.lit("CLM-"), "c10").alias("canonical")))).alias("o")).select("doc_id", "o.*")
    first = vault.extend(spark.createDataFrame([], vault.VAULT), rows.where("doc_id % 2 = 0"))
    return vault.extend(first, rows)


@query(
    "d16_record_headers",
    f"""WITH {DIGITS}, k AS (SELECT doc_id AS record_id, CASE WHEN doc_id % 3 = 0 THEN 'APL-' || p7 END AS cs, CASE WHEN doc_id % 4 > 0 THEN 'M' || m9 END AS me, CASE WHEN doc_id % 7 > 2 THEN 'CLM-' || c10 END AS cl, CASE WHEN doc_id % 4 = 0 AND doc_id % 3 > 0 THEN r END AS ca FROM i),
    n AS (SELECT me, row_number() OVER (ORDER BY sha256('MEMBER_ID|' || me)) AS number FROM (SELECT DISTINCT me FROM k WHERE me IS NOT NULL)),
    p AS (SELECT record_id, nullif(concat_ws('  ', 'member [MEMBER_ID-' || lpad(number::VARCHAR, 6, '0') || ']', 'call ' || ca), '') AS tok,
          nullif(concat_ws('  ', CASE WHEN cs IS NOT NULL THEN 'case [CASE_ID]' END, CASE WHEN k.me IS NOT NULL THEN 'member [MEMBER_ID]' END, CASE WHEN cl IS NOT NULL THEN 'claim [CLAIM_ID]' END, 'call ' || ca), '') AS msk,
          nullif(concat_ws('  ', 'case ' || cs, 'member ' || k.me, 'claim ' || cl, 'call ' || ca), '') AS plain FROM k LEFT JOIN n USING (me))
    SELECT record_id, coalesce('record: ' || tok, '') AS tokenised, coalesce('record: ' || msk, '') AS masked, coalesce('record: ' || plain, '') AS header FROM p""",
)
def d16(spark, d):
    """Header lines of every record in three modes; the vault knows members only, so tokenised headers name no case."""
    k = F.col("doc_id")
    rows = spoken(spark, d).select(k.alias("record_id"), F.when(k % 3 == 0, F.concat(F.lit("APL-"), "p7")).alias("case_id"), F.when(k % 4 > 0, F.concat(F.lit("M"), "m9")).alias("member_id"), F.when(k % 7 > 2, F.concat(F.lit("CLM-"), "c10")).alias("claim_id"), F.when((k % 4 == 0) & (k % 3 > 0), F.col("r")).alias("call_id"))
    known = vault.extend(spark.createDataFrame([], vault.VAULT), rows.select(F.lit("MEMBER_ID").alias("entity"), F.col("member_id").alias("canonical")))
    modes = [vault.record_headers(rows, known, m).withColumnRenamed("header", n) for m, n in (("tokenize", "tokenised"), ("mask", "masked"), ("off", "header"))]
    return modes[0].join(modes[1], "record_id").join(modes[2], "record_id")


@query(
    "d05_record_fallback",
    """WITH c AS (SELECT conv_id AS document_id, length(string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY turn)) AS n FROM conversations GROUP BY 1)
    SELECT document_id, n <= 2000 AS one_chunk FROM c""",
)
def d05_fallback(spark, d):
    """Conversations by the record profile: one chunk, or section chunks of their turns where they are too long."""
    line = F.struct(F.concat("role", F.lit(": "), "text").alias("text"), F.lit("text").alias("category"))
    turns = a.table(spark, d, "conversations").groupBy(F.col("conv_id").alias("document_id")).agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("e"))))["e"].alias("elements"))
    chunks = chunking.chunk_documents(turns, records=True)
    return chunks.groupBy("document_id").agg((F.count(F.lit(1)) == 1).alias("one_chunk"))


