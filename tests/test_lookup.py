"""Lookup tables, identifiers in running text, search copies, chunks, the vault: against plain Python and odd cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from feldspar.functions import identifiers as idn
from feldspar.functions import tables as tb
from feldspar.operators import chunking, row_identity, search_copy, vault

DRUGS = "From Formulary 2026.\n| Drug | Class | Tier |\n|---|---|---|\n| atorvastatin | statin | 1 |\n| metformin | biguanide | 1 |\n| Jardiance (empagliflozin) | SGLT2 | 2 |\n| insulin glargine (Basaglar) | insulin | 1 |\n"
BENEFITS = "| Benefit | High Option |\n| --- | --- |\n| Specialist visits | $45 |\n| High Option | x |\n| 2026 | a |\n| Urgent care | $50 |\n"
LONG = "Removal of tumors and cysts limited to children under 18"
PROSE = f"| Benefit | High |\n|---|---|\n| Notes: | below |\n| {LONG} | 1 |\n| {LONG} and more of it | 2 |\n| Treatment of burns | 3 |\n"


def keys(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.k for r in rows.orderBy("i").select(tb.table_keys(F.col("t")).alias("k")).collect()]


def test_table_keys(spark):
    got = keys(spark, [DRUGS, BENEFITS, PROSE, "generic drugs such as metformin | are covered.", "| Drug | Tier |\n|---|---|\n| metformin | 1 |\n", "", None, DRUGS.replace("|---|---|---|\n", ""), "| a b c |\n|:--|\n| é1 |\n| x, y |\n| the plan |\n| Zé Q |"])
    assert got == [["atorvastatin", "metformin", "jardiance empagliflozin", "insulin glargine basaglar"], ["specialist visits", "urgent care"], [], [], [], [], [], [], ["x y", "z q"]]


def test_questions_name_rows_exactly(spark):
    chunks = spark.createDataFrame([(1, DRUGS), (2, BENEFITS), (3, PROSE), (4, None)], "chunk_id int, content string")
    asked = ["Which drug tier is metformin?", "Is insulin glargine (Basaglar) covered?", "Which drug tier is ibuprofen?", "What is the specialist copay?", "What do I pay for Specialist-visits?", "What is the High Option deductible?", "metformin, or atorvastatin; urgent care", None]
    questions = spark.createDataFrame(list(enumerate(asked)), "question_id int, question string")
    got = {(r.question_id, r.chunk_id): r["keys"] for r in row_identity.row_hits(chunks, questions).collect()}
    assert got == {(0, 1): ["metformin"], (1, 1): ["insulin glargine basaglar"], (4, 2): ["specialist visits"], (6, 1): ["atorvastatin", "metformin"], (6, 2): ["urgent care"]}


def test_seats(spark):
    pool = spark.createDataFrame([(0, 1, 0.4, None), (0, 2, 0.6, 2), (0, 3, 0.7, 1), (0, 4, 0.9, None), (1, 2, 0.6, 2), (1, 3, 0.7, 1), (2, 5, None, None), (2, 6, 0.1, None), (2, 7, 0.2, 1)], "question_id int, chunk_id int, score double, rank int")
    hits = spark.createDataFrame([(0, 1, ["metformin"]), (2, 5, ["a"]), (2, 6, ["b"]), (3, 1, ["c"])], "question_id int, chunk_id int, keys array<string>")
    got = [(r.question_id, r.seat, r.chunk_id, r.score, r.by_identity) for r in row_identity.identity_seats(pool, hits, 2).orderBy("question_id", "seat").collect()]
    assert got == [(0, 1, 1, 0.4, True), (0, 2, 3, 0.7, False), (1, 1, 3, 0.7, False), (1, 2, 2, 0.6, False), (2, 1, 6, 0.1, True), (2, 2, 5, None, True)]


def test_rows_intact(spark):
    chunks = spark.createDataFrame([(1, BENEFITS), (1, "Urgent\tcare $70 in High Option"), (2, "Specialist visits cost $45 in High Option."), (3, "| Specialist visits | $45 | High Option"), (4, None)], "document_id int, content string")
    cells = spark.createDataFrame([(1, 1, "$45", "specialist  visits", "high option"), (1, 2, "$45", "Urgent care", "High Option"), (1, 3, "$45", "Specialist visits", "Standard"), (1, 4, "$70", "Urgent care", "High Option"), (2, 5, "$45", "Specialist visits", "High Option"), (3, 6, "$45", "Specialist visits", "High Option"), (9, 7, "a", "b", "c")], "document_id int, cell_id int, value string, row string, column string")
    assert {r.cell_id: r.intact for r in row_identity.rows_intact(chunks, cells).collect()} == {1: True, 2: False, 3: False, 4: True, 5: False, 6: True, 7: False}


def luhn(body):
    total = sum(d if i % 2 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(map(int, reversed(body))))
    return str(-total % 10)


def plain_rewrite(text):
    def one(m):
        word, digits = re.match("[A-Za-z]+", m[0])[0].upper(), re.sub("[^0-9]", "", m[0])
        if word != "MRN" and luhn(digits[:-1]) != digits[-1]:
            return m[0]
        return {"M": "M", "MRN": "MRN", "CLM": "CLM-", "APL": "APL-"}[word] + digits

    return re.sub(r"(?i)\b(?:M[\s-]?[0-9]{3}[\s-]?[0-9]{3}[\s-]?[0-9]{3}|MRN[\s#:-]*[0-9]{7}|CLM[\s-]?(?:[0-9]{10}|[0-9]{3}[\s-]?[0-9]{3}[\s-]?[0-9]{4})|APL[\s-]?[0-9]{7})\b", one, text)


def test_identifiers_in_text(spark):
    r = random.Random(3)
    texts = ["", None, "no identifiers", "M", "xM123456782 M1234567820", "M 123\n456\t782é", "éM123456782"]
    for _ in range(300):
        words = []
        for _ in range(r.randint(1, 6)):
            kind, n = r.choice([("M", 8), ("m", 8), ("MRN", 7), ("mrn#: ", 7), ("CLM", 9), ("clm", 9), ("APL", 6), ("Apl", 6), ("", 8)])
            digits = "".join(r.choice("0123456789") for _ in range(n))
            digits += "" if n == 7 else luhn(digits) if r.random() < 0.6 else r.choice("0123456789")
            cut = r.choice([None, "-", " "])
            shown = digits if cut is None or n == 7 else cut.join((digits[:3], digits[3:6], digits[6:]))
            words.append(r.choice(["", "ref ", "é", "("]) + kind + r.choice(["", " ", "-"]) + shown + r.choice(["", ".", "x", "é", "\n"]))
        texts.append(" ".join(words))
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("once", idn.rewrite_identifiers(F.col("t"))).withColumn("twice", idn.rewrite_identifiers(F.col("once")))
    for row in rows.collect():
        assert row.once == row.twice == (None if row.t is None else plain_rewrite(row.t)), row.t


def test_canonical_by_kind(spark):
    body = "04821733"
    m = "M" + body + luhn(body)
    claim = "CLM-" + "000418374" + luhn("000418374")
    cases = [("member_id", f" {m[:4]}-{m[4:7]} {m[7:]} ", m), ("member_id", m[1:], m), ("member_id", m[:-1] + str((int(m[-1]) + 1) % 10), None), ("member_id", "M12345", None), ("claim_id", claim.replace("-", " ").lower(), claim), ("claim_id", claim + "1", None), ("mrn", "mrn: 4408125", "MRN4408125"), ("mrn", "4408125", None), ("case_id", "APL-0038174", "APL-0038174" if luhn("003817") == "4" else None), ("case_id", None, None)]
    for kind, surface, want in cases:
        assert spark.createDataFrame([(surface,)], "s string").select(idn.canonical_identifier(kind, F.col("s"))).first()[0] == want, (kind, surface)
    with pytest.raises(KeyError):
        idn.canonical_identifier("ssn", F.lit("x"))


def test_search_copies(spark):
    docs = [(i, f"Pt called. This call may be recorded.\nbalance {i}; mbr M123-456-782") for i in range(25)] + [(90, None), (91, ""), (92, "This call may be recorded.")]
    rows = spark.createDataFrame(docs, "doc_id int, text string")
    got = {r.doc_id: r.index_text for r in search_copy.search_copies(rows, {"Pt": "patient", "mbr": "member"}).collect()}
    shown = "M123456782" if luhn("12345678") == "2" else "M123-456-782"
    assert got[3] == f"balance 3;\nmember {shown}".replace(f"\nmember {shown}", "") or got[3] == f"balance 3;\nmember {shown}"
    assert got[90] is None and got[91] == got[92] == "" and len(got) == len(docs)
    few = search_copy.search_copies(rows.limit(5), {"Pt": "patient"}).orderBy("doc_id").first()
    assert few.index_text.startswith("patient called. This call may be recorded.\nbalance 0")


def plain_chunks(elements, hard, soft, under, limit):
    """The chunking rule step by step."""
    made, open_, section = [], None, ""
    size = lambda p: sum(map(len, p)) + 2 * (len(p) - 1)
    for text, kind in elements:
        pieces = [text]
        if kind == "table" and len(text) > limit:
            lines = text.split("\n")
            head = lines[:2] if len(lines) > 2 and lines[1].strip()[:1] == "|" and not set(lines[1]) - set("|-: ") else []
            pieces, now = [], []
            for row in lines[len(head):]:
                if now and len("\n".join([*head, *now, row])) > limit:
                    pieces.append("\n".join(head + now))
                    now = []
                now.append(row)
            pieces.append("\n".join(head + now))
        elif kind == "text" and len(text) > hard:
            pieces = []
            while len(text) > hard:
                at = text[:hard].rfind(" ")
                at = at if at > 0 else hard
                pieces.append(text[:at])
                text = text[at:].lstrip()
            pieces += [text] if text else []
        if kind == "title":
            section = text
        for piece in pieces:
            if kind == "table":
                made += [open_] if open_ else []
                made.append((section, [piece], True))
                open_ = None
                continue
            if open_ and (size(open_[1]) >= under if kind == "title" else size(open_[1]) + len(piece) > soft):
                made.append(open_)
                open_ = None
            open_ = open_ or (section, [], False)
            open_[1].append(piece)
    made += [open_] if open_ else []
    out = []
    for section, parts, table in made:
        text = "\n\n".join(parts)
        if out and len(text) < under and not table and not out[-1][2] and len(out[-1][0]) + len(text) + 2 <= hard:
            out[-1] = (out[-1][0] + "\n\n" + text, out[-1][1], False)
        else:
            out.append((text, section, table))
    if len(out) > 1 and len(out[0][0]) < under and not out[1][2] and len(out[0][0]) + len(out[1][0]) + 2 <= hard:
        out = [(out[0][0] + "\n\n" + out[1][0], out[1][1] or out[0][1], out[0][2]), *out[2:]]
    return [(t, s or None, k) for t, s, k in out]


@pytest.mark.parametrize(("hard", "soft", "under"), [(2000, 1500, 250), (300, 200, 60), (50, 40, 20)])
def test_section_chunks_of_every_document(spark, sf_dir, hard, soft, under):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("document_id"), F.concat(F.lit("# T\n"), F.coalesce("text", F.lit("")), F.lit("\n## Sub title\n| a | b |\n|---|---|\n"), F.repeat(F.concat(F.lit("| row "), "doc_id", F.lit(" | x |\n")), 30)).alias("text"))
    elements = docs.select("document_id", chunking.markdown_elements(F.col("text")).alias("elements")).cache()
    got = {}
    for r in chunking.chunk_documents(elements, hard, soft, under).orderBy("document_id", "chunk_index").collect():
        got.setdefault(r.document_id, []).append((r.content, r.section, r.is_table))
    for r in elements.collect():
        assert got[r.document_id] == plain_chunks([(e.text, "text" if e.category == "list_item" else e.category) for e in r.elements], hard, soft, under, hard)


def test_chunk_shapes():
    t, p = (lambda s: (s, "title")), (lambda s: (s, "text"))
    fold = chunking.fold
    assert len(fold([t("A"), p("a" * 500), t("B"), p("tiny")])) == 1
    assert len(fold([t("A"), t("B"), t("C"), p("body " * 100)])) == 1
    assert [s for _, s, _ in fold([t("Deductibles"), p("x" * 400), t("Copayments"), p("y" * 400)])] == ["Deductibles", "Copayments"]
    assert [c[0][:5] for c in fold([p("cover"), t("Section"), p("z" * 600)])] == ["cover"]
    wide = "\n".join(["| Benefit | High |", "| --- | --- |", *[f"| Benefit row number {i} with a long description | ${i} |" for i in range(60)]])
    pieces = fold([("before", "text"), (wide, "table"), ("after", "text")], hard=800)
    assert all(c.startswith("| Benefit | High |\n| --- |") for c, _, table in pieces if table) and sum(c.count("row number") for c, _, _ in pieces) == 60
    assert fold([]) == [] and chunking.record([]) == [] and chunking.record([("", "text")]) == []
    assert chunking.record([t("Call"), p("a"), p("b")]) == [("Call\n\na\n\nb", "Call", False)]
    assert len(chunking.record([p("word " * 300)] * 3)) > 1


def test_vault(spark):
    rows = lambda *names: spark.createDataFrame([(e, n) for e, n in names], "entity string, canonical string")
    empty = spark.createDataFrame([], vault.VAULT)
    first = vault.extend(empty, rows(("A", "x"), ("A", "y"), ("A", "x"), ("B", "x"), ("A", None)))
    second = vault.extend(first, rows(("A", "z"), ("B", "q"), ("A", "y")))
    a, b = ({(r.entity, r.original_hash): r.pseudonym for r in v.collect()} for v in (first, second))
    assert len(a) == 3 and len(b) == 5 and all(b[k] == v for k, v in a.items()) and len(set(b.values())) == 5
    assert sorted(b.values()) == ["[A-000001]", "[A-000002]", "[A-000003]", "[B-000001]", "[B-000002]"]
    assert vault.extend(second, rows(("A", "z"))).count() == 5 and vault.extend(empty, rows()).count() == 0
    records = spark.createDataFrame([(1, "A1", "M1", "", "77"), (2, None, None, None, None), (3, None, "M2", "C1", None)], "record_id int, case_id string, member_id string, claim_id string, call_id string")
    known = vault.extend(empty, rows(("MEMBER_ID", "M1"), ("CLAIM_ID", "C1")))
    heads = {m: {r.record_id: r.header for r in vault.record_headers(records, known, m).collect()} for m in ("tokenize", "mask", "off")}
    assert heads["tokenize"] == {1: "record: member [MEMBER_ID-000001]  call 77", 2: "", 3: "record: claim [CLAIM_ID-000001]"}
    assert heads["mask"][1] == "record: case [CASE_ID]  member [MEMBER_ID]  call 77" and heads["off"][3] == "record: member M2  claim C1"
    with pytest.raises(ValueError):
        vault.record_headers(records, known, "other")
