"""Operators on small written-out fixtures."""

import re

import pytest
from pyspark.sql import functions as F

from feldspar.functions import text as tx
from feldspar.functions.identifiers import luhn_digit, luhn_valid
from feldspar.operators import chunking, governance, ingest, search


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_sections_never_exceed_the_hard_limit():
    elements = [("Title", "title"), ("word " * 900, "text"), ("short", "text"), ("| a | b |\n| --- | --- |\n" + "\n".join(f"| {i} | {'x' * 50} |" for i in range(80)), "table"), ("end", "text")]
    chunks = chunking.fold(elements)
    assert all(len(t) <= chunking.HARD for t, _, table in chunks if not table)
    tables = [t for t, _, table in chunks if table]
    assert len(tables) > 1 and all(t.startswith("| a | b |\n| --- | --- |\n") for t in tables)
    assert sum(t.count("\n") - 1 for t in tables) == 80
    assert chunking.fold([]) == [] and chunking.fold([("x" * 5000, "text")])[0][0] == "x" * 2000


def test_a_long_row_is_kept_whole():
    table = "| h |\n| --- |\n| " + "y" * 3000 + " |\n| z |"
    assert any("y" * 3000 in t for t in chunking.split_table(table, 2000))


def test_small_chunks_merge():
    assert chunking.merge_small([("a" * 100, None, False), ("b" * 500, None, False)], 2000, 250) == [("a" * 100 + "\n\n" + "b" * 500, None, False)]
    kept = [("a" * 100, None, False), ("| t |", None, True)]
    assert chunking.merge_small(kept, 2000, 250) == kept


def test_markdown_elements(spark):
    text = "# Head\n\nline one\nline two\n- item\n1. first\n| a |\n| b |\n\nend"
    got = [(e.text, e.category) for e in one(spark, chunking.markdown_elements(F.col("t")), t=text)]
    assert got == [("Head", "title"), ("line one line two", "text"), ("item", "list_item"), ("first", "list_item"), ("| a |\n| b |", "table"), ("end", "text")]


def test_html_table(spark):
    html = "<table><tr><th>A</th><th>B|C</th></tr><tr><td>1 <b>x</b></td></tr></table>"
    assert one(spark, tx.html_table_to_markdown(F.col("h")), h=html) == "| A | B/C |\n| --- | --- |\n| 1 x |  |"


def test_shorthand_is_whole_token_and_idempotent(spark):
    words = {"mbr": "member", "mbr svc": "member services", "c/o": "care of"}
    e = tx.expand_shorthand(F.col("t"), words)
    once = one(spark, e, t="mbr svc c/o mbr, mbrx xmbr mbr/x")
    assert once == "member services care of member, mbrx xmbr mbr/x" and one(spark, e, t=once) == once


@pytest.mark.parametrize(("text", "want"), [("on 2024-03-05 ok", "2024-03-05"), ("as of 3/5/24", "2024-03-05"), ("as of 3/5/2024.", "2024-03-05"), ("March 5, 2024", "2024-03-05"), ("none", None), ("2024-13-45", None)])
def test_as_of(spark, text, want):
    got = one(spark, tx.as_of_date(F.col("t")), t=text)
    assert (str(got) if got else None) == want


def test_luhn(spark):
    assert one(spark, luhn_digit(F.col("d")), d="7992739871") == "3"
    assert one(spark, luhn_valid(F.col("d")), d="79927398713") and not one(spark, luhn_valid(F.col("d")), d="79927398710")


def test_fusion_scores(spark):
    vec = spark.createDataFrame([(0, i, "s", i) for i in (1, 2, 3)], "query_id int, chunk_id int, doc_type string, vrank int")
    txt = spark.createDataFrame([(0, 3, "s", 1)], "query_id int, chunk_id int, doc_type string, trank int")
    got = {r.chunk_id: r.rrf for r in search.fuse(vec, txt, ["doc_type"]).collect()}
    assert got[1] == round(1 / 61, 6) and got[3] == round(1 / 63 + 1 / 61, 6) and max(got, key=got.get) == 3


def test_governance_is_closed(spark):
    df = spark.createDataFrame([(1, "FEHB")], "member_id int, line_of_business string")
    assert governance.secured("patients", df, governance.Principal("NOBODY")).count() == 0
    with pytest.raises(PermissionError):
        governance.secured("lob_entitlements", df, governance.Principal("ACTUARY"))
    with pytest.raises(KeyError):
        _ = governance.Principal("nobody").tiers
    assert governance.masked_columns(governance.Principal("ACTUARY"), ["ssn", "plan_code"]) == ["ssn"]


def test_declared_csv(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Id,Extra,Amount\n1,x,2.5\n2,y,\n")
    got = ingest.read_declared_csv(spark, str(tmp_path), {"id": "bigint", "amount": "double", "city": "string"}).collect()
    assert [tuple(r) for r in got] == [(1, 2.5, None), (2, None, None)]


def test_streaming(spark, sf_dir, tmp_path):
    from feldspar.streaming import jobs

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    seen = []
    jobs.ingest_stream(jobs.read_files(spark, str(tmp_path / "in"), events.schema, 1), lambda df, i: seen.append(df.count()), str(tmp_path / "cp"))
    assert sum(seen) == events.count() and len(seen) == 3
    jobs.ingest_stream(jobs.read_files(spark, str(tmp_path / "in"), events.schema), lambda df, i: seen.append(df.count()), str(tmp_path / "cp"))
    assert sum(seen) == events.count()
    counts = jobs.windowed_counts(jobs.read_files(spark, str(tmp_path / "in"), events.schema), "ts", "event_type", "6 hours", "1 hour")
    q = counts.writeStream.format("memory").queryName("counted").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("counted").agg(F.sum("n")).first()[0] == events.count()


def test_spans_resolve_by_score_then_length(spark):
    from feldspar.operators import deid

    text = "card 4539148803436467 at 10.1.2.3 no 77"
    found = deid.spans(F.col("t"), {"CARD": ("[0-9]{16}", 0.8), "IP": (r"[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+", 0.6), "NUM": ("[0-9]{4,}", 0.5), "LOW": ("[0-9]+", 0.2)})
    got = one(spark, deid.resolve(found), t=text)
    assert [(s.type, text[s.start : s.stop]) for s in got] == [("CARD", "4539148803436467"), ("IP", "10.1.2.3")]
    assert one(spark, deid.masked(F.col("t"), deid.resolve(found)), t=text) == "card <CARD> at <IP> no 77"
    assert one(spark, deid.translated(F.col("t"), [("Ann Lee", "[P-2]"), ("Ann Lee Roy", "[P-1]"), ("Lee", "[P-3]")]), t="ann lee roy and Ann Lee, Leeds") == "[P-1] and [P-2], Leeds"


def test_disclosure_is_written_before_it_is_returned(spark, tmp_path):
    from feldspar.operators import payload

    ranked = spark.createDataFrame([(0, 7, 1, 0.9, "public", "h7", "doc-7"), (0, 8, 2, 0.8, "employee", "h8", "doc-8"), (1, 9, 1, 0.1, "public", "h9", "doc-9")], "query_id int, chunk_id int, rank int, score double, acl_tag string, content_hash string, title string")
    built = payload.build(ranked, search.abstain(ranked, F.lit(0.7)))
    out = {r.query_id: r for r in payload.disclose(built, ranked, "employee", str(tmp_path / "log")).collect()}
    assert out[0].status == "ok" and out[1].status == "insufficient_evidence" and '"chunks":[]' in out[1].payload
    log = spark.read.parquet(str(tmp_path / "log"))
    row = log.where("query_id = 0").first()
    assert row.chunk_ids == [7, 8] and row.content_hashes == ["h7", "h8"]
    assert payload.lineage(log, title_like="DOC-8").count() == 1 and payload.lineage(log, persona="admin").count() == 0
    (tmp_path / "file").write_text("x")
    with pytest.raises(Exception):  # noqa: B017
        payload.disclose(built, ranked, "employee", str(tmp_path / "file"))


def test_worst_of_required(spark):
    from feldspar.operators import payload

    legs = spark.createDataFrame([(1, "a", "doc_probe", True, "ok", 0.9), (1, "b", "doc_probe", True, "insufficient_evidence", 0.2), (2, "a", "member_query", True, "ok", None), (2, "b", "doc_probe", False, "not_executed", 0.4)], "plan_id int, leg string, kind string, required boolean, status string, confidence double")
    got = {r.plan_id: tuple(r) for r in payload.compose(legs).collect()}
    assert got == {1: (1, "insufficient_evidence", 0.2, "b"), 2: (2, "ok", 0.4, "b")}


def test_upserts(spark):
    old = spark.createDataFrame([(1, "model"), (2, "rule")], "id int, origin string")
    new = spark.createDataFrame([(1, "new"), (2, "new"), (3, "new"), (3, "newer")], "id int, origin string")
    assert sorted(map(tuple, ingest.insert_if_absent(old, new, ["id"]).collect())) == [(3, "new")]
    assert sorted(map(tuple, ingest.upsert_unless(old, new.where("origin = 'new'"), ["id"], "origin = 'model'").collect())) == [(1, "model"), (2, "new"), (3, "new")]


def test_all_legs_are_composed(spark, tmp_path):
    from feldspar.plans import registry

    rows = [(i, i // 4, 0.5 + i % 7 / 10) for i in (0, 1, 2, 3, 1999, 2000, 2004, 2007, 90_007, 90_004)]
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.plan_id: r for r in registry.queries()["r02_compose"](spark, str(tmp_path)).collect()}
    assert set(got) == {u for _, u, _ in rows}
    # 90,004 is a required leg without evidence, 90,007 an optional one that wasn't run
    assert (got[22_501].status, got[22_501].missing) == ("insufficient_evidence", "leg0,leg3") and got[501].missing == "leg3"


def test_shorthand_reaches_every_document(spark, tmp_path):
    import hashlib

    from feldspar.plans import documents, registry

    part = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_/&")

    def brute(text):
        out, at = "", 0
        while at < len(text):
            end = at
            while end < len(text) and (text[end] in part) == (text[at] in part):
                end += 1
            out += documents.SHORT.get(text[at:end], text[at:end])
            at = end
        return out

    texts = ["a th", "of 3 is", "la\nla\tis", "été a àla éa", "a/th th&of a-th x_a a_", "(is) of, th. A TH", "", "a", "a\u00a0th\U0001f600of", "  of  ", "ath isof la1 1la", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.h for r in registry.queries()["d13_shorthand"](spark, str(tmp_path)).collect()}
    assert brute("a-th (is) a/th") == "and-the (was) a/th"
    assert got == {i: None if t is None else hashlib.md5(brute(t).encode()).hexdigest() for i, t in enumerate(texts)}


def test_the_query_set_is_every_twentieth_row(spark, sf_dir, tmp_path):
    from feldspar.plans import registry, retrieval

    ids = {i for i in range(500) if i % 20 == 0}
    assert {r.query_id for r in registry.queries()["h01_vector_topk"](spark, sf_dir).select("query_id").distinct().collect()} == ids
    vec, txt = retrieval._arms(spark, sf_dir)
    assert {r.query_id for r in vec.select("query_id").distinct().collect()} == ids
    first = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 20 = 0").collect()}
    terms = retrieval.question_terms(spark, sf_dir, retrieval.query_vectors(spark, sf_dir)).collect()
    assert {(r.query_id, r.term) for r in terms} == {(i, w) for i, t in first.items() for w in re.findall("[a-z0-9]+", t.lower())[:8]}
    assert {r.query_id for r in txt.select("query_id").distinct().collect()} == {r.query_id for r in terms}


def test_blocks_meet_every_query_and_chunk_once(spark, monkeypatch):
    rows = [(i, "s" + str(i % 3), [float((i * k) % 7 - 3) + 0.1 for k in range(1, 5)]) for i in range(60)]
    chunks = spark.createDataFrame(rows, "chunk_id bigint, doc_type string, vector array<float>")
    queries = chunks.where("chunk_id % 4 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    for by in ([], ["doc_type"]):
        want = sorted(map(tuple, search.vector_arm(chunks, queries, by, 10).collect()))
        monkeypatch.setattr(search, "QUERY_BLOCK", 4)
        monkeypatch.setattr(search, "CHUNK_BLOCK", 8)
        monkeypatch.setattr(search, "QUERY_TILE", 3)
        for streamed in (64, 0):
            monkeypatch.setattr(search, "STREAMED_BLOCKS", streamed)
            assert sorted(map(tuple, search.vector_arm(chunks, queries, by, 10).collect())) == want
        assert len(want) == 15 * 10 * (3 if by else 1)
        monkeypatch.undo()


def test_near_duplicates_of_many_copies_match_a_plain_loop(spark):
    import random

    from feldspar.operators.near import first_match, first_seen, similar_pairs

    r = random.Random(3)
    base = [[f"w{r.randrange(400)}" for _ in range(40)] for _ in range(6)]
    texts = [None, "", "two words"]
    for i in range(90):
        words = list(base[i % 6])
        for _ in range(r.choice([0, 0, 1, 2, 3])):
            words[r.randrange(40)] = f"x{r.randrange(9)}"
        texts.append(" ".join(words))
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in ((t or "").split() for t in texts)]
    alike = lambda a, b: bool(sets[a] and sets[b]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    match, of, originals = {}, {}, []
    for d in range(len(texts)):
        if earlier := [a for a in range(d) if alike(a, d)]:
            match[d] = earlier[0]
        if earlier := [a for a in originals if alike(a, d)]:
            of[d] = earlier[0]
        else:
            originals.append(d)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert dict(map(tuple, first_match(*similar_pairs(docs)).collect())) == match
    assert dict(map(tuple, first_seen(*similar_pairs(docs)).collect())) == of
    assert first_seen(*similar_pairs(docs.limit(0))).count() == 0


def test_vectors_like_nothing_are_not_ranked(spark, monkeypatch):
    rows = [(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [2.0, 0.0]), (6, [0.0, 1.0])]
    chunks = spark.createDataFrame(rows, "chunk_id bigint, vector array<float>")
    queries = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(3)], "query_id bigint, vector array<float>")
    want = sorted((q, c, s, k) for q in range(3) for k, (c, s) in enumerate([(1, 1.0), (5, 1.0)], 1))
    for block, streamed in ((256, 64), (2, 64), (2, 0)):
        monkeypatch.setattr(search, "QUERY_BLOCK", block)
        monkeypatch.setattr(search, "STREAMED_BLOCKS", streamed)
        assert sorted(map(tuple, search.vector_arm(chunks, queries, [], 2).collect())) == want
        assert search.vector_arm(chunks.limit(0), queries, [], 2).count() == 0
        assert search.vector_arm(chunks, queries.limit(0), [], 2).count() == 0


def test_percentiles_match_sorted_lists(spark):
    import math
    import random
    from statistics import median

    from feldspar.operators.evaluation import percentiles

    r = random.Random(5)
    groups = {"one": [3.0], "even": [1.0, 2.0], "same": [7.0] * 50, "many": [float(r.randrange(300)) for _ in range(999)], None: [1.0, 5.0, 9.0]}
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in [*vs, None]], "g string, v double")
    want = {g: (median(vs), *(sorted(vs)[math.ceil(p * len(vs) / 100) - 1] for p in (95, 50))) for g, vs in groups.items()}
    assert {x["g"]: (x["median"], x["p95"], x["p50"]) for x in percentiles(rows, "g", "v", [95, 50], ranges=4).collect()} == want
