"""Declared checks, routing, composition, memo tables, the duplicate index, roster names, publishing: brute force and odd cases."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from feldspar.operators import composition, deid, memo, publish, roster
from feldspar.operators.checks import PAYLOAD, RULE, routing_missing, run_checks
from feldspar.operators.duplicates import DuplicateIndex


def missing_brute(planned, expected):
    """The largest matching isn't asked for: each expected leg in order takes the first that is left."""
    pool = [q for kind, q, _ in planned if kind == "member_query"]
    out = []
    for e in (e for e in expected if not e.startswith("doc_probe")):
        hit = next((q for q in pool if q in e.split("|")), None)
        out += [e] if hit is None else []
        if hit is not None:
            pool.remove(hit)
    docs = [e for e in expected if e.startswith("doc_probe")]
    asked = {s for e in docs for s in e.partition(":")[2].split(",") if s}
    hints = [set(s or []) for kind, _, s in planned if kind == "doc_probe"]
    if docs and not hints:
        out.append("doc_probe:" + ",".join(sorted(asked)))
    elif docs and all(hints) and asked - set().union(*hints):
        out.append("doc_probe:" + ",".join(sorted(asked - set().union(*hints))))
    return out


def test_routing_matches_as_multisets(spark):
    r, rows = random.Random(4), []
    for i in range(400):
        planned = [r.choice([("member_query", r.choice("abc"), None), ("doc_probe", None, r.choice([None, [], ["x"], ["x", "y"], ["z"]]))]) for _ in range(r.randint(0, 4))]
        expected = [r.choice(["a", "b", "a|b", "c|a", "doc_probe", "doc_probe:x", "doc_probe:y,z"]) for _ in range(r.randint(0, 4))]
        rows.append((i, planned, expected))
    table = spark.createDataFrame(rows, "i int, planned array<struct<kind:string,query_name:string,sources:array<string>>>, expected array<string>")
    got = {x.i: x.m for x in table.select("i", routing_missing(F.col("planned"), F.col("expected")).alias("m")).collect()}
    assert got == {i: missing_brute(p, e) for i, p, e in rows}


def test_checks(spark):
    chunk = (1, "104", 2025, "brochure", "FEHB 2025", "docs/fehb_2025.pdf", "You pay  $45\nper visit", None)
    other = (6, "10P", 2024, "policy", "CP-0010 v2", "policies/CP-0010.md", "Prior authorization", "M1")
    rows = [("calls", {"rep": "Ann", "n": "3"}), ("calls", {"rep": "Bo", "n": "4"})]
    legs = [("member_query", "calls", None), ("doc_probe", None, ["policy"])]
    payloads = spark.createDataFrame([(1, "ok", [2025, 2026], "2024-05-01", ["11P/2024"], ["ssn"], True, [chunk, other], rows, legs), (2, "insufficient_evidence", None, None, None, None, False, None, None, None)], PAYLOAD)
    cases = [
        ("expected_values", "104/2025", ["you pay $45"], None, True), ("expected_values", "104/2024", ["you pay $45"], None, False), ("expected_values", "any/2024", ["prior  Authorization", "x"], None, True), ("expected_values", "sops/current", ["ann"], None, True),
        ("expected_set", "", ["policies/CP-0010.md", "fehb"], None, False), ("expected_set", "", ["CP-0010.md", "FEHB 2025.pdf", "Bo"], None, True),
        ("exclude_sources", "", ["secret.md"], None, True), ("exclude_sources", "", ["x/CP-0010.md"], None, False), ("absent_titles", "", ["CP-"], None, False), ("absent_titles", "", ["cp-"], None, True),
        ("expected_legs", "", ["denials|calls", "doc_probe:policy"], None, True), ("expected_legs", "", ["calls", "calls"], None, False),
        ("expected_rows", "denials|calls", ["rep=ann", "n=3.001"], 2, True), ("expected_rows", "calls", ["rep=Ann", "n=4"], None, False), ("expected_rows", "calls", ["none=1"], None, False), ("expected_rows", "calls", None, 3, False),
        ("expected_masked", "", ["ssn"], None, True), ("expected_masked", "", None, None, False), ("expected_coverage", "", ["104", "10P"], None, True), ("expected_coverage", "", ["104", "10P"], 2025, False),
        ("expected_not_offered", "", ["11P"], None, True), ("expected_not_offered", "", ["12P"], None, False), ("expected_years", "", ["2026", "2025"], None, True), ("expected_years", "", ["2026"], None, False),
        ("expected_time_points", "", ["current", "2024-05-01"], None, True), ("expected_time_points", "", ["2023-01-01"], None, False), ("expect_status", "", ["ok", "x"], None, True), ("expect_status", "", ["x"], None, False),
        ("required_evidence", "denials|calls", None, 2, True), ("required_evidence", "denials", None, 1, False), ("expect_only_plan", "", ["104"], None, True), ("expect_only_plan", "", ["105"], None, False),
        ("expect_only_member", "", ["M1"], None, True), ("expect_only_member", "", ["M2"], None, False), ("allow", "", ["FEHB"], None, True), ("allow", "", ["CP-"], None, False), ("deny", "", ["CP-"], None, False), ("deny", "", ["zz"], None, True),
    ]
    each = payloads.where("item_id = 1").drop("item_id").crossJoin(spark.range(100, 100 + len(cases)).withColumnRenamed("id", "item_id"))
    rules = spark.createDataFrame([(100 + i, *c[:4]) for i, c in enumerate(cases)], RULE)
    got = {x.item_id: x.verdict for x in run_checks(each, rules).collect()}
    assert {c: got[100 + i] for i, c in enumerate(map(str, cases))} == {str(c): "pass" if c[4] else "fail" for c in cases}
    many = spark.createDataFrame([(1, "expect_status", None, ["ok"], None), (1, "expect_status", None, ["x"], None), (2, "expected_rows", "calls", None, 0), (2, "expect_status", None, None, None), (3, "deny", None, ["x"], None), (2, "deny", None, ["x"], None), (2, "expected_years", None, None, None)], RULE)
    assert {(x.item_id, x.check): (x.verdict, x.failed) for x in run_checks(payloads, many).collect()} == {(1, "expect_status"): ("fail", 1), (2, "expected_rows"): ("skipped", 0), (2, "expect_status"): ("fail", 1), (3, "deny"): ("skipped", 0), (2, "deny"): ("pass", 0), (2, "expected_years"): ("pass", 0)}
    with pytest.raises(Exception, match="no such check"):
        run_checks(payloads, spark.createDataFrame([(1, "nonsense", None, None, None)], RULE)).collect()


def record_shingles(text):
    body = text.split("\n", 1)[1] if "\n" in text else text
    w = re.findall(r"\w+", body.lower())
    return {" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))}


def originals_brute(rows):
    """(doc, original) in the given order, per source; duplicates are never matched."""
    kept, out = {}, {}
    for d, source, text in rows:
        s = record_shingles(text or "")
        hits = [e for e, (t, src) in kept.items() if src == source and len(s & t) >= 0.8 * len(s | t)]
        if hits:
            out[d] = min(hits)
        else:
            kept[d] = (s, source)
    return out, set(kept)


def test_duplicate_index(spark, tmp_path):
    r = random.Random(8)
    texts = ["", "x", "one two", None, "Кто там у ворот\nстоит один и поёт песню", "日本語 の テキスト です よ"]
    for f in range(8):
        own = [f"w{f}x{i}" for i in range(40)]
        for _ in range(5):
            words = list(own)
            for _ in range(r.randint(0, 4)):
                words[r.randrange(40)] = f"e{r.random()}"
            texts.append(f"call {r.random()}\n" + " ".join(words))
    texts += [texts[4].replace("Кто там", "Другой заголовок"), "", "x"]
    rows = [(i, f"s{i % 2 if r.random() < 0.3 else 0}", t) for i, t in enumerate(texts)]
    frame = lambda part: spark.createDataFrame(part, "doc_id bigint, source string, text string")
    want, kept = originals_brute(rows)
    whole = DuplicateIndex(spark, f"file://{tmp_path}/whole")
    assert {x.doc_id: x.duplicate_of for x in whole.add(frame(rows), 0).collect()} == want and {x.doc_id for x in whole.originals().collect()} == kept
    halves = DuplicateIndex(spark, f"file://{tmp_path}/halves")
    parts = [halves.add(frame(rows[:25]), 0), halves.add(frame(rows[25:]), 1), halves.add(frame(rows[25:]), 1)]  # the last run is repeated
    assert {x.doc_id: x.duplicate_of for p in parts for x in p.collect()} == want and {x.doc_id for x in halves.originals().collect()} == kept
    # an original comes again under a new id: later copies point at the row that exists
    first = min(d for d in kept if d in want.values())
    copy = next(d for d, o in want.items() if o == first)
    halves.forget(frame([(first, None, None)]).select("doc_id"), 2)
    again = {x.doc_id: x.duplicate_of for x in halves.add(frame([(1000, rows[first][1], rows[first][2]), (1001, rows[copy][1], rows[copy][2])]), 2).collect()}
    assert again == {1001: 1000} and first not in {x.doc_id for x in halves.originals().collect()}
    # a stored id with another text replaces what was stored
    assert halves.add(frame([(1000, "s0", "something else entirely here")]), 3).count() == 0
    assert {x.doc_id for x in halves.originals().collect()} == (kept - {first}) | {1000}
    assert whole.add(frame([]), 5).count() == 0


def roster_brute(text, names):
    pairs, first, last = set(names), {f for f, _ in names}, {x for _, x in names}
    tokens = list(re.finditer(r"\b[A-Z][a-z]{2,}(?:['-][A-Z][a-z]+)?\b", text))
    out, i = [], 0
    while i < len(tokens):
        m, n = tokens[i], tokens[i + 1] if i + 1 < len(tokens) else None
        if n and ((m[0], n[0]) in pairs and n.start() - m.end() <= 2 or (n[0], m[0]) in pairs and text[m.end() : n.start()] in (",", ", ")):
            out.append((m.start(), n.end(), 0.85))
            i += 2
            continue
        if m[0] in first or m[0] in last:
            out.append((m.start(), m.end(), 0.45))
        i += 1
    return out


def test_roster_names(spark, monkeypatch):
    names = [("Ann", "Lee"), ("Lee", "Ann"), ("Bob", "Lee"), ("Mary", "O'Neil"), ("Mary", "Smith-Jones"), ("Carl", "Bob")]
    r = random.Random(2)
    texts = [None, "", "no names", "Ann Lee", "Lee, Ann", "Lee,Ann Bob", "Ann  Lee", "Ann   Lee", "Mary Smith-Jones called Mary", "annAnn ANN Annie Ann.", "Ann\nLee Bob"]
    for _ in range(200):
        texts.append("".join(r.choice(["Ann", "Lee", "Bob", "Mary", "Carl", "Smith-Jones", "Zed", "said", "O'Neil"]) + r.choice([" ", ", ", ",", "  ", ". ", "-", " é "]) for _ in range(r.randint(1, 9))))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    people = spark.createDataFrame([*names, ("Ann", "Lee"), (None, "Zed")], "first string, last string")
    for most in (100_000, 0):
        monkeypatch.setattr("feldspar.operators.search.BROADCAST_ROWS", most)
        got = {x.doc_id: [(s.start, s.stop, s.score) for s in x.spans] for x in roster.roster_spans(docs, people).collect()}
        assert got == {i: roster_brute(t or "", names) for i, t in enumerate(texts)}
    # with pattern spans, the better of what overlaps stays
    both = roster.roster_spans(docs, people).join(docs, "doc_id").where("doc_id = 3").select(deid.masked(F.col("text"), deid.resolve(F.concat("spans", deid.spans(F.col("text"), {"WORD": ("Ann", 0.5)})))).alias("m"))
    assert both.first().m == "<PERSON>"


def test_memo(spark, tmp_path):
    asked = []

    def score(rows):
        asked.append(rows.count())
        return rows.select("key", F.when(F.col("text") == "nan", F.lit(float("nan"))).when(F.col("text") == "null", None).otherwise(F.length("text").cast("double")).alias("value"))

    store = memo.Memo(spark, f"file://{tmp_path}", "m1")
    rows = spark.createDataFrame([("q", "abc"), ("q", "abc"), ("q", "nan"), ("q", "null"), ("r", "abc"), ("q", None), ("q", "")], "q string, text string")
    first = [(x.value, x.cached) for x in store.lookup(rows, ["q", "text"], score).orderBy("q", "text").collect()]
    second = {(x.q, x.text): x for x in store.lookup(rows, ["q", "text"], score).collect()}
    assert asked == [6, 3] and len(first) == 7 and not any(c for _, c in first)  # nan, null and the null text are tried again
    assert second["q", "abc"].value == 3.0 and second["q", "abc"].cached and not second["q", "nan"].cached and second["q", ""].value == 0.0
    assert memo.Memo(spark, f"file://{tmp_path}", "m2").known().count() == 0
    # two runs that meet: both append, readers take one value a key
    same = store.known().collect()
    spark.createDataFrame([(same[0].key, 99.0)], "key string, value double").write.parquet(f"{tmp_path}/model=m1/run=zz")
    assert {(x.key, x.value) for x in store.known().collect()} == {(x.key, x.value) for x in same}


def test_publish(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    rows = [(1, "a,b", None), (2, 'say "x"\nline', 2.5), (3, "", 0.0), (None, "é\\N", -1.0)]
    first = spark.createDataFrame(rows, "k bigint, t string, v double")
    assert publish.current(spark, path) is None
    assert {tuple(r) for r in publish.publish(spark, path, {"one": first, "two": first.limit(0)}).collect()} == {("one", 4), ("two", 0)}
    assert sorted(map(tuple, publish.published(spark, path, "one").collect()), key=str) == sorted(rows, key=str)
    assert publish.published(spark, path, "two").count() == 0
    version = publish.current(spark, path)["version"]
    broken = first.withColumn("v", F.raise_error(F.lit("half written")).cast("double"))
    with pytest.raises(Exception, match="half written"):
        publish.publish(spark, path, {"one": first.limit(1), "two": broken})
    assert publish.current(spark, path)["version"] == version and publish.published(spark, path, "one").count() == 4
    publish.publish(spark, path, {"one": first.limit(1)})
    assert publish.published(spark, path, "one").count() == 1
    with pytest.raises(KeyError):
        publish.published(spark, path, "two")


def test_composition(spark):
    questions = spark.createDataFrame([(1, "m1", None, None, "104"), (2, None, None, None, None), (3, "m2", "c1", None, None), (4, "m1", None, None, None)], "question_id bigint, member_id string, claim_id string, case_id string, plan_code string")
    legs = spark.createDataFrame([(1, "a", "member_query", "claims", True), (1, "b", "doc_probe", None, True), (2, "a", "member_query", "claims", True), (2, "b", "doc_probe", None, False), (3, "a", "member_query", "claims", False), (3, "c", "member_query", "zzz", False), (3, "d", "other", None, False)], "question_id bigint, leg string, kind string, query_name string, required boolean")
    found = spark.createDataFrame([("m1",), ("m1",)], "member_id string")
    hits = spark.createDataFrame([(1, "b", 7, 0.9), (1, "b", 8, 0.75), (2, "b", 9, 0.1)], "question_id bigint, leg string, chunk_id bigint, score double")
    got = composition.compose_questions(questions, legs, {"claims": ["member_id"]}, {"claims": lambda b: b.join(found, "member_id")}, lambda asked: hits.join(asked.select("question_id", "leg"), ["question_id", "leg"]), provenance={"recipe": "r1"})
    rows = {r.question_id: r for r in got.collect()}
    assert {k: (r.status, r.missing, r.row_count, r.chunks, r.reasons) for k, r in rows.items()} == {
        1: ("ok", "", 2, 2, ""),
        2: ("not_executed", "a,b", 0, 0, "a: not in context: member_id; b: no evidence over the bar"),
        3: ("insufficient_evidence", "a,c,d", 0, 0, "a: no rows; c: no such query: zzz; d: no such kind: other"),
        4: ("out_of_scope", "", 0, 0, ""),
    }
    assert rows[1].confidence == 0.9 and rows[1].provenance == '{"recipe":"r1"}'
    with pytest.raises(ValueError):
        composition.bind_slots(legs, questions, {"claims": ["npi"]})
    notes = composition.coverage_notes(spark.createDataFrame(list(itertools.product([1], ["a", "b", "c"])), "question_id int, key string"), spark.createDataFrame([("a",), ("b",), ("a",)], "key string"), spark.createDataFrame([(1, "a"), (1, "c")], "question_id int, key string")).first()
    assert (notes["keys"], notes.in_corpus, notes.with_evidence, notes.missing_from_corpus, notes.without_evidence) == (["a", "b", "c"], ["a", "b"], ["a", "c"], ["c"], ["b"])
