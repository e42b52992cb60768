"""Declared checks of payloads: a table of rules evaluated over a table of payloads in one plan, and routing matches.

A rule is a row (item_id, check, side, wanted, number); an item may have many rows of a check, and passes it when all hold.
``wanted`` is a list whose meaning the check tells. A payload is one row an item, with its bounded parts as arrays; rules
meet it in one join, and every check is an expression over the two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the year that "current" means.
CURRENT_YEAR = 2026
CHUNK = "array<struct<rank:int,plan_code:string,year:int,doc_type:string,title:string,path:string,text:string,member_key:string>>"
ROW = "array<struct<query_name:string,cells:map<string,string>>>"
LEG = "array<struct<kind:string,query_name:string,sources:array<string>>>"
PAYLOAD = f"item_id bigint, status string, years array<int>, as_of string, not_offered array<string>, masked array<string>, ran boolean, chunks {CHUNK}, rows {ROW}, legs {LEG}"
RULE = "item_id bigint, check string, side string, wanted array<string>, number bigint"
EDITION, YEAR_OF = r"^(\d\d-\d\d\d|\d\d[A-Z0-9])/(\d{4})$", r"^[^/]+/(\d{4})$"


def normal(text: Column) -> Column:
    """Lower case, single spaces, trimmed; null is empty."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def names_document(chunk: Column, ref: Column) -> Column:
    """Whether ``ref`` names the chunk's document: by path suffix, title, or a stem that the title holds."""
    path, title = F.coalesce(chunk["path"], F.lit("")), F.coalesce(chunk["title"], F.lit(""))
    stem = F.regexp_replace(F.element_at(F.split(ref, "/"), -1), r"\.(md|pdf|csv)$", "")
    return F.endswith(path, ref) | (title == ref) | ((stem != "") & F.contains(title, stem))


def _all(xs: Column, f) -> Column:
    return F.coalesce(F.forall(xs, f), F.lit(True))


def _any(xs: Column, f) -> Column:
    return F.coalesce(F.exists(xs, f), F.lit(False))


def routing_missing(planned: Column, expected: Column) -> Column:
    """What of the expected legs the plan lacks, as names.

    Member legs are a multiset: each expected one, in order, takes the first planned leg that is left and that it allows
    ("a|b": either query). Document legs together must search every expected source; a planned one without hints searches
    all, one expected without sources is met by any. More planned legs are allowed. An expected leg is a string: a query,
    "doc_probe", or "doc_probe:source,source".
    """
    is_doc = lambda e: e.startswith("doc_probe")
    want = F.filter(expected, lambda e: ~is_doc(e))
    pool = F.transform(F.filter(planned, lambda p: p["kind"] == "member_query"), lambda p: p["query_name"])
    none = F.array().cast("array<string>")

    def take(acc: Column, e: Column) -> Column:
        allowed = F.split(e, r"\|")
        hit = F.filter(F.sequence(F.lit(1), F.size(acc["pool"]) + 1), lambda i: F.coalesce(F.array_contains(allowed, F.get(acc["pool"], i - 1)), F.lit(False)))
        left = F.filter(acc["pool"], lambda _, i: i != F.get(hit, F.lit(0)) - 1)
        return F.when(F.size(hit) > 0, F.struct(left.alias("pool"), acc["missing"].alias("missing"))).otherwise(F.struct(acc["pool"].alias("pool"), F.concat(acc["missing"], F.array(e)).alias("missing")))

    legs = F.aggregate(want, F.struct(pool.alias("pool"), none.alias("missing")), take)["missing"]
    docs, searched = F.filter(expected, is_doc), F.filter(planned, lambda p: p["kind"] == "doc_probe")
    asked = F.array_distinct(F.filter(F.flatten(F.transform(docs, lambda e: F.split(F.regexp_replace(e, "^doc_probe:?", ""), ","))), lambda s: s != ""))
    hints = F.transform(searched, lambda p: F.coalesce(p["sources"], none))
    everything = F.exists(hints, lambda h: F.size(h) == 0)
    absent = F.array_sort(F.array_except(asked, F.flatten(hints)))
    doc = F.when(F.size(docs) == 0, none).when(F.size(searched) == 0, F.array(F.concat(F.lit("doc_probe:"), F.array_join(F.array_sort(asked), ",")))).when(everything | (F.size(absent) == 0), none).otherwise(F.array(F.concat(F.lit("doc_probe:"), F.array_join(absent, ","))))
    return F.concat(legs, doc)


def _with(value: Column, f) -> Column:
    """``f`` of a value that is made once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _conditions(rule: Column) -> dict[str, Column]:
    """Whether a rule (side, wanted, number) holds for a payload's columns, by check."""
    side, number = F.coalesce(rule["side"], F.lit("")), rule["number"]
    wanted = F.coalesce(rule["wanted"], F.array().cast("array<string>"))
    chunks, rows, row_text = F.col("chunks"), F.col("rows"), F.col("_row_text")
    plan, year = F.regexp_extract(side, EDITION, 1), F.regexp_extract(side, YEAR_OF, 1)
    in_pool = lambda c: ((plan == "") | (c["plan_code"] == plan)) & ((year == "") | (c["year"].cast("string") == year))
    pool_text = F.concat_ws(" ", F.array_join(F.filter(F.zip_with(chunks, F.col("_texts"), lambda c, t: F.when(in_pool(c), t)), lambda t: t.isNotNull()), " "), row_text)
    of_query = F.filter(rows, lambda r: F.array_contains(F.split(side, r"\|"), r["query_name"]))
    # of several allowed queries, the first that has rows
    first = F.filter(F.split(side, r"\|"), lambda q: F.exists(rows, lambda r: r["query_name"] == q))
    of_first = F.filter(rows, lambda r: r["query_name"] == F.get(first, F.lit(0)))
    key, value = (lambda w: F.regexp_extract(w, "^([^=]*)=", 1)), (lambda w: F.regexp_replace(w, "^[^=]*=", ""))
    number_of = lambda x: F.when(x.rlike("(?i)[0-9]|nan|inf"), x.try_cast("double"))  # what surely is none makes no error
    same = lambda got, w: F.coalesce(F.when(number_of(w).isNotNull(), F.abs(number_of(got) - number_of(w)) < 0.005 + 1e-9 * F.abs(number_of(w))).otherwise(got.isNotNull() & (normal(got) == normal(w))), F.lit(False))
    carries = _any(of_first, lambda r: F.forall(wanted, lambda w: same(F.element_at(r["cells"], key(w)), value(w))))
    in_year = lambda c: (number.isNull()) | (c["year"] == number)
    titles = F.transform(chunks, lambda c: F.coalesce(c["title"], F.lit("")))
    top = F.transform(F.filter(chunks, lambda c: c["rank"] <= 5), lambda c: F.coalesce(c["title"], F.lit("")))
    within = lambda ts: _any(ts, lambda t: F.exists(wanted, lambda w: F.contains(t, w)))
    years = F.coalesce(F.col("years"), F.array().cast("array<int>"))
    point = lambda w: F.when(w == "current", F.array_contains(years, CURRENT_YEAR)).otherwise(F.coalesce(F.col("as_of") == w, F.lit(False)) | F.array_contains(years, F.substring(w, 1, 4).cast("int")))
    masked = F.coalesce(F.col("masked"), F.array().cast("array<string>"))
    return {
        "expected_values": _with(pool_text, lambda text: _any(wanted, lambda w: F.contains(text, normal(w)))),
        "expected_set": _all(wanted, lambda w: F.exists(chunks, lambda c: names_document(c, w)) | F.contains(row_text, normal(w))),
        "exclude_sources": ~_any(wanted, lambda w: F.exists(chunks, lambda c: names_document(c, w))),
        "absent_titles": ~within(titles),
        "expected_legs": F.size(routing_missing(F.col("legs"), wanted)) == 0,
        "expected_rows": (number.isNull() | (F.size(of_first) == number)) & ((F.size(wanted) == 0) | carries),
        "expected_masked": F.coalesce(F.col("ran"), F.lit(False)) & F.when(F.size(wanted) == 0, F.size(masked) == 0).otherwise(F.size(F.array_except(wanted, masked)) == 0),
        "expected_coverage": _all(wanted, lambda w: F.exists(chunks, lambda c: (c["plan_code"] == w) & in_year(c))),
        "expected_not_offered": _all(wanted, lambda w: F.exists("not_offered", lambda s: F.startswith(s, w))),
        "expected_years": F.array_sort(years) == F.array_sort(wanted.cast("array<int>")),
        "expected_time_points": _all(wanted, point),
        "expect_status": F.array_contains(wanted, F.col("status")),
        "required_evidence": F.coalesce(F.array_max(F.transform(F.split(side, r"\|"), lambda q: F.size(F.filter(of_query, lambda r: r["query_name"] == q)))) >= number, F.lit(False)),
        "expect_only_plan": _all(F.filter(chunks, lambda c: c["doc_type"] == "brochure"), lambda c: F.coalesce(F.array_contains(wanted, c["plan_code"]), F.lit(False))),
        "expect_only_member": (F.size(chunks) > 0) & _all(chunks, lambda c: c["member_key"].isNull() | F.array_contains(wanted, c["member_key"])),
        "allow": within(top) & (F.col("status") == "ok"),
        "deny": ~within(titles),
    }


CHECKS = (
    "expected_values expected_set exclude_sources absent_titles expected_legs expected_rows expected_masked expected_coverage expected_not_offered "
    "expected_years expected_time_points expect_status required_evidence expect_only_plan expect_only_member allow deny"
).split()
#: Checks that say nothing while the warehouse didn't run.
OF_WAREHOUSE = ("expected_rows", "expected_masked", "required_evidence")


def run_checks(payloads: DataFrame, rules: DataFrame) -> DataFrame:
    """(item_id, check, verdict, failed): pass, fail, or skipped, and how many of the check's rules failed.

    ``payloads`` are as PAYLOAD, ``rules`` as RULE (null ``wanted`` is an empty list). Rules of items without a payload
    are skipped, and so are checks of rows where no warehouse leg ran. An unknown check raises.
    """
    return run_listed(payloads, rules.groupBy("item_id").agg(F.collect_list(F.struct("check", "side", "wanted", "number")).alias("rules")))


def run_listed(payloads: DataFrame, lists: DataFrame) -> DataFrame:
    """``run_checks`` of rules in lists, a row an item (item_id, rules): a payload meets its rules once, and its texts are
    normalised once for all of them."""
    met = lists.join(payloads.withColumn("_there", F.lit(True)), "item_id", "left")
    for name, form in (("chunks", CHUNK), ("rows", ROW), ("legs", LEG), ("not_offered", "array<string>")):
        met = met.withColumn(name, F.coalesce(name, F.array().cast(form)))
    values = lambda r: F.transform(F.map_values(r["cells"]), normal)
    met = met.withColumn("_texts", F.transform("chunks", lambda c: normal(c["text"]))).withColumn("_row_text", F.array_join(F.flatten(F.transform("rows", values)), " "))

    def judged(rule: Column) -> Column:
        # an unknown check raises in the plan itself, so nothing is collected first
        check = F.when(rule["check"].isin(CHECKS), rule["check"]).otherwise(F.raise_error(F.concat(F.lit("no such check: "), rule["check"])))
        holds = F.lit(False)
        for name, condition in _conditions(rule).items():
            holds = F.when(rule["check"] == name, condition).otherwise(holds)
        return F.struct(check.alias("check"), F.coalesce(holds, F.lit(False)).alias("holds"))

    done = met.select("item_id", "_there", "ran", F.transform("rules", judged).alias("_judged"))
    done = done.withColumn("_checks", F.col("_judged.check")).withColumn("_bad", F.transform(F.filter("_judged", lambda j: ~j["holds"]), lambda j: j["check"]))
    done = done.select("item_id", "_there", "ran", "_bad", F.explode(F.array_distinct("_checks")).alias("check"))
    skipped = F.col("_there").isNull() | (F.col("check").isin(list(OF_WAREHOUSE)) & ~F.coalesce("ran", F.lit(False)))
    failed = F.size("_bad") - F.size(F.array_remove("_bad", F.col("check")))
    done = done.select("item_id", "check", skipped.alias("_s"), failed.cast("bigint").alias("failed"))
    verdict = F.when(F.col("_s"), "skipped").when(F.col("failed") == 0, "pass").otherwise("fail")
    return done.select("item_id", "check", verdict.alias("verdict"), F.when(F.col("_s"), 0).otherwise(F.col("failed")).alias("failed"))
