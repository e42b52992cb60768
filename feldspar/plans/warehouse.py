"""The member-data lane: the claim view, the named queries, roles and masks, and the facts drawn by hash."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.governance import MASKS, ROLE_LINES, Principal, secured
from . import adapters as a
from .adapters import ADJUDICATION, APPEALS, CALLS, CLAIM_LINES, ENROLLMENT, NETWORK, PATIENTS, PROVIDERS
from .registry import query

ROLES = list(ROLE_LINES)


def claim_detail(spark, sf_dir: str, principal: Principal | None = None) -> DataFrame:
    """Claim lines with their member, provider and organization; masks of the base tables carry over."""
    lines, people = a.claim_lines(spark, sf_dir), a.patients(spark, sf_dir).drop("line_of_business")
    # keys join unmasked, what a role must not see is masked in the view's output
    view = (
        lines.join(people, "member_id")
        .join(a.providers(spark, sf_dir).select("provider_id", "npi", F.col("name").alias("provider"), "speciality", "organization_id"), "provider_id", "left")
        .join(a.organizations(spark, sf_dir), "organization_id", "left")
        .select("claim_id", "line_number", "member_id", "first_name", "last_name", "zip", "provider", "speciality", "organization", "service_date", "description", "total_claim_cost", "payer_coverage", "line_of_business")
    )
    return secured("claim_detail", view, principal) if principal else view


@query(
    "o14_claim_detail",
    f"""WITH {CLAIM_LINES}, {PATIENTS}, {PROVIDERS}
    SELECT c.line_of_business, count(*) AS lines, count(DISTINCT c.member_id) AS members, count(DISTINCT n_name) AS organizations,
           sum(total_claim_cost)::DECIMAL(20,2) AS total, sum(c.claim_id * 7 + line_number)::BIGINT AS checksum
    FROM claim_lines c JOIN patients m USING (member_id) LEFT JOIN providers p USING (provider_id) LEFT JOIN nation ON n_nationkey = organization_id
    GROUP BY 1""",
)
def o14(spark, d):
    v = claim_detail(spark, d)
    return v.groupBy("line_of_business").agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("member_id").alias("members"), F.countDistinct("organization").alias("organizations"), F.sum("total_claim_cost").cast("decimal(20,2)").alias("total"), F.sum(F.col("claim_id") * 7 + F.col("line_number")).alias("checksum"))


def _each_role(make) -> DataFrame:
    return reduce(DataFrame.unionByName, [make(Principal(r)).withColumn("role", F.lit(r)) for r in ROLES])


@query(
    "s04_lob_scope",
    f"""WITH {PATIENTS}, e AS (SELECT * FROM (VALUES {", ".join(f"('{r}','{x}')" for r, xs in ROLE_LINES.items() for x in xs)}) t(role, line_of_business))
    SELECT role, line_of_business, count(*) AS members FROM e JOIN patients USING (line_of_business) GROUP BY ALL""",
)
def s04(spark, d):
    people = a.patients(spark, d)
    return _each_role(lambda p: secured("patients", people, p).groupBy("line_of_business").agg(F.count(F.lit(1)).alias("members")))


def _masked(role: str, column: str, plain: str) -> str:
    how = MASKS.get(role, {}).get(column)
    return {"null": "NULL", "zip3": f"left({plain}, 3)", "year": f"make_date(year({plain}), 1, 1)", None: plain}[how]


@query(
    "s05_mask_matrix",
    f"WITH {PATIENTS} "
    + " UNION ALL ".join(
        f"""SELECT '{r}' AS role, count(*) AS members, count(DISTINCT line_of_business) AS lines, count({_masked(r, "ssn", "ssn")}) AS ssn_seen,
        count({_masked(r, "last_name", "last_name")}) AS names_seen, count(DISTINCT {_masked(r, "member_id", "member_id")}) AS ids_seen,
        max(length({_masked(r, "zip", "zip")})) AS zip_length, count(DISTINCT {_masked(r, "birthdate", "birthdate")}) AS birthdates
        FROM patients WHERE line_of_business IN ({", ".join(repr(x) for x in ROLE_LINES[r])})"""
        for r in ROLES
    ),
)
def s05(spark, d):
    people = a.patients(spark, d)
    return _each_role(
        lambda p: secured("patients", people, p).agg(F.count(F.lit(1)).alias("members"), F.countDistinct("line_of_business").alias("lines"), F.count("ssn").alias("ssn_seen"), F.count("last_name").alias("names_seen"), F.countDistinct("member_id").alias("ids_seen"), F.max(F.length("zip")).cast("bigint").alias("zip_length"), F.countDistinct("birthdate").alias("birthdates"))
    )


@query(
    "s05_mask_then_filter",
    f"""WITH {PATIENTS} SELECT 'ACTUARY' AS role, 0::BIGINT AS found UNION ALL
    SELECT 'CLAIMS_EXAMINER', count(*) FROM patients WHERE member_id = 17""",
)
def s05_filter(spark, d):
    """Masks come before predicates: a role that may not see ids finds nothing by id."""
    people = a.patients(spark, d)
    one = lambda p: secured("patients", people, p).where("member_id = 17").agg(F.count(F.lit(1)).alias("found")).withColumn("role", F.lit(p.name))
    return one(Principal("ACTUARY")).unionByName(one(Principal("CLAIMS_EXAMINER")))


@query(
    "s05_null_keys_group",
    f"""WITH {CLAIM_LINES} SELECT NULL::BIGINT AS member_id, count(*) AS lines, sum(total_claim_cost)::DECIMAL(20,2) AS total FROM claim_lines""",
)
def s05_group(spark, d):
    """Masked ids group together."""
    lines = secured("claim_lines", a.claim_lines(spark, d), Principal("ACTUARY"))
    return lines.groupBy("member_id").agg(F.count(F.lit(1)).alias("lines"), F.sum("total_claim_cost").cast("decimal(20,2)").alias("total"))


@query(
    "o01_member_profile",
    f"""WITH {PATIENTS}, {ENROLLMENT}
    SELECT p.*, e.year, e.plan_code FROM patients p LEFT JOIN enrollment e
      ON e.member_id = p.member_id AND e.year = (SELECT max(year) FROM enrollment x WHERE x.member_id = p.member_id)""",
)
def o01(spark, d):
    e = a.enrollment(spark, d)
    last = e.groupBy("member_id").agg(F.max_by(F.struct("year", "plan_code"), "year").alias("e")).select("member_id", "e.*")
    return a.patients(spark, d).join(last, "member_id", "left")


@query(
    "o02_claims_summary",
    f"""WITH {CLAIM_LINES}, {PATIENTS}
    SELECT member_id, last_name, count(*) AS lines, sum(total_claim_cost)::DECIMAL(20,2) AS total, sum(payer_coverage)::DECIMAL(20,2) AS covered,
           min(service_date) AS first_service, max(service_date) AS last_service
    FROM claim_lines JOIN patients USING (member_id) GROUP BY ALL""",
)
def o02(spark, d):
    joined = a.claim_lines(spark, d).join(a.patients(spark, d).select("member_id", "last_name"), "member_id")
    return joined.groupBy("member_id", "last_name").agg(F.count(F.lit(1)).alias("lines"), F.sum("total_claim_cost").cast("decimal(20,2)").alias("total"), F.sum("payer_coverage").cast("decimal(20,2)").alias("covered"), F.min("service_date").alias("first_service"), F.max("service_date").alias("last_service"))


@query(
    "o03_recent_claims",
    f"""WITH {CLAIM_LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY member_id ORDER BY service_date DESC, claim_id, line_number, total_claim_cost, provider_id) AS rank FROM claim_lines)
    SELECT member_id, claim_id, line_number, service_date, total_claim_cost, rank FROM r WHERE rank <= 20""",
)
def o03(spark, d):
    """The 20 newest lines of every member: the parameterised query, for all parameters at once."""
    order = Window.partitionBy("member_id").orderBy(F.desc("service_date"), "claim_id", "line_number", "total_claim_cost", "provider_id")
    return a.claim_lines(spark, d).withColumn("rank", F.row_number().over(order)).where("rank <= 20").select("member_id", "claim_id", "line_number", "service_date", "total_claim_cost", F.col("rank").cast("bigint").alias("rank"))


@query(
    "o04_member_calls",
    f"""WITH {CALLS}, r AS (SELECT *, row_number() OVER (PARTITION BY member_id ORDER BY called_at DESC, call_id) AS rank FROM calls)
    SELECT member_id, call_id, reason, duration, claim_id, rank FROM r WHERE rank <= 20""",
)
def o04(spark, d):
    order = Window.partitionBy("member_id").orderBy(F.desc("called_at"), "call_id")
    return a.call_log(spark, d).withColumn("rank", F.row_number().over(order).cast("bigint")).where("rank <= 20").select("member_id", "call_id", "reason", "duration", "claim_id", "rank")


@query("o05_member_enrollment", f"WITH {ENROLLMENT} SELECT member_id, year, option_code, plan_code FROM enrollment")
def o05(spark, d):
    return a.enrollment(spark, d)


@query("o06_claim_adjudication", f"WITH {ADJUDICATION} SELECT claim_id, status, decided_on, reason, policy_id FROM adjudication")
def o06(spark, d):
    return a.adjudication(spark, d).select("claim_id", "status", "decided_on", "reason", "policy_id")


@query(
    "o07_member_denials",
    f"""WITH {ADJUDICATION}, r AS (SELECT *, row_number() OVER (PARTITION BY member_id ORDER BY decided_on DESC, claim_id) AS rank FROM adjudication WHERE status = 'denied')
    SELECT member_id, claim_id, decided_on, reason, policy_id, rank FROM r WHERE rank <= 20""",
)
def o07(spark, d):
    order = Window.partitionBy("member_id").orderBy(F.desc("decided_on"), "claim_id")
    return a.adjudication(spark, d).where("status = 'denied'").withColumn("rank", F.row_number().over(order).cast("bigint")).where("rank <= 20").select("member_id", "claim_id", "decided_on", "reason", "policy_id", "rank")


@query("o08_appeal_case", f"WITH {APPEALS} SELECT * FROM appeals")
def o08(spark, d):
    return a.appeals(spark, d)


@query(
    "o09_member_appeals",
    f"""WITH {APPEALS}, r AS (SELECT *, row_number() OVER (PARTITION BY member_id ORDER BY filed_on DESC, case_id) AS rank FROM appeals)
    SELECT member_id, case_id, filed_on, rank FROM r WHERE rank <= 20""",
)
def o09(spark, d):
    order = Window.partitionBy("member_id").orderBy(F.desc("filed_on"), "case_id")
    return a.appeals(spark, d).withColumn("rank", F.row_number().over(order).cast("bigint")).where("rank <= 20").select("member_id", "case_id", "filed_on", "rank")


@query(
    "o10_provider_lookup",
    f"""WITH {PROVIDERS} SELECT npi, name, speciality, zip, n_name AS organization FROM providers JOIN nation ON n_nationkey = organization_id
    WHERE upper(name) LIKE '%' || upper('r#00000000') || '%' ORDER BY name, npi LIMIT 20""",
)
def o10(spark, d):
    """Providers by a part of the name in any case; the limit is the catalog's."""
    found = a.providers(spark, d).where(F.upper("name").contains("R#00000000"))
    return found.join(a.organizations(spark, d), "organization_id").select("npi", "name", "speciality", "zip", "organization").orderBy("name", "npi").limit(20)


@query("o11_network_status", f"WITH {PROVIDERS}, {NETWORK} SELECT npi, plan_code, in_network FROM providers JOIN network USING (organization_id)")
def o11(spark, d):
    return a.providers(spark, d).join(a.network(spark, d), "organization_id").select("npi", "plan_code", "in_network")


@query(
    "o12_providers_by_specialty",
    f"""WITH {PROVIDERS}, {NETWORK}, r AS (
      SELECT plan_code, speciality, zip, name, row_number() OVER (PARTITION BY plan_code, speciality ORDER BY zip, name) AS rank
      FROM providers JOIN network USING (organization_id) WHERE in_network AND zip LIKE '0%')
    SELECT plan_code, speciality, zip, name, rank FROM r WHERE rank <= 20""",
)
def o12(spark, d):
    order = Window.partitionBy("plan_code", "speciality").orderBy("zip", "name")
    inside = a.network(spark, d).where("in_network")
    return a.providers(spark, d).where(F.col("zip").startswith("0")).join(inside, "organization_id").withColumn("rank", F.row_number().over(order).cast("bigint")).where("rank <= 20").select("plan_code", "speciality", "zip", "name", "rank")


@query(
    "o13_cost_by_condition",
    f"""WITH {CLAIM_LINES} SELECT description, count(*) AS lines, count(DISTINCT member_id) AS members, round(avg(total_claim_cost)::DOUBLE, 4) AS average,
      sum(total_claim_cost)::DECIMAL(20,2) AS total FROM claim_lines WHERE description ILIKE '%m%' GROUP BY 1""",
)
def o13(spark, d):
    found = a.claim_lines(spark, d).where(F.col("description").ilike("%m%"))
    return found.groupBy("description").agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("member_id").alias("members"), F.round(F.sum("total_claim_cost").cast("double") / F.count(F.lit(1)), 4).alias("average"), F.sum("total_claim_cost").cast("decimal(20,2)").alias("total"))


@query(
    "o15_verify_matrix",
    f"WITH {CLAIM_LINES} "
    + " UNION ALL ".join(
        f"""SELECT '{r}' AS role, count(*) AS rows_seen, count(DISTINCT line_of_business) AS lines, count({_masked(r, "member_id", "member_id")}) > 0 AS ids_seen,
        count({_masked(r, "total_claim_cost", "total_claim_cost")}) > 0 AS costs_seen, count(DISTINCT {_masked(r, "member_id", "member_id")}) AS members
        FROM claim_lines WHERE line_of_business IN ({", ".join(repr(x) for x in ROLE_LINES[r])})"""
        for r in ROLES
    ),
)
def o15(spark, d):
    lines = a.claim_lines(spark, d)
    return _each_role(lambda p: secured("claim_lines", lines, p).agg(F.count(F.lit(1)).alias("rows_seen"), F.countDistinct("line_of_business").alias("lines"), (F.count("member_id") > 0).alias("ids_seen"), (F.count("total_claim_cost") > 0).alias("costs_seen"), F.countDistinct("member_id").alias("members")))


@query("w03_network", f"WITH {NETWORK} SELECT * FROM network")
def w03(spark, d):
    return a.network(spark, d)


@query(
    "w04_adjudication_outcomes",
    f"""WITH {ADJUDICATION}, {PROVIDERS}, {NETWORK}, {ENROLLMENT},
    first_line AS (SELECT l_orderkey AS claim_id, min(l_suppkey) AS provider_id FROM lineitem GROUP BY 1)
    SELECT status, coalesce(in_network, false) AS in_network, count(*) AS claims
    FROM adjudication a LEFT JOIN first_line USING (claim_id) LEFT JOIN providers p USING (provider_id)
    LEFT JOIN enrollment e ON e.member_id = a.member_id AND e.year = year(a.service_date)
    LEFT JOIN network n ON n.organization_id = p.organization_id AND n.plan_code = e.plan_code GROUP BY ALL""",
)
def w04(spark, d):
    """Claims with their provider, the enrollment of the service year and the network status under that plan."""
    first = a.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("claim_id")).agg(F.min("l_suppkey").alias("provider_id"))
    claims = a.adjudication(spark, d).withColumn("year", F.year("service_date"))
    joined = claims.join(first, "claim_id", "left").join(a.providers(spark, d).select("provider_id", "organization_id"), "provider_id", "left")
    joined = joined.join(a.enrollment(spark, d).select("member_id", "year", "plan_code"), ["member_id", "year"], "left").join(a.network(spark, d), ["organization_id", "plan_code"], "left")
    return joined.groupBy("status", F.coalesce("in_network", F.lit(False)).alias("in_network")).agg(F.count(F.lit(1)).alias("claims"))


@query(
    "w01_member_numbers",
    """WITH c AS (SELECT c_custkey AS member_id, sha256('7|member|' || c_custkey) AS h FROM customer),
    n AS (SELECT member_id, lpad((list_reduce(list_prepend(0::BIGINT, list_transform(string_split(h, ''), lambda c: ('0x' || c)::BIGINT)), lambda a, x: (a * 16 + x) % 100000000))::VARCHAR, 8, '0') AS digits FROM c),
    s AS (SELECT member_id, digits, list_sum(list_transform(range(1, 9), lambda i:
      CASE WHEN i % 2 = 0 THEN (CASE WHEN substr(digits, i, 1)::BIGINT * 2 > 9 THEN substr(digits, i, 1)::BIGINT * 2 - 9 ELSE substr(digits, i, 1)::BIGINT * 2 END) ELSE substr(digits, i, 1)::BIGINT END)) AS total FROM n)
    SELECT member_id, 'M' || digits || (10 - total % 10) % 10 AS member_number FROM s""",
)
def w01(spark, d):
    """Member numbers: eight digits of a SHA-256 and a Luhn check digit."""
    from ..functions.identifiers import luhn_digit, number_from_hash

    digits = number_from_hash("7", "member", F.col("c_custkey"), 8)
    return a.table(spark, d, "customer").select(F.col("c_custkey").alias("member_id"), F.concat(F.lit("M"), digits, luhn_digit(digits)).alias("member_number"))


@query(
    "i09_semi_join",
    """SELECT c_custkey AS member_id FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2000-01-01')""",
)
def i09(spark, d):
    recent = a.table(spark, d, "orders").where("o_orderdate >= '2000-01-01'").select(F.col("o_custkey").alias("c_custkey"))
    return a.table(spark, d, "customer").join(recent, "c_custkey", "left_semi").select(F.col("c_custkey").alias("member_id"))


@query(
    "i18_years_alive",
    f"""WITH {PATIENTS} SELECT member_id, y::INTEGER AS year FROM patients, (SELECT unnest(range(2021, 2027)) AS y) WHERE birthdate <= make_date(y::INTEGER, 12, 31)""",
)
def i18(spark, d):
    people = a.patients(spark, d).select("member_id", "birthdate", F.explode(F.sequence(F.lit(2021), F.lit(2026))).alias("year"))
    return people.where(F.col("birthdate") <= F.make_date("year", F.lit(12), F.lit(31))).select("member_id", "year")


@query(
    "a16_access_history",
    """WITH log AS (SELECT event_id, ts, user_id, list_transform(range(0, (props::JSON->>'$.k')::BIGINT % 4), lambda i: ['PATIENTS','CLAIM_LINES','APPEALS'][i + 1]) AS objects FROM events)
    SELECT event_id, user_id, o AS object FROM log, LATERAL (SELECT unnest(objects) AS o) WHERE o LIKE 'CLAIM%' ORDER BY ts DESC, event_id LIMIT 50""",
)
def a16(spark, d):
    """The newest accesses to objects of a name prefix, from an access log of arrays."""
    n = F.get_json_object("props", "$.k").cast("int") % 4
    log = a.table(spark, d, "events").select("event_id", "ts", "user_id", F.slice(F.array(F.lit("PATIENTS"), F.lit("CLAIM_LINES"), F.lit("APPEALS")), 1, n).alias("objects"))
    flat = log.select("event_id", "ts", "user_id", F.explode("objects").alias("object")).where(F.col("object").startswith("CLAIM"))
    return flat.orderBy(F.desc("ts"), "event_id").limit(50).select("event_id", "user_id", "object")
