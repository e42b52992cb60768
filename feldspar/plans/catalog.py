"""The catalogue's queries under two roles each, with DuckDB twins over tables secured in the same way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import catalog
from ..operators.governance import MASKS, ROLE_LINES, Principal
from . import adapters as a
from .adapters import APPEALS, CALLS, CLAIM_LINES, ENROLLMENT, NETWORK, PATIENTS, PROVIDERS
from .registry import query
from .warehouse import claim_detail

#: Columns of the secured tables, in the twins.
COLUMNS = {
    "patients": "member_id first_name last_name ssn zip city birthdate line_of_business",
    "detail": "claim_id line_number member_id first_name last_name zip provider service_date description total_claim_cost payer_coverage line_of_business",
    "appeals": "case_id claim_id member_id filed_on reason policy_id",
    "adjudication": "claim_id member_id status decided_on reason policy_id",
    "calls": "call_id member_id called_at reason duration claim_id",
    "enrollment": "member_id year option_code plan_code",
    "providers": "npi name speciality zip organization_id",
}
DETAIL = """detail AS (SELECT c.*, m.first_name, m.last_name, m.zip, p.name AS provider
  FROM claim_lines c JOIN patients m USING (member_id) LEFT JOIN providers p USING (provider_id))"""


def tables(spark, sf_dir: str):
    """The catalogue's tables by name."""
    own = {"calls": a.call_log, "claim_detail": claim_detail}
    return lambda name: own.get(name, getattr(a, name, None))(spark, sf_dir)


def _see(role: str, table: str) -> str:
    """A secured table of the twin: rows of the role's lines, masks applied."""
    how = {None: "{0}", "null": "nullif({0}, {0})", "zip3": "left({0}, 3)", "year": "make_date(year({0}), 1, 1)"}
    cols = COLUMNS[table].split()
    rows = " WHERE line_of_business IN (" + ", ".join(f"'{x}'" for x in ROLE_LINES[role]) + ")" if "line_of_business" in cols else ""
    return f"(SELECT {', '.join(how[MASKS.get(role, {}).get(c)].format(c) + ' AS ' + c for c in cols)} FROM {table}{rows})"


def _both(name: str, roles: tuple[str, str], ctes: str, body: str, /, **given) -> None:
    """Registers a named query, run under two roles; ``body`` has {table} for secured tables."""

    def twin(role: str) -> str:
        return f"SELECT '{role}' AS role, x.* FROM (" + body.format(**{t: _see(role, t) for t in COLUMNS}) + ") x"

    @query(f"catalog_{name}", f"WITH {ctes} " + " UNION ALL ".join(twin(r) for r in roles))
    def both(spark, d) -> DataFrame:
        one = lambda r: catalog.run(name, tables(spark, d), Principal(r), **given).withColumn("role", F.lit(r))
        return one(roles[0]).unionByName(one(roles[1]))


WHOLE = f"{CLAIM_LINES}, {PATIENTS}, {PROVIDERS}, {DETAIL}"
_both(
    "member_profile",
    ("MEMBER_SERVICES_REP", "PSHB_EXAMINER"),
    f"{PATIENTS}, {ENROLLMENT}",
    """SELECT p.*, e.year, e.option_code, e.plan_code FROM {patients} p LEFT JOIN {enrollment} e
       ON e.member_id = p.member_id AND e.year = (SELECT max(year) FROM {enrollment} x WHERE x.member_id = p.member_id) WHERE p.member_id = 13""",
    member_id=13,
)
_both(
    "member_claims_summary",
    ("CARE_MANAGER", "CLAIMS_EXAMINER"),
    WHOLE,
    """SELECT member_id, first_name, last_name, count(*) AS claim_lines, sum(total_claim_cost)::DECIMAL(20,2) AS total_cost, sum(payer_coverage)::DECIMAL(20,2) AS covered,
       min(service_date) AS first_service, max(service_date) AS last_service FROM {detail} WHERE upper(last_name) = 'LAST13' GROUP BY ALL""",
    last_name="last13",
)
_both(
    "member_recent_claims",
    ("ACTUARY", "CLAIMS_EXAMINER"),
    WHOLE,
    """SELECT member_id, last_name, claim_id, line_number, service_date, description, provider, total_claim_cost, payer_coverage FROM {detail} WHERE member_id = 13
       ORDER BY service_date DESC, claim_id, line_number, total_claim_cost, provider LIMIT 30""",
    member_id=13,
    limit=30,
)
_both("member_calls", ("MEMBER_SERVICES_REP", "ACTUARY"), CALLS, "SELECT call_id, reason, duration, claim_id FROM {calls} WHERE member_id = 13 ORDER BY called_at DESC, call_id LIMIT 20", member_id=13)
_both("member_enrollment", ("MEMBER_SERVICES_REP", "ACTUARY"), ENROLLMENT, "SELECT * FROM {enrollment} WHERE member_id = 13", member_id=13)
_both("claim_adjudication", ("APPEALS_ANALYST", "ACTUARY"), APPEALS, "SELECT claim_id, member_id, status, decided_on, reason, policy_id FROM {adjudication} WHERE claim_id = 12", claim_id=12)
_both("member_denials", ("APPEALS_ANALYST", "ACTUARY"), APPEALS, "SELECT claim_id, decided_on, reason, policy_id FROM {adjudication} WHERE member_id = 67 AND status = 'denied' ORDER BY decided_on DESC, claim_id LIMIT 20", member_id=67)
_both("appeal_case", ("APPEALS_ANALYST", "ACTUARY"), APPEALS, "SELECT * FROM {appeals} WHERE case_id = 'APL-12'", case_id="APL-12")
_both("member_appeals", ("APPEALS_ANALYST", "ACTUARY"), APPEALS, "SELECT case_id, claim_id, filed_on, reason FROM {appeals} WHERE member_id = 67 ORDER BY filed_on DESC, case_id LIMIT 20", member_id=67)
_both("provider_lookup", ("MEMBER_SERVICES_REP", "ACTUARY"), PROVIDERS, "SELECT npi, name, speciality, zip, n_name AS organization FROM {providers} JOIN nation ON n_nationkey = organization_id WHERE upper(name) LIKE '%R#00000000%' ORDER BY name, npi LIMIT 20", name="r#00000000")
_both("provider_network_status", ("MEMBER_SERVICES_REP", "PSHB_EXAMINER"), f"{PROVIDERS}, {NETWORK}", "SELECT npi, name, n_name AS organization, plan_code, in_network FROM {providers} JOIN nation ON n_nationkey = organization_id JOIN network USING (organization_id) WHERE npi = '1000000000' AND plan_code = '104'", npi="1000000000", plan_code="104")
_both("providers_by_specialty", ("MEMBER_SERVICES_REP", "ACTUARY"), f"{PROVIDERS}, {NETWORK}", "SELECT npi, name, speciality, n_name AS organization, zip FROM {providers} JOIN nation ON n_nationkey = organization_id JOIN network USING (organization_id) WHERE plan_code = '104' AND in_network AND upper(speciality) = 'CARDIOLOGY' ORDER BY zip, name, npi LIMIT 20", plan_code="104", speciality="cardiology")
_both(
    "cost_by_condition",
    ("CARE_MANAGER", "PSHB_EXAMINER"),
    WHOLE,
    """SELECT description, count(*) AS claim_lines, count(DISTINCT member_id) AS members, round(sum(total_claim_cost)::DOUBLE / count(total_claim_cost), 4) AS average,
       sum(total_claim_cost)::DECIMAL(20,2) AS total FROM {detail} WHERE description ILIKE '%m%' GROUP BY 1""",
    description_like="%m%",
)
