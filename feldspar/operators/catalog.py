"""The catalogue of named, parameterised member-data queries: the only way from a question to warehouse rows.

A query is named, its parameters are typed, and every table it reads is first put through the principal's row policy and
masks (``governance.secured``), so predicates, limits and aggregates only ever meet what the role may see. Parameters
become literals of the plan: filters on them reach the scans.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .governance import Principal, masked_columns, secured

#: Rows that a query with a limit returns where none is asked for, and the most it returns at once.
DEFAULT_LIMIT, MOST_ROWS = 20, 1000


@dataclass(frozen=True)
class Parameter:
    kind: type
    required: bool = True
    default: object = None


@dataclass(frozen=True)
class Named:
    doc: str
    parameters: dict[str, Parameter]
    tables: tuple[str, ...]
    build: Callable[[dict[str, DataFrame], dict], DataFrame]


CATALOG: dict[str, Named] = {}
ID, TEXT, OPTIONAL_ID, OPTIONAL, LIMIT = Parameter(int), Parameter(str), Parameter(int, False), Parameter(str, False), Parameter(int, False, DEFAULT_LIMIT)


def named(doc: str, tables: str, **parameters: Parameter):
    """Registers a query of the catalogue under the function's name."""

    def keep(f):
        CATALOG[f.__name__] = Named(doc, parameters, tuple(tables.split()), f)
        return f

    return keep


def bound(query: Named, given: Mapping[str, object]) -> dict:
    """Checked parameters: none unknown, none missing, each of its type, limits within bounds."""
    unknown = set(given) - set(query.parameters)
    if unknown:
        raise TypeError(f"unknown parameters: {', '.join(sorted(unknown))}")
    out = {}
    for name, p in query.parameters.items():
        value = given.get(name)
        if value is None:
            if p.required:
                raise TypeError(f"parameter {name} is missing")
            value = p.default
        elif isinstance(value, bool) or not isinstance(value, p.kind):
            raise TypeError(f"parameter {name} must be {p.kind.__name__}")
        if name == "limit" and not 1 <= value <= MOST_ROWS:
            raise ValueError(f"limit must be from 1 to {MOST_ROWS}")
        out[name] = value
    return out


def run(name: str, tables: Callable[[str], DataFrame], principal: Principal, /, **given) -> DataFrame:
    """A named query's rows as the principal sees them. ``tables(name)`` gives unsecured tables."""
    if name not in CATALOG:
        raise KeyError(f"no query {name}")
    query = CATALOG[name]
    parameters = bound(query, given)
    return query.build({t: secured(t, tables(t), principal) for t in query.tables}, parameters)


def masked_in(name: str, rows: DataFrame, principal: Principal) -> list[str]:
    """Columns of a result that the role's masks alter."""
    return masked_columns(principal, rows.columns)


def _member(p: dict) -> Column:
    """By id where one is given, else by last (and first) name in any case."""
    if p.get("member_id") is not None:
        return F.col("member_id") == p["member_id"]
    if p.get("last_name") is None:
        return F.lit(False)
    match = F.upper("last_name") == F.upper(F.lit(p["last_name"]))
    return match & (F.upper("first_name") == F.upper(F.lit(p["first_name"]))) if p.get("first_name") is not None else match


def _newest(rows: DataFrame, date: str, limit: int, *ties: str) -> DataFrame:
    return rows.orderBy(F.desc(date), *ties).limit(limit)


@named("Who a member is, with the latest enrolment.", "patients enrollment", member_id=ID)
def member_profile(t, p):
    latest = t["enrollment"].where(F.col("member_id") == p["member_id"]).groupBy("member_id").agg(F.max_by(F.struct("year", "option_code", "plan_code"), "year").alias("e"))
    return t["patients"].where(F.col("member_id") == p["member_id"]).join(latest.select("member_id", "e.*"), "member_id", "left")


@named("One row a member: lines, costs and the span of service, by id or name.", "claim_detail", member_id=OPTIONAL_ID, last_name=OPTIONAL, first_name=OPTIONAL)
def member_claims_summary(t, p):
    sums = [F.sum(c).cast("decimal(20,2)").alias(a) for c, a in (("total_claim_cost", "total_cost"), ("payer_coverage", "covered"))]
    return t["claim_detail"].where(_member(p)).groupBy("member_id", "first_name", "last_name").agg(F.count(F.lit(1)).alias("claim_lines"), *sums, F.min("service_date").alias("first_service"), F.max("service_date").alias("last_service"))


@named("A member's claim lines, newest first, by id or last name.", "claim_detail", member_id=OPTIONAL_ID, last_name=OPTIONAL, limit=LIMIT)
def member_recent_claims(t, p):
    newest = _newest(t["claim_detail"].where(_member(p)), "service_date", p["limit"], "claim_id", "line_number", "total_claim_cost", "provider")
    return newest.select("member_id", "last_name", "claim_id", "line_number", "service_date", "description", "provider", "total_claim_cost", "payer_coverage")


@named("A member's calls, newest first.", "calls", member_id=ID, limit=LIMIT)
def member_calls(t, p):
    return _newest(t["calls"].where(F.col("member_id") == p["member_id"]), "called_at", p["limit"], "call_id").select("call_id", "reason", "duration", "claim_id")


@named("A member's enrolment by year.", "enrollment", member_id=ID)
def member_enrollment(t, p):
    return t["enrollment"].where(F.col("member_id") == p["member_id"]).orderBy("year")


@named("The decision on one claim.", "adjudication", claim_id=ID)
def claim_adjudication(t, p):
    return t["adjudication"].where(F.col("claim_id") == p["claim_id"]).select("claim_id", "member_id", "status", "decided_on", "reason", "policy_id")


@named("A member's denied claims, newest decision first.", "adjudication", member_id=ID, limit=LIMIT)
def member_denials(t, p):
    denied = t["adjudication"].where((F.col("member_id") == p["member_id"]) & (F.col("status") == "denied"))
    return _newest(denied, "decided_on", p["limit"], "claim_id").select("claim_id", "decided_on", "reason", "policy_id")


@named("One appeal case.", "appeals", case_id=TEXT)
def appeal_case(t, p):
    return t["appeals"].where(F.col("case_id") == p["case_id"])


@named("A member's appeals, newest first.", "appeals", member_id=ID, limit=LIMIT)
def member_appeals(t, p):
    return _newest(t["appeals"].where(F.col("member_id") == p["member_id"]), "filed_on", p["limit"], "case_id").select("case_id", "claim_id", "filed_on", "reason")


@named("Providers by NPI, or by a part of the name in any case; 20 at most.", "providers organizations", npi=OPTIONAL, name=OPTIONAL)
def provider_lookup(t, p):
    if p["npi"] is not None:
        match = F.col("npi") == p["npi"]
    else:
        match = F.upper("name").contains(p["name"].upper()) if p["name"] is not None else F.lit(False)
    found = t["providers"].where(match).join(t["organizations"], "organization_id")
    return found.select("npi", "name", "speciality", "zip", "organization").orderBy("name", "npi").limit(20)


@named("Whether a provider's organization is in a plan's network.", "providers organizations network", npi=TEXT, plan_code=TEXT)
def provider_network_status(t, p):
    one = t["providers"].where(F.col("npi") == p["npi"]).join(t["organizations"], "organization_id")
    return one.join(t["network"].where(F.col("plan_code") == p["plan_code"]), "organization_id").select("npi", "name", "organization", "plan_code", "in_network")


@named("Providers in a plan's network, of a speciality and near a ZIP prefix where asked.", "providers organizations network", plan_code=TEXT, speciality=OPTIONAL, zip_prefix=OPTIONAL, limit=LIMIT)
def providers_by_specialty(t, p):
    found = t["providers"]
    if p["speciality"] is not None:
        found = found.where(F.upper("speciality") == p["speciality"].upper())
    if p["zip_prefix"] is not None:
        found = found.where(F.col("zip").startswith(p["zip_prefix"]))
    inside = t["network"].where((F.col("plan_code") == p["plan_code"]) & F.col("in_network")).select("organization_id")
    return found.join(inside, "organization_id").join(t["organizations"], "organization_id").orderBy("zip", "name", "npi").limit(p["limit"]).select("npi", "name", "speciality", "organization", "zip")


@named("Lines, members and cost by description, for descriptions like a pattern in any case.", "claim_detail", description_like=TEXT)
def cost_by_condition(t, p):
    found = t["claim_detail"].where(F.col("description").ilike(p["description_like"]))
    cost = F.sum("total_claim_cost")
    return found.groupBy("description").agg(F.count(F.lit(1)).alias("claim_lines"), F.countDistinct("member_id").alias("members"), F.round(cost.cast("double") / F.count("total_claim_cost"), 4).alias("average"), cost.cast("decimal(20,2)").alias("total"))
