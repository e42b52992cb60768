"""Who may see what, as filters and projections that go into every plan before a caller's operators.

Document tiers: a principal's persona names the tiers it sees; two personas also see cited records of another tier.
Warehouse roles: rows by line of business, then masks by column. A table that isn't granted isn't there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tiers by persona, and the tiers whose cited records a persona sees besides.
PERSONA_TIERS = {
    "public": ["public"],
    "employee": ["public", "employee"],
    "care_team": ["public", "care_team"],
    "member_services": ["public", "employee", "member_services"],
    "appeals": ["public", "employee", "appeals"],
    "admin": ["public", "employee", "care_team", "member_services", "appeals"],
}
CITED_TIERS = {"appeals": ["care_team", "member_services"]}
CITATION_KIND = {"care_team": "clinical_note", "member_services": "call_note"}

#: Warehouse roles, the lines of business each sees, and the columns masked for it.
ROLE_LINES = {"ACTUARY": ["FEHB", "PSHB"], "CARE_MANAGER": ["FEHB", "PSHB"], "MEMBER_SERVICES_REP": ["FEHB", "PSHB"], "APPEALS_ANALYST": ["FEHB", "PSHB"], "CLAIMS_EXAMINER": ["FEHB", "PSHB"], "PSHB_EXAMINER": ["PSHB"], "ACCOUNTADMIN": ["FEHB", "PSHB"]}
MASKS = {
    "ACTUARY": {"first_name": "null", "last_name": "null", "ssn": "null", "zip": "zip3", "city": "null", "birthdate": "year", "member_id": "null", "case_id": "null"},
    "CARE_MANAGER": {"total_claim_cost": "null", "payer_coverage": "null"},
    "MEMBER_SERVICES_REP": {"ssn": "null"},
    "APPEALS_ANALYST": {"ssn": "null"},
}
GRANTED = {"patients", "enrollment", "calls", "adjudication", "appeals", "claim_lines", "organizations", "providers", "network", "claim_detail"}


@dataclass(frozen=True)
class Principal:
    """Exactly one persona or role a session."""

    name: str

    @property
    def tiers(self) -> list[str]:
        if self.name not in PERSONA_TIERS:
            raise KeyError(f"unknown persona {self.name}")
        return PERSONA_TIERS[self.name]

    @property
    def lines(self) -> list[str]:
        return ROLE_LINES.get(self.name, [])

    @property
    def masks(self) -> dict[str, str]:
        return MASKS.get(self.name, {})


def visible(principal: Principal) -> Column:
    """Row policy on (acl_tag, cited): before any ranking, so limits count visible rows only."""
    own = F.col("acl_tag").isin(principal.tiers)
    more = CITED_TIERS.get(principal.name, [])
    return own | (F.col("cited") & F.col("acl_tag").isin(more)) if more else own


def with_citations(chunks: DataFrame, evidence: DataFrame) -> DataFrame:
    """Adds ``cited``: the title is evidence of the kind that belongs to the chunk's tier."""
    kind = F.when(F.col("acl_tag") == "care_team", "clinical_note").when(F.col("acl_tag") == "member_services", "call_note")
    links = evidence.select(F.col("document_title").alias("title"), F.col("kind").alias("_kind")).distinct().withColumn("cited", F.lit(True))
    return chunks.withColumn("_kind", kind).join(links, ["title", "_kind"], "left").withColumn("cited", F.coalesce("cited", F.lit(False))).drop("_kind")


def mask(column: str, how: str) -> Column:
    if how == "null":
        return F.lit(None)
    if how == "zip3":
        return F.left(F.col(column), F.lit(3))
    if how == "year":
        return F.make_date(F.year(column), F.lit(1), F.lit(1))
    raise ValueError(how)


def secured(name: str, df: DataFrame, principal: Principal) -> DataFrame:
    """A warehouse table as a role sees it: granted, rows of its lines of business, masks before all predicates."""
    if name not in GRANTED:
        raise PermissionError(f"{name} isn't granted")
    kinds = dict(df.dtypes)
    if "line_of_business" in kinds:
        df = df.where(F.col("line_of_business").isin(principal.lines) if principal.lines else F.lit(False))
    return df.select(*[mask(c, principal.masks[c]).cast(kinds[c]).alias(c) if c in principal.masks else F.col(c) for c in df.columns])


def masked_columns(principal: Principal, columns: list[str]) -> list[str]:
    """The role's masked columns among a result's columns."""
    return [c for c in columns if c in principal.masks]
