"""The catalogue's contract: names and parameters are checked, and no role sees more than its policy through it."""

import pytest

from feldspar.operators import catalog
from feldspar.operators.governance import MASKS, Principal


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    from feldspar.plans.catalog import tables

    return tables(spark, sf_dir)


def test_parameters_are_checked(tables):
    who = Principal("CLAIMS_EXAMINER")
    for name, given, error in (("no_such", {}, KeyError), ("member_profile", {}, TypeError), ("member_profile", {"member_id": "13"}, TypeError), ("member_profile", {"member_id": 13, "x": 1}, TypeError), ("member_calls", {"member_id": 13, "limit": 0}, ValueError), ("member_calls", {"member_id": True}, TypeError)):
        with pytest.raises(error):
            catalog.run(name, tables, who, **given)
    assert len(catalog.CATALOG) == 13


def test_policies_hold_inside(tables):
    seen = catalog.run("member_profile", tables, Principal("CLAIMS_EXAMINER"), member_id=13).first()
    assert seen.ssn and seen.last_name == "Last13"
    rep = catalog.run("member_profile", tables, Principal("MEMBER_SERVICES_REP"), member_id=13)
    assert rep.first().ssn is None and catalog.masked_in("member_profile", rep, Principal("MEMBER_SERVICES_REP")) == ["ssn"]
    assert catalog.run("member_profile", tables, Principal("ACTUARY"), member_id=13).count() == 0  # masks come before predicates
    assert catalog.run("member_recent_claims", tables, Principal("nobody"), member_id=13).count() == 0
    costs = catalog.run("cost_by_condition", tables, Principal("CARE_MANAGER"), description_like="%").collect()
    assert costs and all(r.total is None and r.claim_lines for r in costs) and MASKS["CARE_MANAGER"]["total_claim_cost"] == "null"
    assert catalog.run("member_claims_summary", tables, Principal("CLAIMS_EXAMINER")).count() == 0  # neither id nor name
    assert catalog.run("member_recent_claims", tables, Principal("CLAIMS_EXAMINER"), member_id=13, limit=2).count() == 2
