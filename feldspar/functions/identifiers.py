"""Identifiers with check digits, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number_from_hash(seed: str, kind: str, key: Column, digits: int) -> Column:
    """sha256(seed|kind|key) modulo 10 ** digits, zero-padded; folds over the hexadecimal digits."""
    hexa = F.sha2(F.concat_ws("|", F.lit(seed), F.lit(kind), key.cast("string")), 256)
    step = lambda acc, c: F.pmod(acc * 16 + F.conv(c, 16, 10).cast("bigint"), F.lit(10**digits))
    return F.lpad(F.aggregate(F.split(hexa, ""), F.lit(0).cast("bigint"), step).cast("string"), digits, "0")


def _luhn_sum(digits: Column, double_last: bool) -> Column:
    """Sum of digits, every second one doubled from the right; ``double_last``: beginning with the last."""
    chars = F.reverse(F.filter(F.split(digits, ""), lambda c: c != ""))

    def worth(c: Column, i: Column) -> Column:
        n = c.cast("int")
        twice = F.when(n * 2 > 9, n * 2 - 9).otherwise(n * 2)
        return F.when(i % 2 == (0 if double_last else 1), twice).otherwise(n)

    return F.aggregate(F.transform(chars, worth), F.lit(0), lambda acc, x: acc + x)


def luhn_digit(digits: Column) -> Column:
    """The check digit that follows ``digits``."""
    return F.pmod(10 - _luhn_sum(digits, True) % 10, F.lit(10)).cast("string")


def luhn_valid(digits: Column) -> Column:
    return digits.rlike("^[0-9]+$") & (_luhn_sum(digits, False) % 10 == 0)


#: How members (9 digits, check digit), records (7 digits), claims (10 digits, check digit) and cases
#: (7 digits, check digit) may be written, and the prefix of their canonical form.
SURFACES = {
    "member_id": (r"M[\s-]?[0-9]{3}[\s-]?[0-9]{3}[\s-]?[0-9]{3}", "M"),
    "mrn": (r"MRN[\s#:-]*[0-9]{7}", "MRN"),
    "claim_id": (r"CLM[\s-]?(?:[0-9]{10}|[0-9]{3}[\s-]?[0-9]{3}[\s-]?[0-9]{4})", "CLM-"),
    "case_id": (r"APL[\s-]?[0-9]{7}", "APL-"),
}
UNCHECKED = ("mrn",)


def canonical_identifier(kind: str, surface: Column) -> Column:
    """The canonical form of a whole surface form, null where its shape or its check digit is wrong.

    A member's nine digits may stand alone. ``kind`` is a key of ``SURFACES``, or a KeyError is raised.
    """
    pattern, prefix = SURFACES[kind]
    whole = F.trim(surface)
    digits = F.regexp_replace(whole, "[^0-9]", "")
    shaped = whole.rlike(f"^(?i:{pattern}{'|[0-9]{9}' if kind == 'member_id' else ''})$")
    return F.when(shaped if kind in UNCHECKED else shaped & luhn_valid(digits), F.concat(F.lit(prefix), digits))


def rewrite_identifiers(text: Column) -> Column:
    """``text`` with every valid surface form in canonical form, in one pass; what fails its check digit stays as it is.

    Idempotent: canonical forms are surface forms of themselves. Null gives null.
    """
    found = r"(?iU)\b(?:" + "|".join(p for p, _ in SURFACES.values()) + r")\b"

    def known(hit: Column) -> Column:
        digits = F.regexp_replace(hit, "[^0-9]", "")
        prefix = F.upper(F.regexp_extract(hit, "^[A-Za-z]+", 0))
        checked = F.when((prefix == "MRN") | luhn_valid(digits), F.concat(F.when(prefix.isin("CLM", "APL"), F.concat(prefix, F.lit("-"))).otherwise(prefix), digits))
        return F.coalesce(checked, hit)

    gaps, hits = F.split(text, found, -1), F.regexp_extract_all(text, F.lit(found), F.lit(0))
    return F.array_join(F.zip_with(gaps, hits, lambda g, h: F.concat(g, F.coalesce(known(h), F.lit("")))), "")
