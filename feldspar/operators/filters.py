"""Hard filters of a search: conjunctive, and applied before any ranking.

Chunks carry year, plan_code, doc_type, versioned, event, member_scoped, member_key, effective_from and effective_to.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

CURRENT_YEAR = 2026


@dataclass(frozen=True)
class Route:
    """What a question enforces; empty means unrestricted."""

    years: tuple[int, ...] = ()
    plan_codes: tuple[str, ...] = ()
    options: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    record: dict[str, str | list[str]] = field(default_factory=dict)
    member_key: int | None = None
    as_of: str | None = None
    #: the single hierarchy key of versioned sources that have just one: naming it bypasses the version window
    leaf_keys: tuple[str, ...] = ()


def record_filter(key: str, value: str | list[str]) -> Column:
    """A missing key passes; a present one must be the value, or one of them."""
    c = F.col(key)
    return c.isNull() | (c.isin(value) if isinstance(value, list) else c == value)


def version_window(as_of: str, bypass: Column | None = None) -> Column:
    """In force on the day: half-open; a versioned chunk without a start is out."""
    day = F.lit(as_of).cast("date")
    inside = F.coalesce(F.col("effective_from") <= day, F.lit(False)) & (F.col("effective_to").isNull() | (F.col("effective_to") > day))
    keep = ~F.col("versioned") | inside
    return keep | bypass if bypass is not None else keep


def edition(years: tuple[int, ...]) -> Column:
    return F.col("year").isin(list(years)) | F.col("event")


def member_scope(member_key: int | None) -> Column:
    if member_key is None:
        return ~F.col("member_scoped")
    return ~F.col("member_scoped") | F.coalesce(F.col("member_key") == member_key, F.lit(False))


def plan(plan_codes: tuple[str, ...]) -> Column:
    return F.col("plan_code").isNull() | F.col("plan_code").isin(list(plan_codes))


def options(asked: tuple[str, ...]) -> Column:
    tags = F.col("section_options")
    return tags.isNull() | (F.size(tags) == 0) | F.arrays_overlap(tags, F.array(*[F.lit(o) for o in asked]))


def identifier_shaped(text: Column) -> Column:
    """Holds a run of seven or more letters, digits and hyphens with three or more digits."""
    runs = F.regexp_extract_all(text, F.lit("[A-Za-z0-9-]{7,}"), F.lit(0))
    return F.exists(runs, lambda r: F.length(F.regexp_replace(r, "[^0-9]", "")) >= 3)


def in_force_on(route: Route) -> str:
    """The day whose versions count: the one that is asked for, or else the last day of the latest year."""
    if route.as_of:
        return route.as_of
    latest = sorted(route.years)[-1:] or [CURRENT_YEAR]
    return "{}-12-31".format(*latest)


def all_of(route: Route) -> Column:
    bypass = None
    for k in route.leaf_keys:
        if k in route.record:
            hit = F.coalesce(F.col(k) == route.record[k], F.lit(False))
            bypass = hit if bypass is None else bypass | hit
    keep = version_window(in_force_on(route), bypass) & member_scope(route.member_key)
    for k, v in route.record.items():
        keep &= record_filter(k, v)
    if route.years:
        keep &= edition(route.years)
    if route.plan_codes:
        keep &= plan(route.plan_codes)
    if route.options:
        keep &= options(route.options)
    if route.sources:
        keep &= F.col("doc_type").isin(list(route.sources))
    return keep
