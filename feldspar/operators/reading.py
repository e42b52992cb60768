"""What a question says: the options it asks for, the years it names, and what lies outside the corpus."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def asked_options(text: Column, names: tuple[str, ...], shy: tuple[str, ...] = (), pairs: tuple[tuple[str, str], ...] = ()) -> Column:
    """The ``names`` of options that ``text`` asks for, in any case and in the order of ``names``.

    A name that begins a longer one ("Basic", "Basic Plus") counts only where it stands without the rest. A ``shy`` one,
    being a common word, counts only before "option" or "plan". Of ``pairs`` the second counts as soon as its bare word is
    said beside the first, and the other way round, so that "High and Standard Option" compares both.
    """

    def said(name: str) -> Column:
        longer = [n[len(name) :].strip() for n in names if n.lower().startswith(name.lower() + " ")]
        rest = "".join(rf"(?!\s+{re.escape(x)}\b)" for x in longer)
        own = rf"(?i)\b{re.escape(name)}\b{rest}" + (r"\s+(?:option|plan)s?\b" if name in shy else "")
        return text.rlike(own)

    partners = {n: {b for a, b in pairs if a == n} | {a for a, b in pairs if b == n} for n in names}
    word = lambda n: text.rlike(rf"(?i)\b{re.escape(n)}\b")

    def counts(name: str) -> Column:
        got = said(name)
        for other in sorted(partners[name]):
            got |= said(other) & word(name)
        return got

    return F.filter(F.array(*[F.when(counts(n), F.lit(n)) for n in names]), lambda x: x.isNotNull())


def said_years(text: Column) -> Column:
    """Years from 2000 to 2099 that stand alone, ascending."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?<![\w$.,-])(20[0-9]{2})(?![\w%]|[.,][0-9])"), F.lit(1)), lambda y: y.cast("int"))))


def boundary(text: Column, own: str, carriers: tuple[str, ...], first: int, last: int) -> Column:
    """struct(scope, value, note): what of a question lies outside, and what to answer; the first that holds.

    ``other_carrier``: one of ``carriers`` is named and ``own`` isn't. ``medicare_program``: Medicare's own premiums,
    enrolment, penalties or costs, without a plan's part in it. ``out_of_year``: every year named lies outside
    ``first`` to ``last``; the value is the earliest. Else ``in_scope`` without value or note; so is a null text.
    """
    other = F.element_at(F.concat(F.filter(F.array(*[F.when(text.rlike(rf"(?i)\b{re.escape(c)}\b"), F.lit(c)) for c in carriers]), lambda x: x.isNotNull()), F.array(F.lit(None).cast("string"))), 1)
    foreign = other.isNotNull() & ~text.rlike(rf"(?i)\b{re.escape(own)}\b")
    medicare = text.rlike(r"(?i)\bmedicare(?:'s)?\s+(?:part\s+[abcd]\s+)?(?:premiums?|enrollment|penalt(?:y|ies)|costs?)\b") & ~text.rlike(r"(?i)\b(?:plan|coordinat\w*|option)\b")
    years = said_years(text)
    outside = (F.size(years) > 0) & F.forall(years, lambda y: (y < first) | (y > last))
    one = lambda scope, value, note: F.struct(F.lit(scope).alias("scope"), value.cast("string").alias("value"), note.alias("note"))
    none = F.lit(None).cast("string")
    return (
        F.when(F.coalesce(foreign, F.lit(False)), one("other_carrier", other, F.concat(F.lit(f"The corpus covers {own} only; "), other, F.lit(" is another carrier."))))
        .when(F.coalesce(medicare, F.lit(False)), one("medicare_program", none, F.lit("Medicare's own rules are outside the corpus; how plans go together with Medicare is in it.")))
        .when(F.coalesce(outside, F.lit(False)), one("out_of_year", years[0], F.concat(F.lit(f"The corpus covers {first} to {last}; "), years[0].cast("string"), F.lit(" is outside."))))
        .otherwise(one("in_scope", none, none))
    )
