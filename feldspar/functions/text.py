"""Text transforms as column expressions: sentences, shorthand, headings, tables, as-of dates, question routing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sentences(text: Column) -> Column:
    """Split after . ; ! ? before white space, and at line breaks; trimmed, empties dropped."""
    parts = F.split(text, r"(?<=[.;!?])\s+|\n")
    # a function of one argument: trim's own second one would be the sentence's place, whose digits it would take off
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def expand_shorthand(text: Column, words: dict[str, str]) -> Column:
    """Whole tokens, case-sensitive, longest key first, in one pass over the text so that it is idempotent."""
    keys = sorted(words, key=lambda k: (-len(k), k))
    pattern = r"(?<![\w/&])(?:" + "|".join(r"\Q" + k + r"\E" for k in keys) + r")(?![\w/&])"
    known = F.create_map(*[F.lit(x) for k in keys for x in (k, words[k])])
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_join(F.zip_with(gaps, hits, lambda g, h: F.concat(F.coalesce(g, F.lit("")), F.coalesce(known[h], F.lit("")))), "")


def template_context(title: Column, section: Column, text: Column) -> Column:
    """The template header of a chunk's index text."""
    where = F.when(section.isNotNull(), F.concat(F.lit(", section '"), section, F.lit("'"))).otherwise("")
    return F.concat(F.lit("This chunk is from "), title, where, F.lit(".\n\n"), text)


def question_phrases(text: Column, stop: list[str], most: int = 4, least: int = 3) -> Column:
    """All runs of 1 to ``most`` words that aren't only stop words; single words of ``least`` letters or more."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    stops = F.array(*[F.lit(s) for s in stop])

    def of_length(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.slice(words, i, F.lit(n)))

    kept = F.filter(F.flatten(F.array(*[of_length(n) for n in range(1, most + 1)])), lambda r: (F.size(F.array_except(r, stops)) > 0) & ((F.size(r) > 1) | (F.length(r[0]) >= least)))
    return F.array_distinct(F.transform(kept, lambda r: F.array_join(r, " ")))


def as_of_date(text: Column) -> Column:
    """The first date said in a text: ISO, m/d/yy(yy), or Month d, yyyy; null where there is none."""
    iso = F.regexp_extract(text, r"\b(20\d\d-\d\d-\d\d)\b", 1)
    slash = F.regexp_extract(text, r"\b(\d{1,2}/\d{1,2}/(?:20)?\d\d)\b", 1)
    month = F.regexp_extract(text, r"\b((?:January|February|March|April|May|June|July|August|September|October|November|December) \d{1,2}, 20\d\d)\b", 1)
    year = F.regexp_extract(slash, r"/((?:20)?\d\d)$", 1)
    full = F.concat(F.regexp_extract(slash, r"^(\d{1,2}/\d{1,2}/)", 1), F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year))
    return F.coalesce(F.try_to_date(F.nullif(iso, F.lit(""))), F.try_to_date(F.when(slash != "", full), "M/d/yyyy"), F.try_to_date(F.nullif(month, F.lit("")), "MMMM d, yyyy"))


def years_said(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\b(20\d\d)\b"), F.lit(1)), lambda y: y.cast("int"))))


def routed_years(said: Column, change: Column, current: int = 2026, first: int = 2021) -> Column:
    """Years to search: a change question takes the year before as well; undated ones the current (and last) year."""
    one = F.array(F.lit(current))
    pair = F.array(F.lit(current - 1), F.lit(current))
    bounded = F.filter(said, lambda y: y.between(first, current))
    return (
        F.when((F.size(said) > 0) & (F.size(bounded) == 0), F.array().cast("array<int>"))
        .when((F.size(bounded) == 1) & change & (bounded[0] > first), F.array(bounded[0] - 1, bounded[0]))
        .when(F.size(bounded) > 0, bounded)
        .when(change, pair)
        .otherwise(one)
    )


def pad_table_row(cells: Column, width: Column) -> Column:
    """A Markdown row of ``width`` cells; bars inside cells become slashes."""
    clean = F.transform(cells, lambda c: F.replace(F.trim(c), F.lit("|"), F.lit("/")))
    padded = F.concat(clean, F.array_repeat(F.lit(""), F.greatest(width - F.size(cells), F.lit(0))))
    return F.concat(F.lit("| "), F.array_join(padded, " | "), F.lit(" |"))


def html_table_rows(html: Column) -> Column:
    """Rows of cells of an HTML table."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]+>", " "), r"\s+", " "))
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), plain))


def html_table_to_markdown(html: Column) -> Column:
    rows = html_table_rows(html)
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    lines = F.transform(rows, lambda r: pad_table_row(r, width))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))), "\n"))


def year_neutral(text: Column, change_words: tuple[str, ...] = ("change", "changed", "changes", "compare", "compared", "difference")) -> Column:
    """A question without years and words of change."""
    words = "|".join(sorted(change_words, key=lambda w: (-len(w), w)))
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\b20\d\d\b|\b(?:" + words + r")\b", " "), " +", " "))
