"""Markdown tables in running text as column expressions: their rows, their keys, and whether a row is still a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import question_phrases

SEPARATOR = r"^\s*\|\s*:?-{2,}"
ROW = r"^\s*\|\s*([^|]*?)\s*\|"
#: Words that name plans, answers or nothing; they are no keys by themselves.
STOP = (
    "high standard option options plan plans hdhp elevate plus fehb pshb tier drug yes no none nothing n/a all the and for with what which does is are of "
    "note notes benefit benefits service services you pay we cover covered in out network"
).split()
#: The most words of a key, the least keys of a lookup table and their least share of its cells.
KEY_WORDS, LEAST_KEYS, LEAST_SHARE = 6, 2, 0.7


def normal_cell(text: Column) -> Column:
    """Lower-case letters and digits with single spaces between words."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def table_keys(content: Column) -> Column:
    """First cells of the rows of a lookup table, in order; none where the text is not one.

    A table needs a separator row; the row before it is a header. Numbers, cells under three characters and cells of stop
    words alone are no cells. A lookup table has two keys of up to six words at least, and they are 70 % of its cells: a
    table whose first cells are sentences is prose laid out as a table. Null gives no keys.
    """
    lines = F.split(F.coalesce(content, F.lit("")), "\n")
    rule = lambda line: F.coalesce(line.rlike(SEPARATOR), F.lit(False))
    stops = F.array(*[F.lit(w) for w in STOP])

    def first_cell(line: Column, i: Column) -> Column:
        return F.when(line.rlike(ROW) & ~rule(line) & ~rule(F.get(lines, i + 1)), normal_cell(F.regexp_extract(line, ROW, 1)))

    named = lambda c: (F.length(c) >= 3) & ~c.rlike("^[0-9 ]+$") & (F.size(F.array_except(F.split(c, " "), stops)) > 0)
    cells = F.filter(F.transform(lines, first_cell), lambda c: c.isNotNull() & named(c))
    keys = F.filter(cells, lambda c: F.size(F.split(c, " ")) <= KEY_WORDS)
    lookup = F.exists(lines, rule) & (F.size(keys) >= LEAST_KEYS) & (F.size(keys) >= LEAST_SHARE * F.size(cells))
    return F.when(lookup, keys).otherwise(F.array().cast("array<string>"))


def row_phrases(question: Column) -> Column:
    """What a question may call a row: its runs of one to four words, single ones of four letters or more."""
    return question_phrases(question, STOP, least=4)


def table_rows(content: Column) -> Column:
    """(header, line) of each body row of each Markdown table, as an array of structs.

    A table's header is its first row; other lines between rows end a table.
    """
    lines = F.transform(F.split(F.coalesce(content, F.lit("")), "\n"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    cells = lambda s: F.transform(F.split(F.regexp_replace(s, r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c))
    is_row = lambda s: s.startswith("|") & s.endswith("|")
    is_rule = lambda s: F.forall(cells(s), lambda c: ~c.rlike("[^-: ]"))
    empty = F.lit(None).cast("array<string>")
    start = F.struct(F.array().cast("array<struct<header:array<string>,line:string>>").alias("done"), empty.alias("header"))

    def step(acc: Column, s: Column) -> Column:
        row = F.array(F.struct(acc["header"].alias("header"), s.alias("line")))
        return (
            F.when(~is_row(s), F.struct(acc["done"].alias("done"), empty.alias("header")))
            .when(is_rule(s), acc)
            .when(acc["header"].isNull(), F.struct(acc["done"].alias("done"), cells(s).alias("header")))
            .otherwise(F.struct(F.concat(acc["done"], row).alias("done"), acc["header"].alias("header")))
        )

    return F.aggregate(lines, start, step, lambda acc: acc["done"])


def plain(text: Column) -> Column:
    """Lower case, runs of white space as one space."""
    return F.lower(F.regexp_replace(text, r"\s+", " "))
