"""From what questions say to the plans and years that are searched, for many questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Plan codes by program and option, and the first year each is offered in.
OFFERED = [("FEHB", "High", "104", 2021), ("FEHB", "Standard", "105", 2021), ("FEHB", "Basic", "106", 2021), ("PSHB", "High", "10P", 2025), ("PSHB", "Standard", "11P", 2025), ("PSHB", "Basic", "12P", 2025)]
#: How programs are said.
PROGRAM_WORDS = {"PSHB": r"(?i)\bPSHB\b|\bpostal\b", "FEHB": r"(?i)\bFEHB\b"}


def programs_said(text: Column) -> Column:
    return F.filter(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in PROGRAM_WORDS.items()]), lambda x: x.isNotNull())


def options_said(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(High|Standard|Basic)\b"), F.lit(1)))


def coverage(questions: DataFrame) -> DataFrame:
    """(question_id, level, plans) of (question_id, question, year): a named program covers all its plans, a named
    option every plan that offers it that year, both their meeting, and neither every plan of the year.

    The plans are few and fixed, so they are an array in the plan and nothing is joined.
    """
    q = questions.select("question_id", "year", programs_said(F.col("question")).alias("ps"), options_said(F.col("question")).alias("os"))
    every = F.array(*[F.struct(F.lit(p).alias("program"), F.lit(o).alias("option"), F.lit(c).alias("plan"), F.lit(y).alias("since")) for p, o, c, y in OFFERED])
    fits = lambda x: ((F.size("ps") == 0) | F.array_contains("ps", x["program"])) & ((F.size("os") == 0) | F.array_contains("os", x["option"])) & (x["since"] <= F.col("year"))
    level = F.when(F.size("os") > 0, "option").when(F.size("ps") > 0, "program").otherwise("all")
    return q.select("question_id", level.alias("level"), F.array_join(F.array_sort(F.filter(every, fits)["plan"]), ",").alias("plans"))
