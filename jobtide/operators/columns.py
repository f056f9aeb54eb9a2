"""Which column of a postings table holds the skills."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def choose_column(df: DataFrame, candidates: tuple[str, ...]) -> str | None:
    """The first candidate column that exists and, if there are several, holds a value somewhere.

    One aggregate over the table, as all rows decide.
    """
    present = [c for c in candidates if c in df.columns]
    if len(present) < 2:  # nothing to look up
        return present[0] if present else None
    filled = df.agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in present]).first()
    return next((c for c in present if filled[c]), None)


STATS_SKILL_ORDER = ("skills_extracted", "skills_list")
IMPACT_SKILL_ORDER = ("skills_list", "skills_extracted", "skills_text")


def with_skills(df: DataFrame, order: tuple[str, ...] = STATS_SKILL_ORDER, out: str = "skills_list") -> DataFrame:
    """The table with the first filled skill column as ``out``; an empty list where there is none."""
    chosen = choose_column(df, order)
    if chosen == out:
        return df
    return df.withColumn(out, F.col(chosen) if chosen else F.array().cast("array<string>"))


def chosen_skills(df: DataFrame, skills_col: str | None, order: tuple[str, ...]) -> tuple[DataFrame, str]:
    """The table and its skill column: the one named, or else the first filled one of ``order``, as an array."""
    if skills_col is not None:
        return df, skills_col
    out = with_skills(df, order)
    if out.schema["skills_list"].dataType.typeName() == "string":
        out = out.withColumn("skills_list", F.split("skills_list", r"\s*,\s*"))
    return out, "skills_list"
