"""Skill dictionary as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide import dims


def builtin_skills(spark: SparkSession) -> DataFrame:
    names = [(s,) for group in dims.SKILL_CATEGORIES.values() for s in group]
    return spark.createDataFrame(names, "skill string")


def skill_dictionary(
    base: DataFrame, skills: DataFrame | None = None, master: DataFrame | None = None
) -> DataFrame:
    """Union of dictionaries, longest name first.

    ``base``, ``skills`` and ``master`` hold a ``skill`` column; names of ``skills`` are
    trimmed, names of ``master`` also count without a trailing noise word.
    """
    names = base.select("skill")
    if skills is not None:
        names = names.union(skills.select(F.trim("skill").alias("skill")).where("skill <> ''"))
    if master is not None:
        noise = r"(?i)\s+(" + "|".join(dims.SKILL_NOISE_WORDS) + ")$"
        short = F.regexp_replace("skill", noise, "").alias("skill")
        names = names.union(master.select("skill")).union(master.select(short))
    return (
        names.where(F.col("skill").isNotNull())
        .distinct()
        .orderBy(F.length("skill").desc(), "skill")
    )


def read_skill_csv(spark: SparkSession, path: str, column: str | None = None) -> DataFrame:
    """A skill list in a CSV file: the named column, else ``Skills``, else the first."""
    raw = spark.read.csv(path, header=True, escape='"')
    name = column or ("Skills" if "Skills" in raw.columns else raw.columns[0])
    return raw.select(F.trim(F.col(name)).alias("skill")).where("skill <> ''")


def usable_skills(dictionary: DataFrame) -> DataFrame:
    """Dictionary entries that may match: not blacklisted, and short ones only if listed."""
    upper = F.upper("skill")
    short_ok = (F.length("skill") > 3) | upper.isin(dims.SHORT_SKILLS)
    return dictionary.select("skill").where(~upper.isin(dims.SKILL_BLACKLIST) & short_ok).distinct()
