"""Role and location dimensions built as set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide import dims


def known_roles(postings: DataFrame, saved: DataFrame | None = None, base: list[str] = dims.BASE_ROLES) -> DataFrame:
    """Distinct titles in lower case, saved roles, and the base roles."""
    spark = postings.sparkSession
    roles = postings.where("job_title IS NOT NULL").select(F.lower("job_title").alias("role"))
    if saved is not None:
        roles = roles.union(saved.select("role"))
    return roles.union(spark.createDataFrame([(r,) for r in base], "role string")).distinct()


def sort_roles(roles: DataFrame) -> DataFrame:
    """Longest role first, so that the most specific one is met first."""
    return roles.orderBy(F.length("role").desc(), "role")


def add_roles(known: DataFrame, found: DataFrame) -> DataFrame:
    """The known roles and the found ones that are missing."""
    return known.union(found.select("role").distinct().join(known, "role", "left_anti"))


def all_locations(postings: DataFrame, common: list[str] = dims.COMMON_LOCATIONS) -> DataFrame:
    """Every location of a posting and the common ones, trimmed and sorted."""
    spark = postings.sparkSession
    found = postings.select(F.explode("location").alias("location")).where("location <> ''")
    both = found.union(spark.createDataFrame([(c,) for c in common], "location string"))
    return both.select(F.trim("location").alias("location")).distinct().orderBy("location")


def role_locations(postings: DataFrame, roles: DataFrame) -> DataFrame:
    """(role, location): where each role is offered."""
    from jobtide.operators.filters import role_titles

    places = postings.select("job_title", F.explode("location").alias("location")).distinct()
    return places.join(role_titles(postings, roles), "job_title").select("role", "location").distinct()


def merge_profile_skills(profiles: DataFrame, dictionary: DataFrame, added: str = "resume_skills") -> DataFrame:
    """Profile skills united with those of the résumé, kept if the dictionary has them.

    The dictionary meets exploded skills in an equi-join, so it may be long.
    """
    united = profiles.withColumn("_skill", F.explode_outer(F.array_union("skills", added)))
    known = dictionary.select(F.col("skill").alias("_skill")).distinct().withColumn("_known", F.lit(True))
    kept = united.join(known, "_skill", "left").groupBy("profile_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("_known"), F.col("_skill")))).alias("skills")
    )
    return profiles.drop("skills", added).join(kept, "profile_id")
