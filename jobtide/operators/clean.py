"""Cleaning: field derivation, duplicate merge, freshness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide import dims
from jobtide.functions import text as tx
from jobtide.operators.skills import extract_skills

ORDER = ("source_file", "row_no")


def clean_text_columns(raw: DataFrame) -> DataFrame:
    """Clean title and company, and the description where there is one."""
    names = [c for c in ("job_title", "company", "job_description") if c in raw.columns]
    return raw.withColumns({c: tx.clean_text(F.col(c)) for c in names})


def standardize_locations(raw: DataFrame) -> DataFrame:
    """Location text or array -> sorted array of cities."""
    location = F.col("location")
    if raw.schema["location"].dataType.typeName() == "string":
        location = tx.text_list(location)
    return raw.withColumn("location", tx.standard_location(location))


def parse_fields(df: DataFrame) -> DataFrame:
    """Experience range and level, salary range and middle."""
    return (
        df.withColumns({
            "_exp": tx.experience_range(F.col("experience_required")),
            "_sal": tx.salary_range(F.col("salary")),
        })
        .withColumns({
            "experience_min": F.col("_exp.min"),
            "experience_max": F.col("_exp.max"),
            "experience_level": tx.experience_level(F.col("_exp.min")),
            "salary_min": F.col("_sal.min"),
            "salary_max": F.col("_sal.max"),
            "salary_mid": (F.col("_sal.min") + F.col("_sal.max")) / 2,
        })
        .drop("_exp", "_sal")
    )


def filter_fresh(df: DataFrame, as_of: Column, days: int = dims.FRESHNESS_DAYS, column: str = "scraped_date") -> DataFrame:
    """Rows scraped within ``days`` before ``as_of``; null dates are dropped."""
    return df.where(F.col(column) >= as_of - F.expr(f"INTERVAL {days} DAYS"))


def posting_key(key: str = "job_url") -> Column:
    """What tells postings apart: the URL, or title and company where there is none."""
    apart = F.sha2(F.concat_ws("\u0001", "job_title", "company"), 256)
    return F.when(F.coalesce(F.col(key), F.lit("")) == "", apart).otherwise(F.col(key))


def total_order(df: DataFrame, order_by: Sequence[str] = ORDER) -> Column:
    """The order columns that the table has, then a hash of the row, so that "first" is never random."""
    return F.struct(*[c for c in order_by if c in df.columns], F.xxhash64(*df.columns))


def merge_duplicates(
    postings: DataFrame,
    key: str = "job_url",
    order_by: Sequence[str] = ORDER,
    union_columns: Sequence[str] = ("location",),
    compat: bool = False,
    id_column: str | None = None,
) -> DataFrame:
    """One row per key: the first filled value of each column, the union of list columns.

    "First" follows ``order_by``, then a hash of the row. Null and '' count as not filled; with ``compat``
    only null does, and all rows without a key merge into one. By default rows
    without a key are kept apart by title and company. ``id_column`` adds the hash of
    what the row was merged by, which is unique.

    One aggregate: its states are one value per plain column and the distinct lists per list column, and all are combined
    before the shuffle, so a key that holds a large share of all rows stays cheap.
    """
    unions = [c for c in union_columns if c in postings.columns]
    plain = [c for c in postings.columns if c != key and c not in unions and c != id_column]
    strings = {f.name for f in postings.schema if f.dataType.typeName() == "string"}
    group = F.coalesce(F.col(key), F.lit("")) if compat else posting_key(key)
    rows = postings.withColumns({"_key": group, "_order": total_order(postings, order_by)})

    def first_filled(c: str) -> Column:
        filled = F.col(c).isNotNull()
        if c in strings and not compat:
            filled = filled & (F.col(c) != "")
        return F.min_by(F.col(c), F.when(filled, F.col("_order"))).alias(c)

    aggs = [first_filled(c) for c in plain]
    aggs.append(F.min_by(F.coalesce(F.col(key), F.lit("")), F.col("_order")).alias(key))
    empty = F.array().cast("array<string>")
    aggs += [F.coalesce(F.array_compact(F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))), empty).alias(c) for c in unions]
    # Beside the key goes its hash: rows are sorted by it, and URLs begin alike.
    merged = rows.groupBy(F.xxhash64("_key").alias("_hash"), "_key").agg(*aggs)
    if id_column:
        merged = merged.withColumn(id_column, F.sha2("_key", 256))
    return merged.select(*dict.fromkeys([*postings.columns, *([id_column] if id_column else [])]))


def drop_duplicate_urls(
    postings: DataFrame, key: str = "job_url", order_by: Sequence[str] = ORDER, keep: Sequence[str] | None = None
) -> DataFrame:
    """The first row of each key; rows alike in ``order_by`` go by a hash of the row.

    A constant-size aggregate state, no per-key sort. Only the columns in ``keep``, by default all, travel and are returned; all
    decide which row is first.
    """
    row = F.struct(*(postings.columns if keep is None else keep))
    return postings.groupBy(F.col(key).alias("_key")).agg(F.min_by(row, total_order(postings, order_by)).alias("_row")).select("_row.*")


def merge_search_locations(found: DataFrame, key: str = "job_url", location: str = "location") -> DataFrame:
    """(key, locations): the searched locations under which a posting was found."""
    return found.groupBy(key).agg(F.array_sort(F.collect_set(location)).alias("location"))


def with_job_id(df: DataFrame) -> DataFrame:
    return df if "job_id" in df.columns else df.withColumn("job_id", F.sha2("job_url", 256))


def add_skill_fields(df: DataFrame, dictionary: DataFrame, compat: bool = False) -> DataFrame:
    """Skills of title and description, education of the description, and their text forms."""
    has_text = "job_description" in df.columns
    described = F.coalesce(F.col("job_description"), F.lit("")) if has_text else F.col("job_title")
    full = F.concat_ws(" ", F.coalesce("job_title", F.lit("")), described) if has_text else described
    out = extract_skills(df.withColumn("_text", full), dictionary, "job_id", "_text").drop("_text")
    return out.withColumns({
        "education_extracted": tx.education(described, compat),
        "skills_text": F.array_join("skills_extracted", ", "),
        "num_skills": F.size("skills_extracted"),
    })


def clean_postings(
    raw: DataFrame,
    dictionary: DataFrame | None = None,
    as_of: Column | None = None,
    horizon_days: int = dims.FRESHNESS_DAYS,
    union_columns: Sequence[str] = ("location",),
    compat: bool = False,
) -> DataFrame:
    """The cleaning job: text, locations, merge by URL, parsed fields, skills, freshness.

    URLs lose their query part before the merge, unless ``compat`` is set.
    """
    df = standardize_locations(clean_text_columns(raw))
    if "job_url" in df.columns:
        if not compat:
            df = df.withColumn("job_url", tx.canonical_url(F.col("job_url")))
        df = merge_duplicates(df, union_columns=union_columns, compat=compat, id_column="job_id")
    df = with_job_id(parse_fields(df))
    if dictionary is not None:
        df = add_skill_fields(df, dictionary, compat)
    if df.schema["scraped_date"].dataType.typeName() == "string":
        df = df.withColumn("scraped_date", F.col("scraped_date").cast("timestamp"))
    return df if as_of is None else filter_fresh(df, as_of, horizon_days)
