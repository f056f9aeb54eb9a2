"""Posting tables derived from the driver's tables, in Spark and in SQL."""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.operators.clean import clean_postings
from jobtide.session import spread, stored


# Tables with much work per row; the others are only joined or counted.
WIDE_WORK = {"lineitem", "documents", "pages", "conversations"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(df) if name in WIDE_WORK else df


ROLE_WORDS = ["Analyst", "Engineer", "Manager", "Designer"]
CITY_TEXTS = ["Bengaluru", "Bombay", "Navi Mumbai", "Gurugram", "New Delhi", "pune", "HYDERABAD", "Bangalore East", None, "Remote"]
DEGREE_TEXTS = ["MBA required", "B.Tech or B.E. holders", "Master of Technology", "any degree", "Masters in Arts", "Ph.D welcome", "to be decided"]


def _pick(index: str, values: list[str | None], fallback: str = "''") -> str:
    """A CASE expression, the same in both dialects."""
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v is not None)
    return f"CASE {index} {arms} ELSE {fallback} END"


# One expression per posting column, valid in Spark SQL and DuckDB.
RAW_COLUMNS = {
    "job_url": "concat('https://jobs.example/', l_orderkey, '?src=', l_linenumber)",
    "job_title": f"concat('<b>', c_mktsegment, '</b>  ', {_pick('l_orderkey % 4', ROLE_WORDS)}, '!')",
    "company": "c_name",
    "experience_required": (
        "CASE WHEN CAST(l_quantity AS INT) % 3 = 0 THEN concat(CAST(l_quantity AS INT) % 12, '-', CAST(l_quantity AS INT) % 12 + 3, ' Yrs') "
        "WHEN CAST(l_quantity AS INT) % 3 = 1 THEN concat(CAST(l_quantity AS INT) % 12, '+ years') "
        "WHEN CAST(l_quantity AS INT) % 2 = 0 THEN 'N/A' END"
    ),
    "salary": (
        "CASE l_returnflag WHEN 'N' THEN 'Not Disclosed' "
        "WHEN 'A' THEN concat(3 + l_partkey % 20, '-', 8 + l_partkey % 20, ' Lacs PA') "
        "ELSE concat(4 + l_partkey % 25, ',00,000 - ', 6 + l_partkey % 25, ',50,000 P.A.') END"
    ),
    "job_description": f"concat('<p>Need ', p_name, ' skills (urgent); ', {_pick('l_suppkey % 7', DEGREE_TEXTS)}, ' </p>')",
    "scraped_date": "l_shipdate",
    "source": "'portal'",
    "source_file": "concat('crawl_', l_linenumber, '.csv')",
    "row_no": "CAST(l_partkey AS BIGINT) * 100000000 + l_suppkey",
    "cluster_id": "CAST(c_nationkey % 20 AS INT)",
    "cluster_label": "CASE WHEN c_nationkey % 20 = 19 THEN 'Error 000 page' ELSE concat('Cluster ', c_nationkey % 20) END",
}
CITY = _pick("s_nationkey % 10", CITY_TEXTS, "n_name")


def raw_postings(spark: SparkSession, sf: str) -> DataFrame:
    """One raw posting per lineitem."""
    t = lambda n: table(spark, sf, n)
    # Small tables meet first, so the lines are shuffled as narrow rows, and last by order: all lines of a posting then lie together.
    orders = t("orders").join(t("customer"), F.expr("o_custkey = c_custkey")).select("o_orderkey", "c_name", "c_mktsegment", "c_nationkey")
    suppliers = t("supplier").join(t("nation"), F.expr("s_nationkey = n_nationkey")).select("s_suppkey", "s_nationkey", "n_name")
    joined = (
        t("lineitem")
        .join(t("part"), F.expr("l_partkey = p_partkey"))
        .join(suppliers, F.expr("l_suppkey = s_suppkey"))
        .join(orders, F.expr("l_orderkey = o_orderkey"))
    )
    columns = [F.expr(e).alias(c) for c, e in RAW_COLUMNS.items()]
    return joined.select(*columns, F.expr(f"array({CITY})").alias("location"), F.expr("array(p_name)").alias("skills_list"))


def postings(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned postings, one per order; the skills of all its lines."""
    raw = raw_postings(spark, sf).drop("job_description")
    return clean_postings(raw, union_columns=("location", "skills_list"))


def full_postings(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned postings with their descriptions and the text form of their skills."""
    jobs = clean_postings(raw_postings(spark, sf), union_columns=("location", "skills_list"))
    return jobs.withColumn("skills_text", F.array_join("skills_list", ", "))


def stored_postings(spark: SparkSession, sf: str, derive=postings) -> DataFrame:
    """The cleaned postings as a written table, for jobs that read them several times."""
    return stored(derive(spark, sf), "postings")


def land_texts(texts: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", folders: int = 64) -> None:
    """One text file for each id, ``<id_col>=<id>`` in its name; every row ends in a line break.

    Hadoop's local file system starts a process (chmod) for each file and folder it makes, which takes
    longer than all the rest. So on a local or mounted path the tasks write the files themselves; on others Spark's writer does.
    """
    rows = texts.select(id_col, text_col).repartition(id_col)
    scheme = re.match(r"(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://)?(/.*)", path)
    if not scheme or scheme[1] not in (None, "file"):
        rows.write.partitionBy(id_col).text(path)
        return
    root = scheme[2]
    os.makedirs(root, exist_ok=True)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = ((i, t) for b in batches for s in range(0, b.num_rows, 256) for i, t in zip(*(c.to_pylist() for c in b.slice(s, 256).columns)))
        done = 0
        for key, group in groupby(pairs, key=lambda pair: pair[0]):
            name = f"{id_col}={'__HIVE_DEFAULT_PARTITION__' if key is None else key}"
            folder = f"{root}/part={zlib.crc32(name.encode()) % folders}"
            os.makedirs(folder, exist_ok=True)
            part = f"{folder}/_{uuid.uuid4().hex}"  # named when whole, so a task may run again
            with open(part, "wb") as out:
                out.writelines((text or "").encode() + b"\n" for _, text in group)
            os.replace(part, f"{folder}/{name}.txt")
            done += 1
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], names=["files"])

    rows.sortWithinPartitions(id_col).mapInArrow(written, "files long").agg(F.sum("files")).first()


def profiles(spark: SparkSession, sf: str) -> DataFrame:
    """One profile per customer: skills bought, a target role by segment."""
    t = lambda n: table(spark, sf, n)
    skills = (
        t("customer")
        .join(t("orders"), F.expr("o_custkey = c_custkey"), "left")
        .join(t("lineitem"), F.expr("l_orderkey = o_orderkey"), "left")
        .join(t("part"), F.expr("l_partkey = p_partkey"), "left")
        .groupBy("c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey")
        .agg(F.array_sort(F.collect_set(F.when(F.expr("l_quantity > 40"), F.col("p_name")))).alias("skills"))
    )
    return skills.select(
        F.expr("concat('P', c_custkey)").alias("profile_id"),
        F.expr(PROFILE_ROLE).alias("current_role"),
        F.expr(TARGET_ROLE).alias("target_role"),
        F.expr(YEARS).alias("years_experience"),
        F.expr(f"array({PROFILE_DEGREE})").alias("education"),
        "skills",
        F.expr(f"array({PROFILE_CITY_1}, {PROFILE_CITY_2})").alias("locations"),
    )


PROFILE_ROLE = "concat(c_mktsegment, ' Analyst')"
TARGET_ROLE = f"concat(lower(c_mktsegment), ' ', lower({_pick('c_custkey % 4', ROLE_WORDS)}))"
YEARS = "CAST(floor(abs(c_acctbal)) % 15 AS INT)"
PROFILE_DEGREE = _pick("c_custkey % 5", ["High School", "Bachelor''s", "MBA", "M.Tech/M.E", "PhD"])
PROFILE_CITY_1 = _pick("c_nationkey % 4", ["Bangalore", "Mumbai", "Pune", "Remote"])
PROFILE_CITY_2 = _pick("c_nationkey % 3", ["Delhi", "hyderabad", "Gurgaon"])

# ---------------------------------------------------------------- SQL side

_COLS = ", ".join(f"{e} AS {c}" for c, e in RAW_COLUMNS.items())
RAW_SQL = f"""raw AS (
  SELECT {_COLS}, {CITY} AS city_text, p_name
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey)"""

SQL_SPACE = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"
SQL_WORD = r"\p{L}\p{N}_"


def sql_clean(x: str) -> str:
    bare = f"regexp_replace({x}, '<[^>]+>', '', 'g')"
    kept = f"regexp_replace({bare}, '[^{SQL_WORD}{SQL_SPACE}.,\\-&/]', '', 'g')"
    return f"coalesce(trim(regexp_replace({kept}, '[{SQL_SPACE}]+', ' ', 'g')), '')"


def sql_city(x: str) -> str:
    low = f"lower({x})"
    arms = " ".join(
        f"WHEN contains({low}, '{a}') THEN '{c}'"
        for a, c in [("bengaluru", "Bangalore"), ("bangalore", "Bangalore"), ("gurgaon", "Gurgaon"), ("gurugram", "Gurgaon"),
                     ("mumbai", "Mumbai"), ("bombay", "Mumbai"), ("new delhi", "Delhi"), ("delhi ncr", "Delhi")]
    )
    return f"CASE {arms} ELSE upper(substr({x}, 1, 1)) || lower(substr({x}, 2)) END"


def sql_title(x: str) -> str:
    return (
        "array_to_string([CASE WHEN r[1] = 'ß' THEN 'Ss' ELSE upper(r[1]) END || substr(r, 2) for r in "
        f"regexp_extract_all(lower({x}), '(\\p{{L}}+|[^\\p{{L}}]+)', 1)], '')"
    )


def sql_numbers(x: str) -> str:
    return f"[CAST(n AS DOUBLE) for n in regexp_extract_all({x}, '(\\d+\\.?\\d*)', 1)]"


def sql_level(x: str) -> str:
    return f"CASE WHEN {x} < 2 THEN 'Entry Level' WHEN {x} < 5 THEN 'Mid Level' WHEN {x} < 10 THEN 'Senior Level' ELSE 'Lead/Principal' END"


SQL_LAKHS = "[CASE WHEN v > 1000 THEN v / 100000.0 ELSE v END for v in " + sql_numbers("replace(lower(salary), ',', '')") + "]"

# Cleaned postings: merged by order, first value by (source file, row number).
POSTINGS_SQL = RAW_SQL + f""",
numbered AS (
  SELECT *, split_part(job_url, '?', 1) AS url,
    row_number() OVER (PARTITION BY split_part(job_url, '?', 1) ORDER BY source_file, row_no) AS rn
  FROM raw),
merged AS (
  SELECT url AS job_url, arg_min({sql_clean('job_title')}, rn) AS job_title,
    arg_min({sql_clean('company')}, rn) AS company, arg_min({sql_clean('job_description')}, rn) AS job_description,
    list_sort(list(DISTINCT p_name)) AS raw_skills,
    arg_min(experience_required, rn) FILTER (experience_required IS NOT NULL AND experience_required <> '') AS experience_required,
    arg_min(salary, rn) AS salary, arg_min(scraped_date, rn) AS scraped_date,
    arg_min(source_file, rn) AS source_file, arg_min(cluster_id, rn) AS cluster_id,
    arg_min(cluster_label, rn) AS cluster_label,
    list_sort(list_distinct(list({sql_city('city_text')}))) AS location,
    list_sort(list_distinct(list({sql_title('p_name')}))) AS skills
  FROM numbered GROUP BY url),
parsed AS (
  SELECT *, {sql_numbers('experience_required')} AS en,
    CASE WHEN NOT contains(salary, 'Not Disclosed') THEN {SQL_LAKHS} END AS sn
  FROM merged),
postings AS (
  SELECT job_url, job_title, company, job_description, raw_skills, location, skills, salary, scraped_date, source_file, cluster_id, cluster_label,
    coalesce(en[1], 0.0) AS experience_min,
    CASE WHEN len(en) >= 2 THEN en[2] WHEN len(en) = 1 THEN en[1] + 2.0 ELSE 0.0 END AS experience_max,
    {sql_level('coalesce(en[1], 0.0)')} AS experience_level,
    sn[1] AS salary_min, coalesce(sn[2], sn[1]) AS salary_max,
    (sn[1] + coalesce(sn[2], sn[1])) / 2 AS salary_mid
  FROM parsed)"""

PROFILES_SQL = f"""profiles AS (
  SELECT 'P' || c_custkey AS profile_id, {PROFILE_ROLE} AS "current_role", {TARGET_ROLE} AS target_role,
    {YEARS} AS years_experience, [{PROFILE_DEGREE}] AS education,
    coalesce(list_sort(list(DISTINCT p_name) FILTER (l_quantity > 40)), []) AS skills,
    [{PROFILE_CITY_1}, {PROFILE_CITY_2}] AS locations
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey
  LEFT JOIN part ON l_partkey = p_partkey
  GROUP BY c_custkey, c_mktsegment, c_acctbal, c_nationkey)"""
