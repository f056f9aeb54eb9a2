"""Cleaning and dictionary queries."""

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.tables import (
    CITY, POSTINGS_SQL, RAW_SQL, SQL_LAKHS, SQL_SPACE, SQL_WORD, postings, raw_postings,
    sql_city, sql_clean, sql_level, sql_numbers, sql_title, table,
)
from jobtide.functions import text as tx
from jobtide.operators import clean, skills
from jobtide.sources import dictionary as dic
from jobtide.sources import postings as src

def as_of():
    return F.lit("2001-11-05").cast("timestamp")



@query("p1_clean_text_cols", f"SELECT doc_id, {sql_clean('text')} AS cleaned FROM documents")
def p1(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.clean_text(F.col("text")).alias("cleaned"))


@query("p2_clean_text_light", f"""SELECT page_id,
  trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '[{SQL_SPACE}]+', ' ', 'g')) AS cleaned FROM pages""")
def p2(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.clean_text_light(F.col("html")).alias("cleaned"))


@query("p3_standardize_location", f"""WITH {RAW_SQL}
  SELECT job_url, source_file, row_no, {sql_city('city_text')} AS city FROM raw""")
def p3(spark, sf):
    raw = clean.standardize_locations(raw_postings(spark, sf))
    return raw.select("job_url", "source_file", "row_no", F.array_join("location", "|").alias("city"))


@query("p4_parse_experience", f"""WITH {RAW_SQL}, n AS (SELECT *, {sql_numbers('experience_required')} AS en FROM raw)
  SELECT job_url, source_file, row_no, coalesce(en[1], 0.0) AS experience_min,
    CASE WHEN len(en) >= 2 THEN en[2] WHEN len(en) = 1 THEN en[1] + 2 ELSE 0.0 END AS experience_max FROM n""")
def p4(spark, sf):
    raw = clean.parse_fields(raw_postings(spark, sf))
    return raw.select("job_url", "source_file", "row_no", "experience_min", "experience_max")


_SALARY_SQL = f"""WITH {RAW_SQL}, n AS (
    SELECT *, CASE WHEN NOT contains(salary, 'Not Disclosed') THEN {SQL_LAKHS} END AS sn FROM raw)"""


@query("p5_parse_salary", _SALARY_SQL + """
  SELECT job_url, source_file, row_no, sn[1] AS salary_min, coalesce(sn[2], sn[1]) AS salary_max FROM n""")
def p5(spark, sf):
    raw = clean.parse_fields(raw_postings(spark, sf))
    return raw.select("job_url", "source_file", "row_no", "salary_min", "salary_max")


@query("p6_salary_mid", _SALARY_SQL + """
  SELECT job_url, source_file, row_no, (sn[1] + coalesce(sn[2], sn[1])) / 2 AS salary_mid FROM n""")
def p6(spark, sf):
    return clean.parse_fields(raw_postings(spark, sf)).select("job_url", "source_file", "row_no", "salary_mid")


@query("p7_experience_level", f"""WITH {POSTINGS_SQL}
  SELECT experience_level, count(*) AS postings FROM postings GROUP BY 1""")
def p7(spark, sf):
    return postings(spark, sf).groupBy("experience_level").agg(F.count(F.lit(1)).alias("postings"))


# Phrase dictionary: the first one to four words of each benchmark passage and
# its second word on its own.
DICTIONARY_SQL = r"""dictionary AS (
  SELECT DISTINCT skill FROM (
    SELECT unnest([regexp_extract(text, '^([\p{L}\p{N}_]+)', 1),
      regexp_extract(text, '^[\p{L}\p{N}_]+[^\p{L}\p{N}_]+([\p{L}\p{N}_]+)', 1),
      regexp_extract(text, '^([\p{L}\p{N}_]+[^\p{L}\p{N}_]+[\p{L}\p{N}_]+)', 1),
      regexp_extract(text, '^([\p{L}\p{N}_]+[^\p{L}\p{N}_]+[\p{L}\p{N}_]+[^\p{L}\p{N}_]+[\p{L}\p{N}_]+[^\p{L}\p{N}_]+[\p{L}\p{N}_]+)', 1)
    ]) AS skill FROM benchmark)
  WHERE length(skill) > 3)"""
# Word runs between marks: a phrase on word boundaries is then a plain substring.
def _marked(x):
    return f"chr(1) || regexp_replace(lower({x}), '([^{SQL_WORD}]+)', chr(1) || '\\1' || chr(1), 'g') || chr(1)"


HITS_SQL = DICTIONARY_SQL + f""", hits AS (
  SELECT doc_id, skill FROM (SELECT doc_id, {_marked('text')} AS t FROM documents)
  JOIN (SELECT skill, {_marked('skill')} AS s FROM dictionary) ON contains(t, s))"""


def phrase_dictionary(spark, sf):
    w, s = r"[\p{L}\p{N}_]+", r"[^\p{L}\p{N}_]+"
    shapes = [f"^({w})", f"^{w}{s}({w})", f"^({w}{s}{w})", f"^({w}{s}{w}{s}{w}{s}{w})"]
    found = F.array(*[F.regexp_extract("text", p, 1) for p in shapes])
    phrases = table(spark, sf, "benchmark").select(F.explode(found).alias("skill"))
    return phrases.where(F.length("skill") > 3).distinct()


@query("p8_extract_skills", f"""WITH {HITS_SQL}
  SELECT d.doc_id, coalesce(string_agg(skill, '|' ORDER BY skill), '') AS skills_extracted
  FROM documents d LEFT JOIN hits h ON d.doc_id = h.doc_id GROUP BY d.doc_id""")
def p8(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    out = skills.extract_skills(docs, phrase_dictionary(spark, sf), "doc_id", "text")
    return out.select("doc_id", F.array_join("skills_extracted", "|").alias("skills_extracted"))


@query("j4_match_dictionary", f"WITH {HITS_SQL} SELECT doc_id, skill FROM hits")
def j4(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return skills.match_dictionary(docs, phrase_dictionary(spark, sf), "doc_id", "text")


@query("p10_skills_text", f"""WITH {HITS_SQL}
  SELECT d.doc_id, coalesce(string_agg(skill, ', ' ORDER BY skill), '') AS skills_text, CAST(count(skill) AS INTEGER) AS num_skills
  FROM documents d LEFT JOIN hits h ON d.doc_id = h.doc_id GROUP BY d.doc_id""")
def p10(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    out = skills.extract_skills(docs, phrase_dictionary(spark, sf), "doc_id", "text")
    return out.select("doc_id", F.array_join("skills_extracted", ", ").alias("skills_text"), F.size("skills_extracted").alias("num_skills"))


def _sql_education(x: str) -> str:
    b, e = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"
    rows = [
        ("B.Tech/B.E", r"B\.?Tech|Bachelor of Engineering|Bachelor of Technology", r"B\.?E\.?"),
        ("Bachelor''s", r"Bachelors?|Degree|Undergraduate|B\.?Sc|B\.?Com", r"B\.?A"),
        ("M.Tech/M.E", r"M\.?Tech|Master of Engineering|Master of Technology", r"M\.?E\.?"),
        ("MBA", r"MBA|PGDM|Master of Business Administration", None),
        ("Master''s", r"Masters?|Postgraduate|M\.?Sc|M\.?Com", r"M\.?A"),
        ("PhD", r"PhD|Ph\.?D|Doctorate", None),
    ]
    out = []
    for label, free, strict in rows:
        test = f"regexp_matches({x}, '(?i){b}({free}){e}')"
        if strict:
            # A trailing dot needs a word character after it to be a boundary.
            test += f" OR regexp_matches({x}, '{b}({strict.removesuffix(chr(92) + '.?')}){e}')"
        out.append(f"CASE WHEN {test} THEN '{label}' END")
    return f"array_to_string([v for v in [{', '.join(out)}] if v IS NOT NULL], '|')"


@query("p9_extract_education", f"""WITH {RAW_SQL}
  SELECT job_url, source_file, row_no, {_sql_education('job_description')} AS education FROM raw""")
def p9(spark, sf):
    raw = raw_postings(spark, sf)
    return raw.select("job_url", "source_file", "row_no", F.array_join(tx.education(F.col("job_description")), "|").alias("education"))


# Skill cells as comma text: words of a document.
@query("p11_normalize_skill_list", f"""WITH parts AS (
    SELECT doc_id, {sql_title('trim(w)')} AS skill
    FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) WHERE w <> '')
  SELECT doc_id, string_agg(skill, '|' ORDER BY skill) AS skills FROM (SELECT DISTINCT doc_id, skill FROM parts) GROUP BY doc_id""")
def p11(spark, sf):
    docs = table(spark, sf, "documents")
    listed = tx.normalize_skills(F.split("text", " "))
    return docs.select("doc_id", F.array_join(listed, "|").alias("skills")).where("skills <> ''")


@query("p12_choose_skill_column", f"""WITH {POSTINGS_SQL}
  SELECT 'skills_list' AS chosen, count(skills) AS filled FROM postings""")
def p12(spark, sf):
    jobs = postings(spark, sf)
    chosen = src.choose_column(jobs, src.STATS_SKILL_ORDER)
    return jobs.agg(F.lit(chosen).alias("chosen"), F.count(chosen).alias("filled"))


@query("p13_canonical_url", "SELECT page_id, split_part(url, '?', 1) AS url FROM pages")
def p13(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.canonical_url(F.col("url")).alias("url"))


_POSTING_FIELDS = ["job_url", "job_title", "company", "experience_min", "experience_max", "experience_level",
                   "salary_min", "salary_max", "salary_mid", "scraped_date", "source_file"]
_POSTING_SELECT = ", ".join(_POSTING_FIELDS) + ", array_to_string(location, '|') AS location"


@query("g1_merge_duplicates", f"WITH {POSTINGS_SQL} SELECT {_POSTING_SELECT} FROM postings")
def g1(spark, sf):
    jobs = clean.clean_postings(raw_postings(spark, sf))
    return jobs.select(*_POSTING_FIELDS, F.array_join("location", "|").alias("location"))


@query("g2_drop_duplicate_urls", f"""WITH {RAW_SQL}, ranked AS (
    SELECT *, row_number() OVER (PARTITION BY job_url ORDER BY source_file, row_no) AS rn FROM raw)
  SELECT job_url, job_title, company, salary, row_no FROM ranked WHERE rn = 1""")
def g2(spark, sf):
    raw = raw_postings(spark, sf).drop("job_description")
    return clean.drop_duplicate_urls(raw).select("job_url", "job_title", "company", "salary", "row_no")


@query("g3_merge_locations_by_key", f"""WITH {RAW_SQL}
  SELECT split_part(job_url, '?', 1) AS job_url, string_agg(DISTINCT city_text, '|' ORDER BY city_text) AS location FROM raw GROUP BY 1""")
def g3(spark, sf):
    found = raw_postings(spark, sf).select(
        tx.canonical_url(F.col("job_url")).alias("job_url"), F.element_at("location", 1).alias("location"))
    return clean.merge_search_locations(found).select("job_url", F.array_join("location", "|").alias("location"))


@query("l5_filter_fresh", f"""WITH {POSTINGS_SQL}
  SELECT job_url, scraped_date FROM postings WHERE scraped_date >= TIMESTAMP '2001-11-05' - INTERVAL 400 DAY""")
def l5(spark, sf):
    return clean.filter_fresh(postings(spark, sf), as_of(), 400).select("job_url", "scraped_date")


@query("i5_expire_stale", """SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 14 DAY""")
def i5(spark, sf):
    as_of = F.lit("2024-01-31").cast("timestamp")
    return clean.filter_fresh(table(spark, sf, "events"), as_of, column="ts").select("event_id", "ts")


# The cleaning job over whole postings with a dictionary of part names.
E1_SQL = POSTINGS_SQL + f""",
described AS (
  SELECT url AS job_url, arg_min({sql_clean('job_title')} || ' ' || {sql_clean('job_description')}, rn) AS full_text,
    arg_min({sql_clean('job_description')}, rn) AS description FROM numbered GROUP BY url),
names AS (SELECT DISTINCT p_name AS skill FROM part),
found AS (
  SELECT job_url, string_agg(skill, ', ' ORDER BY skill) AS skills_text, count(*) AS n
  FROM described JOIN names ON contains(lower(' ' || full_text || ' '), ' ' || skill || ' ') GROUP BY job_url)"""


def cleaned_with_skills(spark, sf, as_of=None, days=14):
    names = table(spark, sf, "part").select(F.col("p_name").alias("skill")).distinct()
    return clean.clean_postings(raw_postings(spark, sf), names, as_of=as_of, horizon_days=days)


@query("e1_clean_postings", f"""WITH {E1_SQL}
  SELECT p.job_url, p.job_title, p.company, p.experience_min, p.experience_level, p.salary_mid, p.scraped_date,
    array_to_string(location, '|') AS location, coalesce(skills_text, '') AS skills_text,
    CAST(coalesce(n, 0) AS INTEGER) AS num_skills, {_sql_education('description')} AS education
  FROM postings p JOIN described USING (job_url) LEFT JOIN found USING (job_url)
  WHERE scraped_date >= TIMESTAMP '2001-11-05' - INTERVAL 1000 DAY""")
def e1(spark, sf):
    jobs = cleaned_with_skills(spark, sf, as_of(), 1000)
    return jobs.select(
        "job_url", "job_title", "company", "experience_min", "experience_level", "salary_mid", "scraped_date",
        F.array_join("location", "|").alias("location"), "skills_text", "num_skills",
        F.array_join("education_extracted", "|").alias("education"))
