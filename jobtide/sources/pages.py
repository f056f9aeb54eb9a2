"""Posting rows from crawled pages held as a table (url, html)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide.functions import text as tx

# The page state's variable, its nesting and its posting keys.
STATE_MARKER = "window._initialState = "
STATE_SCHEMA = (
    "searchPageState struct<details: struct<jobTuple: array<struct<"
    "title: string, companyName: string, location: string, experience: string, tagsAndSkills: string, "
    "jobDescription: string, salaryRange: string, footerPlaceholderLabel: string, jdURL: string>>>>"
)
NOT_DISCLOSED = "Not Disclosed"

# Class names of a job card and its fields.
CARD_PATTERN = r'(?s)(<[^<>]+class="job-listing".*?)(?=<[^<>]+class="job-listing"|\z)'
CARD_FIELDS = {
    "job_title": r'(?s)class="job-title"[^>]*>(.*?)</',
    "company": r'(?s)class="company-name"[^>]*>(.*?)</',
    "experience_required": r'(?s)class="exp"[^>]*>(.*?)</',
    "job_url": r'<a[^>]+href="([^"]*)"',
}
CARD_SKILLS = r'(?s)class="skill"[^>]*>(.*?)</'


def postings_in_state(pages: DataFrame, marker: str = STATE_MARKER, source: str = "portal", compat: bool = False) -> DataFrame:
    """One row per posting of the JSON state embedded in each page.

    The state runs to the script's end; with ``compat`` it is cut at the first
    semicolon, which loses pages whose state holds one. Pages without a readable
    state give no row.
    """
    ending = "([^;]*)" if compat else r"(.*?);\s*</script"
    state = F.from_json(F.regexp_extract("html", r"(?s)\Q" + marker + r"\E" + ending, 1), STATE_SCHEMA)
    jobs = pages.select(*[c for c in pages.columns if c != "html"], F.inline(state["searchPageState"]["details"]["jobTuple"]))
    return jobs.select(
        *[c for c in pages.columns if c != "html"],
        F.col("title").alias("job_title"), F.col("companyName").alias("company"), "location",
        F.col("experience").alias("experience_required"), F.col("tagsAndSkills").alias("skills_list"),
        tx.clean_text_light(F.col("jobDescription")).alias("job_description"),
        F.coalesce("salaryRange", F.lit(NOT_DISCLOSED)).alias("salary"),
        F.col("footerPlaceholderLabel").alias("posted_date"), F.col("jdURL").alias("job_url"), F.lit(source).alias("source"),
    )


def postings_in_cards(
    pages: DataFrame, card: str = CARD_PATTERN, fields: dict[str, str] = CARD_FIELDS,
    skills: str = CARD_SKILLS, base_url: str = "", source: str = "cards",
) -> DataFrame:
    """One row per job card of each page; absent fields read ``N/A``."""
    keep = [c for c in pages.columns if c != "html"]
    cards = pages.select(*keep, F.posexplode(F.regexp_extract_all("html", F.lit(card), 1)).alias("card_no", "card"))
    found = {name: F.regexp_extract("card", pattern, 1) for name, pattern in fields.items()}
    value = {name: F.when(F.col("card").rlike(fields[name]), tx.clean_text_light(x)).otherwise("N/A") for name, x in found.items()}
    value["job_url"] = F.when(F.col("card").rlike(fields["job_url"]), F.concat(F.lit(base_url), found["job_url"])).otherwise("N/A")
    return cards.select(
        *keep, "card_no", *[value[n].alias(n) for n in fields],
        F.transform(F.regexp_extract_all("card", F.lit(skills), 1), F.trim).alias("skills_list"),
        F.lit(NOT_DISCLOSED).alias("salary"), F.lit(source).alias("source"),
    )
