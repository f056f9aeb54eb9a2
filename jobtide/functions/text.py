"""Column expressions that derive posting fields from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobtide import dims

# Java's \s and \w are ASCII; these classes cover Unicode blanks and letters.
SPACE = r"\s\x1c-\x1f\x85\p{Z}"
WORD = r"\p{L}\p{N}_"


def clean_text_light(text: Column) -> Column:
    """Drop tags, collapse blanks. Null becomes ''."""
    bare = F.regexp_replace(text, r"<[^>]+>", "")
    return F.coalesce(F.trim(F.regexp_replace(bare, f"[{SPACE}]+", " ")), F.lit(""))


def clean_text(text: Column) -> Column:
    """Drop tags and every character outside words, blanks and ``. , - & /``."""
    bare = F.regexp_replace(text, r"<[^>]+>", "")
    kept = F.regexp_replace(bare, rf"[^{WORD}{SPACE}.,\-&/]", "")
    return F.coalesce(F.trim(F.regexp_replace(kept, f"[{SPACE}]+", " ")), F.lit(""))


def canonical_url(url: Column) -> Column:
    """The URL without its query part."""
    return F.substring_index(url, "?", 1)


def text_list(text: Column) -> Column:
    """``['a', 'b']`` written as text -> array; other text -> one-element array."""
    return F.when(
        text.startswith("[") & text.endswith("]"),
        F.coalesce(F.from_json(text, "array<string>"), F.array(text)),
    ).when(text.isNotNull(), F.array(text))


def capitalize(text: Column) -> Column:
    """First character upper, the rest lower."""
    first = F.upper(F.substring(text, 1, 1))
    return F.concat(F.substring(first, 1, 1), F.lower(F.concat(F.substring(first, 2, 9), F.substring(text, 2, 1 << 30))))


def standard_location(locations: Column) -> Column:
    """Map each location of an array to its city; sorted and distinct. Null -> [Other]."""

    def one(loc: Column) -> Column:
        low = F.lower(loc)
        expr = None
        for alias, city in dims.LOCATION_ALIASES:
            hit = low.contains(alias)
            expr = F.when(hit, F.lit(city)) if expr is None else expr.when(hit, F.lit(city))
        return expr.otherwise(capitalize(loc))

    known = F.filter(locations, lambda x: x.isNotNull())
    return F.coalesce(
        F.array_sort(F.array_distinct(F.transform(known, one))),
        F.array(F.lit("Other")),
    )


def numbers(text: Column) -> Column:
    """All decimal numbers of a text as doubles."""
    return F.regexp_extract_all(text, F.lit(r"(\d+\.?\d*)"), 1).cast("array<double>")


def experience_range(text: Column) -> Column:
    """struct(min, max) of years: two numbers, or one number and two more; else zeros."""
    nums = numbers(text)
    low = F.when(F.size(nums) >= 1, F.get(nums, 0)).otherwise(0.0)
    high = (
        F.when(F.size(nums) >= 2, F.get(nums, 1))
        .when(F.size(nums) == 1, F.get(nums, 0) + 2.0)
        .otherwise(0.0)
    )
    return F.struct(low.alias("min"), high.alias("max"))


def experience_level(years: Column) -> Column:
    return (
        F.when(years < 2, "Entry Level")
        .when(years < 5, "Mid Level")
        .when(years < 10, "Senior Level")
        .otherwise("Lead/Principal")
    )


def salary_range(text: Column) -> Column:
    """struct(min, max) in lakhs a year; numbers above 1000 are rupees. Null if undisclosed."""
    digits = F.regexp_replace(F.lower(text), ",", "")
    lakhs = F.transform(numbers(digits), lambda v: F.when(v > 1000, v / 100000.0).otherwise(v))
    lakhs = F.when(~text.contains("Not Disclosed"), lakhs)
    low = F.when(F.size(lakhs) >= 1, F.get(lakhs, 0))
    high = F.when(F.size(lakhs) >= 2, F.get(lakhs, 1)).otherwise(low)
    return F.struct(low.alias("min"), high.alias("max"))


def title_case(text: Column) -> Column:
    """Upper-case every letter that follows a non-letter, lower-case the others.

    ``initcap`` splits at blanks only and would give ``A/b Testing``. A text of one run of ASCII letters, and no letter after
    it, is not cut into runs.
    """
    low = F.lower(text)
    runs = F.regexp_extract_all(low, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    one = F.concat(F.upper(F.substring(low, 1, 1)), F.substring(low, 2, 1 << 30))
    return F.when(low.rlike(r"^[a-z]+[ -@\[-`{-~]*$"), one).otherwise(F.array_join(F.transform(runs, capitalize), ""))


def normalize_skills(skills: Column) -> Column:
    """Trimmed, title-cased, distinct, sorted skills of an array. Null -> empty."""
    kept = F.filter(skills, lambda s: s.isNotNull() & (s != ""))
    named = F.transform(kept, lambda s: title_case(F.trim(s)))
    return F.coalesce(F.array_sort(F.array_distinct(named)), F.array().cast("array<string>"))


def skill_text_list(text: Column) -> Column:
    """A skill cell held as text: ``['a', 'b']`` or ``a, b`` -> array of names."""
    parts = F.transform(F.split(text, ","), lambda s: F.regexp_replace(s, r"^[ '\"]+|[ '\"]+$", ""))
    return F.when(
        text.startswith("[") & text.endswith("]"),
        F.coalesce(F.from_json(text, "array<string>"), parts),
    ).otherwise(parts)


def education(text: Column, compat: bool = False) -> Column:
    """Sorted degree labels found in a text.

    The two-letter degrees need capitals, unless ``compat`` is set: then "be"
    and "me" count as degrees.
    """
    found = []
    for label, patterns in sorted(dims.EDUCATION_PATTERNS.items()):
        free = [p for p in patterns if compat or p not in dims.TWO_LETTER_DEGREES]
        strict = [p for p in patterns if p not in free]
        hit = text.rlike("(?i)(?U)(?:" + "|".join(free) + ")")
        if strict:
            hit = hit | text.rlike("(?U)(?:" + "|".join(strict) + ")")
        found.append(F.when(hit, F.lit(label)))
    return F.array_compact(F.array(*found))


def contains_any(text: Column, words: list[str]) -> Column:
    """True when one of the words occurs in the text, compared in lower case."""
    low = F.lower(text)
    hit = F.lit(False)
    for word in words:
        hit = hit | low.contains(word)
    return hit
