"""Dictionary skills in texts.

A skill that begins and ends with a word character occurs on word boundaries
exactly when some span of consecutive word and non-word runs, from a word run
to a word run, equals it. So the containment test is an equality on spans:
either an equi-join (any dictionary) or a set intersection inside the row
(dictionary of bounded size), never text times dictionary.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.functions.text import WORD
from jobtide.session import broadcast_if_small, cut_lineage
from jobtide.sources.dictionary import usable_skills

RUN = rf"([{WORD}]+|[^{WORD}]+)"
EDGED = rf"(?s)^[{WORD}](.*[{WORD}])?$"
MAX_LITERAL_SKILLS = 5_000


def _runs(text: Column) -> Column:
    """Lower-cased runs of a text; words at odd positions, separators between them."""
    trimmed = F.regexp_replace(F.lower(text), rf"^[^{WORD}]+", "")
    return F.regexp_extract_all(trimmed, F.lit(RUN), 1)


def _unedged(dictionary: DataFrame) -> DataFrame:
    """(skill, word) of entries such as ``C++`` that do not begin and end with a word character.

    They have no span. ``word`` is their first word run in lower case, null if they have none.
    """
    rows = usable_skills(dictionary).where(~F.lower("skill").rlike(EDGED)).select("skill")
    word = F.regexp_extract(F.lower("skill"), rf"[{WORD}]+", 0)
    return rows.withColumn("word", F.when(word != "", word))


def _unedged_hits(docs: DataFrame, others: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, skill) of unedged entries: documents that hold an entry's first word, then its own pattern.

    Entries without any word cannot be looked up; they are tested in blocks of patterns.
    """
    text = F.lower(text_col)
    words = docs.select(id_col, F.col(text_col).alias("_text"), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(rf"([{WORD}]+)"), 1))).alias("word"))
    pattern = F.concat(F.lit(r"(?iU)\b\Q"), "skill", F.lit(r"\E\b"))
    # The word of the entry may be part of a longer one in the text only if the pattern fails, so equality is enough.
    hits = words.join(others.where("word IS NOT NULL"), "word").where(F.rlike(F.col("_text"), pattern)).select(id_col, "skill")
    signs = sorted(r["skill"] for r in others.where("word IS NULL").collect())
    for at in range(0, len(signs), MAX_LITERAL_SKILLS):
        hits = hits.union(docs.select(id_col, F.explode(_pattern_hits(F.col(text_col), signs[at : at + MAX_LITERAL_SKILLS]))))
    return hits


def _pattern_hits(text: Column, names: list[str]) -> Column:
    tests = [F.when(text.rlike(r"(?iU)\b\Q" + n + r"\E\b"), F.lit(n)) for n in names]
    return F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")


def _keyed(dictionary: DataFrame) -> DataFrame:
    """(key, words, skill) of the entries the span test covers."""
    return (
        usable_skills(dictionary)
        .select(F.lower("skill").alias("key"), "skill")
        .where(F.col("key").rlike(EDGED))
        .withColumn("words", F.size(F.regexp_extract_all("key", F.lit(rf"([{WORD}]+)"), 1)))
    )


def match_dictionary(docs: DataFrame, dictionary: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, skill): every dictionary skill that occurs in the text, once per document.

    Each document is expanded to its distinct spans of at most as many words as
    the longest entry has, and the spans meet the entries in one equi-join. The
    dictionary is broadcast only if its row count is small.
    """
    keyed = _keyed(dictionary)
    longest = keyed.agg(F.max("words")).first()[0] or 1

    def all_spans(runs: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(runs), F.lit(2))
        longer = [F.transform(at, lambda i: _span(runs, i, n)) for n in range(2, longest + 1)]
        return F.array_distinct(F.concat(runs, *longer))

    runs = F.filter(F.array(_runs(F.col(text_col))), lambda r: F.size(r) > 0)
    spans = docs.select(id_col, F.explode(F.flatten(F.transform(runs, all_spans))).alias("key"))
    hits = spans.join(broadcast_if_small(keyed.select("key", "skill")), "key").select(id_col, "skill")
    return hits.union(_unedged_hits(docs, _unedged(dictionary), id_col, text_col)).distinct()


def _span(runs: Column, start: Column, words: int) -> Column:
    """The span of so many words that begins at a word run."""
    return F.array_join(F.slice(runs, start, 2 * words - 1), "")


def extract_skills(
    docs: DataFrame, dictionary: DataFrame, id_col: str, text_col: str, out: str = "skills_extracted"
) -> DataFrame:
    """Add the sorted array of dictionary skills that occur in the text.

    Entries are matched inside the row while at most ``MAX_LITERAL_SKILLS`` have to be put into the
    plan. Beyond that the rows are numbered, matched by :func:`match_dictionary` and
    joined back by number. Both ways give the same row for a row, whatever its id.
    """
    entries = usable_skills(dictionary).select("skill").limit(MAX_LITERAL_SKILLS + 1).collect()
    if len(entries) > MAX_LITERAL_SKILLS:
        rows = cut_lineage(docs.withColumn("_row", F.monotonically_increasing_id()))
        hits = match_dictionary(rows.select("_row", text_col), dictionary, "_row", text_col)
        found = hits.groupBy("_row").agg(F.array_sort(F.collect_set("skill")).alias(out))
        empty = F.array().cast("array<string>")
        return rows.join(found, "_row", "left").withColumn(out, F.coalesce(out, empty)).drop("_row")
    names = sorted(e["skill"] for e in entries)
    edged = [n for n in names if re.fullmatch(r"(?s)\w(.*\w)?", n.lower())]
    found = skills_in(F.col(text_col), [(n.lower(), n) for n in edged])
    others = sorted(set(names) - set(edged))
    if others:
        found = F.array_sort(F.array_union(found, _pattern_hits(F.col(text_col), others)))
    return docs.withColumn(out, found)


def skills_in(text: Column, entries: list[tuple[str, str]]) -> Column:
    """Sorted skills of a bounded list of (lower-cased key, skill) found in a text."""
    empty = F.array().cast("array<string>")
    if not entries:
        return empty
    spellings: dict[str, list[str]] = {}
    for key, skill in sorted(entries):
        spellings.setdefault(key, []).append(skill)
    by_length: dict[int, list[str]] = {}
    for key in spellings:
        by_length.setdefault(len(_split_words(key)), []).append(key)
    literals = lambda values: F.array(*[F.lit(v) for v in sorted(set(values))])
    names = F.create_map(*[
        c for k in sorted(spellings) for c in (F.lit(k), literals(spellings[k]))
    ])

    # A lambda body is evaluated per element, so shared values are bound first.
    def hits(runs: Column, n: int) -> Column:
        keys = literals(by_length[n])
        if n == 1:
            return F.array_intersect(runs, keys)
        heads = literals(_split_words(k)[0] for k in by_length[n])

        def spans(seen: Column) -> Column:
            at = F.filter(
                F.sequence(F.lit(1), F.size(runs), F.lit(2)),
                lambda i: F.array_contains(seen, F.element_at(runs, i)),
            )
            found = F.array_intersect(F.transform(at, lambda i: _span(runs, i, n)), keys)
            return F.when(F.size(seen) > 0, found).otherwise(empty)

        return _let(F.array_intersect(runs, heads), spans)

    def all_hits(runs: Column) -> Column:
        found = F.concat(*[hits(runs, n) for n in sorted(by_length)])
        return F.when(F.size(runs) > 0, F.flatten(F.transform(found, lambda k: names[k])))

    return F.coalesce(F.array_sort(_let(_runs(text), all_hits)), empty)


def _split_words(key: str) -> list[str]:
    return re.findall(r"\w+", key)


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``."""
    return F.get(F.transform(F.array(value), body), 0)
