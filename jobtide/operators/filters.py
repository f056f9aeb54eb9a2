"""Row predicates over postings and the role bridge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide import dims


def role_matches(title: Column, role: str, regex: bool = False) -> Column:
    """The title contains the role, case ignored; a null title does not match."""
    if regex:
        hit = title.rlike("(?iU)" + role)
    else:
        hit = F.lower(title).contains(role.lower())
    return F.coalesce(hit, F.lit(False))


def location_is(locations: Column, name: str | None) -> Column:
    """The exact location is listed; ``All Locations`` or none means no filter."""
    if not name or name == "All Locations":
        return F.lit(True)
    return F.coalesce(F.array_contains(locations, name), F.lit(False))


def location_like(locations: Column, part: str | Column) -> Column:
    """Some listed location contains the text, case ignored."""
    wanted = F.lower(part if isinstance(part, Column) else F.lit(part))
    return F.coalesce(F.exists(locations, lambda x: F.lower(x).contains(wanted)), F.lit(False))


def location_preferred(locations: Column, preferred: Column) -> Column:
    """Some listed location equals a preferred one, case ignored; no preference lets all pass."""
    lower = lambda c: F.transform(c, F.lower)
    return (F.size(preferred) == 0) | F.coalesce(F.arrays_overlap(lower(locations), lower(preferred)), F.lit(False))


def experience_within(minimum: Column, years: Column, slack: int = 3) -> Column:
    return F.coalesce(minimum <= years + slack, F.lit(False))


def is_real_cluster(label: Column) -> Column:
    """Not the label of an error page; an unlabelled row stays."""
    return F.coalesce(~label.rlike("(?i)error|000"), F.lit(True))


def drop_missing(df: DataFrame, *columns: str) -> DataFrame:
    """Rows whose columns are filled: not null, and no empty text or list."""
    for name in columns:
        kind = df.schema[name].dataType.typeName()
        keep = F.col(name).isNotNull()
        if kind == "string":
            keep = keep & (F.col(name) != "")
        elif kind == "array":
            keep = keep & (F.size(name) > 0)
        df = df.where(keep)
    return df


#: Bits of the map of phrase heads.
HEAD_BITS = 1 << 16


def contained_phrases(texts: DataFrame, key: str, text_col: str, phrases: DataFrame, phrase_col: str, head: int = 4) -> DataFrame:
    """(key, phrase, at): every phrase contained in a text, in lower case, with a position.

    A containment join as two equi-joins. The first ``head`` characters of the
    phrases are looked up among the text's substrings, which gives the phrase
    lengths worth cutting at that position; the cut is then compared for
    equality. Heads and phrases are unique, so neither join can multiply, and a
    row carries at most one phrase length of text. A bitmap of the heads' hashes (8 KB, whatever
    their number) is tested inside the row, so that hardly any position without a hit becomes a row.
    """
    wanted = phrases.select(F.lower(phrase_col).alias("phrase")).where("phrase <> ''").distinct()
    heads = wanted.groupBy(F.substring("phrase", 1, head).alias("head")).agg(
        F.collect_set(F.length("phrase")).alias("lengths")
    )
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(HEAD_BITS))
    bits = heads.select(place(F.col("head")).alias("h")).groupBy(F.expr("h div 64").alias("w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.expr("cast(h % 64 as int)"))).alias("b"))
    words = bits.agg(F.map_from_entries(F.collect_list(F.struct("w", "b"))).alias("m")).select(F.transform(
        F.sequence(F.lit(0), F.lit(HEAD_BITS // 64 - 1)), lambda i: F.coalesce(F.try_element_at("m", i.cast("long")), F.lit(0).cast("long"))).alias("bits"))
    sizes = wanted.agg(F.struct(
        F.max(F.length("phrase")).alias("longest"),
        F.collect_set(F.least(F.length("phrase"), F.lit(head))).alias("heads"),
    ).alias("s"))
    low = texts.where(F.length(text_col) > 0).select(F.col(key), F.lower(text_col).alias("_low")).withColumns(
        {"_s": sizes.scalar(), "_bits": words.scalar()})

    def known(piece: Column) -> Column:
        word = F.get(F.col("_bits"), (place(piece) / 64).cast("int"))
        return F.call_function("getbit", word, (place(piece) % 64).cast("int")) == 1

    def pieces(n: Column) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.length("_low")), lambda i: known(F.substring(F.col("_low"), i, n)))
        return F.transform(at, lambda i: F.struct(
            i.alias("at"), F.substring(F.col("_low"), i, n).alias("head"), F.substring(F.col("_low"), i, F.col("_s.longest")).alias("piece")))

    pieces_of = low.select(key, F.inline(F.flatten(F.transform(F.col("_s.heads"), pieces))))
    return (
        pieces_of.join(heads, "head")
        .select(key, "at", "piece", F.explode("lengths").alias("n"))
        .select(key, "at", F.expr("substring(piece, 1, n)").alias("phrase"))
        .groupBy(key, "phrase").agg(F.min("at").alias("at"))
        .join(wanted, "phrase")
        .select(key, "phrase", "at")
    )


def role_titles(postings: DataFrame, roles: DataFrame, role_col: str = "role") -> DataFrame:
    """(role, job_title): which distinct titles contain which role.

    Built from distinct titles, so its size does not follow the number of postings.
    """
    named = roles.select(F.col(role_col).alias("role")).distinct()
    titles = postings.select("job_title").distinct()
    found = contained_phrases(titles, "job_title", "job_title", named, "role")
    return found.join(named.withColumn("phrase", F.lower("role")), "phrase").select("role", "job_title")


def by_role(postings: DataFrame, roles: DataFrame, role_col: str = "role") -> DataFrame:
    """Postings with the role their title contains, once per role."""
    return postings.join(role_titles(postings, roles, role_col), "job_title")


def check_sufficiency(requests: DataFrame, postings: DataFrame, min_role: int = dims.MIN_ROLE_POSTINGS, min_location: int = dims.MIN_LOCATION_POSTINGS) -> DataFrame:
    """For each (role, location) request: enough postings? with the reason in words.

    Postings are counted by title and location list before they meet a role.
    """
    grouped = postings.groupBy("job_title", "location").count()
    tagged = by_role(grouped, requests.where(F.col("role").isNotNull()))
    totals = tagged.groupBy("role").agg(F.sum("count").alias("n_role"))
    local = (
        requests.where(F.col("role").isNotNull() & F.col("location").isNotNull())
        .select("role", F.col("location").alias("wanted")).distinct()
        .join(tagged, "role")
        .where(location_like(F.col("location"), F.col("wanted")))
        .groupBy("role", F.col("wanted").alias("location"))
        .agg(F.sum("count").alias("n_local"))
    )
    counted = (
        requests.join(totals, "role", "left").join(local, ["role", "location"], "left")
        .fillna(0, ["n_role", "n_local"])
    )
    no_role, no_location = F.col("role").isNull(), F.col("location").isNull()
    few_role = F.col("n_role") < min_role
    few_local = ~no_location & (F.col("n_local") < min_location)
    local_text = F.when(no_location, F.lit("N/A")).otherwise(F.col("n_local").cast("string"))
    reason = (
        F.when(no_role, F.lit("No specific role detected."))
        .when(few_role, F.format_string(f"Low data for '%s' (%d found, need {min_role})", "role", "n_role"))
        .when(few_local, F.format_string(f"Low data for '%s' in '%s' (%d found, need {min_location})", "role", "location", "n_local"))
        .otherwise(F.format_string("Sufficient data available.%d matches for role, %s matches for location.", F.col("n_role"), local_text))
    )
    return counted.withColumns({"is_sufficient": no_role | ~(few_role | few_local), "reason": reason})
