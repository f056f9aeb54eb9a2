"""Market statistics over postings.

Functions take ``by``, the grouping columns (none for the whole table). Per-role
statistics come from ``roles``: postings are first reduced by their title, then
meet the role through the title bridge, so that one popular title never sends
all its postings to one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobtide.functions.stats import t_pvalue, welch
from jobtide.functions.text import normalize_skills
from jobtide.operators.columns import IMPACT_SKILL_ORDER, STATS_SKILL_ORDER, chosen_skills
from jobtide.operators.filters import role_titles
from jobtide.session import broadcast_if_small, cut_lineage

SKILLS = "skills_list"


def top_n(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group, with their rank.

    Spark keeps at most ``n`` rows per group and task before the shuffle.
    """
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on grouping columns, where null is a group of its own."""
    other = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return left.join(other, same, how).drop(*[f"_{k}" for k in keys])


def value_counts(df: DataFrame, column: str, n: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Counts per value, most frequent first, ties by value; the first ``n`` per group."""
    counts = drop_null(df, column).groupBy(*by, column).agg(F.count(F.lit(1)).alias("count"))
    order = [F.col("count").desc(), F.col(column)]
    if n is None:
        return counts
    if by:
        return top_n(counts, by, order, n)
    return counts.orderBy(*order).limit(n)


def drop_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull())


def explode_skills(postings: DataFrame, keep: Sequence[str] = (), skills_col: str = SKILLS) -> DataFrame:
    """One row per posting and normalised skill."""
    skills = F.explode(normalize_skills(F.col(skills_col))).alias("skill_name")
    return postings.select(*keep, skills).where("skill_name <> ''")


def _rate(n: Column, total: Column) -> Column:
    return n / total * 100


def skill_frequency(postings: DataFrame, by: Sequence[str] = (), skills_col: str | None = None, roles: DataFrame | None = None) -> DataFrame:
    """Per group and skill: count, mean salary, and the share of all the group's postings.

    Postings without skills count in the share's denominator. Extracted skills go before listed ones, unless a column is named.
    """
    postings, skills_col = chosen_skills(postings, skills_col, STATS_SKILL_ORDER)
    if roles is not None:
        keys, skills, totals = _role_skills(postings, by, skills_col, roles)
    else:
        keys = list(by)
        skills = explode_skills(postings, [*keys, "salary_mid"], skills_col).groupBy(*keys, "skill_name").agg(*_skill_sums())
        totals = postings.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
    counted = join_groups(skills, totals, keys) if keys else skills.withColumn("_total", totals.scalar())
    return counted.select(
        *keys, "skill_name", "count",
        F.when(F.col("_paid") > 0, F.col("_salary") / F.col("_paid")).alias("avg_salary"),
        _rate(F.col("count"), F.col("_total")).alias("percentage"),
    )


def _skill_sums() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("count"),
        F.sum("salary_mid").alias("_salary"),
        F.count("salary_mid").alias("_paid"),
    ]


def _role_skills(postings: DataFrame, by: Sequence[str], skills_col: str, roles: DataFrame) -> tuple[list[str], DataFrame, DataFrame]:
    """Grouping columns, sums per skill and totals per role, from one pass over the postings.

    Each posting counts once under a null skill, which gives totals and titles
    too. The sums by title are stored, as three joins read them.
    """
    names = F.filter(normalize_skills(F.col(skills_col)), lambda s: s != "")
    marked = F.explode(F.concat(F.array(F.lit(None).cast("string")), names)).alias("skill_name")
    rows = postings.select(*by, "job_title", "salary_mid", marked)
    sums = cut_lineage(rows.groupBy(*by, "job_title", "skill_name").agg(*_skill_sums()))
    tagged = sums.join(role_titles(sums, roles), "job_title")
    keys = [*by, "role"]
    skills = tagged.where("skill_name IS NOT NULL").groupBy(*keys, "skill_name").agg(
        *[F.sum(c).alias(c) for c in ("count", "_salary", "_paid")]
    )
    totals = tagged.where("skill_name IS NULL").groupBy(*keys).agg(F.sum("count").alias("_total"))
    return keys, skills, totals


def top_skills(frequency: DataFrame, n: int, by: Sequence[str] = ()) -> DataFrame:
    """The ``n`` most frequent skills, of each group if there is one; ties by name."""
    order = [F.col("count").desc(), F.col("skill_name")]
    return top_n(frequency, by, order, n) if by else frequency.orderBy(*order).limit(n)


def emerging_skills(postings: DataFrame, n: int = 15, **kw) -> DataFrame:
    """The most demanded skills; the share stands for the growth rate."""
    frequency = skill_frequency(postings, **kw).withColumn("growth_rate", F.col("percentage"))
    return top_skills(frequency, n, kw.get("by", ()))


def daily_skills(postings: DataFrame, skills_col: str | None = None, date: str = "scraped_date") -> DataFrame:
    """(day, skill_name, n): postings of each day with each skill; under a null skill all postings of the day."""
    postings, skills_col = chosen_skills(postings, skills_col, STATS_SKILL_ORDER)
    names = F.filter(normalize_skills(F.col(skills_col)), lambda x: x != "")
    rows = postings.where(F.col(date).isNotNull()).select(
        F.to_date(date).alias("day"), F.explode(F.concat(F.array(F.lit(None).cast("string")), names)).alias("skill_name"))
    return rows.groupBy("day", "skill_name").agg(F.count(F.lit(1)).alias("n"))


def store_daily_skills(postings: DataFrame, path: str, **kw) -> None:
    """Write the counts of the days in ``postings``, a folder for each; other days of the table stay as they are."""
    daily_skills(postings, **kw).repartition("day").write.partitionBy("day").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def skill_growth(daily: DataFrame, as_of: Column, days: int = 14, n: int | None = 15) -> DataFrame:
    """(skill_name, n_now, n_before, share_now, share_before, growth_rate) of two windows of ``days`` days.

    The later window ends with ``as_of``. Shares are percentages of the window's postings, the rate is the change of the share
    in percent; null for skills that are new. Skills go by rate (new ones first), then share and name. Only counts of
    the days of both windows are read.
    """
    age = F.datediff(as_of, "day")
    window = F.when(age.between(0, days - 1), "now").when(age.between(days, 2 * days - 1), "before")
    part = daily.where(age.between(0, 2 * days - 1)).withColumn("_w", window)
    count = lambda w, c: F.sum(F.when(F.col("_w") == w, F.col("n")).otherwise(0)).alias(c)
    totals = part.where("skill_name IS NULL").agg(F.struct(count("now", "now"), count("before", "before")).alias("t")).scalar()
    sums = part.where("skill_name IS NOT NULL").groupBy("skill_name").agg(count("now", "n_now"), count("before", "n_before")).where("n_now > 0")
    share = lambda c, w: F.coalesce(_rate(F.col(c), F.nullif(F.col(f"_t.{w}"), F.lit(0))), F.lit(0.0))
    out = sums.withColumn("_t", totals).withColumns({"share_now": share("n_now", "now"), "share_before": share("n_before", "before")})
    out = out.withColumn("growth_rate", F.when(F.col("n_before") > 0, (F.col("share_now") / F.col("share_before") - 1) * 100)).drop("_t")
    if n is None:
        return out
    return out.orderBy(F.col("growth_rate").desc_nulls_first(), F.col("share_now").desc(), "skill_name").limit(n)


def skill_salary_impact(
    postings: DataFrame,
    by: Sequence[str] = (),
    skills: DataFrame | None = None,
    min_n: int = 3,
    positive_only: bool = True,
    skills_col: str | None = None,
) -> DataFrame:
    """Mean salary with and without each skill, the premium, and Welch's test of it.

    One pass: the moments without a skill are the group's moments minus those
    with it, so no skill scans the postings again. Membership is exact on
    normalised skills; ``skills`` (``skill_name``) limits the skills looked at.
    """
    postings, skills_col = chosen_skills(postings, skills_col, IMPACT_SKILL_ORDER)
    paid = postings.where(F.col("salary_mid").isNotNull())
    moments = [
        F.count(F.lit(1)).cast("double").alias("n"),
        F.avg("salary_mid").alias("mean"),
        F.var_pop("salary_mid").alias("var"),
    ]
    rows = explode_skills(paid, [*by, "salary_mid"], skills_col)
    if skills is not None:
        rows = rows.join(broadcast_if_small(skills.select("skill_name").distinct()), "skill_name", "left_semi")
    having = rows.groupBy(*by, "skill_name").agg(*moments)
    total = paid.groupBy(*by).agg(*[m.alias(f"t_{c}") for m, c in zip(moments, ("n", "mean", "var"))])
    if by:
        both = join_groups(having, total, by)
    else:
        packed = paid.agg(F.struct(*[m.alias(f"t_{c}") for m, c in zip(moments, ("n", "mean", "var"))]).alias("t"))
        both = having.withColumn("_t", packed.scalar()).select("*", "_t.*").drop("_t")

    n1, m1, t_n = F.col("n"), F.col("mean"), F.col("t_n")
    n2 = t_n - n1
    m2 = (F.col("t_mean") * t_n - m1 * n1) / n2
    delta = m1 - m2
    rest = F.col("t_var") * t_n - F.col("var") * n1 - delta * delta * n1 * n2 / t_n
    both = both.where((n1 >= min_n) & (n2 >= min_n)).withColumns({
        "_n2": n2,
        "_m2": m2,
        "_v1": F.col("var") * n1 / (n1 - 1),
        "_v2": F.greatest(rest, F.lit(0.0)) / (n2 - 1),
    })
    t, df = welch(n1, m1, F.col("_v1"), F.col("_n2"), F.col("_m2"), F.col("_v2"))
    out = both.select(
        *by, F.col("skill_name").alias("skill"),
        m1.alias("avg_salary_with"), F.col("_m2").alias("avg_salary_without"),
        (m1 - F.col("_m2")).alias("premium"), t.alias("t"), df.alias("df"), n1.cast("bigint").alias("count"),
    )
    if positive_only:
        out = out.where("premium > 0")
    return out.withColumn("p_value", t_pvalue("t", "df"))


def top_premiums(impact: DataFrame, n: int) -> DataFrame:
    return impact.orderBy(F.col("premium").desc(), F.col("skill")).limit(n)


def weighted_percentiles(df: DataFrame, by: Sequence[str], value: str, points: Sequence[float], exact: bool = True) -> DataFrame:
    """(group, p, n, mean, low, high): percentiles of a column per group.

    Equal values are counted first, so the exact percentile sees one entry per
    distinct value and group. ``exact=False`` uses a bounded sketch instead, for
    groups with very many distinct values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    levels = F.array(*[F.lit(p) for p in points])
    extra = [
        F.sum("_n").alias("n"),
        (F.sum(F.col(value) * F.col("_n")) / F.sum("_n")).alias("mean"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
    ]
    if exact:
        return counts.groupBy(*by).agg(F.percentile(value, levels, F.col("_n")).alias("p"), *extra)
    rough = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.percentile_approx(value, levels, 10_000).alias("p"))
    sums = counts.groupBy(*by).agg(*extra)
    return join_groups(sums, rough, by) if by else sums.withColumn("p", rough.scalar())


def salary_trends(postings: DataFrame, exact: bool = True) -> DataFrame:
    """Quartiles and mean of the salary: overall, by cluster and by experience level.

    One grouped pass; ``kind`` and ``name`` tell the group.
    """
    tags = F.array(
        F.struct(F.lit("global").alias("kind"), F.lit("all").alias("name")),
        F.struct(F.lit("cluster").alias("kind"), F.col("cluster_label").alias("name")),
        F.struct(F.lit("experience").alias("kind"), F.col("experience_level").alias("name")),
    )
    counted = postings.where(F.col("salary_mid").isNotNull()).groupBy("cluster_label", "experience_level", "salary_mid").count()
    rows = counted.select("salary_mid", "count", F.inline(tags)).where(F.col("name").isNotNull())
    if exact:
        spread = F.percentile("salary_mid", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("count"))
        return _quartiles(rows.groupBy("kind", "name").agg(
            spread.alias("p"), F.sum("count").alias("n"),
            (F.sum(F.col("salary_mid") * F.col("count")) / F.sum("count")).alias("mean")))
    plain = postings.where(F.col("salary_mid").isNotNull()).select("salary_mid", F.inline(tags)).where(F.col("name").isNotNull())
    return _quartiles(weighted_percentiles(plain, ["kind", "name"], "salary_mid", (0.25, 0.5, 0.75), exact=False))


def _quartiles(df: DataFrame) -> DataFrame:
    return df.select(
        "kind", "name", "n", "mean",
        F.get("p", 0).alias("p25"), F.get("p", 1).alias("p50"), F.get("p", 2).alias("p75"),
    )


def salary_benchmark(postings: DataFrame, requests: DataFrame, exact: bool = True) -> DataFrame:
    """Median, mean, lowest, highest and number of salaries per (role, location) request.

    A null location means all. A request that nothing matches gives zeros.
    """
    paid = postings.where(F.col("salary_mid").isNotNull())
    counted = paid.groupBy("job_title", "location", "salary_mid").count()
    wanted = requests.select("role", F.col("location").alias("wanted")).distinct()
    rows = (
        counted.join(role_titles(postings, requests), "job_title")
        .groupBy("role", "location", "salary_mid").agg(F.sum("count").alias("count"))
        .join(wanted, "role")
        .where(F.col("wanted").isNull() | F.exists("location", lambda x: F.lower(x) == F.lower("wanted")))
    )
    median = F.percentile("salary_mid", F.lit(0.5), F.col("count")) if exact else F.percentile_approx("salary_mid", 0.5)
    stats = rows.groupBy("role", "wanted").agg(
        median.alias("median"),
        (F.sum(F.col("salary_mid") * F.col("count")) / F.sum("count")).alias("mean"),
        F.min("salary_mid").alias("min"), F.max("salary_mid").alias("max"), F.sum("count").alias("count"),
    )
    filled = wanted.alias("w").join(stats.alias("s"), F.expr("w.role = s.role AND w.wanted <=> s.wanted"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return filled.select("w.role", F.col("w.wanted").alias("location"), *[zero(c) for c in ("median", "mean", "min", "max", "count")])


def salary_distribution(postings: DataFrame, by: Sequence[str] = (), exact: bool = True) -> DataFrame:
    """Box summary per group: quartiles, extremes, mean, count, and the 1.5-IQR fences."""
    box = weighted_percentiles(postings, by, "salary_mid", (0.25, 0.5, 0.75), exact)
    q1, q3 = F.get("p", 0), F.get("p", 2)
    return box.select(
        *by, "n", "mean", F.col("low").alias("min"), q1.alias("q1"), F.get("p", 1).alias("median"), q3.alias("q3"),
        F.col("high").alias("max"),
        (q1 - (q3 - q1) * 1.5).alias("lower_fence"), (q3 + (q3 - q1) * 1.5).alias("upper_fence"),
    )


def cluster_profile(postings: DataFrame, skills_col: str | None = None) -> DataFrame:
    """Per cluster: count, mean salary, five companies, five locations, ten skills."""
    postings, skills_col = chosen_skills(postings, skills_col, STATS_SKILL_ORDER)
    base = postings.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("count"), F.avg("salary_mid").alias("avg_salary"))
    kinds = [("company", 5), ("location", 5), ("skill", 10)]
    one = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    tagged = F.concat(
        F.array(one("company", F.col("company"))),
        F.transform(F.coalesce("location", F.array().cast("array<string>")), lambda x: one("location", x)),
        F.transform(normalize_skills(F.col(skills_col)), lambda x: one("skill", x)),
    )
    counts = postings.select("cluster_id", F.inline(tagged)).where(F.col("value").isNotNull()).groupBy("cluster_id", "kind", "value").agg(F.count(F.lit(1)).alias("n"))
    ranked = top_n(counts, ["cluster_id", "kind"], [F.col("n").desc(), F.col("value")], 10)
    lists = ranked.groupBy("cluster_id").agg(*[
        F.transform(
            F.array_sort(F.collect_list(F.when((F.col("kind") == kind) & (F.col("rank") <= n), F.struct("rank", "value")))),
            lambda x: x["value"],
        ).alias(f"top_{kind}s")
        for kind, n in kinds
    ])
    return base.join(lists, "cluster_id", "left")


def experience_alignment(profiles: DataFrame, postings: DataFrame, role_col: str = "target_role") -> DataFrame:
    """How each profile's years compare with the experience its target role asks for.

    The role's distribution is counted once (title, then role); profiles meet
    one row per distinct requirement of their role, never the postings.
    """
    counted = postings.where(F.col("experience_min").isNotNull()).groupBy("job_title", "experience_min").count()
    volume = counted.join(role_titles(postings, profiles, role_col), "job_title").groupBy("role", "experience_min").agg(F.sum("count").alias("n"))
    quartiles = F.percentile("experience_min", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n"))
    roles = volume.groupBy("role").agg(quartiles.alias("p"), F.sum("n").alias("n"))
    years = F.col("years_experience")
    reach = (
        profiles.select(F.col(role_col).alias("role"), "years_experience").distinct()
        .join(volume, "role")
        .groupBy("role", "years_experience")
        .agg((F.sum(F.when(F.col("experience_min") <= years + 1, F.col("n")).otherwise(0)) / F.sum("n") * 100).alias("accessible_pct"))
    )
    p25, p50, p75 = (F.get("p", i) for i in range(3))
    status = F.when(years < p25, "Under-qualified").when(years > p75 + 2, "Over-qualified").otherwise("Perfectly Matched")
    message = (
        F.when(years < p25, F.concat(F.lit("You are below the core market volume. 75% of available roles require at least "), p25.cast("string"), F.lit(" years of experience.")))
        .when(years > p75 + 2, F.concat(F.lit("You exceed the core market volume for this specific search. Most roles ("), p75.cast("string"), F.lit("%) require less experience than you have.")))
        .otherwise("Your experience perfectly aligns with the current peak market volume for this role.")
    )
    return (
        profiles.withColumn("role", F.col(role_col)).join(roles, "role").join(reach, ["role", "years_experience"])
        .select("profile_id", "role", "years_experience", p25.alias("market_p25"), p50.alias("market_p50"), p75.alias("market_p75"),
                status.alias("status"), message.alias("message"), "accessible_pct")
    )


def experience_histogram(postings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return drop_null(postings, "experience_min").groupBy(*by, "experience_min").agg(F.count(F.lit(1)).alias("count"))


def entry_experience(postings: DataFrame, roles: DataFrame, n: int = 10) -> DataFrame:
    """Mean of the ``n`` smallest experience requirements per role."""
    counted = postings.where(F.col("experience_min").isNotNull()).groupBy("job_title", "experience_min").count()
    volume = counted.join(role_titles(postings, roles), "job_title").groupBy("role", "experience_min").agg(F.sum("count").alias("n"))
    # At least one posting per distinct value, so n values always suffice.
    low = top_n(volume, ["role"], [F.col("experience_min")], n)
    before = Window.partitionBy("role").orderBy("experience_min").rowsBetween(Window.unboundedPreceding, -1)
    taken = low.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn(
        "_take", F.greatest(F.least(F.col("n"), F.lit(n) - F.col("_before")), F.lit(0))
    )
    return taken.groupBy("role").agg((F.sum(F.col("experience_min") * F.col("_take")) / F.sum("_take")).alias("entry_experience"))


def modal_cluster(postings: DataFrame, roles: DataFrame) -> DataFrame:
    """The most frequent cluster of each role, the smallest on ties."""
    counted = postings.where(F.col("cluster_id").isNotNull()).groupBy("job_title", "cluster_id").count()
    votes = counted.join(role_titles(postings, roles), "job_title").groupBy("role", "cluster_id").agg(F.sum("count").alias("n"))
    return votes.groupBy("role").agg(F.max_by("cluster_id", F.struct("n", -F.col("cluster_id"))).alias("cluster_id"))


def role_salary(postings: DataFrame, roles: DataFrame) -> DataFrame:
    """Mean salary of each role."""
    sums = postings.groupBy("job_title").agg(F.sum("salary_mid").alias("s"), F.count("salary_mid").alias("n"))
    return (
        sums.join(role_titles(postings, roles), "job_title").groupBy("role")
        .agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("avg_salary"))
    )


def skills_report(postings: DataFrame, roles: DataFrame, n_skills: int = 10, n_premiums: int = 5) -> DataFrame:
    """(role, section, rank, skill, value): each role's top skills and the market's top premiums."""
    skills = top_skills(skill_frequency(postings, roles=roles), n_skills, ["role"])
    premiums = top_premiums(skill_salary_impact(postings), n_premiums)
    ranked = top_n(premiums.withColumn("role", F.lit("all")), ["role"], [F.col("premium").desc(), F.col("skill")], n_premiums)
    return skills.select("role", F.lit("top_skills").alias("section"), "rank", F.col("skill_name").alias("skill"), F.col("percentage").alias("value")).union(
        ranked.select("role", F.lit("salary_premiums"), "rank", "skill", "premium")
    )


def record_change(cleaned: DataFrame, previous: DataFrame, key: str = "job_url") -> DataFrame:
    """(total, previous_total, difference, new_records, should_update) after a cleaning run.

    ``new_records`` counts keys not seen before; the difference of totals
    misleads once old rows expire.
    """
    seen = previous.select(key).distinct().withColumn("_seen", F.lit(1))
    flagged = cleaned.join(seen, key, "left")
    now = flagged.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("_seen").isNull()).alias("new_records"))
    return (
        now.withColumn("previous_total", previous.groupBy().count().scalar())
        .withColumn("difference", F.col("total") - F.col("previous_total"))
        .withColumn("should_update", F.col("new_records") > 0)
    )
