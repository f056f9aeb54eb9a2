"""Questions as a table: role, location and intent, the statistics that answer them, prompts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide import dims
from jobtide.functions.text import contains_any, title_case
from jobtide.operators import filters, market
from jobtide.session import cut_lineage

LOW_VOLUME = "⚠️ Note: Current market data volume is too low to provide statistical ML insights for this specific query."


def detect_intent(text: Column, intents: Sequence[tuple[str, Sequence[str]]] = tuple(dims.MARKET_INTENTS)) -> Column:
    """The first intent one of whose words the text contains, else ``general``."""
    expr = None
    for name, words in intents:
        hit = contains_any(text, list(words))
        expr = F.when(hit, F.lit(name)) if expr is None else expr.when(hit, F.lit(name))
    return expr.otherwise("general")


def detect_location(text: Column, cities: Sequence[str] = tuple(dims.QUESTION_CITIES)) -> Column:
    """The first listed city the text contains."""
    low = F.lower(text)
    return F.coalesce(*[F.when(low.contains(c), F.lit(c)) for c in cities])


def detect_role(questions: DataFrame, roles: DataFrame, role_col: str = "role") -> DataFrame:
    """(question_id, role): the longest known role the question contains, ties by alphabet."""
    found = filters.contained_phrases(questions, "question_id", "text", roles, role_col)
    order = F.struct(-F.length("phrase"), F.col("phrase"))
    return found.groupBy("question_id").agg(F.min_by("phrase", order).alias("role"))


def role_from_patterns(text: Column, patterns: Sequence[str] = tuple(dims.ROLE_PATTERNS)) -> Column:
    """A role of one to four words that one of the phrasings names."""
    low = F.lower(text)
    tries = []
    for pattern in patterns:
        name = F.trim(F.regexp_replace(F.regexp_extract(low, pattern, 1), r"^\s+|\s+$", ""))
        words = F.size(F.split(name, r"\s+"))
        tries.append(F.when((name != "") & (words <= 4), name))
    return F.coalesce(*tries)


def route_questions(
    questions: DataFrame, roles: DataFrame,
    cities: Sequence[str] = tuple(dims.QUESTION_CITIES),
    intents: Sequence[tuple[str, Sequence[str]]] = tuple(dims.MARKET_INTENTS),
) -> DataFrame:
    """Questions with role (known, else by phrasing), location and intent."""
    text = F.col("text")
    known = detect_role(questions, roles).withColumnRenamed("role", "_known")
    return questions.join(known, "question_id", "left").withColumns({
        "role": F.coalesce("_known", role_from_patterns(text)),
        "location": detect_location(text, cities),
        "intent": detect_intent(text, intents),
    }).drop("_known")


def _slices(routed: DataFrame, postings: DataFrame, min_rows: int) -> DataFrame:
    """(role, location, effective, n): the location slice if it is large enough, else the whole role."""
    requests = routed.where("role IS NOT NULL").select("role", "location").distinct()
    counted = filters.check_sufficiency(requests, postings)
    local = F.col("location").isNotNull() & (F.col("n_local") >= min_rows)
    return counted.select(
        "role", "location", F.when(local, F.col("location")).alias("effective"),
        F.when(local, F.col("n_local")).otherwise(F.col("n_role")).alias("n"),
    )


def _number(value: Column) -> Column:
    """A number as text, at two digits at most."""
    return F.bround(value, 2).cast("string")


def insight_text(routed: DataFrame, postings: DataFrame, min_rows: int = dims.MIN_LOCATION_POSTINGS) -> DataFrame:
    """Routed questions with the statistics block of their intent.

    Statistics are computed once per (role, location) slice and joined to the
    questions; the salary slice compares the location without regard to case.
    """
    from jobtide.plans.reports import sliced_postings

    # Both are as long as the question list and enter several joins below.
    routed = cut_lineage(routed)
    slices = cut_lineage(_slices(routed, postings, min_rows))
    requests = slices.select("role", F.col("effective").alias("location")).distinct()
    tagged = sliced_postings(postings, requests)
    by = ["role", "wanted"]

    line = F.format_string("- **%s**: %.1f%% frequency", F.col("skill_name"), F.bround("percentage", 1))
    top = market.top_skills(market.skill_frequency(tagged, by), 10, by)
    skill_lists = top.groupBy(*by).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("skill_list"))

    salaries = market.salary_benchmark(postings, slices.select("role", "location")).select(
        "role", "location", *[F.col(c).alias(f"s_{c}") for c in ("median", "mean", "min", "max", "count")])

    votes = tagged.where("cluster_id IS NOT NULL").groupBy(*by, "cluster_id").count()
    modal = votes.groupBy(*by).agg(F.max_by("cluster_id", F.struct("count", -F.col("cluster_id"))).alias("cluster_id"))
    clusters = market.cluster_profile(postings).select(
        "cluster_id", F.array_join(F.slice("top_skills", 1, 5), ", ").alias("c_skills"),
        F.array_join(F.slice("top_companys", 1, 3), ", ").alias("c_companies"), F.col("avg_salary").alias("c_salary"))
    careers = modal.join(clusters, "cluster_id").drop("cluster_id")

    same = lambda other, right: (F.col("q.role") == F.col(f"{other}.role")) & F.col(f"q.{right[0]}").eqNullSafe(F.col(f"{other}.{right[1]}"))
    joined = routed.alias("r").join(slices.alias("s"), (F.col("r.role") == F.col("s.role")) & F.col("r.location").eqNullSafe(F.col("s.location")), "left")
    joined = joined.select("r.*", "effective", F.coalesce("n", F.lit(0)).alias("n")).alias("q")
    joined = (
        joined.join(skill_lists.alias("k"), same("k", ("effective", "wanted")), "left")
        .join(careers.alias("c"), same("c", ("effective", "wanted")), "left")
        .join(salaries.alias("p"), same("p", ("location", "location")), "left")
    )
    city = title_case(F.col("q.location"))
    where = (
        F.when(F.col("q.location").isNull(), "")
        .when(F.col("effective").isNotNull(), F.concat(F.lit(" in '"), city, F.lit("'")))
        .otherwise(F.concat(F.lit(" (Global/India context used due to limited data in '"), city, F.lit("')")))
    )
    role = title_case(F.col("q.role"))
    n = F.col("q.n").cast("string")
    skills = F.concat(
        F.lit("### 📊 ML Skills Analysis for '"), role, F.lit("'"), where, F.lit("\nAnalysis based on "), n,
        F.lit(" fresh (last 14 days) job postings matching this role and location:\n"), F.col("skill_list"), F.lit("\n"))
    salary = F.concat(
        F.lit("### 💰 Salary Market Statistics for '"), role, F.lit("'"), where, F.lit("\nBased on **"), F.col("s_count").cast("string"),
        F.lit("** fresh job postings (last 14 days):\n- **Median Salary**: ₹"), _number(F.col("s_median")), F.lit(" LPA\n- **Market Range**: ₹"),
        _number(F.col("s_min")), F.lit(" - ₹"), _number(F.col("s_max")), F.lit(" LPA\n- **Mean Average**: ₹"), _number(F.col("s_mean")), F.lit(" LPA\n"))
    no_salary = F.concat(F.lit("Insufficient salary data to provide specific statistics for '"), F.col("q.role"), F.lit("'"), where, F.lit("."))
    career = F.concat(
        F.lit("### 🚀 Career Insights for '"), role, F.lit("'"), where, F.lit("\nAnalysis of "), n,
        F.lit(" fresh postings within this cluster context:\n- **Key Skills**: "), F.col("c_skills"), F.lit("\n- **Top Hiring Companies**: "),
        F.col("c_companies"), F.lit("\n- **Avg Cluster Salary**: ₹"), F.coalesce(_number(F.col("c_salary")), F.lit("N/A")), F.lit(" LPA\n"))
    known = F.col("q.role").isNotNull()
    block = (
        F.when(known & (F.col("intent") == "skills"), skills)
        .when(known & (F.col("intent") == "salary"), F.when(F.col("s_count") > 0, salary).otherwise(no_salary))
        .when(known & (F.col("intent") == "career_path"), career)
    )
    return joined.select("q.*", F.coalesce(block, F.lit(LOW_VOLUME)).alias("insight")).drop("effective", "n")


def chat_insight(routed: DataFrame, postings: DataFrame, n: int = 8) -> DataFrame:
    """The short insight of the chat: a role's top skills, or its mean salary."""
    roles = routed.where("role IS NOT NULL").select("role").distinct()
    top = market.top_skills(market.skill_frequency(postings, roles=roles), n, ["role"])
    names = top.groupBy("role").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "skill_name"))), lambda x: x["skill_name"]), ", ").alias("_skills"))
    paid = market.role_salary(postings, roles)
    text = F.when(F.col("intent") == "skills", F.format_string("ML INSIGHTS: Top skills for %s: %s. ", "role", "_skills")).when(
        F.col("intent") == "salary", F.format_string("ML INSIGHTS: Average salary for %s is %.2f LPA. ", F.col("role"), F.bround("avg_salary", 2)))
    found = F.when((F.col("intent") == "skills") & F.col("_skills").isNotNull(), text).when(
        (F.col("intent") == "salary") & F.col("avg_salary").isNotNull(), text)
    return (
        routed.join(names, "role", "left").join(paid, "role", "left")
        .withColumn("insight", F.coalesce(found, F.lit(""))).drop("_skills", "avg_salary").select(*routed.columns, "insight")
    )


def follow_up_questions(routed: DataFrame) -> DataFrame:
    """Three follow-up questions per routed question, its role filled in."""
    spark = routed.sparkSession
    rows = [(i, n, t) for i, texts in dims.FOLLOW_UPS.items() for n, t in enumerate(texts, 1)]
    templates = spark.createDataFrame(rows, "intent string, position int, template string")
    intent = F.when(F.col("intent").isin(list(dims.FOLLOW_UPS)), F.col("intent")).otherwise("general")
    joined = routed.withColumn("intent", intent).join(F.broadcast(templates), "intent")
    role = F.coalesce("role", F.lit("this role"))
    return joined.select("question_id", "position", F.replace("template", F.lit("{role}"), role).alias("follow_up"))


def augment_query(answered: DataFrame, guides: DataFrame | None = None) -> DataFrame:
    """The full prompt: insight, the start of a career guide if the role has one, question, instruction."""
    rows = answered
    if guides is not None:
        first = guides.groupBy("role").agg(F.min("guide").alias("_guide"))
        rows = rows.join(first, "role", "left")
    else:
        rows = rows.withColumn("_guide", F.lit(None).cast("string"))
    guide = F.when(F.col("intent") == "career_path", F.coalesce("_guide", F.lit(""))).otherwise("")
    hint = F.when(
        guide.contains("generated"),
        "\n(A new expert career guide has been dynamically generated and added to the database for this role.)").otherwise("")
    prompt = F.concat(
        F.lit("ML Analysis Results:\n"), F.col("insight"), F.lit("\n\nDynamic Career Guide Knowledge:\n"), F.substring(guide, 1, 2000),
        F.lit("\n\nUser Question: "), F.col("text"),
        F.lit("\n\nInstruction: Based on the quantitative ML analysis, the dynamically generated career guide, and real job examples, answer the user's question."), hint)
    return rows.withColumn("prompt", prompt).drop("_guide")


def history_window(turns: DataFrame, exchanges: int = 5, block: int = 1_000) -> DataFrame:
    """Each turn with the ``exchanges`` exchanges (two turns each) before it.

    ``turn`` is the position within the conversation. A conversation is cut into
    blocks of positions and a turn goes to its own block and to all that its reach touches,
    so a conversation of any length spreads over many tasks.
    """
    from pyspark.sql import Window

    reach = 2 * exchanges
    own = F.floor(F.col("turn") / block)
    copies = F.sequence(own, F.floor((F.col("turn") + reach) / block))
    rows = turns.select("conv_id", "turn", "role", "text", own.alias("_own"), F.explode(copies).alias("_block"))
    window = Window.partitionBy("conv_id", "_block").orderBy("turn").rangeBetween(-reach, -1)
    history = F.collect_list(F.struct("turn", "role", "text")).over(window)
    return rows.withColumn("history", history).where("_own = _block").drop("_own", "_block")
