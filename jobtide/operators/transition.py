"""Likelihood of moving from a profile to a role."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide import dims
from jobtide.operators.filters import role_titles
from jobtide.operators.market import entry_experience, skill_frequency, top_skills
from jobtide.operators.match import education_match, lower_all
from jobtide.session import cut_lineage

FEATURES = ["skill_ratio", "exp_gap", "loc_match", "edu_match", "difficulty"]
FEATURE_NAMES = ["Skill Match", "Experience Fit", "Location Alignment", "Education Compatibility", "Role Complexity"]


def normalize_skill(skill: Column, compat: bool = False) -> Column:
    """Lower case, and one spelling per synonym.

    With ``compat`` the synonym table is applied as listed, which swaps "ai" with
    "artificial intelligence" instead of uniting them.
    """
    table = dims.SKILL_SYNONYMS if compat else dims.CANONICAL_SYNONYMS
    low = F.lower(F.trim(skill))
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, low), low)


def representative_jobs(postings: DataFrame, roles: DataFrame, k: int = 20) -> DataFrame:
    """One row per role with postings: its top skills, entry experience and first location."""
    top = top_skills(skill_frequency(postings, roles=roles), k, ["role"])
    skills = top.groupBy("role").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "skill_name", "percentage"))),
        lambda x: F.struct(x["skill_name"].alias("skill"), x["percentage"].alias("percentage")),
    ).alias("skills"))
    firsts = postings.groupBy("job_title").agg(F.min(F.struct("job_url", "location")).alias("first"))
    base = firsts.join(role_titles(postings, roles), "job_title").groupBy("role").agg(F.min("first").alias("first"))
    return (
        base.join(skills, "role", "left")
        .join(entry_experience(postings, roles), "role", "left")
        .select(
            "role", F.coalesce("skills", F.expr("array()").cast("array<struct<skill:string,percentage:double>>")).alias("skills"),
            F.coalesce("entry_experience", F.lit(0.0)).alias("experience_min"), F.col("first.location").alias("location"),
        )
    )


def transition_features(profiles: DataFrame, jobs: DataFrame, compat: bool = False) -> DataFrame:
    """One row per profile and role it is paired with (column ``role``).

    The skill ratio weighs the role's top skills by their market share; with no
    requirement it is 1. ``jobs`` comes from :func:`representative_jobs`.
    """
    own = F.transform(F.coalesce(F.col("p.skills"), F.expr("array()").cast("array<string>")), lambda s: normalize_skill(s, compat))
    joined = profiles.alias("p").join(jobs.alias("j"), F.col("p.role") == F.col("j.role")).select(
        "p.profile_id", "p.role", own.alias("_own"), F.col("j.skills").alias("_skills"), "p.years_experience",
        F.col("p.education").alias("_edu"), lower_all(F.col("p.locations")).alias("_places"),
        F.col("j.experience_min"), lower_all(F.col("j.location")).alias("_at"),
        (F.col("j.education") if "education" in jobs.columns else F.lit(None).cast("array<string>")).alias("_needs"),
    )
    has = lambda x: F.array_contains(F.col("_own"), normalize_skill(x["skill"], compat))
    weight = lambda items: F.aggregate(items, F.lit(0.0), lambda acc, x: acc + x["percentage"])
    total, mine = weight(F.col("_skills")), weight(F.filter("_skills", has))
    return joined.select(
        "profile_id", "role",
        F.when(F.size("_skills") == 0, 1.0).when(total > 0, mine / total).otherwise(0.0).alias("skill_ratio"),
        (F.col("experience_min") - F.coalesce("years_experience", F.lit(0))).alias("exp_gap"),
        F.when((F.size("_at") == 0) | F.arrays_overlap("_at", "_places"), 1.0).otherwise(0.0).alias("loc_match"),
        education_match(F.col("_edu"), F.col("_needs")).alias("edu_match"),
        F.size("_skills").cast("double").alias("difficulty"),
        F.transform(F.filter("_skills", lambda x: ~has(x)), lambda x: x["skill"]).alias("missing"),
    )


@dataclass
class TransitionModel:
    """Weights of a logistic regression and the scaling of its inputs."""

    features: list[str]
    means: list[float]
    deviations: list[float]
    weights: list[float]
    intercept: float
    auc: float | None = None

    def scaled(self) -> list[Column]:
        return [(F.col(c).cast("double") - m) / d for c, m, d in zip(self.features, self.means, self.deviations)]

    def probability(self, df: DataFrame, out: str = "probability") -> DataFrame:
        z = F.lit(self.intercept)
        for w, x in zip(self.weights, self.scaled()):
            z = z + w * x
        return df.withColumn(out, 1 / (1 + F.exp(-z)))


def held_model(rows: DataFrame) -> TransitionModel:
    """A model kept as a table (position, feature, mean, deviation, weight), the intercept in a row without a feature."""
    found = rows.orderBy("position").collect()  # one row for each input
    inputs = [r for r in found if r["feature"] is not None]
    column = lambda c: [float(r[c]) for r in inputs]
    intercept = sum(float(r["weight"]) for r in found if r["feature"] is None)
    return TransitionModel([r["feature"] for r in inputs], column("mean"), column("deviation"), column("weight"), intercept)


def class_weight(label: Column, n: int, positive: int) -> Column:
    """Weights that give both classes the same total."""
    return F.when(label == 1, n / (2.0 * positive)).otherwise(n / (2.0 * (n - positive)))


def loss_slopes(model: TransitionModel, labelled: DataFrame, label: str = "label", c: float = 0.5) -> DataFrame:
    """(feature, slope): derivatives of the training loss at the model's weights; near zero at the optimum."""
    size = labelled.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("double")).alias("pos")).first()
    off = class_weight(F.col(label), size["n"], size["pos"]) * (F.col("_p") - F.col(label))
    rows = model.probability(labelled, "_p")
    sums = rows.agg(F.sum(off).alias("intercept"), *[F.sum(off * x).alias(f) for f, x in zip(model.features, model.scaled())])
    slopes = [F.struct(F.lit("intercept").alias("feature"), (F.col("intercept") / size["n"]).alias("slope"))]
    slopes += [F.struct(F.lit(f).alias("feature"), (F.col(f) / size["n"] + w / (c * size["n"])).alias("slope"))
               for f, w in zip(model.features, model.weights)]
    return sums.select(F.inline(F.array(*slopes)))


def train_transition(labelled: DataFrame, features: list[str] = FEATURES, label: str = "label", c: float = 0.5) -> TransitionModel:
    """Balanced, L2-regularised logistic regression on standardised features.

    ``c`` is the inverse regularisation of the summed loss; with balanced weights
    summing to n the equivalent penalty of Spark's averaged loss is 1 / (c n).
    """
    # Statistics, fit and evaluation read the same rows; compute them once.
    labelled = cut_lineage(labelled.select(*features, label))
    numeric = [F.col(f).cast("double") for f in features]
    stats = labelled.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("double")).alias("pos"),
        *[F.avg(x).alias(f"m{i}") for i, x in enumerate(numeric)],
        *[F.stddev_pop(x).alias(f"d{i}") for i, x in enumerate(numeric)],
    ).first()
    if not stats["pos"] or stats["pos"] == stats["n"]:
        raise ValueError("both classes are needed")
    ids = range(len(features))
    model = TransitionModel(features, [stats[f"m{i}"] for i in ids], [stats[f"d{i}"] or 1.0 for i in ids], [], 0.0)
    rows = labelled.withColumns({
        "_label": F.col(label).cast("double"), "_weight": class_weight(F.col(label), stats["n"], stats["pos"]),
        **{f"_s{i}": x for i, x in enumerate(model.scaled())}})
    rows = VectorAssembler(inputCols=[f"_s{i}" for i in ids], outputCol="_features").transform(rows)
    regression = LogisticRegression(
        featuresCol="_features", labelCol="_label", weightCol="_weight", elasticNetParam=0.0, standardization=False,
        regParam=1.0 / (c * stats["n"]), maxIter=100, tol=1e-9,
    ).fit(rows)
    model.weights, model.intercept = [float(w) for w in regression.coefficients], float(regression.intercept)
    scored = model.probability(labelled.withColumn("_label", F.col(label).cast("double")), "_p")
    model.auc = BinaryClassificationEvaluator(rawPredictionCol="_p", labelCol="_label").evaluate(scored)
    return model


def transition_score(features: DataFrame, model: TransitionModel) -> DataFrame:
    """Probability in percent, confidence, factor texts, missing skills and advice."""
    p = F.col("_p")
    first = F.array_join(F.slice("missing", 1, 3), ", ")
    return model.probability(features, "_p").select(
        "profile_id", "role",
        F.bround(F.least(F.greatest(p * 100, F.lit(0.0)), F.lit(100.0)), 1).alias("probability"),
        F.when(p > 0.75, "High").when(p > 0.4, "Moderate").otherwise("Low").alias("confidence"),
        F.format_string("%.1f%%", F.bround(F.col("skill_ratio") * 100, 1)).alias("skill_match"),
        F.format_string("%.1f years", F.bround("exp_gap", 1)).alias("experience_fit"),
        F.when(F.col("loc_match") > 0.5, "Yes").otherwise("No").alias("location_alignment"),
        F.when(F.col("edu_match") > 0.5, "High").otherwise("Mismatch").alias("education_compatibility"),
        F.when(F.col("difficulty") > 12, "High").when(F.col("difficulty") > 6, "Medium").otherwise("Normal").alias("role_complexity"),
        F.slice("missing", 1, 8).alias("missing_skills"),
        F.when(p > 0.8, "🚀 High success potential! You are a strong candidate.")
        .when(p > 0.5, F.concat(F.lit("💡 Moderate potential. Consider learning: "), first, F.lit(".")))
        .otherwise("⚠️ Difficult transition. Focus on skill building or lower experience roles.").alias("recommendation"),
    )


def feature_weights(spark, model: TransitionModel, names: list[str] | None = None) -> DataFrame:
    """(feature, weight), heaviest first."""
    rows = list(zip(names or model.features, model.weights))
    return spark.createDataFrame(rows, "feature string, weight double").orderBy(F.abs("weight").desc(), "feature")


def with_roles(profiles: DataFrame, roles: list[str]) -> DataFrame:
    """Each profile once per role of a short list."""
    return profiles.withColumn("role", F.explode(F.array(*[F.lit(r) for r in roles])))


def transition_matrix(profiles: DataFrame, postings: DataFrame, model: TransitionModel, roles: list[str] = dims.MARKET_ROLES) -> DataFrame:
    """Probability of every profile for every role that has postings, best first."""
    spark = profiles.sparkSession
    wanted = spark.createDataFrame([(r,) for r in roles], "role string")
    features = transition_features(with_roles(profiles, roles), representative_jobs(postings, wanted))
    return transition_score(features, model).select("profile_id", "role", "probability")
