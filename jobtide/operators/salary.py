"""Salary prediction with a random forest."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide.functions.text import normalize_skills
from jobtide.operators.columns import IMPACT_SKILL_ORDER, chosen_skills
from jobtide.session import cut_lineage

MIN_ROWS = 20
INPUTS = ["exp_num", "num_skills", "cluster_label"]
#: Inputs that one partition of the training table holds, and trees that grow at a time.
INPUTS_PER_PART, PARALLEL = 50_000, 8


@dataclass
class SalaryModel:
    """The stages that make the inputs, and the trees, whose mean is the prediction."""

    stages: PipelineModel
    trees: list[DecisionTreeRegressionModel]

    def importances(self) -> np.ndarray:
        """The share of each input in the gain of all trees."""
        shares = np.sum([t.featureImportances.toArray() for t in self.trees], axis=0)
        return shares / (shares.sum() or 1.0)


def train_salary_model(postings: DataFrame, skills_col: str | None = None, trees: int = 100, depth: int = 30, seed: int = 42) -> SalaryModel | None:
    """Forest on experience (median where missing), number of skills and cluster.

    Null when fewer than twenty postings have a salary. Every posting is drawn for every tree, but trees do not read postings: a
    split is decided by the number and the sum of the salaries drawn at each distinct input, so these are summed once, and a
    tree grows on one weighted row for each distinct input (:func:`_drawn`).
    """
    postings, skills_col = chosen_skills(postings, skills_col, IMPACT_SKILL_ORDER)
    # Read by the count, the median, the labels and the draws: derived once.
    rows = cut_lineage(postings.where("salary_mid IS NOT NULL").select(
        F.col("experience_min").cast("double").alias("exp_num"),
        F.size(normalize_skills(F.col(skills_col))).cast("double").alias("num_skills"),
        "cluster_label", F.col("salary_mid").cast("double").alias("salary_mid"),
    ))
    if rows.limit(MIN_ROWS).count() < MIN_ROWS:
        return None
    stages = Pipeline(stages=[
        Imputer(strategy="median", inputCols=["exp_num"], outputCols=["exp_filled"]),
        StringIndexer(inputCol="cluster_label", outputCol="cluster_index", handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=["cluster_index"], outputCols=["cluster_hot"], dropLast=True, handleInvalid="keep"),
        VectorAssembler(inputCols=["exp_filled", "num_skills", "cluster_hot"], outputCol="features"),
    ]).fit(rows)
    drawn = cut_lineage(_drawn(rows, trees, seed))
    parts = drawn.count() // INPUTS_PER_PART + 1
    inputs = stages.transform(drawn).select("features", "n", "total").coalesce(parts).persist()

    def grow(tree: int) -> DecisionTreeRegressionModel:
        n, total = F.get("n", tree), F.get("total", tree)
        weighed = inputs.select("features", n.alias("n"), F.when(n > 0, total / n).otherwise(0.0).alias("salary_mid"))
        return DecisionTreeRegressor(
            featuresCol="features", labelCol="salary_mid", weightCol="n", predictionCol="predicted_salary", maxDepth=depth, seed=seed, maxMemoryInMB=1024,
        ).fit(weighed)

    try:
        with ThreadPool(PARALLEL) as pool:
            return SalaryModel(stages, pool.map(grow, range(trees), chunksize=1))
    finally:
        inputs.unpersist()


def _drawn(rows: DataFrame, trees: int, seed: int) -> DataFrame:
    """For each distinct input the number ``n`` and sum ``total`` of the salaries drawn for each tree.

    A posting is drawn a Poisson(1) number of times, as in Spark's forest, so equal postings together a Poisson number with their
    count as its mean. Draws are seeded by the posting's values, so they do not depend on how rows are dealt.
    """
    alike = rows.groupBy(*INPUTS, "salary_mid").agg(F.count(F.lit(1)).alias("rows"))
    alike = alike.withColumn("key", F.xxhash64(*INPUTS, "salary_mid"))

    @F.pandas_udf("array<long>")
    def draws(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for key, count in parts:
            yield pd.Series([np.random.default_rng([seed, k & (1 << 64) - 1]).poisson(n, trees) for k, n in zip(key.tolist(), count.tolist())])

    each = alike.select(*INPUTS, "salary_mid", F.posexplode(draws("key", "rows")).alias("tree", "n")).groupBy(*INPUTS, "tree").agg(
        F.sum("n").cast("double").alias("n"), F.sum(F.col("n") * F.col("salary_mid")).alias("total"))
    listed = F.array_sort(F.collect_list(F.struct("tree", "n", "total")))
    return each.groupBy(*INPUTS).agg(listed.alias("t")).select(*INPUTS, F.col("t.n").alias("n"), F.col("t.total").alias("total"))


def predict_salary(profiles: DataFrame, model: SalaryModel) -> DataFrame:
    """Predicted salary of profiles for their ``cluster_label``; missing experience counts as 2 years.

    A label never seen in training sets no cluster input.
    """
    rows = profiles.withColumns({
        "exp_num": F.coalesce(F.col("years_experience").cast("double"), F.lit(2.0)),
        "num_skills": F.coalesce(F.size("skills"), F.lit(0)).cast("double"),
    })
    scored = model.stages.transform(rows)
    found = []
    for n, tree in enumerate(model.trees):
        found.append(f"_tree{n}")
        scored = tree.setPredictionCol(found[-1]).transform(scored)
    mean = reduce(lambda a, b: a + b, [F.col(c) for c in found]) / len(found)
    return scored.select(*profiles.columns, F.bround(mean, 2).alias("predicted_salary"))
