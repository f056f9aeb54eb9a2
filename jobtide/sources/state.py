"""Completed (role, location group) pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.sources.postings import path_exists

STATE_SCHEMA = "role string, location_group string"


def split_pairs(pairs: DataFrame, column: str = "pair") -> DataFrame:
    """``role|group`` texts -> two columns; a text without a bar is dropped."""
    parts = F.split(F.col(column), r"\|", 2)
    return pairs.where(F.col(column).contains("|")).select(
        F.get(parts, 0).alias("role"), F.get(parts, 1).alias("location_group")
    ).distinct()


def read_state_json(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of a JSON array of ``role|group`` texts; a corrupt or missing file is empty."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], STATE_SCHEMA)
    text = spark.read.text(path, wholetext=True)
    return split_pairs(text.select(F.explode(F.from_json("value", "array<string>")).alias("pair")))


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The append-only table of completed pairs; empty before the first append."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], STATE_SCHEMA)
    return spark.read.schema(STATE_SCHEMA).parquet(path).distinct()


def append_state(pairs: DataFrame, path: str) -> None:
    """Add the pairs the table lacks."""
    known = read_state(pairs.sparkSession, path)
    new = pairs.select("role", "location_group").distinct().join(known, ["role", "location_group"], "left_anti")
    new.write.mode("append").parquet(path)
