"""What the operators of this package share: stored tables, Arrow slices, label samples."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.session import scratch_path

#: Words are runs of anything but ASCII white space. ``bytes.split()`` cuts at just these bytes.
WORD_GAP = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if the table has a column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Short slices of Arrow batches, so that few texts at a time become Python strings."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def fold(key: Column, folds: int) -> Column:
    """``crc32`` of the key as text, modulo ``folds``; null keys fall in no fold (null)."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def held_out(key: Column, folds: int, out: int) -> Column:
    """True where labels may not be read; a null key has no label and is not held out."""
    return F.coalesce(fold(key, folds) == out, F.lit(False))


def training_sample(
    docs: DataFrame, labels: DataFrame, label: str, folds: int, out: int, rows: int,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``(text, label)`` of about ``rows`` labelled documents outside the held-out fold.

    The sample is drawn by hash of the key, so it is the same on every run, and
    its keys (16 bytes each) are the only thing broadcast. Repeated label rows
    of a key vote; a tie counts as 1. Rows with a null key, text or label are left out.
    Equal texts with equal labels count once.
    """
    usable = (
        labels.select(F.col(key).alias("k"), F.col(label).cast("double").alias("y"))
        .where(F.col("k").isNotNull() & F.col("y").isNotNull() & (fold(F.col("k"), folds) != out))
        .groupBy("k").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    )
    total = usable.count()
    share = 1.0 if total <= rows else rows / total
    chosen = usable.where(F.pmod(F.xxhash64("k", F.lit("sample")), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    found = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).where(F.col("text").isNotNull()).join(
        F.broadcast(chosen), "k"
    )
    return store(found.select("text", "y").dropDuplicates(["text", "y"]), "train")
