"""Posting tables on disk: raw CSV landing files, Parquet tables, résumé texts."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobtide import dims
from jobtide.functions import text as tx
from jobtide.operators.columns import STATS_SKILL_ORDER, choose_column, with_skills  # noqa: F401
from jobtide.operators.skills import extract_skills
from jobtide.session import dropped_shuffles

#: Columns with another type than text.
RAW_KINDS = {"scraped_date": "timestamp", "row_no": "bigint"}
RAW_COLUMNS = [
    "job_title", "company", "location", "experience_required", "salary", "skills_list", "job_description", "posted_date",
    "job_url", "source", "scraped_date", "source_file", "row_no",
]
CSV_OPTIONS = {"header": True, "multiLine": True, "escape": '"', "quote": '"', "mode": "PERMISSIVE"}


def header_layouts(spark: SparkSession, path: str | list[str]) -> list[tuple[list[str], list[str]]]:
    """The distinct headers of CSV files, each with the files that have it.

    One pass over the first block of each file as plain lines; what comes to the driver is the list of files,
    which the reader lists there anyway. A header must not hold line breaks.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("n"), "value").where("block = 0")
    heads = lines.groupBy("file").agg(F.min_by("value", "n").alias("head"))
    found = heads.groupBy("head").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("head").collect()
    return [(next(csv.reader([r["head"].lstrip("\ufeff").strip()])), r["files"]) for r in found if r["head"].strip()]


def read_raw_postings(spark: SparkSession, path: str | list[str], kinds: dict[str, str] = RAW_KINDS) -> DataFrame:
    """All raw CSV files of a folder, a pattern or a list of files, unreadable files left out.

    Columns are bound by the header of each file; files of one layout are read together
    and layouts are stacked by name. Columns that no file has are null. Rows without a file name and row number of their own get
    the file's name and a number that rises within the file. List cells
    arrive as text and leave as arrays. A file is read by one task, so landing files should stay below some
    hundred megabytes.
    """
    tables = []
    for names, files in header_layouts(spark, path):
        columns = [f"{n}_{names[:i].count(n)}" if n in names[:i] else n for i, n in enumerate(names)]
        schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        rows = spark.read.schema(schema).options(**CSV_OPTIONS).option("ignoreCorruptFiles", True).csv(files)
        tables.append(rows.withColumns({"_file": F.col("_metadata.file_name"), "_row": F.monotonically_increasing_id() % (1 << 33)}))
    if not tables:
        return revive_lists(spark.createDataFrame([], ", ".join(f"{c} {kinds.get(c, 'string')}" for c in RAW_COLUMNS)))
    return revive_lists(typed(stack(tables), kinds))


def typed(rows: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Text rows with all raw columns in their types; ``_file`` and ``_row`` fill gaps and go."""
    lacking = {c: F.lit(None).cast("string") for c in RAW_COLUMNS if c not in rows.columns}
    rows = rows.withColumns(lacking)
    rows = rows.withColumns({c: F.col(c).try_cast(kind) for c, kind in kinds.items()})
    rows = rows.withColumns({"source_file": F.coalesce("source_file", "_file"), "row_no": F.coalesce("row_no", "_row")})
    rest = [c for c in rows.columns if c not in RAW_COLUMNS and c not in ("_file", "_row")]
    return rows.select(*RAW_COLUMNS, *rest)


def stack(tables: list[DataFrame]) -> DataFrame:
    """Union by name; a column that a table lacks becomes null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def revive_lists(df: DataFrame, columns: tuple[str, ...] = ("location", "skills_list", "skills_extracted")) -> DataFrame:
    """Text lists back to arrays; plain skill text is split at commas."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    out = {}
    for c in columns:
        if kinds.get(c) == "string":
            out[c] = tx.text_list(F.col(c)) if c == "location" else tx.skill_text_list(F.col(c))
    return df.withColumns(out)


def lists_as_text(df: DataFrame) -> DataFrame:
    """Arrays to JSON text, for a CSV sink."""
    arrays = [f.name for f in df.schema if f.dataType.typeName() == "array"]
    return df.withColumns({c: F.to_json(c) for c in arrays})


def read_processed(spark: SparkSession, clustered_path: str, cleaned_path: str) -> DataFrame:
    """The clustered table, or the cleaned one where there is no clustered table yet."""
    for path in (clustered_path, cleaned_path):
        if path_exists(spark, path):
            return revive_lists(spark.read.parquet(path))
    raise FileNotFoundError(f"neither {clustered_path} nor {cleaned_path} exists")


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def write_processed(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Overwrite a table; partitioned by a date column, the freshness filter prunes files."""
    writer = df.write.mode("overwrite")
    with dropped_shuffles(df.sparkSession):
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def append_processed(batch: DataFrame, path: str, key: str = "job_url") -> None:
    """Append the rows that the table does not hold yet, one for each posting, so that a replay adds nothing.

    Postings are told apart as in the merge: by URL without its query part, or by title and company.
    """
    from jobtide.operators import clean

    spark = batch.sparkSession
    keyed = lambda df: df.withColumn("_url", tx.canonical_url(F.col(key))).withColumn("_key", clean.posting_key("_url"))
    rows = keyed(batch)
    if path_exists(spark, path):  # before duplicates go, so that only new rows are sorted out by key
        rows = rows.join(keyed(spark.read.parquet(path)).select("_key"), "_key", "left_anti")
    first = clean.drop_duplicate_urls(rows.select(*batch.columns, "_url", "_key"), "_key").select(batch.columns)
    with dropped_shuffles(spark):
        first.write.mode("append").parquet(path)


def read_resumes(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file: path and whole text."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )


def resume_facts(resumes: DataFrame, dictionary: DataFrame, id_col: str = "path", compat: bool = False) -> DataFrame:
    """Skills, degrees and length of each résumé; an empty text gives no row."""
    filled = resumes.where(F.length("text") > 0)
    return extract_skills(filled, dictionary, id_col, "text", "skills").withColumns({
        "education": tx.education(F.col("text"), compat),
        "char_count": F.length("text"),
    })


def describe_sources(docs: DataFrame, indexed: DataFrame, failed: DataFrame | None = None, key: str = "job_url") -> DataFrame:
    """(source_file, n_docs, n_new, n_indexed, status) of an index build.

    ``docs`` are the documents offered and ``indexed`` the keys added in this
    run: Full when all new documents were added, Partial when some were,
    Already Processed or Empty when there was nothing new. Keys in ``failed``
    mark their file as Error.
    """
    added = indexed.select(key).distinct().withColumn("_added", F.lit(1))
    rows = docs.join(added, key, "left")
    if failed is not None:
        rows = rows.join(failed.select(key).distinct().withColumn("_failed", F.lit(1)), key, "left")
    else:
        rows = rows.withColumn("_failed", F.lit(None).cast("int"))
    counted = rows.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.count_if("is_new").alias("n_new"),
        F.count_if(F.col("is_new") & F.col("_added").isNotNull()).alias("n_indexed"),
        F.count("_failed").alias("_failures"),
    )
    status = (
        F.when(F.col("_failures") > 0, F.format_string("Error: %d documents", "_failures"))
        .when(F.col("n_new") == 0, F.lit("Already Processed or Empty"))
        .when(F.col("n_indexed") == F.col("n_new"), F.lit("Full"))
        .otherwise(F.format_string("Partial (%d/%d new jobs)", "n_indexed", "n_new"))
    )
    return counted.withColumn("status", status).drop("_failures")
