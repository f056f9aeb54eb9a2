"""Contiguous shards of near equal bytes, from global prefix sums of per-partition totals.

Rows are put in order (id, checksum, size) by ranges, so each partition holds a
contiguous run and is about as large as any other, whatever the hot source or
group of copies. Totals of the partitions (one row each) give every partition
its offset; a running sum inside the partition then gives each row the bytes
before it, and ``bytes before * shards / total`` is its shard. A cut is off its target by
less than one row. Texts are read once and never shuffled.

Defined cases: a null text has size 1 and the checksum of no bytes (0); a null id sorts
first; repeated rows are rows of their own; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobtide.llm.common import store


def byte_shards(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)`` for each row; slots count from 0 in each shard."""
    body = F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b""))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.monotonically_increasing_id().alias("tie"),  # lets equal rows lie in several partitions
    )
    order = ["doc_id", "text_crc32", "size", "tie"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = store(
        rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id())
        .withColumn("pos", F.monotonically_increasing_id()).drop("tie"),
        "shard-order",
    )
    # One row for each partition; the window over them is as long as the partitions are many.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("part").agg(F.sum("size").alias("bytes")).select(
        "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("offset"))
    total = placed.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"))
    inside = Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    cut = placed.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        F.broadcast(offsets), "part").crossJoin(F.broadcast(total)).select(  # one row
        "doc_id", "size", "text_crc32", "part", "pos",
        F.expr(f"cast(((offset + ahead) * {int(shards)}) div total as int)").alias("shard"))
    # At most one row for each partition and one more for each cut.
    runs = cut.groupBy("part", "shard").agg(F.count("*").alias("n"))
    first = runs.select("part", "shard", F.coalesce(F.sum("n").over(
        Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    number = F.row_number().over(Window.partitionBy("part", "shard").orderBy("pos"))
    return cut.withColumn("nth", number).join(F.broadcast(first), ["part", "shard"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("nth") - 1).cast("long").alias("slot"))
