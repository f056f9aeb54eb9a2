"""Conflict-constrained best-fit packing of documents into bins of a fixed number of words.

Documents are cut into pieces of at most ``capacity`` words. A bin holds no two pieces of one
source and no two of one duplicate cluster. Pieces are dealt at random, by a hash of id, source and text,
into groups of some ``group_rows`` documents, which are packed on their own: the hot
source or cluster spreads like any other, and only the last bins of a group stay emptier than they
could be. In a group, pieces go in order of falling size. Bins are kept in
order of what is left in them and carry a bitmap of their sources and one of their clusters. The search starts at
the first bin with just enough room and goes on to its successors until a bin
without a conflict is found: the tightest compatible one. If there is none, a bin is opened.

Defined cases: a null or empty text is one piece of no words, packed like any other; a null source or
cluster is in conflict with nothing; repeated rows are packed each; copies have equal texts
and so are in conflict, near copies only with ``clusters`` from :func:`near_clusters`; equal pieces go in the order of a hash of id, source and text, so bins do not depend on files or partitions; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobtide.llm import simhash_dedup
from jobtide.llm.common import store


#: Parts into which the rows of one text are dealt when their cluster is looked up.
SALTS = 32


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[int]:
    """The bin of each piece; the pieces are given in the order in which they are packed."""
    source_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(x for x in sources if x is not None))}
    seen: set = set()
    repeated = dict.fromkeys(c for c in clusters if c is not None and (c in seen or seen.add(c)))
    cluster_bit = {c: 1 << i for i, c in enumerate(repeated)}  # a cluster of one is in conflict with nothing
    ordered: list[tuple[int, int]] = []  # (room, bin)
    source_map: list[int] = []
    cluster_map: list[int] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters):
        s, c = source_bit.get(source, 0), cluster_bit.get(cluster, 0)
        at = bisect_left(ordered, (size, -1))
        while at < len(ordered) and (source_map[ordered[at][1]] & s or cluster_map[ordered[at][1]] & c):
            at += 1
        if at < len(ordered):
            room, bin_ = ordered.pop(at)
            source_map[bin_] |= s
            cluster_map[bin_] |= c
        else:
            room, bin_ = capacity, len(source_map)
            source_map.append(s)
            cluster_map.append(c)
        insort(ordered, (room - size, bin_))
        out.append(bin_)
    return out


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def near_clusters(docs: DataFrame, shingle: int = 3, distance: int = 2, text: str = "text") -> DataFrame:
    """``(copy, cluster)``: for the hash of each text that is not empty, the component of near-duplicates it is in.

    The hash stands for the row's id, so rows without an id, or with an id that others have, get their own text's cluster.
    """
    texts = docs.where(F.col(text) != "").select(F.xxhash64(text).alias("copy"), F.col(text).alias("text"))
    found = simhash_dedup.near_duplicates(texts, shingle, distance, key="copy")
    return found.groupBy(F.col("doc_id").alias("copy")).agg(F.min("component_id").alias("cluster"))


def numbered_copies(rows: DataFrame) -> DataFrame:
    """Adds ``copy_no``, from 0, to rows of one ``name`` (equal id, source and text), which are else alike.

    Names with one row, nearly all, are numbered without moving them. Many rows of one name are numbered by input
    partition and shifted, so none of their tasks holds them all.
    """
    again = store(rows.groupBy("name").agg(F.count("*").alias("rows")).where("rows > 1").select("name"), "packing-repeated")
    if again.isEmpty():
        return rows.withColumn("copy_no", F.lit(0).cast("long"))
    flagged = rows.join(again.withColumn("again", F.lit(True)), "name", "left").withColumn("part", F.spark_partition_id())
    flagged = store(flagged, "packing-flagged")
    many = flagged.where("again").drop("again")
    inside = F.row_number().over(Window.partitionBy("name", "part").orderBy("words")) - 1
    ahead = Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = many.groupBy("name", "part").count().select("name", "part", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("offset"))
    counted = many.withColumn("nth", inside).join(offsets, ["name", "part"]).withColumn("copy_no", F.col("nth") + F.col("offset"))
    return store(flagged.where("again is null").withColumn("copy_no", F.lit(0).cast("long")).select(*rows.columns, "copy_no").unionByName(
        counted.select(*rows.columns, "copy_no")), "packing-numbered")


def pack(
    docs: DataFrame, capacity: int = 2048, group_rows: int = 8192, key: str = "doc_id", text: str = "text",
    source: str = "source", cluster: Column | None = None, clusters: DataFrame | None = None,
) -> DataFrame:
    """``(doc_id, source, piece, start, n_words, bin, slot)``: a row for each piece of each row.

    ``start`` counts words of the text; ``bin`` is the bin's name. ``cluster`` is the duplicate cluster of a row, by
    default the hash of its text. With ``clusters``, ``(copy, cluster)`` of :func:`near_clusters`, that hash is looked up there.
    """
    if cluster is None:
        cluster = F.when(F.col(text) != "", F.xxhash64(text))
    rows = store(docs.select(
        F.col(key).alias("doc_id"), F.col(source).alias("source"), cluster.alias("cluster"), words_in(F.col(text)).alias("words"),
        F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce(F.col(source).cast("string"), F.lit("")), text).alias("name")), "packing")
    rows = numbered_copies(rows)
    if clusters is not None:
        # Only copies whose cluster has another name are looked up, each of them once for every salt.
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        known = clusters.where("copy <> cluster").select(F.col("copy").alias("cluster"), F.col("cluster").alias("near"), salts)
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("name", "copy_no"), F.lit(SALTS)).cast("int"))
        rows = store(salted.join(known, ["cluster", "salt"], "left").withColumn("cluster", F.coalesce("near", "cluster")).select(rows.columns), "packing-clusters")
    groups = max(1, -(-rows.count() // group_rows))
    count = F.greatest(F.lit(1), F.ceil(F.col("words") / capacity)).cast("long")
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), count - 1))).select(
        "doc_id", "source", "cluster", "name", "copy_no", "piece", (F.col("piece") * capacity).alias("start"),
        F.least(F.lit(capacity).cast("long"), F.col("words") - F.col("piece") * capacity).alias("n_words"),
        F.pmod(F.xxhash64("name", "copy_no", "piece"), F.lit(groups)).alias("group"))
    full = pieces.where(F.col("n_words") == capacity)  # fills a bin alone
    kinds = dict(rows.dtypes)

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n_words", "name", "copy_no", "piece"], ascending=[False, True, True, True], kind="stable")
        plain = lambda column: [None if pd.isna(x) else x for x in column]
        frame["bin"] = best_fit(frame["n_words"].tolist(), plain(frame["source"]), plain(frame["cluster"]), capacity)
        frame["slot"] = frame.groupby("bin").cumcount()
        frame["bin"] = "g" + frame["group"].astype(str) + "-" + frame["bin"].astype(str)
        return frame[["doc_id", "source", "piece", "start", "n_words", "bin", "slot"]]

    # Ids travel as text: pandas would turn a column of long ids with nulls into floating point.
    schema = f"doc_id string, source {kinds['source']}, piece long, start long, n_words long, bin string, slot long"
    mixed = pieces.where(F.col("n_words") < capacity).withColumn("doc_id", F.col("doc_id").cast("string")).groupBy(
        "group").applyInPandas(packed, schema).withColumn("doc_id", F.col("doc_id").cast(kinds["doc_id"]))
    alone = full.select(
        "doc_id", "source", "piece", "start", "n_words",
        F.concat(F.lit("f"), F.hex("name"), F.lit("-"), "copy_no", F.lit("-"), "piece").alias("bin"), F.lit(0).cast("long").alias("slot"))
    return mixed.unionByName(alone)
