"""Importance resampling towards a target: documents are drawn by how much their hashed n-grams look like the target's.

Features are runs of one to ``longest`` words. A batch interns its n-grams in an open-addressed table of
NumPy arrays: keys are XXH64 of the n-gram's bytes, a slot that is taken is compared byte by byte with its
owner, and what differs goes on to the next slot. All occurrences probe at once. A slot holds the n-gram's bucket
and its count. The CRC-32 behind a bucket is worked out once for each distinct n-gram of the batch, joined from its words' (those
are interned in the same way). Counts give the corpus's bucket totals. In the second pass the slot
of each occurrence gathers its bucket's gain, and a document's gains are added up.

Bucket totals are summed by Spark; ``buckets`` gains, a fixed number, travel to the tasks. A document's
noise comes from its id, so a draw is the same on every run. Drawn rows are numbered in sorted partitions
shifted by the sizes of the partitions before.

Defined cases: a null text has no words (no features, weight 0); rows with a null id take the noise of an empty id;
repeated rows count each and may be drawn each; equal scores go by id (null first), then weight and features;
a text of any length is cut in parts that share words; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobtide.llm.common import slices, store
from jobtide.llm.spans import Cut, byte_kinds, crc_joined, cuts, raw_texts, same_bytes, xxh64

KINDS = byte_kinds(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))


class Table:
    """The distinct n-grams of a cut."""

    def __init__(self, text: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        keys = xxh64(text, starts, sizes)
        capacity = 1 << max(4, (2 * len(keys)).bit_length())
        owner = np.full(capacity, -1, np.int32)
        probe = (keys & np.uint64(capacity - 1)).astype(np.int32)
        todo = np.arange(len(keys), dtype=np.int32)
        while len(todo):
            slot = probe[todo]
            mine = owner[slot]
            free = mine < 0
            if free.any():
                owner[slot[free]] = todo[free]  # one of those that want a free slot gets it
                mine = owner[slot]
            same = (keys[mine] == keys[todo]) & (sizes[mine] == sizes[todo])
            some = np.flatnonzero(same & (mine != todo))
            same[some] = same_bytes(text, starts[mine[some]], starts[todo[some]], sizes[todo[some]])
            todo = todo[~same]
            probe[todo] = (probe[todo] + 1) & (capacity - 1)
        #: The slot of each occurrence; which slots are taken, and the first occurrence there.
        self.slots, self.capacity = probe, capacity
        self.taken = np.flatnonzero(owner >= 0)
        self.first = owner[self.taken]


def word_checksums(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of each word, worked out once for each distinct one."""
    table, data, crc = Table(text, starts, sizes), text.tobytes(), zlib.crc32
    held = np.zeros(table.capacity, np.uint32)
    held[table.taken] = [crc(data[a : a + z]) for a, z in zip(starts[table.first].tolist(), sizes[table.first].tolist())]
    return held[table.slots]


class Features:
    """The n-grams of a cut in a table whose slots hold the bucket and the count of each."""

    def __init__(self, cut: Cut, longest: int, buckets: int):
        size = cut.ends - cut.starts
        word = word_checksums(cut.text, cut.starts, size)
        gap = np.full(len(word), zlib.crc32(b" "), np.uint32)
        spaced = crc_joined(gap, word, size)  # of a space and the word
        found = [(at, np.full(len(at), n)) for n in range(1, longest + 1) for at in [cut.grams(n)]]
        at, n = (np.concatenate(x) for x in zip(*found))
        start = cut.starts[at]
        table = Table(cut.text, start, cut.ends[at + n - 1] - start)
        first, most = at[table.first], n[table.first]
        crc = word[first]
        for j in range(1, longest):
            more = np.flatnonzero(most > j)
            nth = first[more] + j
            crc[more] = crc_joined(crc[more], spaced[nth], size[nth] + 1)
        self.docs, self.slots, self.taken = cut.docs[at], table.slots, table.taken
        self.bucket = np.zeros(table.capacity, np.int64)
        self.bucket[table.taken] = crc % np.uint32(buckets)
        self.count = np.bincount(table.slots, minlength=table.capacity)


def bucket_totals(docs: DataFrame, longest: int, buckets: int, text: str = "text") -> np.ndarray:
    """Features of all texts by bucket."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for part in slices(batches):
            for cut in cuts(raw_texts(part.column(0)), KINDS, longest):
                found = Features(cut, longest, buckets)
                total += np.bincount(found.bucket[found.taken], found.count[found.taken], buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in docs.select(F.col(text)).mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of target and corpus, one added to each bucket."""
    m, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + m) / ((s + 1) * (t_all + m))))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weighed(docs: DataFrame, gains: np.ndarray, longest: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_features, weight)`` for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = part.num_rows
            words, features, weight = (np.zeros(rows, np.int64) for _ in range(3))
            for cut in cuts(raw_texts(part.column(1)), KINDS, longest):
                found = Features(cut, longest, len(shared.value))
                gain = shared.value[found.bucket][found.slots]
                words += np.bincount(cut.docs[cut.grams(1)], minlength=rows)
                features += np.bincount(found.docs, minlength=rows)
                weight += np.bincount(found.docs, gain, rows).astype(np.int64)  # sums of integers below 2^53: exact
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(words), pa.array(features), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        gathered, f"doc_id {kind}, n_words long, n_features long, weight long")


def numbered(rows: DataFrame, order: list, out: str = "rank") -> DataFrame:
    """Positions from 1 in the given order: sorted partitions, each shifted by those before it."""
    parts = store(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranked")
    before, offsets = 0, {}
    for r in sorted(parts.groupBy("part").count().collect()):  # a number for each partition
        offsets[r.part] = before
        before += r["count"]
    shift = F.lit(0).cast("long")
    if offsets:
        shift = F.element_at(F.from_json(F.lit("{" + ",".join(f'"{k}":{v}' for k, v in offsets.items()) + "}"), "map<string,long>"), F.col("part").cast("string"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return parts.withColumn(out, inside + shift).drop("part")


def resample(
    docs: DataFrame, target: DataFrame, share: int = 5, least_words: int = 20, longest: int = 3, buckets: int = 10_000, seed: int = 42,
    key: str = "doc_id", text: str = "text", target_text: str = "text",
) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` for each row; ``share`` percent of the rows with enough words have a rank."""
    gains = bucket_gains(bucket_totals(docs, longest, buckets, text), bucket_totals(target, longest, buckets, target_text))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = store(weighed(docs, gains, longest, key, text).withColumn("score", F.col("weight") + noise), "resampling")
    able = F.col("n_words") >= least_words
    drawn = rows.where(able).count() * share // 100
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("weight"), F.asc("n_features")]
    ranked = numbered(rows.where(able), order).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")).cast("long"))
    return ranked.unionByName(rows.where(~able).withColumn("rank", F.lit(None).cast("long"))).select(
        "doc_id", "n_features", "weight", "score", "rank")
