"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

Two fingerprints of 64 bits link when they differ in at most two bits. A
fingerprint is cut into three segments of at most 23 bits. With two errors in
three segments there is always an exact segment whose successor (1 -> 2 -> 3 -> 1)
has at most one error. The perfect (23, 12) Golay code maps a word and its 23
one-bit neighbours to one or six codewords; words one or two bits apart share
at least one of them. A key is therefore (segment, its exact value, a codeword index of
the successor): some 16 keys for each distinct fingerprint, and every linked
pair shares one.

Equal fingerprints are merged first, so copies cost nothing. Keys are counted
before anything is grouped: buckets of at most ``bucket`` fingerprints are
verified pairwise in the task and leave as a spanning forest; members of
larger buckets go another exact way (``ball_edges``) that never looks at pairs.
Components are then found by alternating large-star and small-star steps.

Defined cases: a null text has no words (fingerprint zero); a null id gets the
smallest id of its component, which is null when no member has one; repeated
rows each get a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide.llm.common import free_name, slices, store

#: (first bit, bits) of the three segments.
SEGMENTS = [(0, 22), (22, 21), (43, 21)]
#: Fixed value: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the (23, 12) Golay code.
GOLAY = 0b101011100011


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Majority bits of the XXH64 (seed 42) of all word shingles of a text, as an unsigned integer."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: 1 - shingle].tolist()
    digest = xxhash.xxh64_intdigest
    bits, total = np.zeros(64, np.int64), len(starts)
    ends = ends[shingle - 1 :].tolist()
    for at in range(0, total, 65536):
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at : at + 65536], ends[at : at + 65536])], "<u8")
        bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fp, tag)`` for each row: the fingerprint as a signed long, and a hash of the text where the id is null."""
    kind = dict(docs.dtypes)[key]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = np.array([fingerprint(x, shingle) for x in part.column(1).to_pylist()], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found), part.column(2)], names=["doc_id", "fp", "tag"])

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.when(F.col(key).isNull(), F.xxhash64(text)).alias("tag"))
    return rows.mapInArrow(hashed, f"doc_id {kind}, fp long, tag long")


def syndromes() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of ``high << 11`` and, by syndrome, the error pattern of weight three or less."""

    def remainder(x: int) -> int:
        for bit in range(22, 10, -1):
            if x >> bit & 1:
                x ^= GOLAY << (bit - 11)
        return x

    high = np.array([remainder(x << 11) for x in range(4096)], np.uint32)
    ones = [1 << i for i in range(23)]
    errors = np.zeros(2048, np.uint32)
    for pattern in [0, *ones, *(a | b for a in ones for b in ones if a < b),
                    *(a | b | c for a in ones for b in ones if a < b for c in ones if b < c)]:
        errors[remainder(pattern)] = pattern
    return high, errors


def codewords(words: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Message index of the codeword nearest to each 23-bit word."""
    high, errors = tables
    return (words ^ errors[high[words >> 11] ^ (words & 0x7FF)]) >> 11


def fuzzy_keys(fps: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``(position in fps, key)`` of all keys, each once for a fingerprint."""
    values = [((fps >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.uint32) for at, n in SEGMENTS]
    near = np.array([0, *(1 << i for i in range(23))], np.uint32)
    rows, keys = [], []
    for s, exact in enumerate(values):
        index = np.sort(codewords(values[(s + 1) % 3][:, None] ^ near[None, :], tables), axis=1)
        first = np.ones(index.shape, bool)
        first[:, 1:] = index[:, 1:] != index[:, :-1]
        row, column = np.nonzero(first)
        rows.append(row)
        keys.append((np.int64(s) << 34) | (exact[row].astype(np.int64) << 12) | index[row, column].astype(np.int64))
    return np.concatenate(rows), np.concatenate(keys)


def forest(members: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the members within ``distance`` bits of each other."""
    fps = np.unique(np.asarray(members, np.int64)).view(np.uint64)
    todo, edges = np.ones(len(fps), bool), []
    for start in range(len(fps)):
        if not todo[start]:
            continue
        todo[start], front = False, [start]
        while front:
            at = front.pop()
            near = np.nonzero(todo & (np.bitwise_count(fps ^ fps[at]) <= distance))[0]
            todo[near] = False
            front.extend(near.tolist())
            edges.extend((int(fps[at : at + 1].view(np.int64)[0]), int(x)) for x in fps[near].view(np.int64))
    return edges


def ball_edges(fps: DataFrame) -> DataFrame:
    """Edges with the same components as all links of at most two bits, without comparing pairs.

    Fingerprints at most two bits apart have a common word within one bit of
    both, and fingerprints with such a common word are at most two bits apart.
    So all that meet in a word are joined to the smallest of them.
    """
    flips = F.concat(F.array(F.lit(0).cast("long")), F.transform(
        F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    meet = fps.select("fp", F.explode(F.transform(flips, lambda z: F.col("fp").bitwiseXOR(z))).alias("z"))
    low = meet.groupBy("z").agg(F.min("fp").alias("low"), F.count("*").alias("n")).where("n > 1").drop("n")
    return meet.join(low, "z").where("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b"))


def link_edges(fps: DataFrame, distance: int = 2, bucket: int = 256) -> DataFrame:
    """``(a, b)``: edges that connect the distinct fingerprints ``fp`` as all links would.

    ``distance`` may be 0, 1 or 2; the keys guarantee no more.
    """
    if not 0 <= distance <= 2:
        raise ValueError("the keys guarantee links of at most two bits")
    tables = syndromes()

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 8192):
            fps = part.column(0).to_numpy(zero_copy_only=False)
            row, key = fuzzy_keys(fps.view(np.uint64), tables)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[row])], names=["key", "fp"])

    @F.pandas_udf("array<struct<a:long,b:long>>")
    def verified(groups: pd.Series) -> pd.Series:
        return pd.Series([[{"a": a, "b": b} for a, b in forest(g, distance)] for g in groups])

    keys = fps.select("fp").mapInArrow(keyed, "key long, fp long")
    sizes = store(keys.groupBy("key").count().where("count > 1"), "simhash-buckets")
    shared = store(keys.join(sizes, "key"), "simhash-keys")
    small = shared.where(F.col("count") <= bucket).groupBy("key").agg(F.collect_list("fp").alias("fps"))
    edges = small.select(F.explode(verified("fps")).alias("e")).select("e.a", "e.b")
    large = shared.where(F.col("count") > bucket).select("fp").distinct()
    if distance == 2:
        exact = ball_edges(large)
    else:  # fewer bits: the same meeting words, then only pairs that differ in one bit
        single = F.explode(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(
            F.call_function("shiftleft", F.lit(1).cast("long"), i))))
        exact = large.select(F.col("fp").alias("a"), single.alias("b")).join(
            large.select(F.col("fp").alias("b")), "b", "left_semi").where(F.lit(distance == 1)).select("a", "b")
    return edges.union(exact).distinct()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """``(node, root)`` for nodes that are not their own root; the root is the smallest node.

    Large-star and small-star steps alternate until nothing changes. Each round is
    written, so a lost executor costs at most one round.
    """
    now = store(
        edges.where("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct(),
        "components",
    )
    mark = None
    for _ in range(rounds):
        stat = now.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
        if stat == mark:
            return now.select(F.col("high").alias("node"), F.col("low").alias("root"))
        mark = stat
        both = now.union(now.select(F.col("low").alias("high"), F.col("high").alias("low")))
        least = both.groupBy("high").agg(F.least(F.min("low"), F.col("high")).alias("least"))
        large = (
            both.join(least, "high").where("low > high")
            .select(F.col("low").alias("high"), F.col("least").alias("low")).where("high <> low").distinct()
        )
        smallest = large.groupBy("high").agg(F.min("low").alias("least"))
        star = large.join(smallest, "high").select(
            F.explode(F.array(F.struct(F.col("high"), F.col("least").alias("low")),
                              F.struct(F.col("low").alias("high"), F.col("least").alias("low")))).alias("e")
        ).select("e.high", "e.low").where("high <> low").distinct()
        now = store(star, "components")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def classes(docs: DataFrame, shingle: int, distance: int, bucket: int, key: str, text: str) -> DataFrame:
    """``(doc_id, fp, tag, root, component_id)`` for each row; ``root`` is the smallest linked fingerprint."""
    hashed = store(fingerprints(docs, shingle, key, text), "simhash")
    distinct = store(hashed.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-distinct")
    roots = components(link_edges(distinct, distance, bucket))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return hashed.join(rooted.join(smallest, "root").drop("low"), "fp")


def near_duplicates(
    docs: DataFrame, shingle: int = 3, distance: int = 2, bucket: int = 256, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for each row of ``docs``."""
    return classes(docs, shingle, distance, bucket, key, text).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, distance: int = 2, bucket: int = 256,
             key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with one row of each component: the one with the smallest id.

    Where several rows carry that id, one of them stays. A component without any id
    keeps one of its rows.
    """
    found = store(classes(docs, shingle, distance, bucket, key, text), "simhash-classes")
    times = free_name(docs, "__times")
    best = store(found.where("doc_id = component_id").groupBy(F.col("doc_id").alias(key)).agg(F.count("*").alias(times)), "simhash-best")
    # Always a shuffled join: the table of winners grows with the documents.
    winners = lambda which: docs.join(best.where(which).drop(times).hint("merge"), key, "left_semi").select(docs.columns)
    out = winners(F.col(times) == 1)
    if not best.where(F.col(times) > 1).isEmpty():
        out = out.unionByName(winners(F.col(times) > 1).dropDuplicates([key]))
    nameless = found.where("component_id is null")
    if not nameless.isEmpty():
        tag = free_name(docs, "__tag")
        tags = nameless.groupBy("root").agg(F.min("tag").alias(tag))
        blank = docs.where(F.col(key).isNull()).withColumn(tag, F.xxhash64(text))
        out = out.unionByName(blank.join(tags, tag, "left_semi").dropDuplicates([tag]).select(docs.columns))
    return out
