"""Benchmark passages in documents: SimHash windows, Hamming blocks, exact weighted-shingle similarity.

Words are lower-cased runs of letters, digits and marks; shingles have five words (all words of
a shorter item). A window has as many words as an item. Windows are placed so that a
shingle shared with an item of their size falls on its place in the item, and at all starts between two
such places less than a window, or at most twice the span of its shingles' starts (``size - k``), apart. No other window
is more similar than all of these. The places of a window's shared shingles are at most ``size - k`` from its start. If none
is to the left, its first shingle is not shared, so moving on loses nothing; if none is to the right, the same holds for its
last shingle and moving back. So it comes to a place, or between two that are no more than ``2 * (size - k)`` apart. Every window gets the SimHash of its shingles, weighted by how often they occur.
``radius + 1`` blocks of the fingerprints are joined: fingerprints that differ in at most ``radius``
bits agree in one block at least. Candidates within the radius are verified by
the weighted Jaccard similarity (sum of smaller over sum of larger counts) of
the shingles themselves.

Only DataFrame functions are used. Texts are cut, hashed and probed in one stage
without a shuffle; what leaves it are the found windows, once each. The shingles of the items are
broadcast in blocks of at most ``MAX_ANCHORS`` rows (40 bytes each), one pass over the documents
for each block.

Defined cases: null and empty texts, on either side, hold nothing; a document with fewer words than the
item is one window; equal passages count as one item with the smallest id; rows with
equal id and text give one result, null ids included; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobtide.llm.common import free_name, store

#: Upper bound of the rows broadcast at once.
MAX_ANCHORS = 500_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}\p{M}]+"), "")


def shingles_of(words: Column, k: Column) -> Column:
    """All runs of ``k`` words of an array with at least ``k`` words, as strings."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.concat_ws(" ", F.slice(words, i, k)))


def simhash(shingles: Column) -> Column:
    """Bits set in over half of the shingles' hashes, as a signed long."""
    hashes = F.transform(shingles, lambda s: F.xxhash64(s))
    one = lambda h, b: F.call_function("shiftright", h, b).bitwiseAND(F.lit(1).cast("long"))
    return F.aggregate(hashes, F.array_repeat(F.lit(0), 64), lambda sums, h: F.transform(
        sums, lambda n, b: n + one(h, b).cast("int")), lambda sums: F.aggregate(
        F.transform(sums, lambda n, b: F.when(n * 2 > F.size(hashes), F.call_function(
            "shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))),
        F.lit(0).cast("long"), lambda acc, bit: acc.bitwiseOR(bit)))


def blocks_of(fp: Column, radius: int) -> Column:
    """``(block, value)`` of the ``radius + 1`` blocks of a fingerprint."""
    count, out = radius + 1, []
    for b in range(count):
        at, end = 64 * b // count, 64 * (b + 1) // count
        value = F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << (end - at)) - 1).cast("long"))
        out.append(F.struct(F.lit(b).alias("block"), value.alias("value")))
    return F.array(*out)


def overlap(a: Column, b: Column) -> Column:
    """Sum of the smaller counts of the shingles that two arrays share."""
    times = lambda array, x: F.size(F.filter(array, lambda y: y == x))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, x: n + F.least(times(a, x), times(b, x)))


def item_table(items: DataFrame, shingle: int, radius: int, key: str, text: str) -> DataFrame:
    """One row for each distinct passage: id, words, size, shingle length, shingles, fingerprint."""
    cut = items.select(F.col(key).alias("item_id"), words_of(F.col(text)).alias("words")).where(F.size("words") > 0)
    once = cut.groupBy("words").agg(F.min("item_id").alias("item_id"))
    k = F.least(F.lit(shingle), F.size("words"))
    rows = once.select("item_id", "words", F.size("words").alias("size"), k.alias("k"),
                       shingles_of(F.col("words"), k).alias("wanted"), F.xxhash64("words").alias("item"))
    return store(rows.withColumn("fp", simhash(F.col("wanted"))), "items")


def hashed_shingles(rows: DataFrame, k: int) -> DataFrame:
    """A row for each place ``i`` of the word array ``w``, with the hash ``h`` of the ``k`` words from there."""
    places = rows.where(F.size("w") >= k).withColumn("i", F.explode(F.sequence(F.lit(0), F.size("w") - k)))
    return places.withColumn("h", F.xxhash64(*(F.col("w")[F.col("i") + j] for j in range(k))))


def windows(docs: DataFrame, items: DataFrame, key: str, text: str) -> DataFrame:
    """``(doc_id, tag, size, k, start, words)``: the item-sized windows that may be like an item of their size.

    ``tag`` is the hash of the text; with the id it tells documents apart.
    """
    cut = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("tag"), words_of(F.col(text)).alias("w"))
    found = []
    for row in items.select("k").distinct().collect():  # at most as many as a shingle has words
        k = row.k
        hashed = hashed_shingles(cut, k)
        anchors = store(hashed_shingles(items.where(F.col("k") == k).select("size", F.col("words").alias("w")), k).select(
            "h", F.col("i").alias("at"), "size").distinct(), "anchors")
        passes = max(1, -(-anchors.count() // MAX_ANCHORS))
        for n in range(passes):
            some = anchors.where(F.pmod(F.hash("h"), F.lit(passes)) == n)
            hit = hashed.join(F.broadcast(some), "h")
            start = F.greatest(F.lit(0), F.least(F.col("i") - F.col("at"), F.size("w") - F.col("size")))
            found.append(hit.select("doc_id", "tag", "size", F.lit(k).alias("k"), start.alias("start"), "w").select(
                "doc_id", "tag", "size", "k", "start", F.slice("w", F.col("start") + 1, 3 * F.col("size")).alias("near")))
    if not found:
        return docs.sparkSession.createDataFrame(
            [], f"doc_id {dict(docs.dtypes)[key]}, tag long, size int, k int, start int, words array<string>")
    placed = reduce(DataFrame.union, found).groupBy("doc_id", "tag", "size", "k", "start").agg(F.first("near").alias("near"))
    after = F.lead("start").over(Window.partitionBy("doc_id", "tag", "size", "k").orderBy("start"))
    gap = placed.withColumn("gap", after - F.col("start"))
    reach = F.greatest(F.col("size") - 1, 2 * (F.col("size") - F.col("k")))
    ahead = F.when(F.col("gap") <= reach, F.col("gap") - 1).otherwise(0)
    moved = gap.withColumn("by", F.explode(F.sequence(F.lit(0), ahead)))
    return moved.select("doc_id", "tag", "size", "k", (F.col("start") + F.col("by")).alias("start"),
                        F.slice("near", F.col("by") + 1, F.col("size")).alias("words"))


def find_passages(
    docs: DataFrame, items: DataFrame, similarity: float = 0.8, shingle: int = 5, radius: int = 22,
    key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``(doc_id, tag, item_id, start, n_words, similarity)``: the best window of each document and item.

    ``start`` and ``n_words`` count words of the document. Of equally similar
    windows the first of those placed is given.
    """
    wanted = item_table(items, shingle, radius, item_key, item_text)
    made = windows(docs, wanted, key, text)
    marked = store(
        made.withColumn("has", shingles_of(F.col("words"), F.col("k")))
        .withColumn("n_words", F.size("words")).drop("words").withColumn("fp", simhash(F.col("has"))), "windows")
    left = marked.select("*", F.explode(blocks_of(F.col("fp"), radius)).alias("b"))
    right = wanted.select("item", "item_id", "size", "wanted", F.col("fp").alias("item_fp"),
                          F.explode(blocks_of(F.col("fp"), radius)).alias("b"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius
    pairs = left.join(right, ["size", "b"]).where(near)
    common = overlap(F.col("has"), F.col("wanted"))
    scored = pairs.withColumn("common", common).withColumn(
        "similarity", F.col("common") / (F.size("has") + F.size("wanted") - F.col("common")))
    best = scored.where(F.col("similarity") >= similarity).groupBy("doc_id", "tag", "item").agg(F.min(F.struct(
        (-F.col("similarity")).alias("less"), "start", "n_words", "item_id")).alias("best"))
    return best.select("doc_id", "tag", "best.item_id", "best.start", "best.n_words", F.round(-F.col("best.less"), 6).alias("similarity"))


def without_passages(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage; all columns stay as they are."""
    names = [free_name(docs, x) for x in ("__tag", "__bad_id", "__bad_tag")]
    bad = store(find_passages(docs, items, key=key, text=text, **how).select(
        F.col("doc_id").alias(names[1]), F.col("tag").alias(names[2])).distinct(), "leaks")
    marked = docs.withColumn(names[0], F.xxhash64(text))
    same = (F.col(names[0]) == F.col(names[2])) & F.col(key).eqNullSafe(F.col(names[1]))
    return marked.join(bad, same, "left_anti").drop(names[0])
