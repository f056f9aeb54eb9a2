"""Collocations: phrases whose words meet more often than their parts would, from Rabin-Karp fingerprints.

Prefix polynomials over the bytes of a cut (one cumulative sum modulo 2^64) give the fingerprint of
every n-gram by a subtraction and a product. Tasks add up equal fingerprints batch by batch, and check
inside the batch that equal fingerprints are equal phrases of one language. An entry is a fingerprint with its count in
the batch, a pointer (row, word) to one occurrence and 32 bits of the XXH64 of its phrase. Entries are packed by ranges
of fingerprints, so a shuffle moves some sixteen bytes for each, and a common phrase comes once from a batch. A range's
task adds up the entries that agree in fingerprint and checksum, and lets one entry of each frequent phrase go on, with
its count over all batches. So equal fingerprints of different phrases fall apart; two phrases would only be
taken for one if 64 and 32 bits of independent hashes agreed: a chance of some 1e-10 for any two of three billion phrases.

Pointers are joined to the texts, where each phrase is read once. A pointer that does
not lead to its fingerprint means that ``docs`` gives other rows when read again, and fails the job.

Levels go up from words (counted as text, as a batch has few) to phrases of ``longest`` words. An n-gram can
only be frequent if both of its (n-1)-grams are; these are looked up in a Bloom filter of fixed size
(``filter_bits``), which travels to the tasks. It only saves shuffle: what it lets through too much is counted and found rare.

Defined cases: a null text is empty; a null language is ``und``; repeated rows count each; null ids do not matter;
a text of any length is cut in parts that share words; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobtide.llm.common import slices, store
from jobtide.llm.spans import Cut, byte_kinds, cuts, raw_texts, same_bytes, xxh64

KINDS = byte_kinds(b" \t", b".,;:!?\n\x0b\x0c\r")
#: Words of a batch, after which its entries leave.
BATCH = 2_200_000
#: Occurrences compared, or entries hashed, at once.
BLOCK = 1 << 17
#: Bits of a fingerprint, and of a length, that travel with a pointer.
CHECK, LENGTH = 20, 4
#: Bits of the filter that are set in one task.
CHUNK = 1 << 19

_RANDOM = np.random.default_rng(20)
BYTES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
BASE = int(_RANDOM.integers(1, 1 << 62)) * 4 + 1
MIX = np.uint64(0x9E3779B97F4A7C15)


def powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n-1)`` modulo 2^64, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out[:n]


class Hasher:
    """Fingerprints of the n-grams of a cut."""

    def __init__(self, base: int = BASE, table: np.ndarray = BYTES):
        self.base, self.inverse, self.table = base, pow(base, -1, 1 << 64), table
        self.up = self.down = np.zeros(0, np.uint64)

    def prefixes(self, cut: Cut) -> np.ndarray:
        n = len(cut.text) + 1
        if len(self.up) < n:
            self.up, self.down = powers(self.base, 2 * n), powers(self.inverse, 2 * n)
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.table[cut.text] * self.down[: n - 1], dtype=np.uint64)])

    def grams(self, cut: Cut, prefixes: np.ndarray, at: np.ndarray, n: int, langs: np.ndarray) -> np.ndarray:
        """Fingerprints of the n-grams that start at the words ``at``; ``langs`` holds a number for each text's language."""
        start = cut.starts[at]
        found = (prefixes[cut.ends[at + n - 1]] - prefixes[start]) * self.up[start] + langs[cut.docs[at]]
        found ^= found >> np.uint64(31)
        found *= MIX
        return found ^ (found >> np.uint64(29))


def lang_numbers(names: list[str]) -> np.ndarray:
    """A number for each language, from its bytes."""
    known: dict[str, int] = {}
    for name in set(names):
        h = 1469598103934665603
        for byte in name.encode():
            h = (h ^ byte) * 1099511628211 % (1 << 64)
        known[name] = h
    return np.array([known[x] for x in names], np.uint64)


def planes(values: np.ndarray) -> bytes:
    """Bytes of an array with all first bytes first, so that compression finds the zeros."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()


def unplanes(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


class Batch:
    """Occurrences of the n-grams of one length, until they are added up."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.texts: list[np.ndarray] = []
        self.size = self.words = 0

    def add(self, cut: Cut, n: int, at: np.ndarray, fps: np.ndarray, row: int) -> None:
        start = cut.starts[at]
        small = (start + self.size, cut.ends[at + n - 1] - start, cut.docs[at] + row, cut.number[at])
        self.parts.append((fps, *(x.astype(np.int32) for x in small)))
        self.texts.append(cut.text)
        self.size += len(cut.text)
        self.words += len(cut.starts)

    def __len__(self) -> int:
        return sum(len(p[0]) for p in self.parts)

    def added_up(self, langs: list[str]) -> tuple[np.ndarray, ...]:
        """``(fingerprint, count, row, word, start, size)`` in order of the fingerprints, and the text; empties the batch.

        ``langs`` has the language of each row.
        """
        known: dict[str, int] = {}
        lang = np.array([known.setdefault(x, len(known)) for x in langs], np.int32)
        columns = list(zip(*self.parts))
        self.parts = []
        fps, start, size, row, word = (np.concatenate(columns.pop(0)) for _ in range(5))
        text, self.texts = np.concatenate(self.texts), []
        order = np.argsort(fps, kind="stable").astype(np.int32)
        ordered = fps[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        count = np.diff(np.append(first, len(ordered)))
        del ordered
        lead = np.repeat(order[first], count)
        wrong = np.zeros(len(order), bool)
        for some in range(0, len(order), BLOCK):  # a block at a time: the comparison needs some 60 bytes for each
            i, j = order[some : some + BLOCK], lead[some : some + BLOCK]
            same = (size[i] == size[j]) & (lang[row[i]] == lang[row[j]])
            wrong[some : some + BLOCK] = ~same | ~same_bytes(text, start[i], start[j], np.minimum(size[i], size[j]))
        del lead
        best = order[first]
        if wrong.any():  # equal fingerprints of different phrases: entries of their own
            count -= np.add.reduceat(wrong, first).astype(count.dtype)
            others: dict[tuple, list[int]] = {}
            for i in order[wrong].tolist():
                others.setdefault((int(fps[i]), int(lang[row[i]]), text[start[i] : start[i] + size[i]].tobytes()), []).append(i)
            best = np.append(best, np.array([i[0] for i in others.values()], best.dtype))
            count = np.append(count, [len(i) for i in others.values()])
            again = np.argsort(fps[best], kind="stable")
            best, count = best[again], count[again]
        return fps[best], count.astype(np.int64), row[best], word[best], start[best], size[best], text


def checksums(text: np.ndarray, start: np.ndarray, size: np.ndarray, langs: np.ndarray) -> np.ndarray:
    """32 bits of the XXH64 of each slice and its language's number, a block at a time."""
    out = np.empty(len(start), np.uint32)
    for at in range(0, len(start), BLOCK):
        some = slice(at, at + BLOCK)
        out[some] = (xxh64(text, start[some], size[some]) ^ langs[some]) * MIX >> np.uint64(32)
    return out


def rows_of(docs: DataFrame, lang: str, text: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))


def count_words(docs: DataFrame, longest: int) -> DataFrame:
    """``(lang, phrase, f)`` of all words; ``docs`` has ``row, lang, text``."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, batch, names = Hasher(), Batch(), []

        def full() -> Iterator[pa.RecordBatch]:
            if not len(batch):
                return
            _, count, row, _, start, size, text = batch.added_up(names)
            data = text.tobytes()
            for at in range(0, len(count), 50_000):
                some = slice(at, at + 50_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[r] for r in row[some].tolist()], pa.string()),
                     pa.array([data[a : a + z].decode() for a, z in zip(start[some].tolist(), size[some].tolist())], pa.string()), pa.array(count[some])],
                    names=["lang", "phrase", "f"])

        for part in slices(batches):
            langs = part.column(1).to_pylist()
            names = [*names, *langs] if len(batch) else langs
            numbers, first = lang_numbers(langs), len(names) - len(langs)
            for cut in cuts(raw_texts(part.column(2)), KINDS, longest):
                batch.add(cut, 1, at := cut.grams(1), hasher.grams(cut, hasher.prefixes(cut), at, 1, numbers), first)
                if batch.words >= BATCH:
                    yield from full()
                    batch = Batch()
        yield from full()

    return docs.mapInArrow(counted, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def word_prints(words: DataFrame) -> DataFrame:
    """``(fp)``: the fingerprints of words given as ``lang, phrase``."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for part in slices(batches, 8192):
            numbers = lang_numbers(part.column(0).to_pylist())
            for cut in cuts(raw_texts(part.column(1)), KINDS, 1):
                found = hasher.grams(cut, hasher.prefixes(cut), cut.grams(1), 1, numbers)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["fp"])

    return words.select("lang", "phrase").mapInArrow(hashed, "fp long")


def bloom_filter(fps: DataFrame, bits: int) -> np.ndarray:
    """A filter of ``bits`` (a power of two) with two places for each ``fp``; its size does not depend on the data.

    Places are dealt out by chunks of the filter, and a task sets the bits of its chunks as they come.
    """
    shift, mask = bits.bit_length() - 1, F.lit(bits - 1).cast("long")
    places = fps.select(F.explode(F.array(
        F.col("fp").bitwiseAND(mask), F.shiftrightunsigned("fp", shift).bitwiseAND(mask))).alias("place"))
    chunk = F.shiftright("place", CHUNK.bit_length() - 1).cast("int")

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            chunks, at = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for c in np.unique(chunks).tolist():
                inside = at[chunks == c] - c * CHUNK
                np.bitwise_or.at(held.setdefault(c, np.zeros(min(CHUNK, bits) // 8, np.uint8)), inside >> 3, (128 >> (inside & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["chunk", "bits"])

    out = np.zeros(bits // 8, np.uint8)
    for r in places.select(chunk.alias("chunk"), "place").repartition("chunk").mapInArrow(filled, "chunk int, bits binary").collect():
        out[r.chunk * CHUNK // 8 :][: len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    return out


def may_hold(bloom: np.ndarray, fps: np.ndarray) -> np.ndarray:
    mask, shift = np.uint64(len(bloom) * 8 - 1), np.uint64((len(bloom) * 8).bit_length() - 1)
    out = np.ones(len(fps), bool)
    for place in (fps & mask, (fps >> shift) & mask):
        out &= (bloom[(place >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (place & np.uint64(7)).astype(np.uint8)) & 1) > 0
    return out


def gram_entries(docs: DataFrame, n: int, longest: int, bloom: np.ndarray, buckets: int) -> DataFrame:
    """Packed entries of the n-grams whose (n-1)-grams the filter may hold, by range of fingerprints."""
    shared = docs.sparkSession.sparkContext.broadcast(bloom)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, batch, ids, names = Hasher(), Batch(), np.zeros(0, np.int64), []

        def full() -> Iterator[pa.RecordBatch]:
            if not len(batch):
                return
            fps, count, row, word, start, size, text = batch.added_up(names)
            checks = checksums(text, start, size, lang_numbers(names)[row])
            del start, size, text
            row, low = ids[row] - ids[0], int(ids[0])  # rows of a task have numbers that follow each other
            bucket = ((fps >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            stops = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(fps)]
            columns = [(fps, "<u8"), (count, "<u4"), (row, "<u4"), (word, "<u4"), (checks, "<u4")]
            spans = list(zip(stops[:-1], stops[1:]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(bucket[a]) for a, _ in spans], pa.int32()), pa.array([low] * len(spans), pa.int64()),
                 *(pa.array([planes(values[a:b].astype(kind)) for a, b in spans], pa.binary()) for values, kind in columns)],
                names=["bucket", "low", "fps", "counts", "rows", "words", "checks"])

        for part in slices(batches):
            mine, langs = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_pylist()
            ids, names = (np.concatenate([ids, mine]), [*names, *langs]) if len(batch) else (mine, langs)
            numbers, first = lang_numbers(langs), len(ids) - len(mine)
            for cut in cuts(raw_texts(part.column(2)), KINDS, longest):
                at, prefixes = cut.grams(n), hasher.prefixes(cut)
                for side in (0, 1):
                    at = at[may_hold(shared.value, hasher.grams(cut, prefixes, at + side, n - 1, numbers))]
                batch.add(cut, n, at, hasher.grams(cut, prefixes, at, n, numbers), first)
                if batch.words >= BATCH:
                    yield from full()
                    batch = Batch()
        yield from full()

    return docs.mapInArrow(packed, "bucket int, low long, fps binary, counts binary, rows binary, words binary, checks binary")


def frequent_entries(packed: DataFrame, n: int, least: int) -> DataFrame:
    """``(row, place, f, fp)``: one entry of each phrase with ``least`` occurrences or more, with its count over all batches."""

    def added_up(table: pa.Table) -> pa.Table:
        fps, counts, words, checks = (np.concatenate([unplanes(x, kind) for x in table.column(c).to_pylist()])
                                      for c, kind in (("fps", "<u8"), ("counts", "<u4"), ("words", "<u4"), ("checks", "<u4")))
        rows = np.concatenate([unplanes(x, "<u4").astype(np.int64) + low for x, low in zip(table.column("rows").to_pylist(), table.column("low").to_pylist())])
        order = np.argsort(fps, kind="stable")
        again = fps[order[1:]] == fps[order[:-1]]
        other = checks[order[1:]] != checks[order[:-1]]
        if (again & other).any():  # equal fingerprints of different phrases
            order = np.lexsort((checks, fps))
            again = fps[order[1:]] == fps[order[:-1]]
            other = checks[order[1:]] != checks[order[:-1]]
        first = np.flatnonzero(np.concatenate([[True], ~again | other]))
        total = np.add.reduceat(counts[order].astype(np.int64), first)
        lead, total = order[first[total >= least]], total[total >= least]
        fps = fps[lead]
        place = words[lead].astype(np.int64) << (CHECK + LENGTH) | n << CHECK | (fps >> np.uint64(64 - CHECK)).astype(np.int64)
        return pa.table({"row": rows[lead], "place": place, "f": total, "fp": fps.view(np.int64)})

    return packed.groupBy("bucket").applyInArrow(added_up, "row long, place long, f long, fp long")


def read_phrases(docs: DataFrame, entries: DataFrame, longest: int) -> DataFrame:
    """``(lang, phrase, words, f)``: the phrases that the pointers of the entries lead to."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for part in slices(batches):
            langs, lists = part.column(0).to_pylist(), part.column(2)
            numbers = lang_numbers(langs)
            doc = np.repeat(np.arange(len(langs)), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            place, f = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            word, n, check = place >> (CHECK + LENGTH), place >> CHECK & ((1 << LENGTH) - 1), place & ((1 << CHECK) - 1)
            todo = np.ones(len(place), bool)
            for cut in cuts(raw_texts(part.column(1)), KINDS, longest):
                known, prefixes = cut.docs.astype(np.int64) << 36 | cut.number, hasher.prefixes(cut)
                wanted = doc.astype(np.int64) << 36 | word
                at = np.searchsorted(known, wanted)
                here = todo & (at + n <= len(known))
                here[here] = known[at[here]] == wanted[here]
                data = cut.text.tobytes()
                for size in range(2, longest + 1):
                    some = np.flatnonzero(here & (n == size))
                    if not len(some):
                        continue
                    found = hasher.grams(cut, prefixes, at[some], size, numbers)
                    some = some[(found >> np.uint64(64 - CHECK)).astype(np.int64) == check[some]]
                    todo[some] = False
                    a, b = cut.starts[at[some]].tolist(), cut.ends[at[some] + size - 1].tolist()
                    named = [[langs[i] for i in doc[some].tolist()], [data[x:y].decode() for x, y in zip(a, b)]]
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(x, pa.string()) for x in named), pa.array(np.full(len(some), size, np.int32)), pa.array(f[some])],
                        names=["lang", "phrase", "words", "f"])
            if todo.any():
                raise ValueError("a pointer does not lead to its phrase: the documents give other rows when they are read again; store them first")

    pointers = entries.groupBy("row").agg(F.collect_list(F.struct("place", "f")).alias("places"))
    texts = docs.join(pointers.hint("merge"), "row").select("lang", "text", "places")
    return texts.mapInArrow(read, "lang string, phrase string, words int, f long")


def frequent_phrases(docs: DataFrame, least: int = 10, longest: int = 3, filter_bits: int = 1 << 26, bucket_bytes: int = 8 << 20) -> tuple[DataFrame, DataFrame]:
    """``(lang, phrase, f)`` of all words, and ``(lang, phrase, words, f)`` of phrases with ``least`` occurrences or more."""
    if not 2 <= longest < 1 << LENGTH:
        raise ValueError(f"phrases have 2 to {(1 << LENGTH) - 1} words")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    words = store(count_words(docs, longest), "collocation-words")
    prints, levels = word_prints(words.where(F.col("f") >= least)), []
    for n in range(2, longest + 1):
        packed = gram_entries(docs, n, longest, bloom_filter(prints, filter_bits), buckets)
        levels.append(store(frequent_entries(packed, n, least), f"collocation-entries-{n}"))
        prints = levels[-1].select("fp")
    entries = levels[0]
    for level in levels[1:]:
        entries = entries.unionByName(level)
    return words, store(read_phrases(docs, entries.drop("fp"), longest), "collocation-phrases")


def scored(phrases: DataFrame, words: DataFrame, least: int) -> DataFrame:
    """``(lang, phrase, words, a, l, r, score)``: each phrase by its lowest-scoring cut, exactly."""
    counts = words.where(F.col("f") >= least).select("lang", "phrase", "f").unionByName(phrases.select("lang", "phrase", "f"))
    parts = F.split("phrase", " ")
    cut = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "lang", F.col("f").alias("a"), "words", "k", F.array_join(F.slice(parts, F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice(parts, F.col("k") + 1, F.col("words")), " ").alias("right"))
    cut = cut.join(counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cut = cut.join(counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    wide = {c: F.col(c).cast("decimal(15,0)") for c in "alr"}  # products fit 38 digits
    score = F.call_function("div", wide["a"] * wide["a"] * F.lit(1_000_000).cast("decimal(7,0)"), wide["l"] * wide["r"])
    cut = cut.select("lang", F.concat_ws(" ", "left", "right").alias("phrase"), "words", "a", "k", "l", "r", score.alias("score"))
    best = cut.where("words > 2").groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "words", "a", "l", "r")).alias("best"))
    single = cut.where("words = 2").select("lang", "phrase", "words", "a", "l", "r", "score")  # has one cut
    return single.unionByName(best.select("lang", "phrase", "best.words", "best.a", "best.l", "best.r", "best.score"))


def not_contained(found: DataFrame, share: int) -> DataFrame:
    """Without phrases that lie in a longer one with ``share`` percent of their occurrences or more."""
    parts = F.split("phrase", " ")
    inner = found.where("words > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1))).withColumn(
        "at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1))).select(
        "lang", F.array_join(F.slice(parts, F.col("at"), F.col("size")), " ").alias("phrase"), F.col("a").alias("longer"))
    most = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    joined = found.join(most, ["lang", "phrase"], "left")
    return joined.where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share)).drop("longer")


def first_of_each(found: DataFrame, first: int, salts: int = 16) -> DataFrame:
    """Adds ``rank``; a language's rows are first cut to ``first`` in ``salts`` parts, so none meets one task whole."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= first)
    ranked = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= first).drop("salt")


def collocations(
    docs: DataFrame, least: int = 10, longest: int = 3, share: int = 50, first: int = 2000, lang: str = "lang", text: str = "text",
    filter_bits: int = 1 << 26, bucket_bytes: int = 8 << 20,
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``first`` phrases of each language."""
    rows = rows_of(docs, lang, text)
    words, phrases = frequent_phrases(rows, least, longest, filter_bits, bucket_bytes)
    found = store(scored(phrases, words, least), "collocation-scores")
    best = first_of_each(not_contained(found, share), first)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
