"""Lines that stand in many documents are dropped everywhere.

Document counts of line hashes are kept as levelled sorted runs. A batch of documents
brings the hashes of its distinct lines with counts. What the runs already know as frequent is taken off by a merge anti-join, so
settled lines are not carried on; the rest becomes a sorted run of level 0. When ``fanout`` runs lie on
a level, they are merged into one run of the next level; hashes that reach the threshold there move
to a run of settled hashes. Runs are immutable tables in the shared folder, sorted by hash.

When all batches are in, a last compaction settles the rest, and the lines of the documents are looked up.
Hashes are pairs of 64-bit hashes with different seeds. Hot lines: a document counts a line once, tasks
add up before the shuffle, and settled hashes with more than about a ``1 / heavy`` share of all lines, of which there are
at most ``2 * heavy * batches``, are broadcast; the others meet in a shuffled join.
Dropped places are gathered by document and joined to its lines.

Everything is DataFrame functions: no Python in the tasks.

Defined cases: a null text is one empty line; a line's key is the line without white space around it, A-Z in lower
case; empty keys are never dropped (``least_chars``); repeated rows are documents of their own; null ids do not matter; a document without
any line left has an empty text; an empty table gives an empty result; other columns stay with :func:`without_lines`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.llm.common import store
from jobtide.session import scratch_path

BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    bare = F.btrim(line, F.lit(BLANK))
    plain = F.length(bare) == F.octet_length(bare)  # ASCII only: lower() does the same and is faster
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")]


class Runs:
    """Levelled sorted runs of ``(h1, h2, docs)``; ``docs`` counts documents with the line."""

    def __init__(self, threshold: int, fanout: int = 4):
        self.threshold, self.fanout = threshold, fanout
        self.levels: list[list[DataFrame]] = []
        self.settled: list[DataFrame] = []

    def _write(self, run: DataFrame, level: int) -> DataFrame:
        return store(run.sortWithinPartitions("h1", "h2"), f"line-run-{level}")

    def _put(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            self._compact(self.levels[level], level + 1)

    def _compact(self, runs: list[DataFrame], level: int) -> None:
        both = runs[0]
        for run in runs[1:]:
            both = both.unionByName(run)
        total = self._write(both.groupBy("h1", "h2").agg(F.sum("docs").alias("docs")), level)
        runs.clear()
        self.settled.append(total.where(F.col("docs") >= self.threshold))
        self._put(total.where(F.col("docs") < self.threshold), level)

    def add(self, batch: DataFrame) -> None:
        """Takes in the counts of a batch, ``(h1, h2, docs)``, each hash once."""
        for known in self.settled:
            batch = batch.join(known.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        run = self._write(batch, 0)
        self.settled.append(run.where(F.col("docs") >= self.threshold))
        self._put(run.where(F.col("docs") < self.threshold), 0)

    def frequent(self) -> DataFrame:
        """``(h1, h2, docs)`` of all hashes in ``threshold`` documents or more. ``docs`` is what was counted until a hash was settled."""
        rest = [run for level in self.levels for run in level]
        if len(rest) > 1:
            depth, self.levels = len(self.levels), []
            self._compact(rest, depth)
        out = self.settled[0]
        for run in self.settled[1:]:
            out = out.unionByName(run)
        # Batches before the one that settled a hash may together settle it once more.
        return store(out.groupBy("h1", "h2").agg(F.sum("docs").alias("docs")).sortWithinPartitions("h1", "h2"), "line-run-settled")


def with_rows(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` as one column ``r``, with a row number and a mark of the text: names of ``docs`` cannot clash."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("r"), F.monotonically_increasing_id().alias("row"),
                       F.xxhash64(F.col(text)).alias("mark"), F.col(text).alias("text"))


def line_counts(rows: DataFrame, batches: int, least_chars: int) -> DataFrame:
    """``(batch, h1, h2, docs)``: documents of each batch with the line, a document counted once."""
    keys = F.array_distinct(F.transform(lines_of(F.col("text")), key_of))
    batch = F.pmod(F.xxhash64("row"), F.lit(batches)).cast("int")
    lines = rows.select(batch.alias("batch"), F.explode(keys).alias("key")).where(F.length("key") >= least_chars)
    return lines.select("batch", *hashes(F.col("key"))).groupBy("batch", "h1", "h2").agg(F.count(F.lit(1)).alias("docs"))


def frequent_lines(rows: DataFrame, threshold: int, least_chars: int, batches: int, fanout: int) -> tuple[DataFrame, int]:
    """The settled run of all batches, and how many lines of documents were counted."""
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "line-batches")
    line_counts(rows, batches, least_chars).write.partitionBy("batch").parquet(path)
    counts = spark.read.schema("h1 long, h2 long, docs long, batch int").parquet(path)
    runs = Runs(threshold, fanout)
    for b in range(batches):
        runs.add(counts.where(F.col("batch") == b).drop("batch"))
    return runs.frequent(), counts.agg(F.sum("docs")).first()[0] or 0


def dropped_places(rows: DataFrame, frequent: DataFrame, total: int, least_chars: int, batches: int, heavy: int) -> DataFrame:
    """``(row, mark, places)``: numbers of a document's lines that are frequent."""
    line = rows.select("row", "mark", F.posexplode(lines_of(F.col("text"))).alias("place", "line")).withColumn("key", key_of(F.col("line")))
    line = line.where(F.length("key") >= least_chars).select("row", "mark", "place", *hashes(F.col("key")))
    # A hash with more than 1/heavy of all lines has this many in the batch that settles it, on average twice as many.
    hot = F.col("docs") * (2 * heavy * batches) >= F.lit(total)
    few = F.broadcast(frequent.where(hot).select("h1", "h2"))  # fewer than 2 * heavy * batches + 1, of 16 bytes
    others = frequent.where(~hot).select("h1", "h2").hint("merge")
    found = line.join(few, ["h1", "h2"], "left_semi").unionByName(line.join(few, ["h1", "h2"], "left_anti").join(others, ["h1", "h2"], "left_semi"))
    return found.groupBy("row").agg(F.first("mark").alias("seen"), F.collect_list("place").alias("places"))


def cleaned(
    docs: DataFrame, threshold: int = 10, least_chars: int = 1, batches: int = 4, fanout: int = 3, heavy: int = 10_000, text: str = "text",
) -> DataFrame:
    """``(r, lines, places, kept)``: each row as it was, its lines, the places of dropped lines (null: none) and the lines that stay.

    ``docs`` is read several times and must give the same rows in the same order; other rows fail the job.
    """
    rows = with_rows(docs, text)
    frequent, total = frequent_lines(rows, threshold, least_chars, batches, fanout)
    places = dropped_places(rows, frequent, total, least_chars, batches, heavy)
    whole = rows.select("row", "mark", "r", lines_of(F.col("text")).alias("lines"))
    joined = whole.join(places.hint("merge"), "row", "left")
    moved = F.col("seen").isNotNull() & (F.col("seen") != F.col("mark"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("places"))
    kept = F.when(moved, F.raise_error(F.lit("the documents give other rows when they are read again; store them first")).cast("array<string>")).when(
        F.col("places").isNull(), F.col("lines")).otherwise(F.transform(left, lambda i: F.get("lines", i)))
    return joined.select("r", "lines", "places", kept.alias("kept"))


def without_lines(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with frequent lines taken out of the text; rows and other columns stay. Texts are no longer null."""
    found = cleaned(docs, text=text, **options)
    return found.select(*(F.concat_ws("\n", "kept").alias(c) if c == text else F.col("r").getField(c).alias(c) for c in docs.columns))


def dropped_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, kept_sha256)`` for each row."""
    found = cleaned(docs.select(key, text), text=text, **options)
    return found.select(
        F.col("r").getField(key).alias("doc_id"), F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("places").isNull(), 0).otherwise(F.size("places")).cast("long").alias("n_dropped"),
        F.sha2(F.concat_ws("\n", "kept"), 256).alias("kept_sha256"))
