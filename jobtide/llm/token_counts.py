"""Token counts of a byte-level BPE vocabulary without materialising ids.

A byte-level BPE never merges across pre-tokens, so a text has as many tokens as its pre-tokens
have pieces. One pass counts the corpus's distinct pre-tokens (combined in the
task, then by shuffle); pieces are counted once for each of them by the tokenizer library. A
second pass takes each document's pre-token frequencies and joins them to the
pieces. The most frequent pre-tokens, at most ``COMMON`` of at most ``LONGEST`` bytes, travel to
the tasks and are joined there; all others go through a shuffled join. Both joins are
exact and use the same table.

Texts are first cut at single spaces: the pre-tokens of a piece with its leading space depend on nothing
outside it, so tasks add up equal pieces before they cut them into pre-tokens. Texts with other
white space beside a space are cut by the pattern as a whole.

Defined cases: a null text is empty (0 bytes, 0 tokens); special strings inside a text count as one
token, as the library's default has it; every row is counted on its own, so repeated rows and
null ids do not matter; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from operator import mul

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide.llm.common import slices, store

#: Fixed value: the byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bounds of the table that travels to the tasks.
COMMON, LONGEST = 200_000, 64
#: Pieces that a task remembers at once.
REMEMBERED = 120_000


#: A space beside other white space: what is a pre-token there depends on both sides.
TANGLED = re.compile(r" (?:\s|(?<=\s ))").search


class Cutter:
    """Cuts texts into pieces between single spaces, and pieces into pre-tokens."""

    def __init__(self, specials: list[str]):
        self.find = regex.compile(PATTERN).findall
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None

    def cut(self, text: str) -> tuple[list[str], list[str], int]:
        """Pieces that follow a space, pre-tokens of all the rest, and the number of special strings."""
        parts = self.special.split(text) if self.special and self.special.search(text) else [text]
        pieces: list[str] = []
        tokens: list[str] = []
        for part in parts:
            if not part:
                continue
            if part[0] == " " or part[-1] == " " or TANGLED(part):
                tokens += self.find(part)
            else:
                head, *rest = part.split(" ")
                tokens += self.find(head)
                pieces = pieces + rest if pieces else rest
        return pieces, tokens, len(parts) - 1

    def tokens_of(self, piece: str) -> list[str]:
        return self.find(" " + piece)


def load(path: str) -> tuple[str, list[str]]:
    """The tokenizer file's content (a megabyte or two) and its special strings."""
    with open(path, encoding="utf-8") as f:
        content = f.read()
    found = json.loads(content)
    kind = found["pre_tokenizer"] or {}
    if kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex", True) or found["normalizer"]:
        raise ValueError("only byte-level BPE without prefix space and normalizer is counted this way")
    return content, [x["content"] for x in found["added_tokens"]]


def pretoken_totals(texts: DataFrame, specials: list[str]) -> DataFrame:
    """``(token, n)``: distinct pre-tokens of the whole corpus with their frequencies."""

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, pieces, tokens = Cutter(specials), Counter(), Counter()

        def full() -> Iterator[pa.RecordBatch]:
            for piece, n in pieces.items():
                for token in cutter.tokens_of(piece):
                    tokens[token] += n
            pieces.clear()
            for at in range(0, len(found := list(tokens)), 20_000):
                some = found[at : at + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([tokens[t] for t in some], pa.int64())], names=["token", "n"])
            tokens.clear()

        for part in slices(batches):
            for text in part.column(0).to_pylist():
                if text:
                    rest, found, _ = cutter.cut(text)
                    pieces.update(rest)
                    tokens.update(found)
            if len(pieces) + len(tokens) >= REMEMBERED:
                yield from full()
        yield from full()

    return texts.mapInArrow(totals, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def piece_counts(totals: DataFrame, content: str) -> DataFrame:
    """Adds ``pieces``, counted once for each distinct pre-token."""
    shared = totals.sparkSession.sparkContext.broadcast(content)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core is the only one it may use
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(shared.value)
        for part in slices(batches, 4096):
            found = tokenizer.encode_batch_fast(part.column(0).to_pylist(), add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([len(e) for e in found], pa.int64())], names=["token", "n", "pieces"])

    return totals.mapInArrow(counted, "token string, n long, pieces long")


def common_pieces(pieces: DataFrame) -> dict[str, int]:
    """Pieces of the most frequent pre-tokens: those with at least the least frequency that at most COMMON reach."""
    short = pieces.where(F.octet_length("token") <= LONGEST)
    # Classes of frequency, about 9 % wide, bound what is collected to find the cut.
    class_of = F.floor(F.log2("n") * 8)
    sizes = {r.c: r["count"] for r in short.groupBy(class_of.alias("c")).count().collect()}
    total, least = 0, None
    for c in sorted(sizes, reverse=True):
        total += sizes[c]
        if total > COMMON:
            break
        least = c
    if least is None:
        return {}
    return {r.token: r.pieces for r in short.where(class_of >= least).select("token", "pieces").collect()}


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for each row of ``docs``."""
    content, specials = load(path)
    spark = docs.sparkSession
    pieces = store(piece_counts(pretoken_totals(docs.select(text), specials), content), "pieces")
    known = spark.sparkContext.broadcast(common_pieces(pieces))
    kind = dict(docs.dtypes)[key]
    schema = f"doc_id {kind}, n_bytes long, common long, tokens array<string>, times array<long>"

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, table = Cutter(specials), known.value
        common: dict[str, int] = {}  # piece: pieces of its common pre-tokens
        odd: dict[str, list[str]] = {}  # piece: its other pre-tokens

        def learn(piece: str) -> None:
            tokens = cutter.tokens_of(piece)
            common[piece] = sum(table.get(t, 0) for t in tokens)
            if rest := [t for t in tokens if t not in table]:
                odd[piece] = rest

        def measured(text: str) -> tuple[int, Counter]:
            pieces, tokens, total = cutter.cut(text)
            counts = Counter(pieces)
            if len(common) > REMEMBERED:
                common.clear()
                odd.clear()
            for piece in counts:
                if piece not in common:
                    learn(piece)
            total += sum(map(mul, map(common.__getitem__, counts), counts.values()))
            rare: Counter = Counter()
            for piece, n in counts.items():
                if piece in odd:
                    for token in odd[piece]:
                        rare[token] += n
            for token in tokens:
                if token in table:
                    total += table[token]
                else:
                    rare[token] += 1
            return total, rare

        for part in slices(batches):
            found = [measured(x) if x else (0, {}) for x in part.column(1).to_pylist()]
            sizes = [len(x.encode("utf-8", "replace")) if x else 0 for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes, pa.int64()), pa.array([total for total, _ in found], pa.int64()),
                 pa.array([list(rare) for _, rare in found], pa.list_(pa.string())),
                 pa.array([list(rare.values()) for _, rare in found], pa.list_(pa.int64()))],
                names=["doc_id", "n_bytes", "common", "tokens", "times"])

    rows = store(
        docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(looked_up, schema)
        .withColumn("row", F.monotonically_increasing_id()), "token-frequencies")
    rest = rows.select("row", F.explode(F.arrays_zip("tokens", "times")).alias("f")).select(
        "row", F.col("f.tokens").alias("token"), F.col("f.times").alias("times"))
    rare = rest.join(pieces.select("token", "pieces"), "token").groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("rare"))
    counted = rows.select("row", "doc_id", "n_bytes", "common").join(rare, "row", "left")
    total = F.col("common") + F.coalesce("rare", F.lit(0))
    return counted.select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
