"""Quality rules as a short-circuit cascade ordered by rejection per cost.

Rules are functions of a text's measures. Measures are worked out when a rule
asks for one and kept for the next rule. On a sample of texts every rule is
timed with fresh measures and its rejections noted; then rules are put in order: always
the one that rejects most of what is left for its cost. The order changes the
work, never the verdict, as a text is kept when no rule rejects it.

Defined cases: a null text is an empty one (no words, rejected by ``min_words``); every row
is judged on its own, so repeated rows, null ids and other columns do not matter;
an empty table gives an empty result and leaves the rules in the order given.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.llm.common import free_name

SYMBOLS = "#*$%&|<>"


class Measures:
    """What rules ask about a text; each value is worked out once, on demand."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "replace").split()  # cuts at ASCII white space only

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, " \t\n\x0b\x0c\r"))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def n_marks(self) -> int:
        return self.text.count("!")

    @cached_property
    def lines(self) -> list[str]:
        return [line for line in self.text.split("\n") if line.strip(" \t\n\x0b\x0c\r")]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in windows of five that occur twice or more, the first included."""
        w = self.words
        runs = list(zip(w, w[1:], w[2:], w[3:], w[4:]))
        if len(set(runs)) == len(runs):
            return 0
        seen: dict[tuple, int] = {}
        covered = np.zeros(len(w) + 1, np.int64)
        for at, run in enumerate(runs):
            first = seen.setdefault(run, at)
            if first != at:
                covered[first] += 1
                covered[first + 5] -= 1
                covered[at] += 1
                covered[at + 5] -= 1
        return int((np.cumsum(covered)[:-1] > 0).sum())

    @cached_property
    def n_upper(self) -> int:
        raw = np.frombuffer(self.text.encode("utf-8", "replace"), np.uint8)
        return int(((raw >= 65) & (raw <= 90)).sum())

    @cached_property
    def n_lower(self) -> int:
        raw = np.frombuffer(self.text.encode("utf-8", "replace"), np.uint8)
        return int(((raw >= 97) & (raw <= 122)).sum())


class Rule(NamedTuple):
    name: str
    rejects: Callable[[Measures], bool]


BASE = [
    Rule("min_words", lambda m: m.n_words < 10),
    Rule("repeats", lambda m: 100 * m.n_repeat_words > 20 * m.n_words),
]
MORE = [
    Rule("symbols", lambda m: 100 * m.n_symbols > 30 * m.n_words),
    Rule("exclamation", lambda m: 100 * m.n_marks > 30 * m.n_words),
    Rule("shouting", lambda m: m.n_upper > m.n_lower),
    Rule("repeated_lines", lambda m: 100 * m.n_dup_lines > 30 * len(m.lines)),
    Rule("word_length", lambda m: m.word_chars > 25 * m.n_words),
]
RULES = BASE + MORE
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def trial(docs: DataFrame, rules: list[Rule], rows: int, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Seconds of each rule, and a row of rejections for each sampled text.

    The sample holds about ``rows`` texts, drawn at random in place; what comes to the driver is a flag
    and a time for each rule and text.
    """
    @F.pandas_udf("array<double>")
    def tried(texts: pd.Series) -> pd.Series:
        out = []
        for x in texts:
            found = []
            for rule in rules:
                start = time.perf_counter()
                verdict = rule.rejects(Measures(x))
                found += [time.perf_counter() - start, float(verdict)]
            out.append(found)
        return pd.Series(out)

    total = docs.count()
    sample = docs.select(F.col(text).alias("t")).sample(fraction=min(1.0, rows / max(1, total)), seed=7)
    found = np.array([r[0] for r in sample.select(tried("t")).collect()]).reshape(-1, len(rules), 2)
    return found[:, :, 0].sum(axis=0), found[:, :, 1] > 0


def cascade(rules: list[Rule], cost: np.ndarray, rejected: np.ndarray) -> list[Rule]:
    """The rules, greedily by rejections among what is left for their cost."""
    left, todo, order = np.ones(len(rejected), bool), list(range(len(rules))), []
    while todo:
        gain = [(rejected[left, i].sum() + 1e-9) / max(cost[i], 1e-9) for i in todo] if len(rejected) else [0] * len(todo)
        best = todo.pop(int(np.argmax(gain)))
        order.append(rules[best])
        left &= ~rejected[:, best]
    return order


def planned(docs: DataFrame, rules: list[Rule] = RULES, rows: int = 400, text: str = "text") -> list[Rule]:
    return cascade(list(rules), *trial(docs, list(rules), rows, text))


def keeps(text: Column, rules: list[Rule]) -> Column:
    """True where no rule rejects; later rules are not asked once one does."""
    @F.pandas_udf("boolean")
    def kept(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([not any(rule.rejects(m) for rule in rules) for m in map(Measures, texts)], dtype=bool)

    return kept(text)


def apply_rules(docs: DataFrame, rules: list[Rule] = RULES, rows: int = 400, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that every rule lets pass; all columns stay as they are."""
    order = planned(docs, rules, rows, text)
    kept = free_name(docs, "__kept")
    return docs.withColumn(kept, keeps(F.col(text), order)).where(F.col(kept)).drop(kept)


def judge_rules(
    docs: DataFrame, base: list[Rule] = BASE, more: list[Rule] = MORE, rows: int = 400, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(doc_id, <COUNTS>, base_failed, kept)`` for each row. The counts are worked out for all rows."""
    order, first = planned(docs, base + more, rows, text), {rule.name for rule in base}

    @F.pandas_udf(", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for m in map(Measures, texts):
                fail = next((rule.name for rule in order if rule.rejects(m)), None)
                failed = fail in first or (fail is not None and any(rule.rejects(m) for rule in base))
                out.append([*(getattr(m, c) for c in COUNTS), failed, fail is None])
            yield pd.DataFrame(out, columns=[*COUNTS, "base_failed", "kept"])

    found = docs.select(F.col(key).alias("doc_id"), judged(F.col(text)).alias("r"))
    return found.select("doc_id", "r.*")
