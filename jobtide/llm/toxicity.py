"""Toxicity from a learnt lexicon, matched with spelling errors and weighed by context.

Learning (labelled sample only): words that are much more frequent in toxic than in other
documents form the lexicon. Evidence is counted by distinct left neighbours, so a
passage that was copied many times counts once. Words close to a lexicon term
are tallied too: a clean word that happens to lie near a term keeps its own, low, evidence.

Matching: the Levenshtein automata of all terms are intersected with the lexicon's trie. The
product is made deterministic as it is walked: a state holds the rows of edit distances of the trie nodes that
can still match, and is shared by all words that reach it, so most words end
after a few characters. Each distinct word is walked once in a task.

Scoring: a hit counts with the evidence of its form; forms never seen get their
term's, less for each edit and for each clean word near the term. A hit between two quotation marks
at most ``SPAN`` tokens apart, or just after a word of reporting, is quotation and counts ``QUOTED`` of its weight,
unless other hits stand in its window. Abusive hits add up (noisy or),
quotations count by their largest. Documents without a hit score the rate of toxic ones among such documents.

Defined cases: null and empty texts have no hit; every row is scored on its own, so
repeated rows, null ids and other columns do not matter; an empty table gives an empty result; with
no usable label the lexicon is empty and every score is 0.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.llm.common import held_out, slices, training_sample

#: Words, and the marks that open or close a quotation.
TOKEN = re.compile(r"[^\W_]+|[\"“”„«»]").findall
MARKS = frozenset("\"“”„«»")
#: Words that introduce a quotation.
REPORTING = frozenset("said says called calls quote quoted quotes word words term terms wrote dit mot wort wörter sagte dijo palabra".split())
WINDOW, QUOTED = 8, 0.25
#: Most tokens between the marks of a quotation.
SPAN = 40
#: Bounds of what the driver collects: lexicon terms, and forms near them.
MAX_TERMS, MAX_FORMS = 3000, 20000


def edits_allowed(length: int) -> int:
    return 0 if length < 4 else 1 if length < 8 else 2


class Automaton:
    """Levenshtein automata of the terms, intersected with their trie and determinised on demand."""

    def __init__(self, terms: Iterable[str], most_states: int = 200_000):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.allowed: list[int] = [0]  # most edits of any term below a node
        for term in sorted(set(terms)):
            at, k = 0, edits_allowed(len(term))
            self.allowed[0] = max(self.allowed[0], k)
            for c in term:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.allowed.append(0)
                at = self.children[at][c]
                self.allowed[at] = max(self.allowed[at], k)
            self.term[at] = term
        self.most_states = most_states
        self.reset()

    def reset(self) -> None:
        """State 0 is dead, state 1 the start. A state maps trie nodes to their edit distance."""
        self.states: list[dict[int, int]] = [{}, self.closed({0: 0})]
        self.index = {frozenset(): 0, frozenset(self.states[1].items()): 1}
        self.moves: list[dict[str, int]] = [{}, {}]

    def closed(self, state: dict[int, int]) -> dict[int, int]:
        """Add nodes reached by leaving out characters of the term."""
        out, todo = dict(state), list(state.items())
        while todo:
            node, k = todo.pop()
            for child in self.children[node].values():
                if k < self.allowed[child] and k + 1 < out.get(child, 99):
                    out[child] = k + 1
                    todo.append((child, k + 1))
        return {node: k for node, k in out.items() if k <= self.allowed[node]}

    def step(self, state: int, c: str) -> int:
        moved: dict[int, int] = {}
        for node, k in self.states[state].items():
            if k < self.allowed[node]:  # a character too many
                moved[node] = min(moved.get(node, 99), k + 1)
            for label, child in self.children[node].items():
                cost = k + (label != c)
                if cost <= self.allowed[child]:
                    moved[child] = min(moved.get(child, 99), cost)
        moved = self.closed(moved)
        mark = frozenset(moved.items())
        if mark not in self.index:
            self.index[mark] = len(self.states)
            self.states.append(moved)
            self.moves.append({})
        return self.index[mark]

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term within its allowed edits, and the distance; the first term of equals."""
        if len(self.states) > self.most_states:
            self.reset()
        state = 1
        for c in word:
            following = self.moves[state].get(c)
            if following is None:
                following = self.moves[state][c] = self.step(state, c)
            if not following:
                return None
            state = following
        hits = [(k, self.term[n]) for n, k in self.states[state].items() if self.term[n] is not None and k <= edits_allowed(len(self.term[n]))]
        return min(hits)[::-1] if hits else None


class Lexicon(NamedTuple):
    terms: dict[str, float]  # term: probability that a hit is abuse
    forms: dict[str, float]  # other seen forms near a term: theirs
    clean: dict[str, float]  # term: share of clean words among the seen forms near it
    floor: float  # score without a hit


def surprise(n1: float, n0: float, all1: float, all0: float) -> float:
    """Log-likelihood ratio of a word's counts in both classes against independence."""
    rate = all1 / (all1 + all0)
    total = 0.0
    for seen, share in ((n1, rate), (n0, 1 - rate)):
        if seen:
            total += seen * math.log(seen / ((n1 + n0) * share))
    return 2 * total


def tally(sample: DataFrame, only: frozenset[str] | None, automaton: Automaton | None) -> DataFrame:
    """``(word, n1, n0)``: distinct left neighbours of words in toxic and in other documents.

    ``only`` keeps these words, ``automaton`` those that it matches.
    """
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted: dict[str, bool] = {}
        for part in slices(batches):
            found = set()
            for text, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                past = ""
                for word in TOKEN(text.lower()):
                    keep = wanted.get(word)
                    if keep is None:
                        keep = wanted[word] = word in only if only is not None else automaton.match(word) is not None
                    if keep:
                        found.add((word, past, y))
                    past = word
            words, before, y = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(before, pa.string()), pa.array(y, pa.int32())], names=["word", "past", "y"])

    once = sample.select("text", "y").mapInArrow(pairs, "word string, past string, y int").distinct()
    return once.groupBy("word").agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0"))


def document_counts(sample: DataFrame) -> DataFrame:
    """``(word, n1, n0)``: toxic and other documents that hold each word."""
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2048):
            sums: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            for text, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                for word in set(TOKEN(text.lower())) - MARKS:
                    sums[word][y] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v[1] for v in sums.values()], pa.int64()),
                                              pa.array([v[0] for v in sums.values()], pa.int64())], names=["word", "n1", "n0"])

    return sample.select("text", "y").mapInArrow(counts, "word string, n1 long, n0 long").groupBy("word").agg(
        F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def learn(sample: DataFrame, least: int = 3, ratio: float = 8.0, evidence: float = 22.0) -> Lexicon:
    """The lexicon of a sample ``(text, y)``; see the module's text for the method."""
    size = sample.agg(F.sum("y").alias("n1"), F.count("*").alias("n")).first()
    all1, all0 = size.n1 or 0, size.n - (size.n1 or 0)
    if not all1 or not all0:
        return Lexicon({}, {}, {}, 0.0)
    lift = (F.col("n1") / all1) / ((F.col("n0") + 0.5) / all0)
    likely = document_counts(sample).where((F.col("n1") >= least) & (lift >= ratio)).orderBy(
        F.desc(F.col("n1") - F.col("n0") * (all1 / all0)), "word").limit(2 * MAX_TERMS)
    found = tally(sample, frozenset(r.word for r in likely.collect()), None).collect()
    terms = {}
    for r in sorted(found, key=lambda r: (-r.n1, r.word)):
        precision = (r.n1 + 0.5 * all1 / (all1 + all0)) / (r.n1 + r.n0 + 0.5)
        if len(terms) < MAX_TERMS and r.n1 >= 2 * least and precision >= 0.6 and surprise(r.n1, r.n0, all1, all0) >= evidence:
            terms[r.word] = precision
    automaton = Automaton(terms)
    near = tally(sample, None, automaton).orderBy(F.desc(F.col("n1") + F.col("n0")), "word").limit(MAX_FORMS).collect() if terms else []
    forms, tallies = {}, defaultdict(lambda: [0, 0])
    for r in near:
        if r.word in terms:
            continue
        term, k = automaton.match(r.word)
        forms[r.word] = (r.n1 + 2 * all1 / (all1 + all0)) / (r.n1 + r.n0 + 2)
        tallies[term][0] += r.n1
        tallies[term][1] += r.n0
    clean = {term: n0 / (n1 + n0) for term, (n1, n0) in tallies.items()}
    lexicon = Lexicon(terms, forms, clean, 0.0)
    judged = sample.select("y", (score(F.col("text"), lexicon) > 0).alias("hit")).where("not hit").agg(
        F.sum("y").alias("n1"), F.count("*").alias("n")).first()
    return lexicon._replace(floor=((judged.n1 or 0) + 0.1) / (judged.n + 1))


def weight(lexicon: Lexicon, automaton: Automaton, word: str) -> float:
    """How likely a hit of this word is abuse; 0 for words that match nothing."""
    if word in lexicon.terms:
        return lexicon.terms[word]
    found = automaton.match(word)
    if found is None:
        return 0.0
    if word in lexicon.forms:
        return lexicon.forms[word]
    term, k = found
    return lexicon.terms[term] * 0.8**k * (1 - lexicon.clean.get(term, 0.0))


def score_text(text: str | None, weights: dict[str, float], find) -> float:
    """Noisy or of the abusive hits, or the largest quoted one; ``find`` gives a word's weight and remembers it."""
    if not text:
        return 0.0
    tokens = TOKEN(text.lower())
    hits = {}
    for word in set(tokens):
        w = weights.get(word)
        if w is None:
            w = find(word)
        if w >= 0.3:
            hits[word] = w
    if not hits:
        return 0.0
    at = [i for i, t in enumerate(tokens) if t in hits]
    marked = not MARKS.isdisjoint(tokens)
    inside = quoted_places(tokens) if marked else None
    abuse: dict[str, float] = {}
    quoted = 0.0
    for n, i in enumerate(at):
        word = tokens[i]
        crowd = (n > 0 and i - at[n - 1] <= WINDOW) or (n + 1 < len(at) and at[n + 1] - i <= WINDOW)
        reported = not REPORTING.isdisjoint(tokens[max(0, i - 3) : i])
        if (reported or (marked and inside[i])) and not crowd:
            quoted = max(quoted, QUOTED * hits[word])
        else:
            abuse[word] = hits[word]
    rest = 1.0
    for w in abuse.values():
        rest *= 1 - w
    return max(quoted, 1 - rest)


def quoted_places(tokens: list[str], span: int = SPAN) -> list[bool]:
    """For each token, whether it stands between two marks that are a pair.

    A mark pairs with the next one if that is at most ``span`` tokens away; otherwise it is a stray one (an inch sign, a
    quotation that is never closed), and the next may open a pair.
    """
    out, opened = [False] * len(tokens), None
    for i, t in enumerate(tokens):
        if t not in MARKS:
            continue
        if opened is None or i - opened > span:
            opened = i
        else:
            out[opened + 1 : i] = [True] * (i - opened - 1)
            opened = None
    return out


def score(text: Column, lexicon: Lexicon) -> Column:
    """Toxicity between 0 and 1 of a text column."""
    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = Automaton(lexicon.terms)
        known: dict[str, float] = {}

        def find(word: str) -> float:
            if len(known) > 500_000:
                known.clear()
            known[word] = w = weight(lexicon, automaton, word)
            return w

        for texts in batches:
            out = [score_text(t, known, find) for t in texts]
            yield pd.Series([lexicon.floor + (1 - lexicon.floor) * s for s in out], dtype=float)

    return scored(text)


def judge_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = 10_000, folds: int = 4, out: int = 2,
                   key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row of ``docs``."""
    lexicon = learn(training_sample(docs, labels, label, folds, out, rows, key, text))
    scored = docs.select(F.col(key).alias("doc_id"), held_out(F.col(key), folds, out).alias("held_out"),
                         score(F.col(text), lexicon).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
