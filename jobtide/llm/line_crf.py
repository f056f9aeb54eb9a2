"""Document quality from a linear-chain conditional random field over lines.

Every line with a word is a node; its states are bad and good. Node
weights see the line's own features and those of the lines before and after, edge weights tie
neighbouring labels. Forward-backward gives each line's probability of being good; their mean,
weighted by the bytes of the lines, is the document's raw quality, which a logistic curve maps to
the score.

Only documents have labels, so training starts with every line labelled as its
document and then relabels the lines of bad documents that the model finds good (the worst line
stays bad). The fit uses a hash sample of at most ``rows`` labelled documents
of at most ``MAX_LINES`` lines; 52 bytes for each line come to the driver, where the fit takes some 400 bytes for each. Scoring reads whole texts.

Defined cases: a text without a word (null, empty, white space) scores 0; every row is scored on
its own, so repeated rows, null ids and other columns do not matter; an empty table gives an
empty result; with no usable label, or only one class, every text with a word scores 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.llm.common import free_name, held_out, training_sample

SPACE, UPPER, LOWER, DIGIT, SYMBOL, MARK, STOP, OTHER = range(8)
#: Longest document, in lines, that training uses, unless told otherwise (bounds the fit, not the scoring).
MAX_LINES = 400
FEATURES = 12


def classes() -> np.ndarray:
    table = np.full(256, OTHER, np.uint8)
    table[[9, 10, 11, 12, 13, 32]] = SPACE
    table[65:91], table[97:123], table[128:], table[48:58] = UPPER, LOWER, LOWER, DIGIT
    table[list(b"#*$%&|<>")], table[33], table[list(b".,;:?'\"()-")] = SYMBOL, MARK, STOP
    return table


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)  # modulo 2**64


#: An odd multiplier of a polynomial hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


class Lines(NamedTuple):
    features: np.ndarray
    weight: np.ndarray
    first: np.ndarray  # position of each document's first line, and the end


def line_features(texts: list[str | None]) -> Lines:
    """Features of all lines with a word, document by document."""
    raw = [(x or "").encode("utf-8", "replace") + b"\n" for x in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    if not len(data):
        return Lines(np.zeros((0, FEATURES)), np.zeros(0), np.zeros(len(texts) + 1, np.int64))
    kind = classes()[data]
    ends = np.nonzero(data == 10)[0]
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(ends)
    line = np.repeat(np.arange(n), ends - starts + 1)
    count = np.bincount(line * 8 + kind, minlength=8 * n).reshape(n, 8)
    blank = kind == SPACE
    edge = np.concatenate([[True], blank])
    word = np.nonzero(edge[:-1] & ~blank)[0]
    stop = np.nonzero(~edge[1:] & np.concatenate([blank[1:], [True]]))[0] + 1
    own = line[word]
    words = np.bincount(own, minlength=n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data), BASE))])
    back = powers(len(data), INVERSE)
    word_hash = (sums[stop] - sums[word]) * back[word]
    again = np.concatenate([[False], (word_hash[1:] == word_hash[:-1]) & (own[1:] == own[:-1])]) if len(word) else np.zeros(0, bool)
    same = np.bincount(own[again], minlength=n)
    single = np.bincount(own[stop - word == 1], minlength=n)
    line_hash = (sums[ends] - sums[starts]) * back[starts]
    doc = np.repeat(np.arange(len(texts)), np.array([x.count(b"\n") for x in raw], np.int64))
    kept = np.nonzero(words > 0)[0]
    count, words, same, single, line_hash, doc = (x[kept] for x in (count, words, same, single, line_hash, doc))
    size = (ends - starts)[kept]
    letters = count[:, UPPER] + count[:, LOWER] + 1
    chars = np.maximum(1, size - count[:, SPACE] + 1)
    twin = np.concatenate([[False], (line_hash[1:] == line_hash[:-1]) & (doc[1:] == doc[:-1])]) if len(kept) else np.zeros(0, bool)
    tail = data[ends[kept] - 1] if len(kept) else np.zeros(0, np.uint8)
    features = np.stack([
        count[:, UPPER] / letters,
        np.minimum(1, 4 * count[:, SYMBOL] / chars),
        np.minimum(1, 8 * count[:, MARK] / chars),
        np.minimum(1, 4 * count[:, DIGIT] / chars),
        np.minimum(1, 8 * count[:, STOP] / chars),
        np.minimum(1, 8 * count[:, OTHER] / chars),
        same / words,
        single / words,
        np.minimum(1, np.log1p(words) / 8),
        np.minimum(1, chars / words / 20),
        (tail == 46).astype(float),
        twin.astype(float),
    ], axis=1) if len(kept) else np.zeros((0, FEATURES))
    first = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(texts)))]).astype(np.int64)
    return Lines(features, size.astype(float), first)


def with_neighbours(lines: Lines) -> np.ndarray:
    """Each line's features, those of the lines before and after it in its document, and a constant."""
    x, n = lines.features, len(lines.features)
    heads = np.zeros(n + 1, bool)
    heads[lines.first] = True
    before, after = np.zeros_like(x), np.zeros_like(x)
    if n > 1:
        inner = ~heads[1:n]
        before[1:][inner] = x[:-1][inner]
        after[:-1][inner] = x[1:][inner]
    return np.concatenate([x, before, after, np.ones((n, 1))], axis=1)


def forward_backward(node: np.ndarray, edge: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of good for each line, and the expected 2 x 2 counts of neighbouring labels.

    All documents advance together, one line a step; ``node`` is the log-odds of good.
    """
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    order = order[length[order] > 0]
    start, length = first[:-1][order], length[order]
    ahead, back = np.zeros((len(node), 2)), np.zeros((len(node), 2))
    steps = int(length[0]) if len(length) else 0
    active = [int(np.searchsorted(-length, -t, side="left")) for t in range(steps)]  # documents with over t lines
    ahead[start, 1] = node[start]
    for t in range(1, steps):
        at = start[: active[t]] + t
        past = ahead[at - 1]
        ahead[at, 0] = np.logaddexp(past[:, 0] + edge[0, 0], past[:, 1] + edge[1, 0])
        ahead[at, 1] = np.logaddexp(past[:, 0] + edge[0, 1], past[:, 1] + edge[1, 1]) + node[at]
    for t in range(steps - 2, -1, -1):
        at = start[: active[t + 1]] + t
        bad, good = back[at + 1, 0], back[at + 1, 1] + node[at + 1]
        back[at, 0] = np.logaddexp(edge[0, 0] + bad, edge[0, 1] + good)
        back[at, 1] = np.logaddexp(edge[1, 0] + bad, edge[1, 1] + good)
    both = ahead + back
    total = np.logaddexp(both[:, 0], both[:, 1])
    pairs = np.zeros((2, 2))
    inner = np.ones(len(node), bool)
    inner[start] = False
    at = np.nonzero(inner)[0]
    for i in (0, 1):
        for j in (0, 1):
            pairs[i, j] = np.exp(ahead[at - 1, i] + edge[i, j] + j * node[at] + back[at, j] - total[at]).sum()
    return np.exp(both[:, 1] - total), pairs


class Model(NamedTuple):
    weights: np.ndarray
    edge: np.ndarray
    slope: float
    offset: float


def raw_quality(lines: Lines, weights: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Mean probability of good, weighted by bytes; 0 for a document without a line."""
    good, _ = forward_backward(with_neighbours(lines) @ weights, edge, lines.first)
    ends = np.concatenate([[0.0], np.cumsum(good * lines.weight)])
    size = np.concatenate([[0.0], np.cumsum(lines.weight)])
    return (ends[lines.first[1:]] - ends[lines.first[:-1]]) / np.maximum(1, size[lines.first[1:]] - size[lines.first[:-1]])


def fit_chain(x: np.ndarray, label: np.ndarray, first: np.ndarray, steps: int, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights that maximise the likelihood of the line labels (Adam, full batch)."""
    inner = np.ones(len(label), bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    at = np.nonzero(inner)[0]
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[at - 1], label[at]), 1)
    size = x.shape[1]
    theta, mean, square = np.zeros(size + 4), np.zeros(size + 4), np.zeros(size + 4)
    for step in range(1, steps + 1):
        good, pairs = forward_backward(x @ theta[:size], theta[size:].reshape(2, 2), first)
        slope = np.concatenate([x.T @ (label - good), (seen - pairs).ravel()]) / len(label) - ridge * theta
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        theta = theta + 0.15 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return theta[:size], theta[size:].reshape(2, 2)


def curve(raw: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve (Newton steps with a small ridge)."""
    x, w = np.stack([raw, np.ones(len(raw))], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2), x.T @ (label - p) - 0.05 * w)
    return float(w[0]), float(w[1])


def train(sample: DataFrame, steps: int = 80, passes: int = 2, ridge: float = 1e-4, lines: int = MAX_LINES) -> Model | None:
    """Fit the model on ``(text, y)``, on documents of at most ``lines`` lines; None when there is no sample of both classes."""
    @F.pandas_udf("struct<x:binary,w:binary>")
    def measured(texts: pd.Series) -> pd.DataFrame:
        found = [line_features([t]) for t in texts]
        fits = [len(f.weight) <= lines for f in found]
        return pd.DataFrame({"x": [f.features.astype("<f4").tobytes() if ok else b"" for f, ok in zip(found, fits)],
                             "w": [f.weight.astype("<f4").tobytes() if ok else b"" for f, ok in zip(found, fits)]})

    rows = sample.select(F.xxhash64("text").alias("h"), measured("text").alias("m"), "y").where(F.octet_length("m.w") > 0).select("h", "m.*", "y").collect()
    rows.sort(key=lambda r: (r.h, r.y))
    label = np.array([r.y for r in rows])
    if len(set(label.tolist())) < 2:
        return None
    first = np.concatenate([[0], np.cumsum([len(r.w) // 4 for r in rows])]).astype(np.int64)
    plain = lambda data: np.frombuffer(b"".join(data), "<f4").astype(float)
    found = Lines(plain(r.x for r in rows).reshape(-1, FEATURES), plain(r.w for r in rows), first)
    x, line_label = with_neighbours(found), np.repeat(label, np.diff(first))
    of_line = np.repeat(np.arange(len(rows)), np.diff(first))
    for turn in range(passes):
        weights, edge = fit_chain(x, line_label, first, steps, ridge)
        if turn + 1 < passes:
            good, _ = forward_backward(x @ weights, edge, first)
            worst = np.minimum.reduceat(good, first[:-1])
            line_label = np.where((label[of_line] == 1) | ((good > 0.5) & (good > worst[of_line])), 1, 0)
    return Model(weights, edge, *curve(raw_quality(found, weights, edge), label))


def score(text: Column, model: Model | None) -> Column:
    """Quality between 0 and 1 of a text column."""
    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out, group, size = [], [], 0
            todo = texts.tolist()
            for at, one in enumerate(todo):
                group.append(one)
                size += len(one or "")
                if size > 300_000 or at + 1 == len(todo):
                    lines = line_features(group)
                    some = np.diff(lines.first) > 0
                    if model is None:
                        out.append(np.where(some, 0.5, 0.0))
                    else:
                        raw = raw_quality(lines, model.weights, model.edge)
                        out.append(np.where(some, 1 / (1 + np.exp(-(model.slope * raw + model.offset))), 0.0))
                    group, size = [], 0
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    return scored(text)


def fit(docs: DataFrame, labels: DataFrame, rows: int = 4000, folds: int = 5, out: int = 0,
        key: str = "doc_id", text: str = "text", label: str = "quality") -> Model | None:
    """Train on about ``rows`` labelled documents whose key is not in the held-out fold."""
    return train(training_sample(docs, labels, label, folds, out, rows, key, text))


def judge_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = 4000, folds: int = 5,
                  out: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row of ``docs``."""
    model = fit(docs, labels, rows, folds, out, key, text)
    scored = docs.select(F.col(key).alias("doc_id"), held_out(F.col(key), folds, out).alias("held_out"),
                         score(F.col(text), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = 4000, folds: int = 5,
              out: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more; all columns stay as they are."""
    model = fit(docs, labels, rows, folds, out, key, text)
    name = free_name(docs, "__score")
    return docs.withColumn(name, score(F.col(text), model)).where(F.col(name) >= threshold).drop(name)
