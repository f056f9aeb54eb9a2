"""Nearest documents for many queries at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide.operators.cells import in_cells, smallest_per_row
from jobtide.operators.market import top_n

# Vectors are single precision; differences below this are noise.
DIGITS = 6

#: Distances that a task holds at once when it scans the corpus; a matrix of them takes 16 MB, and their making a few such.
MAX_DISTANCES = 2_000_000

#: Numbers that a side of a shuffled cell holds; as doubles they take 32 MB.
CELL_NUMBERS = 4_000_000

#: Pieces that a side is cut into before its cells grow: 64 cells are enough to keep a cluster busy.
PIECES = 8


def raw_distances(queries: np.ndarray, corpus: np.ndarray, metric: str) -> np.ndarray:
    """Squared L2 or cosine distances, queries by corpus."""
    if metric == "cosine":
        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        return 1.0 - unit(queries) @ unit(corpus).T
    found = queries @ corpus.T
    found *= -2.0
    found += (queries**2).sum(axis=1)[:, None] + (corpus**2).sum(axis=1)[None, :]
    return found


def rounded(found: np.ndarray) -> np.ndarray:
    return np.round(np.maximum(found, 0.0), DIGITS)


def as_matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def nearest_rows(q_ids, q_vectors, d_ids, d_vectors, k: int, metric: str, query_id: str, doc_id: str) -> pd.DataFrame:
    """The ``k`` nearest of some documents for each of some queries; ties go to the smaller id.

    At most ``MAX_DISTANCES`` are held at once. Documents come in order of their ids, so after the first slice one counts only
    if it is nearer than the k-th so far.
    """
    order = np.argsort(d_ids, kind="stable")
    d_ids, d_vectors = d_ids[order], d_vectors[order]
    step = max(1, min(len(q_ids), int(MAX_DISTANCES**0.5)))
    width = max(k, MAX_DISTANCES // step)
    parts = []
    for low in range(0, len(q_ids), step):
        asked = q_vectors[low : low + step]
        cost = rounded(raw_distances(asked, d_vectors[:width], metric))
        rows, cols = smallest_per_row(cost, k)
        away = cost[rows, cols]
        for at in range(width, len(d_ids), width):
            limit = np.full(len(asked), np.inf)
            last = np.flatnonzero(np.bincount(rows, minlength=len(asked)) >= k)
            limit[last] = away[np.searchsorted(rows, last, side="right") - 1]
            cost = raw_distances(asked, d_vectors[at : at + width], metric)
            new_rows, new_cols = np.nonzero(cost < limit[:, None])  # rounding may lift, not lower, what counts
            new = rounded(cost[new_rows, new_cols])
            kept = new < limit[new_rows]
            if not kept.any():
                continue
            rows, cols, away = np.r_[rows, new_rows[kept]], np.r_[cols, new_cols[kept] + at], np.r_[away, new[kept]]
            by = np.lexsort((cols, away, rows))
            rows, cols, away = rows[by], cols[by], away[by]
            near = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < k
            rows, cols, away = rows[near], cols[near], away[near]
        parts.append((rows + low, cols, away))
    rows, cols, away = (np.concatenate(x) if parts else np.zeros(0, int) for x in (zip(*parts) if parts else ((), (), ())))
    return pd.DataFrame({query_id: q_ids[rows], doc_id: d_ids[cols], "distance": away})


def vector_topk(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 8,
    metric: str = "l2",
    match_on: Sequence[str] = (),
    query_id: str = "query_id",
    doc_id: str = "vec_id",
    vector: str = "embedding",
    block_rows: int = 2_000,
) -> DataFrame:
    """The ``k`` nearest corpus rows of each query: (query, rank, doc, distance); exact.

    Ties go to the smaller id. ``match_on`` names metadata columns that must be
    equal on both sides; null equals nothing. Rows without a vector are near to nothing. At most ``block_rows`` queries go to the corpus, which then
    stays where it is and is scanned in slices of at most ``MAX_DISTANCES`` distances; more are never gathered, but compared with it
    in shuffled cells of ``block_rows`` of either side or more: of large sides so many that they are cut into ``PIECES``, up to ``CELL_NUMBERS``,
    as a row travels once for each piece of the other side. Either way a task emits at most k rows per query and cell, never the distances.
    """
    id_type = corpus.schema[doc_id].dataType.simpleString()
    q_type = queries.schema[query_id].dataType.simpleString()
    schema = f"{query_id} {q_type}, {doc_id} {id_type}, distance double"
    keys = list(match_on)
    docs = corpus.where(F.col(vector).isNotNull()).select(*keys, doc_id, F.col(vector).alias("_v"))
    asked = queries.where(F.col(vector).isNotNull()).select(*keys, query_id, F.col(vector).alias("_v"))
    shipped = asked.limit(block_rows + 1).collect()
    if not shipped:
        return docs.sparkSession.createDataFrame([], f"{schema}, rank int")

    def nearest(q_ids, q_vectors, d_ids, d_vectors) -> pd.DataFrame:
        return nearest_rows(q_ids, q_vectors, d_ids, d_vectors, k, metric, query_id, doc_id)

    if len(shipped) <= block_rows:
        groups: dict[tuple, list] = {}
        for r in shipped:
            groups.setdefault(tuple(r[c] for c in keys), []).append(r)
        known = {
            group: (np.array([r[query_id] for r in rows]), np.array([r["_v"] for r in rows], dtype=np.float64))
            for group, rows in groups.items() if None not in group
        }

        step = max(1, MAX_DISTANCES // len(shipped))

        def slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            return (batch[at : at + step] for batch in batches for at in range(0, len(batch), step))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = None
            for batch in slices(batches):
                parts = batch.groupby(keys, sort=False) if keys else [((), batch)]
                for group, part in parts:
                    if group not in known:
                        continue
                    found = nearest(*known[group], part[doc_id].to_numpy(), as_matrix(part["_v"]))
                    best = found if best is None else pd.concat([best, found])
                if best is not None:
                    best = best.sort_values(["distance", doc_id]).groupby(query_id, sort=False).head(k)
            if best is not None:
                yield best

        partial = docs.mapInPandas(scan, schema)
    else:
        most = CELL_NUMBERS // max(1, len(shipped[0]["_v"]))
        del shipped
        left, right, names = in_cells(docs, asked, keys, doc_id, query_id, block_rows, PIECES, most)

        def cell(d: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
            if not len(d) or not len(q):
                return pd.DataFrame({query_id: [], doc_id: [], "distance": []})
            return nearest(q[query_id].to_numpy(), as_matrix(q["_v"]), d[doc_id].to_numpy(), as_matrix(d["_v"]))

        partial = left.groupBy(*names).cogroup(right.groupBy(*names)).applyInPandas(cell, schema)
    return top_n(partial, [query_id], [F.col("distance"), F.col(doc_id)], k)


def rank_sources(hits: DataFrame, query_id: str = "query_id") -> DataFrame:
    """(query, sources): the retrieved documents as a list, each URL or title once, in rank order.

    ``hits`` holds ``rank`` and the documents' ``source``, ``job_title``,
    ``company``, ``job_url`` and ``title``; a query's hits are at most its k.
    """
    key = F.coalesce(F.nullif("job_url", F.lit("")), F.nullif("title", F.lit("")))
    job = F.format_string(
        "- **[%s at %s](%s)**", F.coalesce("job_title", F.lit("Job")), F.coalesce("company", F.lit("Unknown")), F.coalesce("job_url", F.lit("#"))
    )
    guide = F.format_string("- 📖 Guide: **%s**", F.coalesce("title", F.lit("Guide")))
    line = F.when(F.col("source") == "job_posting", job).when(F.col("source") == "career_guide", guide)
    first = hits.withColumn("_key", key).where("_key IS NOT NULL").groupBy(query_id, "_key").agg(
        F.min(F.struct("rank", line.alias("line"))).alias("_f")
    )
    lines = F.array_sort(F.collect_list(F.when(F.col("_f.line").isNotNull(), F.col("_f"))))
    listed = first.groupBy(query_id).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("sources"))
    return hits.select(query_id).distinct().join(listed, query_id, "left").fillna("", ["sources"])


def retrieve_with_sources(queries: DataFrame, corpus: DataFrame, metadata: DataFrame, k: int = 8, doc_id: str = "vec_id", query_id: str = "query_id", **kw) -> DataFrame:
    """Nearest documents of each query, formatted as a source list."""
    hits = vector_topk(queries, corpus, k, query_id=query_id, doc_id=doc_id, **kw)
    return rank_sources(hits.join(metadata, doc_id), query_id)


def profile_query(profiles: DataFrame) -> DataFrame:
    """The question a profile's roadmap is retrieved with."""
    text = F.format_string(
        "Career path from %s to %s for someone with %d years of experience. Key skills needed and transition strategy.",
        F.coalesce("current_role", F.lit("Professional")), F.coalesce("target_role", F.lit("target role")),
        F.coalesce("years_experience", F.lit(0)),
    )
    return profiles.select("profile_id", text.alias("query"))
