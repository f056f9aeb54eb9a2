"""A partitioned vector index: vectors in lists around centroids, searched list by list.

Centroids are fitted by k-means on a bounded sample (``rows`` vectors, drawn by a hash of the id); every row is
then assigned to its nearest one and written, in order of the lists. A search looks into the ``probes`` lists nearest to a
query. With ``exact`` it goes on: what was found bounds the distance of the k-th neighbour, and by the triangle inequality
only lists whose centroid is no further than that bound and the list's radius can hold a nearer one.

Lists and queries meet in shuffled cells of bounded size (see :mod:`jobtide.operators.cells`), so a large list
or one that many queries ask is spread. Only centroids, radii and counts travel to tasks, at most ``MAX_LISTS`` of each.

Rows without a vector are not indexed, and queries without one find nothing.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.operators.cells import in_cells
from jobtide.operators.market import top_n
from jobtide.operators.retrieval import as_matrix, nearest_rows
from jobtide.session import cut_lineage

#: Bound of centroids; at 384 dimensions they take 12 MB.
MAX_LISTS = 4096


class VectorIndex(NamedTuple):
    path: str
    centroids: np.ndarray
    radii: np.ndarray  # largest distance from a centroid to a vector of its list; -1 where the list is empty
    metric: str
    doc_id: str
    vector: str


def _prepared(vectors: np.ndarray, metric: str) -> np.ndarray:
    """For cosine, vectors of length one: their squared distance is twice the cosine distance."""
    if metric != "cosine":
        return vectors
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)


def _nearest(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    out = []
    for at in range(0, len(vectors), 4096):
        some = vectors[at : at + 4096]
        out.append(((centroids**2).sum(axis=1)[None, :] - 2.0 * some @ centroids.T).argmin(axis=1))
    return np.concatenate(out) if out else np.zeros(0, int)


def fit_centroids(corpus: DataFrame, lists: int, rows: int = 20_000, rounds: int = 10, metric: str = "l2",
                  doc_id: str = "vec_id", vector: str = "embedding") -> np.ndarray:
    """Centres of k-means on a sample of ``rows`` vectors; fewer than ``lists`` if it holds fewer different vectors."""
    sample = corpus.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(doc_id), doc_id).limit(rows).select(F.col(vector).alias("v")).collect()
    if not sample:
        return np.zeros((0, 0))
    points = _prepared(np.array([r.v for r in sample], dtype=np.float64), metric)
    centres = np.unique(points[: min(len(points), 4 * lists)], axis=0)
    centres = centres[np.random.default_rng(1).permutation(len(centres))[:lists]]
    for _ in range(rounds):
        own = _nearest(points, centres)
        size = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
    return centres


def build_index(corpus: DataFrame, path: str, lists: int | None = None, rows: int = 20_000, metric: str = "l2",
                doc_id: str = "vec_id", vector: str = "embedding") -> VectorIndex:
    """Assign every row to a list and write it; without ``lists`` there are about as many as a list has rows."""
    corpus = corpus.where(F.col(vector).isNotNull())
    if lists is None:
        lists = max(1, round(corpus.count() ** 0.5))
    centroids = fit_centroids(corpus, min(lists, MAX_LISTS), rows, metric=metric, doc_id=doc_id, vector=vector)

    @F.pandas_udf("list int, away double")
    def placed(vectors: pd.Series) -> pd.DataFrame:
        points = _prepared(as_matrix(vectors), metric) if len(vectors) else np.zeros((0, centroids.shape[1]))
        own = _nearest(points, centroids)
        return pd.DataFrame({"list": own, "away": np.linalg.norm(points - centroids[own], axis=1)})

    rows_ = corpus.withColumn("_placed", placed(vector)).select(corpus["*"], F.col("_placed.list").alias("list"), F.col("_placed.away").alias("away"))
    rows_.repartitionByRange("list", doc_id).sortWithinPartitions("list", doc_id).write.mode("overwrite").parquet(path)
    radii = np.full(len(centroids), -1.0)
    for r in corpus.sparkSession.read.parquet(path).groupBy("list").agg(F.max("away").alias("r")).collect():  # a row for each list
        radii[r.list] = r.r
    return VectorIndex(path, centroids, radii, metric, doc_id, vector)


def _reached(index: VectorIndex, probes: int, bound: bool):
    """The lists nearest to a query; or, with ``bound``, all others that may hold something nearer than a distance."""
    centroids, radii = index.centroids, index.radii

    def ranked(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        points = _prepared(as_matrix(vectors), index.metric)
        away = np.sqrt(np.maximum((points**2).sum(axis=1)[:, None] + (centroids**2).sum(axis=1)[None, :] - 2.0 * points @ centroids.T, 0.0))
        away[:, radii < 0] = np.inf  # empty lists
        return away, np.argsort(away, axis=1, kind="stable")[:, :probes]

    if not bound:
        @F.pandas_udf("array<int>")
        def first(vectors: pd.Series) -> pd.Series:
            away, near = ranked(vectors)
            return pd.Series([[int(c) for c in n if np.isfinite(a[c])] for a, n in zip(away, near)])

        return first

    @F.pandas_udf("array<int>")
    def others(vectors: pd.Series, found: pd.Series) -> pd.Series:
        away, near = ranked(vectors)
        # Cosine distances are half of squared distances; what was found is rounded.
        reach = np.sqrt(np.maximum(found.to_numpy(float) * (2 if index.metric == "cosine" else 1), 0) + 1e-5) + 1e-9
        open_ = (away - radii[None, :] <= np.where(np.isnan(reach), np.inf, reach)[:, None]) & np.isfinite(away)
        np.put_along_axis(open_, near, False, axis=1)
        return pd.Series([np.flatnonzero(o).tolist() for o in open_])

    return others


def search(queries: DataFrame, index: VectorIndex, k: int = 8, probes: int = 8, exact: bool = False,
           query_id: str = "query_id", block_rows: int = 2_000) -> DataFrame:
    """The ``k`` nearest indexed rows of each query: (query, rank, doc, distance); ties go to the smaller id.

    Without ``exact`` rows outside the ``probes`` nearest lists are missed.
    """
    spark = queries.sparkSession
    q_type = queries.schema[query_id].dataType.simpleString()
    corpus = spark.read.parquet(index.path)
    id_type = corpus.schema[index.doc_id].dataType.simpleString()
    schema = f"{query_id} {q_type}, {index.doc_id} {id_type}, distance double"
    if not len(index.centroids):
        return spark.createDataFrame([], f"{schema}, rank int")
    asked = queries.where(F.col(index.vector).isNotNull()).select(query_id, F.col(index.vector).alias("_v"))
    docs = corpus.select("list", index.doc_id, F.col(index.vector).alias("_v"))

    def cell(d: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(d) or not len(q):
            return pd.DataFrame({query_id: [], index.doc_id: [], "distance": []})
        return nearest_rows(q[query_id].to_numpy(), as_matrix(q["_v"]), d[index.doc_id].to_numpy(), as_matrix(d["_v"]), k, index.metric, query_id, index.doc_id)

    def looked_up(reached: Column, of: DataFrame) -> DataFrame:
        probe = cut_lineage(of.select(query_id, "_v", F.explode(reached).alias("list")))
        left, right, names = in_cells(docs, probe, ["list"], index.doc_id, query_id, block_rows)
        return left.groupBy(*names).cogroup(right.groupBy(*names)).applyInPandas(cell, schema)

    order = [F.col("distance"), F.col(index.doc_id)]
    found = top_n(looked_up(_reached(index, probes, False)("_v"), asked), [query_id], order, k)
    if not exact:
        return found
    found = cut_lineage(found)
    limits = found.where(F.col("rank") == k).select(query_id, F.col("distance").alias("_found"))
    rest = looked_up(_reached(index, probes, True)("_v", "_found"), asked.join(limits, query_id, "left"))
    return top_n(found.drop("rank").unionByName(rest), [query_id], order, k)


def recall(found: DataFrame, true: DataFrame, query_id: str = "query_id", doc_id: str = "vec_id") -> DataFrame:
    """(query, n_true, n_found): how many of the true neighbours a search has found."""
    hit = true.select(query_id, doc_id).join(found.select(query_id, doc_id).withColumn("_hit", F.lit(1)), [query_id, doc_id], "left")
    return hit.groupBy(query_id).agg(F.count(F.lit(1)).alias("n_true"), F.count("_hit").alias("n_found"))
