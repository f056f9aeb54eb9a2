"""Skill graphs as edge and vertex tables; many graphs, one per ``by`` value, at once.

Edges are undirected: one row per pair in (``src``, ``dst``). Vertices are in ``node``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide.operators.market import top_n
from jobtide.session import cut_lineage


def _both_ways(edges: DataFrame, by: Sequence[str]) -> DataFrame:
    one = edges.select(*by, F.col("src").alias("node"), F.col("dst").alias("other"))
    return one.union(edges.select(*by, "dst", "src"))


def degree_centrality(edges: DataFrame, vertices: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Degree over the number of other vertices; an isolated vertex has zero."""
    keys = list(by)
    degrees = _both_ways(edges, by).groupBy(*by, "node").agg(F.count(F.lit(1)).alias("degree"))
    joined = vertices.select(*by, "node").join(degrees, [*by, "node"], "left").fillna(0, ["degree"])
    sizes = vertices.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    joined = joined.join(sizes, keys) if keys else joined.withColumn("_n", sizes.scalar())
    centrality = F.when(F.col("_n") > 1, F.col("degree") / (F.col("_n") - 1)).otherwise(F.lit(1.0))
    return joined.withColumn("centrality", centrality).drop("_n")


def communities(edges: DataFrame, vertices: DataFrame, by: Sequence[str] = (), rounds: int = 10) -> DataFrame:
    """Communities of the unweighted graphs by label propagation: (by, node, community).

    Every vertex starts with its own name. In a round, all vertices of all graphs at once take the label that most of their
    neighbours and they themselves hold, of equally frequent ones the smallest. It ends when no label changes, or after ``rounds``
    rounds. A community is named after its smallest vertex; isolated vertices stay alone. One method
    for graphs of any size: a round is two joins over the edge table, and is checkpointed.
    """
    keys = list(by)
    own = vertices.select(*keys, "node").distinct()
    labels = cut_lineage(own.select(*keys, "node", F.concat("node", F.lit("")).alias("label")))
    # A vertex hears its neighbours and itself.
    links = _both_ways(edges.where("src <> dst"), by).unionByName(own.select(*keys, "node", F.concat("node", F.lit("")).alias("other")))
    links = cut_lineage(links.distinct())
    mark = None
    for _ in range(rounds):
        heard = links.join(labels.withColumnsRenamed({"node": "other"}), [*keys, "other"])
        votes = heard.groupBy(*keys, "node", "label").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy(*keys, "node").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("best"))
        labels = cut_lineage(best.select(*keys, "node", F.col("best.label").alias("label")))
        state = labels.agg(F.sum(F.xxhash64(*keys, "node", "label").cast("decimal(38,0)"))).first()[0]
        if state == mark:
            break
        mark = state
    smallest = labels.groupBy(*keys, "label").agg(F.min("node").alias("community"))
    return labels.join(smallest, [*keys, "label"]).select(*keys, "node", "community")


def modularity(edges: DataFrame, labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Modularity Q of a partition, one aggregate per graph."""
    keys = list(by) or ["_graph"]
    graph = lambda df: df if by else df.withColumn("_graph", F.lit(0))
    links, labels = graph(edges), graph(labels)
    side = lambda name: labels.select(*keys, F.col("node").alias(name), F.col("community").alias(f"c_{name}"))
    ends = links.join(side("src"), [*keys, "src"]).join(side("dst"), [*keys, "dst"])
    inside = ends.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("c_src") == F.col("c_dst")).alias("within"))
    ends_of = ends.select(*keys, F.explode(F.array("c_src", "c_dst")).alias("community"))
    mass = ends_of.groupBy(*keys, "community").agg(F.count(F.lit(1)).alias("d"))
    squares = mass.groupBy(*keys).agg(F.sum(F.col("d") * F.col("d")).alias("dd"))
    q = F.col("within") / F.col("m") - F.col("dd") / (4 * F.col("m") * F.col("m"))
    return inside.join(squares, keys).select(*by, q.alias("modularity"))


def community_breakdown(centrality: DataFrame, labels: DataFrame, by: Sequence[str] = (), n: int = 8) -> DataFrame:
    """The most central vertices of each community, the largest communities first."""
    joined = labels.join(centrality, [*by, "node"])
    ranked = top_n(joined, [*by, "community"], [F.col("centrality").desc(), F.col("node")], n)
    sizes = labels.groupBy(*by, "community").agg(F.count(F.lit(1)).alias("size"))
    return ranked.join(sizes, [*by, "community"]).select(*by, "community", "size", "rank", "node", "centrality")
