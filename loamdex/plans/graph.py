"""PageRank over a bag of edges, and the rank that combines it with TF-IDF."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamdex.sources.tables import stored

DAMPING, CUT_EVERY = 0.85, 5


def out_degrees(edges: DataFrame) -> DataFrame:
    """(src, degree), parallel edges counted."""
    return edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))


def page_rank(nodes: DataFrame, edges: DataFrame, iterations: int) -> DataFrame:
    """(id, rank) after so many rounds of rank(v) = 0.15 + 0.85 * sum(rank(u) / degree(u)), from 1.0.

    Edges to unknown nodes count in a degree, but their share is lost, as is
    that of nodes without edges; edges from unknown nodes are left out.  Edges
    are gathered once to one row a pair; lineage is cut every few rounds.
    """
    weights = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m")).join(out_degrees(edges), "src")
    weights = stored(weights.select("src", "dst", (F.col("m") / F.col("degree")).alias("p")), "edges")
    nodes = nodes.select("id").distinct()
    ranks = nodes.withColumn("rank", F.lit(1.0))
    for i in range(iterations):
        given = weights.join(ranks, weights.src == ranks.id).groupBy("dst").agg(F.sum(F.col("rank") * F.col("p")).alias("given"))
        ranks = nodes.join(given, nodes.id == given.dst, "left").select("id", (F.lit(1 - DAMPING) + F.lit(DAMPING) * F.coalesce("given", F.lit(0.0))).alias("rank"))
        if (i + 1) % CUT_EVERY == 0 and i + 1 < iterations:
            ranks = stored(ranks, "ranks")
    return ranks


def combined_rank(scores: DataFrame, node_of: DataFrame, ranks: DataFrame, weight: float, top_k: int | None = None) -> DataFrame:
    """(doc_id, score) with score + weight * rank; node_of has (doc_id, id), and documents without a rank count 0."""
    joined = scores.join(node_of, "doc_id", "left").join(ranks, "id", "left")
    out = joined.select("doc_id", (F.col("score") + weight * F.coalesce("rank", F.lit(0.0))).alias("score")).orderBy(F.desc("score"), "doc_id")
    return out if top_k is None else out.limit(max(0, top_k))
