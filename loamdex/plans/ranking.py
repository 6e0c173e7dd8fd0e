"""TF-IDF ranking: no logarithm, no smoothing, normalised over the query's terms only."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamdex.operators.search import identity
from loamdex.sources.tables import stored


def tf_idf(postings: DataFrame, num_docs: DataFrame, terms: list[str], top_k: int | None = None) -> DataFrame:
    """(doc_id, score) of documents with any of the terms (analyzed; repeats weigh more), best first, ties by doc_id.

    idf = N / df, q = count in the query * idf, w = tf * idf, and score =
    sum(w q) / sqrt(sum(w^2)).  num_docs is one row (n).  top_k=None gives all,
    0 or less none.  Postings of segments give their segment_id and local_id as
    well.  Deleted terms are not hidden here: pass all postings.
    """
    spark = postings.sparkSession
    counted = Counter(terms)
    if not counted or top_k is not None and top_k <= 0:
        return postings.select(*identity(postings), F.lit(0.0).alias("score")).where(F.lit(False))
    query = spark.createDataFrame(sorted(counted.items()), "term string, qtf long")
    by = identity(postings)
    own = stored(postings.where(F.col("term").isin(sorted(counted))).select("term", *by, "tf"), "matches")
    df = own.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(query), "term")
    idf = df.crossJoin(F.broadcast(num_docs)).select("term", "qtf", (F.col("n") / F.col("df")).alias("idf"))
    # The matches are read twice, so they are stored once; idf has one row a query term and is broadcast.
    weighted = own.join(F.broadcast(idf), "term").select(*by, (F.col("tf") * F.col("idf")).alias("w"), (F.col("qtf") * F.col("idf")).alias("q"))
    scores = weighted.groupBy(*by).agg((F.sum(F.col("w") * F.col("q")) / F.sqrt(F.sum(F.col("w") * F.col("w")))).alias("score"))
    ranked = scores.orderBy(F.desc("score"), "doc_id")
    return ranked if top_k is None else ranked.limit(top_k)
