"""The search engine over a crawl: cleaned pages, a link graph, and ranked search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamdex.operators.index import Index
from loamdex.plans.graph import combined_rank, page_rank
from loamdex.plans.ranking import tf_idf
from loamdex.sources.store import number_rows, read_edges, read_folder, read_nodes
from loamdex.sources.tables import stored


def page_id(docs: DataFrame) -> DataFrame:
    """(doc_id, id): the number in a page's first line."""
    return docs.select("doc_id", F.split("text", "\n")[0].try_cast("int").alias("id"))


@dataclass
class SearchEngine:
    folder: str
    index: Index
    ranks: DataFrame | None = None

    def write_index(self, threshold: int | None = 1000) -> None:
        """Index the pages of <folder>/cleaned; ids run from 0 in an order that the paths alone decide."""
        files = stored(read_folder(self.index.spark, self.folder).withColumn("key", F.xxhash64("path")), "pages")
        ordered = number_rows(files, "key")
        self.index.add(ordered.select((F.col("rn") - 1).alias("doc_id"), "text"), threshold)

    def compute_page_rank(self, iterations: int) -> None:
        read = lambda name: self.index.spark.read.text(f"{self.folder}/{name}")
        self.ranks = stored(page_rank(read_nodes(read("url.tsv")), read_edges(read("id-graph.tsv")), iterations), "page_rank")

    def page_rank_scores(self) -> DataFrame:
        return self.ranks.orderBy(F.desc("rank"), "id")

    def tf_idf(self, query: list[str], top_k: int | None = None) -> DataFrame:
        n = self.index.documents().agg(F.count(F.lit(1)).alias("n"))
        return tf_idf(self.index.postings(hidden=False), n, self.index.analyzer.analyze_query(query), top_k)

    def search(self, query: list[str], top_k: int, weight: float) -> DataFrame:
        """(doc_id, score, text) by TF-IDF plus weight times page rank; texts are fetched for the best only."""
        docs = self.index.documents()
        best = combined_rank(self.tf_idf(query), page_id(docs), self.ranks, weight, top_k)
        return best.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "score", "text").orderBy(F.desc("score"), "doc_id")
