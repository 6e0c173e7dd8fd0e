"""Full-scan, keyword, AND, OR and phrase search over documents or postings; each gives doc_id rows.

Query terms are few and become literals of the plan, so filters reach the scan.
Postings of segments tell documents apart by segment_id and local_id, which
their results carry as well; a doc_id may come again in another segment.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamdex.functions.analysis import Analyzer


def identity(rows: DataFrame) -> list[str]:
    """The columns that tell documents apart."""
    return [c for c in ("segment_id", "local_id") if c in rows.columns] + ["doc_id"]


def _none(rows: DataFrame) -> DataFrame:
    return rows.select(*identity(rows)).where(F.lit(False))


def full_scan(docs: DataFrame, query: str, analyzer: Analyzer) -> DataFrame:
    """Documents that hold all tokens of the query, without an index; an empty query finds none."""
    wanted = sorted(set(analyzer.analyze(query)))
    if not wanted:
        return _none(docs)
    own = identity(docs)
    rows = analyzer.analyzed(docs.select(*own, "text"), *own[:-1])
    return rows.where(F.size(F.array_except(F.array(*map(F.lit, wanted)), "terms")) == 0).select(*own)


def all_terms(postings: DataFrame, terms: list[str]) -> DataFrame:
    """Documents with all of the terms, repeats counting once; no terms find none."""
    wanted, own = sorted(set(terms)), identity(postings)
    if not wanted:
        return _none(postings)
    met = postings.where(F.col("term").isin(wanted)).groupBy(*own).agg(F.countDistinct("term").alias("n"))
    return met.where(F.col("n") == len(wanted)).select(*own)


def keyword(postings: DataFrame, word: str, analyzer: Analyzer) -> DataFrame:
    """Documents with the first token of the keyword; a keyword without tokens finds none."""
    term = next(iter(analyzer.analyze(word)), "")
    return postings.where(F.col("term") == term).select(*identity(postings)).distinct() if term else _none(postings)


def search_and(postings: DataFrame, keywords: list[str], analyzer: Analyzer) -> DataFrame:
    """Documents with every keyword's first token; a keyword that analyzes to nothing makes the result empty."""
    first = [next(iter(analyzer.analyze(k)), "") for k in keywords]
    return all_terms(postings, first) if all(first) else _none(postings)


def search_or(postings: DataFrame, keywords: list[str], analyzer: Analyzer) -> DataFrame:
    """Documents with any keyword's first token; keywords that analyze to nothing do not matter."""
    terms = sorted({t for k in keywords if (t := next(iter(analyzer.analyze(k)), ""))})
    return postings.where(F.col("term").isin(terms)).select(*identity(postings)).distinct() if terms else _none(postings)


def phrase(postings: DataFrame, keywords: list[str], analyzer: Analyzer) -> DataFrame:
    """Documents with the keywords' tokens at consecutive positions; a term may come twice.  Needs positions."""
    if "positions" not in postings.columns:
        raise NotImplementedError("phrase search needs a positional index")
    terms, own = analyzer.analyze_query(keywords), identity(postings)
    if not terms:
        return _none(postings)
    distinct = sorted(set(terms))
    held = postings.where(F.col("term").isin(distinct)).groupBy(*own).agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"))
    held = held.where(F.size("at") == len(distinct))
    starts = [_shifted(t, i) for i, t in enumerate(terms)]
    return held.where(F.size(reduce(F.array_intersect, starts)) > 0).select(*own)


def _shifted(term: str, by: int) -> Column:
    return F.transform(F.col("at")[term], lambda p: p - by)
