"""Text analysis as Column expressions: tokenizers, stop words, analyzers, positions.

An analyzer maps a string Column to an array<string> Column and a Python string
to a list, so that documents are analyzed on the JVM and queries on the driver.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The stop words.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()
# Delimiters of the punctuation tokenizer; the caret is one of them, and \v is vertical white space.
DELIMITERS = ",.;?! ^\f\n\r\t\x0b\x85  "
_JAVA_CLASS = r"[,.;?! ^\f\n\r\t\v]"


def punctuation_tokens(text: Column) -> Column:
    """Lower-cased pieces between delimiters, without empty pieces and stop words; null and '' give []."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit("".join(map(chr, range(0x21)))))
    return F.filter(F.split(F.lower(trimmed), _JAVA_CLASS), lambda t: (t != "") & ~t.isin(*STOP_WORDS))


def punctuation_tokens_py(text: str | None) -> list[str]:
    trimmed = re.sub(r"\A[\x00-\x20]+|[\x00-\x20]+\Z", "", text or "").lower()
    return [t for t in re.split(f"[{re.escape(DELIMITERS)}]", trimmed) if t and t not in STOP_WORDS]


def naive_tokens(text: Column) -> Column:
    """Lower-cased pieces between ASCII white space; trailing empty pieces go, a leading one and that of '' stay."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t\n\x0B\f\r]+")
    kept = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    blank = (F.size(parts) == 2) & (parts[0] == "") & (F.element_at(parts, -1) == "")
    return F.when(F.coalesce(text, F.lit("")) == "", F.array(F.lit(""))).when(blank, F.array().cast("array<string>")).otherwise(kept)


def naive_tokens_py(text: str | None) -> list[str]:
    parts = re.split(r"[ \t\n\x0b\f\r]+", (text or "").lower())
    if parts == [""]:
        return parts
    while parts and parts[-1] == "":
        parts.pop()
    return parts


@dataclass(frozen=True)
class Analyzer:
    """tokens on the JVM, tokens_py on the driver; stem, if given, maps a term to its stem and runs over distinct terms only."""

    tokens: Callable[[Column], Column] = punctuation_tokens
    tokens_py: Callable[[str | None], list[str]] = punctuation_tokens_py
    stem: Callable[[str], str] | None = None

    def analyze(self, text: str | None) -> list[str]:
        found = self.tokens_py(text)
        return [self.stem(t) for t in found] if self.stem else found

    def analyze_query(self, keywords: list[str]) -> list[str]:
        """All tokens of all keywords; keywords that analyze to nothing drop out."""
        return [t for k in keywords for t in self.analyze(k) if t]

    def analyzed(self, docs: DataFrame, *own: str) -> DataFrame:
        """(own columns, doc_id, terms) of docs (doc_id, text, own columns): each text's terms in order.

        Stemming runs in Arrow batches, over the distinct terms of each; nothing is shuffled for it.
        """
        found = docs.select(*own, "doc_id", self.tokens(F.col("text")).alias("terms"))
        if self.stem is None:
            return found
        stem = self.stem

        def run(batches):
            import pyarrow as pa
            import pyarrow.compute  # noqa: F401

            for batch in batches:
                lists = batch.column(batch.num_columns - 1)
                coded = lists.flatten().dictionary_encode()
                stems = pa.array([stem(t) for t in coded.dictionary.to_pylist()], pa.string())
                # Only the dictionary is stemmed; offsets start anew, as flatten() leaves out what lies before.
                sizes = pa.compute.list_value_length(lists).fill_null(0).to_numpy()
                offsets = pa.array([0, *sizes.cumsum().tolist()], pa.int32())
                terms = pa.ListArray.from_arrays(offsets, stems.take(coded.indices))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], terms], names=batch.schema.names)

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema)
        return found.mapInArrow(run, kinds)

    def occurrences(self, docs: DataFrame, *own: str) -> DataFrame:
        """(own columns, doc_id, pos, term) of docs (doc_id, text, own columns); pos counts what stop words leave, from 0."""
        return self.analyzed(docs, *own).select(*own, "doc_id", F.posexplode("terms").alias("pos", "term"))


def stemmed(terms: DataFrame, stem: Callable[[str], str]) -> DataFrame:
    """(term, stem) of a table of distinct terms, in Arrow batches."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            column = batch.column(0)
            yield pa.RecordBatch.from_arrays([column, pa.array([None if t is None else stem(t) for t in column.to_pylist()], pa.string())], names=["term", "stem"])

    return terms.select("term").mapInArrow(run, "term string, stem string")


def positions(docs: DataFrame, keyword: str, analyzer: Analyzer) -> DataFrame:
    """(doc_id, positions) of the keyword's first token in each document that has it."""
    term = next(iter(analyzer.analyze(keyword)), None)
    found = analyzer.occurrences(docs).where(F.col("term") == F.lit(term))
    return found.groupBy("doc_id").agg(F.sort_array(F.collect_list("pos")).alias("positions"))
