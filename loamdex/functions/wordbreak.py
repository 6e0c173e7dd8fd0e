"""Word segmentation of un-spaced text with a frequency dictionary, which is a parameter."""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamdex.functions.analysis import STOP_WORDS


def read_dictionary(lines: DataFrame) -> DataFrame:
    """(word, freq, line_no) of lines (line_no, value): trimmed, split at single blanks; lines of other than two fields drop out."""
    parts = F.split(F.regexp_replace("value", r"^[\x00-\x20]+|[\x00-\x20]+$", ""), " ")
    return lines.select("line_no", parts.alias("p")).where(F.size("p") == 2).select(F.col("p")[0].alias("word"), F.col("p")[1].cast("double").alias("freq"), "line_no")


def rewritten(lines: DataFrame) -> DataFrame:
    """lines (value, ...) where those of three fields, `rank freq word`, become `word freq`; a leading blank makes an empty first field, other lines stay."""
    return lines.withColumn("value", F.regexp_replace("value", r"^\S*\s+(\S+)\s+(\S+)\s*\z", "$2 $1"))


def probabilities(entries: DataFrame) -> DataFrame:
    """(word, p): the last frequency of a word over the sum of all rows, repeats included."""
    last = entries.groupBy("word").agg(F.max_by("freq", "line_no").alias("freq"))
    total = entries.agg(F.sum("freq")).first()[0]
    return last.select("word", (F.col("freq") / F.lit(total)).alias("p"))


@dataclass
class WordBreaker:
    """Segments lower-cased text into dictionary words of the greatest product of probabilities; then stop words go.

    Of equal products the one with fewer words wins, then the shorter first
    word.  Text that cannot be segmented, blanks alone included, raises, or
    gives None with on_error="null".
    """

    logs: dict[str, float]
    on_error: str = "fail"

    def __post_init__(self):
        self.longest = max(map(len, self.logs), default=0)

    def tokenize(self, text: str | None) -> list[str] | None:
        text = (text or "").strip("".join(map(chr, range(33)))).lower()
        best: list[tuple[float, int, int] | None] = [None] * len(text) + [(0.0, 0, 0)]
        for i in range(len(text) - 1, -1, -1):
            for j in range(i + 1, min(len(text), i + self.longest) + 1):
                rest, log = best[j], self.logs.get(text[i:j])
                if rest is not None and log is not None and (best[i] is None or (-(log + rest[0]), rest[1] + 1) < (-best[i][0], best[i][1])):
                    best[i] = (log + rest[0], rest[1] + 1, j)
        if not text or best[0] is None:
            if self.on_error == "null":
                return None
            raise ValueError("the text cannot be broken into words")
        out, i = [], 0
        while i < len(text):
            out.append(text[i : best[i][2]])
            i = best[i][2]
        return [t for t in out if t not in STOP_WORDS]

    @classmethod
    def of(cls, table: DataFrame, on_error: str = "fail", most: int = 5_000_000) -> WordBreaker:
        """Of (word, p); the dictionary goes through the driver and is refused beyond `most` words."""
        rows = table.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} words")
        return cls({r.word: math.log(r.p) for r in rows if r.p > 0}, on_error)

    def column(self, text: Column) -> Column:
        """array<string> of a string Column, in Arrow batches; each batch segments its distinct texts, and the dictionary is broadcast once."""
        spark = SparkSession.getActiveSession()
        shared = spark.sparkContext.broadcast(self)

        def run(texts):
            breaker = shared.value
            of = {t: breaker.tokenize(t) for t in texts.drop_duplicates()}
            return texts.map(of)

        run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
        return F.pandas_udf(run, "array<string>")(text)



def japanese_breaker(entries: DataFrame, on_error: str = "fail") -> WordBreaker:
    """A segmenter of Japanese text, by a Japanese dictionary (word, freq, line_no); nothing of another language stays in it."""
    return WordBreaker.of(probabilities(entries), on_error)
