"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts come from array operations over their bytes.  The
trees are grown on the driver from a bounded sample of labelled rows, flattened
into arrays, broadcast, and traversed for a batch at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamdex.llm.common import keyed, remainder
from loamdex.llm.textops import LOWER, NOT_SPACE, Block, blocks, run_hashes, runs

#: Labelled rows that a model is fitted on at most (about; chosen by a hash of the id).
SAMPLE_ROWS = 40_000
THRESHOLD = 0.7
FEATURES = (
    "log_bytes", "log_words", "mean_word", "sd_word", "long_words", "short_words", "upper", "digit", "symbol", "stop_marks", "commas", "beyond_ascii", "blank", "newlines",
    "log_lines", "mean_line", "repeated_lines", "distinct_words", "entropy", "symbol_words", "capital_words", "digit_words", "longest_word", "commonest_word", "end_marks",
)
_UPPER, _DIGIT, _SYMBOL, _STOP, _END = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91] = _DIGIT[48:58] = True
_SYMBOL[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:!?'\"()-"]] = True
_STOP[[ord(c) for c in ".!?"]] = True


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _distinct(hashes: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By row: distinct items, and how often the commonest occurs."""
    rows = len(firsts) - 1
    if not len(hashes):
        return np.zeros(rows), np.zeros(rows)
    row = np.repeat(np.arange(rows), np.diff(firsts))
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    most = np.zeros(rows)
    np.maximum.at(most, r[at], np.diff(np.append(at, len(h))))
    return np.bincount(r[at], minlength=rows).astype(float), most


def statistics(block: Block) -> np.ndarray:
    """rows x FEATURES."""
    data, offsets, rows = block.data, block.offsets, block.rows
    starts, ends = runs(NOT_SPACE[data], offsets)
    low, firsts = LOWER[data], np.searchsorted(starts, offsets)
    size, count = np.diff(offsets).astype(float), np.diff(firsts).astype(float)
    line_starts, line_ends = runs(data != 10, offsets)
    line_firsts = np.searchsorted(line_starts, offsets)
    lines = np.diff(line_firsts).astype(float)
    length = (ends - starts).astype(float)
    by_word = lambda flags: _per_row(flags, firsts) / np.maximum(count, 1)
    by_byte = lambda flags: _per_row(flags, offsets) / np.maximum(size, 1)
    mean = by_word(length)
    words, commonest = _distinct(run_hashes(low, starts, ends), firsts)
    distinct_lines, _ = _distinct(run_hashes(low, line_starts, line_ends), line_firsts)
    longest, entropy = np.zeros(rows), np.zeros(rows)
    np.maximum.at(longest, np.repeat(np.arange(rows), np.diff(firsts)), length)
    for r in range(rows):
        if size[r]:
            p = np.bincount(data[offsets[r] : offsets[r + 1]], minlength=256) / size[r]
            p = p[p > 0]
            entropy[r] = -(p * np.log2(p)).sum()
    first_byte = data[starts] if len(starts) else np.zeros(0, np.uint8)
    last_byte = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    symbols = np.zeros(len(data) + 1)
    np.cumsum(_SYMBOL[data], out=symbols[1:])
    columns = (
        np.log1p(size), np.log1p(count), mean, np.sqrt(np.maximum(by_word(length**2) - mean**2, 0)), by_word(length > 12), by_word(length <= 2), by_byte(_UPPER[data]), by_byte(_DIGIT[data]), by_byte(_SYMBOL[data]), by_byte(_STOP[data]),
        by_byte(data == 44), by_byte(data >= 128), by_byte(~NOT_SPACE[data]), by_byte(data == 10), np.log1p(lines), size / np.maximum(lines, 1), 1 - distinct_lines / np.maximum(lines, 1), words / np.maximum(count, 1), entropy,
        by_word(symbols[ends] - symbols[starts] > 0), by_word(_UPPER[first_byte]), by_word(_DIGIT[first_byte]), longest, commonest / np.maximum(count, 1), by_word(_STOP[last_byte]),
    )
    return np.stack(columns, axis=1)


@dataclass
class Trees:
    """Flattened trees: node i of all trees tests feature[i] <= cut[i] (then left[i], else right[i]); leaves have feature -1 and a value."""

    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[at]
            inner = f >= 0
            goes = x[rows, np.maximum(f, 0)] <= self.cut[at]
            at = np.where(inner, np.where(goes, self.left[at], self.right[at]), at)
        return self.base + self.value[at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 2.0, l2: float = 1.0) -> Trees:
    """Trees for the log-odds of y, by second-order boosting over binned features.  One class only, or no rows: a constant."""
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    feature, cut, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        for part, empty in ((feature, -1), (cut, 0.0), (left, -1), (right, -1), (value, 0.0)):
            part.append(empty)
        return len(feature) - 1

    if len(y) and 0 < y.sum() < len(y):
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        raw, width = np.full(len(y), base), x.shape[1]
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, p * (1 - p)
            root = node()
            roots.append(root)
            level = [(root, np.arange(len(y)))]
            for d in range(depth + 1):
                below = []
                for at, rows in level:
                    flat = (binned[rows] + np.arange(width) * bins).ravel()
                    gs = np.bincount(flat, np.repeat(g[rows], width), width * bins).reshape(width, bins).cumsum(axis=1)
                    hs = np.bincount(flat, np.repeat(h[rows], width), width * bins).reshape(width, bins).cumsum(axis=1)
                    all_g, all_h = gs[0, -1], hs[0, -1]
                    gain = gs**2 / (hs + l2) + (all_g - gs) ** 2 / (all_h - hs + l2) - all_g**2 / (all_h + l2)
                    gain[(hs < least) | (all_h - hs < least)] = -1
                    j, b = divmod(int(gain.argmax()), bins)
                    if d == depth or gain[j, b] <= 1e-6 or b >= len(edges[j]):
                        value[at] = rate * all_g / (all_h + l2)
                        raw[rows] += value[at]
                        continue
                    feature[at], cut[at], left[at], right[at] = j, float(edges[j][b]), node(), node()
                    goes = binned[rows, j] <= b
                    below += [(left[at], rows[goes]), (right[at], rows[~goes])]
                level = below
    return Trees(np.array(roots, np.int64), np.array(feature or [-1]), np.array(cut or [0.0]), np.array(left or [-1]), np.array(right or [-1]), np.array(value or [0.0]), base, depth)


def _features(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, quality) as (quality, features)."""

    def count(batches):
        for rows in batches:
            for block in blocks(rows.column(0)):
                found = statistics(block)
                values = pa.ListArray.from_arrays(pa.array(np.arange(block.rows + 1, dtype=np.int32) * found.shape[1]), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([rows.column(1).slice(block.first, block.rows), values], names=["quality", "features"])

    return docs.mapInArrow(count, "quality int, features array<double>")


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Trees of the labelled rows of docs where usable holds: all, or about sample_rows by a hash of the id."""
    marked = labels.select(F.col("doc_id").cast("bigint").alias("labelled"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)").groupBy("labelled").agg(F.max("quality").alias("quality"))
    if usable is not None:
        marked = marked.withColumnRenamed("labelled", "doc_id").where(usable).withColumnRenamed("doc_id", "labelled")
    share = min(1.0, sample_rows / max(1, marked.count()))
    picked = marked.where(F.pmod(F.xxhash64("labelled", F.lit(6)), F.lit(1 << 20)) < share * (1 << 20))
    # About sample_rows short rows at most, so they are broadcast, and no text is shuffled.
    rows = _features(docs.join(F.broadcast(picked), docs.doc_id == picked.labelled).select("text", "quality")).collect()
    x = np.array([r.features for r in rows]).reshape(len(rows), len(FEATURES))
    order = np.lexsort(x.T)
    return fit(x[order], np.array([r.quality for r in rows], float)[order])


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, held_out: tuple[int, int] = (4, 2)) -> DataFrame:
    """doc_id, held_out, score and predicted of each document.

    The model learns labels.quality (1 is good) from documents whose
    crc32(doc_id as text) mod held_out[0] is not held_out[1]; its only inputs are
    statistics of the text.  score is the chance of label 1; predicted is 1 if it
    is threshold or more.  Null texts count as empty and get the score of the
    empty text.  A doc_id with several labels has the greatest; labels other than
    0 and 1 and null ids teach nothing.  Without labels all scores are 0.5; rows
    with repeated or null ids each give a row; an empty table gives none.
    """
    rows = keyed(docs)
    out = remainder(F.col("doc_id"), held_out[0]) == held_out[1]
    shared = docs.sparkSession.sparkContext.broadcast(train(rows, labels, ~out))

    def score(batches):
        model = shared.value
        for rows in batches:
            for block in blocks(rows.column(2)):
                part = [rows.column(k).slice(block.first, block.rows) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*part, pa.array(model.score(statistics(block)))], names=["doc_id", "held_out", "score"])

    found = rows.select("doc_id", out.alias("held_out"), "text").mapInArrow(score, "doc_id long, held_out boolean, score double")
    return found.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
