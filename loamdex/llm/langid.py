"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams by language in a distributed aggregate; the matrix of
log-probabilities (languages x buckets) is broadcast, and a batch of texts is
scored by numpy: each n-gram's bucket adds its column to its document's sums.
Texts are lower-cased; letters stay, each run of anything else is one blank.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamdex.llm.common import fresh, keyed, remainder, small_batches, stored
from loamdex.llm.textops import BLOCK_BYTES, blocks, mix

UNKNOWN = "und"
#: Parameters of the model: n-gram lengths, buckets, and labelled documents used for each language (about; all, if fewer).
ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
SAMPLE_PER_LANG = 4000
_SMOOTHING = 0.5
#: Whether a text is like its language's: labelled documents of each language that show what is usual (about; at least, or the language takes any text), and deviations below their mean that are too many.
USUAL_DOCS, LEAST_DOCS = 1000, 30
DEVIATIONS = 16.0
#: Languages of one matrix (BUCKETS x languages, 8 bytes each), which is broadcast; texts are scored against more languages matrix by matrix.
MATRIX_LANGUAGES = 500


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """By code point: the lower-case letter's code point, or 0 for what is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if (x := chr(c)).isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def gram_buckets(data: np.ndarray, offsets: np.ndarray, orders: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, row) of every n-gram with a letter of a block of texts, and the number of letters of each row."""
    rows = len(offsets) - 1
    # A code point starts at each byte that is no continuation byte; rows are cut at those.
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    row = np.searchsorted(offsets, starts, side="right") - 1
    code = _letters()[points]
    letters = np.bincount(row[code > 0], minlength=rows)
    before = np.zeros(len(code), np.uint32)
    before[1:] = code[:-1]
    new = np.ones(len(code), bool)
    new[1:] = row[1:] != row[:-1]
    keep = (code > 0) | ((before > 0) & ~new)
    code, row = code[keep], row[keep]
    out, at = [], []
    for n in orders:
        count = max(0, len(code) - n + 1)
        h, some = np.full(count, np.uint64(n)), np.zeros(count, bool)
        for k in range(n):
            part = code[k : k + count]
            h = h * np.uint64(0x9FB21C651E98DF25) + part
            some |= part > 0
        some &= row[:count] == row[n - 1 : n - 1 + count]
        out.append((mix(h[some]) >> np.uint64(40)).astype(np.int64) & (buckets - 1))
        at.append(row[:count][some])
    return np.concatenate(out), np.concatenate(at), letters


@dataclass
class LanguageModel:
    """languages in order, their log priors, and log-probabilities (buckets x languages)."""

    languages: list[str]
    priors: np.ndarray
    weights: np.ndarray
    orders: tuple[int, ...] = ORDERS
    #: The smoothed n-gram count of each language; None for a model without languages.
    totals: np.ndarray | None = None

    def sums(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Summed log-probabilities of each row's n-grams (rows x languages), its letters, and its n-grams."""
        bucket, row, letters = gram_buckets(data, offsets, self.orders, len(self.weights))
        rows = len(offsets) - 1
        # The rows' counts are a sparse matrix; its product with the weights, language by language.
        return np.stack([np.bincount(row, weights=self.weights[:, k][bucket], minlength=rows) for k in range(len(self.languages))], axis=1), letters, np.bincount(row, minlength=rows)


def _pieces(data: np.ndarray, most: int):
    """Parts of a long text, cut at code points."""
    at = 0
    while at < len(data):
        end = min(len(data), at + most)
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        yield data[at:end]
        at = end


def _sample(labelled: DataFrame, counts: dict[str, int], most: int) -> DataFrame:
    """lang and text of about `most` labelled documents of each language (all, if fewer), by a hash of the id; a smaller sample is part of a larger one."""
    shares = labelled.sparkSession.createDataFrame([(k, min(1.0, most / n)) for k, n in counts.items()], "lang string, share double")
    picked = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit(10)), F.lit(1 << 20)) < F.col("share") * (1 << 20)
    return labelled.join(F.broadcast(shares), "lang").where(picked).select("lang", "text")


def _labelled(docs: DataFrame, usable: Column | None) -> DataFrame:
    return docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.lit(True) if usable is None else usable))


def train(docs: DataFrame, usable: Column | None = None, orders: tuple[int, ...] = ORDERS, buckets: int = BUCKETS, sample_per_lang: int = SAMPLE_PER_LANG) -> Iterator[LanguageModel]:
    """Models of docs (doc_id, text, lang) where usable holds and lang is not null: of all languages in order, MATRIX_LANGUAGES at most in each.

    Priors come from all labelled rows; n-gram counts from about
    sample_per_lang whole texts of each language, chosen by a hash of the id.
    A model comes to the driver when it is asked for, as one array a language.
    """
    labelled = _labelled(docs, usable)
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages, total = sorted(counts), sum(counts.values())

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for rows in batches:
            langs = rows.column(0).to_pylist()
            for block in blocks(rows.column(1)):
                bucket, row, _ = gram_buckets(block.data, block.offsets, orders, buckets)
                names = langs[block.first : block.first + block.rows]
                for lang in set(names):
                    own = np.array([x == lang for x in names])
                    found = np.bincount(bucket[own[row]], minlength=buckets)
                    held[lang] = held[lang] + found if lang in held else found
        for lang, found in held.items():
            some = np.flatnonzero(found)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(some), pa.string()), "bucket": pa.array(some, pa.int32()), "n": pa.array(found[some], pa.int64())})

    def laid_out(part: pa.Table) -> pa.Table:
        found = np.zeros(buckets, np.int64)
        found[part["bucket"].to_numpy()] = part["n"].to_numpy()
        return pa.table({"lang": part["lang"][:1], "counts": pa.array([found.tobytes()], pa.binary())})

    for at in range(0, len(languages), MATRIX_LANGUAGES):
        own = {k: counts[k] for k in languages[at : at + MATRIX_LANGUAGES]}
        sample = _sample(labelled, own, sample_per_lang)
        grams = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
        # A language has a row a bucket at most, so its array is made in one task.
        rows = grams.groupBy("lang").applyInArrow(laid_out, "lang string, counts binary").collect()
        held = np.full((buckets, len(own)), _SMOOTHING)
        place = {k: i for i, k in enumerate(own)}
        for r in rows:
            held[:, place[r.lang]] += np.frombuffer(r.counts, np.int64)
        priors = np.log(np.array(list(own.values()), float) / total)
        yield LanguageModel(list(own), priors, np.log(held / held.sum(axis=0)), orders, held.sum(axis=0))


@dataclass
class Usual:
    """By language: the mean of documents' mean log-probabilities of an n-gram, their variance, and that of n-grams in a document."""

    mean: np.ndarray
    between: np.ndarray
    within: np.ndarray

    def least(self, lang: np.ndarray, grams: np.ndarray, deviations: float, orders: int) -> np.ndarray:
        """The least mean log-probability that a text of so many n-grams may have; a position's n-grams (one of each order) go together."""
        return self.mean[lang] - deviations * np.sqrt(self.between[lang] + orders * self.within[lang] / np.maximum(1, grams))


def usual(docs: DataFrame, model: LanguageModel, usable: Column | None = None, sample_per_lang: int = SAMPLE_PER_LANG) -> Usual:
    """What the model gives labelled documents of each of its languages that it has learned from, each without its own counts.

    docs, usable and sample_per_lang are those of train().  A language of fewer
    than LEAST_DOCS such documents takes any text (its mean is minus infinity).
    """
    labelled = _labelled(docs, usable).where(F.col("lang").isin(model.languages))
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        model = shared.value
        place, size = {k: i for i, k in enumerate(model.languages)}, len(model.weights)
        for rows in batches:
            langs = rows.column(0).to_pylist()
            for block in blocks(rows.column(1)):
                bucket, row, _ = gram_buckets(block.data, block.offsets, model.orders, size)
                lang = np.array([place[x] for x in langs[block.first : block.first + block.rows]])
                pair, n = np.unique(row * size + bucket, return_counts=True)
                row, bucket = pair // size, pair % size
                grams = np.bincount(row, weights=n, minlength=block.rows)
                left = np.exp(model.weights[bucket, lang[row]]) * model.totals[lang[row]] - n
                p = np.log(np.maximum(left, _SMOOTHING)) - np.log(model.totals[lang] - grams)[row]
                some = np.flatnonzero(grams)
                mean = np.bincount(row, weights=n * p, minlength=block.rows)[some] / grams[some]
                square = np.bincount(row, weights=n * p * p, minlength=block.rows)[some] / grams[some]
                yield pa.RecordBatch.from_pydict({"lang": pa.array(lang[some], pa.int64()), "mean": pa.array(mean, pa.float64()), "within": pa.array(square - mean**2, pa.float64())})

    judged = _sample(labelled, counts, min(USUAL_DOCS, sample_per_lang)).mapInArrow(judge, "lang long, mean double, within double")
    found = judged.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg("mean").alias("mean"), F.var_pop("mean").alias("between"), F.avg("within").alias("within")).collect()
    k = len(model.languages)
    out = Usual(np.full(k, -np.inf), np.zeros(k), np.zeros(k))
    for r in found:
        if r.n >= LEAST_DOCS:
            out.mean[r.lang], out.between[r.lang], out.within[r.lang] = r.mean, r.between, max(0.0, r.within)
    return out


#: What a text's languages have shown so far: the best, its sum with the prior, the logarithm of all sums' total, and whether the text is like the best one's.
_SO_FAR = (("best", "string"), ("top", "double"), ("all", "double"), ("like", "boolean"))


def predict(docs: DataFrame, models: Iterable[tuple[LanguageModel, Usual | None]], lang_name: str = "lang_pred", score_name: str = "score", deviations: float = DEVIATIONS) -> DataFrame:
    """docs with the predicted language and its posterior probability among the languages of all models.

    Null texts, and texts without a letter, get `und` and score 0; so does
    every text if no language was learned.  Long texts are scored whole, part by
    part.  Where a model comes with what is usual, texts whose mean
    log-probability of an n-gram is more than `deviations` below that of the
    predicted language get `und` and score 0, too.  Ties go to the language that
    sorts first.  Columns of the two names are replaced, all others pass
    through; an empty table gives no rows.  With several models the table is
    written after each, so that one matrix is held at a time.
    """
    spark = docs.sparkSession
    small_batches(spark)
    names = [c for c in docs.columns if c.lower() not in (lang_name.lower(), score_name.lower())]
    at = [c.lower() for c in names].index("text")
    out, last = docs.select(*(F.col(f"`{c}`") for c in names)), []
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names)
    for c, kind in _SO_FAR:
        last.append(fresh([*names, *last], c))
        kinds += f", `{last[-1]}` {kind}"
        out = out.withColumn(last[-1], F.lit(None).cast(kind))

    def against(model: LanguageModel, like: Usual | None):
        shared = spark.sparkContext.broadcast((model, like))

        def score(batches):
            model, like = shared.value
            for rows in batches:
                best, top, total, fits = ([] for _ in _SO_FAR)
                for block in blocks(rows.column(at)):
                    if block.rows == 1 and len(block.data) > BLOCK_BYTES:
                        sums, letters, grams = np.zeros((1, len(model.languages))), np.zeros(1, np.int64), np.zeros(1, np.int64)
                        for part in _pieces(block.data, BLOCK_BYTES):
                            more, some, count = model.sums(part, np.array([0, len(part)]))
                            sums, letters, grams = sums + more, letters + some, grams + count
                    else:
                        sums, letters, grams = model.sums(block.data, block.offsets)
                    plain, sums = sums, sums + model.priors
                    first = sums.argmax(axis=1)
                    most = sums.max(axis=1)
                    good = np.ones(len(first), bool)
                    if like is not None:
                        good = plain[np.arange(len(first)), first] >= grams * like.least(first, grams, deviations, len(model.orders))
                    best += [model.languages[b] if k else None for b, k in zip(first.tolist(), (letters > 0).tolist(), strict=True)]
                    top += most.tolist()
                    total += (most + np.log(np.exp(sums - most[:, None]).sum(axis=1))).tolist()
                    fits += good.tolist()
                old_best, old_top, old_all, old_fits = (rows.column(len(names) + i) for i in range(4))
                if len(best) and old_best.null_count < len(best):
                    was = np.array(old_top.fill_null(-np.inf).to_pylist())
                    keep = was >= np.array(top)  # the earlier language sorts first
                    best = [o if k else b for o, b, k in zip(old_best.to_pylist(), best, keep.tolist(), strict=True)]
                    fits = [o if k else f for o, f, k in zip(old_fits.to_pylist(), fits, keep.tolist(), strict=True)]
                    total = np.logaddexp(old_all.fill_null(-np.inf).to_numpy(zero_copy_only=False), total).tolist()
                    top = np.maximum(was, top).tolist()
                columns = [pa.array(best, pa.string()), pa.array(top, pa.float64()), pa.array(total, pa.float64()), pa.array(fits, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(names)], *columns], names=[*names, *last])

        return score

    for i, (model, like) in enumerate(models):
        out = (stored(out, "scored") if i else out).mapInArrow(against(model, like), kinds)
    best, top, total, fits = (F.col(f"`{c}`") for c in last)
    known = best.isNotNull() & F.coalesce(fits, F.lit(False))
    guess = F.when(known, best).otherwise(UNKNOWN).alias(lang_name)
    return out.select(*(F.col(f"`{c}`") for c in names), guess, F.when(known, F.least(F.exp(top - total), F.lit(1.0))).otherwise(0.0).alias(score_name))


def language_id(docs: DataFrame, held_out: tuple[int, int] = (3, 1)) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document, by a model of the labelled documents that are not held out.

    held_out = (m, r) holds out documents whose crc32(doc_id as text) mod m is r; a null id counts as the empty text.
    """
    rows = keyed(docs, "lang")
    out = remainder(F.col("doc_id"), held_out[0]) == held_out[1]
    models = ((model, None) for model in train(rows, ~out))
    return predict(rows.select("doc_id", out.alias("held_out"), "text"), models).drop("text")


def known_language(docs: DataFrame, held_out: tuple[int, int] = (3, 1), deviations: float = DEVIATIONS) -> DataFrame:
    """docs without those whose language is `und`, or which are unlike the labelled documents of their language; same columns.

    What no learned language is likely for, such as gibberish, goes by the mean
    log-probability of its n-grams, which is more than `deviations` below what
    labelled documents show.  If no language was learned, all documents stay.
    """
    lang, score = fresh(docs.columns, "lang_pred"), fresh(docs.columns, "lang_score")
    rows, learned = keyed(docs, "lang"), remainder(F.col("doc_id"), held_out[0]) != held_out[1]
    if _labelled(rows, learned).limit(1).count() == 0:
        return docs
    models = ((model, usual(rows, model, learned)) for model in train(rows, learned))
    found = predict(docs, models, lang, score, deviations)
    return found.where(F.col(lang) != UNKNOWN).select(*(F.col(f"`{c}`") for c in docs.columns))
