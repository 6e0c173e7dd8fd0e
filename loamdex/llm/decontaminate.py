"""Benchmark decontamination: a broadcast hash set of benchmark n-grams, scanned along every document.

The benchmark's windows are hashed into a sorted array with a bitmap in front;
every window of every document is looked up by array operations, and each hit
is verified word by word against the benchmark's own words before it counts.
Documents are never shuffled.

A benchmark of more text than one broadcast may hold (its size is checked) has
its windows in a table instead, dealt by their hash.  Then a bitmap of fixed
size is broadcast, the documents' windows that it lets through are joined to
that table, words and all, and the hits go back to their rows.  Both ways give
the same results.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamdex.llm.common import fresh, keyed, small_batches, stored
from loamdex.llm.textops import ALNUM, Words, blocks, windows, words

WINDOW = 10
#: Benchmark text that one broadcast holds (its windows take about ten times as much).
BROADCAST_BYTES = 8 << 20
_BITS = 20
#: Bits of the bitmap in front of a table of windows, as a power of two; it goes through the driver in words of 64.
FILTER_BITS = 24


@dataclass
class WindowSet:
    """Windows of benchmark items: by length, sorted hashes with a bitmap; by words, the ids of the items that have them."""

    hashes: dict[int, tuple[np.ndarray, np.ndarray]]
    items: dict[bytes, frozenset]

    @classmethod
    def build(cls, rows: list[tuple[str | None, str | None]], n: int) -> WindowSet:
        """rows: (item_id as text, text).  Items of fewer than n words, but not none, are one window."""
        found, held = defaultdict(list), defaultdict(set)
        for block in blocks(pa.array([text for _, text in rows], pa.string())):
            of = words(block, ALNUM)
            for r in range(block.rows):
                a, b = int(of.firsts[r]), int(of.firsts[r + 1])
                if size := min(n, b - a):
                    found[size].append(windows(of.hashes[a:b], size))
                    for i in range(a, b - size + 1):
                        held[of.key(i, size)].add(rows[block.first + r][0])
        hashes = {}
        for size, parts in found.items():
            sorted_ = np.unique(np.concatenate(parts))
            bitmap = np.zeros(1 << _BITS, bool)
            bitmap[sorted_ >> np.uint64(64 - _BITS)] = True
            hashes[size] = sorted_, bitmap
        return cls(hashes, {k: frozenset(v) for k, v in held.items()})

    def scan(self, of: Words, rows: int) -> tuple[np.ndarray, dict[int, set]]:
        """Which words lie in an occurrence of a window, and by row the ids of the items with such windows."""
        cover, items = np.zeros(len(of.starts) + 1, np.int64), defaultdict(set)
        for size, (sorted_, bitmap) in self.hashes.items():
            seen = windows(of.hashes, size)
            at = np.flatnonzero(bitmap[seen >> np.uint64(64 - _BITS)])
            at = at[sorted_[np.minimum(np.searchsorted(sorted_, seen[at]), len(sorted_) - 1)] == seen[at]]
            row = np.searchsorted(of.firsts, at, side="right") - 1
            within = at + size <= of.firsts[row + 1]
            for i, r in zip(at[within].tolist(), row[within].tolist(), strict=True):
                ids = self.items.get(of.key(i, size))
                if ids is not None:
                    cover[i] += 1
                    cover[i + size] -= 1
                    items[r] |= ids
        return np.cumsum(cover[:-1]) > 0, items


def _spans(of: Words, hit: np.ndarray, a: int, b: int, base: int) -> list[tuple[int, int]]:
    """Byte spans of the runs of hit words among words a..b-1, from the row's first byte."""
    at = a + np.flatnonzero(hit[a:b])
    if not len(at):
        return []
    cuts = np.flatnonzero(np.diff(at) > 1)
    return [(int(of.starts[s]) - base, int(of.ends[e]) - base) for s, e in zip(at[[0, *(cuts + 1)]].tolist(), at[[*cuts, -1]].tolist(), strict=True)]


def _cut(text: str, of: Words, hit: np.ndarray) -> str:
    """text without the spans of hit words (a newline stands for each)."""
    raw, parts, at = text.encode(), [], 0
    for start, end in _spans(of, hit, 0, len(of.starts), 0):
        parts.append(raw[at:start])
        at = end
    return b"\n".join([*parts, raw[at:]]).decode()


def _words_of(text: str) -> Words:
    (block,) = blocks(pa.array([text], pa.string()), len(text.encode()) + 1)
    return words(block, ALNUM)


def without_windows(text: str, held: WindowSet) -> str:
    """text with all spans of hit words cut out (a newline stands for each), again until no window is left."""
    while text:
        of = _words_of(text)
        hit, _ = held.scan(of, 1)
        if not hit.any():
            break
        text = _cut(text, of, hit)
    return text


@dataclass
class WindowTable:
    """Windows of a large benchmark: rows (hash, key, items) by hash, the sizes that occur, and a bitmap of the hashes."""

    rows: DataFrame
    sizes: list[int]
    bitmap: np.ndarray

    @classmethod
    def build(cls, items: DataFrame, n: int) -> WindowTable:
        """items: (item, text)."""

        def cut(batches):
            for batch in batches:
                for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    of = _words_of(text or "")
                    if size := min(n, len(of.starts)):
                        keys = [of.key(i, size) for i in range(len(of.starts) - size + 1)]
                        hashes = windows(of.hashes, size).view(np.int64)
                        columns = [pa.array(hashes), pa.array(keys, pa.binary()), pa.array([size] * len(keys), pa.int32()), pa.array([item] * len(keys), pa.string())]
                        yield pa.RecordBatch.from_arrays(columns, names=["hash", "key", "size", "item"])

        found = stored(items.mapInArrow(cut, "hash long, key binary, size int, item string"), "windows")
        rows = stored(found.groupBy("hash", "key").agg(F.collect_set("item").alias("items")), "window_items")
        bit = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
        # 2^FILTER_BITS / 64 rows at most, whatever the benchmark's size.
        one = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.bitwiseAND(F.lit(63)).cast("int"))
        held = rows.groupBy(F.shiftright(bit, 6).cast("int").alias("at")).agg(F.bit_or(one).alias("bits")).toArrow()
        bitmap = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
        bitmap[held["at"].to_numpy()] = held["bits"].to_numpy().view(np.uint64)
        return cls(rows, sorted(r[0] for r in found.select("size").distinct().collect()), bitmap)

    def hits(self, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Of docs (row, text): rows (row, n_words), and (row, hits, items) of those with an occurrence; hits are word numbers."""
        shared, sizes = docs.sparkSession.sparkContext.broadcast(self.bitmap), self.sizes
        place = pa.struct([("hash", pa.int64()), ("key", pa.binary()), ("at", pa.int32()), ("size", pa.int32())])

        def scan(batches):
            held = shared.value
            for batch in batches:
                for block in blocks(batch.column(1)):
                    of = words(block, ALNUM)
                    some: list[list[dict]] = [[] for _ in range(block.rows)]
                    for size in sizes:
                        seen = windows(of.hashes, size)
                        bit = seen >> np.uint64(64 - FILTER_BITS)
                        at = np.flatnonzero(held[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1))
                        row = np.searchsorted(of.firsts, at, side="right") - 1
                        within = at + size <= of.firsts[row + 1]
                        signed = seen.view(np.int64)
                        for i, r in zip(at[within].tolist(), row[within].tolist(), strict=True):
                            some[r].append({"hash": int(signed[i]), "key": of.key(i, size), "at": i - int(of.firsts[r]), "size": size})
                    columns = [batch.column(0).slice(block.first, block.rows), pa.array(np.diff(of.firsts), pa.int64()), pa.array(some, pa.list_(place))]
                    yield pa.RecordBatch.from_arrays(columns, names=["row", "n_words", "places"])

        kind = "row long, n_words long, places array<struct<hash:long,key:binary,at:int,size:int>>"
        scanned = stored(docs.select("row", "text").mapInArrow(scan, kind), "scanned")
        places = scanned.select("row", F.explode("places").alias("p")).select("row", "p.*")
        last = F.col("at") + F.col("size") - 1
        met = places.join(self.rows, ["hash", "key"]).select("row", F.sequence("at", last).alias("hits"), "items")
        union = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
        return scanned.select("row", "n_words"), met.groupBy("row").agg(union("hits"), union("items"))


def _windows_of(benchmark: DataFrame, n: int) -> WindowSet | WindowTable:
    """A set to broadcast, if the benchmark's texts are small enough for it; else a table."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + F.lit(16))).first()[0] or 0
    if size > BROADCAST_BYTES:
        return WindowTable.build(rows, n)
    return WindowSet.build([tuple(r) for r in rows.collect()], n)


def _scanned(docs: DataFrame, held: WindowSet) -> DataFrame:
    """doc_id, n_words, hits (word numbers in an occurrence) and items of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(held)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("hits", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])

    def scan(batches):
        held = shared.value
        for batch in batches:
            for block in blocks(batch.column(1)):
                of = words(block, ALNUM)
                hit, items = held.scan(of, block.rows)
                sizes = np.diff(of.firsts)
                hits = [(np.flatnonzero(hit[of.firsts[r] : of.firsts[r + 1]]) if r in items else []) for r in range(block.rows)]
                named = [[x for x in items.get(r, ()) if x is not None] for r in range(block.rows)]
                columns = [batch.column(0).slice(block.first, block.rows), pa.array(sizes, pa.int64()), pa.array(hits, pa.list_(pa.int64())), pa.array(named, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return keyed(docs).mapInArrow(scan, "doc_id long, n_words long, hits array<long>, items array<string>")


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each document.

    Words are runs of 0-9, a-z (A-Z lower-cased) and all code points beyond
    ASCII.  A window is n consecutive words of an item, or the whole of an item
    with fewer, but not none.  n_hit counts the document's words inside any
    occurrence of any window, n_items the items that have such a window;
    items_sha256 is the SHA-256 of their ids, sorted as strings and joined by
    commas.  Null or empty texts have no words and no hits; items without words
    have no windows; items that share an id are one item; the windows of items
    with a null id count for hits, but name no item.  Each row of docs gives a
    row, also where ids repeat or are null.  Empty tables: no rows, or no hits.
    """
    held = _windows_of(benchmark, n)
    if isinstance(held, WindowSet):
        found = _scanned(docs, held)
    else:
        numbered = stored(keyed(docs).withColumn("row", F.monotonically_increasing_id()), "rows")
        sizes, hits = held.hits(numbered)
        found = numbered.select("row", "doc_id").join(sizes, "row").join(hits, "row", "left")
        none = F.array()
        found = found.select("doc_id", "n_words", F.coalesce("hits", none.cast("array<int>")).alias("hits"), F.coalesce("items", none.cast("array<string>")).alias("items"))
    digest = F.sha2(F.array_join(F.sort_array("items"), ",").cast("binary"), 256)
    size = lambda c: F.size(c).cast("long")
    return found.select("doc_id", "n_words", size("hits").alias("n_hit"), size("items").alias("n_items"), digest.alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, remove: str = "spans") -> DataFrame:
    """docs without the benchmark's windows; same columns, other columns pass through.

    remove="spans" cuts the hit words, first to last of each run, and puts a
    newline in their place, again until no window occurs; a document of which no
    word is left goes.  remove="documents" drops each contaminated document.
    n_chars, if there is such a column, follows the text.  Documents without
    hits, null texts included, stay as they are.
    """
    if remove not in ("spans", "documents"):
        raise ValueError("remove is 'spans' or 'documents'")
    small_batches(docs.sparkSession)
    held, flag = _windows_of(benchmark, n), fresh(docs.columns, "text_was_cut")
    out = (_cut_by_set if isinstance(held, WindowSet) else _cut_by_table)(docs, held, remove, flag)
    for c in docs.columns:
        if c.lower() == "n_chars":
            out = out.withColumn(c, F.when(F.col(flag), F.length("text").cast(docs.schema[c].dataType)).otherwise(F.col(c)))
    text_left = ~F.col(flag) | F.col("text").rlike(r"[0-9A-Za-z]|[^\x00-\x7F]")
    return out.where(text_left).drop(flag)


def _cut_by_set(docs: DataFrame, held: WindowSet, remove: str, flag: str) -> DataFrame:
    """docs with a flag on the texts that were cut, in one scan."""
    shared = docs.sparkSession.sparkContext.broadcast(held)
    at = [c.lower() for c in docs.columns].index("text")

    def cut(batches):
        held = shared.value
        for batch in batches:
            texts, keep, changed = batch.column(at), np.ones(batch.num_rows, bool), {}
            for block in blocks(texts):
                of = words(block, ALNUM)
                _, items = held.scan(of, block.rows)
                for r in items:
                    if remove == "documents":
                        keep[block.first + r] = False
                    else:
                        changed[block.first + r] = without_windows(block.text(r).decode(), held)
            if changed:
                texts = pa.array([changed.get(i, x) for i, x in enumerate(texts.to_pylist())], texts.type)
            flags = pa.array([i in changed for i in range(batch.num_rows)])
            columns = [texts if i == at else c for i, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays([*columns, flags], names=batch.schema.names).filter(pa.array(keep))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.withColumn(flag, F.lit(False)).mapInArrow(cut, f"{schema}, `{flag}` boolean")


def _cut_by_table(docs: DataFrame, held: WindowTable, remove: str, flag: str) -> DataFrame:
    """The same by joins with the table; texts that were cut are scanned again, until none has a window."""
    row, (text,) = fresh(docs.columns, "row_number"), [c for c in docs.columns if c.lower() == "text"]
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    texts, changes = numbered.select(F.col(row).alias("row"), F.col(f"`{text}`").alias("text")), []

    def cut(batches):
        for batch in batches:
            out = []
            for text, hits in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                of = _words_of(text)
                hit = np.zeros(len(of.starts), bool)
                hit[hits] = True
                out.append(_cut(text, of, hit))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["row", "text"])

    while True:
        found = texts.join(held.hits(texts)[1], "row").select("row", "text", "hits")
        if remove == "documents":
            return numbered.join(found.select(F.col("row").alias(row)), row, "left_anti").drop(row).withColumn(flag, F.lit(False))
        texts = stored(found.mapInArrow(cut, "row long, text string"), "cut")
        if texts.limit(1).count() == 0:
            break
        changes.append(texts.withColumn("turn", F.lit(len(changes))))
    if not changes:
        return numbered.drop(row).withColumn(flag, F.lit(False))
    latest = reduce(DataFrame.unionByName, changes).groupBy("row").agg(F.max_by("text", "turn").alias(flag))
    joined = numbered.join(latest.withColumnRenamed("row", row), row, "left")
    own = [F.coalesce(F.col(flag), F.col(f"`{c}`")).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*own, F.col(flag).isNotNull().alias(flag))
