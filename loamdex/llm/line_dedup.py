"""Line deduplication over a sharded minimal perfect hash.

Documents are dealt to blocks by a hash of their id, in one shuffle that the
first and the last step share.  A block sends each of its distinct line hashes
once, with the least and greatest doc_id that hold it, to
the shard that the hash belongs to; so a line that a third of all documents
share costs a row a block, not a row a document.  A shard builds a minimal
perfect hash over its distinct line hashes, which indexes compact arrays
(fingerprint, count, least and greatest doc_id); the blocks' hashes probe these
arrays, and the answers, repeated lines only, go back to the blocks that asked.
No line text is shuffled but inside its document, and no line is joined.

Keys are 128-bit hashes of normalised lines, of which the perfect hash takes
one half and the fingerprint check the other.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamdex.llm.common import fresh, input_bytes, small_batches, tasks
from loamdex.llm.textops import mix

MIN_CHARS = 10
#: Bytes of input files for a block at most (about), whatever the session's number of partitions.
BLOCK_INPUT = 64 << 20
#: Distinct lines that a task holds before it sends them on; the shards merge what comes twice.
HELD_LINES = 200_000
_BLANK = b" \t\n\x0b\x0c\r"


@dataclass
class PerfectHash:
    """A minimal perfect hash: level after level, keys alone in their bit are placed and the rest go on.

    bits[l] marks the placed bits of level l, ranks[l] counts those before each
    byte, bases[l] those of all levels before; slots run from 0 to the number of keys - 1.
    """

    bits: list[np.ndarray]
    sizes: list[int]
    ranks: list[np.ndarray]
    bases: list[int]

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 1.5) -> PerfectHash:
        """keys: distinct uint64."""
        out, base, left, level = cls([], [], [], []), 0, keys, 0
        while len(left):
            size = max(64, int(len(left) * gamma) // 64 * 64 + 64)
            at = cls._at(left, level, size)
            alone = np.bincount(at, minlength=size) == 1
            packed = np.packbits(alone)
            rank = np.zeros(len(packed) + 1, np.int64)
            np.cumsum(np.bitwise_count(packed), out=rank[1:])
            out.bits.append(packed)
            out.sizes.append(size)
            out.ranks.append(rank)
            out.bases.append(base)
            base += int(rank[-1])
            left, level = left[~alone[at]], level + 1
        return out

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for keys that no level has (others than those built on may get any slot)."""
        found, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (packed, size, rank, base) in enumerate(zip(self.bits, self.sizes, self.ranks, self.bases, strict=True)):
            at = self._at(keys[todo], level, size)
            byte, bit = at >> 3, (at & 7).astype(np.uint8)
            here = packed[byte]
            hit = (here >> (np.uint8(7) - bit)) & 1 == 1
            before = (here >> (np.uint8(8) - bit).clip(0, 7)) * (bit > 0)
            found[todo[hit]] = (base + rank[byte] + np.bitwise_count(before))[hit]
            todo = todo[~hit]
        return found


def _joint(keys: np.ndarray, prints: np.ndarray, salt: int) -> np.ndarray:
    return keys if salt == 0 else mix(keys ^ prints * np.uint64(2 * salt + 1))


@dataclass
class LineIndex:
    """A shard's arrays, by the slot of its perfect hash.  salt: the first under which no two lines share a 64-bit key."""

    salt: int
    hashes: PerfectHash
    fingerprints: np.ndarray
    counts: np.ndarray
    least: np.ndarray
    greatest: np.ndarray

    @classmethod
    def build(cls, keys: np.ndarray, prints: np.ndarray, least: np.ndarray, greatest: np.ndarray, counts: np.ndarray) -> LineIndex:
        salt = 0
        while True:
            joint = _joint(keys, prints, salt)
            distinct, first, inverse = np.unique(joint, return_index=True, return_inverse=True)
            if np.array_equal(prints[first][inverse], prints):
                break
            salt += 1
        size, hashes = len(distinct), PerfectHash.build(distinct)
        out = cls(salt, hashes, np.zeros(size, np.uint64), np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max), np.full(size, np.iinfo(np.int64).min))
        at = hashes.slots(distinct)[inverse]
        out.fingerprints[at] = prints
        np.add.at(out.counts, at, counts)
        np.minimum.at(out.least, at, least)
        np.maximum.at(out.greatest, at, greatest)
        return out

    def probe(self, keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each line is in two or more documents, and the least doc_id that holds it."""
        at = self.hashes.slots(_joint(keys, prints, self.salt))
        return (at >= 0) & (self.fingerprints[at] == prints) & (self.least[at] < self.greatest[at]), self.least[at]


def _keys(text: bytes, min_chars: int) -> list[int | None]:
    """The 128-bit hash of each line; None for lines that are too short.  Lower-casing the text first is the same, and faster."""
    digest, out = xxhash.xxh3_128_intdigest, []
    for line in text.lower().split(b"\n"):
        key = line.strip(_BLANK)
        n = len(key)
        out.append(None if n < min_chars or n < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars else digest(key))
    return out


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with repeated lines dropped: text is replaced, and n_lines (before) and n_dropped are added.

    Lines are split at \\n; a null or empty text is one empty line and stays as
    it is (null stays null).  A line's key is the line without ASCII blanks at
    both ends, A-Z lower-cased.  Keys of min_chars code points or more that two
    or more documents hold lose all their lines, repeats inside a document
    included, except in the document with the smallest doc_id; there all its
    lines stay.  Rows with the same doc_id are one document.  Rows with a null
    doc_id are left alone and do not count.  Columns named n_lines or n_dropped
    are replaced; other columns pass through.  An empty table gives no rows.

    Blocks and shards are twice spark.sql.shuffle.partitions in number, and more
    where that would make a block of over BLOCK_INPUT bytes of the input's files,
    so that one fits in a task's memory; see the module's docstring.
    """
    spark = docs.sparkSession
    small_batches(spark)
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    place = {c.lower(): i for i, c in enumerate(names)}
    at_id, at_text, count = place["doc_id"], place["text"], max(2 * tasks(spark), -(-input_bytes(docs) // BLOCK_INPUT))
    kinds = {"doc_id": "bigint", "text": "string"}
    columns = [F.col(f"`{c}`").cast(kinds[c.lower()]).alias(c) if c.lower() in kinds else F.col(f"`{c}`") for c in names]
    block = fresh(docs.columns, "line_block")
    # Rows without an id are dealt evenly, not as one key.
    key = F.coalesce(F.col(f"`{names[at_id]}`").cast("bigint"), F.monotonically_increasing_id())
    dealt = docs.select(*columns, F.pmod(F.xxhash64(key), F.lit(count)).cast("int").alias(block)).repartition(count, block)

    def asked(batches):
        schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("least", pa.int64()), ("greatest", pa.int64()), ("n", pa.int64())])

        def packed(held):
            halves = np.frombuffer(b"".join([key.to_bytes(16, "little") for _, key in held]), np.int64).reshape(-1, 2)
            numbers = np.array(list(held.values()), np.int64)
            shard = (mix(halves[:, 0].view(np.uint64)) % np.uint64(count)).astype(np.int32)
            part = np.fromiter((p for p, _ in held), np.int32, len(held))
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in (shard, part, *halves.T, *numbers.T)], schema=schema)

        held: dict[tuple[int, int], list[int]] = {}
        for rows in batches:
            ids, texts, parts = rows.column(at_id).to_pylist(), rows.column(at_text).cast(pa.binary()), rows.column(len(names)).to_pylist()
            for doc, text, part in zip(ids, texts, parts, strict=True):
                if doc is None or not text.is_valid:
                    continue
                for key in set(_keys(text.as_buffer().to_pybytes(), min_chars)):
                    if key is None:
                        continue
                    if (old := held.get((part, key))) is None:
                        held[part, key] = [doc, doc, 1]
                    else:
                        old[0], old[1], old[2] = min(old[0], doc), max(old[1], doc), old[2] + 1
                if len(held) >= HELD_LINES:
                    yield packed(held)
                    held = {}
        if held:
            yield packed(held)

    def answered(table: pa.Table) -> pa.Table:
        part, a, b, least, greatest, n = (table[c].to_numpy() for c in ("block", "a", "b", "least", "greatest", "n"))
        a, b = a.view(np.uint64), b.view(np.uint64)
        index = LineIndex.build(a, b, least, greatest, n)
        repeated, owner = index.probe(a, b)
        repeated &= greatest > owner
        rows = [part[repeated], a[repeated].view(np.int64), b[repeated].view(np.int64), owner[repeated]]
        if len(part):  # one answer for each line that a block asked for
            order = np.lexsort((rows[2], rows[1], rows[0]))
            rows = [x[order] for x in rows]
            new = np.ones(len(order), bool)
            new[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]) | (rows[2][1:] != rows[2][:-1])
            rows = [x[new] for x in rows]
        return pa.table({"block": rows[0], "a": rows[1], "b": rows[2], "owner": rows[3]})

    def rebuilt(left: pa.Table, right: pa.Table) -> pa.Table:
        lows, highs = right["a"].to_numpy().view(np.uint64).tolist(), right["b"].to_numpy().view(np.uint64).tolist()
        owner = {a | b << 64: o for a, b, o in zip(lows, highs, right["owner"].to_pylist(), strict=True)}
        texts, lines, dropped = [], [], []
        for doc, text in zip(left.column(at_id).to_pylist(), left.column(at_text).cast(pa.binary()).to_pylist(), strict=True):
            out, n = text, 0
            if text and doc is not None and owner:
                keys = _keys(text, min_chars)
                drop = [key is not None and owner.get(key, doc) < doc for key in keys]
                if n := sum(drop):
                    out = b"\n".join([line for line, gone in zip(text.split(b"\n"), drop, strict=True) if not gone])
            texts.append(out)
            lines.append(text.count(b"\n") + 1 if text else 1)
            dropped.append(n)
        out_columns = [left.column(i) for i in range(len(names))]
        out_columns[at_text] = pa.array(texts, pa.binary()).cast(pa.string())
        return pa.Table.from_arrays([*out_columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=[*names, "n_lines", "n_dropped"])

    probes = dealt.mapInArrow(asked, "shard int, block int, a long, b long, least long, greatest long, n long")
    answers = probes.groupBy("shard").applyInArrow(answered, "block int, a long, b long, owner long")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema if f.name != block)
    return dealt.groupBy(block).cogroup(answers.groupBy("block")).applyInArrow(rebuilt, schema + ", n_lines long, n_dropped long")


def deduplicated(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """line_dedup() with the columns of docs; n_chars, if there is such a column, follows the texts that changed."""
    own = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    out = line_dedup(docs.select(*(F.col(f"`{c}`") for c in own)), min_chars)
    size = F.when(F.col("n_dropped") > 0, F.length("text"))
    return out.select(*(F.coalesce(size, F.col(f"`{c}`")).cast(docs.schema[c].dataType).alias(c) if c.lower() == "n_chars" else F.col(f"`{c}`") for c in own))
