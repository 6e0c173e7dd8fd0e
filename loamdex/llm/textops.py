"""Vectorised byte-level text kernels shared by the operators of this subpackage.

Texts arrive as Arrow string arrays; their UTF-8 buffers are viewed as numpy
arrays, so that words, hashes and counts of a whole batch come from a few array
operations instead of a Python loop over words.  ASCII rules (A-Z lower-casing,
ASCII white space) are exact on UTF-8 bytes, since bytes of longer code points
are all 0x80 or higher.  Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that one array operation works on; a longer text is a block of its own.
BLOCK_BYTES = 1 << 18
#: Longer runs of bytes are hashed one by one.
LONG_RUN = 64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of `[^\x20\x09-\x0D]+`.
NOT_SPACE = ~IS_SPACE
#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` (digits, a-z and all beyond ASCII), after lower-casing.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


@dataclass
class Block:
    """Rows first..first+len(offsets)-2 of a batch: their bytes, end to end."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def text(self, row: int) -> bytes:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes()


def blocks(texts: pa.Array | pa.ChunkedArray, most: int = BLOCK_BYTES) -> Iterator[Block]:
    """The texts of an Arrow array in blocks of about `most` bytes, in order."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    if pa.types.is_null(texts.type):
        texts = texts.cast(pa.string())
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if len(texts) == 0:
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield Block(at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
        at = end


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of `inside`, none of which crosses a row."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    cuts = offsets[1:-1]
    before[cuts[cuts < len(inside)]] = False
    after[cuts[cuts > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


#: By a number of bytes, 0 to 8: the bits of so many little-endian bytes.
FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def chunks_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place of data on, as one little-endian integer; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def run_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of bytes; other seeds give independent hashes.

    Eight bytes at a time go through a bijective mix, so runs of up to 8 bytes
    and one length never share a hash, and no arithmetic structure of longer
    ones (as in a polynomial) makes them collide.
    """
    sizes, at8 = ends - starts, chunks_at(low)
    out = mix(sizes.astype(np.uint64) + np.uint64((2 * seed + 1) * 0xA24BAED4963EE407 % 2**64))
    todo = np.flatnonzero(sizes <= LONG_RUN)
    at, left = starts[todo], sizes[todo]
    while len(todo):
        chunk = at8[at] & FIRST_BYTES[np.minimum(left, 8)]
        out[todo] = mix((out[todo] ^ chunk) + np.uint64(0x9E3779B97F4A7C15))
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(sizes > LONG_RUN).tolist():
        out[i] = xxhash.xxh3_64_intdigest(low[starts[i] : ends[i]].tobytes(), seed)
    return out


@dataclass
class Words:
    """Words of a block; word i is low[starts[i]:ends[i]] and firsts[r]:firsts[r+1] are those of row r."""

    low: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    firsts: np.ndarray

    def other_hashes(self) -> np.ndarray:
        """Hashes of the words that are independent of `hashes`."""
        return run_hashes(self.low, self.starts, self.ends, 1)

    def key(self, i: int, n: int) -> bytes:
        """n words from word i on, joined by a blank."""
        return b" ".join(self.low[a:b].tobytes() for a, b in zip(self.starts[i : i + n].tolist(), self.ends[i : i + n].tolist(), strict=True))


def words(block: Block, kind: np.ndarray, hashed: bool = True) -> Words:
    """Lower-cased words made of the bytes of `kind`."""
    low = LOWER[block.data]
    starts, ends = runs(kind[low], block.offsets)
    hashes = run_hashes(low, starts, ends) if hashed else np.zeros(0, np.uint64)
    return Words(low, starts, ends, hashes, np.searchsorted(starts, block.offsets))


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive word hashes, by the index of the first."""
    count = max(0, len(hashes) - n + 1)
    out = np.full(count, np.uint64(n))
    for k in range(n):
        out = out * np.uint64(0x9FB21C651E98DF25) + hashes[k : k + count]
    return mix(out)


def owners(firsts: np.ndarray, count: int) -> np.ndarray:
    """The row of each of `count` items, where firsts[r] is the first item of row r."""
    marks = np.zeros(count + 1, np.int64)
    np.add.at(marks, firsts[1:-1], 1)
    return np.cumsum(marks[:count])
