"""Token counts by a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton, held in flat arrays, enumerates the vocabulary
matches that end at each character, longest first; dynamic programming carries
the best score and the number of pieces, and keeps no path.  All words of a
block step through the automaton together, as rows of arrays, and words that
repeat are counted once: no piece holds a blank after anything else, so texts
fall apart at blanks without any loss.

Tie rules are those of the tokenizer: a later candidate replaces an earlier one
only if its score is strictly higher, and candidates come by ascending start,
the unknown character last.
"""

from __future__ import annotations

import os
import struct
from collections import deque
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loamdex.llm.common import keyed
from loamdex.llm.textops import FIRST_BYTES, blocks, chunks_at, mix

_MARK = "▁"
_MARK_BYTES = _MARK.encode()
#: What an unknown character scores below the least score of the vocabulary.
UNKNOWN_PENALTY = 10.0
#: Words whose counts a task keeps, and characters that one step of the search holds.
CACHE_SLOTS = 1 << 19
#: Bytes of a word, blank included, whose count may be kept.
SHORT_WORD = 32
STEP_CHARS = 1 << 21


def _fields(raw: bytes):
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            yield tag >> 3, raw[at : at + size]
            at += size
        else:
            size = 8 if kind == 1 else 4
            yield tag >> 3, raw[at : at + size]
            at += size


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with their scores, and what the tokenizer does around them."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    byte_fallback: bool
    dummy_prefix: bool

    @classmethod
    def read(cls, raw: bytes) -> Vocabulary:
        """Of a model file: pieces (1) of text, score and type, trainer (2) and normaliser (3) settings."""
        pieces, scores, fallback, prefix, extra, charsmap = [], [], False, True, True, b""
        for number, value in _fields(raw):
            if number == 1:
                parts = dict(_fields(value))
                if parts.get(3, 1) == 1:
                    pieces.append(parts[1].decode())
                    scores.append(struct.unpack("<f", parts.get(2, b"\0\0\0\0"))[0])
                elif parts.get(3) == 4:
                    raise ValueError("user-defined pieces are not supported")
            elif number == 2:
                fallback = bool(dict(_fields(value)).get(35, 0))
            elif number == 3:
                parts = dict(_fields(value))
                prefix, extra, charsmap = bool(parts.get(3, 1)), bool(parts.get(4, 1)), parts.get(2, b"")
        if charsmap or extra:
            raise ValueError("normalisers that change texts are not supported")
        return cls(tuple(pieces), tuple(scores), fallback, prefix)


class Automaton:
    """Aho-Corasick over code points, in arrays: edges in a hash table, failure links, and links to the next shorter piece."""

    def __init__(self, vocabulary: Vocabulary):
        children: list[dict[int, int]] = [{}]
        piece: list[int] = [-1]
        for i, text in enumerate(vocabulary.pieces):
            at = 0
            for c in text:
                if (to := children[at].get(ord(c))) is None:
                    to = children[at][ord(c)] = len(children)
                    children.append({})
                    piece.append(-1)
                at = to
            if at and piece[at] < 0:
                piece[at] = i
        count = len(children)
        fail, link = np.zeros(count, np.int32), np.zeros(count, np.int32)
        queue = deque((to, 0, c) for c, to in children[0].items())
        while queue:
            at, parent, c = queue.popleft()
            back = int(fail[parent])
            while parent and back and c not in children[back]:
                back = int(fail[back])
            fail[at] = children[back].get(c, 0) if parent else 0
            link[at] = fail[at] if piece[fail[at]] >= 0 else link[fail[at]]
            queue.extend((to, at, c2) for c2, to in children[at].items())
        self.fail, self.link = fail, link
        self.piece = np.array(piece, np.int32)
        scores = np.array([*vocabulary.scores, 0.0])
        self.score = scores[self.piece]
        self.size = np.array([*(len(p) for p in vocabulary.pieces), 0], np.int32)[self.piece]
        self.unknown = float(scores[:-1].min()) - UNKNOWN_PENALTY if vocabulary.pieces else -UNKNOWN_PENALTY
        self.fallback = vocabulary.byte_fallback
        singles = [ord(p) for p in vocabulary.pieces if len(p) == 1]
        self.known = np.zeros(0x110000, bool)
        self.known[singles] = True
        #: Whether texts may be cut before blanks.
        self.cuts = not any(a != _MARK and b == _MARK for p in vocabulary.pieces for a, b in zip(p, p[1:], strict=False))
        keys = np.array([at << 21 | c for at, to in enumerate(children) for c in to], np.int64)
        values = np.array([v for to in children for v in to.values()], np.int32)
        self.mask = (1 << max(4, int(len(keys) * 6).bit_length())) - 1
        self.keys, self.values = np.full(self.mask + 1, -1, np.int64), np.zeros(self.mask + 1, np.int32)
        slot, todo = mix(keys.view(np.uint64)).astype(np.int64) & self.mask, np.arange(len(keys))
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = todo[self.keys[slot[todo]] == -1]
            self.keys[slot[free]], self.values[slot[free]] = keys[free], values[free]  # of several, the last stays
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _edge(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        key = state.astype(np.int64) << 21 | char
        slot = mix(key.view(np.uint64)).astype(np.int64) & self.mask
        out, todo = np.full(len(key), -1, np.int32), np.arange(len(key))
        for _ in range(self.probes):
            held = self.keys[slot[todo]]
            hit = held == key[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (held != -1)]
            if not len(todo):
                break
            slot[todo] = (slot[todo] + 1) & self.mask
        return out

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        out = self._edge(state, char)
        todo = np.flatnonzero(out < 0)
        at = state[todo]
        while len(todo):
            root = at == 0
            out[todo[root]] = 0
            todo, at = todo[~root], self.fail[at[~root]]
            found = self._edge(at, char[todo])
            out[todo] = found
            left = found < 0
            todo, at = todo[left], at[left]
        return out

    def counts(self, texts: list[str]) -> np.ndarray:
        """The number of pieces of the best segmentation of each text (blanks as marks, prefix included)."""
        order = np.array(sorted(range(len(texts)), key=lambda i: -len(texts[i])), np.int64)
        out = np.zeros(len(texts), np.int64)
        at = 0
        while at < len(order):
            size = len(texts[order[at]])
            rows = order[at : at + max(1, STEP_CHARS // (size + 1))]
            out[rows] = self._group([texts[i] for i in rows.tolist()], size)
            at += len(rows)
        return out

    def _group(self, texts: list[str], size: int) -> np.ndarray:
        """texts: longest first; size: of the longest."""
        sizes = np.array([len(t) for t in texts])
        codes = np.zeros((size, len(texts)), np.int64)
        flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        row = np.repeat(np.arange(len(texts)), sizes)
        codes[np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes), row] = flat
        best, pieces = np.zeros((size + 1, len(texts))), np.zeros((size + 1, len(texts)), np.int32)
        last_unknown = np.zeros((size + 1, len(texts)), bool)
        state = np.zeros(len(texts), np.int32)
        for t in range(size):
            n = int(np.searchsorted(-sizes, -t, side="left"))  # rows longer than t
            char = codes[t, :n]
            state = self.step(state[:n], char)
            top, count, unknown = np.full(n, -np.inf), np.zeros(n, np.int32), np.zeros(n, bool)
            at = np.where(self.piece[state] >= 0, state, self.link[state])
            live = np.flatnonzero(at)
            at = at[live]
            while len(live):
                begin = t + 1 - self.size[at]
                total = best[begin, live] + self.score[at]
                better = total > top[live]
                won = live[better]
                top[won], count[won] = total[better], pieces[begin[better], won] + 1
                at = self.link[at]
                more = at > 0
                live, at = live[more], at[more]
            strange = np.flatnonzero(~self.known[char])
            if len(strange):
                total = best[t, strange] + self.unknown
                won = strange[total > top[strange]]
                top[won] = best[t, won] + self.unknown
                if self.fallback:
                    c = char[won]
                    count[won] = pieces[t, won] + 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
                else:  # a run of unknown characters is one piece
                    count[won] = pieces[t, won] + ~last_unknown[t, won]
                unknown[won] = True
            best[t + 1, :n], pieces[t + 1, :n], last_unknown[t + 1, :n] = top, count, unknown
        return pieces[sizes, np.arange(len(texts))]


class Counter:
    """Counts tokens of batches; keeps the counts of short words, with the words themselves, in a table of fixed size."""

    def __init__(self, vocabulary: Vocabulary):
        self.automaton, self.prefix = Automaton(vocabulary), vocabulary.dummy_prefix
        # Runs of unknown characters that meet across a cut would be one piece, so without byte fallback the blank must be a known piece.
        self.cuts = self.automaton.cuts and (vocabulary.byte_fallback or bool(self.automaton.known[ord(_MARK)]))
        #: By slot: the word's hash, its bytes with size and place, and its count.
        self.keys, self.values = np.zeros(CACHE_SLOTS, np.uint64), np.zeros(CACHE_SLOTS, np.int64)
        self.held = np.zeros((CACHE_SLOTS, SHORT_WORD // 8 + 1), np.uint64)

    def __call__(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        for block in blocks(texts):
            data, offsets = block.data, block.offsets
            if _MARK_BYTES in data.tobytes():  # the same as a blank
                marked = pa.array([block.text(r).decode().replace(_MARK, " ") for r in range(block.rows)], pa.string())
                (block2,) = blocks(marked, len(data) + 1)
                data, offsets = block2.data, block2.offsets
            if not len(data):
                continue
            blank = data == 0x20
            cut = np.zeros(len(data) + 1, bool)
            if self.cuts:
                cut[1:-1] = blank[1:] & ~blank[:-1]
            begins = offsets[:-1][np.diff(offsets) > 0]
            cut[begins] = True
            starts = np.flatnonzero(cut[:-1])
            ends = np.append(starts[1:], len(data))
            first = np.zeros(len(data) + 1, bool)
            first[begins] = self.prefix
            counts = self._counts(data, starts, ends, first[starts])
            row = np.searchsorted(offsets, starts, side="right") - 1
            out[block.first : block.first + block.rows] = np.bincount(row, weights=counts, minlength=block.rows).astype(np.int64)
        return out

    def _counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The count of each word.  Words are the same if their bytes are; hashes only lead to them."""
        spelled = lambda i: (_MARK if first[i] else "") + data[starts[i] : ends[i]].tobytes().decode().replace(" ", _MARK)
        out, alone = np.zeros(len(starts), np.int64), np.flatnonzero(ends - starts > SHORT_WORD)
        short = np.flatnonzero(ends - starts <= SHORT_WORD)
        own = self._bytes(data, starts[short], ends[short], first[short])
        hashes = np.full(len(short), np.uint64(1))
        for k in range(own.shape[1]):
            hashes = mix((hashes ^ own[:, k]) + np.uint64(0x9E3779B97F4A7C15))
        unique, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        slot = (unique & np.uint64(CACHE_SLOTS - 1)).astype(np.int64)
        known = (self.keys[slot] == unique) & (self.held[slot] == own[where]).all(axis=1)
        found, new = np.where(known, self.values[slot], -1), np.flatnonzero(~known)
        found[new] = self.automaton.counts([spelled(i) for i in short[where[new]].tolist()])
        # Of several new words in a slot one stays, with its own bytes and count.
        kept = new[np.unique(slot[new], return_index=True)[1]]
        self.keys[slot[kept]], self.held[slot[kept]], self.values[slot[kept]] = unique[kept], own[where[kept]], found[kept]
        out[short] = found[inverse]
        # Long words, and short ones that share a hash with another, are told apart by their spelling.
        alone = np.concatenate([alone, short[(own != own[where][inverse]).any(axis=1)]])
        if len(alone):
            words = [spelled(i) for i in alone.tolist()]
            distinct = list(dict.fromkeys(words))
            of = dict(zip(distinct, self.automaton.counts(distinct).tolist(), strict=True))
            out[alone] = [of[w] for w in words]
        return out

    @staticmethod
    def _bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Words of SHORT_WORD bytes at most as integers: their bytes, eight a column, then size and whether they come first."""
        at8, size = chunks_at(data), ends - starts
        out = np.zeros((len(starts), SHORT_WORD // 8 + 1), np.uint64)
        for k in range(SHORT_WORD // 8):
            out[:, k] = at8[np.minimum(starts + 8 * k, len(data))] & FIRST_BYTES[np.clip(size - 8 * k, 0, 8)]
        out[:, -1] = size * 2 + first
        return out


@lru_cache(maxsize=2)
def _counter(raw: bytes) -> Counter:
    return Counter(Vocabulary.read(raw))


def token_counts(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id and n_tokens of each document, as a unigram tokenizer with that vocabulary counts them.

    The file is a SentencePiece model, whose pieces and scores are read as a
    unigram vocabulary; sums of scores are exact to double precision.  No start
    or end tokens are counted.  Null and empty texts have no tokens; whole texts
    are counted, however long; rows with repeated or null ids each give a row;
    an empty table gives none.  The path is the driver's or any that Spark reads.
    """
    spark = docs.sparkSession
    if os.path.exists(vocabulary_path):
        with open(vocabulary_path, "rb") as f:
            raw = f.read()
    else:
        raw = bytes(spark.read.format("binaryFile").load(vocabulary_path).first()["content"])
    shared = spark.sparkContext.broadcast(raw)

    def count(batches):
        counter = _counter(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counter(batch.column(1)))], names=["doc_id", "n_tokens"])

    return keyed(docs).mapInArrow(count, "doc_id long, n_tokens long")
