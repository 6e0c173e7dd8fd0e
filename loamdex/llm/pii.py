"""Personal data by a semi-Markov conditional random field over candidate regions.

Regular expressions find base spans, which always stay.  Around them, and in
any stretch of digits and separators or address-like text, the field scores
whole segments, over regions of any length: a segment of a type has features of
all its text (digits, groups, separators, checksum, neighbours), and dynamic
programming over segment ends, with a bound on a segment's tokens, picks
boundaries and types jointly.  Its weights are trained on the spot, by gradient
of the exact likelihood, on regions (cut to a bounded length) of a bounded
sample of documents with the base spans as labels, and on made-up examples: the
entities in the ways that people write them, which base patterns do not know,
and numbers that are none (dates, versions, sums, serial numbers).
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from dataclasses import dataclass
from functools import cached_property
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamdex.llm.common import keyed

# The base patterns of the query's contract.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Matches start at runs of digits only, as any other start in a run fails alike; so a long run is read once.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")

#: Parameters of the field: documents it learns from (about; by a hash of the id), made-up examples, tokens of a segment at most, training rounds, and how much likelier than no entity a span must be.
SAMPLE_DOCS = 4000
MADE_UP = 600
MAX_TOKENS = 24
ROUNDS = 40
MARGIN = 1.0
#: Stretches of text that may hold an entity: digits with what may stand between them, and addresses around an @ or what stands for it.
NUMBERS = re.compile(r"[+(]?(?<![0-9])[0-9](?:[\x20().\-/]{0,2}[0-9]){5,}")
AT = re.compile(r"\x20?@\x20?|\x20?[\[(][aA][tT][\])]\x20?")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(][dD][oO][tT][\])]\x20?)[A-Za-z0-9-]++)+")
#: Characters of a region at most, where the field learns.
LEARNT_CHARS = 96
#: First tokens whose segments are held at a time.
TOKENS_AT_ONCE = 4096
TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|.", re.S)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 if d < 5 else d * 2 - 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join([c for c in s if "0" <= c <= "9"])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, sorted; failing matches are dropped and not tried again."""
    out = []
    if "@" in text:
        out += [(m.start(), 0, m.end()) for m in _emails(text)]
    for m in IP.finditer(text):
        # a part may have leading zeros and any length; int() of very long digits is refused
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if 12 <= m.end() - m.start() and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def _name_start(text: str, at: int, least: int) -> int:
    """Where the run of an address's name that ends at `at` starts, from least on."""
    while at > least and (c := text[at - 1]) < "\x80" and (c.isalnum() or c in "._%+-"):
        at -= 1
    return at


def _emails(text: str):
    """EMAIL.finditer(text), but that it starts at an @ and looks back, so that long words cost no time."""
    at, least = text.find("@"), 0
    while at >= 0:
        first = _name_start(text, at, least)
        if first < at and (m := EMAIL.match(text, first)):
            least = m.end()
            yield m
        at = text.find("@", max(at + 1, least))


FEATURES = 50


# Shapes of dates, and of addresses whose signs are written out.
_DATE = re.compile(r"(?:19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}(?![0-9])|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:19|20)[0-9]{2}(?![0-9])")
_MASKED = re.compile(r"[A-Za-z0-9._%+-]+(?:\x20?@\x20?|\x20?[\[(][aA][tT][\])]\x20?)[A-Za-z0-9-]+(?:(?:\.|\x20?[\[(][dD][oO][tT][\])]\x20?)[A-Za-z0-9-]+)+")


def _features(text: str, region_start: int, start: int, end: int, tokens: int) -> list[int]:
    """The numbers of the features that hold of the whole segment text[start:end]."""
    s = text[start:end]
    digits = _digits(s)
    n, out = len(digits), [0]
    before, after = text[start - 1] if start else " ", text[end] if end < len(text) else " "
    groups = [len(g) for g in re.findall(r"[0-9]+", s)]
    parts = s.split(".")
    out += [1] if "@" in s else []
    out += [2] if EMAIL.fullmatch(s) else []
    out += [3] if re.search(r"(?i)[\[(]at[\])]|[\[(]dot[\])]|\x20@|@\x20", s) and s[:1].isalnum() and s[-1:].isalnum() else []
    out += [4] if "." in s else []
    out += [5] if len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts) else []
    out += [6] if len(parts) == 4 and all(p.isdigit() for p in parts) and any(len(p) > 3 or int(p) > 255 for p in parts) else []
    out += [7] if s[0] == "+" else []
    out += [8] if s[0] == "(" else []
    out += [9] if n < 7 else [10] if n < 9 else [11] if n < 12 else [12] if n <= 15 else [13] if n <= 19 else [14]
    if 12 <= n <= 19:
        out += [15] if luhn(digits) else [16]
    out += [17] if "-" in s else []
    out += [18] if " " in s else []
    out += [19] if "/" in s else []
    out += [20] if "(" in s and ")" in s else []
    out += [21] if len(groups) > 1 and all(g == 4 for g in groups[:-1]) else []
    out += [22] if groups[-3:] == [3, 3, 4] else []
    out += [23] if len(groups) >= 2 and set(groups) <= {2, 3, 4} else []
    out += [24] if len(groups) == 1 and s.isdigit() else []
    out += [25] if before.isalnum() or before in "+@._%-" else [26]
    out += [27] if after.isalnum() or after in "@" else [28]
    out += [29] if not (s[-1].isalnum()) else []
    out += [30] if not (s[0].isalnum() or s[0] in "+(") else []
    out += [31] if any(c.isalpha() for c in s) and "@" not in s and 3 not in out else []
    context = text[max(0, start - 24) : start].lower()
    out += [32] if re.search(r"mail|e-mail|contact", context) else []
    out += [33] if re.search(r"phone|tel|call|fax|mobile", context) else []
    out += [34] if re.search(r"card|visa|master|credit|pay", context) else []
    out += [35] if re.search(r"\bip\b|host|server|addr", context) else []
    out += [36] if re.search(r"[\x20().\-/]{2}", s) else []
    out += [37] if re.fullmatch(r"[0-9](?:[\x20.\-]?[0-9])+", s) else []
    out += [38] if 9 <= n <= 15 and re.fullmatch(r"(?:\+|00)[0-9][\x20().0-9/-]+[0-9]", s) else []
    out += [39] if len(set(digits)) == 1 and n > 6 else []
    out += [40] if _DATE.match(s) else []
    out += [41] if s[:2] == "00" and n >= 9 else []
    out += [42] if n == 10 and groups == [3, 3, 4] else []
    out += [43] if len(groups) >= 3 and len({c for c in s if not c.isdigit()}) == 1 and "/" in s else []
    out += [44] if "." in s and len(groups) >= 3 and max(groups) <= 2 else []
    out += [45] if _MASKED.fullmatch(s) else []
    out += [46] if re.search(r"[\x20().\-/]{3}", s) else []
    out += [47] if groups and groups[0] == 4 and digits[:2] in ("19", "20") and len(groups) > 1 else []
    out += [48] if groups == [4, 4, 4, 4] or groups == [4, 6, 5] else []
    out += [49] if len(groups) > 1 and s[0] in "+(" or s[:1] == "0" and len(groups) > 1 else []
    return out


@dataclass
class Region:
    """A stretch of text that starts at `start`, and its token edges."""

    text: str
    start: int
    edges: list[int]

    def segments_from(self, first: int, last: int) -> list[tuple[int, int, list[int]]]:
        """The candidate segments that start at tokens first to last: (first token, end token, features)."""
        text, edges, out = self.text, self.edges, []
        n = len(edges) - 1
        for a in range(first, min(n, last)):
            if not (text[edges[a]].isalnum() or text[edges[a]] in "+("):
                continue
            for b in range(a + 1, min(n, a + MAX_TOKENS) + 1):
                if text[edges[b] - 1].isalnum() and (edges[b] - edges[a] >= 6):
                    out.append((a, b, _features(text, self.start, edges[a], edges[b], b - a)))
        return out

    @cached_property
    def segments(self) -> list[tuple[int, int, list[int]]]:
        return self.segments_from(0, len(self.edges) - 1)


def _stretches(text: str) -> list[tuple[int, int]]:
    found, least = [(m.start(), m.end()) for m in NUMBERS.finditer(text)], 0
    for m in AT.finditer(text) if "@" in text or "(" in text or "[" in text else ():
        first = _name_start(text, m.start(), least)
        if first < m.start() and (domain := DOMAIN.match(text, m.end())):
            found.append((first, domain.end()))
            least = domain.end()
    out: list[tuple[int, int]] = []
    for start, end in sorted(found):  # what overlaps is one region
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def regions(text: str, most: int | None = None) -> list[Region]:
    """Candidate regions, of any length; or cut to `most` characters, to learn from."""
    out = []
    for start, end in _stretches(text):
        end = end if most is None else min(end, start + most)
        out.append(Region(text, start, [start] + [start + t.end() for t in TOKEN.finditer(text[start:end])]))
    return out


def short_regions(text: str) -> list[Region]:
    """Regions of a bounded length that have segments."""
    return [r for r in regions(text, LEARNT_CHARS) if r.segments]


def _scores(segments: list[tuple[int, int, list[int]]], weights: np.ndarray) -> np.ndarray:
    return np.array([weights[:, f].sum(axis=1) for _, _, f in segments]).reshape(len(segments), len(weights))


def likelihood(region: Region, gold: list[tuple[int, int, int]], weights: np.ndarray) -> tuple[float, np.ndarray]:
    """Log-likelihood of the gold segments (first token, end token, kind), and its gradient, by forward and backward sums.  Tokens outside segments score 0."""
    n, scores = len(region.edges) - 1, _scores(region.segments, weights)
    ending: list[list[int]] = [[] for _ in range(n + 1)]
    starting: list[list[int]] = [[] for _ in range(n + 1)]
    for i, (a, b, _) in enumerate(region.segments):
        ending[b].append(i)
        starting[a].append(i)
    any_kind = np.logaddexp.reduce(scores, axis=1)
    ahead, back = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, n + 1):
        ahead[t] = np.logaddexp.reduce([ahead[t - 1], *(ahead[region.segments[i][0]] + any_kind[i] for i in ending[t])])
    for t in range(n - 1, -1, -1):
        back[t] = np.logaddexp.reduce([back[t + 1], *(back[region.segments[i][1]] + any_kind[i] for i in starting[t])])
    grad, value = np.zeros_like(weights), -ahead[n]
    wanted = set(gold)
    for i, (a, b, f) in enumerate(region.segments):
        grad[:, f] -= np.exp(ahead[a] + back[b] - ahead[n] + scores[i])[:, None]
        for k in range(len(KINDS)):
            if (a, b, k) in wanted:
                value += scores[i, k]
                grad[k, f] += 1
    return value, grad


def decode(region: Region, weights: np.ndarray, margin: float = MARGIN) -> list[tuple[int, int, int]]:
    """The best (start, kind, end) of the region; a segment counts margin less than it scores.  Ties go to fewer and earlier segments."""
    n = len(region.edges) - 1
    # To each token edge: the best total, and the start and kind of the segment that ends there in it (-1: none).
    best, by = [0.0] * (n + 1), [(-1, -1)] * (n + 1)
    more = [-np.inf] * (n + 1)
    for first in range(0, n, TOKENS_AT_ONCE):
        segments = region.segments_from(first, first + TOKENS_AT_ONCE)
        scores = _scores(segments, weights) - margin
        i = 0
        for t in range(first, min(n, first + TOKENS_AT_ONCE)):
            while i < len(segments) and segments[i][0] == t:
                total, b = best[t] + scores[i].max(), segments[i][1]
                if total > more[b]:
                    more[b], by[b] = total, (t, int(scores[i].argmax()))
                i += 1
            best[t + 1] = max(best[t], more[t + 1])
            if more[t + 1] <= best[t]:
                by[t + 1] = (-1, -1)
    out, t = [], n
    while t > 0:
        a, kind = by[t]
        if a >= 0:
            out.append((region.edges[a], kind, region.edges[t]))
        t = a if a >= 0 else t - 1
    return out[::-1]


def _card(rng: random.Random, size: int) -> str:
    d = rng.choice("3456") + "".join(rng.choice("0123456789") for _ in range(size - 2))
    return next(d + c for c in "0123456789" if luhn(d + c))


def _grouped(digits: str, sizes: tuple[int, ...], sep: str) -> str:
    cuts = [sum(sizes[:i]) for i in range(len(sizes) + 1)]
    return sep.join(digits[a:b] for a, b in zip(cuts, cuts[1:], strict=False))


def made_up(count: int, seed: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Short texts with the spans (start, kind, end) of the entities in them: a half have one, in any of the ways that people write it; the others have numbers that are none."""
    rng, out = random.Random(seed), []
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9)))

    def email() -> str:
        at = rng.choice(["@", " [at] ", "[at]", "(at)", " (at) ", " @ ", "[AT]"])
        dot = rng.choice([".", ".", "(dot)", "[dot]", " [dot] ", " (dot) "]) if at != "@" else "."
        return rng.choice([word(), f"{word()}.{word()}", word() + number(2)]) + at + dot.join([word(), rng.choice(["org", "com", "net", "example", "de"])])

    def card() -> str:
        sep = rng.choice(["", " ", "-", ".", "/", "  "])
        return _grouped(_card(rng, 15), (4, 6, 5), sep) if rng.random() < 0.2 else _grouped(_card(rng, 16), (4, 4, 4, 4), sep)

    def phone() -> str:
        sep = rng.choice([" ", "-", ".", "/"])
        local = _grouped(str(rng.randint(2, 9)) + number(9), (3, 3, 4), sep)
        own = str(rng.choice([1, 33, 34, 44, 49]))
        area, rest = local[:3], local[4:]
        with_code = [f"+{own}{sep}{local}", f"00{own}{sep}{local}", f"+{own} ({area}) {rest}", f"00{own} {number(2)} {number(4)} {number(4)}", f"+{own}{number(9)}"]
        return rng.choice([*with_code, f"({area}) {rest}", local, f"0{number(2)}{sep}{number(4)}{sep}{number(4)}"])

    def address() -> str:
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))

    def serial(size: int) -> str:
        while luhn(d := str(rng.randint(1, 9)) + number(size - 1)):
            pass
        return d

    none = (
        lambda: f"{rng.randint(1950, 2030)}{(s := rng.choice('-/.'))}{rng.randint(1, 12):02d}{s}{rng.randint(1, 28):02d}",
        lambda: f"{rng.randint(1, 28):02d}{(s := rng.choice('-/.'))}{rng.randint(1, 12):02d}{s}{rng.randint(1950, 2030)}",
        lambda: f"{rng.randint(1950, 2030)}-{rng.randint(1950, 2030)} {rng.randint(1950, 2030)}-{rng.randint(1950, 2030)}",
        lambda: number(rng.randint(6, 8)), lambda: serial(rng.choice([11, 12, 13, 14, 16, 16, 16])), lambda: number(rng.randint(20, 40)),
        lambda: ".".join(number(rng.randint(1, 2)) for _ in range(rng.randint(5, 6))), lambda: ".".join(str(rng.randint(256, 999)) for _ in range(4)),
        lambda: _grouped("978" + number(10), (3, 1, 2, 6, 1), "-"), lambda: f"{number(3)}-{number(4)}", lambda: _grouped(serial(16), (4, 4, 4, 4), rng.choice(" -./")),
        lambda: " ".join(number(rng.randint(1, 3)) for _ in range(rng.randint(6, 9))), lambda: f"{rng.randint(1, 9)}.{number(rng.randint(6, 12))}",
    )
    kinds, hints = (email, address, card, phone), (("mail", "contact", "write to"), ("host", "server", "ip"), ("card", "visa", "paid with"), ("call", "tel", "phone"))
    for i in range(count):
        left = " ".join(word() for _ in range(rng.randint(0, 3)))
        right = rng.choice(["", ".", ", ", " "]) + " ".join([""] + [word() for _ in range(rng.randint(0, 2))])
        kind = rng.randrange(4)
        if i % 2:
            entity = rng.choice(none)()
        else:
            entity = kinds[kind]()
            left = f"{left} {rng.choice(hints[kind])}" if rng.random() < 0.4 else left
        left += " " if left else ""
        out.append((left + entity + right, [] if i % 2 else [(len(left), kind, len(left) + len(entity))]))
    return out


def fit(examples: list[tuple[str, list[tuple[int, int, int]]]], rounds: int = ROUNDS, l2: float = 0.01) -> np.ndarray:
    """Weights (kinds x features) of greatest penalised likelihood, by gradient steps of a fixed number."""
    data = []
    for text, spans in examples:
        for region in short_regions(text):
            place = {e: i for i, e in enumerate(region.edges)}
            known = {(a, b) for a, b, _ in region.segments}
            gold, last = [], -1
            for start, kind, end in sorted(spans, key=lambda s: (s[0], s[1])):
                a, b = place.get(start, -1), place.get(end, -1)
                if (a, b) in known and a >= last:
                    gold.append((a, b, kind))
                    last = b
            data.append((region, gold))
    weights = np.zeros((len(KINDS), FEATURES))
    weights[:, 0] = -2.0
    speed = np.zeros_like(weights)
    for _ in range(rounds if data else 0):
        grad = -l2 * weights * len(data) / 50
        for region, gold in data:
            grad += likelihood(region, gold, weights)[1]
        speed += grad**2
        weights += 0.5 * grad / (np.sqrt(speed) + 1e-6)
    return weights


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, most_regions: int = 400, examples: int = MADE_UP) -> np.ndarray:
    """Weights learned from about sample_docs documents (all, if fewer), of which most_regions short stretches around regions, in the order of a hash, are used, and from made-up examples."""
    share = min(1.0, sample_docs / max(1, docs.count()))
    rows = docs.where(F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit(9)), F.lit(1 << 20)) < share * (1 << 20))

    def found(batches):
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                if text and (some := short_regions(text)):
                    spans = base_spans(text)
                    for region in some:
                        a, b = max(0, region.start - 24), region.edges[-1] + 12
                        out.append((text[a:b], [(s - a, k, e - a) for s, k, e in spans if a <= s and e <= b]))
            keys = [hashlib.md5(x.encode()).hexdigest() for x, _ in out]
            spans = pa.array([[list(s) for s in y] for _, y in out], pa.list_(pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([x for x, _ in out], pa.string()), spans], names=["key", "text", "spans"])

    distinct = rows.mapInArrow(found, "key string, text string, spans array<array<int>>").dropDuplicates(["key"])
    kept = distinct.orderBy("key").limit(most_regions).collect()
    return fit([(r.text, [tuple(s) for s in r.spans]) for r in kept] + made_up(examples, 1))


def text_spans(text: str | None, weights: np.ndarray, margin: float = MARGIN) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans, and all spans: the base and what the field adds that does not overlap them; both sorted."""
    if not text:
        return [], []
    base = base_spans(text)
    # Base spans may overlap: up to each of them, in the order of starts, the furthest end.
    starts, ends = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max))
    more = list(base)
    for region in regions(text):
        for start, kind, end in decode(region, weights, margin):
            before = bisect_left(starts, end)  # base spans that start before the end
            if not before or ends[before - 1] <= start:
                more.append((start, kind, end))
    return base, sorted(more)


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def personal_data(docs: DataFrame, weights: np.ndarray | None = None, margin: float = MARGIN) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of each document.

    spans lists kind:start:end by start, then kind (code points, end exclusive):
    the base patterns' spans and those that the field adds elsewhere; the counts
    and base_sha256 are of the base spans alone.  Null and empty texts have
    none; rows with repeated or null ids each give a row; an empty table gives
    none.  Without weights, they are learned from docs.
    """
    rows = keyed(docs)
    shared = docs.sparkSession.sparkContext.broadcast(train(rows) if weights is None else weights)

    def scan(batches):
        held = shared.value
        for batch in batches:
            counts, digests, spans = [[] for _ in KINDS], [], []
            for text in batch.column(1).to_pylist():
                base, all_ = text_spans(text, held, margin)
                for k, column in enumerate(counts):
                    column.append(sum(kind == k for _, kind, _ in base))
                digests.append(hashlib.sha256(spelled(base).encode()).hexdigest())
                spans.append(spelled(all_))
            columns = [*(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return rows.mapInArrow(scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")

