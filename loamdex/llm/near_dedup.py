"""Near-duplicate detection with SetSketch registers, banding, joint likelihood and exact verification.

1. A document's set of word shingles becomes a SetSketch: register i is
   floor(1 - log_b m_i), held to 0..q+1, where m_i is the least of the set's
   exponential hashes under function i.  Registers are mergeable (by maximum)
   and locality-sensitive: two agree with about the sets' Jaccard similarity.
   Documents with equal sets are one node from here on.
2. Bands of registers are hashed to buckets.  Each bucket links its members to
   its least member, a number of pairs linear in the bucket.
3. For each such pair the likelihood of the registers (how many are higher,
   lower and equal, given both set sizes) is compared at its maximum and at the
   threshold; pairs that cannot reach it are dropped, the rest is verified on
   full sets: the members of a leader, in blocks, all against all, which gives a
   spanning forest of exact links and never the pairs themselves.
4. Buckets whose members still lie in several components may hold a link
   between members that none of their leaders shared.  Their members are
   compared by likelihood, block by block, and what may be a link is verified
   as before, in groups that those possible links connect.
5. Components come from all verified links.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamdex.llm.common import discard, fresh, keyed, stored
from loamdex.llm.components import components
from loamdex.llm.textops import NOT_SPACE, Block, blocks, mix, windows, words

#: Registers, their base and their greatest value less one.
REGISTERS, BASE, LIMIT = 288, 1.001, 65534
#: A pair at the threshold may share no band with this chance at most.  At 0.8 that gives 48 bands of 6 registers (5e-7).
MISSED = 1e-6
#: Members and shingles (about) of a block that is verified at once; members of one that is compared by likelihood.
BLOCK_DOCS, BLOCK_SHINGLES, BLOCK_SKETCHES = 512, 1 << 20, 2048
# Words of the query's contract, and A-Z to lower case.
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_SMALL = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: A pair is dropped if its registers are e^SLACK times likelier at the best similarity under the threshold than at any from it on.
SLACK = 14.0
SHINGLE, PERCENT = 5, 80
#: Up to so many ids (8 bytes each) are broadcast to pick texts; beyond, a join shuffles.
BROADCAST_IDS = 2_000_000


def _sets(hashes: np.ndarray, firsts: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each row's shingles, from the words' hashes."""
    all_, out = windows(hashes, n), []
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        if b - a >= n:
            own = np.sort(all_[a : b - n + 1])
            keep = np.ones(len(own), bool)
            keep[1:] = own[1:] != own[:-1]
            out.append(own[keep])
        else:
            out.append(windows(hashes[a:b], b - a) if b > a else all_[:0])
    return out


def shingle_sets(block: Block, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row; with fewer than n words, the whole sequence as one."""
    of = words(block, NOT_SPACE)
    return _sets(of.hashes, of.firsts, n)


def exact_set(text: bytes, n: int) -> set:
    """The shingles of a text themselves, as tuples of words."""
    own = _WORD.findall(text.translate(_SMALL))
    if len(own) < n:
        return {tuple(own)} if own else set()
    return set(zip(*(own[i:] for i in range(n)), strict=False))


def checked_links(texts: list[bytes], sets: list[np.ndarray], n: int, percent: int, labels: np.ndarray | None = None, split: int | None = None) -> list[tuple[int, int]]:
    """exact_links(), whose links are checked on the shingles' bytes; if a hash has misled them, all sets are compared by bytes."""
    found, held = exact_links(sets, percent, labels, split), {}
    for i, j in found:
        x, y = (held[k] if k in held else held.setdefault(k, exact_set(texts[k], n)) for k in (i, j))
        both = len(x & y)
        if 100 * both < percent * (len(x) + len(y) - both):
            numbers: dict = {}
            plain = [np.array(sorted(numbers.setdefault(s, len(numbers)) for s in exact_set(t, n)), np.uint64) for t in texts]
            return exact_links(plain, percent, labels, split)
    return found


@lru_cache(maxsize=4)
def _functions(registers: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240)
    return rng.integers(0, 2**32, registers, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, registers, dtype=np.uint32)


def sketch(own: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """The SetSketch of a set of 64-bit hashes: uint16 registers; all 0 for the empty set."""
    if not len(own):
        return np.zeros(registers, np.uint16)
    times, plus = _functions(registers)
    half, least = (own >> np.uint64(32)).astype(np.uint32), np.full(registers, 2**32 - 1, np.uint32)
    for at in range(0, len(half), 512):
        least = np.minimum(least, (half[at : at + 512, None] * times + plus).min(axis=0))
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2**32) / 20.0
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, LIMIT + 1).astype(np.uint16)


def band_rows(percent: int, registers: int = REGISTERS) -> int:
    """Registers of a band: as many as leave pairs at the threshold a chance of MISSED at most to share none; ValueError if one is too many."""
    for rows in range(16, 0, -1):
        if (1 - (percent / 100) ** rows) ** (registers // rows) <= MISSED:
            return rows
    raise ValueError("percent is too low for so many registers")


def band_keys(sketches: np.ndarray, rows: int) -> np.ndarray:
    """documents x bands: a hash of each band's registers and number."""
    bands = sketches.shape[1] // rows
    parts = sketches[:, : bands * rows].reshape(len(sketches), bands, rows).astype(np.uint64)
    h = np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(rows):
        h = mix(h * np.uint64(0x9FB21C651E98DF25) + parts[:, :, k])
    return h.view(np.int64)


def likelihood_ratio(higher: np.ndarray, lower: np.ndarray, equal: np.ndarray, n: np.ndarray, m: np.ndarray, threshold: float, steps: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """The similarity of greatest joint likelihood, and how much that exceeds the greatest from threshold on (logarithms).

    higher, lower, equal: registers of the first sketch against the second;
    n, m: the sets' sizes.  P(higher) = p(u - v J), P(lower) = p(v - u J), where
    p(x) = -log_b(1 - x (b - 1) / b), u = n / (n + m) and v = m / (n + m).
    """
    u, v = n / (n + m), m / (n + m)
    most = np.minimum(u / v, v / u)
    p = lambda x: np.clip(-np.log1p(-np.clip(x, 1e-9, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-9, 1)

    def value(j: np.ndarray) -> np.ndarray:
        up, down = p(u - v * j), p(v - u * j)
        return higher * np.log(up) + lower * np.log(down) + equal * np.log(np.clip(1 - up - down, 1e-9, 1))

    best, where, above = np.full(np.shape(u), -np.inf), np.zeros(np.shape(u)), np.full(np.shape(u), -np.inf)
    for k in range(steps + 1):
        j = most * (k / steps)
        now = value(j)
        where, best = np.where(now > best, j, where), np.maximum(best, now)
        j = np.minimum(threshold + (most - threshold) * (k / steps), most)
        above = np.where(most >= threshold - 1e-12, np.maximum(above, value(np.maximum(j, 0))), above)
    return where, np.maximum(best, above) - above


def may_link(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs of sketches (rows) may be links.  Few steps suffice: the cut needs no exact maximum."""
    higher, lower = (a > b).sum(axis=-1), (a < b).sum(axis=-1)
    threshold = percent / 100
    _, excess = likelihood_ratio(higher, lower, a.shape[-1] - higher - lower, n.astype(float), m.astype(float), threshold, steps=20)
    return excess <= SLACK


class Forest:
    """Disjoint sets of numbered items; least numbers are roots."""

    def __init__(self, size: int):
        self.parent = list(range(size))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.parent[max(i, j)] = min(i, j)
        return i != j

    def labels(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.parent))], np.int64)


def exact_links(sets: list[np.ndarray], percent: int, labels: np.ndarray | None = None, split: int | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links of the sets: pairs with 100 * intersection >= percent * union.

    labels: items with equal labels count as linked already.  split: only pairs
    of one item below it and one from it on.
    Intersections of all pairs are sums of small matrix products, over a bounded
    number of elements at a time.
    """
    count = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    forest = Forest(count)
    if labels is not None:
        _, first, inverse = np.unique(labels, return_index=True, return_inverse=True)
        for i, j in enumerate(first[inverse].tolist()):
            forest.join(i, j)
    if count < 2:
        return []
    elements = np.concatenate(sets)
    item = np.repeat(np.arange(count), sizes)
    _, number, often = np.unique(elements, return_inverse=True, return_counts=True)
    shared = often[number] > 1  # elements of one set are in no intersection
    item, number = item[shared], number[shared]
    order = np.argsort(number, kind="stable")
    item, number = item[order], number[order]
    both = np.zeros((count, count), np.float32)
    if len(number):
        dense = np.cumsum(np.concatenate([[0], number[1:] != number[:-1]]))
        for a in range(0, int(dense[-1]) + 1, 8192):
            lo, hi = np.searchsorted(dense, [a, a + 8192])
            held = np.zeros((count, int(dense[hi - 1]) - a + 1), np.float32)
            held[item[lo:hi], dense[lo:hi] - a] = 1
            both += held @ held.T
    both = both.astype(np.int64)
    linked = np.triu(100 * both >= percent * (sizes[:, None] + sizes[None, :] - both), 1) & (sizes[:, None] > 0) & (sizes[None, :] > 0)
    if split is not None:
        linked[:split, :split] = linked[split:, split:] = False
    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(linked)), strict=True):
        if forest.join(i, j):
            out.append((i, j))
    return out


def possible_links(sketches: np.ndarray, sizes: np.ndarray, labels: np.ndarray, percent: int, split: int | None = None) -> list[tuple[int, int]]:
    """A spanning forest, over labels, of the pairs with different labels that may be links.  split: as in exact_links()."""
    count, out = len(sketches), []
    _, number = np.unique(labels, return_inverse=True)
    forest = Forest(int(number.max()) + 1 if count else 0)
    rows, least = (count - 1 if split is None else split), (percent / 100 - 0.35) * sketches.shape[1]
    slab = max(1, 16_384 // max(1, count))
    for at in range(0, rows, slab):
        i, j = np.divmod(np.arange(min(slab, rows - at) * count), count)
        i = i + at
        fits = (j > i if split is None else j >= split) & (labels[i] != labels[j])
        fits &= 100 * np.minimum(sizes[i], sizes[j]) >= percent * np.maximum(sizes[i], sizes[j])  # sizes alone rule out many
        i, j = i[fits], j[fits]
        fits = (sketches[i] == sketches[j]).sum(axis=1) > least
        i, j = i[fits], j[fits]
        if len(i):
            passed = may_link(sketches[i], sketches[j], sizes[i], sizes[j], percent)
            out += [(x, y) for x, y in zip(i[passed].tolist(), j[passed].tolist(), strict=True) if forest.join(int(number[x]), int(number[y]))]
    return out


def _ints(values) -> pa.Array:
    return pa.array(values, pa.int64())


def _sketched(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n, a 128-bit hash of the set (a, b: of two independent hashes of the words) and the sketch of each document."""

    def sketch_all(batches):
        for batch in batches:
            for block in blocks(batch.column(1)):
                of = words(block, NOT_SPACE)
                sets, others = _sets(of.hashes, of.firsts, n), _sets(of.other_hashes(), of.firsts, n)
                a, b = (np.array([int(mix(s).sum(dtype=np.uint64)) for s in half], np.uint64).view(np.int64) for half in (sets, others))
                sizes = [max(len(s), len(o)) for s, o in zip(sets, others, strict=True)]
                columns = [batch.column(0).slice(block.first, block.rows), _ints(sizes), _ints(a), _ints(b)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([sketch(s).tobytes() for s in sets], pa.binary())], names=["doc_id", "n", "a", "b", "sketch"])

    return docs.mapInArrow(sketch_all, "doc_id long, n long, a long, b long, sketch binary")


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def _texts_of(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (..., id) with the texts of their documents."""
    wanted = stored(rows.select("id").distinct(), "ids")
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    texts = texts.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, "id", "left_semi")
    return rows.join(texts, "id")


def _verified(docs: DataFrame, rows: DataFrame, keys: list[str], n: int, percent: int) -> DataFrame:
    """(a, b): spanning forests of the exact links in each group of rows (keys, id, side, label); side 0 is compared with side 1, or within itself where no 1 is."""

    def verify(part: pa.Table) -> pa.Table:
        part = part.sort_by([("side", "ascending"), ("id", "ascending")])
        ids, side = part["id"].to_numpy(), part["side"].to_numpy()
        sets = [s for block in blocks(part["text"]) for s in shingle_sets(block, n)]
        split = int((side == 0).sum())
        texts = [t or b"" for t in part["text"].cast(pa.binary()).to_pylist()]
        found = checked_links(texts, sets, n, percent, part["label"].to_numpy(), split if split < len(ids) else None)
        return pa.table({"a": _ints([ids[i] for i, _ in found]), "b": _ints([ids[j] for _, j in found])})

    return _texts_of(docs, rows).groupBy(*keys).applyInArrow(verify, "a long, b long")


def _blocks_of(docs: int, shingles: int | None = None):
    """The number of blocks of so many members, and of so many shingles (column n), at most (about)."""
    by_docs = F.ceil(F.count(F.lit(1)) / docs)
    return F.greatest(by_docs, F.ceil(F.sum("n") / shingles)).cast("int") if shingles else by_docs.cast("int")


def _block_pairs(rows: DataFrame, keys: list[str], of) -> DataFrame:
    """rows (keys, id, ...) dealt to every pair of blocks (x, y), x <= y, of their group; side is 1 for the rows of y where x < y.

    The numbers of blocks are a table of their own, so that the join with it can
    split the rows of a large group over tasks.
    """
    sizes = stored(rows.groupBy(*keys).agg(of.alias("of")), "sizes")
    dealt = rows.join(sizes, keys).withColumn("own", F.pmod(F.xxhash64("id", F.lit(3)), F.col("of")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    return dealt.select("*", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).cast("int").alias("side")).drop("own", "other", "of")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each document.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a
    document's set holds its distinct shingles of so many words, or the whole
    sequence as one if it has fewer.  Documents are linked if 100 *
    intersection >= percent * union; component_id is the least doc_id that links
    reach, itself included, and kept is true where it is the row's own.  The
    bands follow percent (band_rows()); a percent that they cannot serve is refused.
    Documents without words (or with null text) have the empty set and are
    linked with nothing.  Rows that share an id are one document; if their
    sets differ, the one of the least hash leads to its links.  A row with a
    null id is linked with nothing, has no component, and is kept.  An empty
    table gives no rows.
    """
    docs, rows_of_band = keyed(docs), band_rows(percent)
    known = docs.where(F.col("doc_id").isNotNull())
    base = stored(_sketched(docs, shingle), "sketches")
    full = base.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    # A node for each set; of the sets that one id stands for, that of the least hash.
    nodes = full.groupBy("a", "b", "n").agg(F.min("doc_id").alias("id"), F.first("sketch").alias("sketch"))
    least = F.min_by(F.struct("sketch", "n"), F.struct("a", "b", "n")).alias("least")
    sketches = stored(nodes.groupBy("id").agg(least).select("id", "least.sketch", "least.n"), "nodes")

    def to_bands(batches):
        for batch in batches:
            keys = band_keys(_matrix(batch.column(1)), rows_of_band) if batch.num_rows else np.zeros((0, REGISTERS // rows_of_band), np.int64)
            yield pa.RecordBatch.from_arrays([_ints(keys.ravel()), _ints(np.repeat(batch.column(0).to_numpy(), keys.shape[1]))], names=["bucket", "id"])

    bands = sketches.select("id", "sketch").mapInArrow(to_bands, "bucket long, id long")
    buckets = bands.groupBy("bucket").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead < last").select("bucket", "lead")
    members = stored(bands.join(buckets, "bucket"), "members")

    def likely(batches):
        for batch in batches:
            if batch.num_rows:
                sizes = (batch.column(i).to_numpy() for i in (3, 5))
                passed = may_link(_matrix(batch.column(2)), _matrix(batch.column(4)), *sizes, percent)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(5)], names=["lead", "id", "n"]).filter(pa.array(passed))

    pairs = members.where("id <> lead").select("lead", "id").distinct()
    leaders = sketches.select(F.col("id").alias("lead"), F.col("sketch").alias("s1"), F.col("n").alias("n1"))
    pairs = pairs.join(sketches, "id").join(leaders, "lead").select("lead", "id", "s1", "n1", "sketch", "n")
    pairs = stored(pairs.mapInArrow(likely, "lead long, id long, n long"), "pairs")

    # A leader's members in blocks; the leader is in each of them.
    counts = stored(pairs.groupBy("lead").agg(_blocks_of(BLOCK_DOCS, BLOCK_SHINGLES).alias("of")), "blocks")
    rows = pairs.join(counts, "lead").select("lead", F.pmod(F.xxhash64("id", F.lit(2)), F.col("of")).cast("int").alias("x"), "id")
    rows = rows.unionByName(rows.select("lead", "x", F.col("lead").alias("id")).distinct())
    links = stored(_verified(known, rows.select("*", F.lit(0).alias("side"), F.col("id").alias("label")), ["lead", "x"], shingle, percent), "links")
    labels = components(links)

    # Buckets that still hold several components, and pairs that their leader's blocks did not compare: those of
    # members that fell short of the leader, or that lie in different blocks.  Of buckets with the same members one is enough.
    whole = pairs.join(counts.where("of = 1").select("lead"), "lead", "left_semi").select("lead", "id", F.lit(1).alias("met"))
    mixed = members.join(labels, "id", "left").join(whole, ["lead", "id"], "left")
    mixed = mixed.select("bucket", "id", F.coalesce("component", "id").alias("label"), (F.col("met").isNull() & (F.col("id") != F.col("lead"))).cast("int").alias("apart"))
    sums = (F.sum(F.xxhash64("id", F.lit(k)) % (1 << 40)).alias(f"sum{k}") for k in (4, 5))
    labels_of = (F.min("label").alias("p"), F.max("label").alias("q"))
    open_ = mixed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.sum("apart").alias("apart"), *labels_of, *sums)
    open_ = open_.where("size > 2 and apart > 0 and p < q").groupBy("size", "sum4", "sum5").agg(F.min("bucket").alias("bucket")).select("bucket")
    mixed = stored(mixed.select("bucket", "id", "label").join(open_, "bucket", "left_semi"), "mixed")

    def maybe(part: pa.Table) -> pa.Table:
        part = part.sort_by([("side", "ascending"), ("id", "ascending")])
        ids, split = part["id"].to_numpy(), int((part["side"].to_numpy() == 0).sum())
        label = part["label"].to_numpy()
        found = possible_links(_matrix(part["sketch"]), part["n"].to_numpy(), label, percent, split if split < len(ids) else None)
        return pa.table({"a": _ints([label[i] for i, _ in found]), "b": _ints([label[j] for _, j in found])})

    chances = stored(_block_pairs(mixed, ["bucket"], _blocks_of(BLOCK_SKETCHES)).join(sketches, "id").groupBy("bucket", "x", "y").applyInArrow(maybe, "a long, b long"), "chances")
    if chances.limit(1).count():
        # Components that a possible link joins make a group; its members that met in such buckets are compared, but for what is one component already.
        groups = components(chances).select(F.col("id").alias("label"), F.col("component").alias("lead"))
        ends = stored(mixed.select("id", "label").distinct().join(groups, "label").join(sketches.select("id", "n"), "id"), "ends")
        dealt = _block_pairs(ends, ["lead"], _blocks_of(BLOCK_DOCS, BLOCK_SHINGLES)).drop("n")
        more = _verified(known, dealt, ["lead", "x", "y"], shingle, percent)
        labels = components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
        discard(ends)
    discard(members, pairs, counts, links, mixed, chances)

    # Empty sets take no part in the join: they would all meet in one key.
    linked = nodes.drop("sketch").join(labels, "id", "left").select("a", "b", "n", F.coalesce("component", "id").alias("component"))
    rows = base.select("doc_id", "n", "a", "b")
    out = rows.where("n > 0 and doc_id is not null").join(linked, ["a", "b", "n"]).select("doc_id", "n", "component")
    out = out.unionByName(rows.where("n = 0 or doc_id is null").select("doc_id", "n", F.lit(None).cast("bigint").alias("component")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component, of the document with the least doc_id; same columns.

    Of rows that share this id one stays, the one whose text sorts first.  Rows
    with a null id all stay.
    """
    name, row = fresh(docs.columns, "duplicate_id"), fresh(docs.columns, "row_of_id")
    found = stored(near_duplicates(docs, shingle, percent).select("doc_id", "kept"), "kept")
    own = docs["doc_id"].cast("bigint")
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct()
    kept = docs.join(gone, own == F.col(name), "left_anti")
    repeated = stored(found.where("kept and doc_id is not null").groupBy(F.col("doc_id").alias(name)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(name), "repeated")
    if repeated.limit(1).count():
        first = Window.partitionBy(own).orderBy("text", F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))
        several = kept.join(repeated, own == F.col(name), "left_semi").withColumn(row, F.row_number().over(first)).where(F.col(row) == 1)
        kept = kept.join(repeated, own == F.col(name), "left_anti").unionByName(several.drop(row))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
