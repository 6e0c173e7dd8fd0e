"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Each source's target is its weight's share of the wanted words, held to a
multiple of what the source has.  Words are apportioned to sources by highest
quotients and counted in blocks, all of a source of one size; then each source's
blocks go to groups of its shards and each group's to its shards by highest
quotients, so every quota is an integer.  Inside a shard the documents lie in a
seeded order, cut into blocks; every block is taken quota // blocks times, and
those that come first in a seeded order once more.  A document's share is what
the taken blocks hold of it.

Only sizes are shuffled, never texts.  Shards hold a bounded number of
documents, so a source with a third of all rows is spread like the rest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamdex.llm.common import fresh, keyed, stored, tasks
from loamdex.llm.textops import NOT_SPACE, blocks, runs

WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2.0
SEED = 20
#: Documents of a shard, about; blocks of the whole mix, about; and blocks of a shard at least, about (its source's blocks are smaller for it, down to a word).
SHARD_DOCS = 2_000
BLOCKS = 1 << 20
SHARD_BLOCKS = 256
#: Shards of a group, about: a source's blocks go to its groups first, then to a group's shards, so that no task sees all shards of a source.
GROUP_SHARDS = 1_000
#: Up to so many sources are apportioned on the driver, a row each; more of them in tables, with the same result.
DRIVER_SOURCES = 100_000
#: Divisors that one job tries.
TRIED = 24


def water_fill(sizes: np.ndarray, weights: np.ndarray, total: float, limit: float) -> np.ndarray:
    """Targets that share total by weight; none is above limit * size, and the excess is shared again by weight."""
    caps, targets, open_ = limit * sizes, np.zeros(len(sizes)), np.ones(len(sizes), bool)
    total = min(float(total), float(caps.sum()))
    while open_.any():
        level = (total - caps[~open_].sum()) / weights[open_].sum()
        over = open_ & (weights * level > caps)
        if not over.any():
            targets[open_] = weights[open_] * level
            break
        open_ &= ~over
    targets[~open_] = caps[~open_]
    return targets


def sainte_lague(votes: np.ndarray, seats: int, most: np.ndarray | None = None) -> np.ndarray:
    """Seats by the highest quotients votes / (2k + 1), none beyond most; ties go to the earlier entry.

    Seats come from a bisected divisor, then the last few one by one, so time
    does not grow with their number.
    """
    votes = np.asarray(votes, np.float64)
    most = np.full(len(votes), np.iinfo(np.int64).max // 4) if most is None else np.asarray(most, np.int64)
    most = np.where(votes > 0, most, 0)
    seats = int(min(seats, sum(most.tolist())))
    if seats <= 0:
        return np.zeros(len(votes), np.int64)

    def given(d: float) -> np.ndarray:
        return np.minimum(np.floor(votes / (2 * d) + 0.5), most).astype(np.int64)

    high, low = float(votes.max()) * 2, float(votes.max()) / (4.0 * seats + 4)
    while given(low).sum() < seats:
        low /= 16
    while low < (mid := (low + high) / 2) < high:
        if given(mid).sum() > seats:
            low = mid
        else:
            high = mid
    out = given(high)
    while (left := seats - int(out.sum())) > 0:
        quotients = np.where(out < most, votes / (2 * out + 1), -1.0)
        for i in np.argsort(-quotients, kind="stable")[: min(left, int((quotients >= quotients.max() * (1 - 1e-12)).sum()))]:
            out[i] += 1
    return out


def seeded(values: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each integer under a seed; the same everywhere and at every run."""
    h = values.astype(np.int64).view(np.uint64) + np.uint64((2 * seed + 1) * 0x9E3779B97F4A7C15 % 2**64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    return h ^ (h >> np.uint64(31))


def taken_words(sizes: np.ndarray, quota: int, block: int, order: np.ndarray) -> np.ndarray:
    """Words taken of each document of a shard, whose documents lie end to end and are cut into blocks.

    order ranks the blocks; the quota's whole rounds take all, its rest the first ones.
    """
    ends = np.cumsum(sizes)
    count = len(order)
    if not count:
        return np.zeros(len(sizes), np.int64)
    rounds, rest = divmod(quota, count)
    edges = np.minimum(np.arange(count + 1, dtype=np.int64) * block, int(ends[-1]))
    picked = np.zeros(count + 1, np.int64)
    chosen = np.zeros(count, bool)
    chosen[np.argsort(order, kind="stable")[:rest]] = True
    np.cumsum(np.where(chosen, np.diff(edges), 0), out=picked[1:])

    def before(at: np.ndarray) -> np.ndarray:  # words of chosen blocks before word `at` of the shard
        b = np.minimum(at // block, count - 1)
        return picked[b] + np.where(chosen[b], at - edges[b], 0)

    return rounds * sizes + before(ends) - before(ends - sizes)


def row_key(docs: DataFrame) -> Column:
    """A hash of id and text, by which documents are dealt and ordered: rows that share an id, or have none, are no one key."""
    of = {c.lower(): F.col(f"`{c}`") for c in docs.columns}
    return F.xxhash64(of["doc_id"].cast("bigint"), of["text"].cast("string"))


def word_counts(docs: DataFrame) -> DataFrame:
    """doc_id, source, key (a hash of id and text) and size: the number of `[^\\x20\\x09-\\x0D]+` in the text, 0 for null."""
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("key", pa.int64()), ("size", pa.int64())])

    def count(batches):
        for batch in batches:
            for block in blocks(batch.column(1)):
                starts, _ = runs(NOT_SPACE[block.data], block.offsets)
                sizes = np.diff(np.searchsorted(starts, block.offsets))
                own = [batch.column(i).slice(block.first, block.rows) for i in (0, 2, 3)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(sizes, pa.int64())], schema=schema)

    rows = keyed(docs, "source")
    return rows.withColumn("key", row_key(rows)).mapInArrow(count, "doc_id long, source string, key long, size long")


def _apportioned(sources: DataFrame, weights: tuple, share: float, limit: float) -> DataFrame:
    """sources (source, words, docs) with source_size, target and words_given (by highest quotients)."""
    rows = sorted(sources.collect(), key=lambda r: (r.source is None, r.source or ""))
    words = np.array([r.words for r in rows], np.float64)
    by_weight = np.array([weights[i % len(weights)] for i in range(len(rows))], np.float64)
    total = min(share * float(words.sum()), limit * float(words.sum()))
    targets = water_fill(words, by_weight, total, limit)
    given = sainte_lague(targets, round(total), np.array([int(limit * r.words) for r in rows], np.int64))
    kind = "source string, docs long, source_size long, target double, words_given long"
    return sources.sparkSession.createDataFrame([(r.source, r.docs, int(r.words), float(t), int(g)) for r, t, g in zip(rows, targets, given, strict=True)], kind)


def _apportioned_in_tables(sources: DataFrame, weights: tuple, share: float, limit: float) -> DataFrame:
    """The same, where the driver sees sums only: the level of the water, a divisor, and where ties are cut."""
    spark = sources.sparkSession
    order = F.col("source").asc_nulls_last()
    ranged = sources.repartitionByRange(tasks(spark), order).sortWithinPartitions(order).withColumn("at", F.monotonically_increasing_id())
    ranged = stored(ranged, "ranged").withColumn("part", F.shiftright("at", 33))
    before = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row a task
    before = before.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    rank = F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("before")
    held = ranged.join(F.broadcast(before), "part").select("source", "words", "docs", rank.alias("rank"))
    weight = F.get(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights)).cast("int"))
    held = held.select("*", weight.alias("weight"), (F.lit(limit) * F.col("words")).alias("cap"))
    whole = float(sources.agg(F.sum("words")).first()[0] or 0)
    total, level = min(share * whole, limit * whole), -1.0
    while True:  # each round shuts the sources that the level before fills
        shut = F.col("cap") < F.col("weight") * level
        caps, open_ = held.agg(F.sum(F.when(shut, F.col("cap"))), F.sum(F.when(~shut, F.col("weight")))).first()
        now = (total - (caps or 0.0)) / open_ if open_ else level
        if now <= level:
            break
        level = now
    full = F.col("cap") < F.col("weight") * level
    target = F.when(full, F.col("cap")).otherwise(F.col("weight") * level)
    most = F.when(target > 0, F.floor("cap")).otherwise(0).cast("bigint")
    held = stored(held.select("source", "docs", "rank", F.col("words").alias("source_size"), target.alias("target"), most.alias("most")), "targets")
    given = lambda d: F.least(F.floor(F.col("target") / (2 * d) + 0.5).cast("bigint"), F.col("most"))
    top, all_ = held.agg(F.max("target"), F.sum("most")).first()
    seats = min(round(total), all_ or 0)
    if seats <= 0:
        return held.select("source", "docs", "source_size", "target", F.lit(0).cast("bigint").alias("words_given"))
    high, low = top * 2, top / (4.0 * seats + 4)
    while held.agg(F.sum(given(low))).first()[0] < seats:
        low /= 16
    while mids := sorted({m for i in range(1, TRIED + 1) if low < (m := low + (high - low) * (i / (TRIED + 1))) < high} | ({m} if low < (m := (low + high) / 2) < high else set())):
        sums = held.agg(*(F.sum(given(m)) for m in mids)).first()
        over = [m for m, n in zip(mids, sums, strict=True) if n > seats]
        low, high = max([low, *over]), min([high, *(m for m in mids if m not in over)])
    held = held.withColumn("words_given", given(high))
    while (left := seats - held.agg(F.sum("words_given")).first()[0]) > 0:
        quotient = F.when(F.col("words_given") < F.col("most"), F.col("target") / (2 * F.col("words_given") + 1)).otherwise(-1.0)
        best = held.agg(F.max(quotient)).first()[0]
        tied = quotient >= best * (1 - 1e-12)
        first, last = held.where(tied).agg(F.count(F.lit(1)), F.max("rank")).first()
        low_rank, high_rank = -1, last  # of more ties than are left, the first by rank
        while first > left and high_rank - low_rank > 1:
            mid = (low_rank + high_rank) // 2
            if held.where(tied & (F.col("rank") <= mid)).count() < left:
                low_rank = mid
            else:
                high_rank = mid
        held = stored(held.withColumn("words_given", F.col("words_given") + (tied & (F.col("rank") <= high_rank)).cast("bigint")), "given")
    return held.select("source", "docs", "source_size", "target", "words_given")


def mix_sources(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, limit: float = LIMIT, seed: int = SEED) -> DataFrame:
    """doc_id, source, key, size, source_size, target and taken of each document.

    size counts the text's words.  Sources, in code-point order, null last,
    have the weights in turn; they share `share` times all words, and a target
    stops at `limit` times its source's words, the excess shared again by
    weight.  taken is the number of the document's words in the mix, repeats
    counted: at most ceil(limit) times size.  A source's words come to its
    target within about half a block and the odd-sized last blocks of its shards; a
    block is about a millionth of the mix, but at most about 1 / SHARD_BLOCKS of
    what the source's shards have on average, and at least a word.  Null and empty texts have size 0
    and are not taken; rows with equal ids are documents of their own, which are
    dealt by a hash of id and text; ids may be null.  Reruns agree.  An empty table gives no rows.
    """
    sizes = stored(word_counts(docs), "sizes")
    sources = stored(sizes.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs")), "sources")
    few = sources.count() <= DRIVER_SOURCES
    table = (_apportioned if few else _apportioned_in_tables)(sources, weights, share, limit)
    # Blocks of each source: about a millionth of the mix, smaller for small sources.
    whole = sources.agg(F.sum("words")).first()[0] or 0
    shards = F.ceil(F.col("docs") / SHARD_DOCS).cast("bigint")
    own = F.floor(F.col("source_size") / F.greatest(F.lit(1), SHARD_BLOCKS * F.col("shards"))).cast("bigint")
    block = F.greatest(F.lit(1), F.least(F.lit(int(share * whole) // BLOCKS), own)).cast("bigint")
    table = table.withColumn("shards", shards).withColumn("block", block)
    quota = F.floor((F.col("words_given") + F.floor(F.col("block") / 2)) / F.col("block")).cast("bigint")
    table = table.select(F.col("source").alias("named"), "source_size", "target", quota.alias("quota"), "shards", "block")
    table = F.broadcast(table) if few else stored(table, "quotas")
    shard = F.pmod(F.xxhash64("key", F.lit(seed)), F.col("shards"))
    dealt = sizes.join(table, sizes.source.eqNullSafe(table.named))
    dealt = dealt.select("doc_id", "source", "key", "size", "source_size", "target", "quota", "shards", "block", shard.alias("shard"))

    def apportion(part: pa.Table) -> pa.Table:
        """The quota of the rows' source or group, by the words of each row."""
        part = part.sort_by("key")
        held, block = part["words"].to_numpy(), part["block"][0].as_py()
        given = sainte_lague(held, part["quota"][0].as_py(), int(np.ceil(limit)) * -(-held // block))
        return pa.table({"named": part["source"], "of": part["key"], "given": pa.array(given, pa.int64())})

    kind = "named string, of long, given long"
    shards = dealt.groupBy("source", "shard", "shards", "quota", "block").agg(F.sum("size").alias("words"))
    shards = stored(shards.withColumn("group", F.pmod("shard", F.ceil(F.col("shards") / GROUP_SHARDS))).drop("shards"), "shards")
    groups = shards.groupBy("source", "group", "quota", "block").agg(F.sum("words").alias("words")).withColumnRenamed("group", "key")
    groups = groups.groupBy("source").applyInArrow(apportion, kind)
    inside = shards.drop("quota").join(groups, shards.source.eqNullSafe(groups.named) & (shards.group == groups.of))
    inside = inside.select("source", "group", F.col("shard").alias("key"), "words", "block", F.col("given").alias("quota"))
    quotas_of = inside.groupBy("source", "group").applyInArrow(apportion, kind).withColumnRenamed("given", "shard_quota")
    full = dealt.join(quotas_of, dealt.source.eqNullSafe(quotas_of.named) & (dealt.shard == quotas_of.of)).drop("named", "of", "quota", "shards")

    def take(part: pa.Table) -> pa.Table:
        keys, size = part["key"].to_numpy(), part["size"].to_numpy()
        order = np.lexsort((size, keys, seeded(keys, seed)))
        part, size, block = part.take(pa.array(order)), size[order], part["block"][0].as_py()
        number = int(-(-size.sum() // block))
        ranks = seeded(np.arange(number) + part["shard"][0].as_py() * 1_000_003, seed + 1)
        taken = taken_words(size, part["shard_quota"][0].as_py(), block, ranks)
        return part.drop_columns(["shard", "shard_quota", "block"]).append_column("taken", pa.array(taken, pa.int64()))

    return full.groupBy("source", "shard").applyInArrow(take, "doc_id long, source string, key long, size long, source_size long, target double, taken long")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs that the mix takes words of, with size, target and taken (columns of these names are replaced).

    Options are those of mix_sources().  Rows that share id, source and text
    share what the mix takes of them equally (less than a word a row is lost).
    """
    own, (source, key, size, target, taken) = {c.lower(): c for c in docs.columns}, (fresh(docs.columns, f"mix_{c}") for c in ("source", "key", "size", "target", "taken"))
    share = F.floor(F.sum("taken") / F.count(F.lit(1))).cast("bigint")
    mix = mix_sources(docs, **options).groupBy(F.col("source").alias(source), F.col("key").alias(key)).agg(F.max("size").alias(size), F.max("target").alias(target), share.alias(taken))
    names = [c for c in docs.columns if c.lower() not in ("size", "target", "taken")]
    of = docs[own["source"]].cast("string") if "source" in own else F.lit(None).cast("string")
    joined = docs.join(mix.where(F.col(taken) > 0), (row_key(docs) == F.col(key)) & of.eqNullSafe(F.col(source)))
    return joined.select(*(F.col(f"`{c}`") for c in names), F.col(size).alias("size"), F.col(target).alias("target"), F.col(taken).alias("taken"))
