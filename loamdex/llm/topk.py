"""Exact top-k search by inner product: cover trees over queries and data, traversed together.

Components become integers floor(1024 x), so scores are exact.  The top of the
tree is built on a bounded sample: its points are the centres of cells, every
vector goes to its nearest one, and large cells are split into blocks of
bounded size.  A block builds the rest of the tree on its own vectors.

1. Each query is searched in one block of its own cell, which gives it a first
   kth score.
2. A query goes on to the other blocks whose cell may still hold a better
   score: <q, p> <= <q, c> + r |q| for a cell of centre c and radius r.
3. A task gets queries and data of one block, builds a cover tree on both, and
   walks them together from the most promising nodes on.  Node pairs are pruned
   when <cq, cp> + rq |cp| + rp |cq| + rq rp is below the worst kth score of the
   query node's group, which starts with the scores of the first round.

The best k of each query are merged by a window; only the sample, and a row a
cell, ever meet on the driver.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamdex.llm.common import stored

SCALE = 1024
#: Components of a block of data and of queries (about); vectors of a leaf of data, and of one of queries (small groups prune more).
DATA_VALUES, QUERY_VALUES, LEAF, QUERY_LEAF = 1 << 19, 1 << 16, 96, 8
#: Components of the sample that cells are made from (about); cells at most; lengths of vectors that get cells of their own (others share the cell around 0).
SAMPLE_VALUES, CELLS, LENGTHS = 1 << 19, 256, 64
#: From this bound of scores on, doubles round: candidates are scored again in exact integers.
EXACT_BELOW = 2.0**52


@dataclass
class Node:
    """A ball of 2^level: rows of the block within radius of the centre, one of them.  The children's balls, as arrays, stand beside them."""

    rows: np.ndarray
    centre: np.ndarray
    norm: float
    radius: float
    level: int
    children: list[Node] = field(default_factory=list)
    worst: float = -np.inf

    def adopt(self, children: list[Node]) -> Node:
        self.children = children
        self.centres = np.stack([c.centre for c in children])
        self.norms, self.radii = (np.array([getattr(c, name) for c in children]) for name in ("norm", "radius"))
        self.leaves = np.array([not c.children for c in children])
        return self


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0))


def net(points: np.ndarray, apart: float, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Rows that lie more than `apart` from each other, so that every point is within it of one, and each point's nearest of them.  The first row is in it."""
    nearest, label = np.full(len(points), np.inf), np.zeros(len(points), np.int64)
    picked: list[int] = []
    todo = np.arange(len(points))
    while len(todo):
        some = todo[:step]
        far, free, new = _apart(points[some], points[some]) > apart, np.ones(len(some), bool), []
        for i in range(len(some)):
            if free[i]:
                new.append(i)
                free &= far[i]
        away = _apart(points, points[some[new]])
        best = away.argmin(axis=1)
        reach = away[np.arange(len(points)), best]
        reach[some[new]], best[some[new]] = 0.0, np.arange(len(new))
        closer = reach < nearest
        label[closer], nearest[closer] = len(picked) + best[closer], reach[closer]
        picked += some[new].tolist()
        todo = todo[nearest[todo] > apart]
    return np.array(picked, np.int64), label


def cover_tree(points: np.ndarray, rows: np.ndarray | None = None, leaf: int = 1) -> Node:
    """A cover tree.  A node of level l covers its points within 2^l; its children are centred on a net of these points:

    more than 2^(l-1) from each other, and every point within that of its child's
    centre.  The node's own centre is a child's.  Levels between which nothing
    splits are left out, and `leaf` points or fewer stay together.
    """
    if rows is None:
        mean = ((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin()
        rows = np.concatenate([[mean], np.delete(np.arange(len(points)), mean)])
    centre = points[rows[0]]
    radius = float(np.sqrt(((points[rows] - centre) ** 2).sum(axis=1)).max())
    level = int(np.ceil(np.log2(radius))) if radius > 0 else -1
    node = Node(rows, centre, float(np.sqrt((centre**2).sum())), radius, level)
    if len(rows) <= leaf or radius == 0:
        return node
    picked, label = net(points[rows], 2.0 ** (level - 1))
    order = np.argsort(label, kind="stable")
    cuts = np.searchsorted(label[order], np.arange(len(picked) + 1))
    parts = []
    for i, first in enumerate(picked.tolist()):
        own = order[cuts[i] : cuts[i + 1]]
        parts.append(cover_tree(points, rows[np.concatenate([[first], own[own != first]])], leaf))
    return node.adopt(parts)


def _floor(score: int | None) -> float:
    """A kth score as a bound; the least score may stand for any lower one."""
    return -np.inf if score is None or score <= -(2**63) else float(score)


class Search:
    """The best k of each query so far; ties go to the smaller id.  Scores below a query's floor are of no use."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int, floors: np.ndarray | None = None):
        self.queries, self.query_ids, self.data, self.ids, self.k = queries, query_ids, data, ids, k
        self.scores = np.full((len(queries), k), -np.inf)
        self.best = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.floors = np.full(len(queries), -np.inf) if floors is None else floors
        reach = float(np.abs(queries).max()) * float(np.abs(data).max()) * data.shape[1]
        #: What a score in doubles may be off; exact integer scores of each query's best, where that is needed.
        self.error = 0.0 if reach < EXACT_BELOW else reach * 2.0**-48
        self.exact: list[list[tuple[int, int]]] = [[] for _ in queries] if self.error else []

    def least(self, rows: np.ndarray) -> np.ndarray:
        out = np.maximum(self.scores[rows, -1], self.floors[rows]) - self.error
        return np.where(out <= -(2.0**63), -np.inf, out) if self.error else out

    def base(self, q: Node, rows: np.ndarray) -> None:
        """A leaf of queries against rows of the data."""
        found = self.queries[q.rows] @ self.data[rows].T
        found[self.query_ids[q.rows][:, None] == self.ids[rows][None, :]] = -np.inf
        found[found < self.least(q.rows)[:, None]] = -np.inf
        some = np.isfinite(found)
        if self.error:
            for i, j in zip(*(x.tolist() for x in np.nonzero(some)), strict=True):
                score = sum(int(a) * int(b) for a, b in zip(self.queries[q.rows[i]], self.data[rows[j]], strict=True))
                held = self.exact[q.rows[i]]
                held.append((-min(max(score, -(2**63)), 2**63 - 1), int(self.ids[rows[j]])))
                held.sort()
                del held[self.k :]
                self.scores[q.rows[i], : len(held)] = [-float(s) for s, _ in held]
        elif some.any():
            rows, found = rows[some.any(axis=0)], found[:, some.any(axis=0)]
            scores = np.concatenate([self.scores[q.rows], found], axis=1)
            ids = np.concatenate([self.best[q.rows], np.broadcast_to(self.ids[rows], found.shape)], axis=1)
            order = np.lexsort((ids, -scores), axis=1)[:, : self.k]
            self.scores[q.rows] = np.take_along_axis(scores, order, axis=1)
            self.best[q.rows] = np.take_along_axis(ids, order, axis=1)
        q.worst = float(self.least(q.rows).min())

    def worst(self, q: Node) -> float:
        """The worst kth score of a group of queries."""
        if q.children:
            return min(self.worst(c) for c in q.children)
        if q.worst == -np.inf:
            q.worst = float(self.least(q.rows).min())
        return q.worst

    def bounds(self, q: Node, over: Node, which: np.ndarray) -> np.ndarray:
        """What no pair of q and of these children exceeds.  Half a unit of slack covers rounding, as scores are integers."""
        out = over.centres[which] @ q.centre + q.radius * over.norms[which] + over.radii[which] * (q.norm + q.radius)
        return out + 0.5 + 1e-9 * np.abs(out) + self.error

    def walk(self, q: Node, p: Node) -> None:
        """Best first over pairs of a query node and some children of a data node; the larger ball is split first."""
        root = Node(p.rows, p.centre, p.norm, p.radius, p.level).adopt([p])
        turn, heap = 0, [(-np.inf, 0, q, root, np.array([0]))]
        while heap:
            minus, _, q, over, which = heapq.heappop(heap)
            bounds, worst = self.bounds(q, over, which), self.worst(q)
            kept = bounds >= worst
            which, bounds = which[kept], bounds[kept]
            if not len(which):
                continue
            leaves = over.leaves[which]
            next_ = []
            if q.children and not (len(which[~leaves]) and over.radii[which[~leaves]].max() > q.radius):
                next_ += [(a, over, which, bounds.max()) for a in q.children]
            else:
                for i, bound in zip(which[~leaves].tolist(), bounds[~leaves].tolist(), strict=True):
                    child = over.children[i]
                    next_.append((q, child, np.arange(len(child.children)), bound))
                if leaves.any() and q.children:
                    next_ += [(a, over, which[leaves], bounds[leaves].max()) for a in q.children]
                elif leaves.any():
                    self.leaves(q, over, which[leaves], bounds[leaves])
            for a, node, part, bound in next_:
                turn += 1
                heapq.heappush(heap, (-float(bound), turn, a, node, part))

    def leaves(self, q: Node, over: Node, which: np.ndarray, bounds: np.ndarray) -> None:
        order, at, step = np.argsort(-bounds, kind="stable"), 0, 64
        while at < len(order) and bounds[order[at]] >= self.worst(q):
            some = which[order[at : at + step]]
            self.base(q, np.concatenate([over.children[i].rows for i in some.tolist()]))
            at, step = at + step, 4 * step

    def found(self) -> tuple[np.ndarray, list[int], list[int]]:
        """Query rows, ids and scores."""
        if self.error:
            all_ = [(i, j, -s) for i, held in enumerate(self.exact) for s, j in held]
            return np.array([i for i, _, _ in all_], np.int64), [j for _, j, _ in all_], [s for _, _, s in all_]
        q, j = np.nonzero(np.isfinite(self.scores))
        return q, self.best[q, j].tolist(), self.scores[q, j].astype(np.int64).tolist()


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = pa.concat_arrays(values.chunks) if isinstance(values, pa.ChunkedArray) else values
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1) if len(values) else np.zeros((0, 0))


def best_pairs(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int, floors: np.ndarray | None = None) -> tuple[np.ndarray, list[int], list[int]]:
    """(query row, id, score) of each query's best k of the data, itself left out; all integers, those below its floor left out."""
    if not len(queries) or not len(data):
        return np.zeros(0, np.int64), [], []
    search = Search(queries.astype(np.float64), query_ids, data.astype(np.float64), ids, k, floors)
    search.walk(cover_tree(search.queries, leaf=QUERY_LEAF), cover_tree(search.data, leaf=LEAF))
    return search.found()


def _centres(sample: pa.Table, share: float) -> dict[int, np.ndarray]:
    """Centres of cells by the length of vectors: farthest points of the sample, one for each block that the data may need, CELLS at most."""
    dims = sample["dim"].to_numpy()
    lengths, often = np.unique(dims, return_counts=True)
    out = {}
    for dim, n in sorted(zip(lengths.tolist(), often.tolist(), strict=True), key=lambda x: (-x[1], x[0]))[:LENGTHS]:
        points = _vectors(sample.filter(pa.array(dims == dim))["x"])
        points = points[np.lexsort(points.T)]
        picked = [int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())]
        nearest = ((points - points[picked[0]]) ** 2).sum(axis=1)
        while len(picked) < min(CELLS, -(-int(n / share) * dim // DATA_VALUES)) and nearest.max() > 0:
            picked.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, ((points - points[picked[-1]]) ** 2).sum(axis=1))
        out[dim] = points[picked]
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: each query's k highest integer inner products with other rows.

    is_query is a condition on the id column.  Components x become
    floor(scale * x), x as double.  Vectors that are null or empty, or hold null
    or non-finite components, and rows with a null id, take no part.  Vectors of
    different lengths are only compared with their like.  Ties go to the smaller
    id; a query with fewer than k candidates gets them all; rows with the
    query's own id are never its results.  Rows that repeat an id and a vector
    (of integers) are one row; other vectors of an id are rows of their own, and
    a query id with several of them gets the best of all.  Scores that 64 bits
    cannot hold count as the nearest that they can.  No queries, or an empty
    table: no rows.

    Cells come from about SAMPLE_VALUES components of the vectors, chosen by a
    hash of the id; they only steer the search, every row is searched.
    """
    own = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    own = own.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & finite)
    own = own.select("vec_id", F.transform("x", lambda x: F.floor(x * scale).cast("double")).alias("x"), F.size("x").alias("dim"))
    share = min(1.0, SAMPLE_VALUES / max(1, own.agg(F.sum(F.col("dim").cast("bigint"))).first()[0] or 0))
    deal = lambda c, seed, to: F.pmod(F.xxhash64(c, F.lit(seed)), to).cast("int")
    sample = own.where(deal("vec_id", 5, F.lit(1 << 20)) < share * (1 << 20)).select("x", "dim").toArrow()
    spark, centres = vectors.sparkSession, _centres(sample, share)
    shared = spark.sparkContext.broadcast(centres)

    def nearest(batches):
        """The cell and the distance from its centre; lengths without cells have one around 0."""
        held = shared.value
        for batch in batches:
            dims = batch.column(2).to_numpy()
            cells, away = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                points = _vectors(batch.column(1).take(pa.array(rows)))
                around = held.get(dim, np.zeros((1, dim)))
                cells[rows] = _apart(points, around).argmin(axis=1)
                away[rows] = np.sqrt(((points - around[cells[rows]]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells), pa.array(away)], names=["vec_id", "x", "dim", "cell", "away"])

    kind = "vec_id long, x array<double>, dim int"
    dealt = stored(own.dropDuplicates(["vec_id", "x"]).mapInArrow(nearest, f"{kind}, cell int, away double"), "vectors")
    counts = dealt.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("asked"), F.max("away").alias("radius"))
    blocks = F.ceil(F.col("n") * F.col("dim") / DATA_VALUES).cast("int")
    cells = stored(counts.select("dim", "cell", "asked", "radius", blocks.alias("blocks")), "cells")
    radii = {(r.dim, r.cell): r.radius for r in cells.where(F.col("dim").isin(list(centres))).collect()}
    limits = spark.sparkContext.broadcast({dim: np.array([radii.get((dim, j), -np.inf) for j in range(len(c))]) for dim, c in centres.items()})
    keys = ["dim", "cell", "block", "chunk"]
    of_rows = dealt.select("vec_id", "x", "dim", "cell")

    def data(chunks: DataFrame):
        """All rows of the cells in chunks (dim, cell, blocks, chunks), by block, for each chunk of queries."""
        every = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("in_chunk")
        # Names of their own, as both sides come from one table.
        of_block = deal("vec_id", 3, F.col("blocks")).alias("in_block")
        rows = of_rows.join(chunks, ["dim", "cell"]).select("vec_id", F.col("x").alias("y"), F.col("dim").alias("in_dim"), F.col("cell").alias("in_cell"), of_block, every)
        return rows.groupBy("in_dim", "in_cell", "in_block", "in_chunk")

    # First round: each query in one block of its own cell.
    asked = F.ceil(F.col("asked") * F.col("dim") / F.col("blocks") / QUERY_VALUES).cast("int")
    home = cells.where("asked > 0").select("dim", "cell", "blocks", asked.alias("chunks"))
    left = of_rows.where(is_query).join(home, ["dim", "cell"])
    left = left.select(F.col("vec_id").alias("query_id"), "x", "dim", "cell", deal("vec_id", 1, F.col("blocks")).alias("block"), deal("vec_id", 2, F.col("chunks")).alias("chunk"))

    def search(a: pa.Table, b: pa.Table, floors: np.ndarray | None = None) -> tuple[np.ndarray, list[int], list[int]]:
        return best_pairs(_vectors(a["x"]), a["query_id"].to_numpy(), _vectors(b["y"]), b["vec_id"].to_numpy(), k, floors)

    def first(a: pa.Table, b: pa.Table) -> pa.Table:
        best: list[list[dict]] = [[] for _ in range(a.num_rows)]
        for i, j, s in zip(*search(a, b), strict=True):
            best[i].append({"vec_id": j, "score": s})
        return a.drop_columns(["chunk"]).append_column("best", pa.array(best, pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.int64())]))))

    best = "best array<struct<vec_id:long,score:long>>"
    near = left.groupBy(*keys).cogroup(data(home)).applyInArrow(first, f"query_id long, x array<double>, dim int, cell int, block int, {best}")

    def ranked(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    laid_out = lambda rows: rows.select("query_id", F.explode("best").alias("b")).select("query_id", "b.vec_id", "b.score")
    if cells.groupBy("dim").agg(F.sum("blocks").alias("blocks")).where("blocks > 1").limit(1).count() == 0:
        return ranked(laid_out(near))  # one block a length: the first round has seen all

    def route(batches):
        """The kth score so far (null: fewer than k), and the cells that may hold a better one."""
        held, reach = shared.value, limits.value
        for batch in batches:
            floors = [min(s["score"] for s in own) if len(own) >= k else None for own in batch.column(5).to_pylist()]
            to = []
            for q, dim, floor in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), floors, strict=True):
                if dim not in held:
                    to.append([0])
                    continue
                q, around = np.array(q), held[dim]
                live, radius, norm = np.isfinite(reach[dim]), np.maximum(reach[dim], 0), float(np.sqrt(q @ q)) if len(q) else 0.0
                rounding = 0.5 + 1e-9 * norm * (radius + np.sqrt((around**2).sum(axis=1)))
                bounds = around @ q + radius * norm + rounding
                to.append(np.flatnonzero(live & (bounds >= _floor(floor))).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floors, pa.int64()), pa.array(to, pa.list_(pa.int32()))], names=[*batch.schema.names, "floor", "to"])

    routed = stored(near.mapInArrow(route, f"query_id long, x array<double>, dim int, cell int, block int, {best}, floor long, to array<int>"), "routed")

    # Second round: each query in all other blocks that may matter.
    visits = routed.select("dim", F.explode("to").alias("cell")).groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("visits"))
    chunks = F.ceil(F.col("visits") * F.col("dim") / QUERY_VALUES).cast("int")
    wanted = stored(visits.join(cells, ["dim", "cell"]).select("dim", "cell", "blocks", chunks.alias("chunks")), "visits")
    left = routed.select("query_id", "x", "dim", "floor", F.col("cell").alias("home"), F.col("block").alias("met"), F.explode("to").alias("cell"))
    left = left.join(wanted, ["dim", "cell"]).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), deal("query_id", 2, F.col("chunks")).alias("chunk"))
    left = left.where("cell <> home or block <> met").select("query_id", "x", "floor", *keys)

    def further(a: pa.Table, b: pa.Table) -> pa.Table:
        floors = np.array([_floor(s) for s in a["floor"].to_pylist()])
        rows, ids, scores = search(a, b, floors)
        return pa.table({"query_id": a["query_id"].to_numpy()[rows], "vec_id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.int64())})

    far = left.groupBy(*keys).cogroup(data(wanted)).applyInArrow(further, "query_id long, vec_id long, score long")
    return ranked(laid_out(routed).unionByName(far))
