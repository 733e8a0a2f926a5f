"""Approximate nearest neighbours: a forest of random-projection trees, a priority queue shared by the trees, and exact reranking.

A node of a tree has a centre and up to CELLS directions, each the difference of two random members of the node; a vector goes to the child whose direction its
offset from the centre projects on farthest. The forest is fitted on a sample of SAMPLE rows at most (all rows where there are no more), down to cells that hold few
of them; every row is indexed: it falls to one leaf of each tree. A leaf that holds more than GROUP rows is split on by further random directions about its own
centre, so that leaves stay bounded in rows as the table grows.

A query has one queue for all trees. A node's place in it is the sum, over its ancestors, of the square of what the query's projection falls short of the
farthest one; the nearest nodes are opened first, until their leaves hold `enough` entries. How many are enough is measured, not set: for PROBES queries (a bounded
number) the true neighbours are found by brute force over all rows, and `enough` is the least number of entries within which the share TARGET of them lies. So the
candidates of a query depend on how well the data separate: few for data with clusters or of low dimension, many for data without structure.

Equal vectors are one entry, with the k + 1 smallest of their ids, and no query needs more of them; equal queries are searched once. Queries and rows meet at their
leaves, where distances are computed on the original vectors in double precision, the rows of a leaf streaming past its queries.

Defined results: vectors that are null, zero, of another size than most, or that hold null or non-finite components take no part, as rows or as queries, and neither do rows
with a null id; of rows with the same id, each is a candidate, and the nearest stands for the id; repeated rows are one row; ties go to the smaller id; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papertide.functions.runtime import checkpoint
from papertide.llm.spans import over_batches

TREES, CELLS, SAMPLE, GROUP = 10, 1024, 60_000, 8192
#: Sample rows for each direction of a node, and those that a leaf holds at most (where its vectors differ).
PER_CELL, IN_LEAF = 8, 128
#: Queries for which the true neighbours are found, and the share of these that the budget must reach.
PROBES, TARGET = 128, 0.95
#: Numbers held at once by a block of distances.
BLOCK = 1 << 21


def _single(x: np.ndarray) -> np.ndarray:
    """For the forest alone: single precision, drawn in to where projections and their squares stay finite."""
    return np.clip(x, -1e15, 1e15).astype(np.float32)


@dataclass
class Forest:
    """All trees. node: centre, first direction and number of directions; child of each direction: a node, or leaf -1 - child. roots: first nodes.
    Leaves have the centre of their members; `fine` are the directions that split a large leaf further."""

    centre: np.ndarray
    first: np.ndarray
    width: np.ndarray
    direction: np.ndarray
    child: np.ndarray
    roots: list[int]
    leaf_centre: np.ndarray
    fine: np.ndarray

    @property
    def leaves(self) -> int:
        return len(self.leaf_centre)

    def reach(self, node: int, x: np.ndarray) -> np.ndarray:
        """How far vectors project on each direction of a node."""
        return (x - self.centre[node]) @ self.direction[self.first[node] : self.first[node] + self.width[node]].T

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        out = np.empty((len(x), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            node = np.full(len(x), root, np.int64)
            while len(open_ := np.flatnonzero(node >= 0)):
                for n in np.unique(node[open_]).tolist():
                    at = open_[node[open_] == n]
                    node[at] = self.child[self.first[n] + self.reach(n, x[at]).argmax(axis=1)]
            out[:, t] = -1 - node
        return out

    def cells(self, x: np.ndarray, splits: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree, with its part in the upper 32 bits. splits: parts of each leaf."""
        leaf = self.leaf_of(x)
        for t in range(leaf.shape[1]):
            of = leaf[:, t]
            if len(at := np.flatnonzero(splits[of] > 1)):
                far = (x[at] - self.leaf_centre[of[at]]) @ self.fine.T
                far[np.arange(len(self.fine)) >= splits[of[at]][:, None]] = -np.inf
                leaf[at, t] |= far.argmax(axis=1).astype(np.int64) << 32
        return leaf

    def search(self, q: np.ndarray, size: np.ndarray, splits: np.ndarray, enough: float) -> tuple[np.ndarray, np.ndarray]:
        """The leaves (with parts) that the shared queue opens for a query until they hold `enough` entries, in order, and the entries held up to each.

        The queue is an array kept in order: all nodes before the place where the entries are enough are opened together, which brings that place nearer,
        until there are only leaves before it.
        """
        q = _single(q)
        node = np.array(self.roots, np.int64)
        owed, what, held = np.zeros(len(node)), np.where(node >= 0, node, -1 - node), np.zeros(len(node))
        kind = np.where(node >= 0, 1, 0)  # 0: a leaf, 1: a node, 2: a large leaf
        kind[(kind == 0)] = np.where(splits[what[kind == 0]] > 1, 2, 0)
        held = np.where(kind == 0, size[np.where(kind == 0, what, 0)], 0.0) if len(size) else held
        while True:
            order = np.argsort(owed, kind="stable")
            owed, what, held, kind = owed[order], what[order], held[order], kind[order]
            upto = np.cumsum(held)
            end = int(np.searchsorted(upto, enough)) + 1
            inner = np.flatnonzero(kind[:end])
            if not len(inner):
                return what[:end], upto[:end]
            new = []
            for i in inner.tolist():
                if kind[i] == 1:
                    n = int(what[i])
                    far = self.reach(n, q[None])[0]
                    to = self.child[self.first[n] : self.first[n] + self.width[n]]
                    leaf = np.where(to < 0, -1 - to, 0)
                    sort = np.where(to >= 0, 1, np.where(splits[leaf] > 1, 2, 0))
                    new.append((owed[i] + np.square(far.max() - far), np.where(to >= 0, to, leaf), np.where(sort == 0, size[leaf], 0.0), sort))
                else:
                    n = int(what[i])
                    far = self.fine[: splits[n]] @ (q - self.leaf_centre[n])
                    new.append((owed[i] + np.square(far.max() - far), n | np.arange(splits[n]) << 32, np.full(splits[n], size[n] / splits[n]), np.zeros(splits[n], np.int64)))
            kept = np.ones(len(owed), bool)
            kept[inner] = False
            owed, what, held, kind = (np.concatenate([a[kept], *b]) for a, b in zip((owed, what, held, kind), zip(*new, strict=True), strict=True))


def grow(sample: np.ndarray, rows: int, trees: int = TREES, seed: int = 5) -> Forest:
    """The forest for a sample of the distinct vectors of a table of so many rows."""
    rng, x = np.random.default_rng(seed), np.ascontiguousarray(_single(sample))
    dim = x.shape[1] if x.ndim == 2 else 0
    centre, first, width, direction, child, roots, leaf_centre, used = [], [], [], [], [], [], [], 0
    scale = max(1.0, rows / max(1, len(x)))

    def unit(at: np.ndarray, n: int) -> np.ndarray:
        d = x[rng.choice(at, n)] - x[rng.choice(at, n)]
        size = np.linalg.norm(d, axis=1)
        return d[size > 0] / size[size > 0, None]

    for _ in range(trees):
        todo: list[tuple[np.ndarray, int]] = [(np.arange(len(x)), -1)]
        while todo:
            at, place = todo.pop()
            lines = np.zeros((0, dim), np.float32)
            if len(at) > 1 and (place < 0 or len(at) > IN_LEAF):
                lines = unit(at, int(min(CELLS, max(2, len(at) * (scale if place < 0 else 1) // PER_CELL))))
            if len(lines) > 1:
                middle = x[at].mean(axis=0)
                to = ((x[at] - middle) @ lines.T).argmax(axis=1)
                if (to == to[0]).all():
                    lines = lines[:0]
            if len(lines) > 1:
                node = len(first)
                centre.append(middle)
                first.append(used)
                width.append(len(lines))
                direction.append(lines)
                order = np.argsort(to, kind="stable")
                bound = np.searchsorted(to[order], np.arange(len(lines) + 1))
                child.append(np.zeros(len(lines), np.int64))
                todo += [(at[order[bound[k] : bound[k + 1]]], used + k) for k in range(len(lines))]
                used += len(lines)
                made = node
            else:
                made = -1 - len(leaf_centre)
                leaf_centre.append(x[at].mean(axis=0) if len(at) else np.zeros(dim, np.float32))
            if place < 0:
                roots.append(made)
            else:
                at_node = int(np.searchsorted(first, place, side="right")) - 1
                child[at_node][place - first[at_node]] = made
    stack = lambda parts, shape: np.concatenate(parts).astype(np.float32) if parts else np.zeros(shape, np.float32)
    fine = rng.standard_normal((CELLS, dim)).astype(np.float32)
    fine /= np.maximum(np.linalg.norm(fine, axis=1, keepdims=True), 1e-30)
    return Forest(
        np.array(centre, np.float32).reshape(len(centre), dim), np.array(first, np.int64), np.array(width, np.int64), stack(direction, (0, dim)), np.concatenate(child) if child else np.zeros(0, np.int64), roots,
        np.array(leaf_centre, np.float32).reshape(len(leaf_centre), dim), fine,
    )


def budget(forest: Forest, size: np.ndarray, splits: np.ndarray, probes: np.ndarray, truth: list[np.ndarray], target: float = TARGET) -> float:
    """The least number of entries within which the share `target` of the probes' true neighbours lies. truth: for each probe, its neighbours' vectors."""
    need = []
    for q, near in zip(probes, truth, strict=True):
        what, upto = forest.search(q, size, splits, float("inf"))
        order = np.argsort(what)
        at = order[np.searchsorted(what[order], forest.cells(_single(near), splits))]
        need.append(upto[at].min(axis=1))
    return float(np.quantile(np.concatenate(need), target, method="higher")) if need else 0.0


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def _closest(far: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    """The places of the k lowest distances of different names, ties by the smaller name."""
    if len(far) > 4 * k:
        at = np.flatnonzero(far <= np.partition(far, 2 * k - 1)[2 * k - 1])
        if len(np.unique(names[at])) < k:
            at = np.arange(len(far))
    else:
        at = np.arange(len(far))
    at = at[np.lexsort((names[at], far[at]))]
    return at[np.sort(np.unique(names[at], return_index=True)[1])][:k]


def _distances(queries: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All distances; where squares are too large or too small for doubles, of vectors scaled by their largest difference."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        far = np.sqrt(np.square(queries[:, None, :] - x[None]).sum(axis=2))
        for i, j in zip(*np.nonzero(~((far > 1e-140) & (far < 1e150))), strict=True):
            off = queries[i] / 2 - x[j] / 2
            if most := np.abs(off).max(initial=0.0):
                far[i, j] = 2 * most * np.sqrt(np.square(off / most).sum())
    return far


def _met(queries: np.ndarray, labels: np.ndarray, batch: pa.Table, dim: int, k: int) -> Iterator[pa.Table]:
    """query, vec_id and score of the k nearest of a batch of entries (ids, v) for each of the queries."""
    ids = batch["ids"].combine_chunks()
    names, owner = ids.flatten().to_numpy(), np.repeat(np.arange(len(ids)), ids.value_lengths().to_numpy())
    x, step = _matrix(batch["v"].combine_chunks(), dim), max(1, BLOCK // max(1, len(ids) * dim))
    for lo in range(0, len(queries), step):
        far = _distances(queries[lo : lo + step], x)[:, owner]
        at = [_closest(f, names, k) for f in far]
        flat = np.concatenate(at)
        own = np.repeat(np.arange(len(at)), [len(a) for a in at])
        yield pa.table([pa.array(labels[lo : lo + step][own]), pa.array(names[flat]), pa.array(far[own, flat])], ["query", "vec_id", "score"])


def nearest(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 10, every: int = 100, trees: int = TREES, sample: int = SAMPLE, group: int = GROUP, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of the k nearest found of each row whose id is divisible by `every`."""
    spark = vectors.sparkSession
    kind = vectors.schema[vector].dataType.elementType.typeName()
    kind = kind if kind == "float" else "double"
    v = F.col(vector).cast(f"array<{kind}>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"), F.size(v).alias("dim")).where(F.col("vec_id").isNotNull() & good)
    sizes = rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").take(1)
    dim = sizes[0].dim if sizes else 0
    rows = rows.where(F.col("dim") == dim).select("vec_id", "v").distinct()
    # Both steps combine before they shuffle, so a vector that many rows have is no large group.
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    entries = checkpoint(rows.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select("ids", "v"))
    asking = rows.where(F.pmod(F.col("vec_id"), F.lit(every)) == 0)
    asked = checkpoint(asking.groupBy("v").agg(F.min("vec_id").alias("query")).select("query", "v"))

    total = entries.count()
    part = entries if total <= sample else entries.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int(sample / total * (1 << 30)))
    picked = part.select("v", F.col("ids")[0].alias("id")).toArrow()
    order = np.argsort(picked["id"].to_numpy(), kind="stable")
    forest = grow(_matrix(picked["v"].combine_chunks(), dim)[order] if len(picked) else np.zeros((0, dim)), total, trees)
    shared, leaves = spark.sparkContext.broadcast(forest), forest.leaves  # bounded by the sample

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        f, n = shared.value, np.zeros(leaves, np.int64)
        for batch in batches:
            n += np.bincount(f.leaf_of(_single(_matrix(batch.column(0), dim))).ravel(), minlength=leaves)
        at = np.flatnonzero(n)
        yield pa.table([pa.array(at), pa.array(n[at])], ["leaf", "n"])

    held = np.zeros(leaves, np.int64)
    for r in over_batches(entries.select("v"), count, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect():
        held[r.leaf] = r.n
    splits = np.where(held > group, np.minimum(CELLS, 2 * (held // group + 1)), 1)

    probes = asked.orderBy(F.xxhash64("query")).limit(PROBES).orderBy("query").toArrow()
    tried, labels = _matrix(probes["v"].combine_chunks(), dim) if len(probes) else np.zeros((0, dim)), probes["query"].to_numpy()
    probe = spark.sparkContext.broadcast((tried, labels))

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        q, names = probe.value
        for batch in batches:
            for lo in range(0, len(batch), 2048):
                yield from _met(q, names, pa.Table.from_batches([batch.slice(lo, 2048)]), dim, k + 1)

    near = over_batches(entries, brute, "query long, vec_id long, score double").where("query <> vec_id").groupBy("query", "vec_id").agg(F.min("score").alias("score"))
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    # At most PROBES x k rows: small enough for a broadcast at every size of the table.
    wanted = entries.withColumn("vec_id", F.explode("ids")).join(F.broadcast(near.select("query", "vec_id")), "vec_id").select("query", "vec_id", "v").orderBy("query", "vec_id").toArrow()
    of = wanted["query"].to_numpy()
    found = _matrix(wanted["v"].combine_chunks(), dim) if len(wanted) else np.zeros((0, dim))
    seen = [(q, found[of == name]) for q, name in zip(tried, labels.tolist(), strict=True) if (of == name).any()]
    enough = budget(forest, held, splits, np.array([q for q, _ in seen]), [x for _, x in seen], target)
    plan = spark.sparkContext.broadcast((held, splits))
    columns = f"cell long, asks boolean, query long, ids array<long>, v array<{kind}>"

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        f, (_, parts) = shared.value, plan.value
        for batch in batches:
            cell = f.cells(_single(_matrix(batch.column(1), dim)), parts)
            own = pa.array(np.repeat(np.arange(len(cell)), cell.shape[1]))
            yield pa.table([pa.array(cell.ravel()), pa.array(np.zeros(cell.size, bool)), pa.nulls(cell.size, pa.int64()), batch.column(0).take(own), batch.column(1).take(own)], ["cell", "asks", "query", "ids", "v"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        f, (n, parts) = shared.value, plan.value
        for batch in batches:
            for lo in range(0, len(batch), 256):
                b = batch.slice(lo, 256)
                to = [f.search(q, n, parts, enough)[0] for q in _matrix(b.column(1), dim)]
                own = pa.array(np.repeat(np.arange(len(to)), [len(t) for t in to]))
                yield pa.table([pa.array(np.concatenate(to)), pa.array(np.ones(len(own), bool)), b.column(0).take(own), pa.nulls(len(own), pa.list_(pa.int64())), b.column(1).take(own)], ["cell", "asks", "query", "ids", "v"])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Rows come by cell, those that ask first."""
        now, queries, names = None, [], []
        for batch in batches:
            table, cell, asks = pa.Table.from_batches([batch]), batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            change = np.flatnonzero((cell[1:] != cell[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *change.tolist()], [*change.tolist(), len(cell)], strict=True):
                if a == b:
                    continue
                if cell[a] != now:
                    now, queries, names = cell[a], [], []
                if asks[a]:
                    queries.append(_matrix(batch.column(4).slice(a, b - a), dim))
                    names.append(batch.column(2).slice(a, b - a).to_numpy(zero_copy_only=False))
                elif queries:
                    yield from _met(np.concatenate(queries), np.concatenate(names).astype(np.int64), table.slice(a, b - a), dim, k + 1)

    met = over_batches(asked, ask, columns).unionByName(over_batches(entries, index, columns))
    hits = over_batches(met.repartition("cell").sortWithinPartitions("cell", F.desc("asks")), rank, "query long, vec_id long, score double")
    best = hits.groupBy("query", "vec_id").agg(F.min("score").alias("score"))
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))).where(F.col("r") <= k + 1)
    members = asking.join(asked, "v").select("query", F.col("vec_id").alias("query_id"))
    each = members.join(best, "query").where("query_id <> vec_id")
    return each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
