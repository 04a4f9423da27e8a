"""Approximate nearest neighbours: a forest of random-projection trees, one priority queue per query.

* Fit: ``trees`` trees are grown on a bounded sample of ``sample`` vectors. A node projects on a random
  direction and splits at the sample's median.
* Index: every row goes to one leaf in each tree.
* Search: a query keeps all trees' open nodes in one queue, ordered by the largest margin that was
  crossed on the way, and opens the nearest until the rows in the opened leaves add up to a budget.
* Budget: for ``probes`` of the queries the true neighbours are found by brute force over all rows, each
  task keeping k rows a probe; the budget is the least that would have opened leaves with ``recall`` of
  them (at least ``search_rows``). So clustered vectors cost little, and what vectors without structure cost
  is what the wanted recall takes.
* Rerank: queries and rows meet by leaf; the cosine of each pair is computed in double precision
  on the original vectors, and a leaf passes on only each query's k best.

Leaves that hold many rows or many queries are cut into a grid of blocks, so no task gathers
an unbounded group, not even for a vector that a third of all rows share. Only the forest and the leaves'
row counts reach the driver; the sample and ``sample_leaf`` bound both.

README has measured figures of recall and of the share of rows that is compared.

Defined results: vectors that are null, zero, of another length than most of the sample, or that hold
null or non-finite components take no part, nor do null ids; rows with the query's id are its own
row; a repeated id counts once, with its best score; fewer than k candidates give fewer rows.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ship


@dataclass(frozen=True)
class Forest:
    trees: int = 6
    sample: int = 50_000  #: vectors to grow trees on, at most about
    leaf_rows: int = 512  #: rows aimed at in a leaf
    sample_leaf: int = 8  #: sample vectors in a leaf at least, which bounds the number of leaves
    recall: float = 0.95  #: share of the probes' true neighbours that the budget must reach
    probes: int = 256  #: queries that are searched exactly to set the budget, at most
    search_rows: int = 2_000
    block: int = 2_048  #: rows, and queries, of a leaf that one task compares at a time
    seed: int = 11


class Tree:
    def __init__(self, x: np.ndarray, leaf: int, r: np.random.Generator):
        self.normal: list[np.ndarray | None] = []
        self.at: list[float] = []
        self.child: list[tuple[int, int]] = []
        self.leaf: list[int] = []
        self.leaves = 0
        self._grow(x, np.arange(len(x)), leaf, r)
        self.normals = np.array([n if n is not None else np.zeros(x.shape[1]) for n in self.normal])
        self.left, self.right = (np.array([c[i] for c in self.child]) for i in (0, 1))
        self.cut, self.leaf_of = np.array(self.at), np.array(self.leaf)

    def _node(self, normal, at, leaf) -> int:
        self.normal.append(normal)
        self.at.append(at)
        self.child.append((-1, -1))
        self.leaf.append(leaf)
        return len(self.leaf) - 1

    def _grow(self, x: np.ndarray, rows: np.ndarray, leaf: int, r: np.random.Generator) -> int:
        for _ in range(3 if len(rows) > leaf else 0):
            w = r.normal(size=x.shape[1])
            w /= np.linalg.norm(w)
            p = x[rows] @ w
            t = float(np.median(p))
            low = p <= t
            if 0 < low.sum() < len(rows):
                me = self._node(w, t, -1)
                self.child[me] = (self._grow(x, rows[low], leaf, r), self._grow(x, rows[~low], leaf, r))
                return me
        self.leaves += 1
        return self._node(None, 0.0, self.leaves - 1)

    def assign(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while len(open_ := np.flatnonzero(self.leaf_of[at] < 0)):
            n = at[open_]
            side = np.einsum("ij,ij->i", x[open_], self.normals[n]) > self.cut[n]
            at[open_] = np.where(side, self.right[n], self.left[n])
        return self.leaf_of[at]


def opened(forest: list[Tree], rows: list[np.ndarray], q: np.ndarray, budget: float) -> list[tuple[int, int]]:
    """The (tree, leaf) pairs that one query opens, nearest first."""
    margins = [t.normals @ q - t.cut for t in forest]
    heap = [(0.0, t, 0) for t in range(len(forest))]
    out, seen = [], 0
    while heap and seen < budget:
        far, t, n = heapq.heappop(heap)
        tree, m = forest[t], margins[t]
        while tree.leaf[n] < 0:
            low, high = tree.child[n]
            near, other = (high, low) if m[n] > 0 else (low, high)
            heapq.heappush(heap, (max(far, abs(m[n])), t, other))
            n = near
        leaf = tree.leaf[n]
        if rows[t][leaf]:
            out.append((t, leaf))
            seen += rows[t][leaf]
    return out


def valid_vectors(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and v (array of double) of the vectors that take part."""
    v = F.col("v")
    good = F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(good)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of pairs of rows, component by component: equal vectors get exactly equal values wherever they lie."""
    dot, na, nb = (np.zeros(len(a)) for _ in range(3))
    for d in range(a.shape[1]):
        x, y = a[:, d], b[:, d]
        dot += x * y
        na += x * x
        nb += y * y
    return dot / (np.sqrt(na) * np.sqrt(nb))


def nearest(query_id: np.ndarray, q: np.ndarray, vec_id: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query_id, vec_id and score of each query's k best; a fast product picks all that can be among them,
    the exact measure decides."""
    fast = _unit(q) @ _unit(x).T
    own = query_id[:, None] == vec_id
    fast[own] = -np.inf
    at = len(x) - k
    if at > 0 and len(np.unique(vec_id)) == len(vec_id):
        least = np.partition(fast, at, 1)[:, at, None] - 1e-9
    else:  # few rows, or repeated ids that could take the places of others
        least = -2.0
    i, j = np.nonzero((fast >= least) & ~own)
    score = cosines(q[i], x[j])
    order = np.lexsort((vec_id[j], -score, i))
    i, v, score = i[order], vec_id[j[order]], score[order]
    again = np.zeros(len(i), bool)
    if np.ndim(least) == 0:  # of a repeated id the best score counts
        _, first = np.unique(np.column_stack([i, v]), axis=0, return_index=True) if len(i) else (None, np.zeros(0, int))
        again = ~np.isin(np.arange(len(i)), first)
    i, v, score = i[~again], v[~again], score[~again]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    good = rank < k
    return query_id[i[good]], v[good], score[good]


def in_sample(share: float) -> Column:
    """Whether a row is in a sample of such a share, however small, by its id's hash."""
    return F.shiftrightunsigned(F.xxhash64("vec_id"), 11).cast("double") < share * 2.0**53


def grow(valid: DataFrame, n: int, config: Forest) -> list[Tree]:
    rows = valid.where(in_sample(min(1.0, config.sample / max(n, 1)))).orderBy("vec_id").limit(int(config.sample * 1.2)).collect()
    dims = Counter(len(r["v"]) for r in rows).most_common(1)
    x = _unit(np.array([r["v"] for r in rows if len(r["v"]) == dims[0][0]])) if rows else np.zeros((0, 1))
    if not len(x):
        return []
    leaf = max(config.sample_leaf, int(config.leaf_rows * len(x) / n))
    return [Tree(x, leaf, np.random.default_rng([config.seed, t])) for t in range(config.trees)]


def measured_budget(index: DataFrame, queries: DataFrame, forest: list[Tree], sent, rows: list[np.ndarray], k: int, config: Forest) -> int:
    """Rows that a query's opened leaves must hold (a row counts in each tree) to reach the wanted recall."""
    probes = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(config.probes).select("vec_id", "v").collect()
    if not probes:
        return config.search_rows
    ids, x = np.array([p["vec_id"] for p in probes]), _unit(np.array([p["v"] for p in probes]))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, leaves = np.full((len(ids), 0), 0.0), np.zeros((len(ids), 0, len(sent.value)), np.int64)
        for b in batches:
            if b.num_rows:
                fast = x @ _unit(_matrix(b.column(1))).T
                fast[ids[:, None] == b.column(0).to_numpy()] = -np.inf
                score = np.concatenate([score, fast], 1)
                leaves = np.concatenate([leaves, np.broadcast_to(_matrix(b.column(2)), (len(ids), b.num_rows, len(sent.value)))], 1)
                top = np.argsort(-score, axis=1, kind="stable")[:, :k]
                score, leaves = np.take_along_axis(score, top, 1), np.take_along_axis(leaves, top[:, :, None], 1)
        probe = np.repeat(np.arange(len(ids)), score.shape[1])
        found = np.isfinite(score.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(probe[found], pa.int64()), pa.array(score.ravel()[found], pa.float64()), pa.array(list(leaves.reshape(-1, len(sent.value))[found]), pa.list_(pa.int64()))], ["probe", "score", "leaves"])

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for p, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen, at = 0, {}
                for t, leaf in opened(sent.value, rows, x[p], float("inf")):
                    at[t, leaf] = seen
                    seen += int(rows[t][leaf])
                out += [min(at[t, leaf] for t, leaf in enumerate(leaves)) for leaves in wanted]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["cost"])

    near = index.select("vec_id", "v", "leaves").mapInArrow(best, "probe long, score double, leaves array<long>")
    near = near.withColumn("at", F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score")))).where(F.col("at") <= k)
    seen = near.groupBy("probe").agg(F.collect_list("leaves").alias("wanted")).mapInArrow(costs, "cost long").collect()  # k a probe
    cost = np.sort([r["cost"] for r in seen])
    return max(config.search_rows, int(cost[min(len(cost) - 1, int(np.ceil(config.recall * len(cost))) - 1)]) + 1) if len(cost) else config.search_rows


OUT = "query_id long, rank int, vec_id long, score double"


def search(vectors: DataFrame, is_query, k: int = 5, config: Forest = Forest()) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row for which is_query holds."""
    spark = vectors.sparkSession
    ship(spark)
    valid = valid_vectors(vectors)
    n = valid.count()
    forest = grow(valid, n, config) if n else []
    if not forest:
        return spark.createDataFrame([], OUT)
    dims = forest[0].normals.shape[1]
    sent = spark.sparkContext.broadcast(forest)  # bounded by config.sample / sample_leaf nodes a tree

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _unit(_matrix(b.column(1)))
                leaves = np.column_stack([t.assign(x) for t in sent.value])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(leaves), pa.list_(pa.int64()))], ["vec_id", "v", "leaves"])

    index = materialize(valid.where(F.size("v") == dims).mapInArrow(assign, "vec_id long, v array<double>, leaves array<long>"), "ann_index")
    leaf = index.select("vec_id", F.posexplode("leaves").alias("tree", "leaf"))
    rows = [np.zeros(t.leaves, np.int64) for t in forest]
    for r in leaf.groupBy("tree", "leaf").count().collect():
        rows[r["tree"]][r["leaf"]] = r["count"]
    budget = measured_budget(index, index.where(is_query), forest, sent, rows, k, config)

    def open_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                got = [[t << 32 | leaf for t, leaf in opened(sent.value, rows, q, budget)] for q in _unit(_matrix(b.column(1)))]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.list_(pa.int64()))], ["vec_id", "v", "opened"])

    queries = materialize(index.where(is_query).select("vec_id", "v").mapInArrow(open_leaves, "vec_id long, v array<double>, opened array<long>"), "ann_queries")
    visits = {r["key"]: r["count"] for r in queries.select(F.explode("opened").alias("key")).groupBy("key").count().collect()}
    # of each leaf: over how many blocks its rows and its queries are dealt
    grid = [(key, int(-(-rows[key >> 32][key & 0xFFFFFFFF] // config.block)), -(-c // config.block)) for key, c in visits.items()]
    plan = spark.createDataFrame(grid or [(-1, 1, 1)], "key long, row_blocks int, query_blocks int")
    of_row, of_query = F.pmod(F.xxhash64("vec_id"), F.col("row_blocks")).cast("int"), F.pmod(F.xxhash64("vec_id"), F.col("query_blocks")).cast("int")
    left = index.select("vec_id", "v", F.posexplode("leaves").alias("tree", "leaf")).withColumn("key", F.shiftleft(F.col("tree").cast("long"), 32) + F.col("leaf"))
    left = left.join(F.broadcast(plan), "key").select("key", "vec_id", "v", of_row.alias("rb"), F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("qb"))
    right = queries.select("vec_id", "v", F.explode("opened").alias("key")).join(F.broadcast(plan), "key").select("key", "vec_id", "v", of_query.alias("qb"), F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1)).alias("rb"))

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        c = ([], [], [])
        if a.num_rows and b.num_rows:
            c = nearest(b["vec_id"].to_numpy(), _matrix(b["v"]), a["vec_id"].to_numpy(), _matrix(a["v"]), k)
        return pa.table({"query_id": pa.array(c[0], pa.int64()), "vec_id": pa.array(c[1], pa.int64()), "score": pa.array(c[2], pa.float64())})

    by = ["key", "rb", "qb"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(compare, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
