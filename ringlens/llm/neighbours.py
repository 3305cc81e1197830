"""Approximate nearest neighbours by inner product over a forest of random-projection trees.

Trees: inner products become distances when every vector gets one more component, the root of the largest squared
length minus its own (queries get zero). A node draws ``DRAWS`` random directions, takes the one along which its rows spread most, and splits
at the median. The forest is fitted to ``SAMPLE`` distinct vectors of smallest hash, down to ``LEAF`` of them in a leaf: this bound is
the parameter of the fit. Every row is then indexed in one leaf of each tree.

Search: all trees of a query share one priority queue. It gives the open node whose splitting planes lie nearest to the
query; the query descends from there to a leaf and leaves the other sides in the queue, until the leaves visited hold a set
number of rows, and one tree's enough for a full answer. That number is found for the data: for ``PROBES`` queries the true neighbours are computed over all rows, and the
search goes as far as it takes to meet ``RECALL`` of them. Where vectors have neighbours a small part of the rows does;
vectors without any structure take a large one.

Reranking: leaves next to each other form blocks of about ``BLOCK`` rows (a larger leaf, several blocks). A block and the queries that
visit one of its leaves, in lots of ``LOT``, meet in one task, where exact products in double precision rank the rows of the
visited leaves. What a query's own sample rows already reach need not be sent on. The lists of the blocks are merged per query.

Equal vectors are indexed once with their 21 smallest ids: no further one can be among 20 nearest, the query's own row
aside, so a vector held by a third of all rows is one row here and ties go to smaller ids.

Vectors null, zero, of another length than most, or holding null or non-finite components take no part, neither do null
ids. Repeated ids are rows of their own. Extra columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ringlens.llm.store import cut_lineage

TOP = 20
EVERY = 20  # the contract's queries: ids divisible by it
TREES = 4
DRAWS = 8
SAMPLE = 16_384
LEAF = 32
BLOCK = 4096
LOT = 4096
PROBES = 200
RECALL = 0.96

_KEYED = "vec_id bigint, k1 bigint, k2 bigint, v binary"


class Forest(NamedTuple):
    """Nodes of all trees in one numbering: child below zero is leaf -1 - child."""

    roots: np.ndarray
    directions: np.ndarray  # node x (dimensions + 1)
    limits: np.ndarray
    children: np.ndarray  # node x 2: not above the limit, above it
    trees: np.ndarray  # of each leaf
    radius2: float

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.radius2 - (vectors * vectors).sum(axis=1), 0.0)
        return np.hstack([vectors, np.sqrt(rest)[:, None]])

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree (vectors x trees)."""
        lifted, found = self.lifted(vectors), np.zeros((len(vectors), len(self.roots)), dtype=np.int64)
        for t, root in enumerate(self.roots.tolist()):
            waiting = [(root, np.arange(len(vectors)))]
            while waiting:
                node, rows = waiting.pop()
                if node < 0:
                    found[rows, t] = -1 - node
                    continue
                # a sum in fixed order, so that a vector takes one side whatever stands beside it
                above = (lifted[rows] * self.directions[node]).sum(axis=1) > self.limits[node]
                for side, own in ((0, rows[~above]), (1, rows[above])):
                    if len(own):
                        waiting.append((int(self.children[node, side]), own))
        return found

    def visits(self, query: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int]]:
        """(leaf, rows visited with it) by the shared queue, nearest splitting planes first."""
        offsets = (self.directions[:, :-1] @ query - self.limits).tolist()
        queue = [(0.0, root) for root in self.roots.tolist()]
        heapq.heapify(queue)
        children, rows = self.children.tolist(), 0
        while queue:
            reach, node = heapq.heappop(queue)
            while node >= 0:
                offset = offsets[node]
                near, far = children[node][::-1] if offset > 0 else children[node]
                heapq.heappush(queue, (max(reach, abs(offset)), far))
                node = near
            rows += sizes[-1 - node]
            yield -1 - node, rows


def fit_forest(sample: np.ndarray, radius2: float, trees: int = TREES, leaf: int = LEAF, seed: int = 7) -> Forest:
    chance = np.random.default_rng(seed)
    empty = Forest(np.zeros(0), np.zeros((0, 0)), np.zeros(0), np.zeros((0, 2)), np.zeros(0), radius2)
    lifted = empty.lifted(sample)
    roots, directions, limits, children, leaves = [], [], [], [], []

    def split(rows: np.ndarray) -> int:
        if len(rows) > leaf:
            drawn = chance.standard_normal((DRAWS, lifted.shape[1]))
            drawn /= np.linalg.norm(drawn, axis=1, keepdims=True)
            along = lifted[rows] @ drawn.T
            best = int(along.var(axis=0).argmax())
            limit = float(np.median(along[:, best]))
            above = along[:, best] > limit
            if above.any() and not above.all():
                node = len(limits)
                directions.append(drawn[best])
                limits.append(limit)
                children.append([0, 0])
                children[node] = [split(rows[~above]), split(rows[above])]
                return node
        leaves.append(len(roots))
        return -len(leaves)

    for _ in range(trees):
        roots.append(split(np.arange(len(sample))))
    return Forest(np.array(roots), np.array(directions).reshape(-1, lifted.shape[1]), np.array(limits), np.array(children, dtype=np.int64).reshape(-1, 2),
                  np.array(leaves), radius2)


def clean_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, k1, k2 (hashes of the vector), v (its components as doubles): the rows that take part."""
    rows = embeddings.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>").alias("e")).where(
        "vec_id IS NOT NULL AND e IS NOT NULL AND size(e) > 0")
    lengths = rows.groupBy(F.size("e").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.col("rows").desc(), "n").limit(1).collect()
    usual = lengths[0].n if lengths else 0

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("e").flatten()
            matrix = values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, usual) + 0.0  # nulls are NaN, -0.0 is 0.0
            right = np.isfinite(matrix).all(axis=1) & (matrix != 0).any(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(pa.array(right)), pa.array([r.tobytes() for r in matrix[right]], pa.binary())],
                                             names=["vec_id", "v"])

    vectors = rows.where(F.size("e") == usual).mapInArrow(of, "vec_id bigint, v binary")
    return vectors.select("vec_id", F.xxhash64(F.lit(1), "v").alias("k1"), F.xxhash64(F.lit(2), "v").alias("k2"), "v")


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    bodies = column.to_pylist()
    return np.frombuffer(b"".join(bodies), np.float64).reshape(len(bodies), -1)


def exact_scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, each summed in the same order."""
    return (queries * rows).sum(axis=1)


def _probe_budget(vectors: DataFrame, probes: pa.Table, forest: Forest, sizes: np.ndarray, top: int) -> int:
    """Rows to visit for the share ``RECALL`` of the true neighbours of the probes."""
    queries, keys = _matrix(probes.column("v")), set(zip(probes.column("k1").to_pylist(), probes.column("k2").to_pylist()))
    own = [(a, b) for a, b in zip(probes.column("k1").to_pylist(), probes.column("k2").to_pylist())]
    shipped = vectors.sparkSession.sparkContext.broadcast((queries, own))  # PROBES vectors

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, own = shipped.value
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _matrix(batch.column("v"))
            scores = rows @ queries.T
            names = list(zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist()))
            place = {k: i for i, k in enumerate(names)}
            for q, key in enumerate(own):
                if key in place:
                    scores[place[key], q] = -np.inf
            best = np.argpartition(-scores, min(top, len(rows)) - 1, axis=0)[:top]
            for q in range(len(own)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), q)), pa.array(scores[best[:, q], q]), batch.column("v").take(pa.array(best[:, q]))],
                                                 names=["q", "score", "v"])

    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "v")
    true = vectors.mapInArrow(of, "q bigint, score double, v binary").where("score > double('-inf')") \
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("q", "v").toArrow()
    if not true.num_rows or not keys:
        return int(sizes.sum())
    leaves, q_of = forest.leaf_of(_matrix(true.column("v"))), true.column("q").to_numpy()
    needed = []
    for q, query in enumerate(queries):
        wanted = {}
        for row in np.flatnonzero(q_of == q).tolist():
            for leaf in leaves[row].tolist():
                wanted.setdefault(leaf, []).append(row)
        met = set()
        for leaf, rows in forest.visits(query, sizes):
            for row in wanted.get(leaf, ()):
                if row not in met:
                    met.add(row)
                    needed.append(rows)
            if len(met) == (q_of == q).sum():
                break
    needed.sort()
    return int(needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))) - 1)])


def _blocks(sizes: np.ndarray, trees: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each leaf: small neighbours of a tree share one, a large leaf has several."""
    first, parts, at, room, tree = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), -1, 0, -1
    for leaf, size in enumerate(sizes.tolist()):
        if trees[leaf] != tree:
            tree, room = trees[leaf], -1
        if size > BLOCK:
            parts[leaf] = -(-size // BLOCK)
            first[leaf], at, room = at + 1, at + int(parts[leaf]), -1
            continue
        if size > room:
            at, room = at + 1, BLOCK
        first[leaf], room = at, room - size
    return first, parts


def neighbours(embeddings: DataFrame, asked: DataFrame, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``asked`` the nearest rows of ``embeddings`` that the search meets.

    ``asked`` (vec_id, embedding) are rows of ``embeddings``; a query's own row is no candidate.
    """
    spark = embeddings.sparkSession
    kept = top + 1  # the query's own row may be among them
    queries = cut_lineage(clean_vectors(asked).select("vec_id", "k1", "k2", "v"))
    rows = clean_vectors(embeddings)
    smallest = rows.withColumn("place", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("vec_id"))).where(F.col("place") <= kept)
    vectors = cut_lineage(smallest.groupBy("k1", "k2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("v").alias("v")))
    by_hash = F.xxhash64("k1", "k2", F.lit("sample"))
    sample = vectors.select("k1", "k2", "v").orderBy(by_hash, "k1").limit(SAMPLE).toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")

    def longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([float((_matrix(batch.column(0)) ** 2).sum(axis=1).max())])], names=["n"])

    radius2 = vectors.select("v").mapInArrow(longest, "n double").agg(F.max("n")).first()[0]
    known = _matrix(sample.column("v"))
    forest = fit_forest(known, radius2)
    fitted = spark.sparkContext.broadcast(tuple(forest))  # TREES * SAMPLE / LEAF nodes

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaves = Forest(*fitted.value).leaf_of(_matrix(batch.column("v")))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(
                    pa.array(np.arange(0, leaves.size + 1, leaves.shape[1], dtype=np.int32)), pa.array(leaves.reshape(-1)))],
                    names=["k1", "k2", "ids", "v", "leaves"])

    placed = cut_lineage(vectors.select("k1", "k2", "ids", "v").mapInArrow(place, "k1 bigint, k2 bigint, ids array<bigint>, v binary, leaves array<bigint>"))
    sizes = np.zeros(len(forest.trees), dtype=np.int64)
    for r in placed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("n")).collect():  # one row per leaf
        sizes[r.leaf] = r.n
    distinct = cut_lineage(queries.groupBy("k1", "k2").agg(F.first("v").alias("v")))
    probes = distinct.orderBy(by_hash, "k1").limit(PROBES).toArrow()
    budget = _probe_budget(vectors, probes, forest, sizes, top) if probes.num_rows else 0
    first, parts = _blocks(sizes, forest.trees)
    plan = spark.sparkContext.broadcast((sizes, first, parts, known, forest.leaf_of(known)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The blocks that each query visits, with the leaves there, and a score that its top rows reach."""
        forest, (sizes, first, parts, known, known_leaves) = Forest(*fitted.value), plan.value
        for batch in batches:
            blocks, visits, owner, bounds = [], [], [], []
            for i, query in enumerate(_matrix(batch.column("v")) if batch.num_rows else ()):
                visited: dict[int, list[int]] = {}
                seen = np.zeros(len(sizes), dtype=bool)
                in_tree = [0] * len(forest.roots)
                for leaf, count in forest.visits(query, sizes):
                    seen[leaf] = True
                    in_tree[forest.trees[leaf]] += sizes[leaf]
                    for block in range(int(first[leaf]), int(first[leaf] + parts[leaf])):
                        visited.setdefault(block, []).append(leaf)
                    if count >= budget and max(in_tree) >= kept:  # a tree has a row once
                        break
                scores = exact_scores(known[seen[known_leaves].any(axis=1)], query)
                blocks += visited.keys()
                visits += visited.values()
                owner += [i] * len(visited)
                bounds += [float(np.partition(scores, -kept)[-kept]) if len(scores) >= kept else float("-inf")] * len(visited)
            at = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks, pa.int64()), pa.array(visits, pa.list_(pa.int64())), *(batch.column(c).take(at) for c in ("k1", "k2", "v")),
                 pa.array(bounds, pa.float64())], names=["block", "leaves", "k1", "k2", "v", "least"])

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: as many tasks as a shuffle has
    asks = cut_lineage(distinct.repartition(tasks, "k1").mapInArrow(search, "block bigint, leaves array<bigint>, k1 bigint, k2 bigint, v binary, least double"))
    lots = cut_lineage(asks.groupBy("block").agg(F.expr(f"(count(*) + {LOT} - 1) DIV {LOT}").alias("lots")))
    leaf_table = spark.createDataFrame(pa.table({"leaf": np.arange(len(sizes)), "first": first, "parts": parts}))
    indexed = placed.withColumn("leaf", F.explode("leaves")).join(F.broadcast(leaf_table), "leaf") \
        .withColumn("block", F.col("first") + F.pmod(F.xxhash64("k1", "k2"), "parts"))  # one row per leaf
    index = indexed.join(lots, "block").withColumn("lot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("lots") - 1))) \
        .select("block", "lot", "leaf", "k1", "k2", "ids", "v")
    spread = asks.join(lots, "block").withColumn("lot", F.pmod(F.xxhash64("k1", "k2"), "lots")).drop("lots")

    def rank(key: tuple, rows: pa.Table, queries: pa.Table) -> pa.Table:
        """The best ``kept`` rows of the block for each query, among those of the leaves it visits."""
        out: list[list] = [[] for _ in range(6)]
        if rows.num_rows and queries.num_rows:
            vectors, asked = _matrix(rows.column("v")), _matrix(queries.column("v"))
            leaf, ids = rows.column("leaf").to_numpy(), rows.column("ids").to_pylist()
            smallest = np.array([i[0] for i in ids])
            order = np.argsort(leaf, kind="stable")
            begins, ends = (np.searchsorted(leaf[order], np.arange(leaf.max() + 2), s) for s in ("left", "right"))
            own, names = (np.stack([t.column(c).to_numpy() for c in ("k1", "k2")], axis=1) for t in (queries, rows))
            least, leaves = queries.column("least").to_numpy(), queries.column("leaves").to_pylist()
            for start in range(0, len(asked), 256):
                products = asked[start : start + 256] @ vectors.T
                slack = 1e-9 * (1 + np.abs(products).max(axis=1))
                for q in range(start, min(start + 256, len(asked))):
                    at = np.concatenate([order[begins[x] : ends[x]] for x in leaves[q] if x < len(begins)] or [np.zeros(0, np.int64)])
                    line = products[q - start, at]
                    bound = least[q] - slack[q - start]
                    if len(line) > kept:
                        bound = max(bound, np.partition(line, -kept)[-kept] - slack[q - start])
                    at = at[line >= bound]
                    exact = exact_scores(vectors[at], asked[q])
                    best = np.lexsort((smallest[at], -exact))[:kept]
                    at, n = at[best], len(best)
                    for column, values in zip(out, ([int(own[q, 0])] * n, [int(own[q, 1])] * n, names[at, 0].tolist(), names[at, 1].tolist(),
                                                    exact[best].tolist(), [ids[i] for i in at.tolist()])):
                        column.extend(values)
        kinds = [pa.int64()] * 4 + [pa.float64(), pa.list_(pa.int64())]
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds)], names=["k1", "k2", "c1", "c2", "score", "ids"])

    found = index.groupBy("block", "lot").cogroup(spread.groupBy("block", "lot")).applyInArrow(
        rank, "k1 bigint, k2 bigint, c1 bigint, c2 bigint, score double, ids array<bigint>")
    # a vector is met in several trees, and may be the query's own
    met = found.groupBy("k1", "k2", "c1", "c2").agg(F.max("score").alias("score"), F.max("ids").alias("ids")).select(
        "k1", "k2", "score", (F.col("c1").eqNullSafe(F.col("k1")) & F.col("c2").eqNullSafe(F.col("k2"))).alias("same"), F.explode("ids").alias("vec_id"))
    best = Window.partitionBy("k1", "k2").orderBy(F.col("score").desc(), "vec_id")
    lists = met.withColumn("place", F.row_number().over(best)).where(F.col("place") <= kept).groupBy("k1", "k2").agg(
        F.sort_array(F.collect_list(F.struct("place", "vec_id", "score", "same"))).alias("near"))
    answers = queries.select(F.col("vec_id").alias("query_id"), "k1", "k2").join(cut_lineage(lists), ["k1", "k2"])
    own = F.array_position(F.transform("near", lambda n: n["same"] & (n["vec_id"] == F.col("query_id"))), F.lit(True)).cast("int")
    without = F.when(own > 0, F.concat(F.slice("near", 1, own - 1), F.slice("near", own + 1, kept))).otherwise(F.slice("near", 1, top))
    return answers.select("query_id", F.posexplode(without).alias("place", "n")).select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("n.vec_id").alias("vec_id"), F.col("n.score").alias("score"))


def nearest_of_every(embeddings: DataFrame, every: int = EVERY, top: int = TOP) -> DataFrame:
    """``neighbours`` of the rows whose id is divisible by ``every``."""
    return neighbours(embeddings, embeddings.where(F.col("vec_id") % every == 0), top)
