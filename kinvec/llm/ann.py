"""Approximate nearest neighbours: a hierarchical k-means tree, best bin first.

The tree is fitted on a bounded sample (`sample`, on the driver); every row is
then indexed: it goes to the leaf that greedy descent gives.  A query walks the
tree with a priority queue of unopened nodes by distance of their centre, which
yields leaves best first.  How many leaves are visited is calibrated: for a
bounded set of rows the true neighbours come from an exact pass over all rows,
and visits are widened until the share of them that lies in visited leaves
reaches the target.

The sample bounds the leaves of this tree, so a leaf grows with the table.  Leaves
of more than `most` rows are split on the executors, each by a tree of its own
fitted on a bounded sample of its rows, as often as it takes; a query walks the
trees of the leaves it visits, with visits calibrated for each level.  What a query
meets is thus bounded by the visits, whatever the number of rows.

Queries and rows meet in blocks of a leaf (at most 1024
rows by 512 queries), so no leaf, however large, is one task's work, and each
block returns at most k rows a query.  Distances are exact.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import runtime, vectors

SAMPLE, BRANCHES, LEAF_ROWS = 16_384, 16, 128
CALIBRATION, TARGET = 100, 0.97
ROW_BLOCK, QUERY_BLOCK = 1024, 512
MOST, SUB_SAMPLE, LEVELS = 8192, 4096, 4
_SUBS, _LEVEL = 1 << 12, 56  # a split leaf's parts; a leaf's number holds its level and its way down


@dataclass
class Tree:
    centres: list[np.ndarray]  # by inner node: a row a child
    children: list[list[int]]  # an inner node's number, or ~leaf
    leaves: int

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out = np.zeros(len(x), dtype=np.int32)
        todo = [(0, np.arange(len(x)))] if self.centres else []
        while todo:
            node, rows = todo.pop()
            near = _nearest(x[rows], self.centres[node])
            for j, child in enumerate(self.children[node]):
                own = rows[near == j]
                if child < 0:
                    out[own] = ~child
                elif len(own):
                    todo.append((child, own))
        return out

    def walk(self, q: np.ndarray, visits: int, rows: np.ndarray | None = None, need: int = 0) -> list[int]:
        """The first leaves best bin first: `visits` of them, and more until they hold `need` rows."""
        if not self.centres:
            return [0]
        queue, out, held = [(0.0, 0)], [], 0
        while queue and (len(out) < visits or held < need):
            _, node = heapq.heappop(queue)
            if node < 0:
                out.append(~node)
                held += int(rows[~node]) if rows is not None else need
                continue
            gap = self.centres[node] - q
            for d, child in zip((gap * gap).sum(axis=1).tolist(), self.children[node], strict=True):
                heapq.heappush(queue, (d, child))
        return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2 * (x @ centres.T)).argmin(axis=1)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(centres, nearest), centres without rows dropped."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = _nearest(x, centres)
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres = total[count > 0] / count[count > 0, None]
    return centres, _nearest(x, centres)


def fit(x: np.ndarray, leaf: int, branches: int = BRANCHES, seed: int = 11) -> Tree:
    """Split until a node has at most `leaf` sampled rows or can't be split."""
    rng = np.random.default_rng(seed)
    centres: list[np.ndarray] = []
    children: list[list[int]] = []
    leaves = 0
    todo = [(np.arange(len(x)), -1, 0)]
    while todo:
        rows, parent, place = todo.pop()
        split = None
        if len(rows) > leaf:
            c, near = kmeans(x[rows], min(branches, max(2, len(rows) // leaf)), rng)
            kinds = np.unique(near)
            if len(kinds) > 1:
                split = c[kinds], np.searchsorted(kinds, near)
        if split is None:
            me = ~leaves
            leaves += 1
        else:
            me = len(centres)
            centres.append(split[0])
            children.append([0] * len(split[0]))
            todo += [(rows[split[1] == j], me, j) for j in range(len(split[0]))]
        if parent >= 0:
            children[parent][place] = me
    return Tree(centres, children, max(leaves, 1))


def nearest(q: np.ndarray, q_id: np.ndarray, x: np.ndarray, x_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of x, distance): exact k nearest of each query, ties to the smaller id; its own id is no candidate."""
    most = max(np.abs(q).max(initial=0), np.abs(x).max(initial=0))
    if not 1e-150 < most < 1e150 and most > 0:  # squares would overflow or vanish: scale by a power of two
        scale = 2.0 ** np.floor(np.log2(most))
        a, b, d = nearest(q / scale, q_id, x / scale, x_id, k)
        return a, b, d * scale
    a, b, d = [], [], []
    qq, xx = (q * q).sum(axis=1), (x * x).sum(axis=1)
    for i in range(len(q)):
        rough = qq[i] + xx - 2 * (x @ q[i])
        rough[x_id == q_id[i]] = np.inf
        if len(rough) > k:
            limit = np.partition(rough, k - 1)[k - 1]
            near = np.flatnonzero(rough <= limit + 1e-9 * (1 + abs(qq[i]) + xx.max()))
        else:
            near = np.arange(len(rough))
        near = near[x_id[near] != q_id[i]]
        gap = x[near] - q[i]
        exact = np.sqrt((gap * gap).sum(axis=1))
        top = np.lexsort((x_id[near], exact))[:k]
        a.append(np.full(len(top), i))
        b.append(near[top])
        d.append(exact[top])
    if not a:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return np.concatenate(a), np.concatenate(b), np.concatenate(d)


def index(rows: DataFrame, tree: Tree) -> DataFrame:
    """rows (vec_id, v) with their leaf."""
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def assign(batches):
        for batch in batches:
            leaf = shared.value.assign(vectors.matrix(batch.column(1))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), batch.column(0), batch.column(1)], names=["leaf", "vec_id", "v"])

    return rows.select("vec_id", "v").mapInArrow(runtime.task(assign), f"leaf long, vec_id long, v {rows.schema['v'].dataType.simpleString()}")


def part_of(leaf: np.ndarray | int, level: int, sub: np.ndarray | int):
    """The number of a part of a leaf: parts of level 1 are of leaves of the first tree."""
    return (level << _LEVEL) | ((leaf & ((1 << _LEVEL) - 1)) * _SUBS + sub)


def way(leaf: int) -> list[int]:
    """A leaf's number at each level down to its own."""
    out = [leaf]
    while level := out[0] >> _LEVEL:
        low = (out[0] & ((1 << _LEVEL) - 1)) // _SUBS
        out.insert(0, (level - 1) << _LEVEL | low)
    return out


def along(rows: DataFrame, trees: DataFrame, block: int, use: Callable, schema: str) -> DataFrame:
    """use(tree, leaf, ids, vectors as an array) for the rows (leaf, id, v) of leaves that have a tree (leaf, tree).

    A leaf's rows are dealt in blocks of about that many, each with the tree
    before its rows, so that a task streams through them.
    """
    kind = rows.schema["v"].dataType
    sizes = rows.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("nb")).join(trees.select("leaf"), "leaf")
    left = trees.join(sizes, "leaf").select("leaf", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("b"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("id"), F.lit(None).cast(kind).alias("v"), "tree")
    right = rows.join(sizes, "leaf").select("leaf", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int").alias("b"), F.lit(1).alias("side"), "id", "v", F.lit(None).cast("binary").alias("tree"))
    both = left.union(right).repartition(runtime.parts(rows.sparkSession), "leaf", "b").sortWithinPartitions("leaf", "b", "side")

    def run(batches):
        tree = None
        for batch in batches:
            side, leaf = batch.column(2).to_numpy(), batch.column(0).to_numpy()
            edges = np.flatnonzero(np.append(True, (side[1:] != side[:-1]) | (leaf[1:] != leaf[:-1]))).tolist() + [len(side)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if side[a] == 0:
                    tree = pickle.loads(batch.column(5)[b - 1].as_py())
                else:
                    yield use(tree, int(leaf[a]), batch.column(3).slice(a, b - a), batch.column(4).slice(a, b - a))

    return both.mapInArrow(runtime.task(run), schema)


def refined(indexed: DataFrame, most: int = MOST, sample: int = SUB_SAMPLE, leaf_rows: int = LEAF_ROWS) -> tuple[DataFrame, list[DataFrame]]:
    """indexed with its leaves split until none has more than `most` rows, and each level's trees (leaf, tree).

    Equal vectors can't be told apart: a leaf of them stays whole.
    """
    kind = indexed.schema["v"].dataType.simpleString()
    levels: list[DataFrame] = []
    for level in range(1, LEVELS + 1):
        large = indexed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
        if not large.limit(1).count():
            break

        def grow(table: pa.Table) -> pa.Table:
            x, n = vectors.matrix(table["v"]), table["n"][0].as_py()
            tree = fit(x, max(8, round(leaf_rows * len(x) / n)))
            return pa.table({"leaf": table["leaf"].slice(0, 1), "tree": pa.array([pickle.dumps(tree)], pa.binary()), "parts": pa.array([tree.leaves], pa.int32())})

        share = F.least(F.lit(1.0), F.lit(sample) / F.col("n")) * 1_000_000
        drawn = indexed.join(large, "leaf").where(F.pmod(F.xxhash64("vec_id", F.lit(40 + level)), F.lit(1_000_000)) < share)
        trees = drawn.select("leaf", "n", "v").groupBy("leaf").applyInArrow(grow, "leaf long, tree binary, parts int")
        trees = runtime.written(trees.where(F.col("parts") > 1).select("leaf", "tree"), "trees")
        if not trees.limit(1).count():
            break

        def place(tree, leaf, ids, v, level=level):
            sub = part_of(leaf, level, tree.assign(vectors.matrix(v)).astype(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(sub), ids, v], names=["leaf", "vec_id", "v"])

        moved = along(indexed.withColumnRenamed("vec_id", "id"), trees, most, place, f"leaf long, vec_id long, v {kind}")
        stay = indexed.join(trees.select("leaf"), "leaf", "left_anti").select("leaf", "vec_id", "v")
        indexed = runtime.written(stay.union(moved), "index")
        levels.append(trees)
    return indexed, levels


def calibrate(indexed: DataFrame, total: int, tree: Tree, k: int, target: float = TARGET, queries: int = CALIBRATION, levels: list[DataFrame] | None = None) -> list[int]:
    """Leaves to visit, and of each level's trees, so that the share of true neighbours met reaches target, on a bounded set of rows."""
    levels = levels or []
    target **= 1 / (1 + len(levels))
    chosen = indexed.where(F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(1_000_000)) < min(1.0, queries / total) * 1_000_000).select("vec_id", "v").toArrow()
    q, q_id = vectors.matrix(chosen["v"]), chosen["vec_id"].to_numpy()
    shared = indexed.sparkSession.sparkContext.broadcast((q, q_id))

    def exact(batches):
        own, own_id = shared.value
        for batch in batches:
            leaf, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            a, b, d = nearest(own, own_id, vectors.matrix(batch.column(2)), ids, k)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(ids[b]), pa.array(d), pa.array(leaf[b])], names=["q", "vec_id", "score", "leaf"])

    found = indexed.mapInArrow(runtime.task(exact), "q long, vec_id long, score double, leaf long")
    top = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))).where(F.col("r") <= k).select("q", "leaf").collect()
    if not top:
        return [tree.leaves, *[_SUBS] * len(levels)]

    def enough(place: np.ndarray) -> int:
        place, visits = np.sort(place), 1
        while np.searchsorted(place, visits) < target * len(place):
            visits += 1
        return visits

    order = [{leaf: n for n, leaf in enumerate(tree.walk(x, tree.leaves))} for x in q]
    ways = [(r["q"], way(r["leaf"])) for r in top]
    out = [enough(np.array([order[i][w[0]] for i, w in ways]))]
    for level, trees in enumerate(levels, 1):
        met = [(i, w[level - 1], (w[level] & ((1 << _LEVEL) - 1)) % _SUBS) for i, w in ways if len(w) > level]
        if not met:
            out.append(1)
            continue
        # at most one tree for each true neighbour of the bounded set of rows
        own = {r["leaf"]: pickle.loads(r["tree"]) for r in trees.where(F.col("leaf").isin(sorted({leaf for _, leaf, _ in met}))).toLocalIterator()}
        out.append(enough(np.array([own[leaf].walk(q[i], own[leaf].leaves).index(sub) for i, leaf, sub in met])))
    return out


def search(embeddings: DataFrame, every: int = 100, k: int = 10, target: float = TARGET, sample: int = SAMPLE, most: int = MOST) -> DataFrame:
    """query_id, rank, vec_id, score, visited: the k nearest found of each row whose vec_id `every` divides.

    Nearest by Euclidean distance in double precision, ties to the smaller
    vec_id; a query's own vec_id is no candidate.  Null, empty, zero and
    non-finite vectors take no part, nor those that have not the commonest
    length.  Of rows with one vec_id the least vector, component by component,
    stands for all.  A query has fewer than k rows only where there are fewer
    candidates.  Without rows there is no result.
    """
    spark = embeddings.sparkSession
    rows = vectors.read(embeddings).where(F.col("v").isNotNull() & F.col("vec_id").isNotNull()).select("vec_id", "v")
    d = vectors.dimension(rows)
    if d is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, visited int")
    rows = runtime.written(rows.where(F.size("v") == d).groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    total = rows.count()
    drawn = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(4)), F.lit(1_000_000)) < min(1.0, sample / total) * 1_000_000).select("vec_id", "v").toArrow().sort_by("vec_id")
    x = vectors.matrix(drawn["v"])
    tree = fit(x, max(8, round(LEAF_ROWS * len(x) / total)))
    indexed = runtime.written(index(rows, tree), "index")
    held = np.zeros(tree.leaves, dtype=np.int64)
    for r in indexed.groupBy("leaf").count().collect():  # one row a leaf: bounded by the sample
        held[r["leaf"]] = r["count"]
    indexed, levels = refined(indexed, most)
    visits, *more = calibrate(indexed, total, tree, k, target, levels=levels)
    walks = spark.sparkContext.broadcast((tree, held))

    def walk(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                walked, rows_of = walks.value
                own = [walked.walk(q, visits, rows_of, k + 1) for q in vectors.matrix(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(own, pa.list_(pa.int64()))], names=["query_id", "v", "leaves"])

    queries = indexed.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "v").mapInArrow(runtime.task(walk), f"query_id long, v {rows.schema['v'].dataType.simpleString()}, leaves array<long>")
    queries = runtime.written(queries, "queries").select("query_id", "v", F.explode("leaves").alias("leaf"))
    for trees, wide in zip(levels, more, strict=True):

        def descend(tree, leaf, ids, v, wide=wide):
            level = (leaf >> _LEVEL) + 1
            own = [[part_of(leaf, level, s) for s in tree.walk(q, wide)] for q in vectors.matrix(v)]
            n = np.array([len(o) for o in own])
            take = pa.array(np.repeat(np.arange(len(own)), n))
            return pa.RecordBatch.from_arrays([ids.take(take), v.take(take), pa.array(np.concatenate(own).astype(np.int64))], names=["query_id", "v", "leaf"])

        stay = queries.join(trees.select("leaf"), "leaf", "left_anti").select("query_id", "v", "leaf")
        down = along(queries.select("leaf", F.col("query_id").alias("id"), "v"), trees, QUERY_BLOCK, descend, f"query_id long, v {rows.schema['v'].dataType.simpleString()}, leaf long")
        queries = runtime.written(stay.union(down), "queries")
    by_leaf = indexed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / ROW_BLOCK).cast("int").alias("nb")).join(queries.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("nq")), "leaf")
    if not levels:  # one row a leaf, and the sample bounds the leaves
        by_leaf = F.broadcast(by_leaf)
    left = queries.join(by_leaf, "leaf").select("leaf", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("b"), F.pmod(F.xxhash64("query_id"), F.col("nq")).cast("int").alias("c"), F.lit(0).alias("side"), F.col("query_id").alias("id"), "v")
    right = indexed.join(by_leaf, "leaf").select("leaf", F.pmod(F.xxhash64("vec_id"), F.col("nb")).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("c"), F.lit(1).alias("side"), F.col("vec_id").alias("id"), "v")
    meeting = left.union(right).repartition(runtime.parts(spark), "leaf", "b", "c").sortWithinPartitions("leaf", "b", "c", "side")

    def meet(batches):
        def one(table):
            side, ids, own = table["side"].to_numpy(), table["id"].to_numpy(), vectors.matrix(table["v"])
            a, b, score = nearest(own[side == 0], ids[side == 0], own[side == 1], ids[side == 1], k) if (side == 1).any() else ([], [], [])
            if len(a):
                found.append((ids[side == 0][a], ids[side == 1][b], score))
            if sum(len(f[0]) for f in found) > 1 << 18:
                best()
                if len(found[0][0]) > 1 << 17:  # so many queries that little is saved
                    yield from sent()

        def best():
            """Only each query's k nearest so far in this task."""
            q, x, d = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.lexsort((x, d, q))
            q, x, d = q[order], x[order], d[order]
            head = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
            place = np.arange(len(q)) - np.repeat(head, np.diff(np.append(head, len(q))))
            found[:] = [(q[place < k], x[place < k], d[place < k])]

        def sent():
            if found:
                best()
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found[0]], names=["query_id", "vec_id", "score"])
                found.clear()

        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        kept, last = [], None
        for batch in batches:
            key = np.stack([batch.column(i).to_numpy() for i in range(3)])
            edges = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0))).tolist() + [batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                now = tuple(key[:, a])
                if now != last and kept:
                    yield from one(pa.Table.from_batches(kept))
                    kept = []
                last = now
                kept.append(batch.slice(a, b - a))
        if kept:
            yield from one(pa.Table.from_batches(kept))
        yield from sent()

    found = meeting.mapInArrow(runtime.task(meet), "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", F.lit(visits).alias("visited"))


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest found of every hundredth embedding."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
