"""Approximate nearest neighbours: a forest of random-projection trees, one priority queue, exact reranking.

Every tree splits space by hyperplanes: a node's direction joins two random points of a bounded sample, its threshold is
the median of the sample's projections there.  Every vector of the table is assigned to one leaf per tree.  A query
searches all trees through one shared queue, ordered by the sum of the squared margins crossed on the way to a node.  It
stops at a share of the squared distance to the query's k-th nearest vector of the sample; the share is calibrated on
the sample by brute force, so that a wanted part of true neighbours lies within.  Close clusters therefore need few
leaves, and only structureless data need many.  Leaves are dealt to buckets of bounded size; a query goes once to each
bucket with the list of its leaves there, is compared in double precision, and its best are merged.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import only, tidy


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the vectors that trees are fitted on (with ``values``, the numbers in them), ``leaf`` the
    sampled vectors of a leaf.

    ``recall``: part of the sample's true neighbours that the queue's limit is calibrated for, on ``trials`` of its
    vectors; 1 or more visits every leaf.  A query's leaves hold at least ``least`` vectors, where one counts once per
    tree.  Leaves of more than ``block`` rows are dealt into several; a bucket has about ``bucket`` rows.
    """

    trees: int = 3
    sample: int = 20_000
    values: int = 4_000_000
    leaf: int = 64
    least: int = 500
    recall: float = 0.95
    trials: int = 256
    block: int = 4096
    bucket: int = 32_768
    seed: int = 17


@dataclass
class Tree:
    """Inner nodes by number; children below 0 are leaves (-1 - leaf number)."""

    directions: np.ndarray
    thresholds: np.ndarray
    children: np.ndarray
    leaves: int

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64) if len(self.children) else np.full(len(x), -1)
        open_ = at >= 0
        while open_.any():
            rows = np.flatnonzero(open_)
            nodes = at[rows]
            right = np.einsum("ij,ij->i", x[rows], self.directions[nodes]) > self.thresholds[nodes]
            at[rows] = self.children[nodes, right.astype(int)]
            open_ = at >= 0
        return -1 - at


def fit_tree(sample: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
    directions, thresholds, children, leaves = [], [], [], 0

    def grow(rows: np.ndarray) -> int:
        nonlocal leaves
        split = None
        for _ in range(4):
            if len(rows) <= leaf:
                break
            a, b = sample[rng.choice(rows, 2, replace=False)]
            d = a - b
            if not (norm := np.linalg.norm(d)):
                d = rng.normal(size=sample.shape[1])
                norm = np.linalg.norm(d)
            d = d / norm
            p = sample[rows] @ d
            t = float(np.median(p))
            if 0 < (p > t).sum() < len(rows):
                split = d, t, p > t
                break
        if split is None:
            leaves += 1
            return -leaves
        n = len(children)
        directions.append(split[0])
        thresholds.append(split[1])
        children.append([0, 0])
        children[n] = [grow(rows[~split[2]]), grow(rows[split[2]])]
        return n

    grow(np.arange(len(sample)))
    dims = sample.shape[1] if sample.ndim == 2 else 0
    return Tree(np.array(directions).reshape(-1, dims), np.array(thresholds), np.array(children, dtype=np.int64).reshape(-1, 2), leaves)


def leaf_margins(tree: Tree, query: np.ndarray) -> np.ndarray:
    """Sum of squared margins between a query and each leaf."""
    out, p = np.zeros(tree.leaves), tree.directions @ query - tree.thresholds
    open_ = [(0 if len(p) else -1, 0.0)]
    while open_:
        node, far = open_.pop()
        if node < 0:
            out[-1 - node] = far
        else:
            side = int(p[node] > 0)
            open_ += [(int(tree.children[node, side]), far), (int(tree.children[node, 1 - side]), far + p[node] * p[node])]
    return out


def calibrate(sample: np.ndarray, ids: np.ndarray, trees: list[Tree], k: int, s: Settings, rng: np.random.Generator) -> float:
    """Squared margin, as a share of the squared distance to the k-th nearest, within which ``s.recall`` of the sample's
    true neighbours have a leaf."""
    if s.recall >= 1:
        return float("inf")
    leaves, needs = [t.leaf_of(sample) for t in trees], []
    for i in rng.permutation(len(sample))[: s.trials].tolist():
        d = ((sample - sample[i]) ** 2).sum(axis=1)
        d[ids == ids[i]] = np.inf
        near = np.argsort(d, kind="stable")[:k]
        near = near[np.isfinite(d[near])]
        if len(near):
            far = np.min([leaf_margins(t, sample[i])[leaf[near]] for t, leaf in zip(trees, leaves)], axis=0)
            needs.append(far / max(d[near[-1]], 1e-300))
    return float(np.quantile(np.concatenate(needs), s.recall)) if needs else float("inf")


def search_leaves(query: np.ndarray, trees: list[Tree], sizes: list[np.ndarray], limit: float, least: int = 0) -> list[tuple[int, int]]:
    """``(tree, leaf)`` in the order of the shared queue up to the squared margin ``limit``, and on until the leaves hold
    ``least`` vectors."""
    queue: list[tuple[float, int, int, int]] = [(0.0, t, t, 0 if len(tree.children) else -1) for t, tree in enumerate(trees)]
    projections = [(tree.directions @ query - tree.thresholds).tolist() for tree in trees]
    children = [tree.children.tolist() for tree in trees]
    heapq.heapify(queue)
    found, held, n = [], 0, len(queue)
    while queue and (queue[0][0] <= limit or held < least):
        margin, _, t, node = heapq.heappop(queue)
        while node >= 0:
            p = projections[t][node]
            right = p > 0
            n += 1
            heapq.heappush(queue, (margin + p * p, n, t, children[t][node][not right]))
            node = children[t][node][right]
        found.append((t, -1 - node))
        held += int(sizes[t][-1 - node])
    return found


def usable(vector, dims: int | None = None):
    """Condition: not null, not empty, all components finite, not all zero."""
    finite = F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    return finite & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column, dims: int) -> np.ndarray:
    flat = column.flatten() if hasattr(column, "flatten") else column
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _best(q: np.ndarray, q_id: int, x: np.ndarray, ids: np.ndarray, norms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances of the ``k`` nearest rows in double precision; of an id's rows the nearest counts."""
    rough = norms - 2 * (x @ q)  # chooses; what its rounding could change is measured exactly
    rough[ids == q_id] = np.inf
    slack, m = 1e-12 * (float(norms.max(initial=0.0)) + float(q @ q)), 4 * k
    chosen = np.flatnonzero(np.isfinite(rough))
    while m < len(chosen):  # until k ids are held
        best = np.argpartition(rough, m - 1)[:m]
        best = best[np.argsort(rough[best], kind="stable")]
        first = np.sort(np.unique(ids[best], return_index=True)[1])
        if len(first) >= k:
            chosen = np.flatnonzero(rough <= rough[best[first[k - 1]]] + slack)
            break
        m *= 4
    d = np.sqrt(((x[chosen] - q) ** 2).sum(axis=1))
    order = np.lexsort((ids[chosen], d))
    order = order[np.sort(np.unique(ids[chosen][order], return_index=True)[1])][:k]
    return ids[chosen][order], d[order]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, settings: Settings | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query the ``k`` nearest vectors found, by Euclidean distance.

    ``vectors`` and ``queries`` have ``vec_id`` and ``embedding``; other columns are ignored.  Rows whose vector is
    null, empty, zero or holds null or non-finite components, or whose id is null, take no part; nor do vectors of
    another length than the table's most frequent one.  A query's own id is no candidate; ties go to the smaller id;
    rows of one id count as one candidate, the nearest.  No queries or no vectors give no rows.
    """
    s = settings or Settings()
    spark = vectors.sparkSession
    fit = usable(F.col("embedding")) & F.col("vec_id").isNotNull()
    kind = dict(vectors.dtypes)["embedding"]
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    clean = only(vectors, "vec_id", "embedding").where(fit).select("vec_id", F.col("embedding").cast(kind).alias("v"))
    asked = only(queries, "vec_id", "embedding").where(fit).select(F.col("vec_id").alias("query_id"), F.col("embedding").cast(kind).alias("v")).dropDuplicates(["query_id"])
    counts = clean.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if counts is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, total = counts["dims"], counts["count"]
    clean, asked = clean.where(F.size("v") == dims), asked.where(F.size("v") == dims)
    drawn = clean.orderBy(F.xxhash64("vec_id", F.lit(s.seed)), "vec_id", "v").limit(max(1, min(s.sample, s.values // dims))).toArrow()  # bounded
    sample, sample_ids = _matrix(drawn["v"].combine_chunks(), dims), drawn["vec_id"].to_numpy()
    rng = np.random.default_rng(s.seed)
    trees = [fit_tree(sample, s.leaf, rng) for _ in range(s.trees)]
    share = calibrate(sample, sample_ids, trees, k, s, rng)
    forest = spark.sparkContext.broadcast((trees, sample, sample_ids))  # at most 2 * sample / leaf hyperplanes per tree
    offsets = np.concatenate([[0], np.cumsum([t.leaves for t in trees])]).astype(np.int64)  # leaves are numbered through

    def tally(batches):
        n = np.zeros(offsets[-1], np.int64)
        for b in batches:
            x = _matrix(b.column(0), dims)
            for t, tree in enumerate(forest.value[0]):
                n += np.bincount(offsets[t] + tree.leaf_of(x), minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["leaf", "n"])

    sizes = np.zeros(offsets[-1], np.int64)
    for r in clean.select("v").mapInArrow(tidy(tally), "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect():  # one row per leaf
        sizes[r.leaf] = r.n
    parts = np.maximum(1, -(-sizes // s.block))  # blocks of each leaf
    starts = np.concatenate([[0], np.cumsum(parts)])[:-1]  # blocks are numbered through
    buckets = max(1, -(-int(total) * s.trees // s.bucket))
    plan = spark.sparkContext.broadcast((sizes, parts, starts))

    def bucket_of(block: np.ndarray) -> np.ndarray:
        h = block.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h ^ (h >> np.uint64(31))) % np.uint64(buckets)).astype(np.int64)

    def assign(batches):
        _, parts, starts = plan.value
        for b in batches:
            x, ids = _matrix(b.column(1), dims), b.column(0).to_numpy().astype(np.int64)
            h = ids.view(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
            spread = (h ^ (h >> np.uint64(32))) >> np.uint64(8)
            for t, tree in enumerate(forest.value[0]):
                leaf = offsets[t] + tree.leaf_of(x)
                block = starts[leaf] + (spread % parts[leaf].astype(np.uint64)).astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32)), pa.array(block))
                yield pa.RecordBatch.from_arrays([pa.array(bucket_of(block)), pa.array(np.zeros(len(x), np.int32)), b.column(0), b.column(1), lists], names=["bucket", "kind", "id", "v", "blocks"])

    def probe(batches):
        sizes, parts, starts = plan.value
        trees, sample, sample_ids = forest.value
        norms, by_tree = (sample * sample).sum(axis=1), [sizes[offsets[t] : offsets[t + 1]] for t in range(len(trees))]
        for b in batches:
            for i, (q, v) in enumerate(zip(b.column(0).to_pylist(), _matrix(b.column(1), dims))):
                _, d = _best(v, q, sample, sample_ids, norms, k)
                limit = share * d[-1] ** 2 if len(d) == k else float("inf")
                found = np.array([offsets[t] + leaf for t, leaf in search_leaves(v, trees, by_tree, limit, s.least)])
                found = found[sizes[found] > 0]
                block = np.concatenate([np.zeros(0, np.int64), *[np.arange(starts[x], starts[x] + parts[x]) for x in found]])
                to = bucket_of(block)
                order = np.argsort(to, kind="stable")
                keys, cuts = np.unique(to[order], return_index=True)
                lists = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(order)).astype(np.int32)), pa.array(block[order]))
                one = b.slice(i, 1).take(pa.array(np.zeros(len(keys), np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.ones(len(keys), np.int32)), one.column(0), one.column(1), lists], names=["bucket", "kind", "id", "v", "blocks"])

    def compare(batches):
        at, x, ids, block, norms, held = None, None, None, None, None, []
        for b in batches:
            if not b.num_rows:
                continue
            bucket, sort = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero((bucket[1:] != bucket[:-1]) | (sort[1:] != sort[:-1])) + 1, [b.num_rows]]).tolist()
            for start, stop in zip(cuts[:-1], cuts[1:]):
                some, key = b.slice(start, stop - start), int(bucket[start])
                if key != at:
                    at, x, held = key, None, []
                v = _matrix(some.column(3), dims)
                if sort[start] == 0:  # the bucket's vectors come first
                    held.append((v, some.column(2).to_numpy(), some.column(4).flatten().to_numpy()))
                elif held:
                    if x is None:
                        x, ids, block = (np.concatenate([h[n] for h in held]) for n in range(3))
                        order = np.argsort(block, kind="stable")
                        x, ids, block, held = x[order], ids[order], block[order], held[:1]
                        norms = (x * x).sum(axis=1)
                    out: tuple[list, list, list] = ([], [], [])
                    for q, q_id, wanted in zip(v, some.column(2).to_pylist(), some.column(4)):
                        wanted = wanted.values.to_numpy()
                        low, high = np.searchsorted(block, wanted), np.searchsorted(block, wanted, side="right")
                        rows = np.concatenate([np.zeros(0, np.int64), *map(np.arange, low.tolist(), high.tolist())])
                        near, d = _best(q, q_id, x[rows], ids[rows], norms[rows], k)
                        for column, values in zip(out, ([q_id] * len(d), near.tolist(), d.tolist())):
                            column.extend(values)
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    schema = f"bucket long, kind int, id long, v {kind}, blocks array<long>"
    rows = clean.mapInArrow(tidy(assign), schema).union(asked.mapInArrow(tidy(probe), schema))
    # a task holds one bucket of vectors and one batch of queries at a time
    pairs = rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(tidy(compare), "query_id long, vec_id long, score double")
    once = pairs.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
