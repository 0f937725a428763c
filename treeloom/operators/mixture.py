"""Mixtures of trees: bootstrapped (MCL-B) and fitted by expectation-maximisation.

Trees of a mixture share every plan: counts for all of them are summed side by side in one pass over the samples, and
``tree_id`` keys what follows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import saved
from .counts import counts1, counts2
from .inference import load, log_likelihood
from .mst import mst
from .resample import bootstrap_weights
from .tree import orient, tables


def by_tree(counts: DataFrame, columns: list[str]) -> DataFrame:
    """``tree_id, ..., n`` of counts with one column per tree; empty masses fall away."""
    keys = [c for c in counts.columns if c not in columns]
    masses = F.array(*[F.col(c) for c in columns])
    return counts.select(*keys, F.posexplode(masses).alias("tree_id", "n")).where("n > 0").select(F.col("tree_id").cast("long").alias("tree_id"), *keys, "n")


def mi_by_tree(c1: DataFrame, c2: DataFrame) -> DataFrame:
    """``tree_id, src, dst, mi`` from counts keyed by tree, in one aggregation: sum n/N log2(n N / (n_x n_y))."""
    total = c1.groupBy("tree_id", "var").agg(F.sum("n").alias("mass")).groupBy("tree_id").agg(F.max("mass").alias("mass"))
    x = c1.select("tree_id", F.col("var").alias("src"), "x", F.col("n").alias("nx"))
    y = c1.select("tree_id", F.col("var").alias("dst"), F.col("x").alias("y"), F.col("n").alias("ny"))
    rows = c2.join(x, ["tree_id", "src", "x"]).join(y, ["tree_id", "dst", "y"]).join(total, "tree_id")
    return rows.groupBy("tree_id", "src", "dst").agg(F.sum(F.col("n") / F.col("mass") * F.log2(F.col("n") * F.col("mass") / (F.col("nx") * F.col("ny")))).alias("mi"))


def _structures(c1: DataFrame, c2: DataFrame, method: str, digits: int) -> DataFrame:
    edges = mi_by_tree(c1, c2).select("tree_id", "src", "dst", (F.round(-F.col("mi"), digits) + F.lit(0.0)).alias("weight"))
    return orient(mst(edges, method, by=("tree_id",)), by=("tree_id",))


def mcl_b(obs: DataFrame, n: int, seeds: list[int], estimator: str = "mle", method: str = "kruskal", digits: int = 8) -> tuple[DataFrame, DataFrame]:
    """Trees and tables keyed by ``tree_id``: structures from bootstrap samples, parameters from all observations."""
    names = [f"w{k}" for k in range(len(seeds))]
    weighted = saved(bootstrap_weights(obs.select("obs_id", "xs"), n, seeds).withColumn("all", F.lit(1.0)), "bootstrap")
    every = [*names, "all"]
    c1, c2 = saved(counts1(weighted, every), "counts1"), saved(counts2(weighted, every), "counts2")
    trees = saved(_structures(by_tree(c1.drop("all"), names), by_tree(c2.drop("all"), names), method, digits), "trees")
    ids = trees.select("tree_id").distinct()
    full1 = c1.select("var", "x", F.col("all").alias("n")).join(ids)
    full2 = c2.select("src", "dst", "x", "y", F.col("all").alias("n")).join(ids)
    return trees, tables(trees, full1, full2, estimator, by=("tree_id",))


def mixture_belief(beliefs: DataFrame, weights: dict[int, float] | None = None) -> DataFrame:
    """``case_id, var, x, p``: mean (or weighted sum) of the trees' beliefs ``tree_id, case_id, var, x, p``."""
    if weights is None:
        n = F.countDistinct("tree_id")
        trees = beliefs.agg(n).first()[0]
        return beliefs.groupBy("case_id", "var", "x").agg((F.sum("p") / trees).alias("p"))
    w = F.coalesce(*[F.when(F.col("tree_id") == k, F.lit(float(v))) for k, v in weights.items()])
    return beliefs.groupBy("case_id", "var", "x").agg(F.sum(F.col("p") * w).alias("p"))


def responsibilities(ll: DataFrame, mu: dict[int, float]) -> DataFrame:
    """``tree_id, obs_id, gamma``: shares of mu * 2**ll of each observation, scaled by its best tree first."""
    from pyspark.sql import Window

    w = Window.partitionBy("obs_id")
    prior = F.coalesce(*[F.when(F.col("tree_id") == k, F.lit(float(np.log2(v)) if v > 0 else float("-inf"))) for k, v in mu.items()])
    rows = ll.withColumn("s", F.col("ll") + prior)
    rows = rows.withColumn("e", F.pow(F.lit(2.0), F.col("s") - F.max("s").over(w)))
    return rows.select("tree_id", "obs_id", (F.col("e") / F.sum("e").over(w)).alias("gamma"))


def fit_em(obs: DataFrame, trees: int, samples: int, start: DataFrame, max_iter: int = 20, tol: float = 1e-6, method: str = "kruskal", digits: int = 8) -> tuple[DataFrame, DataFrame, dict[int, float], list[float]]:
    """EM-MT: trees, tables, mixing weights and the mean log2 likelihood before each step.

    ``start(obs_id, fold)`` deals observations to trees at first.  A step relearns every tree from its responsibilities
    as weights and sets each mixing weight to their mean; it stops when the likelihood gains less than ``tol``.
    """
    names = [f"g{k}" for k in range(trees)]
    base = obs.select("obs_id", "xs")
    state = base.join(start, "obs_id").select("obs_id", "xs", *[F.when(F.col("fold") == k, 1.0).otherwise(0.0).alias(c) for k, c in enumerate(names)])
    history: list[float] = []
    for _ in range(max_iter):
        state = saved(state, "em")
        c1, c2 = by_tree(counts1(state, names), names), by_tree(counts2(state, names), names)
        c1, c2 = saved(c1, "em1"), saved(c2, "em2")
        tree = saved(_structures(c1, c2, method, digits), "emt")
        cpt = saved(tables(tree, c1, c2, "mle", by=("tree_id",)), "emc")
        sums = state.agg(*[F.avg(c).alias(c) for c in names]).first()
        mu = {k: float(sums[c]) for k, c in enumerate(names)}
        models = load(tree, cpt, "tree_id")
        shared = base.sparkSession.sparkContext.broadcast((models, mu))

        def run(batches):
            held, weights = shared.value
            for b in batches:
                xs = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                s = np.full((b.num_rows, trees), -np.inf)
                for k, m in held.items():
                    if weights[k] > 0:
                        s[:, k] = m.log2_likelihood(xs, samples) + np.log2(weights[k])
                top = s.max(axis=1, keepdims=True)
                e = np.exp2(s - top)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(g) for g in (e / e.sum(axis=1, keepdims=True)).T], pa.array(top[:, 0] + np.log2(e.sum(axis=1)))], names=["obs_id", "xs", *names, "score"])

        kind = dict(base.dtypes)["obs_id"]
        scored = saved(base.mapInArrow(run, f"obs_id {kind}, xs array<double>, " + ", ".join(f"{c} double" for c in names) + ", score double"), "ems")
        history.append(scored.agg(F.avg("score")).first()[0])
        state = scored.drop("score")
        if len(history) > 1 and history[-1] - history[-2] < tol:
            break
    return tree, cpt, mu, history


__all__ = ["by_tree", "fit_em", "log_likelihood", "mcl_b", "mi_by_tree", "mixture_belief", "responsibilities"]
