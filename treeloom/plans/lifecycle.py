"""Lifecycles that chain the operators."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.counts import counts1, counts2
from ..operators.graph import mi_edges
from ..operators.inference import infer, load, log_likelihood
from ..operators.info import mutual_information
from ..operators.mixture import mcl_b
from ..operators.mst import mst
from ..operators.reshape import by_observation
from ..operators.score import kl_curve
from ..operators.tree import orient, tables
from ..sources import generate_samples
from ..storage import saved


@dataclass
class Learned:
    edges: DataFrame
    tree: DataFrame
    cpt: DataFrame


def learn_tree(obs: DataFrame, weights: list[str] | None = None, method: str = "auto", estimator: str = "mle", root: int | None = None, precision: int | None = None, digits: int = 8) -> Learned:
    """Maximum-weight tree of the samples with its tables.  ``digits`` rounds weights, so that ties break by ids."""
    c1, c2 = saved(counts1(obs, weights), "counts1"), saved(counts2(obs, weights), "counts2")
    mi = mutual_information(c1, c2, precision)
    edges = mst(mi.select("src", "dst", (F.round(-F.col("mi"), digits) + F.lit(0.0)).alias("weight")), method)
    edges = saved(edges, "tree")
    tree = saved(orient(edges, root), "oriented")
    return Learned(edges, tree, tables(tree, c1, c2, estimator))


def answer(model: Learned, evidence: DataFrame) -> DataFrame:
    """Beliefs of all variables for each case of evidence."""
    return infer(load(model.tree, model.cpt), evidence)


def compare_methods(edges: DataFrame, methods: list[str], repeat: int = 3) -> DataFrame:
    """``method, edges, weight, seconds``: mean wall time of each spanning-tree method on one graph."""
    edges = saved(edges, "edges")
    rows = []
    for m in methods:
        took = []
        for _ in range(repeat):
            began = time.perf_counter()
            found = mst(edges, m).agg(F.count("*").alias("n"), F.sum("weight").alias("w")).first()
            took.append(time.perf_counter() - began)
        rows.append((m, found.n, found.w, sum(took) / len(took)))
    return edges.sparkSession.createDataFrame(rows, "method string, edges long, weight double, seconds double")


def _generated(spark: SparkSession, variables: int, samples: int, values: int, seed: int) -> DataFrame:
    """``obs_id, xs`` of random samples with ``values`` values."""
    return saved(by_observation(generate_samples(spark, variables, samples, 0, values - 1, seed)), "samples")


def time_methods(spark: SparkSession, sizes: list[int], methods: list[str], samples: int = 500, values: int = 2, repeat: int = 3) -> DataFrame:
    """``variables, method, edges, weight, seconds``: spanning trees of random samples with so many variables.

    The dependency graph itself is the row with the method ``information``.
    """
    rows = []
    for variables in sizes:
        obs = _generated(spark, variables, samples, values, variables)
        began = time.perf_counter()
        edges = saved(mi_edges(obs, digits=8), "edges")
        rows.append((variables, "information", edges.count(), None, time.perf_counter() - began))
        rows += [(variables, r.method, r.edges, r.weight, r.seconds) for r in compare_methods(edges, methods, repeat).collect()]
    return spark.createDataFrame(rows, "variables int, method string, edges long, weight double, seconds double")


def time_mixtures(spark: SparkSession, sizes: list[int], trees: int = 10, methods: tuple[str, ...] = ("kruskal", "prim"), samples: int = 500, values: int = 2, repeat: int = 3) -> DataFrame:
    """``variables, method, rows, seconds``: mean wall time to learn a mixture of ``trees`` bootstrapped trees, by method."""
    rows = []
    for variables in sizes:
        obs = _generated(spark, variables, samples, values, variables)
        for method in methods:
            took = []
            for _ in range(repeat):
                began = time.perf_counter()
                _, cpt = mcl_b(obs, samples, list(range(trees)), method=method)
                n = cpt.count()
                took.append(time.perf_counter() - began)
            rows.append((variables, method, n, sum(took) / len(took)))
    return spark.createDataFrame(rows, "variables int, method string, rows long, seconds double")


def kl_by_trees(train: DataFrame, n: int, test: DataFrame, densities: DataFrame, sizes: list[int], seeds: list[int] | None = None) -> DataFrame:
    """``trees, kl``: divergence of bootstrapped mixtures by their number of trees."""
    tree, cpt = mcl_b(train, n, seeds or list(range(max(sizes))))
    ll = saved(log_likelihood(load(tree, cpt, "tree_id"), test, n, "tree_id"), "ll")
    return kl_curve(ll, densities, sizes)
