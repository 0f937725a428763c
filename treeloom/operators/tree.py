"""Orientation of spanning trees and learning of their conditional probability tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .info import both_ways

ESTIMATORS = ("mle", "bayes", "laplace")


def orient(edges: DataFrame, root: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """``var, parent, level, weight`` by breadth-first search from ``root`` (the least id by default).

    The root has no parent and level 0.  Vertices that the root doesn't reach are left out.  One tree is one task's
    work: it has as many edges as an observation has values.
    """
    by = list(by)

    def one(e: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for a, b, w in zip(e["src"].tolist(), e["dst"].tolist(), e["weight"].tolist()):
            near.setdefault(a, []).append((b, w))
            near.setdefault(b, []).append((a, w))
        start = root if root is not None else min(near)
        rows, seen, level = [(start, None, 0, None)], {start}, [start]
        depth = 0
        while level:
            depth += 1
            after = []
            for v in level:
                for u, w in sorted(near.get(v, [])):
                    if u not in seen:
                        seen.add(u)
                        rows.append((u, v, depth, w))
                        after.append(u)
            level = after
        out = pd.DataFrame(rows, columns=["var", "parent", "level", "weight"]).astype({"parent": "Int64"})
        for c in by:
            out[c] = e[c].iloc[0]
        return out[[*by, "var", "parent", "level", "weight"]]

    kinds = {f.name: f.dataType.simpleString() for f in edges.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "var long, parent long, level int, weight double"])
    return edges.groupBy(*by).applyInPandas(one, schema)


def node_state(tree: DataFrame) -> DataFrame:
    """``var, state``: root, leaf or node."""
    parents = tree.select(F.col("parent").alias("p")).where("p IS NOT NULL").distinct()
    state = F.when(F.col("level") == 0, "root").when(F.col("p").isNull(), "leaf").otherwise("node")
    return tree.join(parents, tree["var"] == parents.p, "left").select("var", state.alias("state"))


def depth(tree: DataFrame) -> DataFrame:
    return tree.agg(F.max("level").alias("depth"))


def tables(tree: DataFrame, c1: DataFrame, c2: DataFrame, estimator: str = "mle", by: tuple[str, ...] = ()) -> DataFrame:
    """CPTs ``var, x, parent_x, p`` of a tree, p = P(var = x | parent = parent_x); the root's rows have no ``parent_x``.

    ``mle``: n(x,y) / n(y).  ``laplace``: (n(x,y) + 1) / (n(y) + number of values of var).  ``bayes``: smoothing as in
    earlier work, ((n(x,y)+1) / (N + max x)) / ((n(y)+1) / (N + y)) and (n(x)+1) / (N + x) for the root; it doesn't
    sum to 1.  Only pairs of values that occur have rows.  Weighted counts give weighted estimates.
    """
    if estimator not in ESTIMATORS:
        raise ValueError(f"estimator is one of {ESTIMATORS}")
    by = list(by)
    total = F.sum("n").over(Window.partitionBy(*by, "var"))
    marginal = c1.select(*by, "var", "x", "n", total.alias("mass"), F.count("*").over(Window.partitionBy(*by, "var")).alias("card"), F.max("x").over(Window.partitionBy(*by, "var")).alias("top"))
    n, big, x = F.col("n"), F.col("mass"), F.col("x")
    root_p = {"mle": n / big, "laplace": (n + 1) / (big + F.col("card")), "bayes": (n + 1) / (big + x)}[estimator]
    roots = tree.where("parent IS NULL").select(*by, "var").join(marginal, [*by, "var"]).select(*by, "var", "x", F.lit(None).cast("double").alias("parent_x"), root_p.alias("p"))
    pairs = _both(c2, by).withColumnRenamed("cond", "parent").withColumnRenamed("c", "y")
    inner = tree.where("parent IS NOT NULL").select(*by, "var", "parent").join(pairs, [*by, "var", "parent"])
    of_parent = marginal.select(*by, F.col("var").alias("parent"), F.col("x").alias("y"), F.col("n").alias("ny"), "mass")
    of_child = marginal.select(*by, "var", "card", "top").distinct()
    inner = inner.join(of_parent, [*by, "parent", "y"]).join(of_child, [*by, "var"])
    ny, y = F.col("ny"), F.col("y")
    p = {"mle": n / ny, "laplace": (n + 1) / (ny + F.col("card")), "bayes": ((n + 1) / (big + F.col("top"))) / ((ny + 1) / (big + y))}[estimator]
    return roots.unionByName(inner.select(*by, "var", "x", F.col("y").alias("parent_x"), p.alias("p")))


def _both(c2: DataFrame, by: list[str]) -> DataFrame:
    if not by:
        return both_ways(c2)
    one = c2.select(*by, F.col("src").alias("var"), F.col("dst").alias("cond"), "x", F.col("y").alias("c"), "n")
    return one.union(c2.select(*by, F.col("dst"), F.col("src"), F.col("y"), F.col("x"), F.col("n")))
