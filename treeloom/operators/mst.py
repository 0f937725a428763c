"""Minimum spanning trees (forests, where a graph isn't connected), for many graphs at once.

Edges are totally ordered by (weight, src, dst), so every method gives the same tree.  ``kruskal`` and ``prim`` solve
one graph per task, next to its edges; ``boruvka`` (and its message-passing sibling ``ghs``) works by keyed minima over
all edges and suits graphs that exceed a task.  ``ghs`` names the same rounds: what the message-passing algorithm
computes in them, the least edge that leaves each vertex and each fragment, are ``vertex_minimum`` and
``fragment_minimum``.  ``auto`` counts the edges and decides.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import saved

#: Graphs with more edges are solved by ``boruvka`` if the method is ``auto``.
ONE_TASK_EDGES = 2_000_000
METHODS = ("auto", "kruskal", "prim", "boruvka", "ghs")


def _find(parent: dict, v):
    while parent[v] != v:
        parent[v] = parent[parent[v]]
        v = parent[v]
    return v


def _kruskal(e: pd.DataFrame) -> np.ndarray:
    """Row numbers of the tree's edges: by ascending edges, those that join two sets."""
    order = np.lexsort((e["dst"], e["src"], e["weight"]))
    src, dst = e["src"].tolist(), e["dst"].tolist()
    parent = {v: v for v in set(src) | set(dst)}
    chosen = []
    for k in order.tolist():
        a, b = _find(parent, src[k]), _find(parent, dst[k])
        if a != b:
            parent[a] = b
            chosen.append(k)
    return np.array(chosen, dtype=int)


def _prim(e: pd.DataFrame) -> np.ndarray:
    """Row numbers of the tree's edges: from a vertex, again and again the least edge that leaves the tree."""
    src, dst, weight = e["src"].tolist(), e["dst"].tolist(), e["weight"].tolist()
    near: dict = {}
    for k, (a, b, w) in enumerate(zip(src, dst, weight)):
        near.setdefault(a, []).append((w, a, b, k, b))
        near.setdefault(b, []).append((w, a, b, k, a))
    reached, chosen = set(), []
    for start in sorted(near):
        if start in reached:
            continue
        reached.add(start)
        heap = list(near[start])
        heapq.heapify(heap)
        while heap:
            *_, k, v = heapq.heappop(heap)
            if v not in reached:
                reached.add(v)
                chosen.append(k)
                for edge in near[v]:
                    if edge[4] not in reached:
                        heapq.heappush(heap, edge)
    return np.array(chosen, dtype=int)


def _boruvka(edges: DataFrame, by: list[str]) -> DataFrame:
    """Rounds of: least edge that leaves each component; join what they connect; relabel.  Original ends are kept."""
    schema = edges.schema
    edges = saved(edges, "edges")
    ends = edges.select(*by, F.col("src").alias("id")).union(edges.select(*by, "dst")).distinct()
    labels = saved(ends.withColumn("comp", F.col("id")), "components")
    tree = None
    order = F.struct("weight", "src", "dst")
    while True:
        s = labels.select(*by, F.col("id").alias("src"), F.col("comp").alias("cs"))
        d = labels.select(*by, F.col("id").alias("dst"), F.col("comp").alias("cd"))
        crossing = edges.join(s, [*by, "src"]).join(d, [*by, "dst"]).where("cs <> cd")
        leaving = crossing.select(*by, F.col("cs").alias("comp"), "cd", order.alias("e")).union(crossing.select(*by, F.col("cd"), F.col("cs"), order))
        least = saved(leaving.groupBy(*by, "comp").agg(F.min(F.struct("e", "cd")).alias("m")).select(*by, "comp", F.col("m.cd").alias("to"), F.col("m.e").alias("e")), "least")
        if least.isEmpty():
            break
        found = least.select(*by, "e.*").distinct()
        tree = found if tree is None else tree.union(found)
        # chosen links form trees in which exactly one pair of components points at each other: the smaller one is the root
        back = least.select(*by, F.col("comp").alias("to"), F.col("to").alias("back"))
        up = least.join(back, [*by, "to"]).select(*by, "comp", F.when((F.col("back") == F.col("comp")) & (F.col("comp") < F.col("to")), F.col("comp")).otherwise(F.col("to")).alias("to"))
        up = saved(up, "pointers")
        while True:  # pointer jumping: depth halves each time
            on = up.select(*by, F.col("comp").alias("to"), F.col("to").alias("further"))
            step = saved(up.join(on, [*by, "to"]).select(*by, "comp", "to", "further"), "pointers")
            if step.where("further <> to").isEmpty():
                break
            up = step.select(*by, "comp", F.col("further").alias("to"))
        labels = saved(labels.join(up, [*by, "comp"], "left").select(*by, "id", F.coalesce("to", "comp").alias("comp")), "components")
    if tree is None:
        return edges.limit(0)
    return tree.select(*[F.col(f.name).cast(f.dataType) for f in schema])


def mst(edges: DataFrame, method: str = "auto", by: tuple[str, ...] = ()) -> DataFrame:
    """Tree edges ``src, dst, weight`` of an undirected graph, or of one graph per value of the columns ``by``."""
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}")
    by = list(by)
    # one orientation and one edge per pair
    edges = edges.where("src <> dst").groupBy(*by, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min("weight").alias("weight"))
    edges = edges.select(*by, "src", "dst", "weight")
    if method == "auto":
        edges = saved(edges, "edges")
        most = edges.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
        method = "kruskal" if most <= ONE_TASK_EDGES else "boruvka"
    if method in ("boruvka", "ghs"):
        return _boruvka(edges, by)
    solve = _kruskal if method == "kruskal" else _prim

    def one(e: pd.DataFrame) -> pd.DataFrame:
        return e.iloc[solve(e)]

    return edges.groupBy(*by).applyInPandas(one, edges.schema)


def fragment_minimum(edges: DataFrame, fragments: DataFrame) -> DataFrame:
    """``frag, src, dst, weight``: the least edge leaving each fragment of ``fragments(id, frag)``."""
    s = fragments.select(F.col("id").alias("src"), F.col("frag").alias("fs"))
    d = fragments.select(F.col("id").alias("dst"), F.col("frag").alias("fd"))
    out = edges.join(s, "src").join(d, "dst").where("fs <> fd")
    e = F.struct("weight", "src", "dst").alias("e")
    return out.select(F.explode(F.array("fs", "fd")).alias("frag"), e).groupBy("frag").agg(F.min("e").alias("e")).select("frag", "e.src", "e.dst", "e.weight")


def vertex_minimum(edges: DataFrame, fragments: DataFrame) -> DataFrame:
    """``id, src, dst, weight``: the least edge at each vertex that leaves its fragment."""
    s = fragments.select(F.col("id").alias("src"), F.col("frag").alias("fs"))
    d = fragments.select(F.col("id").alias("dst"), F.col("frag").alias("fd"))
    out = edges.join(s, "src").join(d, "dst").where("fs <> fd")
    e = F.struct("weight", "src", "dst").alias("e")
    return out.select(F.explode(F.array("src", "dst")).alias("id"), e).groupBy("id").agg(F.min("e").alias("e")).select("id", "e.src", "e.dst", "e.weight")


def total_weight(tree: DataFrame) -> DataFrame:
    """``edges, weight``: number of edges and their sum."""
    return tree.agg(F.count("*").alias("edges"), F.sum("weight").alias("weight"))
