"""Exact belief propagation, batched over cases.

A model (tree and tables) has as many rows as its variables' values, so it is collected and broadcast; cases stay where
they are and each Arrow batch is propagated at once: upward products of lambda messages, downward pi messages.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A model with more table rows isn't broadcast.
MODEL_ROWS = 20_000_000


@dataclass
class Model:
    """Variables in breadth-first order; ``tables[v][x, y]`` = P(v = values[v][x] | parent = values[parent][y])."""

    order: list[int]
    parent: dict[int, int | None]
    values: dict[int, np.ndarray]
    tables: dict[int, np.ndarray]

    def beliefs(self, evidence: dict[int, np.ndarray], cases: int) -> dict[int, np.ndarray]:
        """Normalised beliefs, cases x values; rows of impossible evidence are NaN.  NaN in evidence: not observed."""
        lam = {}
        for v in self.order:
            e = evidence.get(v)
            lam[v] = np.ones((cases, len(self.values[v]))) if e is None else np.where(np.isnan(e)[:, None], 1.0, (e[:, None] == self.values[v][None, :]).astype(float))
        children: dict[int, list[int]] = {v: [] for v in self.order}
        message = {}
        for v in self.order:
            if self.parent[v] is not None:
                children[self.parent[v]].append(v)
        for v in reversed(self.order):
            for c in children[v]:
                lam[v] = lam[v] * message[c]
            if self.parent[v] is not None:
                message[v] = lam[v] @ self.tables[v]
                top = message[v].max(axis=1, keepdims=True)  # keeps long products in range; beliefs are normalised later
                message[v] = message[v] / np.where(top > 0, top, 1.0)
        pi, out = {}, {}
        own = {v: (np.ones_like(lam[v]) if evidence.get(v) is None else np.where(np.isnan(evidence[v])[:, None], 1.0, (evidence[v][:, None] == self.values[v][None, :]).astype(float))) for v in self.order}
        for v in self.order:
            pi[v] = np.repeat(self.tables[v][:, 0][None, :], cases, axis=0) if self.parent[v] is None else pi[v]
            full = pi[v] * lam[v]
            with np.errstate(invalid="ignore", divide="ignore"):
                out[v] = full / full.sum(axis=1, keepdims=True)
            kids = children[v]
            before = [own[v] * pi[v]]
            for c in kids:
                before.append(before[-1] * message[c])
            after = np.ones_like(pi[v])
            for k in range(len(kids) - 1, -1, -1):  # all siblings' messages but the child's own
                to = before[k] * after
                total = to.sum(axis=1, keepdims=True)
                to = to / np.where(total > 0, total, 1.0)
                pi[kids[k]] = to @ self.tables[kids[k]].T
                after = after * message[kids[k]]
        return out

    def log2_likelihood(self, xs: np.ndarray, samples: int) -> np.ndarray:
        """Of complete observations (rows); a pair of values without table row counts 1 / (samples + largest value of var)."""
        out = np.zeros(len(xs))
        for v in self.order:
            val = self.values[v]
            at = np.searchsorted(val, xs[:, v])
            known = (at < len(val)) & (val[np.minimum(at, len(val) - 1)] == xs[:, v])
            row = np.where(known, at, 0)
            if self.parent[v] is None:
                p = np.where(known, self.tables[v][row, 0], 0.0)
            else:
                pv = self.values[self.parent[v]]
                pa_ = np.searchsorted(pv, xs[:, self.parent[v]])
                ok = (pa_ < len(pv)) & (pv[np.minimum(pa_, len(pv) - 1)] == xs[:, self.parent[v]])
                p = np.where(known & ok, self.tables[v][row, np.where(ok, pa_, 0)], 0.0)
            out += np.log2(np.where(p > 0, p, 1.0 / (samples + val.max())))
        return out


def load(tree: DataFrame, cpt: DataFrame, by: str | None = None) -> dict:
    """Models by tree id (key None without ``by``)."""
    if cpt.limit(MODEL_ROWS + 1).count() > MODEL_ROWS:
        raise ValueError("the model is too large to be broadcast")
    t, c = tree.toPandas(), cpt.toPandas()
    out = {}
    for key in sorted(t[by].unique().tolist()) if by else [None]:
        tt, cc = (t[t[by] == key], c[c[by] == key]) if by else (t, c)
        tt = tt.sort_values(["level", "var"])
        parent = {int(v): (None if p != p or p is None else int(p)) for v, p in zip(tt["var"], tt["parent"].astype(object).where(tt["parent"].notna(), None))}
        values = {v: np.unique(cc.loc[cc["var"] == v, "x"].to_numpy(dtype=float)) for v in parent}
        tables = {}
        for v, rows in cc.groupby("var"):
            up = parent[v]
            table = np.zeros((len(values[v]), 1 if up is None else len(values[up])))
            x = np.searchsorted(values[v], rows["x"].to_numpy(dtype=float))
            y = np.zeros(len(rows), int) if up is None else np.searchsorted(values[up], rows["parent_x"].to_numpy(dtype=float))
            table[x, y] = rows["p"].to_numpy(dtype=float)
            tables[v] = table
        out[key] = Model([int(v) for v in tt["var"]], parent, values, tables)
    return out


def infer(models: dict, evidence: DataFrame, by: str | None = None) -> DataFrame:
    """``case_id, var, x, p`` (after the tree id) for every case of ``evidence(case_id, var, x)``.

    A case without evidence is a row whose ``var`` is null.  Values that the model doesn't know, and evidence that it
    deems impossible, give null beliefs.
    """
    spark = evidence.sparkSession
    shared = spark.sparkContext.broadcast(models)
    known = F.filter(F.collect_list(F.struct("var", "x")), lambda e: e["var"].isNotNull())
    cases = evidence.groupBy("case_id").agg(known.alias("e"))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                ids, seen = part.column(0), {}
                for i, e in enumerate(part.column(1).to_pylist()):
                    for pair in e:
                        seen.setdefault(pair["var"], np.full(part.num_rows, np.nan))[i] = pair["x"]
                for key, model in shared.value.items():
                    for v, p in model.beliefs(seen, part.num_rows).items():
                        n = p.shape[1]
                        cols = [ids.take(pa.array(np.repeat(np.arange(part.num_rows), n))), pa.array(np.full(p.size, v)), pa.array(np.tile(model.values[v], part.num_rows)), pa.array(p.ravel(), from_pandas=True)]
                        names = ["case_id", "var", "x", "p"]
                        if by:
                            cols, names = [pa.array(np.full(p.size, key)), *cols], [by, *names]
                        yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = dict(evidence.dtypes)["case_id"]
    return cases.mapInArrow(run, (f"{by} long, " if by else "") + f"case_id {kind}, var long, x double, p double")


def log_likelihood(models: dict, obs: DataFrame, samples: int, by: str | None = None) -> DataFrame:
    """``obs_id, ll`` (after the tree id): base-2 log likelihood of complete observations."""
    spark = obs.sparkSession
    shared = spark.sparkContext.broadcast(models)

    def run(batches):
        for b in batches:
            width = len(b.column(1)[0]) if b.num_rows else 0
            xs = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, width)
            for key, model in shared.value.items():
                cols, names = [b.column(0), pa.array(model.log2_likelihood(xs, samples) if b.num_rows else [], pa.float64())], ["obs_id", "ll"]
                if by:
                    cols, names = [pa.array([key] * b.num_rows, pa.int64()), *cols], [by, *names]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = dict(obs.dtypes)["obs_id"]
    return obs.select("obs_id", "xs").mapInArrow(run, (f"{by} long, " if by else "") + f"obs_id {kind}, ll double")
