"""Contingency counts, on which every measure rests.

Few variables: each row is exploded into its pairs, which map-side aggregation folds to at most card squared rows per
pair and task.  Many variables: one-hot blocks are multiplied per Arrow batch, a strip of variables in each scan.
Several weight columns (trees of a mixture) are summed side by side, so samples are never replicated.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to so many variables pairs are exploded in the JVM.
EXPLODE_UP_TO = 40
#: Variables whose pairs with all later ones a scan counts, beyond that.
STRIP = 64


def _weights(obs: DataFrame, weights: list[str] | None) -> list[str]:
    if weights is not None:
        return weights
    return ["w"] if "w" in obs.columns else []


def counts1(obs: DataFrame, weights: list[str] | None = None) -> DataFrame:
    """``var, x, n``, or one sum per weight column where several are named; masses of zero or less fall away.

    A null value is missing and counts for nothing, as do null rows and the places that a shorter row doesn't have.
    """
    names = _weights(obs, weights)
    long = obs.select(*names, F.posexplode("xs").alias("var", "x")).where("x IS NOT NULL")
    return _summed(long, [F.col("var").cast("long").alias("var"), F.col("x")], names)


def counts2(obs: DataFrame, weights: list[str] | None = None, variables: int | None = None) -> DataFrame:
    """``src, dst, x, y, n`` for all ``src < dst``, as ``counts1``; a pair counts where both values are there.

    ``variables``: width of the longest row, which is looked up if it isn't known.
    """
    names = _weights(obs, weights)
    if variables is None:
        variables = obs.agg(F.max(F.size("xs"))).first()[0] or 0
    if variables < 2:
        return _summed(obs.limit(0).select(*names, F.lit(0).cast("long").alias("src"), F.lit(0).cast("long").alias("dst"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), [F.col(c) for c in ("src", "dst", "x", "y")], names)
    if variables <= EXPLODE_UP_TO:
        value = lambda i: F.get("xs", F.lit(i))
        pairs = F.array(*[F.struct(F.lit(i).cast("long").alias("src"), F.lit(j).cast("long").alias("dst"), value(i).alias("x"), value(j).alias("y")) for i in range(variables) for j in range(i + 1, variables)])
        long = obs.select(*names, F.explode(pairs).alias("p")).select(*names, "p.*").where("x IS NOT NULL AND y IS NOT NULL")
        return _summed(long, [F.col(c) for c in ("src", "dst", "x", "y")], names)
    return _blocked(obs, names, variables)


def _summed(long: DataFrame, keys: list, names: list[str]) -> DataFrame:
    if not names:
        return long.groupBy(*keys).agg(F.count("*").cast("double").alias("n"))
    if len(names) == 1:
        return long.groupBy(*keys).agg(F.sum(names[0]).cast("double").alias("n")).where("n > 0")
    return long.groupBy(*keys).agg(*[F.sum(c).cast("double").alias(c) for c in names])


def _matrix(column, width: int) -> np.ndarray:
    """Rows of a list column as a matrix; NaN stands for what is null or not there."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    lengths = np.diff(column.offsets.to_numpy())
    out = np.full((len(column), width), np.nan)
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


class _Codes:
    """Numbers of (variable, value) in the order of their appearance."""

    def __init__(self):
        self.known: dict[tuple[int, float], int] = {}

    def hot(self, xs: np.ndarray, first: int) -> np.ndarray:
        """One-hot rows of values; variables are counted from ``first``."""
        codes = np.empty(xs.shape, np.int64)
        for v in range(xs.shape[1]):
            values, inverse = np.unique(xs[:, v], return_inverse=True)
            codes[:, v] = np.array([-1 if np.isnan(x) else self.known.setdefault((first + v, float(x)), len(self.known)) for x in values])[inverse]
        out = np.zeros((len(xs), len(self.known)))
        row, col = np.nonzero(codes >= 0)
        out[row, codes[row, col]] = 1.0
        return out

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array([k[0] for k in self.known], np.int64), np.array([k[1] for k in self.known])


def _blocked(obs: DataFrame, names: list[str], variables: int) -> DataFrame:
    """Pair counts by products of one-hot matrices, a batch at a time; for unweighted and weighted samples.

    A scan handles ``STRIP`` variables against all later ones, so that a task's sums are bounded; nothing is shuffled
    but these sums.
    """
    columns = names or ["n"]
    obs = obs.where("xs IS NOT NULL").select(F.col("xs").cast("array<double>").alias("xs"), *names)

    def strip(low: int):
        def run(batches):
            totals: dict[str, np.ndarray] = {}
            own, later = _Codes(), _Codes()
            for b in batches:
                for at in range(0, b.num_rows, 2048):
                    part = b.slice(at, 2048)
                    xs = _matrix(part.column(0), variables)
                    a, c = own.hot(xs[:, low : low + STRIP], low), later.hot(xs[:, low:], low)
                    for k, name in enumerate(columns):
                        w = part.column(1 + k).to_numpy(zero_copy_only=False).astype(float) if names else None
                        product = (a if w is None else a * w[:, None]).T @ c
                        if (old := totals.get(name)) is not None:
                            product[: old.shape[0], : old.shape[1]] += old
                        totals[name] = product
            if not own.known:
                return
            (var, val), (var2, val2) = own.keys(), later.keys()
            i, j = np.nonzero(sum(np.abs(t) for t in totals.values()))
            take = var[i] < var2[j]
            i, j = i[take], j[take]
            for at in range(0, len(i), 50_000):
                p, q = i[at : at + 50_000], j[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(var[p]), pa.array(var2[q]), pa.array(val[p]), pa.array(val2[q]), *[pa.array(totals[n][p, q]) for n in columns]], names=["src", "dst", "x", "y", *columns])

        return run

    schema = "src long, dst long, x double, y double, " + ", ".join(f"`{c}` double" for c in columns)
    parts = [obs.mapInArrow(strip(low), schema) for low in range(0, variables, STRIP)]
    out = reduce(DataFrame.union, parts).groupBy("src", "dst", "x", "y").agg(*[F.sum(c).alias(c) for c in columns])
    if len(names) <= 1:
        return out.withColumnRenamed(columns[0], "n").where("n > 0")
    return out
