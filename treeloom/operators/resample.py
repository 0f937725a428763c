"""Bootstrap, independent resampling, splits and folds; all seeded and reproducible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hash_uniform


def bootstrap_index(spark, n: int, seed: int = 0) -> DataFrame:
    """``draw, obs_id``: ``n`` draws with replacement of 0..n-1, the same for all variables."""
    return spark.range(n).select(F.col("id").alias("draw"), F.floor(hash_uniform(F.col("id"), seed) * n).alias("obs_id"))


def bootstrap_weights(obs: DataFrame, n: int, seeds: list[int]) -> DataFrame:
    """Add ``w0, w1, ...``: how often each observation (0..n-1) is drawn for each seed.

    Samples aren't copied: the draws of all seeds are counted side by side and joined once.
    """
    draws = F.array(*[F.struct(F.lit(k).alias("k"), F.floor(hash_uniform(F.col("id"), seed) * n).alias("obs_id")) for k, seed in enumerate(seeds)])
    drawn = obs.sparkSession.range(n).select(F.explode(draws).alias("d")).select("d.*")
    names = [f"w{k}" for k in range(len(seeds))]
    counted = drawn.groupBy("obs_id").agg(*[F.sum(F.when(F.col("k") == k, 1.0).otherwise(0.0)).alias(c) for k, c in enumerate(names)])
    return obs.join(counted, "obs_id", "left").fillna(0.0, names)


def poisson_weight(number: Column, seed: int = 0, most: int = 12) -> Column:
    """Poisson(1) multiplicity of an observation from its id alone: a bootstrap without draws, counts or joins."""
    u, p, total, out = hash_uniform(number, seed), 0.36787944117144233, 0.0, F.lit(float(most))
    steps = []
    for k in range(most):
        total += p
        steps.append((k, total))
        p /= k + 1
    for k, bound in reversed(steps):
        out = F.when(u < bound, float(k)).otherwise(out)
    return out


def resample_index(spark, n: int, variables: int, seed: int = 0) -> DataFrame:
    """``var, draw, obs_id``: draws with replacement that differ from variable to variable."""
    rows = spark.range(n).select(F.col("id").alias("draw"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(variables - 1).cast("long"))).alias("var"))
    return rows.select("var", "draw", F.floor(hash_uniform(F.col("draw") * variables + F.col("var"), seed) * n).alias("obs_id"))


def resample(long: DataFrame, index: DataFrame) -> DataFrame:
    """``var, draw, x`` of tidy samples by an index of ``resample_index``."""
    return index.join(long, ["var", "obs_id"]).select("var", "draw", "x")


def train_test_split(obs: DataFrame, share: float = 0.6, seed: int = 0, mode: str = "random", n: int | None = None) -> DataFrame:
    """Add ``part`` (train or test): by a hash of ``obs_id``, or the first observations of ``n`` (``mode='prefix'``)."""
    first = F.col("obs_id") < int(share * n) if mode == "prefix" else hash_uniform(F.col("obs_id"), seed) < share
    return obs.withColumn("part", F.when(first, "train").otherwise("test"))


def folds(obs: DataFrame, k: int, seed: int = 0, balanced: bool = True) -> DataFrame:
    """Add ``fold`` 0..k-1, aligned across variables.

    Balanced folds differ by one observation at most: places inside hash slots plus slot totals, so no single task
    orders all rows.  Otherwise an observation's fold is its hash alone.
    """
    u = hash_uniform(F.col("obs_id"), seed)
    if not balanced:
        return obs.withColumn("fold", F.floor(u * k).cast("int"))
    slots = 1024
    rows = obs.withColumn("u", u).withColumn("slot", F.floor(u * slots).cast("int"))
    starts = rows.groupBy("slot").count().withColumn("start", F.coalesce(F.sum("count").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    place = F.row_number().over(Window.partitionBy("slot").orderBy("u", "obs_id")) - 1
    numbered = rows.withColumn("place", place).join(starts, "slot")
    return numbered.withColumn("fold", ((F.col("start") + F.col("place")) % k).cast("int")).drop("u", "slot", "place", "start")
