"""Scores: divergence from given densities, cross-entropy of beliefs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import saved


def empirical_density(obs: DataFrame) -> DataFrame:
    """``obs_id, p``: frequency of each observation's whole tuple."""
    same = saved(obs.groupBy(F.col("xs").alias("all")).agg(F.count("*").alias("n")), "tuples")
    rows = same.agg(F.sum("n")).first()[0] or 1
    # counts come from partial sums; a frequent tuple's rows can be split in the join
    return obs.join(same, F.col("xs") == F.col("all")).select("obs_id", (F.col("n") / rows).alias("p"))


def mean_tree_kl(ll: DataFrame, densities: DataFrame) -> DataFrame:
    """``kl``: mean over trees of the mean of log2 p - ll."""
    per_tree = ll.join(densities, "obs_id").groupBy("tree_id").agg(F.avg(F.log2("p") - F.col("ll")).alias("kl"))
    return per_tree.agg(F.avg("kl").alias("kl"))


def mixture_kl(ll: DataFrame, densities: DataFrame) -> DataFrame:
    """``kl`` of the equally weighted mixture: mean of log2 p - log2 mean 2**ll."""
    best = ll.groupBy("obs_id").agg(F.max("ll").alias("m"))
    mixed = ll.join(best, "obs_id").groupBy("obs_id").agg((F.first("m") + F.log2(F.avg(F.pow(F.lit(2.0), F.col("ll") - F.col("m"))))).alias("l"))
    return mixed.join(densities, "obs_id").agg(F.avg(F.log2("p") - F.col("l")).alias("kl"))


def kl_curve(ll: DataFrame, densities: DataFrame, sizes: list[int]) -> DataFrame:
    """``trees, kl``: mean tree divergence of the first 1, 3, 5, ... trees."""
    per_tree = ll.join(densities, "obs_id").groupBy("tree_id").agg(F.avg(F.log2("p") - F.col("ll")).alias("k"))
    sized = per_tree.withColumn("trees", F.explode(F.array(*[F.lit(s) for s in sizes]))).where("tree_id < trees")
    return sized.groupBy("trees").agg(F.avg("k").alias("kl"))


def special_score(beliefs: DataFrame, frequencies: DataFrame) -> DataFrame:
    """``var, score``: entropy of the belief plus its cross-entropy to the frequencies, over values that both have."""
    q = frequencies.select("var", "x", F.col("p").alias("q"))
    b = F.col("p")
    return beliefs.join(q, ["var", "x"]).where("p > 0 AND q > 0").groupBy("var").agg(F.sum(-b * F.log2(b) - b * F.log2("q")).alias("score"))


def divergence(beliefs: DataFrame, frequencies: DataFrame) -> DataFrame:
    """``var, kl``: true divergence of the frequencies from the belief."""
    q = frequencies.select("var", "x", F.col("p").alias("q"))
    return beliefs.join(q, ["var", "x"]).where("p > 0 AND q > 0").groupBy("var").agg(F.sum(F.col("p") * (F.log2("p") - F.log2("q"))).alias("kl"))
