"""Entropy, conditional entropy and mutual information in bits, from contingency counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import truncate_at


def entropy(c1: DataFrame) -> DataFrame:
    """``var, h``: -sum p log2 p."""
    total = F.sum("n").over(Window.partitionBy("var"))
    p = F.col("n") / F.col("t")
    return c1.withColumn("t", total).groupBy("var").agg((F.sum(-p * F.log2(p)) + 0.0).alias("h"))


def pmf(c1: DataFrame) -> DataFrame:
    """``var, x, p``."""
    return c1.select("var", "x", (F.col("n") / F.sum("n").over(Window.partitionBy("var"))).alias("p"))


def both_ways(c2: DataFrame) -> DataFrame:
    """Pair counts in both orders: ``var, cond, x, c, n``."""
    one = c2.select(F.col("src").alias("var"), F.col("dst").alias("cond"), "x", F.col("y").alias("c"), "n")
    return one.union(c2.select(F.col("dst"), F.col("src"), F.col("y"), F.col("x"), F.col("n")))


def conditional_entropy(c2: DataFrame) -> DataFrame:
    """``var, cond, h``: H(var | cond) of all ordered pairs, over the pairs of values that occur."""
    by_pair = Window.partitionBy("var", "cond")
    rows = both_ways(c2).withColumn("t", F.sum("n").over(by_pair)).withColumn("m", F.sum("n").over(Window.partitionBy("var", "cond", "c")))
    return rows.groupBy("var", "cond").agg((F.sum(-(F.col("n") / F.col("t")) * F.log2(F.col("n") / F.col("m"))) + 0.0).alias("h"))


def mutual_information(c1: DataFrame, c2: DataFrame, precision: int | None = None, full: bool = False) -> DataFrame:
    """``src, dst, mi``: H(src) - H(src | dst) for ``src < dst``, or for all ordered pairs.

    ``precision`` cuts both terms to so many digits first, as older results do; it makes them differ by direction.
    Without it one aggregation over the pair counts gives sum n/N log2(n N / (n_x n_y)), which is the same in both.
    """
    if precision is None:
        total = c1.groupBy(F.col("var").alias("src")).agg(F.sum("n").alias("mass"))
        x = c1.select(F.col("var").alias("src"), "x", F.col("n").alias("nx"))
        y = c1.select(F.col("var").alias("dst"), F.col("x").alias("y"), F.col("n").alias("ny"))
        rows = c2.join(x, ["src", "x"]).join(y, ["dst", "y"]).join(total, "src")
        term = F.col("n") / F.col("mass") * F.log2(F.col("n") * F.col("mass") / (F.col("nx") * F.col("ny")))
        mi = rows.groupBy("src", "dst").agg(F.sum(term).alias("mi"))
        if not full:
            return mi
        ways = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
        return mi.select(F.explode(ways).alias("w"), "mi").select("w.src", "w.dst", "mi")
    h = entropy(c1).select(F.col("var").alias("src"), F.col("h").alias("h1"))
    given = conditional_entropy(c2).select(F.col("var").alias("src"), F.col("cond").alias("dst"), F.col("h").alias("h2"))
    if not full:
        given = given.where("src < dst")
    a, b = F.col("h1"), F.col("h2")
    if precision is not None:
        a, b = truncate_at(a, precision), truncate_at(b, precision)
    return given.join(h, "src").select("src", "dst", (a - b).alias("mi"))
