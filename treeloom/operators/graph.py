"""Dependency graphs: complete graphs whose weights are negated mutual information."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .counts import counts1, counts2
from .info import mutual_information


def mi_edges(obs: DataFrame, weights: list[str] | None = None, precision: int | None = None, full: bool = False, drop_zero: bool = False, digits: int | None = None) -> DataFrame:
    """``src, dst, weight``: weight is -MI; ``digits`` rounds it, ``drop_zero`` leaves out independent pairs."""
    mi = mutual_information(counts1(obs, weights), counts2(obs, weights), precision, full)
    weight = -F.col("mi") + F.lit(0.0)
    weight = F.round(weight, digits) if digits is not None else weight
    edges = mi.select("src", "dst", weight.alias("weight"))
    return edges.where("weight <> 0") if drop_zero else edges


def vertices(edges: DataFrame, fragments: bool = False) -> DataFrame:
    """``id`` (and ``frag``, its own id) of every end of an edge."""
    ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    return ids.withColumn("frag", F.col("id")) if fragments else ids


def matrix(edges: DataFrame, variables: int) -> DataFrame:
    """``src, row``: upper-triangular dense rows, zero elsewhere."""
    row = F.map_from_entries(F.collect_list(F.struct("dst", "weight")))
    cells = F.transform(F.sequence(F.lit(0), F.lit(variables - 1)), lambda j: F.coalesce(F.element_at(F.col("m"), j.cast("long")), F.lit(0.0)))
    return edges.groupBy("src").agg(row.alias("m")).select("src", cells.alias("row"))


def from_matrix(rows: DataFrame) -> DataFrame:
    """``src, dst, weight`` (``src < dst``) of ``src, row``."""
    return rows.select("src", F.posexplode("row").alias("dst", "weight")).select("src", F.col("dst").cast("long").alias("dst"), "weight").where("src < dst")
