"""Reshaping samples: tidy, variable-major, evidence; predicates and joins on graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tidy(obs: DataFrame) -> DataFrame:
    """One row per observation and variable: all other columns, ``var, x``."""
    rest = [F.col(f"`{c}`") for c in obs.columns if c != "xs"]
    return obs.select(*rest, F.posexplode("xs").alias("var", "x")).withColumn("var", F.col("var").cast("long"))


def by_variable(obs: DataFrame) -> DataFrame:
    """``var, xs``: a variable's values in the order of ``obs_id``.  A row is as long as the table."""
    return tidy(obs).groupBy("var").agg(F.transform(F.sort_array(F.collect_list(F.struct("obs_id", "x"))), lambda s: s.x).alias("xs"))


def weighted_by_variable(obs: DataFrame) -> DataFrame:
    """``var, xws``: pairs of value and weight in the order of ``obs_id``."""
    pairs = F.transform(F.sort_array(F.collect_list(F.struct("obs_id", "x", "w"))), lambda s: F.struct(s.x.alias("x"), s.w.alias("w")))
    return tidy(obs).groupBy("var").agg(pairs.alias("xws"))


def by_observation(variables: DataFrame) -> DataFrame:
    """``obs_id, xs`` of ``var, xs`` rows; variables in ascending order."""
    long = variables.select("var", F.posexplode("xs").alias("obs_id", "x"))
    return long.groupBy(F.col("obs_id").cast("long").alias("obs_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("var", "x"))), lambda s: s.x).alias("xs"))


def evidence_of(obs: DataFrame) -> DataFrame:
    """``case_id, var, x``: every variable of every observation as evidence."""
    return tidy(obs.select(F.col("obs_id").alias("case_id"), "xs"))


def label_pairs(labels: DataFrame, column: str, ordered: bool = True) -> DataFrame:
    """Pairs of distinct labels, ``src < dst`` or both ways.  Labels are few: one per variable."""
    a, b = labels.select(F.col(column).alias("src")), labels.select(F.col(column).alias("dst"))
    return a.join(b, F.col("src") < F.col("dst") if ordered else F.col("src") != F.col("dst"))


def crossing_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with exactly one end among ``members(id)``."""
    ids = members.select("id").distinct()
    s = ids.select(F.col("id").alias("src"), F.lit(True).alias("in_src"))
    d = ids.select(F.col("id").alias("dst"), F.lit(True).alias("in_dst"))
    joined = edges.join(s, "src", "left").join(d, "dst", "left")
    return joined.where(F.col("in_src").isNull() != F.col("in_dst").isNull()).select(*edges.columns)


def edge_subgraph(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """Edges whose ``src, dst`` is in ``wanted``."""
    return edges.join(wanted.select("src", "dst"), ["src", "dst"], "left_semi")


def triplets(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges with both ends' attributes as ``src_*`` and ``dst_*``; ``vertices`` has ``id`` and attributes."""
    names = [c for c in vertices.columns if c != "id"]
    s = vertices.select(F.col("id").alias("src"), *[F.col(c).alias(f"src_{c}") for c in names])
    d = vertices.select(F.col("id").alias("dst"), *[F.col(c).alias(f"dst_{c}") for c in names])
    return edges.join(s, "src").join(d, "dst")
