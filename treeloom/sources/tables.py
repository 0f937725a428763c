"""Relational tables as matrices of discrete observations: ``obs_id, xs`` (and ``w``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def embedding_signs(embeddings: DataFrame) -> DataFrame:
    """Signs (0 or 1) of all components of each vector."""
    signs = F.transform("embedding", lambda x: F.when(x > 0, 1.0).otherwise(0.0))
    return embeddings.select(F.col("vec_id").alias("obs_id"), signs.alias("xs"))


def lineitem_codes(lineitem: DataFrame) -> DataFrame:
    """Six variables of order lines, without an id, weighted by quantity: flag, status, line, discount, tax, year."""
    flag = F.when(F.col("l_returnflag") == "A", 0.0).when(F.col("l_returnflag") == "N", 1.0).otherwise(2.0)
    status = F.when(F.col("l_linestatus") == "F", 0.0).otherwise(1.0)
    xs = F.array(flag, status, F.col("l_linenumber").cast("double"), F.round(F.col("l_discount") * 100), F.round(F.col("l_tax") * 100), F.year("l_shipdate").cast("double"))
    return lineitem.select(xs.alias("xs"), F.col("l_quantity").alias("w"))


def order_codes(orders: DataFrame) -> DataFrame:
    """Status, priority and month of orders."""
    status = F.when(F.col("o_orderstatus") == "F", 0.0).when(F.col("o_orderstatus") == "O", 1.0).otherwise(2.0)
    xs = F.array(status, F.substring("o_orderpriority", 1, 1).cast("double"), F.month("o_orderdate").cast("double"))
    return orders.select(F.col("o_orderkey").alias("obs_id"), xs.alias("xs"))
