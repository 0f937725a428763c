"""Trees and networks as text for graph viewers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_dot(edges: DataFrame, directed: bool = False, digits: int = 4) -> DataFrame:
    """``line``: statements of a DOT graph; edges are labelled by their weight."""
    arrow = " -> " if directed else " -- "
    label = F.format_number("weight", digits)
    return edges.select(F.concat(F.col("src").cast("string"), F.lit(arrow), F.col("dst").cast("string"), F.lit(' [label="'), label, F.lit('"];')).alias("line"))
