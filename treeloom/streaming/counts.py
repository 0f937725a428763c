"""Contingency counts of a stream: they are additive, so a model can be refreshed from running sums at any time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.counts import counts1, counts2


def count_stream(stream: DataFrame, path: str, checkpoint: str, variables: int, trigger: dict | None = None):
    """Append each micro-batch's counts to ``path/c1`` and ``path/c2``, keyed by batch; returns the running query.

    A batch that is replayed after a failure overwrites its own part, so sums stay exact.
    """

    def sink(batch: DataFrame, number: int) -> None:
        batch.persist()
        counts1(batch).write.mode("overwrite").parquet(f"{path}/c1/batch={number}")
        counts2(batch, variables=variables).write.mode("overwrite").parquet(f"{path}/c2/batch={number}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def fold_counts(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """``counts1`` and ``counts2`` of everything seen so far."""
    c1 = spark.read.parquet(f"{path}/c1").groupBy("var", "x").agg(F.sum("n").alias("n"))
    c2 = spark.read.parquet(f"{path}/c2").groupBy("src", "dst", "x", "y").agg(F.sum("n").alias("n"))
    return c1, c2
