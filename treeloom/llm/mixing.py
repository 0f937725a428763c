"""Mixing sources to target weights along a curriculum, with DataFrame operations only.

Every source has a weight that changes over the training time ``t`` from 0 to 1, piecewise linearly between equally
spaced points.  Its integral up to ``t`` gives the source's cumulative demand for words; scaled to the source's target
it is inverted in closed form (a linear or quadratic equation within one piece), which turns a document's place in its
source's stream into a position in training.  Documents, repeats included, are sorted by range of that position.

A source's stream is its documents in an order fixed by a hash, again and again until the target is reached.  Running
sums are taken in two steps, over hash slots of a source and within a slot, so that no source is one task's work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import WORD_PATTERN, only, written


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """Add ``weight`` and ``target`` to ``sources(source, source_size)``, one row per source.

    Sources by code point, null last, have the weights in turn and share the sum of all sizes.  No target exceeds
    ``most`` times its source's size; what is cut off goes to the others by weight, until none is above.  That is one
    water level: with sources by their cap per weight, the first level at or below the next cap holds.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    weighted = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1))
    weighted = weighted.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before, everything = by_cap.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    total = F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    holds = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    leveled = weighted.withColumn("level", level).withColumn("level", F.max(holds).over(everything))
    return leveled.withColumn("target", F.least(F.col("cap"), F.col("level") * F.col("weight"))).drop("cap", "level")


def _areas(schedule: Column) -> tuple[Column, Column]:
    """Demand before each of the schedule's points, and in all."""
    steps = F.sequence(F.lit(1), F.size(schedule) - 1)
    piece = lambda i: (F.element_at(schedule, i) + F.element_at(schedule, i + 1)) / 2
    before = F.transform(F.sequence(F.lit(0), F.size(schedule) - 1), lambda n: F.aggregate(F.filter(steps, lambda i: i <= n), F.lit(0.0), lambda a, i: a + piece(i)))
    return before, F.element_at(before, -1)


def _inverse(share: Column, schedule: Column, before: Column, total: Column) -> Column:
    pieces = F.size(schedule) - 1
    need = share * total
    piece = F.least(pieces, F.greatest(F.lit(1), F.size(F.filter(before, lambda x: x <= need))))
    rest = need - F.element_at(before, piece)
    start, slope = F.element_at(schedule, piece), F.element_at(schedule, piece + 1) - F.element_at(schedule, piece)
    root = F.sqrt(F.greatest(F.lit(0.0), start * start + 2 * slope * rest))
    inside = F.when(start + root > 0, 2 * rest / (start + root)).otherwise(F.lit(0.0))
    return F.when(total > 0, (piece - 1 + F.least(F.lit(1.0), inside)) / pieces).otherwise(share)


def position(share: Column, schedule: Column) -> Column:
    """Training time at which a source has met ``share`` (0 to 1) of its demand, for an array of schedule weights.

    Between neighbouring points the weight is linear, so demand is quadratic there.  A schedule whose integral is zero
    counts as constant.
    """
    return _inverse(share, schedule, *_areas(schedule))


#: Schedules dealt to sources in turn where the caller names none: even, falling, rising.
SCHEDULES = ((1.0, 1.0, 1.0), (3.0, 2.0, 1.0), (1.0, 2.0, 3.0))


def _slots(rows: int) -> int:
    """Slots per source: about the square root of the rows, so that both steps of the running sums are short."""
    slots = 1
    while slots * slots < rows:
        slots *= 2
    return slots


def plan(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3.0, schedules: Sequence[Sequence[float]] = SCHEDULES, seed: int = 3) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken, passes, positions, mark`` of every row of ``docs(doc_id, source, text, ...)``.

    A source takes its documents ``floor(target / size)`` times whole and then, in the order of the hash ``mark``, up
    to the target; the last document is taken in part (``taken`` counts its words), so a source meets its target to a
    word.  ``passes`` counts whole documents, a part of half or more as one.  ``positions`` has the training time of
    the middle of each pass, in the source's stream that starts again after every round.  A null or empty text has
    size 0 and is taken 0 times; a null source is a source of its own, the last; null ids and repeated rows take part
    like others; no rows give none.  The result is a written table.
    """
    mark = F.xxhash64("doc_id", "source", "text", F.lit(seed))
    sized = written(only(docs, "doc_id", "source", "text").select("doc_id", "source", word_count(F.col("text")).alias("size"), mark.alias("mark")), "sizes")
    slots = _slots(sized.count())
    sized = sized.withColumn("slot", F.pmod("mark", F.lit(slots)))
    by_slot = sized.groupBy("source", "slot").agg(F.sum("size").alias("slot_size"))
    by_source = targets(by_slot.groupBy("source").agg(F.sum("slot_size").alias("source_size")), weights, most)
    number = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    curves = F.array(*[F.array(*[F.lit(float(x)) for x in curve]) for curve in schedules])
    by_source = by_source.withColumn("schedule", F.element_at(curves, number % len(schedules) + 1))
    before, total = _areas(F.col("schedule"))
    by_source = by_source.withColumn("before", before).withColumn("area", total)
    earlier = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slot_starts = by_slot.withColumn("slot_start", F.coalesce(F.sum("slot_size").over(earlier), F.lit(0))).drop("slot_size").withColumnRenamed("source", "s")
    slot_starts = slot_starts.join(by_source, slot_starts.s.eqNullSafe(by_source.source)).drop("source").withColumnRenamed("slot", "k")
    joined = sized.join(slot_starts, sized.source.eqNullSafe(slot_starts.s) & (sized.slot == slot_starts.k))
    within = Window.partitionBy("source", "slot").orderBy("mark", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = joined.withColumn("start", F.col("slot_start") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.withColumn("goal", F.round("target").cast("long"))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("goal") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    placed = placed.withColumn("full", full)
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("goal") - F.col("full") * F.col("source_size") - F.col("start")))
    placed = placed.withColumn("part", part.cast("long"))
    half = (F.col("part") > 0) & (2 * F.col("part") >= F.col("size"))
    passes = F.when(F.col("size") > 0, F.col("full")).otherwise(F.lit(0)) + F.when(half, 1).otherwise(0)
    placed = placed.withColumn("passes", passes.cast("int"))

    def at(copy: Column) -> Column:
        middle = F.col("start") + (copy - 1) * F.col("source_size") + F.col("size") / 2
        share = F.when(F.col("goal") > 0, F.least(F.lit(1.0), middle / F.col("goal"))).otherwise(F.lit(0.0))
        return _inverse(share, F.col("schedule"), F.col("before"), F.col("area"))

    numbers = F.when(F.col("passes") > 0, F.sequence(F.lit(1), F.col("passes"))).otherwise(F.array().cast("array<int>"))
    taken = (F.col("full") * F.col("size") + F.col("part")).alias("taken")
    return written(placed.select("doc_id", "source", "size", "source_size", "target", taken, "passes", F.transform(numbers, at).alias("positions"), "mark"), "plan")


def in_order(plan: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows of a plan sorted by range of their first position; rows that aren't passed come first, by their mark."""
    first = plan.withColumn("position", F.get("positions", F.lit(0)))
    keys = ["position", "mark", "doc_id"]
    return (first.repartitionByRange(partitions, *keys) if partitions else first.repartitionByRange(*keys)).sortWithinPartitions(*keys)


def mix(docs: DataFrame, partitions: int | None = None, **options) -> DataFrame:
    """Rows of ``docs`` in training order, repeated as often as the mix passes them, with their columns.

    Each pass stands at its own position.  Equal rows (one id, source and text) each come as often as the first of
    them passes.  Rows with null or empty texts have no words and don't come; no rows give none.
    """
    seed = options.get("seed", 3)
    passed = plan(docs, **options).where("passes > 0")
    chosen = passed.groupBy("mark", "doc_id").agg(F.min_by("positions", F.col("positions")[0]).alias("treeloom positions"))
    chosen = written(chosen.select(F.col("mark").alias("treeloom key"), F.col("doc_id").alias("treeloom id"), "treeloom positions"), "passes")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.withColumn("treeloom mark", F.xxhash64("doc_id", "source", "text", F.lit(seed)))
    same = (F.col("treeloom mark") == F.col("treeloom key")) & F.col("doc_id").eqNullSafe(F.col("treeloom id"))
    copies = rows.join(chosen, same).select(*columns, "treeloom mark", F.explode("treeloom positions").alias("treeloom position"))
    keys = ["treeloom position", "treeloom mark"]
    ordered = copies.repartitionByRange(partitions, *keys) if partitions else copies.repartitionByRange(*keys)
    return ordered.sortWithinPartitions(*keys).select(*columns)
