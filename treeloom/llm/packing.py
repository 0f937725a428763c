"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm on islands.

Documents are encoded, closed by an end id and, only if longer than the capacity, cut into full pieces and a rest.
Full pieces are sequences of their own.  The others are dealt at random into instances of bounded size.  Each instance
lives on several islands, which start from best-fit-decreasing packings in perturbed orders.  A generation crosses two
packings: well-filled bins of one are injected whole into the other, bins there that hold one of the same pieces are
opened with the worst ones, and their remaining pieces are put back: first by swaps with smaller pieces of bins that
have room, then by best fit, about longest first.  After each epoch the elite of every island moves to the next one.  Islands' states are tables in the shared folder, so a lost executor costs its tasks only.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import only, tidy, written


@dataclass(frozen=True)
class Settings:
    """Of the genetic algorithm; ``instance``: pieces that are packed together, at most about twice as many."""

    instance: int = 6000
    islands: int = 2
    population: int = 6
    epochs: int = 3
    generations: int = 40
    seed: int = 7


# ---------------------------------------------------------------- pieces


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, special: bool = True) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``) of every document; a null text has the end id alone."""

    def run(batches):
        from .tokens import encoder

        enc = encoder(tokenizer, special)
        names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
        for b in batches:
            for at in range(0, b.num_rows, 1500):
                part, cols = b.slice(at, 1500), [[] for _ in names]
                for doc_id, found in zip(part.column(0).to_pylist(), enc.encode_many(part.column(1).to_pylist())):
                    ids = np.append(np.frombuffer(found, dtype=enc.dtype).astype("<u4"), np.uint32(end_id)).astype("<u4")
                    for n, start in enumerate(range(0, len(ids), capacity)):
                        piece = ids[start : start + capacity]
                        for c, v in zip(cols, (doc_id, n, start, len(piece), zlib.crc32(piece), piece.tolist() if with_ids else None)):
                            c.append(v)
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return only(docs, "doc_id", "text").mapInArrow(tidy(run, "tokens"), PIECES + (", ids array<int>" if with_ids else ""))


# ---------------------------------------------------------------- one instance


class Packing:
    """Bins of piece numbers with their fills; best-fit insertion, crossover."""

    def __init__(self, sizes: list[int], capacity: int, bins: list[list[int]] | None = None):
        self.sizes, self.capacity = sizes, capacity
        self.bins: list[list[int]] = bins or []
        self.full = [sum(sizes[i] for i in held) for held in self.bins]

    def insert(self, items) -> None:
        """Put items, in this order, each into the bin that it fills best, or into a new one."""
        size_of, capacity, bins, full = self.sizes, self.capacity, self.bins, self.full
        by_room: dict[int, list[int]] = {}
        mask = 0
        for k, fill in enumerate(full):
            if room := capacity - fill:
                by_room.setdefault(room, []).append(k)
                mask |= 1 << room
        for i in items:
            size = size_of[i]
            fits = mask >> size
            if fits:
                room = size + (fits & -fits).bit_length() - 1
                same = by_room[room]
                k = same.pop()
                if not same:
                    mask ^= 1 << room
                bins[k].append(i)
            else:
                room, k = capacity, len(bins)
                bins.append([i])
                full.append(0)
            full[k] += size
            if room := room - size:
                by_room.setdefault(room, []).append(k)
                mask |= 1 << room

    def fills(self) -> list[int]:
        return list(self.full)

    def fitness(self) -> tuple[int, int]:
        """Fewer bins first, then unequal fills."""
        return -len(self.bins), sum(f * f for f in self.full)

    def improve(self, loose: list[int]) -> list[int]:
        """Swap pieces of bins that have room for larger loose ones that still fit; returns what is loose then."""
        size_of = self.sizes
        loose = sorted(loose, key=size_of.__getitem__)
        lengths = [size_of[i] for i in loose]
        for k, held in enumerate(self.bins):
            room = self.capacity - self.full[k]
            if not room:
                continue
            best, at, to = 0, -1, -1
            for n, i in enumerate(held):
                x = bisect_right(lengths, size_of[i] + room) - 1
                if x >= 0 and lengths[x] - size_of[i] > best:
                    best, at, to = lengths[x] - size_of[i], n, x
            if best:
                out, held[at] = held[at], loose.pop(to)
                del lengths[to]
                self.full[k] += best
                place = bisect_right(lengths, size_of[out])
                lengths.insert(place, size_of[out])
                loose.insert(place, out)
        return loose

    def cross(self, donor: Packing, rng: np.random.Generator) -> Packing:
        """A child: some well-filled bins of the donor whole, the bins here without any of their pieces, and the
        pieces of all others, and of the worst bins, put back by swaps and best fit."""
        full = [k for k, f in enumerate(donor.full) if f >= 0.98 * self.capacity] or [int(np.argmax(donor.full))]
        chosen = rng.permutation(full)[: int(rng.integers(1, max(2, len(full) // 10 + 2)))]
        injected = [list(donor.bins[k]) for k in chosen]
        there = {i for held in injected for i in held}
        kept, displaced = [], []
        for held in self.bins:
            if there.isdisjoint(held):
                kept.append(list(held))
            else:
                displaced += [i for i in held if i not in there]
        child = Packing(self.sizes, self.capacity, injected + kept)
        # the worst bins are opened too, so that their pieces may find better places
        for k in sorted(np.argsort(child.full, kind="stable")[: 1 + len(child.bins) // 50].tolist(), reverse=True):
            displaced += child.bins.pop(k)
            del child.full[k]
        displaced = child.improve(displaced)
        noise = rng.uniform(0.97, 1.03, len(displaced)).tolist()
        order = sorted(range(len(displaced)), key=lambda n: -self.sizes[displaced[n]] * noise[n])
        child.insert([displaced[n] for n in order])
        return child

    def assignment(self) -> list[int]:
        out = [0] * len(self.sizes)
        for k, held in enumerate(self.bins):
            for i in held:
                out[i] = k
        return out


def from_assignment(sizes, capacity: int, assignment) -> Packing:
    bins: list[list[int]] = [[] for _ in range(max(assignment, default=-1) + 1)]
    for i, k in enumerate(assignment):
        bins[k].append(i)
    return Packing(sizes, capacity, [b for b in bins if b])


def evolve(sizes, capacity: int, population: list[list[int]], settings: Settings, seed: int) -> list[list[int]]:
    """Population after an epoch, best first, as assignments; an empty one is made anew.

    An epoch ends early when as few bins are used as the sum of sizes allows.
    """
    rng = np.random.default_rng(seed)
    sizes = [int(s) for s in sizes]
    bound = -(-sum(sizes) // capacity)
    packs = [from_assignment(sizes, capacity, a) for a in population]
    while len(packs) < settings.population and not (packs and len(packs[0].bins) <= bound):
        noise = rng.uniform(0.9, 1.1, len(sizes)) if packs or seed % 2 else np.ones(len(sizes))
        p = Packing(sizes, capacity)
        p.insert(np.argsort(-np.array(sizes) * noise, kind="stable").tolist())
        packs.append(p)
        packs.sort(key=Packing.fitness, reverse=True)
    for _ in range(settings.generations):
        if len(packs[0].bins) <= bound or len(packs) < 2:
            break
        a, b = rng.choice(len(packs), 2, replace=False)
        child = packs[a].cross(packs[b], rng)
        if all(child.fitness() != p.fitness() for p in packs):
            packs = sorted([*packs, child], key=Packing.fitness, reverse=True)[: settings.population]
    return [p.assignment() for p in packs]


# ---------------------------------------------------------------- islands


def pack(rows: DataFrame, capacity: int = 2048, settings: Settings | None = None) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a table with ``length`` from 1 to ``capacity``; other columns stay.

    Equal rows are packed like any others; an empty table stays empty.  Sequence ids are distinct, but not dense.
    """
    s = settings or Settings()
    rows = written(rows, "pieces")
    whole = rows.where(F.col("length") >= capacity).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = rows.where(F.col("length") < capacity)
    n = max(1, -(-short.count() // s.instance))
    dealt = short.select(F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(s.seed)), F.lit(n)).alias("instance"), F.struct(F.col("length"), F.struct(*short.columns).alias("row")).alias("item"))
    instances = written(dealt.groupBy("instance").agg(F.sort_array(F.collect_list("item"), asc=False).alias("items")), "instances")
    sizes = instances.select("instance", F.col("items.length").alias("sizes"))

    def epoch(number: int):
        def run(batches):
            for b in batches:
                for at in range(b.num_rows):
                    inst, island, size, pop = (b.column(k)[at].as_py() for k in range(4))
                    out = evolve(size, capacity, pop or [], s, ((s.seed * 1009 + inst) * 31 + number) * 2 + island)
                    fit = from_assignment(size, capacity, out[0]).fitness()
                    yield pa.RecordBatch.from_arrays([pa.array([inst]), pa.array([island], pa.int32()), pa.array([out], pa.list_(pa.list_(pa.int32()))), pa.array([fit[0]], pa.int64()), pa.array([fit[1]], pa.int64())], names=["instance", "island", "population", "neg_bins", "evenness"])

        return run

    schema = "instance long, island int, population array<array<int>>, neg_bins long, evenness long"
    state = sizes.select("instance", F.explode(F.sequence(F.lit(0), F.lit(s.islands - 1))).alias("island"), "sizes", F.expr("CAST(NULL AS array<array<int>>)").alias("population"))
    # an explicit number: rows are small, but each is seconds of work, so tasks must not be joined by their size
    tasks = min(n * s.islands, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * s.islands // 8))
    for number in range(s.epochs):
        islands = written(state.repartition(tasks, "instance", "island").mapInArrow(tidy(epoch(number)), schema), "islands")
        if number + 1 < s.epochs:
            elite = islands.select("instance", F.pmod(F.col("island") + 1, F.lit(s.islands)).cast("int").alias("island"), F.slice("population", 1, 1).alias("guest"))
            merged = islands.join(elite, ["instance", "island"]).join(sizes, "instance")
            state = merged.select("instance", "island", "sizes", F.array_distinct(F.concat("guest", "population")).alias("population"))
    best = islands.groupBy("instance").agg(F.max_by(F.col("population")[0], F.struct("neg_bins", "evenness", -F.col("island"))).alias("bin"))
    placed = instances.join(best, "instance").select("instance", F.explode(F.arrays_zip(F.col("items"), F.col("bin"))).alias("x")).select("instance", "x.items.row.*", F.col("x.bin").alias("bin number"))
    from pyspark.sql import Window

    w = Window.partitionBy("instance", "bin number").orderBy(F.col("length").desc(), *[F.col(f"`{c}`") for c in rows.columns if c != "length"]).rowsBetween(Window.unboundedPreceding, -1)
    filled = placed.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("instance") * (1 << 20) + F.col("`bin number`")).alias("sequence_id"), F.coalesce(F.sum("length").over(w), F.lit(0)).cast("long").alias("offset"))
    return filled.unionByName(whole)


def best_fit_packing(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, settings: Settings | None = None, with_ids: bool = False, special: bool = True) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset``.

    ``special``: the tokenizer's special tokens are told by their strings in a text; else these are ordinary text.

    Null and empty texts are one piece of the end id.  Texts of any length are encoded whole.  A null ``doc_id`` is
    kept as it is; repeated rows are packed each for itself; other columns are ignored; no rows give no pieces.
    """
    return pack(pieces(docs, tokenizer, capacity, end_id, with_ids, special), capacity, settings)
