"""Near-duplicate embeddings by E8 lattice hashing.

Unit vectors are projected to ``blocks`` times 8 random orthonormal directions per table, scaled, shifted and decoded
block by block to the nearest points of the E8 lattice.  A key joins the cells of all blocks; a vector is filed under
its home cells and, with one block moved at a time, under the neighbouring cells nearest to it.  Only keys, a number and
a 64-bit sign sketch are shuffled.  What meets in a cell with similar sketches is a candidate; candidates' components
are then verified by cosine in double precision, block against block, so no list of all pairs of a dense group ever
exists.  Exact copies are folded before.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import connected_components, only, shared_buckets, sieve, sifted, thin, tidy, whole_buckets, written
from .neighbours import usable


@dataclass(frozen=True)
class Settings:
    """``cell``: edge of the lattice's unit for unit vectors; ``probes``: neighbouring cells per block; ``bits``: of 64
    sketch bits in which candidates of a cell differ at most; ``block``: rows compared at once.

    Of pairs of 64 dimensions with a cosine of 0.98, 0.9999 share a key and 0.9999999 pass the sketch; of random pairs
    about one in 10,000 shares a key.
    """

    tables: int = 4
    blocks: int = 2
    cell: float = 0.6
    probes: int = 2
    bits: int = 16
    block: int = 1024
    seed: int = 23


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((-1, 1), repeat=2):
            v = [0.0] * 8
            v[i], v[j] = a, b
            out.append(v)
    out += [[x / 2 for x in signs] for signs in product((-1, 1), repeat=8) if np.prod(signs) > 0]
    return np.array(out)


def _nearest_d8(y: np.ndarray) -> np.ndarray:
    """Nearest point with integer coordinates of even sum."""
    f = np.rint(y)
    odd = np.flatnonzero(f.sum(axis=1) % 2 != 0)
    gap = y[odd] - f[odd]
    worst = np.abs(gap).argmax(axis=1)
    f[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    return f


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """Nearest point of E8, the union of D8 and D8 moved by one half in all coordinates."""
    a, b = _nearest_d8(y), _nearest_d8(y - 0.5) + 0.5
    near = ((y - a) ** 2).sum(axis=1) <= ((y - b) ** 2).sum(axis=1)
    return np.where(near[:, None], a, b)


def cells(y: np.ndarray, probes: int) -> np.ndarray:
    """Doubled integer coordinates of the home cell and of the ``probes`` next ones: rows x (1 + probes) x 8."""
    home, roots = nearest_e8(y), _roots()
    out = np.empty((len(y), 1 + probes, 8), np.int64)
    out[:, 0] = np.rint(2 * home)
    if probes:
        # |y - home - root|^2 differs from a constant by -2 (y - home).root, as all roots have the same length
        order = np.argpartition(-(y - home) @ roots.T, probes - 1, axis=1)[:, :probes]
        out[:, 1:] = np.rint(2 * (home[:, None] + roots[order]))
    return out


def _directions(dims: int, s: Settings) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Scaled directions and shift of each table, and the hyperplanes of the sketch."""
    rng = np.random.default_rng(s.seed)
    tables, wide = [], max(dims, 8 * s.blocks)
    for _ in range(s.tables):
        q, _ = np.linalg.qr(rng.normal(size=(wide, 8 * s.blocks)))
        tables.append((q[:dims] * (np.sqrt(wide / 8) / s.cell), rng.uniform(0, 1, 8 * s.blocks)))
    return tables, rng.normal(size=(dims, 64))


def _hashed(start: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of whole numbers."""
    h = start.astype(np.uint64)
    for column in numbers.T:
        h = (h ^ column.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h = h ^ (h >> np.uint64(29))
    return h


def keys_of(x: np.ndarray, start: np.ndarray, table: tuple[np.ndarray, np.ndarray], s: Settings) -> np.ndarray:
    """Keys of unit vectors in one table: rows x (1 + blocks * probes); ``start`` tells labels apart."""
    y = x @ table[0] + table[1]
    parts = [cells(y[:, 8 * b : 8 * b + 8], s.probes) for b in range(s.blocks)]
    home = [p[:, 0] for p in parts]
    out = [_hashed(start, np.concatenate(home, axis=1))]
    for b in range(s.blocks):
        for k in range(1, 1 + s.probes):
            out.append(_hashed(start, np.concatenate([parts[b][:, k] if a == b else home[a] for a in range(s.blocks)], axis=1)))
    return np.stack(out, axis=1)


def _unit(flat: np.ndarray, dims: int) -> np.ndarray:
    x = flat.astype(np.float64).reshape(-1, dims)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _spanning(near: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """Links that connect what ``near`` (rows ``a`` x columns ``b``) connects, as few as possible."""
    rows, columns, out = np.ones(len(a), bool), np.ones(len(b), bool), []
    for start in range(len(a)):
        if not rows[start]:
            continue
        rows[start] = False
        open_ = [(True, start)]
        while open_:
            is_row, i = open_.pop()
            found = np.flatnonzero(near[i] & columns if is_row else near[:, i] & rows)
            if len(found):
                (columns if is_row else rows)[found] = False
                out.append(np.stack([np.full(len(found), a[i] if is_row else b[i]), b[found] if is_row else a[found]], axis=1))
                open_ += [(not is_row, k) for k in found.tolist()]
    return out


def _runs(batches, work, keys: int):
    """Results of ``work(table of a run)`` for each run of equal first ``keys`` columns of a sorted partition."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        new = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        cuts = np.concatenate([[0], np.flatnonzero(new) + 1, [b.num_rows]]).tolist()
        for start, stop in zip(cuts[:-1], cuts[1:]):
            key = tuple(c[start] for c in columns)
            if held and key != last:
                yield from work(pa.Table.from_batches(held))
                held = []
            last = key
            held.append(b.slice(start, stop - start))
    if held:
        yield from work(pa.Table.from_batches(held))


def near_duplicates(vectors: DataFrame, least: float = 0.98, settings: Settings | None = None) -> DataFrame:
    """``vec_id, n_links, component_id`` for every row of ``vectors(vec_id, embedding, label, ...)``.

    Only vectors with equal labels are compared.  Rows whose label or id is null, or whose vector is null, empty, zero
    or holds null or non-finite components, link with nothing; nor do vectors of different lengths.  Rows with one
    vector and label, repeated rows too, are linked to each other.  Other columns are ignored; no rows give none.
    """
    s = settings or Settings()
    rows = only(vectors, "vec_id", "embedding", "label").select("vec_id", F.col("embedding").alias("v"), F.col("label").cast("string").alias("label"))
    fit = usable(F.col("v")) & F.col("vec_id").isNotNull() & F.col("label").isNotNull()
    clean, other = rows.where(fit), rows.where(~fit)
    # a class is one vector with one label; its digest has 128 bits
    clean = clean.select("vec_id", "v", F.xxhash64("label").alias("lh"), F.xxhash64("label", "v").alias("d"), F.xxhash64(F.lit("e"), "v", "label").alias("e"))

    def file(batches):
        known: dict[int, tuple] = {}
        width = s.tables * (1 + s.blocks * s.probes)
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                lengths = np.diff(part.column(1).offsets.to_numpy())
                keys, sketch = np.zeros((part.num_rows, width), np.uint64), np.zeros(part.num_rows, np.uint64)
                for dims in np.unique(lengths).tolist():
                    which = np.flatnonzero(lengths == dims)
                    some = part.take(pa.array(which))
                    x = _unit(some.column(1).flatten().to_numpy(zero_copy_only=False), dims)
                    if dims not in known:
                        known[dims] = _directions(dims, s)
                    tables, planes = known[dims]
                    label = some.column(2).to_numpy().view(np.uint64)
                    keys[which] = np.concatenate([keys_of(x, label ^ np.uint64(1000 * dims + t), table, s) for t, table in enumerate(tables)], axis=1)
                    sketch[which] = np.packbits(x @ planes > 0, axis=1).view(np.uint64)[:, 0]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, width, dtype=np.int32)), pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(3), part.column(4), pa.array(sketch.view(np.int64)), lists], names=["vec_id", "d", "e", "sketch", "cells"])

    filed = written(clean.mapInArrow(tidy(file), "vec_id long, d long, e long, sketch long, cells array<long>"), "filed")
    folded = filed.groupBy("d", "e").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("sketch").alias("sketch"), F.first("cells").alias("cells"))
    classes = written(folded, "classes")

    def meet(batches):
        for rows in whole_buckets(batches):
            found = [np.zeros((0, 2), np.int64)]
            for left in shared_buckets(rows):
                while len(left) > 1:
                    queue, left = [left[0]], left[1:]
                    while queue and len(left):
                        at = queue.pop()
                        near = np.bitwise_count((left[:, 1] ^ at[1]).view(np.uint64)) <= s.bits
                        if near.any():
                            found.append(np.stack([np.full(int(near.sum()), at[0]), left[near][:, 0]], axis=1))
                            queue.extend(left[near])
                            left = left[~near]
            both = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["src", "dst"])

    keyed = classes.select(F.explode("cells").alias("key"), "d", "sketch").repartition("key").sortWithinPartitions("key")
    candidates = connected_components(keyed.mapInArrow(tidy(lambda bs: thin(meet(bs))), "src long, dst long"))

    members = written(classes.join(candidates, classes.d == candidates.node).select("component", "d", "e", "rep", "n"), "members")
    sizes = written(members.groupBy("component").agg(F.ceil(F.count("*") / s.block).cast("int").alias("blocks")), "sizes")
    members = members.join(sizes, "component").select(F.col("component"), F.col("d").alias("d2"), F.col("e").alias("e2"), "rep", "n", "blocks")
    # only vectors that the sieve lets through are shuffled
    mine = sifted(clean, "d", sieve(candidates.select("node")), "treeloom hit").where("`treeloom hit`").select("vec_id", "d", "e", "v")
    named = mine.join(members, (mine.d == members.d2) & (mine.e == members.e2) & (mine.vec_id == members.rep))
    dealt = named.withColumn("b", F.pmod("d", F.col("blocks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    place = ["component", "low", "high"]
    pairs = dealt.select("component", F.least("b", "o").alias("low"), F.greatest("b", "o").alias("high"), "b", "d", "n", F.col("v").cast("array<double>").alias("v"))

    def verify(table):
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        ids, first = np.unique(table.column("d").to_numpy(), return_index=True)  # repeated rows count once, in n
        table = table.take(pa.array(first))
        lengths = np.array([len(x) for x in table.column("v")])
        n, b = table.column("n").to_numpy(), table.column("b").to_numpy()
        for dims in np.unique(lengths).tolist():  # one length, but for a chance collision of keys
            which = np.flatnonzero(lengths == dims)
            x = _unit(table.column("v").take(pa.array(which)).combine_chunks().flatten().to_numpy(zero_copy_only=False), dims)
            one, two = (np.flatnonzero(b[which] == k) for k in (low, high))
            near = x[one] @ x[two].T >= least
            one, two = which[one], which[two]
            if low == high:
                np.fill_diagonal(near, False)
            counts = [(ids[one], near @ n[two])]
            if low != high:
                counts.append((ids[two], n[one] @ near))
            found = _spanning(near, ids[one], ids[two])
            both = np.concatenate([np.zeros((0, 2), np.int64), *found])
            src = np.concatenate([c[0] for c in counts] + [both[:, 0]])
            dst = np.concatenate([c[0] for c in counts] + [both[:, 1]])
            links = np.concatenate([c[1] for c in counts] + [np.zeros(len(both), np.int64)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst), pa.array(links)], names=["src", "dst", "links"])

    checked = pairs.repartition(*place).sortWithinPartitions(*place).mapInArrow(tidy(lambda bs: _runs(bs, verify, 3)), "src long, dst long, links long")
    checked = written(checked, "checked")
    linked = connected_components(checked.where("src <> dst").select("src", "dst"))
    counted = checked.where("src = dst").groupBy(F.col("src").alias("c")).agg(F.sum("links").alias("links"))
    of = classes.select("d", "e", "rep", "n")
    with_comp = written(of.join(linked, of.d == linked.node, "left").join(counted, F.col("d") == F.col("c"), "left").select("d", "e", "rep", F.coalesce("component", "d").alias("component"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "linked")
    low = written(with_comp.groupBy("component").agg(F.min("rep").alias("component_id")), "low")
    answer = written(with_comp.join(low, "component").select(F.col("d").alias("d2"), F.col("e").alias("e2"), "n_links", "component_id"), "answer")
    inside = filed.join(answer, (filed.d == answer.d2) & (filed.e == answer.e2)).select("vec_id", "n_links", "component_id")
    return inside.unionByName(other.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
