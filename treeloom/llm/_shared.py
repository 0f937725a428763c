"""Small helpers that the training-data operators share: shared folder, written tables, files, components, sieves."""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word of a text: a run of characters other than space and U+0009 to U+000D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Edges of a task of which one spanning forest is made.
THIN_EDGES = 2_000_000

_work_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder, as a URI or path, that the driver and every executor can reach.

    It lies below ``spark.checkpoint.dir`` of the session.  Only where that is unset, and only in local mode,
    a temporary folder is made and becomes the session's checkpoint folder.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="treeloom-")
        sc.setCheckpointDir(base)
    key = f"{sc.applicationId}|{base}"
    if key not in _work_dirs:
        _work_dirs[key] = f"{base.rstrip('/')}/treeloom-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _work_dirs[key])
    return _work_dirs[key]


def _remove(spark: SparkSession, uri: str) -> None:
    try:
        delete(spark, uri)
    except Exception:  # noqa: BLE001 - the session may be gone already
        pass


def delete(spark: SparkSession, uri: str) -> None:
    """Delete a file or folder of the shared store."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


#: Where the shared folder is a mounted one (``file:``), tables get no checksum files beside theirs, and so half as many
#: files and processes that set their modes.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.options(compression="zstd", **PLAIN_FILES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def reachable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, if it isn't installed there."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))


#: What a worker keeps from task to task, by name, and how it is dropped.
kept_by_workers: dict[str, Callable[[], None]] = {}


def tidy(run, keep: str = ""):
    """``run`` for ``mapInArrow``: frees what other operators keep in a reused worker, and unused memory at the end."""

    def work(batches):
        for name, drop in kept_by_workers.items():
            if name != keep:
                drop()
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return work


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that further columns of the caller can't clash with working columns."""
    reachable(df.sparkSession)
    return df.select(*[F.col(f"`{n}`") for n in names])


def file_system(uri: str):
    """Arrow file system and path of a URI; a plain path is a local or mounted file."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


class AtomicFile:
    """A file that appears under its name only when it is complete; every attempt of a task has its own."""

    def __init__(self, folder: str, name: str):
        self.fs, root = file_system(folder)
        self.fs.create_dir(root, recursive=True)
        stem, dot, ext = name.partition(".")
        self.name = f"{stem}-{uuid.uuid4().hex[:8]}{dot}{ext}"
        self._final, self._temp = f"{root}/{self.name}", f"{root}/.{self.name}.tmp"
        self._out = self.fs.open_output_stream(self._temp)
        self.size = 0

    def write(self, data) -> None:
        self._out.write(data)
        self.size += len(data)

    def commit(self) -> str:
        self._out.close()
        self.fs.move(self._temp, self._final)
        return self.name


def open_input(folder: str, name: str):
    fs_, root = file_system(folder)
    return fs_.open_input_file(f"{root}/{name}")


def whole_buckets(batches):
    """Rows of a partition sorted by its first column, as matrices of whole numbers that end where that changes.

    A bucket that spans many batches is joined once.
    """
    held: list[np.ndarray] = []
    for b in batches:
        if not b.num_rows:
            continue
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns], axis=1)
        cut = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
        if held and (cut or held[-1][-1, 0] != rows[-1, 0]):
            yield np.concatenate([*held, rows[:cut]])
            held = []
        elif cut:
            yield rows[:cut]
        held.append(rows[cut:])
    if held:
        yield np.concatenate(held)


def shared_buckets(rows: np.ndarray):
    """The rows of each bucket, without the first column, of more than one row."""
    cuts = np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1
    starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(rows)]])
    for i in np.flatnonzero(ends - starts > 1):
        yield rows[starts[i] : ends[i], 1:]


def thin(batches):
    """Of the edges (``src, dst``) that a task makes a spanning forest, which connects the same.

    Memory is bounded: after ``THIN_EDGES`` edges the forest so far is given out.
    """
    parent: dict[int, int] = {}
    found: list[np.ndarray] = []
    seen = 0
    for batch in batches:
        pairs = np.unique(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1), axis=0)
        kept = np.zeros(len(pairs), bool)
        for k, (u, v) in enumerate(pairs.tolist()):
            while (up := parent.setdefault(u, u)) != u:
                parent[u] = u = parent[up]
            while (up := parent.setdefault(v, v)) != v:
                parent[v] = v = parent[up]
            if u != v:
                parent[max(u, v)] = min(u, v)
                kept[k] = True
        found.append(pairs[kept])
        seen += len(pairs)
        if seen >= THIN_EDGES:
            yield _edges(found)
            parent, found, seen = {}, [], 0
    yield _edges(found)


def _edges(found: list[np.ndarray]) -> pa.RecordBatch:
    both = np.concatenate([np.zeros((0, 2), np.int64), *found])
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["src", "dst"])


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Components of an undirected graph given as ``edges(src long, dst long)``.

    Returns ``node long, component long`` for every node that has an edge to another one; ``component`` is one node of
    the component, the same for all its nodes.  Edges are written and thinned to spanning forests, task by task (a
    caller whose own task makes the edges thins them there already).  Then each round contracts every node into its neighbour of least hash, if that is less
    than its own; rounds' maps are written to the shared folder and composed at the end, from the last, smallest one
    back.  A hub's edges are only summed by partial aggregation or joined with a written table of one row per node, so
    Spark can split them, and nothing is gathered on the driver.
    """
    e = written(edges.where("src <> dst").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")), "cc")
    e = written(e.mapInArrow(tidy(thin), "src long, dst long").distinct(), "cc")
    maps: list[DataFrame] = []
    for _ in range(max_rounds):
        if e.isEmpty():
            break
        ends = e.select(F.col("src").alias("node"), F.col("dst").alias("near")).union(e.select("dst", "src"))
        least = ends.groupBy("node").agg(F.min_by("near", F.xxhash64("near")).alias("near"))
        mine, its = F.xxhash64("node"), F.xxhash64("near")
        lower = (its < mine) | ((its == mine) & (F.col("near") < F.col("node")))
        hop = written(least.select("node", F.when(lower, F.col("near")).otherwise(F.col("node")).alias("to")), "cc")
        maps.append(hop)
        moved = e.join(hop.select(F.col("node").alias("src"), F.col("to").alias("a")), "src").join(hop.select(F.col("node").alias("dst"), F.col("to").alias("b")), "dst")
        e = written(moved.where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct(), "cc")
    else:
        raise RuntimeError("components did not settle")
    if not maps:
        return e.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    found = maps[-1].withColumnRenamed("to", "component")
    for hop in reversed(maps[:-1]):
        further = found.select(F.col("node").alias("to"), "component")
        found = hop.join(further, "to", "left").select("node", F.coalesce("component", "to").alias("component"))
    return found


# ---------------------------------------------------------------- sieve

#: Bits of a sieve, 4 MB in all; it is broadcast as at most 1024 rows, however many keys it holds.
SIEVE_BITS = 1 << 25


def sieve(keys: DataFrame) -> DataFrame:
    """Bitmap of the hashed values of a table's one column of longs, as slot and bits."""
    bit = F.pmod(F.col(keys.columns[0]), F.lit(SIEVE_BITS))
    rows = keys.select(F.shiftright(bit, 15).alias("treeloom slot"), bit.bitwiseAND(F.lit(32767)).alias("at"))
    return rows.groupBy("treeloom slot").agg(F.bitmap_construct_agg("at").alias("treeloom bits"))


def sifted(df: DataFrame, key: str, bitmap: DataFrame, name: str) -> DataFrame:
    """``df`` with a boolean column ``name``: false only where ``key`` is surely not among the sieve's keys.

    Of the rows that aren't, most get false while the sieve is sparse; an exact join must follow for the others.
    """
    bit = F.pmod(F.col(f"`{key}`"), F.lit(SIEVE_BITS))
    joined = df.join(F.broadcast(bitmap.withColumnRenamed("treeloom bits", f"{name} bits")), F.shiftright(bit, 15) == F.col("`treeloom slot`"), "left")
    byte = F.substring(F.col(f"`{name} bits`"), (F.shiftright(bit.bitwiseAND(F.lit(32767)), 3) + 1).cast("int"), F.lit(1))
    hit = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), bit.bitwiseAND(F.lit(7)).cast("int")) == 1
    return joined.withColumn(name, F.coalesce(hit, F.lit(False))).drop("treeloom slot", f"{name} bits")
