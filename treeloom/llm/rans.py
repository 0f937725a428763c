"""Token-id files: interleaved range asymmetric numeral system with shared static frequencies.

All files of a data set share one frequency table (``frequencies.bin``).  A file holds, in ascending ``doc_id`` order,
the ids of consecutive documents as independent blocks.  A block is coded by ``LANES`` interleaved 64-bit coders that
emit 32-bit words; at fixed distances it stores the coders' states and the place in its words (checkpoints), so a reader
can start there.  A footer lists each block's place, first id, number of ids and CRC-32, and the documents' lengths.

file    := magic block* footer footer-size:u32 footer-crc32:u32 magic
block   := word-count:u32 checkpoint-words:u32[] states:u64[checkpoints][LANES] words:u32[]
footer  := zlib(json header line, then the arrays that it names)
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import AtomicFile, file_system, new_dir, only, open_input, tidy, written

MAGIC = b"TLRANS01"
LANES = 2048
PROBABILITY_BITS = 20
LOW = np.uint64(1 << 31)
BLOCK_IDS = 1 << 20
CHECKPOINT_IDS = 1 << 18
#: A file is closed after so many ids; a reading task decodes the documents that begin in so many ids of a file.
FILE_IDS = 1 << 26
CHUNK_IDS = 1 << 23


class Frequencies:
    """Static table: frequency and start of every id, scaled to ``2**PROBABILITY_BITS``."""

    def __init__(self, scaled: np.ndarray):
        self.scaled = scaled.astype(np.uint64)
        self.starts = np.concatenate([[0], np.cumsum(self.scaled)])[:-1].astype(np.uint64)
        self._ids: np.ndarray | None = None

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Frequencies:
        """Every id that occurs gets at least one part."""
        total, parts = int(counts.sum()), 1 << PROBABILITY_BITS
        if not total:
            return cls(np.array([parts]))
        if int((counts > 0).sum()) > parts:
            raise ValueError("more ids than parts")
        scaled = np.where(counts > 0, np.maximum(1, (counts.astype(np.float64) * (parts / total)).astype(np.int64)), 0)
        rest = parts - int(scaled.sum())
        while rest:  # the most frequent ids take up what rounding left
            order = np.argsort(-scaled, kind="stable")
            step = rest if rest > 0 else -min(-rest, int(scaled[order[0]]) // 2)
            scaled[order[0]] += step
            rest -= step
        return cls(scaled)

    @property
    def ids(self) -> np.ndarray:
        if self._ids is None:
            self._ids = np.repeat(np.arange(len(self.scaled), dtype=np.uint32), self.scaled.astype(np.int64))
        return self._ids

    def to_bytes(self) -> bytes:
        body = zlib.compress(self.scaled.astype("<u4").tobytes())
        return MAGIC + zlib.crc32(body).to_bytes(4, "little") + body

    @classmethod
    def from_bytes(cls, data: bytes) -> Frequencies:
        if data[:8] != MAGIC or zlib.crc32(data[12:]) != int.from_bytes(data[8:12], "little"):
            raise ValueError("damaged frequency table")
        return cls(np.frombuffer(zlib.decompress(data[12:]), dtype="<u4"))


def encode_block(ids: np.ndarray, freq: Frequencies) -> bytes:
    """One block of ids."""
    n = len(ids)
    rows, every = -(-n // LANES), CHECKPOINT_IDS // LANES
    state = np.full(LANES, LOW, dtype=np.uint64)
    bits, room = np.uint64(PROBABILITY_BITS), np.uint64(63 - PROBABILITY_BITS)
    f_all, c_all = freq.scaled[ids], freq.starts[ids]
    emitted: list[np.ndarray] = [np.zeros(0, np.uint32)] * rows
    states: list[np.ndarray] = []
    for r in range(rows - 1, -1, -1):
        f, c = f_all[r * LANES : (r + 1) * LANES], c_all[r * LANES : (r + 1) * LANES]
        x = state[: len(f)]
        over = x >= f << room
        emitted[r] = x[over].astype(np.uint32)
        x = np.where(over, x >> np.uint64(32), x)
        q = x // f
        state[: len(f)] = (q << bits) + (x - q * f) + c
        if r % every == 0:
            states.append(state.copy())
    places = np.concatenate([[0], np.cumsum([len(e) for e in emitted])])
    words = np.concatenate(emitted) if rows else np.zeros(0, np.uint32)
    marks = places[: rows : every].astype("<u4")
    return np.uint32(len(words)).tobytes() + marks.tobytes() + b"".join(s.astype("<u8").tobytes() for s in reversed(states)) + words.astype("<u4").tobytes()


def decode_block(data, n: int, freq: Frequencies, checkpoint: int = 0, stop: int | None = None) -> np.ndarray:
    """ids of a block of ``n`` from a checkpoint (by number) on, up to id ``stop``."""
    rows, every = -(-n // LANES), CHECKPOINT_IDS // LANES
    marks = np.frombuffer(data, "<u4", -(-rows // every), 4)
    at = 4 + 4 * len(marks)
    state = np.frombuffer(data, "<u8", LANES, at + checkpoint * LANES * 8).astype(np.uint64)
    words = np.frombuffer(data, "<u4", -1, at + len(marks) * LANES * 8).astype(np.uint64)
    bits, mask, table = np.uint64(PROBABILITY_BITS), np.uint64((1 << PROBABILITY_BITS) - 1), freq.ids
    place, first = int(marks[checkpoint]) if len(marks) else 0, checkpoint * every
    stop = n if stop is None else min(stop, n)
    out = []
    for r in range(first, -(-stop // LANES)):
        x = state[: min(LANES, n - r * LANES)]
        slot = x & mask
        s = table[slot]
        x = freq.scaled[s] * (x >> bits) + slot - freq.starts[s]
        need = np.flatnonzero(x < LOW)
        x[need] = x[need] << np.uint64(32) | words[place : place + len(need)]
        place += len(need)
        state[: len(x)] = x
        out.append(s)
    return (np.concatenate(out) if out else np.zeros(0, np.uint32))[: stop - first * LANES]


# ---------------------------------------------------------------- files


def write_file(folder: str, name: str, docs: Iterator[tuple[int | None, np.ndarray]], freq: Frequencies) -> dict:
    """Write one file of ``(doc_id, ids)`` and return its name and sizes; memory holds about one block and one document."""
    out = AtomicFile(folder, name)
    out.write(MAGIC)
    doc_ids, lengths, blocks, held, first = [], [], [], [], 0

    def flush(ids: np.ndarray):
        nonlocal first
        body = encode_block(ids, freq)
        blocks.append((out.size, len(body), first, len(ids), zlib.crc32(body)))
        out.write(body)
        first += len(ids)

    waiting = 0
    for doc_id, ids in docs:
        doc_ids.append(doc_id)
        lengths.append(len(ids))
        held.append(ids)
        waiting += len(ids)
        if waiting >= BLOCK_IDS:
            joined = np.concatenate(held)
            whole = len(joined) // BLOCK_IDS * BLOCK_IDS
            for at in range(0, whole, BLOCK_IDS):
                flush(joined[at : at + BLOCK_IDS])
            held, waiting = [joined[whole:]], len(joined) - whole
    if waiting:
        flush(np.concatenate(held))
    nulls = np.array([d is None for d in doc_ids], dtype=np.uint8)
    arrays = {"blocks": np.array(blocks, dtype="<i8").reshape(-1, 5), "doc_ids": np.array([d or 0 for d in doc_ids], dtype="<i8"), "nulls": nulls, "lengths": np.array(lengths, dtype="<i8")}
    head = json.dumps({k: [v.dtype.str, list(v.shape)] for k, v in arrays.items()}).encode() + b"\n"
    footer = zlib.compress(head + b"".join(v.tobytes() for v in arrays.values()))
    out.write(footer)
    out.write(len(footer).to_bytes(4, "little") + zlib.crc32(footer).to_bytes(4, "little") + MAGIC)
    return {"name": out.commit(), "n_docs": len(lengths), "n_tokens": int(sum(lengths)), "bytes": out.size}


class Reader:
    """Random and sequential access to one file."""

    def __init__(self, folder: str, name: str, freq: Frequencies):
        self.file, self.freq = open_input(folder, name), freq
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        n, crc = int.from_bytes(tail[:4], "little"), int.from_bytes(tail[4:8], "little")
        footer = self.file.read_at(n, size - 16 - n)
        if tail[8:] != MAGIC or zlib.crc32(footer) != crc:
            raise ValueError(f"damaged footer of {name}")
        data = zlib.decompress(footer)
        head, at = json.loads(data[: data.index(b"\n")]), data.index(b"\n") + 1
        for k, (kind, shape) in head.items():
            count = int(np.prod(shape))
            setattr(self, k, np.frombuffer(data, kind, count, at).reshape(shape))
            at += count * np.dtype(kind).itemsize

    def block(self, k: int) -> bytes:
        at, size, _, _, crc = self.blocks[k].tolist()
        body = self.file.read_at(size, at)
        if zlib.crc32(body) != crc:
            raise ValueError(f"damaged block {k}")
        return body

    def ids(self, start: int, count: int) -> np.ndarray:
        """``count`` ids of the file from ``start`` on, decoded from the nearest checkpoints."""
        out, stop = [], min(start + count, int(self.lengths.sum()))
        while start < stop:
            k = int(np.searchsorted(self.blocks[:, 2], start, side="right")) - 1
            first, n = self.blocks[k, 2:4].tolist()
            mark = (start - first) // CHECKPOINT_IDS
            part = decode_block(self.block(k), n, self.freq, mark, stop - first)[start - first - mark * CHECKPOINT_IDS :]
            out.append(part)
            start += len(part)
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def _decoded(self, start: int, stop: int) -> Iterator[np.ndarray]:
        """ids from ``start`` up to ``stop``, block by block; the first one from the checkpoint before it."""
        k = int(np.searchsorted(self.blocks[:, 2], start, side="right")) - 1
        while start < stop:
            first, n = self.blocks[k, 2:4].tolist()
            mark = (start - first) // CHECKPOINT_IDS
            part = decode_block(self.block(k), n, self.freq, mark, stop - first)[start - first - mark * CHECKPOINT_IDS :]
            yield part
            start += len(part)
            k += 1

    def documents(self, low: int = 0, high: int | None = None) -> Iterator[tuple[int | None, int, Iterator[np.ndarray]]]:
        """``doc_id, start, parts of ids`` in order, of documents that begin at ids from ``low`` to below ``high``; parts
        of a document must be used up before the next one."""
        ends = np.cumsum(self.lengths)
        starts = ends - self.lengths
        a, b = np.searchsorted(starts, [low, int(ends[-1]) if high is None and len(ends) else high or 0]).tolist()
        if a == b:
            return
        source, buffer = self._decoded(int(starts[a]), int(ends[b - 1])), np.zeros(0, np.uint32)

        def parts(n):
            nonlocal buffer
            while n:
                if not len(buffer):
                    buffer = next(source)
                part, buffer = buffer[:n], buffer[n:]
                n -= len(part)
                yield part

        for doc_id, null, start, n in zip(*(x[a:b].tolist() for x in (self.doc_ids, self.nulls, starts, self.lengths))):
            yield (None if null else doc_id), start, parts(n)


# ---------------------------------------------------------------- data sets


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, special: bool = True, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode ``docs(doc_id, text, ...)`` and write token files below ``folder``; returns the list of files.

    The list ``file_no, name, n_docs, n_tokens, bytes`` is a table; a task writes a file of ``file_ids`` ids after the
    other.  Ids ascend by ``doc_id`` from file to file
    (null ids first, rows of one id by their tokens).  A null text has the end id alone; other columns are ignored;
    without rows there are no files.
    """

    def encode(batches):
        """Documents as rows of kind 0, and at the end how often each id occurs as one row of kind 1."""
        from .tokens import encoder

        enc = encoder(tokenizer, special)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        total = np.zeros(max(enc.tokenizer.get_vocab_size(), end_id + 1), np.int64)
        names, width = ["kind", "doc_id", "ids", "width"], enc.dtype.itemsize
        for b in batches:
            for at in range(0, b.num_rows, 5000):
                part = b.slice(at, 5000)
                found = [x + end for x in enc.encode_many(part.column(1).to_pylist())]
                for text in found:
                    if len(text) > 1 << 20:
                        total += np.bincount(np.frombuffer(text, enc.dtype), minlength=len(total))
                total += np.bincount(np.frombuffer(b"".join(x for x in found if len(x) <= 1 << 20), enc.dtype), minlength=len(total))
                yield pa.RecordBatch.from_arrays([pa.array([0] * len(found), pa.int32()), part.column(0), pa.array(found, pa.binary()), pa.array([width] * len(found), pa.int32())], names=names)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([None], pa.int64()), pa.array([total.astype("<i8").tobytes()]), pa.array([8], pa.int32())], names=names)

    def add(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            for one in b.column(0):
                n = np.frombuffer(one.as_buffer(), "<i8")
                total = n + (total if len(total) else 0)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found])], names=["id", "n"])

    def write(batches):
        freq = _load(folder)

        def rows():
            for b in batches:
                for doc_id, ids, width in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                    yield doc_id, np.frombuffer(ids.as_buffer(), dtype=f"<u{width}").astype(np.uint32)

        source, part, number = rows(), TaskContext.get().partitionId(), 0
        while (first := next(source, None)) is not None:
            done = write_file(folder, f"tokens-{part:06d}-{number:06d}.rans", _limited(first, source, file_ids), freq)
            yield pa.RecordBatch.from_arrays([pa.array([part << 32 | number]), *[pa.array([done[k]]) for k in ("name", "n_docs", "n_tokens", "bytes")]], names=["file_no", "name", "n_docs", "n_tokens", "bytes"])
            number += 1

    spark = docs.sparkSession
    encoded = written(only(docs, "doc_id", "text").mapInArrow(tidy(encode, "tokens"), "kind int, doc_id long, ids binary, width int"), "ids")
    counts = encoded.where("kind = 1").select("ids").mapInArrow(tidy(add), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # at most the vocabulary
    encoded = encoded.where("kind = 0").drop("kind")
    table = np.zeros(max((r.id for r in counts), default=0) + 1, dtype=np.int64)
    for r in counts:
        table[r.id] = r.n
    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/frequencies.bin") as out:
        out.write(Frequencies.of_counts(table).to_bytes())
    ordered = encoded.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    return written(ordered.mapInArrow(tidy(write), "file_no long, name string, n_docs long, n_tokens long, bytes long"), "files")


def _limited(first, rest, most: int):
    """Documents until they have ``most`` ids, the last one whole."""
    n = 0
    while first is not None:
        yield first
        n += len(first[1])
        first = next(rest, None) if n < most else None


def _load(folder: str) -> Frequencies:
    with open_input(folder, "frequencies.bin") as f:
        return Frequencies.from_bytes(f.read())


def read_token_files(files: DataFrame, folder: str, chunk_ids: int = CHUNK_IDS) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the files of ``write_token_files``.

    A task decodes the documents that begin in ``chunk_ids`` ids of a file, from the checkpoint before them.
    """
    spark = files.sparkSession
    listed = files.orderBy("file_no").select("name", "n_tokens").collect()  # one row per file
    before = np.concatenate([[0], np.cumsum([r.n_tokens for r in listed], dtype=np.int64)]).tolist()
    plan = [(r.name, start, r.n_tokens) for r, start in zip(listed, before)]
    chunks = sum(-(-r.n_tokens // chunk_ids) for r in listed)

    def read(batches):
        freq = _load(folder)
        for b in batches:
            for name, before, chunk in zip(*[c.to_pylist() for c in b.columns]):
                reader, rows = Reader(folder, name, freq), []
                for doc_id, start, parts in reader.documents(chunk * chunk_ids, (chunk + 1) * chunk_ids):
                    n = crc = 0
                    for part in parts:
                        crc, n = zlib.crc32(part.astype("<u4"), crc), n + len(part)
                    rows.append((doc_id, before + start, n, crc))
                for at in range(0, len(rows), 10_000):
                    cols = list(zip(*rows[at : at + 10_000]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    todo = spark.createDataFrame(plan, "name string, before long, n_tokens long").where("n_tokens > 0")
    todo = todo.select("name", "before", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / chunk_ids).cast("int"))).alias("chunk"))
    return todo.repartition(max(1, chunks)).mapInArrow(tidy(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_folder(spark) -> str:
    return new_dir(spark, "tokens")
