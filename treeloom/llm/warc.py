"""WARC archives as seekable Zstandard bundles.

A bundle is one file: independent Zstandard frames, each with whole WARC/1.1 records of about ``FRAME_BYTES``, closed by
two skippable frames.  The first maps every record's identifier (the UUID of its WARC-Record-ID) to its frame and its
offset inside the uncompressed frame; the second is the usual seek table (sizes of all frames), so a reader finds any
frame from the file's end.  Any Zstandard tool reads the whole as an ordinary WARC stream.

Records with equal payloads of at least ``REVISIT_BYTES`` are stored once: that with the largest id is the response, the
others are revisits that name it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import AtomicFile, new_dir, only, open_input, sieve, sifted, tidy, written

FRAME_BYTES = 1 << 18
REVISIT_BYTES = 1000
#: Uncompressed bytes of a bundle aimed at.
BUNDLE_BYTES = 1 << 28
#: Bundles that a task reads one after the other.
TASK_BUNDLES = 1
#: Magic numbers of the Zstandard format: skippable frames, seek table footer (fixed values).
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEK_MAGIC = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
_NAMES = uuid.UUID("6f1f6d3c-6f0e-4e1c-9a51-2b9a3ad0a0c5")


def record_uuid(page_id: int | None, digest: str) -> uuid.UUID:
    """Identifier of a page's record, made of the page id and the payload's SHA-1 in hex.

    Rows that share it hold the same page and payload, so a reference to any of them is right.
    """
    return uuid.uuid5(_NAMES, f"{page_id} {digest}")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{record_uuid(page_id, digest)}>"


def _line(value: str) -> str:
    """A header value on one line."""
    return "".join(" " if ord(c) < 32 or ord(c) == 127 else c for c in value)


def build_record(page_id, url, payload: bytes | None, digest: bytes, size: int, refers_to) -> bytes:
    """A response with its payload or, if ``payload`` is None, a revisit of page ``refers_to``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest.hex())}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if payload is None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest.hex())}", f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data, at: int = 0) -> tuple[dict, bytes, int]:
    """Headers, block and end of the record at a place of an uncompressed frame."""
    stop = data.index(b"\r\n\r\n", at)
    lines = bytes(data[at:stop]).decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    head = dict(x.split(": ", 1) for x in lines[1:])
    start = stop + 4
    end = start + int(head["Content-Length"])
    if bytes(data[end : end + 4]) != b"\r\n\r\n":
        raise ValueError("damaged record")
    return head, bytes(data[start:end]), end + 4


def write_bundle(folder: str, name: str, records: Iterator[tuple[uuid.UUID, bytes]]) -> dict:
    """Write records with their identifiers in order; memory holds a frame and the index."""
    import zstandard

    out, packer = AtomicFile(folder, name), zstandard.ZstdCompressor(level=3, write_checksum=True)
    frames, index, held, size = [], [], [], 0

    def flush():
        nonlocal held, size
        if held:
            plain = b"".join(held)
            packed = packer.compress(plain)
            out.write(packed)
            frames.append((len(packed), len(plain)))
            held, size = [], 0

    for name_, record in records:
        index.append((name_.bytes, len(frames), size))
        held.append(record)
        size += len(record)
        if size >= FRAME_BYTES:
            flush()
    flush()
    body = zlib.compress(struct.pack("<Q", len(index)) + b"".join(struct.pack("<16sII", *x) for x in index))
    skip = struct.pack("<II", SKIPPABLE_INDEX, len(body)) + body
    out.write(skip)
    entries = b"".join(struct.pack("<II", *f) for f in [*frames, (len(skip), 0)])
    seek = entries + struct.pack("<IBI", len(frames) + 1, 0, SEEK_MAGIC)
    out.write(struct.pack("<II", SKIPPABLE_SEEK, len(seek)) + seek)
    return {"name": out.commit(), "records": len(index), "bytes": out.size}


class Bundle:
    """Reader of one bundle: by record identifier or number, or all in order."""

    def __init__(self, folder: str, name: str):
        self.file = open_input(folder, name)
        size = self.file.size()
        count, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEK_MAGIC:
            raise ValueError(f"{name} has no seek table")
        table = self.file.read_at(8 * count, size - 9 - 8 * count)
        sizes = [struct.unpack_from("<II", table, 8 * i) for i in range(count)]
        self.frames, at = [], 0
        for packed, plain in sizes:
            self.frames.append((at, packed, plain))
            at += packed
        at, packed, _ = self.frames.pop()
        body = zlib.decompress(self.file.read_at(packed, at)[8:])
        (n,) = struct.unpack_from("<Q", body)
        entries = list(struct.iter_unpack("<16sII", body[8 : 8 + 24 * n]))
        self.index = [e[1:] for e in entries]
        self.numbers = {e[0]: i for i, e in reversed(list(enumerate(entries)))}  # of repeated records the first

    def frame(self, k: int) -> bytes:
        import zstandard

        at, packed, plain = self.frames[k]
        data = zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at))
        if len(data) != plain:
            raise ValueError("damaged frame")
        return data

    def record(self, number: int) -> tuple[dict, bytes]:
        k, at = self.index[number]
        return parse_record(self.frame(k), at)[:2]

    def find(self, name: uuid.UUID) -> tuple[dict, bytes] | None:
        """The record with an identifier, or None; one frame is read."""
        number = self.numbers.get(name.bytes)
        return None if number is None else self.record(number)

    def __iter__(self) -> Iterator[tuple[int, int, int, dict, bytes]]:
        """Record number, frame, offset in the frame, headers, block."""
        held, data = -1, b""
        for number, (k, at) in enumerate(self.index):
            if k != held:
                held, data = k, self.frame(k)
            yield number, k, at, *parse_record(data, at)[:2]


def roles(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, digest, size, refers_to``: the page of the response that a revisit refers to, else null.

    A revisit's html is null.  Roles are decided on ids, digests and sizes alone.  Html isn't shuffled but for the few
    rows that a sieve of the revisits lets through by chance.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = only(pages, "page_id", "url", "html").select("page_id", "url", "html", F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("size"))
    own = F.xxhash64("page_id", "digest", "size")
    narrow = written(rows.select("page_id", "url", "digest", "size", own.alias("own")), "digests")
    first = narrow.where(F.col("size") >= REVISIT_BYTES).groupBy("digest", "size").agg(F.max("page_id").alias("response"), F.count("*").alias("n"))
    first = written(first.where("n > 1 AND response IS NOT NULL").select("digest", "size", "response"), "responses")
    again = narrow.join(first, ["digest", "size"]).where(~F.col("page_id").eqNullSafe(F.col("response")))
    again = written(again.select("page_id", "url", "digest", "size", "own", F.col("response").alias("refers_to")), "revisits")
    names = ["page_id", "url", "html", "digest", "size"]
    bitmap, none = sieve(again.select("own")), F.lit(None)
    marked = sifted(rows.withColumn("own", own), "own", bitmap, "may revisit")
    out = marked.where("NOT `may revisit`").select(*names, none.cast("long").alias("refers_to"))
    out = out.unionByName(again.select("page_id", "url", none.cast("string").alias("html"), "digest", "size", "refers_to"))
    same = [F.col("a.page_id").eqNullSafe(F.col("b.page_id")), F.col("a.own") == F.col("b.own"), F.col("a.digest") == F.col("b.digest")]
    by_chance = sifted(narrow, "own", bitmap, "may revisit").where("`may revisit`").alias("a").join(again.alias("b"), same, "left_anti")
    by_chance = written(by_chance.select("page_id", "digest", "own").distinct(), "others")
    if by_chance.isEmpty():
        return out
    chosen = sifted(marked.where("`may revisit`"), "own", sieve(by_chance.select("own")), "by chance").where("`by chance`")
    exact = chosen.alias("a").join(by_chance.alias("b"), same, "left_semi")
    return out.unionByName(exact.select(*names, none.cast("long").alias("refers_to")))


def write_archives(pages: DataFrame, folder: str, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write ``pages(page_id, url, html, ...)`` below ``folder``; returns the bundles: ``name, records, bytes``.

    A task writes a bundle of about ``bundle_bytes`` uncompressed after the other.

    A null html is an empty payload, a null url has no target line.  Of equal long payloads all rows with the largest
    page id are responses (repeated rows too); a null page id never is the one referred to, and if all are null each
    is a response.  Other columns are ignored; without rows there are no bundles.
    """

    def run(batches):
        def records():
            for b in batches:
                for page_id, url, html, digest, size, refers_to in zip(*[c.to_pylist() for c in b.columns]):
                    payload = (html or "").encode("utf-8", "surrogatepass") if refers_to is None else None
                    yield record_uuid(page_id, digest), build_record(page_id, url, payload, bytes.fromhex(digest), size, refers_to)

        source, number = records(), 0
        while (first := next(source, None)) is not None:
            done = write_bundle(folder, f"bundle-{TaskContext.get().partitionId():06d}-{number:04d}.warc.zst", _limited(first, source, bundle_bytes))
            yield pa.RecordBatch.from_arrays([pa.array([done[k]]) for k in ("name", "records", "bytes")], names=["name", "records", "bytes"])
            number += 1

    return written(roles(pages).mapInArrow(tidy(run), "name string, records long, bytes long"), "bundles")


def _limited(first, rest, most: int):
    """Records until they have ``most`` bytes, the last one whole."""
    size = 0
    while first is not None:
        yield first
        size += len(first[1])
        first = next(rest, None) if size < most else None


def read_archives(bundles: DataFrame, folder: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, bundle, record, frame, frame_offset`` of every record.

    A response's size and digest come from its payload, a revisit's from its stored headers; a response whose payload
    doesn't have the stored digest is an error.
    """

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "bundle", "record", "frame", "frame_offset"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def read(batches):
        for b in batches:
            for name in b.column(0).to_pylist():
                rows = []
                for number, frame, at, head, block in Bundle(folder, name):
                    cut = block.index(b"\r\n\r\n")
                    stored = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    kind, refers_to = head["WARC-Type"], head.get("X-Refers-To-Page")
                    if kind == "response":
                        size, digest = len(block) - cut - 4, hashlib.sha1(block[cut + 4 :]).hexdigest()
                        if digest != stored:
                            raise ValueError(f"damaged payload of record {number} in {name}")
                    else:
                        size, digest = int(block[:cut].rsplit(b": ", 1)[1]), stored
                    page_id = head.get("X-Page-Id")
                    rows.append((None if page_id is None else int(page_id), size, digest, kind, None if refers_to is None else int(refers_to), name, number, frame, at))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, bundle string, record long, frame long, frame_offset long"
    # a name is a few bytes, but seconds of work: an explicit number of tasks, at most TASK_BUNDLES for each
    tasks = max(1, -(-bundles.count() // TASK_BUNDLES))
    return bundles.select("name").repartition(tasks).mapInArrow(tidy(read), schema)


def archive_folder(spark) -> str:
    return new_dir(spark, "warc")
