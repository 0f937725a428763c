"""Quality selection by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

A text's features are its words and runs of signs (lower-cased A-Z), their pairs, and pairs of their shapes (word,
capitals, digits, the signs themselves; a word after itself is one feature of its own), hashed to ``2**bits`` buckets.
The raw model counts the features of every document; the target model those of a bounded sample of documents labelled
good.  A document's log weight is the sum of ``log p_target - log p_raw`` over its features.  ``k`` documents are drawn
without replacement by Gumbel top-k: the ``k`` largest of log weight plus Gumbel noise.  ``k`` is the expected size of
a draw that takes each document with probability ``min(1, weight * exp(slack))``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import only, tidy, written

#: Bytes of a text that are hashed at once; parts end at white space.
PART_BYTES = 1 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SPACE, _WORD, _SIGN = 0, 1, 2


@dataclass(frozen=True)
class Settings:
    """``target_docs`` bounds the sample of good documents; ``slack`` in nats favours keeping.

    ``smoothing``: features by which both models are drawn together in every bucket.
    """

    bits: int = 16
    target_docs: int = 20_000
    slack: float = 6.0
    smoothing: float = 200.0
    seed: int = 5


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower-cased value of every byte."""
    kind, low = np.full(256, _SIGN, np.uint8), np.arange(256, dtype=np.uint64)
    kind[[0x20, *range(0x09, 0x0E)]] = _SPACE
    kind[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = _WORD
    low[0x41:0x5B] += 0x20
    return kind, low


_KIND, _LOW = _tables()
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64 and of its inverse, at least ``n`` of each."""
    if not _powers or next(iter(_powers)) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        base = 0x5851F42D4C957F2D
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers.clear()
        _powers[size] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return next(iter(_powers.values()))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _MULTIPLIER
    return h ^ (h >> np.uint64(32))


def _tokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and shape hash of each token of a part."""
    kind = _KIND[data]
    cuts = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    starts = np.concatenate([[0], cuts])
    ends = np.concatenate([cuts, [len(data)]])
    held = kind[starts] != _SPACE
    starts, ends = starts[held], ends[held]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    up, down = _power_tables(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_LOW[data] + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])
    h = _mix((sums[ends] - sums[starts]) * down[starts])
    capitals = np.concatenate([[0], np.cumsum((data >= 0x41) & (data <= 0x5A))])
    smalls = np.concatenate([[0], np.cumsum((data >= 0x61) & (data <= 0x7A))])
    digits = np.concatenate([[0], np.cumsum((data >= 0x30) & (data <= 0x39))])
    big, small, digit = (c[ends] - c[starts] for c in (capitals, smalls, digits))
    shape = np.where(digit == ends - starts, 1, np.where((big >= 2) & (small == 0), 2, 3)).astype(np.uint64)
    return h, np.where(kind[starts] == _SIGN, h, shape)


def feature_parts(text: str, bits: int):
    """Buckets of a whole text's features, part by part."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    shift, at = np.uint64(64 - bits), 0
    last = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    while at < len(data):
        cut = at + PART_BYTES
        while cut < len(data) and _KIND[data[cut]] != _SPACE:
            cut += 1
        h, shape = _tokens(data[at:cut])
        at = cut
        if not len(h):
            continue
        yield (h * _MULTIPLIER) >> shift
        h, shape = np.concatenate([last[0], h]), np.concatenate([last[1], shape])
        last = h[-1:], shape[-1:]
        same = (h[1:] == h[:-1]) & (shape[1:] <= np.uint64(3))
        pair = np.where(same, np.uint64(0x1234567), _mix(h[:-1] * np.uint64(3) + h[1:]))
        yield (pair * _MULTIPLIER) >> shift
        yield (_mix(_mix(shape[:-1]) * np.uint64(5) + shape[1:]) * _MULTIPLIER) >> shift


def log_ratios(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> np.ndarray:
    """``log p_target - log p_raw`` of every bucket; zeros if no document is labelled good.

    Every document counts for the raw model, the target sample too.  Rows without text count for nothing.
    """
    s = settings or Settings()
    width = 1 << s.bits
    good = only(labels, "doc_id", "quality").where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    good = good.orderBy(F.xxhash64("doc_id", F.lit(s.seed)), "doc_id").limit(s.target_docs).withColumn("good", F.lit(True))
    marked = only(docs, "doc_id", "text").where("text IS NOT NULL").join(F.broadcast(good), "doc_id", "left")  # at most target_docs ids

    def run(batches):
        counts = np.zeros((2, width), np.int64)
        for b in batches:
            for t, g in zip(b.column(0), b.column(1).to_pylist()):
                for ids in feature_parts(t.as_py(), s.bits):
                    if len(ids) > width // 8:
                        n = np.bincount(ids.astype(np.int64), minlength=width)
                        counts[0] += n
                        if g:
                            counts[1] += n
                    else:
                        np.add.at(counts[0], ids, 1)
                        if g:
                            np.add.at(counts[1], ids, 1)
        found = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), *[pa.array(c[found]) for c in counts]], names=["f", "raw", "target"])

    counts = np.zeros((2, width))
    found = marked.select("text", "good").mapInArrow(tidy(run), "f int, raw long, target long").groupBy("f").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()  # at most 2**bits rows
    counts[:, found["f"].to_numpy()] = found["raw"].to_numpy(), found["target"].to_numpy()
    if not counts[1].sum():
        return np.zeros(width)
    raw, target = counts / counts.sum(axis=1, keepdims=True)
    prior = s.smoothing / counts[0].sum()  # a bucket that the raw text hardly has says nothing about the target
    return np.log((target + prior) / (raw + prior))


def score(docs: DataFrame, ratios: np.ndarray, settings: Settings | None = None, keep: bool = False) -> DataFrame:
    """``doc_id, n_features, log_weight, gumbel_key`` of every row; with ``keep`` after all columns of ``docs``.

    A text that is null or has no features has log weight 0.  The noise depends on ``doc_id``, text and seed only.
    """
    s = settings or Settings()
    spark = docs.sparkSession
    rows = docs if keep else only(docs, "doc_id", "text")
    shared = spark.sparkContext.broadcast(ratios)  # 2**bits numbers
    at = rows.columns.index("text")
    bits = s.bits
    names = [*(rows.columns if keep else ["doc_id", "mark"]), "n_features", "log_weight"]
    if not keep:
        rows = rows.withColumn("mark", F.xxhash64("doc_id", "text", F.lit(s.seed)))

    def run(batches):
        ratio = shared.value
        for b in batches:
            for start in range(0, b.num_rows, 1000):
                part = b.slice(start, 1000)
                n, w = [], []
                for t in part.column(at):
                    total, count = 0.0, 0
                    if t.is_valid:
                        for ids in feature_parts(t.as_py(), bits):
                            total += float(ratio[ids].sum())
                            count += len(ids)
                    n.append(count)
                    w.append(total)
                columns = part.columns if keep else [part.column(0), part.column(2)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(w, pa.float64())], names=names)

    fields = rows.schema.fields if keep else [rows.schema["doc_id"], rows.schema["mark"]]
    out = rows.mapInArrow(tidy(run), T.StructType([*fields, T.StructField("n_features", T.LongType()), T.StructField("log_weight", T.DoubleType())]))
    mark = F.xxhash64("doc_id", "text", F.lit(s.seed)) if keep else F.col("mark")
    uniform = (F.shiftrightunsigned(mark, 12).cast("double") + 0.5) / float(1 << 52)
    out = out.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform)))
    return out if keep else out.select("doc_id", "n_features", "log_weight", "gumbel_key")


def draw_size(scored: DataFrame, slack: float) -> int:
    """``k``: expected size of a draw by ``min(1, weight * exp(slack))``, summed in whole millionths."""
    share = F.round(F.exp(F.least(F.lit(0.0), F.col("log_weight") + slack)) * 1e6).cast("long")
    return round((scored.agg(F.sum(share)).first()[0] or 0) / 1e6)


def top_k(scored: DataFrame, k: int, most: int = 50_000):
    """Condition for the ``k`` rows with the largest ``gumbel_key`` (ties to the smaller ``doc_id``, null last).

    The threshold is found exactly by histograms of narrowing ranges; only a last range of at most ``most`` rows, or of
    equal keys, is ordered.
    """
    if k <= 0:
        return F.lit(False)
    key = F.col("gumbel_key")
    low, high, total = scored.agg(F.min(key), F.max(key), F.count("*")).first()
    if k >= total:
        return F.lit(True)
    above = 0  # rows over the range
    inside = total
    while inside > most and high > low:
        step = (high - low) / 1024
        if low + step == low:
            break
        slot = F.least(F.floor((key - low) / step), F.lit(1023)).cast("int")
        found = scored.where((key >= low) & (key <= high)).groupBy(slot.alias("slot")).agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).collect()
        for r in sorted(found, key=lambda r: -r.slot):
            if above + r.n >= k:
                low, high, inside = r.low, r.high, r.n
                break
            above += r.n
    w = scored.where((key >= low) & (key <= high)).orderBy(key.desc(), F.col("doc_id").asc_nulls_last()).limit(k - above)
    last = w.orderBy(key.asc(), F.col("doc_id").desc_nulls_first()).select("gumbel_key", "doc_id").first()
    tie = F.lit(True) if last.doc_id is None else F.coalesce(F.col("doc_id") <= last.doc_id, F.lit(False))
    return (key > last.gumbel_key) | ((key == last.gumbel_key) & tie)


def resample(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> DataFrame:
    """``doc_id, n_features, log_weight, gumbel_key, kept`` of every document.

    Null and empty texts weigh 1 (log weight 0).  Repeated rows share weight and noise and fall together; if the last
    place falls between equal rows, all of them are kept.  Without good labels every weight is 1.  Other columns are
    ignored; no rows give none.
    """
    s = settings or Settings()
    scored = written(score(docs, log_ratios(docs, labels, s), s), "scores")
    return scored.withColumn("kept", top_k(scored, draw_size(scored, s.slack)))


def keep_drawn(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Rows of ``docs`` that ``resample`` keeps, with all their columns; they are scored again rather than shuffled.

    Null and empty texts weigh 1 and stay as ``resample`` says, rows with a null id too; repeated rows stay or go
    together; no rows give none; further columns, whatever their names, come back as they were.
    """
    s = settings or Settings()
    ratios = log_ratios(docs, labels, s)
    scored = written(score(docs, ratios, s), "scores")
    names = {c: f"treeloom {i}" for i, c in enumerate(docs.columns) if c in ("n_features", "log_weight", "gumbel_key")}
    again = score(docs.withColumnsRenamed(names), ratios, s, keep=True).where(top_k(scored, draw_size(scored, s.slack)))
    return again.drop("n_features", "log_weight", "gumbel_key").withColumnsRenamed({v: k for k, v in names.items()}).select(*[F.col(f"`{c}`") for c in docs.columns])
