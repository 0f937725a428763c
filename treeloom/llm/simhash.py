"""Near-duplicate documents by SimHash fingerprints and Golay-code fuzzy keys.

A fingerprint of 64 bits is cut into three segments of 22, 21 and 21 bits, each padded with zeros to a word of the
perfect binary Golay code (23 bits, corrects 3 errors).  The keys of a segment are the codewords to which the segment
itself and all its one-bit neighbours decode: one or six codewords.  Two segments at distance 2 or less have a common
one-bit neighbour (or are neighbours), hence a common key.  Two fingerprints that differ in at most 5 bits have at most
one segment with more than 2 differing bits, so they agree on a key of both other segments.  A bucket is such a pair of
keys (24 bits and the pair's number); candidates of a bucket are verified by their exact Hamming distance.

Exact copies are folded before (one row per distinct fingerprint), and a bucket yields a spanning forest of its links
rather than all pairs, so groups of thousands of copies stay linear.

``near_duplicates`` links by the distance of fingerprints.  ``similar_documents`` takes the same buckets, of three
fingerprints, as candidates for a similarity of shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import connected_components, only, shared_buckets, sieve, sifted, thin, tidy, whole_buckets, written

SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 (fixed value).
GOLAY_POLYNOMIAL = 0b110001110101
MAX_DISTANCE = 5
#: Texts are cut at white space into parts of about so many bytes while they are hashed.
PART_BYTES = 1 << 22


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit word by the generator polynomial: 11 bits."""
    r = words.astype(np.uint32).copy()
    for bit in range(22, 10, -1):
        r ^= ((r >> np.uint32(bit)) & np.uint32(1)) * np.uint32(GOLAY_POLYNOMIAL << (bit - 11))
    return r


@lru_cache(maxsize=1)
def _leaders() -> np.ndarray:
    """Error pattern of weight 3 or less for each of the 2048 syndromes."""
    errors = [0]
    for i in range(23):
        errors.append(1 << i)
        for j in range(i):
            errors.append(1 << i | 1 << j)
            errors.extend(1 << i | 1 << j | 1 << k for k in range(j))
    errors = np.array(errors, dtype=np.uint32)
    table = np.zeros(2048, dtype=np.uint32)
    table[_syndrome(errors)] = errors
    return table


def golay_index(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit word."""
    words = words.astype(np.uint32)
    return (words ^ _leaders()[_syndrome(words)]) >> np.uint32(11)


def segment_keys(words: np.ndarray, bits: int) -> np.ndarray:
    """Keys of segments: row by row the codeword indices of the word and of its one-bit neighbours, repeats as -1."""
    flips = np.concatenate([[0], 1 << np.arange(bits)]).astype(np.uint32)
    keys = golay_index((words.astype(np.uint32)[:, None] ^ flips[None, :]).ravel()).reshape(len(words), bits + 1).astype(np.int64)
    keys.sort(axis=1)
    keys[:, 1:][keys[:, 1:] == keys[:, :-1]] = -1
    keys = -np.sort(-keys, axis=1)
    return keys[:, : max(1, int((keys >= 0).sum(axis=1).max(initial=1)))]


def bucket_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (row number, bucket key) of an array of unsigned fingerprints."""
    parts = [segment_keys((fingerprints >> np.uint64(at)) & np.uint64((1 << bits) - 1), bits) for at, bits in SEGMENTS]
    rows, keys = [], []
    for n, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        a, b = parts[i][:, :, None], parts[j][:, None, :]
        key = np.where((a >= 0) & (b >= 0), a << 12 | b | n << 24, -1).reshape(len(fingerprints), -1)
        r, c = np.nonzero(key >= 0)
        rows.append(r)
        keys.append(key[r, c])
    return np.concatenate(rows), np.concatenate(keys)


def _word_parts(data: bytes) -> Iterator[list[bytes]]:
    """Words of a text, part by part."""
    at = 0
    while len(data) - at > PART_BYTES:
        cut = at + PART_BYTES
        while cut < len(data) and data[cut] not in b" \t\n\v\f\r":
            cut += 1
        yield data[at:cut].split()
        at = cut
    yield (data[at:] if at else data).split()


def shingle_hashes(text: str | None, width: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of a whole text's shingles of ``width`` words, part by part.

    A-Z are lower-cased and words are joined by one space.  A text with fewer words is one shingle; one without words
    has none.
    """
    import xxhash

    digest = xxhash.xxh64_intdigest
    found, carry = False, []
    for words in _word_parts((text or "").encode("utf-8", "surrogatepass").lower()):
        words = carry + words
        carry = words[-(width - 1) :] if width > 1 else []
        if len(words) < width:
            continue
        line = b" ".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: len(words) - width + 1].tolist()
        found = True
        yield np.array([digest(line[s:e], 42) for s, e in zip(starts, ends[width - 1 :].tolist())], dtype="<u8")
    if not found and carry:
        yield np.array([digest(b" ".join(carry), 42)], dtype="<u8")


def _set_bits(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each of the 64 bits."""
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        total += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total


def _majority(ones: np.ndarray, total: int) -> int:
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > total).tolist()))


def fingerprint(text: str | None, width: int = 4) -> int:
    """SimHash of a whole text: bits that are set in over half its shingles' hashes; 0 without words."""
    ones, total = np.zeros(64, dtype=np.int64), 0
    for hashes in shingle_hashes(text, width):
        ones += _set_bits(hashes)
        total += len(hashes)
    return _majority(ones, total)


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """``doc_id, fp``: the fingerprint as a signed long; a null text has no words."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return only(docs, "doc_id", "text").mapInArrow(tidy(run), "doc_id long, fp long")


def _forest(fps: np.ndarray, most: int) -> list[np.ndarray]:
    """Links of one bucket as a spanning forest: breadth-first, each step against what no tree has reached yet."""
    left, out = fps, []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= most
            if near.any():
                found = left[near]
                out.append(np.stack([np.full(len(found), at), found], axis=1))
                queue.extend(found)
                left = left[~near]
    return out


def links(distinct: DataFrame, most: int = 4) -> DataFrame:
    """``src, dst``: links between distinct fingerprints (column ``fp``) of ``most`` or fewer differing bits.

    For every link of the full graph both ends are connected in the result; a bucket gives a spanning forest only.
    """
    if not 0 <= most <= MAX_DISTANCE:
        raise ValueError(f"keys are complete up to {MAX_DISTANCE} bits")

    def spread(batches):
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fps), 2000):
                part = fps[at : at + 2000]
                rows, keys = bucket_keys(part)
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(part[rows].view(np.int64))], names=["key", "fp"])

    def verify(batches):
        for rows in whole_buckets(batches):
            found = [x for left in shared_buckets(rows) for x in _forest(np.ascontiguousarray(left[:, 0]).view(np.uint64), most)]
            both = np.concatenate([np.zeros((0, 2), np.uint64), *found])
            yield pa.RecordBatch.from_arrays([pa.array(both[:, k].copy().view(np.int64)) for k in (0, 1)], names=["src", "dst"])

    keyed = distinct.select("fp").mapInArrow(tidy(spread), "key int, fp long")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(lambda bs: thin(verify(bs))), "src long, dst long")


def near_duplicates(docs: DataFrame, most: int = 4, width: int = 4) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs(doc_id, text, ...)``.

    ``component_id`` is the smallest ``doc_id`` that links reach, the own one included.  Null and empty texts have
    fingerprint zero, which links like any other.  A null ``doc_id`` takes part, but never is a component's id (which
    is null if all its rows have none).  Repeated rows each come back; an empty table gives an empty result; other
    columns are ignored.
    """
    fps = written(fingerprints(docs, width), "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    comps = connected_components(links(distinct, most))
    named = distinct.join(comps, distinct.fp == comps.node, "inner").select("fp", "component", "first_id")
    low = written(named.groupBy("component").agg(F.min("first_id").alias("component_id")), "best")
    ids = distinct.join(named.join(low, "component").select("fp", "component_id"), "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
    # both sides are tables, so that Spark can split the rows of a frequent fingerprint
    return fps.join(written(ids, "ids"), "fp").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp):
    """A signed long column as 16 lower-case hexadecimal digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


# ---------------------------------------------------------------- by similarity of shingle sets

#: Bits of 192 in which the three fingerprints of two texts of one bucket may differ to be compared by their sketches.
LOOSE_BITS = 48
#: Smallest shingle hashes of a set that are compared before the whole set is.
SKETCH = 256
#: A pair is compared by its whole sets if its sketches' similarity is at most so many standard errors too low.
SKETCH_ERRORS = 6
NO_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Shingle hashes of a block aimed at.
BLOCK_HASHES = 1 << 21


def _digest(data: bytes) -> tuple[int, int]:
    """128 bits of a set of hashes as two unsigned numbers, the first cut to 63 bits."""
    import xxhash

    digest = xxhash.xxh3_128_intdigest(data)
    return digest >> 65, digest & (1 << 64) - 1


def _mixed(h: np.ndarray) -> np.ndarray:
    """A second hash of each hash."""
    h = (h ^ np.uint64(0x1234567)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _print(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """One number for each triple of fingerprints."""
    return _mixed(a ^ _mixed(b ^ _mixed(c)))


def describe(text: str | None, width: int) -> tuple[int, int, int, np.ndarray]:
    """Three fingerprints of the distinct shingles, and their 64-bit hashes in ascending order.

    How often a shingle occurs doesn't count, as in the similarity of sets.
    """
    first = np.unique(np.concatenate([np.zeros(0, np.uint64), *map(np.unique, shingle_hashes(text, width))]))
    second = _mixed(first)
    third = _mixed(second)
    return *(_majority(_set_bits(h), len(h)) for h in (first, second, third)), np.sort(second)


def _estimated(one: np.ndarray, flat: np.ndarray, row: np.ndarray, tops: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Jaccard similarity of one sketch with others (``flat`` hashes of ``row``), below the lower of both tops."""
    top = np.minimum(tops, one[-1] if len(one) == SKETCH else NO_TOP)
    at = np.searchsorted(one, flat)
    same = (at < len(one)) & (one[np.minimum(at, len(one) - 1)] == flat) & (flat <= top[row])
    both = np.bincount(row[same], minlength=len(sizes))
    mine = np.searchsorted(one, top, side="right")
    theirs = np.bincount(row[flat <= top[row]], minlength=len(sizes))
    return both / np.maximum(1, mine + theirs - both)


def similarity(one: np.ndarray, other: np.ndarray) -> float:
    """Jaccard similarity of two sets of hashes in ascending order; of two empty sets 1."""
    if len(one) > len(other):
        one, other = other, one
    if not len(one):
        return float(not len(other))
    at = np.searchsorted(other, one)
    both = int((other[np.minimum(at, len(other) - 1)] == one).sum())
    return both / (len(one) + len(other) - both)


def _similar(docs: DataFrame, width: int, least: float, block: int) -> tuple[DataFrame, DataFrame]:
    """Rows ``doc_id, mark, d, e, ...`` with the digest of their shingle sets, and for each digest its component's
    first row: ``d, e, best(is null, doc_id, mark)``."""

    def spell(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                rows = []
                for t in part.column(2):
                    *prints, hashes = describe(t.as_py(), width)
                    rows.append((*prints, *_digest(hashes.tobytes()), len(hashes)))
                found = np.array([[x - (1 << 64) if x >> 63 else x for x in r] for r in rows], dtype=np.int64).reshape(-1, 6)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(found[:, k].copy()) for k in range(6)]], names=["doc_id", "mark", "a", "b", "c", "d", "e", "n"])

    def spread(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                for f in (0, 1, 2):
                    rows, keys = bucket_keys(part.column(f).to_numpy(zero_copy_only=False).view(np.uint64))
                    taken = part.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([pa.array((keys + (3 * f << 24)).astype(np.int32)), *taken.columns], names=["key", "a", "b", "c"])

    def loose(batches):
        for rows in whole_buckets(batches):
            out = [np.zeros((0, 6), np.uint64)]
            for left in shared_buckets(rows.view(np.uint64)):
                while len(left) > 1:
                    queue, left = [left[0]], left[1:]
                    while queue and len(left):
                        at = queue.pop()
                        near = np.bitwise_count(left ^ at).sum(axis=1) <= LOOSE_BITS
                        if near.any():
                            found = left[near]
                            out.append(np.concatenate([np.broadcast_to(at, found.shape), found], axis=1))
                            queue.extend(found)
                            left = left[~near]
            both = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(_print(*both[:, k : k + 3].T).view(np.int64)) for k in (0, 3)], names=["src", "dst"])

    def shingle(batches):
        for b in batches:
            for at in range(0, b.num_rows, 100):
                part = b.slice(at, 100)
                sets, right = [], []
                for d, t in zip(part.column(3).to_pylist(), part.column(4)):
                    hashes = describe(t.as_py(), width)[-1].tobytes()
                    sets.append(hashes)
                    right.append(_digest(hashes)[0] == d)  # not another text with the same mark
                found = pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(sets, pa.binary())], names=["component", "node", "blocks", "shingles"])
                yield found.filter(pa.array(right))

    def verify(batches):
        at, nodes, sets = None, [], []
        for b in batches:
            keys = list(zip(*[b.column(k).to_pylist() for k in range(3)]))
            for i, (key, node) in enumerate(zip(keys, b.column(3).to_pylist())):
                if key != at:
                    yield from _verified(np.array(nodes, np.int64), sets, least)
                    at, nodes, sets = key, [], []
                if nodes and nodes[-1] == node:  # a repeated row
                    continue
                nodes.append(node)
                sets.append(np.frombuffer(b.column(4)[i].as_py(), np.uint64))
        yield from _verified(np.array(nodes, np.int64), sets, least)

    def named(batches):
        for b in batches:
            found = _print(*(b.column(k).to_numpy().view(np.uint64) for k in (2, 3, 4)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found.view(np.int64))], names=["doc_id", "mark", "a", "b", "c", "d", "e", "n", "print"])

    # the mark finds a class's text again, whose complete set is needed only if the class has candidates
    texts = _marked(docs)
    prints = written(texts.mapInArrow(tidy(lambda bs: named(spell(bs))), "doc_id long, mark long, a long, b long, c long, d long, e long, n long, print long"), "prints")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "mark")
    folded = prints.groupBy("d", "e").agg(F.min(order).alias("first"), F.min("mark").alias("mark"), F.min_by(F.struct("a", "b", "c", "n", "print"), "mark").alias("of"))
    classes = written(folded.select("d", "e", "first", "mark", "of.*").withColumn("node", F.xxhash64("d", "e")), "classes")
    keyed = classes.select("a", "b", "c").distinct().mapInArrow(tidy(spread), "key int, a long, b long, c long")
    near = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(lambda bs: thin(loose(bs))), "src long, dst long")
    groups = connected_components(near).withColumnRenamed("node", "m")
    # a fingerprint without links can still have several classes
    members = classes.join(groups, classes["print"] == groups.m, "left").select(F.coalesce("component", "print").alias("component"), "node", "mark", "d", "n")
    members = written(members, "members")
    blocks = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / BLOCK_HASHES)).cast("int")
    sizes = members.groupBy("component").agg(blocks.alias("blocks"), F.count("*").alias("many")).where("many > 1")
    members = written(members.join(written(sizes, "sizes"), "component").select("component", "node", "blocks", "d", "mark"), "members")
    # only texts that the sieve lets through are shuffled
    wanted = sifted(texts.select("mark", "text"), "mark", sieve(members.select("mark")), "treeloom hit").where("`treeloom hit`").select("mark", "text")
    chosen = wanted.join(members, "mark").select("component", "node", "blocks", "d", "text")
    dealt = chosen.mapInArrow(tidy(shingle), "component long, node long, blocks int, shingles binary")
    dealt = dealt.withColumn("own", F.pmod("node", F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = ["component", "low", "high"]  # about two blocks at most
    pairs = dealt.select("component", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node", "shingles")
    links_ = pairs.repartition(*pair).sortWithinPartitions(*pair, "node").mapInArrow(tidy(lambda bs: thin(verify(bs))), "src long, dst long")
    linked = connected_components(links_).withColumnRenamed("node", "m")
    named = classes.join(linked, classes.node == linked.m).select("d", "e", "component", "first")
    low = written(named.groupBy("component").agg(F.min("first").alias("best")), "best")
    labels = named.join(low, "component").select("d", "e", "best")
    return prints, written(classes.join(labels, ["d", "e"], "left").select("d", "e", F.coalesce("best", "first").alias("best")), "labels")


def _marked(docs: DataFrame) -> DataFrame:
    """``doc_id, mark, text``: the mark is the same for rows of one id and text only."""
    return only(docs, "doc_id", "text").select("doc_id", F.xxhash64("doc_id", "text").alias("mark"), "text")


def similar_documents(docs: DataFrame, width: int = 5, least: float = 0.8, block: int = 2048) -> DataFrame:
    """``doc_id, component_id``: documents linked by a similarity of ``least`` or more of their sets of shingles.

    Candidates share a Golay bucket of one of three fingerprints and differ in few of all 192 bits; what they connect is
    compared again by the complete sets of shingle hashes, block against block, and only those links count.  Sketches
    of the sets only spare comparisons of pairs far below ``least``.
    Documents with equal sets (by a digest of 128 bits) are one class from the start; classes with equal fingerprints
    are candidates like others.  Nulls, empty texts, repeated rows and further columns are treated as by
    ``near_duplicates``.
    """
    prints, labels = _similar(docs, width, least, block)
    return prints.select("doc_id", "d", "e").join(labels, ["d", "e"]).select("doc_id", F.col("best.doc_id").alias("component_id"))


def _verified(nodes: np.ndarray, sets: list[np.ndarray], least: float):
    """Spanning forest of the links of one pair of blocks: sketches choose, complete sets decide."""
    sketches = [x[:SKETCH] for x in sets]
    enough = least - SKETCH_ERRORS * (max(0.0, least * (1 - least)) / SKETCH) ** 0.5
    left = np.arange(len(nodes))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            sizes = np.array([len(sketches[i]) for i in left])
            flat = np.concatenate([sketches[i] for i in left])
            row = np.repeat(np.arange(len(left)), sizes)
            tops = np.array([sketches[i][-1] if len(sketches[i]) == SKETCH else NO_TOP for i in left], dtype=np.uint64)
            if len(sketches[at]):
                alike = _estimated(sketches[at], flat, row, tops, sizes)
                whole = (len(sketches[at]) < SKETCH) & (sizes < SKETCH)  # the sketches are the sets
                near = alike >= np.where(whole, least, enough)
                for i in np.flatnonzero(near & ~whole):
                    near[i] = similarity(sets[at], sets[left[i]]) >= least
            else:
                near = sizes == 0
            if near.any():
                found = left[near]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), nodes[at])), pa.array(nodes[found])], names=["src", "dst"])
                queue.extend(found.tolist())
                left = left[~near]


def keep_first(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """Rows of ``docs`` without near-duplicates: of each group of similar documents one row stays, whole.

    It is a row with the group's smallest id; of several texts with that id, that of the smallest hash; of equal rows
    one.  A null id comes after all others.  Rows are chosen by their class, so rows of one id can stay and go apart.
    Null and empty texts are one group; no rows give none; further columns, whatever their names, come back.
    """
    prints, labels = _similar(docs, width, least, 2048)
    stay = labels.select(F.col("best.doc_id").alias("treeloom id"), F.col("best.mark").alias("treeloom mark")).distinct()
    # rows that are alone need no shuffle: only marks that go, or that several rows have, are looked at exactly
    gone = prints.join(labels, ["d", "e"]).where((F.col("mark") != F.col("best.mark")) | ~F.col("doc_id").eqNullSafe(F.col("best.doc_id"))).select("mark")
    many = prints.groupBy("mark").agg(F.count("*").alias("rows")).where("rows > 1").select("mark")
    unsure = written(gone.union(many).distinct(), "unsure")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    mark = F.xxhash64("doc_id", "text")
    rows = sifted(docs.withColumn("treeloom mark", mark), "treeloom mark", sieve(unsure), "treeloom hit")
    clear = rows.where("NOT `treeloom hit`").select(*columns)
    found = rows.where("`treeloom hit`").join(stay.withColumnRenamed("treeloom mark", "m"), (F.col("`treeloom mark`") == F.col("m")) & F.col("doc_id").eqNullSafe(F.col("`treeloom id`")), "left_semi")
    equal = Window.partitionBy("treeloom mark", "doc_id").orderBy(F.xxhash64(*[c for c, kind in docs.dtypes if "map<" not in kind]))
    first = found.withColumn("treeloom rank", F.row_number().over(equal)).where("`treeloom rank` = 1")
    return clear.unionByName(first.select(*columns))
