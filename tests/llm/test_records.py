"""Operators on vectors, pages and conversations on small tables, against brute force."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from treeloom.llm import lattice, neighbours, preferences, warc

V = "vec_id long, embedding array<float>, label int, score string, rank string, n string, v string"


def vectors(seed=0, n=300, dims=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)).astype(np.float32)
    for i in range(0, 60, 2):  # near copies
        x[i + 1] = x[i] + rng.normal(size=dims).astype(np.float32) * 0.02
    x[100:130] = x[100]  # exact copies
    x[140:180] = x[140] + (rng.normal(size=(40, dims)) * 0.01).astype(np.float32)  # a dense group
    rows = [(i, [float(a) for a in x[i]], int(i // 2 % 3 if i < 100 else 1), "a", "b", "c", "d") for i in range(n)]
    bad = [None, [], [0.0] * dims, [float("nan")] * dims, [None] + [1.0] * (dims - 1), [float("inf")] + [1.0] * (dims - 1), [1.0, 2.0]]
    rows += [(1000 + k, v, 1, "a", "b", "c", "d") for k, v in enumerate(bad)]
    rows += [(None, rows[0][1], 0, "a", "b", "c", "d"), (1010, rows[0][1], None, "a", "b", "c", "d"), rows[3]]
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(vectors(), V).repartition(3).cache()


# ---------------------------------------------------------------- 4


def test_nearest(spark, table):
    settings = neighbours.Settings(leaf=16, least=100, block=40, bucket=64)
    got = neighbours.nearest(table, table.where("vec_id % 20 = 0"), 10, settings).collect()
    good = {r[0]: np.array(r[1], dtype=float) for r in vectors() if r[0] is not None and (r[0] < 1000 or r[0] == 1010)}
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: r.rank):
        by[r.query_id].append(r)
    assert set(by) == {i for i in good if i % 20 == 0}
    hits = 0
    for q, found in by.items():
        assert [r.rank for r in found] == list(range(1, 11))
        d = {i: math.sqrt(((v - good[q]) ** 2).sum()) for i, v in good.items() if i != q}
        assert all(r.score == pytest.approx(d[r.vec_id], abs=1e-12) for r in found)
        assert [(r.score, r.vec_id) for r in found] == sorted((r.score, r.vec_id) for r in found)
        hits += len({r.vec_id for r in found} & set(sorted(d, key=lambda i: (d[i], i))[:10]))
    assert hits / (10 * len(by)) >= 0.9
    assert neighbours.nearest(table.limit(0), table).count() == 0
    assert neighbours.nearest(table, table.limit(0)).count() == 0
    few = table.where("vec_id IN (0, 1, 2)")
    assert neighbours.nearest(few, few.where("vec_id = 0"), 10).count() == 2


def test_repeated_rows_take_one_place(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 8))
    rows = [(i, [float(a) for a in x[i] + 0.001 * (c % 3)]) for i in range(40) for c in range(30)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    everything = neighbours.Settings(leaf=2000, recall=1.0, block=400, bucket=1000)  # blocks of many ids
    got = defaultdict(list)
    for r in sorted(neighbours.nearest(frame, spark.createDataFrame([(i, x[i].tolist()) for i in range(6)], "vec_id long, embedding array<double>"), 5, everything).collect(), key=lambda r: r.rank):
        got[r.query_id].append(r)
    for i in range(6):
        d = {j: min(math.sqrt(((x[j] + 0.001 * c - x[i]) ** 2).sum()) for c in range(3)) for j in range(40) if j != i}
        assert [r.vec_id for r in got[i]] == sorted(d, key=lambda j: (d[j], j))[:5]
        assert all(r.score == pytest.approx(d[r.vec_id], abs=1e-12) for r in got[i])


def test_queue_goes_by_margin():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 8))
    trees = [neighbours.fit_tree(x, 20, rng) for _ in range(2)]
    sizes = [np.bincount(t.leaf_of(x), minlength=t.leaves) for t in trees]
    found = neighbours.search_leaves(x[3], trees, sizes, float("inf"))
    margins = [neighbours.leaf_margins(t, x[3]) for t in trees]
    order = [margins[t][leaf] for t, leaf in found]
    assert order == pytest.approx(sorted(order)) and len(neighbours.search_leaves(x[3], trees, sizes, order[10])) >= 11
    assert len(found) == len(set(found)) == sum(t.leaves for t in trees)
    assert set(found[:2]) >= {(0, int(trees[0].leaf_of(x[3:4])[0]))} or (1, int(trees[1].leaf_of(x[3:4])[0])) in found[:2]
    same = neighbours.fit_tree(np.ones((200, 4)), 16, rng)
    assert same.leaves == 1 and (same.leaf_of(np.ones((3, 4))) == 0).all()


def test_clusters_need_few_leaves():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(60, 32))
    x = centres[rng.integers(0, 60, 8000)] + 0.15 * rng.normal(size=(8000, 32))
    s, ids = neighbours.Settings(sample=3000, leaf=32, least=100), np.arange(8000)
    some = rng.choice(8000, 3000, replace=False)
    trees = [neighbours.fit_tree(x[some], s.leaf, rng) for _ in range(s.trees)]
    share = neighbours.calibrate(x[some], ids[some], trees, 10, s, rng)
    leaves = [t.leaf_of(x) for t in trees]
    sizes = [np.bincount(leaf, minlength=t.leaves) for t, leaf in zip(trees, leaves)]
    hits = seen = 0
    for i in range(0, 8000, 100):
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        in_sample = np.sort(d[some])[9]
        met = np.zeros(8000, bool)
        for t, leaf in neighbours.search_leaves(x[i], trees, sizes, share * in_sample, s.least):
            met |= leaves[t] == leaf
        hits += met[np.argsort(d)[:10]].sum()
        seen += met.sum()
    assert hits / 800 >= 0.9 and seen / (80 * 8000) <= 0.3


# ---------------------------------------------------------------- 8


def test_e8_points_are_nearest():
    rng = np.random.default_rng(2)
    y = rng.normal(size=(200, 8)) * 2
    home, roots = lattice.nearest_e8(y), lattice._roots()
    assert roots.shape == (240, 8) and np.allclose((roots**2).sum(axis=1), 2)
    best = ((y - home) ** 2).sum(axis=1)
    for r in roots:
        assert (best <= ((y - home - r) ** 2).sum(axis=1) + 1e-12).all()
    twice = np.rint(2 * home).astype(int)
    assert ((twice % 2 == twice[:, :1] % 2).all()) and (home.sum(axis=1) % 2 == 0).all()


def test_lattice_keys_find_pairs():
    rng, s, n = np.random.default_rng(3), lattice.Settings(), 3000
    tables, planes = lattice._directions(64, s)
    a = rng.normal(size=(n, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    zero = np.zeros(n, np.uint64)
    for cosine in (0.98, 0.985, 0.99):
        r = rng.normal(size=(n, 64))
        r -= (r * a).sum(axis=1, keepdims=True) * a
        b = cosine * a + math.sqrt(1 - cosine**2) * r / np.linalg.norm(r, axis=1, keepdims=True)
        met = np.zeros(n, bool)
        for t in tables:
            one, two = (lattice.keys_of(x, zero, t, s) for x in (a, b))
            met |= (one[:, :, None] == two[:, None, :]).any(axis=(1, 2))
        alike = ((a @ planes > 0) != (b @ planes > 0)).sum(axis=1) <= s.bits
        assert met.mean() >= 0.999 and alike.mean() >= 0.999


def test_spanning_links_connect():
    rng = np.random.default_rng(5)
    for _ in range(20):
        near = rng.random((12, 9)) < 0.12
        a, b = np.arange(12), np.arange(100, 109)
        found = lattice._spanning(near, a, b)

        def parts(links):
            groups = []
            for u, v in links:
                hit = [g for g in groups if u in g or v in g]
                groups = [g for g in groups if g not in hit] + [set().union({u, v}, *hit)]
            return sorted(map(sorted, groups))

        links = [(int(a[i]), int(b[j])) for i, j in zip(*np.nonzero(near))]
        few = [tuple(map(int, r)) for r in np.concatenate([np.zeros((0, 2), int), *found])]
        assert parts(few) == parts(links) and {tuple(sorted(x)) for x in few} <= set(links)


def test_lattice_links(table):
    rows = vectors()
    got = lattice.near_duplicates(table, 0.98, lattice.Settings(block=16)).collect()
    dealt = lattice.near_duplicates(table, 0.98, lattice.Settings(block=500)).collect()
    assert Counter(map(tuple, dealt)) == Counter(map(tuple, got))
    ok = [k for k, r in enumerate(rows) if r[0] is not None and r[2] is not None and (r[0] < 1000)]
    x = np.array([rows[k][1] for k in ok])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([rows[k][2] for k in ok])
    near = (x @ x.T >= 0.98) & (label[:, None] == label[None, :])
    for i in range(len(ok)):  # exact copies always link
        near[i] |= np.array([rows[k][1] == rows[ok[i]][1] for k in ok]) & (label == label[i])
    np.fill_diagonal(near, True)
    ids = np.array([rows[k][0] for k in ok])
    comp = ids.copy()
    while True:
        low = np.where(near, comp[None, :], 10**9).min(axis=1)
        if (low == comp).all():
            break
        comp = low
    want = Counter(zip(ids.tolist(), (near.sum(axis=1) - 1).tolist(), comp.tolist()))
    want += Counter((r[0], 0, r[0]) for k, r in enumerate(rows) if k not in ok)
    assert Counter(map(tuple, got)) == want
    assert lattice.near_duplicates(table.limit(0)).count() == 0


# ---------------------------------------------------------------- 9


def pages():
    long = "<p>" + "x" * 1200 + "</p>"
    rows = [(i, f"http://h/{i}", long if i % 3 == 0 else f"<p>{i}</p>", "clash") for i in range(60)]
    rows += [(100, None, None, "a"), (101, "http://h/\r\nX: y", "", "a"), (102, "u", "é" * 600, "a"), (103, "u", "é" * 600, "a"), (None, "u", long, "a"), (57, "again", long, "a"), (104, "u", "\r\n\r\n" * 400_000, "a")]
    return rows


def test_archives(spark, tmp_path):
    table = spark.createDataFrame(pages(), "page_id long, url string, html string, digest string").repartition(3)
    folder = f"file://{tmp_path}/w"
    got = warc.read_archives(warc.write_archives(table, folder), folder).collect()
    want = Counter()
    for page_id, _, html, _ in pages():
        data = (html or "").encode()
        same = [p for p, _, h, _ in pages() if h == html and p is not None]
        first = max(same) if len(data) >= 1000 and same else page_id
        revisit = first != page_id
        want[page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    r = next(r for r in got if r.page_id == 102 or r.page_id == 103)
    head, _ = warc.Bundle(folder, r.bundle).record(r.record)
    assert head["X-Page-Id"] == str(r.page_id)
    for r in got:  # by identifier: a frame and an offset
        bundle, name = warc.Bundle(folder, r.bundle), warc.record_uuid(r.page_id, r.payload_digest)
        head, _ = bundle.find(name)
        assert head["WARC-Record-ID"] == f"<urn:uuid:{name}>" and head.get("X-Page-Id") == (None if r.page_id is None else str(r.page_id))
        if r.record_type == "revisit":
            assert head["WARC-Refers-To"] == warc.record_id(r.refers_to, r.payload_digest)
    assert bundle.find(warc.record_uuid(-5, "0")) is None
    empty = f"file://{tmp_path}/e"
    assert warc.read_archives(warc.write_archives(table.limit(0), empty), empty).count() == 0


def test_archives_with_a_crowded_sieve(spark, tmp_path, monkeypatch):
    from treeloom.llm import _shared

    table = spark.createDataFrame(pages(), "page_id long, url string, html string, digest string").repartition(3)
    rows = lambda found: Counter((r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in found.collect())
    want = rows(warc.read_archives(warc.write_archives(table, f"file://{tmp_path}/w"), f"file://{tmp_path}/w"))
    monkeypatch.setattr(_shared, "SIEVE_BITS", 8)  # nearly all rows pass it by chance
    bundles = warc.write_archives(table, f"file://{tmp_path}/x", bundle_bytes=3000)
    assert rows(warc.read_archives(bundles, f"file://{tmp_path}/x")) == want and bundles.count() > 10


def test_bundles_are_plain_zstandard(tmp_path, monkeypatch):
    import zstandard

    monkeypatch.setattr(warc, "FRAME_BYTES", 500)
    records = [warc.build_record(i, "u", b"abc" * i, hashlib.sha1(b"abc" * i).digest(), 3 * i, None) for i in range(50)]
    names = [warc.record_uuid(i, hashlib.sha1(b"abc" * i).hexdigest()) for i in range(50)]
    done = warc.write_bundle(str(tmp_path), "b.warc.zst", zip(names, records))
    bundle = warc.Bundle(str(tmp_path), done["name"])
    assert len(bundle.frames) > 5 and bundle.record(33)[0]["X-Page-Id"] == "33" and len(list(bundle)) == 50
    assert bundle.find(names[44])[0]["X-Page-Id"] == "44"
    with open(tmp_path / done["name"], "rb") as f:
        assert zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read() == b"".join(records)


# ---------------------------------------------------------------- 3


def test_preferences(spark):
    schema = "pair_id long, turn long, role string, text string, a string, n string"
    a = [(1, 0, "user", "hi"), (1, 1, "assistant", "good"), (2, 0, "user", "q"), (2, 1, "assistant", "same"), (3, 0, None, None), (3, 1, "assistant", "é"), (None, 0, "user", "x"), (4, 0, "user", "alone")]
    b = [(1, 0, "user", "hi"), (1, 1, "assistant", "bad"), (1, 2, "user", "why"), (1, 3, "assistant", "so"), (2, 0, "user", "q"), (2, 1, "assistant", "same"), (3, 0, "user", ""), (None, 0, "user", "x")]
    frame = lambda rows: spark.createDataFrame([(*r, "x", "y") for r in rows], schema)
    got = {r.pair_id: r for r in preferences.format_preferences(frame(a), frame(b)).collect()}
    assert set(got) == {1, 2, 3}
    one = got[1]
    assert one.n_common == 1 and one.prompt == "<|user|>\nhi<|end|>\n" and one.chosen == "<|assistant|>\ngood<|end|>\n"
    assert [one.chosen[s.start : s.stop] for s in one.chosen_spans] == ["good<|end|>\n"]
    assert [one.rejected[s.start : s.stop] for s in one.rejected_spans] == ["bad<|end|>\n", "so<|end|>\n"]
    assert (got[2].n_common, got[2].chosen, got[2].rejected, got[2].chosen_spans) == (2, "", "", [])
    assert (got[3].n_common, got[3].rejected) == (1, "") and got[3].chosen.endswith("é<|end|>\n")
    assert preferences.format_preferences(frame(a).limit(0), frame(b)).count() == 0


def test_stale_answers(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "first"), (1, 2, "user", "r"), (1, 3, "assistant", "second"), (1, 4, "user", "late"), (2, 0, "user", "none"), (3, 0, "assistant", "only")]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.pair_id: r for r in preferences.format_preferences(*preferences.stale_answers(c)).collect()}
    assert set(got) == {1, 3} and got[1].n_common == 3 and "second" in got[1].chosen and "first" in got[1].rejected
    assert got[3].rejected == "<|assistant|>\n<|end|>\n"


def test_null_turns_come_first(spark):
    rows = [(1, None, "user", "q"), (1, 0, "assistant", "first"), (1, 1, "user", "late"), (2, None, "user", "z"), (2, None, "assistant", "only")]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.pair_id: r for r in preferences.format_preferences(*preferences.stale_answers(c)).collect()}
    assert set(got) == {1, 2}
    assert got[1].prompt == "<|user|>\nq<|end|>\n" and got[1].chosen == "<|assistant|>\nfirst<|end|>\n" and got[1].rejected == "<|assistant|>\n<|end|>\n"
    assert "only" in got[2].prompt + got[2].chosen and "only" not in got[2].rejected
