"""Operators of the tree models on small samples, against plain Python."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeloom.functions import add_maps, concat_array_maps, divide_maps, multiply_maps, truncate_at
from treeloom.operators import graph, inference, info, mixture, mst, resample, reshape, score, tree
from treeloom.operators import counts
from treeloom.operators.counts import _blocked, counts1, counts2
from treeloom.plans import answer, learn_tree, to_dot
from treeloom.sources import generate_samples, read_adjacency, read_edge_list, read_observations, read_variables

RNG = np.random.default_rng(4)
SAMPLES = [[float(a), float(a ^ (RNG.random() < 0.2)), float(RNG.integers(3)), float(a & (RNG.random() < 0.7))] for a in RNG.integers(0, 2, 200)]


@pytest.fixture(scope="module")
def obs(spark):
    return spark.createDataFrame([(i, x) for i, x in enumerate(SAMPLES)], "obs_id long, xs array<double>")


def plain_mi(i, j):
    n = len(SAMPLES)
    both, a, b = Counter((s[i], s[j]) for s in SAMPLES), Counter(s[i] for s in SAMPLES), Counter(s[j] for s in SAMPLES)
    return sum(c / n * math.log2(c * n / (a[x] * b[y])) for (x, y), c in both.items())


def test_mutual_information(obs):
    rows = info.mutual_information(counts1(obs), counts2(obs), full=True).collect()
    assert len(rows) == 12
    for r in rows:
        assert r.mi == pytest.approx(plain_mi(r.src, r.dst), abs=1e-9)
    cut = info.mutual_information(counts1(obs), counts2(obs), precision=8).collect()
    assert all(abs(r.mi - plain_mi(r.src, r.dst)) < 3e-8 for r in cut)


def test_unit_weights_and_blocked_counts_agree(obs):
    keys = ["src", "dst", "x", "y"]
    plain = {tuple(r[k] for k in keys): r.n for r in counts2(obs).collect()}
    unit = {tuple(r[k] for k in keys): r.n for r in counts2(obs.withColumn("w", F.lit(1.0))).collect()}
    block = {tuple(r[k] for k in keys): r.n for r in _blocked(obs, [], 4).collect()}
    assert plain == unit == block


def test_zero_weights_fall_away(obs):
    half = obs.withColumn("w", F.when(F.col("obs_id") < 100, 1.0).otherwise(0.0))
    got = {r["var"]: r.h for r in info.entropy(counts1(half)).collect()}
    want = {r["var"]: r.h for r in info.entropy(counts1(obs.where("obs_id < 100"))).collect()}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("method", ["kruskal", "prim", "boruvka", "ghs", "auto"])
def test_spanning_trees(spark, method):
    rng = np.random.default_rng(1)
    edges = [(i, j, float(rng.integers(6))) for i in range(9) for j in range(i + 1, 9)]
    found = {(r.src, r.dst) for r in mst.mst(spark.createDataFrame(edges, "src long, dst long, weight double"), method).collect()}
    parent = list(range(9))

    def top(v):
        while parent[v] != v:
            v = parent[v]
        return v

    want = set()
    for i, j, _ in sorted(edges, key=lambda e: (e[2], e[0], e[1])):
        if top(i) != top(j):
            parent[top(i)] = top(j)
            want.add((i, j))
    assert found == want


def test_forest_and_no_edges(spark):
    schema = "src long, dst long, weight double"
    two = spark.createDataFrame([(0, 1, 1.0), (2, 3, 1.0), (3, 2, 0.5), (4, 4, 0.0)], schema)
    for method in ("kruskal", "boruvka"):
        assert {(r.src, r.dst, r.weight) for r in mst.mst(two, method).collect()} == {(0, 1, 1.0), (2, 3, 0.5)}
        assert mst.mst(two.limit(0), method).count() == 0


def test_tables_sum_to_one_and_belief_is_exact(spark, obs):
    model = learn_tree(obs, method="kruskal")
    sums = model.cpt.groupBy("var", "parent_x").agg(F.sum("p").alias("s")).collect()
    assert all(r.s == pytest.approx(1) for r in sums)
    m = inference.load(model.tree, model.cpt)[None]
    domains = [m.values[v] for v in range(4)]

    def joint(x):
        p = 1.0
        for v in range(4):
            at = int(np.searchsorted(domains[v], x[v]))
            up = m.parent[v]
            p *= m.tables[v][at, 0 if up is None else int(np.searchsorted(domains[up], x[up]))]
        return p

    states = {x: joint(x) for x in itertools.product(*domains)}
    for seen in ({}, {1: 1.0}, {0: 0.0, 2: 2.0}):
        rows = [(7, v, x) for v, x in seen.items()] or [(7, None, None)]
        got = answer(model, spark.createDataFrame(rows, "case_id long, var long, x double")).collect()
        kept = {x: p for x, p in states.items() if all(x[v] == y for v, y in seen.items())}
        total = sum(kept.values())
        for r in got:
            assert r.p == pytest.approx(sum(p for x, p in kept.items() if x[r["var"]] == r.x) / total, abs=1e-12)
    ll = inference.log_likelihood({None: m}, obs, len(SAMPLES)).collect()
    assert all(r.ll == pytest.approx(math.log2(states[tuple(SAMPLES[r.obs_id])])) for r in ll)


def test_likelihood_does_not_depend_on_the_root(obs):
    totals = []
    for root in (0, 3):
        model = learn_tree(obs, method="prim", root=root)
        totals.append(inference.log_likelihood(inference.load(model.tree, model.cpt), obs, 200).agg(F.sum("ll")).first()[0])
    assert totals[0] == pytest.approx(totals[1])


def test_impossible_evidence_is_null(spark, obs):
    model = learn_tree(obs, method="kruskal")
    rows = answer(model, spark.createDataFrame([(0, 2, 9.0)], "case_id long, var long, x double")).collect()
    assert rows and all(r.p is None for r in rows)


def test_resampling(spark, obs):
    index = resample.bootstrap_index(spark, 200, 1)
    assert index.agg(F.min("obs_id"), F.max("obs_id")).first()[1] < 200
    assert index.exceptAll(resample.bootstrap_index(spark, 200, 1)).count() == 0
    drawn = resample.bootstrap_weights(obs, 200, [1, 2])
    assert drawn.agg(F.sum("w0"), F.sum("w1")).first()[:] == (200.0, 200.0)
    sizes = [r["count"] for r in resample.folds(obs, 3).groupBy("fold").count().collect()]
    assert sum(sizes) == 200 and max(sizes) - min(sizes) <= 1
    prefix = resample.train_test_split(obs, 0.6, mode="prefix", n=200)
    assert prefix.where("part = 'train'").agg(F.max("obs_id")).first()[0] == 119
    mean = spark.range(20000).select(F.avg(resample.poisson_weight(F.col("id"), 3))).first()[0]
    assert mean == pytest.approx(1, abs=0.05)


@pytest.mark.parametrize("n", [500, 5000, 50000])
def test_draws_are_random(spark, n):
    from treeloom.functions import hash_uniform

    seeds = [0, 1, 7]
    counts_ = []
    for seed in seeds:
        drawn = spark.range(n).select(F.floor(hash_uniform(F.col("id"), seed) * n).alias("i")).groupBy("i").count().collect()
        c = np.zeros(n)
        for r in drawn:
            c[r.i] = r["count"]
        counts_.append(c)
        assert (c == 0).mean() == pytest.approx(math.exp(-1), abs=0.05 if n < 1000 else 0.02)
        assert c.var() == pytest.approx(1, abs=0.25 if n < 1000 else 0.1)
        assert c.max() >= 4
    for a in range(3):
        for b in range(a):
            # at every shift, by the Fourier transform
            x, y = (np.fft.rfft(c - c.mean()) for c in (counts_[a], counts_[b]))
            assert np.abs(np.fft.irfft(x * y.conj(), n)).max() / n <= 6 / math.sqrt(n)


def test_poisson_weights_are_poisson(spark):
    got = Counter(r.w for r in spark.range(20000).select(resample.poisson_weight(F.col("id"), 3).alias("w")).collect())
    for k in range(5):
        assert got[float(k)] / 20000 == pytest.approx(math.exp(-1) / math.factorial(k), abs=0.015)


def test_resampled_values_are_the_observations(spark, obs):
    index = resample.resample_index(spark, 200, 4, 5)
    got = resample.resample(reshape.tidy(obs), index).collect()
    at = {(r["var"], r.draw): r.obs_id for r in index.collect()}
    assert len(got) == 800 and all(r.x == SAMPLES[at[r["var"], r.draw]][r["var"]] for r in got)
    assert len({tuple(at[v, d] for d in range(200)) for v in range(4)}) == 4


def test_ragged_and_null_values(spark, monkeypatch):
    rows = [(0, None), (1, [0.0, 1.0]), (2, [1.0, 1.0, 0.0]), (3, [None, 1.0, 1.0]), (4, []), (5, [1.0, 0.0, 0.0, 1.0])]
    table = spark.createDataFrame(rows, "obs_id long, xs array<double>")
    one, two = Counter(), Counter()
    for _, xs in rows:
        have = [(v, x) for v, x in enumerate(xs or []) if x is not None]
        one.update(have)
        two.update((a, b, x, y) for (a, x), (b, y) in itertools.combinations(have, 2))
    assert {(r["var"], r.x): r.n for r in counts1(table).collect()} == one
    keys = ["src", "dst", "x", "y"]
    for explode, strip in ((40, 64), (1, 64), (1, 2)):
        monkeypatch.setattr(counts, "EXPLODE_UP_TO", explode)
        monkeypatch.setattr(counts, "STRIP", strip)
        assert {tuple(r[k] for k in keys): r.n for r in counts2(table).collect()} == two
    assert counts2(table.limit(0)).count() == counts1(table.limit(0)).count() == 0


def test_more_text_formats(spark, tmp_path):
    from treeloom.sources import line_count, numbered_lines, read_densities, read_indexed_densities, read_indexed_observations, to_int_list

    (tmp_path / "i").write_text("7,0 1 2\n3, 1 1 1\n")
    assert {r.obs_id: r.xs for r in read_indexed_observations(spark, f"file://{tmp_path}/i").collect()} == {7: [0, 1, 2], 3: [1, 1, 1]}
    (tmp_path / "d").write_text("0.5\n0.25\n")
    assert {r.obs_id: r.p for r in read_densities(spark, f"file://{tmp_path}/d").collect()} == {0: 0.5, 1: 0.25}
    (tmp_path / "e").write_text("4,0.5\n")
    assert [tuple(r) for r in read_indexed_densities(spark, f"file://{tmp_path}/e").collect()] == [(4, 0.5)]
    lines = spark.read.text(f"file://{tmp_path}/d").select("value")
    assert sorted(r.line for r in numbered_lines(lines).collect()) == ["0,0.5", "1,0.25"] and line_count(spark, f"file://{tmp_path}/d") == 2
    assert spark.range(1).select(to_int_list(F.array(F.lit("3"), F.lit("4")))).first()[0] == [3, 4]


def test_matrix_and_subgraph(obs):
    edges = graph.mi_edges(obs)
    back = graph.from_matrix(graph.matrix(edges, 4))
    assert {(r.src, r.dst): r.weight for r in back.collect()} == pytest.approx({(r.src, r.dst): r.weight for r in edges.collect()})
    assert reshape.edge_subgraph(edges, edges.where("src = 0")).count() == 3


def test_matrix_rounds_as_its_sql(spark, tmp_path):
    """Weights that are halves at 8 digits: -0.28944499857 and -0.00056500388, which DuckDB writes -0.28945 and -0.00056."""
    import duckdb

    from treeloom import queries

    columns = []
    for both, first, second, neither in ((2, 26, 36, 16), (1, 8, 10, 61)):
        columns += [[1] * (both + first) + [-1] * (second + neither), [1] * both + [-1] * first + [1] * second + [-1] * neither]
    rows = [(i, [float(c[i]) for c in columns] + [-1.0] * 60) for i in range(80)]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    con.execute(f"COPY embeddings TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)")
    wanted = dict(con.execute(queries.oracle_sql()["mi_matrix"]).fetchall())
    assert wanted[0].split()[1] == "-0.28945" and wanted[2].split()[3] == "-0.00056"
    assert {r.src: r.line for r in queries.mi_matrix(spark, str(tmp_path)).collect()} == wanted


def test_mixture_of_one_tree_is_the_tree(spark, obs):
    model = learn_tree(obs, method="kruskal")
    seen = spark.createDataFrame([(0, 0, 1.0)], "case_id long, var long, x double")
    beliefs = answer(model, seen)
    mixed = mixture.mixture_belief(beliefs.withColumn("tree_id", F.lit(0)))
    assert mixed.exceptAll(beliefs.select(*mixed.columns)).count() == 0


def test_em_does_not_lose_likelihood(spark, obs):
    start = resample.folds(obs.select("obs_id"), 2, 1)
    trees, cpt, mu, history = mixture.fit_em(obs, 2, 200, start, max_iter=4, tol=0)
    assert sum(mu.values()) == pytest.approx(1)
    assert all(b >= a - 1e-6 for a, b in zip(history, history[1:]))


def test_text_formats(spark, tmp_path):
    (tmp_path / "v").write_text("0,0 1 1\n1, 1 0 1\n10,1 1 0\n")
    assert {r["var"]: r.xs for r in read_variables(spark, f"file://{tmp_path}/v").collect()} == {0: [0, 1, 1], 1: [1, 0, 1], 10: [1, 1, 0]}
    (tmp_path / "o").write_text("0; 1; 2\n3; 4; 5\n")
    assert [(r.obs_id, r.xs) for r in read_observations(spark, f"file://{tmp_path}/o").orderBy("obs_id").collect()] == [(0, [0, 1, 2]), (1, [3, 4, 5])]
    (tmp_path / "a").write_text("0 1:0.5,2:-1\n1 0:0.5\n2 0:-1\n")
    assert {tuple(r) for r in read_adjacency(spark, f"file://{tmp_path}/a").collect()} == {(0, 1, 0.5), (0, 2, -1.0)}
    (tmp_path / "g").write_text("A F 2\nA B 3.5\n")
    assert {tuple(r) for r in read_edge_list(spark, f"file://{tmp_path}/g").collect()} == {("A", "F", 2.0), ("A", "B", 3.5)}


def test_generators_and_reshaping(spark, obs):
    made = generate_samples(spark, 3, 50, 0, 4, seed=2).collect()
    assert all(len(r.xs) == 50 and set(r.xs) <= {0.0, 1.0, 2.0, 3.0, 4.0} for r in made)
    back = reshape.by_observation(reshape.by_variable(obs)).orderBy("obs_id").collect()
    assert [r.xs for r in back] == SAMPLES
    assert to_dot(graph.mi_edges(obs)).count() == 6


def test_maps_and_truncation(spark):
    row = spark.range(1).select(
        add_maps(F.expr("map(1, 2.0D, 3, 1.0D)"), F.expr("map(1, 5.0D, 9, 1.0D)")).alias("a"),
        divide_maps(F.expr("map(1, 2.0D)"), F.expr("map(1, 5.0D)")).alias("d"),
        multiply_maps(F.expr("map(1, 2.0D)"), F.expr("map(1, 5.0D)")).alias("m"),
        concat_array_maps(F.expr("map(1, array(1))"), F.expr("map(1, array(2), 2, array(3))")).alias("c"),
        truncate_at(F.lit(-0.123456789), 8).alias("t"),
    ).first()
    assert row.a == {1: 7.0, 3: 1.0} and row.d == {1: 2.5} and row.m == {1: 10.0} and row.c == {1: [1, 2], 2: [3]}
    assert row.t == pytest.approx(-0.12345679)


def test_timings_of_generated_samples(spark):
    from treeloom.plans import time_methods, time_mixtures

    rows = time_methods(spark, [6, 70], ["kruskal", "prim"], samples=60, repeat=1).collect()
    found = {(r.variables, r.method): r for r in rows}
    for v in (6, 70):
        assert found[v, "information"].edges == v * (v - 1) // 2
        assert found[v, "kruskal"].edges == found[v, "prim"].edges == v - 1
        assert found[v, "kruskal"].weight == pytest.approx(found[v, "prim"].weight) and found[v, "prim"].seconds > 0
    assert {(r.variables, r.method) for r in time_mixtures(spark, [5], trees=2, samples=40, repeat=1).collect()} == {(5, "kruskal"), (5, "prim")}


def test_divergence_of_itself_is_zero(obs):
    p = info.pmf(counts1(obs))
    assert all(abs(r.kl) < 1e-12 for r in score.divergence(p, p).collect())
    assert tree.node_state(learn_tree(obs).tree).where("state = 'root'").count() == 1


def test_streamed_counts(spark, obs, tmp_path):
    from treeloom.streaming import count_stream, fold_counts

    obs.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    count_stream(stream, f"{tmp_path}/out", f"{tmp_path}/ck", 4).awaitTermination()
    c1, c2 = fold_counts(spark, f"{tmp_path}/out")
    assert c1.exceptAll(counts1(obs).select(*c1.columns)).count() == 0
    assert c2.exceptAll(counts2(obs).select(*c2.columns)).count() == 0
