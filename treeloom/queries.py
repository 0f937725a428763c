"""Registered queries of the tree-model operators, each over whole tables, with its DuckDB oracle.

Samples: ``E`` - signs of all 64 components of ``embeddings``; ``L`` - six codes of ``lineitem``, weighted by quantity;
``O`` - three codes of ``orders``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import graph, info, inference, mixture, mst, resample, reshape, score, tree
from .operators.counts import counts1, counts2
from .plans.lifecycle import compare_methods, kl_by_trees, learn_tree, time_mixtures
from .functions import concat_array_maps
from .sources import (
    embedding_signs,
    line_count,
    lineitem_codes,
    log_density_lines,
    numbered_lines,
    order_codes,
    read_adjacency,
    read_densities,
    read_edge_list,
    read_indexed_densities,
    read_indexed_observations,
    read_observations,
    read_variables,
    repeat_columns,
    repeat_rows,
    to_adjacency,
    write_lines,
)
from .storage import reachable, saved

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _e(spark, sf_dir) -> DataFrame:
    return embedding_signs(_table(spark, sf_dir, "embeddings"))


def _l(spark, sf_dir, weighted=False) -> DataFrame:
    obs = lineitem_codes(_table(spark, sf_dir, "lineitem"))
    return obs if weighted else obs.select("xs")


def _o(spark, sf_dir) -> DataFrame:
    return order_codes(_table(spark, sf_dir, "orders"))


def _r(column: str, digits: int = 6):
    """Rounded, and never a negative zero."""
    return (F.round(column, digits) + F.lit(0.0)).alias(column)


def _scaled(value, digits: int):
    """Rounded through a multiple, as DuckDB does; ``F.round`` goes by decimal digits and takes some halves the other way."""
    scale = F.lit(float(10**digits))
    return F.round(value * scale) / scale + F.lit(0.0)


# ---------------------------------------------------------------- SQL parts


def _E() -> str:
    return """obs AS (SELECT vec_id AS obs_id, list_transform(embedding, lambda e: CASE WHEN e > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS xs, 1.0::DOUBLE AS w FROM embeddings),
long AS (SELECT obs_id, w, unnest(range(len(xs))) AS var, unnest(xs) AS x FROM obs)"""


def _L(weighted: bool = False) -> str:
    return f"""obs AS (SELECT row_number() OVER () AS obs_id, [CASE l_returnflag WHEN 'A' THEN 0.0::DOUBLE WHEN 'N' THEN 1.0 ELSE 2.0 END, CASE l_linestatus WHEN 'F' THEN 0.0::DOUBLE ELSE 1.0 END,
  l_linenumber::DOUBLE, round(l_discount * 100), round(l_tax * 100), year(l_shipdate)::DOUBLE] AS xs, {"l_quantity" if weighted else "1.0"}::DOUBLE AS w FROM lineitem),
long AS (SELECT obs_id, w, unnest(range(6)) AS var, unnest(xs) AS x FROM obs)"""


_O = """obs AS (SELECT o_orderkey AS obs_id, [CASE o_orderstatus WHEN 'F' THEN 0.0::DOUBLE WHEN 'O' THEN 1.0 ELSE 2.0 END, substr(o_orderpriority, 1, 1)::DOUBLE, month(o_orderdate)::DOUBLE] AS xs, 1.0::DOUBLE AS w FROM orders),
long AS (SELECT obs_id, w, unnest(range(3)) AS var, unnest(xs) AS x FROM obs)"""

#: Counts, entropies and information of the samples ``long``.
_COUNTS = """c1 AS (SELECT var, x, sum(w) AS n FROM long GROUP BY ALL),
tot AS (SELECT var, sum(n) AS total FROM c1 GROUP BY var),
pairs AS (SELECT i.i AS src, j.j AS dst, xs[i.i + 1] AS x, xs[j.j + 1] AS y, w FROM obs, (SELECT DISTINCT var AS i FROM long) i, (SELECT DISTINCT var AS j FROM long) j WHERE i.i <> j.j),
c2 AS (SELECT src, dst, x, y, sum(w) AS n FROM pairs GROUP BY ALL)"""
_INFO = (
    _COUNTS
    + """,
h1 AS (SELECT var, -sum(n / total * log2(n / total)) AS h FROM c1 JOIN tot USING (var) GROUP BY var),
h2 AS (SELECT src, dst, -sum(c2.n / total * log2(c2.n / c1.n)) AS h FROM c2 JOIN c1 ON c1.var = dst AND c1.x = y JOIN tot ON tot.var = dst GROUP BY src, dst),
mi AS (SELECT src, dst, h1.h - h2.h AS mi, floor(h1.h * 1e8) / 1e8 - floor(h2.h * 1e8) / 1e8 AS mi8 FROM h2 JOIN h1 ON h1.var = src),
edges AS (SELECT src, dst, round(-mi, 8) + 0.0 AS weight FROM mi WHERE src < dst)"""
)
#: Spanning tree by Prim's rule and breadth-first levels from variable 0.
def _tree(s: str = "") -> str:
    return f"""prim{s} AS (
  SELECT 0 AS step, [0::BIGINT] AS seen, NULL::BIGINT AS src, NULL::BIGINT AS dst, NULL::DOUBLE AS weight
  UNION ALL
  SELECT step + 1, list_append(seen, fresh), src, dst, weight FROM (
    SELECT p.step, p.seen, e.src, e.dst, e.weight, CASE WHEN list_contains(p.seen, e.src) THEN e.dst ELSE e.src END AS fresh,
      row_number() OVER (ORDER BY e.weight, e.src, e.dst) AS r
    FROM prim{s} p JOIN edges{s} e ON list_contains(p.seen, e.src) <> list_contains(p.seen, e.dst)
  ) WHERE r = 1
),
mst{s} AS MATERIALIZED (SELECT src, dst, weight FROM prim{s} WHERE step > 0),
bfs{s} AS (
  SELECT 0::BIGINT AS var, NULL::BIGINT AS parent, 0 AS level, NULL::DOUBLE AS weight
  UNION ALL
  SELECT CASE WHEN m.src = b.var THEN m.dst ELSE m.src END, b.var, b.level + 1, m.weight
  FROM bfs{s} b JOIN mst{s} m ON (m.src = b.var OR m.dst = b.var) AND (b.parent IS NULL OR (m.src <> b.parent AND m.dst <> b.parent))
)"""


_TREE = _tree()
_CPT = """cpt AS (
  SELECT t.var, c2.x, c2.y AS parent_x, c2.n / c1.n AS p FROM bfs t JOIN c2 ON c2.src = t.var AND c2.dst = t.parent JOIN c1 ON c1.var = t.parent AND c1.x = c2.y
  UNION ALL
  SELECT t.var, c1.x, NULL, n / total FROM bfs t JOIN c1 ON c1.var = t.var JOIN tot ON tot.var = t.var WHERE t.parent IS NULL
)"""


def _with(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"


def _model(samples: str) -> str:
    return _with(samples, _INFO, _TREE, _CPT, recursive=True)


def _states(variables: int) -> str:
    """Probabilities of all combinations of values."""
    domains = ", ".join(f"(SELECT x FROM c1 WHERE var = {v}) d{v}" for v in range(variables))
    values = ", ".join(f"d{v}.x" for v in range(variables))
    return f""",
states AS (SELECT [{values}] AS xs FROM {domains}),
joint AS (SELECT xs, product(coalesce(p, 0)) AS p FROM states CROSS JOIN bfs t LEFT JOIN cpt c ON c.var = t.var AND c.x = xs[t.var + 1] AND (t.parent IS NULL OR c.parent_x = xs[t.parent + 1]) GROUP BY xs)"""


def _joint(evidence: dict[int, int]) -> str:
    """Beliefs of the six codes of order lines by enumeration of all states."""
    seen = " AND ".join(["true", *(f"xs[{v + 1}] = {x}" for v, x in evidence.items())])
    return (
        _states(6)
        + f""",
kept AS (SELECT xs, p / sum(p) OVER () AS p FROM joint WHERE {seen})
SELECT 0::BIGINT AS case_id, c1.var, c1.x, round(coalesce(sum(CASE WHEN xs[c1.var + 1] = c1.x THEN p END), 0), 6) + 0.0 AS p FROM kept, c1 GROUP BY c1.var, c1.x"""
    )


def _uniform(number: str, seed: int) -> str:
    return f"(('0x' || substr(md5('{seed}:' || ({number})::VARCHAR), 1, 12))::BIGINT / 281474976710656.0::DOUBLE)"


# ---------------------------------------------------------------- reshaping


@_query(_with(_E()) + "SELECT var, string_agg(x::INT::VARCHAR, '' ORDER BY obs_id) AS xs FROM long GROUP BY var")
def sample_transpose(spark, sf_dir):
    return reshape.by_variable(_e(spark, sf_dir)).select("var", F.array_join(F.transform("xs", lambda x: x.cast("int").cast("string")), "").alias("xs"))


@_query(_with(_E()) + "SELECT var, string_agg((x * 10)::INT::VARCHAR || ':' || (obs_id % 7)::VARCHAR, ',' ORDER BY obs_id) AS xws FROM long GROUP BY var")
def weighted_transpose(spark, sf_dir):
    obs = _e(spark, sf_dir).withColumn("w", F.col("obs_id") % 7)
    text = F.transform("xws", lambda s: F.concat_ws(":", (s.x * 10).cast("int"), s.w.cast("int")))
    return reshape.weighted_by_variable(obs).select("var", F.array_join(text, ",").alias("xws"))


@_query(_with(_E()) + "SELECT obs_id AS case_id, var, x FROM long")
def evidence_long(spark, sf_dir):
    return reshape.evidence_of(_e(spark, sf_dir))


@_query("SELECT a.i AS src, b.i AS dst FROM range(64) a(i) JOIN range(64) b(i) ON a.i < b.i")
def pair_theta_lt(spark, sf_dir):
    return reshape.label_pairs(counts1(_e(spark, sf_dir)).select("var").distinct(), "var")


@_query("SELECT a.i AS src, b.i AS dst FROM range(64) a(i) JOIN range(64) b(i) ON a.i <> b.i")
def pair_theta_ne(spark, sf_dir):
    return reshape.label_pairs(counts1(_e(spark, sf_dir)).select("var").distinct(), "var", ordered=False)


@_query(_with(_E(), _INFO) + "SELECT src, dst, round(weight, 6) + 0.0 AS weight FROM edges WHERE (src < 5) <> (dst < 5)")
def crossing_edges(spark, sf_dir):
    members = spark.range(5).select("id")
    return reshape.crossing_edges(graph.mi_edges(_e(spark, sf_dir), digits=8), members).select("src", "dst", _r("weight"))


# ---------------------------------------------------------------- information


@_query(_with(_L(), _INFO) + "SELECT var, round(h, 6) + 0.0 AS h FROM h1")
def entropy_all(spark, sf_dir):
    return info.entropy(counts1(_l(spark, sf_dir))).select("var", _r("h"))


@_query(_with(_L(), _INFO) + "SELECT src AS var, dst AS cond, round(h, 6) + 0.0 AS h FROM h2")
def cond_entropy_all(spark, sf_dir):
    return info.conditional_entropy(counts2(_l(spark, sf_dir), variables=6)).select("var", "cond", _r("h"))


@_query(_with(_L(), _INFO) + "SELECT src, dst, round(mi, 6) + 0.0 AS mi FROM mi WHERE src < dst")
def mutual_info_lt(spark, sf_dir):
    obs = _l(spark, sf_dir)
    return info.mutual_information(counts1(obs), counts2(obs, variables=6)).select("src", "dst", _r("mi"))


@_query(_with(_E(), _INFO) + "SELECT src, dst, round(mi, 6) + 0.0 AS mi FROM mi")
def mutual_info_full(spark, sf_dir):
    obs = _e(spark, sf_dir)
    return info.mutual_information(counts1(obs), counts2(obs, variables=64), full=True).select("src", "dst", _r("mi"))


@_query(_with(_L(), _INFO) + "SELECT src, dst, round(mi8 * 1e8)::BIGINT AS units FROM mi WHERE src < dst")
def mi_truncated(spark, sf_dir):
    """In whole units of 1e-8, to which both entropies are cut."""
    obs = _l(spark, sf_dir)
    found = info.mutual_information(counts1(obs), counts2(obs, variables=6), precision=8)
    return found.select("src", "dst", F.round(F.col("mi") * 1e8).cast("long").alias("units"))


@_query(_with(_O, _INFO) + "SELECT src, dst, round(mi, 6) + 0.0 AS mi FROM mi")
def mutual_info_orders(spark, sf_dir):
    obs = _o(spark, sf_dir)
    return info.mutual_information(counts1(obs), counts2(obs, variables=3), full=True).select("src", "dst", _r("mi"))


@_query(_with(_L(), _COUNTS) + "SELECT var, x, round(n / total, 6) AS p FROM c1 JOIN tot USING (var)")
def pmf(spark, sf_dir):
    return info.pmf(counts1(_l(spark, sf_dir))).select("var", "x", _r("p"))


@_query(_with(_E(), _COUNTS) + "SELECT src, dst, x, y, n::DOUBLE AS n FROM c2 WHERE src < dst")
def pair_counts_blocked(spark, sf_dir):
    return counts2(_e(spark, sf_dir))


@_query(_with(_L(True), _INFO) + "SELECT var, round(h, 6) + 0.0 AS h FROM h1")
def weighted_entropy(spark, sf_dir):
    return info.entropy(counts1(_l(spark, sf_dir, True))).select("var", _r("h"))


@_query(_with(_L(True), _INFO) + "SELECT src AS var, dst AS cond, round(h, 6) + 0.0 AS h FROM h2")
def weighted_cond_entropy(spark, sf_dir):
    return info.conditional_entropy(counts2(_l(spark, sf_dir, True), variables=6)).select("var", "cond", _r("h"))


@_query(_with(_L(True), _INFO) + "SELECT src, dst, round(mi, 6) + 0.0 AS mi FROM mi WHERE src < dst")
def weighted_mi(spark, sf_dir):
    obs = _l(spark, sf_dir, True)
    return info.mutual_information(counts1(obs), counts2(obs, variables=6)).select("src", "dst", _r("mi"))


# ---------------------------------------------------------------- graphs and spanning trees


@_query(_with(_E(), _INFO) + "SELECT src, dst, round(weight, 6) + 0.0 AS weight FROM edges")
def mi_graph_edges(spark, sf_dir):
    return graph.mi_edges(_e(spark, sf_dir), digits=8).select("src", "dst", _r("weight"))


@_query(_with(_E(), _INFO) + "SELECT src, dst, round(-mi, 6) + 0.0 AS weight FROM mi")
def mi_graph_full(spark, sf_dir):
    return graph.mi_edges(_e(spark, sf_dir), full=True).select("src", "dst", _r("weight"))


@_query(_with(_E(), _INFO) + "SELECT src, dst, round(weight, 6) + 0.0 AS weight, src AS src_frag, dst AS dst_frag FROM edges")
def ghs_graph(spark, sf_dir):
    edges = saved(graph.mi_edges(_e(spark, sf_dir), digits=8))
    return reshape.triplets(edges, graph.vertices(edges, fragments=True)).select("src", "dst", _r("weight"), "src_frag", "dst_frag")


@_query(_with(_L(True), _INFO) + "SELECT src, dst, round(weight, 6) + 0.0 AS weight, src AS src_frag, dst AS dst_frag FROM edges")
def ghs_weighted_graph(spark, sf_dir):
    edges = saved(graph.mi_edges(_l(spark, sf_dir, True)))
    return reshape.triplets(edges, graph.vertices(edges, fragments=True)).select("src", "dst", _r("weight"), "src_frag", "dst_frag")


@_query(_with(_E(), _INFO) + "SELECT a.i AS src, string_agg(format('{:.5f}', coalesce(CASE WHEN b.i > a.i THEN round(weight, 5) + 0.0 END, 0.0)), ' ' ORDER BY b.i) AS line FROM range(63) a(i) CROSS JOIN range(64) b(i) LEFT JOIN edges ON src = a.i AND dst = b.i GROUP BY a.i")
def mi_matrix(spark, sf_dir):
    """Of edges rounded to 8 digits, as in the SQL; a weight's text is rounded once more."""
    rows = graph.matrix(graph.mi_edges(_e(spark, sf_dir), digits=8), 64)
    return rows.select("src", F.array_join(F.transform("row", lambda w: F.format_string("%.5f", _scaled(w, 5))), " ").alias("line"))


_MST_SQL = _with(_E(), _INFO, _TREE, recursive=True) + "SELECT src, dst, round(weight, 6) + 0.0 AS weight FROM mst"


def _mst(method):
    def run(spark, sf_dir):
        return mst.mst(graph.mi_edges(_e(spark, sf_dir), digits=8), method).select("src", "dst", _r("weight"))

    return run


for _m in ("kruskal", "prim", "boruvka", "ghs"):
    _QUERIES[f"mst_{_m}"], _SQL[f"mst_{_m}"] = _mst(_m), _MST_SQL


@_query(_with(_E(), _INFO, _TREE, recursive=True) + "SELECT count(*)::BIGINT AS edges, round(sum(weight), 6) AS weight FROM mst")
def mst_total_weight(spark, sf_dir):
    return mst.total_weight(mst.mst(graph.mi_edges(_e(spark, sf_dir), digits=8))).select("edges", _r("weight"))


@_query(
    _with(_E(), _INFO, _TREE, recursive=True)
    + "SELECT node, node::VARCHAR || ' ' || string_agg(near::VARCHAR || ':' || format('{:.6f}', round(w, 6)), ',' ORDER BY near) AS line FROM (SELECT src AS node, dst AS near, weight AS w FROM mst UNION ALL SELECT dst, src, weight FROM mst) GROUP BY node"
)
def mst_adjacency(spark, sf_dir):
    found = mst.mst(graph.mi_edges(_e(spark, sf_dir), digits=8)).withColumn("weight", F.format_string("%.6f", F.round("weight", 6)))
    return to_adjacency(found)


@_query(
    _with(_E(), _INFO)
    + "SELECT v AS id, arg_min(src, (weight, src, dst)) AS src, arg_min(dst, (weight, src, dst)) AS dst FROM (SELECT unnest([src, dst]) AS v, * FROM edges) GROUP BY v"
)
def ghs_vertex_minimum(spark, sf_dir):
    edges = saved(graph.mi_edges(_e(spark, sf_dir), digits=8))
    return mst.vertex_minimum(edges, graph.vertices(edges, fragments=True)).select("id", "src", "dst")


@_query(
    _with(_E(), _INFO)
    + "SELECT v AS frag, arg_min(src, (weight, src, dst)) AS src, arg_min(dst, (weight, src, dst)) AS dst FROM (SELECT unnest([src % 4, dst % 4]) AS v, * FROM edges WHERE src % 4 <> dst % 4) GROUP BY v"
)
def ghs_fragment_minimum(spark, sf_dir):
    edges = saved(graph.mi_edges(_e(spark, sf_dir), digits=8))
    return mst.fragment_minimum(edges, graph.vertices(edges).withColumn("frag", F.col("id") % 4)).select("frag", "src", "dst")


# ---------------------------------------------------------------- trees and tables


def _oriented(spark, sf_dir):
    """Counts of single values and pairs, and the oriented tree."""
    obs = _e(spark, sf_dir)
    c1, c2 = saved(counts1(obs)), saved(counts2(obs, variables=64))
    mi = info.mutual_information(c1, c2)
    edges = mst.mst(mi.select("src", "dst", (F.round(-F.col("mi"), 8) + F.lit(0.0)).alias("weight")), "kruskal")
    return c1, c2, saved(tree.orient(edges))


_TREE_SQL = _with(_E(), _INFO, _TREE, recursive=True)


@_query(_TREE_SQL + "SELECT var, level FROM bfs")
def tree_levels(spark, sf_dir):
    return _oriented(spark, sf_dir)[2].select("var", "level")


@_query(_TREE_SQL + "SELECT var, parent, round(weight, 6) + 0.0 AS weight FROM bfs WHERE parent IS NOT NULL")
def tree_edges(spark, sf_dir):
    return _oriented(spark, sf_dir)[2].where("parent IS NOT NULL").select("var", "parent", _r("weight"))


@_query(_TREE_SQL + "SELECT var, CASE WHEN parent IS NULL THEN 'root' WHEN var IN (SELECT parent FROM bfs WHERE parent IS NOT NULL) THEN 'node' ELSE 'leaf' END AS state FROM bfs")
def node_state(spark, sf_dir):
    return tree.node_state(_oriented(spark, sf_dir)[2])


@_query(_TREE_SQL + "SELECT max(level) AS depth FROM bfs")
def tree_depth(spark, sf_dir):
    return tree.depth(_oriented(spark, sf_dir)[2])


def _cpt(estimator, weighted=False):
    def run(spark, sf_dir):
        if weighted:
            model = learn_tree(_l(spark, sf_dir, True), method="kruskal", estimator=estimator)
            return model.cpt.select("var", "x", "parent_x", _r("p"))
        c1, c2, t = _oriented(spark, sf_dir)
        return tree.tables(t, c1, c2, estimator).select("var", "x", "parent_x", _r("p"))

    return run


_SMOOTH = """,
card AS (SELECT var, count(*) AS card, max(x) AS top FROM c1 GROUP BY var)
SELECT t.var, c2.x, c2.y AS parent_x, round({inner}, 6) AS p
FROM bfs t JOIN c2 ON c2.src = t.var AND c2.dst = t.parent JOIN c1 ON c1.var = t.parent AND c1.x = c2.y JOIN tot ON tot.var = t.parent JOIN card ON card.var = t.var
UNION ALL
SELECT t.var, c1.x, NULL, round({root}, 6) FROM bfs t JOIN c1 ON c1.var = t.var JOIN tot ON tot.var = t.var JOIN card ON card.var = t.var WHERE t.parent IS NULL"""

_QUERIES["cpt_mle"] = _cpt("mle")
_SQL["cpt_mle"] = _TREE_SQL + "," + _CPT + " SELECT var, x, parent_x, round(p, 6) AS p FROM cpt"
_QUERIES["cpt_bayes"] = _cpt("bayes")
_SQL["cpt_bayes"] = _TREE_SQL + _SMOOTH.format(inner="((c2.n + 1) / (total + top)) / ((c1.n + 1) / (total + c2.y))", root="(c1.n + 1) / (total + c1.x)")
_QUERIES["cpt_laplace"] = _cpt("laplace")
_SQL["cpt_laplace"] = _TREE_SQL + _SMOOTH.format(inner="(c2.n + 1) / (c1.n + card)", root="(c1.n + 1) / (total + card)")
_QUERIES["cpt_weighted"] = _cpt("mle", True)
_SQL["cpt_weighted"] = _with(_L(True), _INFO, _TREE, _CPT, recursive=True) + "SELECT var, x, parent_x, round(p, 6) AS p FROM cpt"


@_query(_TREE_SQL + "SELECT c1.var, x, round(n / total, 6) AS p FROM c1 JOIN tot USING (var) WHERE c1.var = 0")
def root_marginal(spark, sf_dir):
    c1, c2, t = _oriented(spark, sf_dir)
    return tree.tables(t, c1, c2).where("parent_x IS NULL").select("var", "x", _r("p"))


# ---------------------------------------------------------------- inference


def _models(obs: DataFrame) -> dict:
    model = learn_tree(obs, method="kruskal")
    return inference.load(model.tree, model.cpt)


def _bp(seen):
    def run(spark, sf_dir):
        rows = [(0, v, float(x)) for v, x in seen.items()] or [(0, None, None)]
        evidence = spark.createDataFrame(rows, "case_id long, var long, x double")
        return inference.infer(_models(_l(spark, sf_dir)), evidence).select("case_id", "var", "x", _r("p"))

    return run


for _name, _seen in {"bp_no_evidence": {}, "bp_evidence_root": {0: 1}, "bp_evidence_internal": {2: 3, 3: 5}, "bp_evidence_leaf": {4: 2}}.items():
    _QUERIES[_name], _SQL[_name] = _bp(_seen), _model(_L()) + _joint(_seen)


@_query(
    _model(_O)
    + _states(3)
    + """,
part AS (SELECT j.xs[1] AS a, c1.var, c1.x, sum(j.p) AS p FROM joint j JOIN c1 ON j.xs[c1.var + 1] = c1.x WHERE c1.var > 0 GROUP BY ALL),
whole AS (SELECT xs[1] AS a, sum(p) AS p FROM joint GROUP BY ALL),
pairs_ AS (SELECT whole.a, c1.var, c1.x, coalesce(part.p, 0) / whole.p AS p FROM whole CROSS JOIN (SELECT var, x FROM c1 WHERE var > 0) c1 LEFT JOIN part ON part.a = whole.a AND part.var = c1.var AND part.x = c1.x)
SELECT obs_id AS case_id, pairs_.var, pairs_.x, round(pairs_.p, 6) + 0.0 AS p FROM obs JOIN pairs_ ON xs[1] = pairs_.a"""
)
def bp_per_observation(spark, sf_dir):
    """Priority and month of every order, given its status."""
    obs = _o(spark, sf_dir)
    seen = reshape.evidence_of(obs).where("var = 0")
    return inference.infer(_models(obs), seen).where("var > 0").select("case_id", "var", "x", _r("p"))


# ---------------------------------------------------------------- resampling


def _count(spark, sf_dir) -> int:
    return _table(spark, sf_dir, "embeddings").count()


@_query(f"SELECT i AS draw, floor({_uniform('i', 5)} * n)::BIGINT AS obs_id FROM (SELECT unnest(range(n)) AS i, n FROM (SELECT count(*) AS n FROM embeddings))")
def bootstrap_index(spark, sf_dir):
    return resample.bootstrap_index(spark, _count(spark, sf_dir), 5)


@_query(f"SELECT v AS var, i AS draw, floor({_uniform('i * 4 + v', 5)} * n)::BIGINT AS obs_id FROM (SELECT unnest(range(n)) AS i, n FROM (SELECT count(*) AS n FROM embeddings)) CROSS JOIN range(4) r(v)")
def resample_index(spark, sf_dir):
    return resample.resample_index(spark, _count(spark, sf_dir), 4, 5)


@_query(f"SELECT vec_id AS obs_id, CASE WHEN {_uniform('vec_id', 9)} < 0.6 THEN 'train' ELSE 'test' END AS part FROM embeddings")
def train_test_split(spark, sf_dir):
    return resample.train_test_split(_e(spark, sf_dir).select("obs_id"), 0.6, 9)


@_query(f"SELECT vec_id AS obs_id, ((row_number() OVER (ORDER BY {_uniform('vec_id', 3)}, vec_id) - 1) % 5)::INT AS fold FROM embeddings")
def folds(spark, sf_dir):
    return resample.folds(_e(spark, sf_dir).select("obs_id"), 5, 3)


# ---------------------------------------------------------------- mixtures and scores



def _mix(trees: int) -> str:
    """Information of pairs in bootstrap samples, as ``info``."""
    boots = ",\n".join(
        f"b{k} AS (SELECT floor({_uniform('i', k)} * n)::BIGINT AS obs_id, count(*)::DOUBLE AS w FROM (SELECT unnest(range(n)) AS i, n FROM (SELECT count(*) AS n FROM embeddings)) GROUP BY 1)" for k in range(trees)
    )
    drawn = " UNION ALL ".join(f"SELECT {k}::BIGINT AS tree_id, * FROM b{k}" for k in range(trees))
    return f"""{boots},
drawn AS ({drawn}),
o AS (SELECT tree_id, xs, drawn.w FROM obs JOIN drawn USING (obs_id)),
p AS (SELECT tree_id, i AS src, j AS dst, xs[i + 1] AS x, xs[j + 1] AS y, sum(w) AS n FROM o, range(64) a(i), range(64) b(j) WHERE i < j GROUP BY ALL),
q AS (SELECT *, sum(n) OVER (PARTITION BY tree_id, src, dst) AS t, sum(n) OVER (PARTITION BY tree_id, src, dst, x) AS nx, sum(n) OVER (PARTITION BY tree_id, src, dst, y) AS ny FROM p),
info AS MATERIALIZED (SELECT tree_id, src, dst, sum(n / t * log2(n * t / (nx * ny))) AS mi FROM q GROUP BY ALL)"""


def _mix_trees(trees: int) -> str:
    parts = [f"edges{k} AS MATERIALIZED (SELECT src, dst, round(-mi, 8) + 0.0 AS weight FROM info WHERE tree_id = {k}),\n{_tree(str(k))}" for k in range(trees)]
    return _with(_E(), _COUNTS, _mix(trees), *parts, recursive=True)


def _each(trees: int, sql: str) -> str:
    return " UNION ALL ".join(sql.format(k=k) for k in range(trees))


#: Log likelihoods of all observations under every tree; parameters come from all observations, so every pair is known.
_MIX_LL = """,
forest AS ({all}),
lls AS MATERIALIZED (SELECT tree_id, obs_id, sum(log2(coalesce(c2.n / c1.n, r.n / tot.total))) AS ll FROM obs CROSS JOIN forest t
LEFT JOIN c2 ON c2.src = t.var AND c2.dst = t.parent AND c2.x = xs[t.var + 1] AND c2.y = xs[t.parent + 1] LEFT JOIN c1 ON c1.var = t.parent AND c1.x = xs[t.parent + 1]
JOIN c1 r ON r.var = t.var AND r.x = xs[t.var + 1] JOIN tot ON tot.var = t.var GROUP BY ALL),
dens AS (SELECT obs_id, count(*) OVER (PARTITION BY xs) / (count(*) OVER ())::DOUBLE AS p FROM obs)
"""
_MIX_MI = _with(_E(), _mix(3)) + "SELECT tree_id, src, dst, round(mi, 6) + 0.0 AS mi FROM info"


@_query(_MIX_MI)
def mcl_b_information(spark, sf_dir):
    names = ["w0", "w1", "w2"]
    obs = resample.bootstrap_weights(_e(spark, sf_dir), _count(spark, sf_dir), [0, 1, 2])
    c1, c2 = mixture.by_tree(counts1(obs, names), names), mixture.by_tree(counts2(obs, names, 64), names)
    return mixture.mi_by_tree(c1, c2).select("tree_id", "src", "dst", _r("mi"))


def _mixture(spark, sf_dir, estimator="mle"):
    t, c = mixture.mcl_b(_e(spark, sf_dir), _count(spark, sf_dir), [0, 1, 2], estimator)
    return t, saved(c, "tables")


@_query(_mix_trees(3) + _each(3, "SELECT {k}::BIGINT AS tree_id, var, parent, level, round(weight, 6) + 0.0 AS weight FROM bfs{k}"))
def mcl_b_trees(spark, sf_dir):
    return _mixture(spark, sf_dir)[0].select("tree_id", "var", "parent", "level", _r("weight"))


def _belief(estimator):
    def run(spark, sf_dir):
        models = inference.load(*_mixture(spark, sf_dir, estimator), "tree_id")
        seen = spark.createDataFrame([(0, 0, 1.0)], "case_id long, var long, x double")
        return mixture.mixture_belief(saved(inference.infer(models, seen, "tree_id"))).select("case_id", "var", "x", _r("p"))

    return run


_QUERIES["mixture_belief"] = _belief("mle")
_QUERIES["mixture_belief_bayes"] = _belief("bayes")
# with one observed variable a belief goes from neighbour to neighbour by the empirical conditional frequencies
_KERNEL = """,
kern AS MATERIALIZED (SELECT src AS v, dst AS u, sum(CASE WHEN x = 0 AND y = 0 THEN n ELSE 0 END) / sum(CASE WHEN y = 0 THEN n ELSE 0 END) AS k0,
  sum(CASE WHEN x = 0 AND y = 1 THEN n ELSE 0 END) / sum(CASE WHEN y = 1 THEN n ELSE 0 END) AS k1 FROM c2 GROUP BY ALL)"""
_WALK = """,
bel{k} AS (SELECT 0::BIGINT AS var, -1::BIGINT AS prev, 0.0::DOUBLE AS p0 UNION ALL
  SELECT kern.v, b.var, k0 * p0 + k1 * (1 - p0) FROM bel{k} b JOIN mst{k} m ON m.src = b.var OR m.dst = b.var JOIN kern ON kern.u = b.var AND kern.v = CASE WHEN m.src = b.var THEN m.dst ELSE m.src END WHERE kern.v <> b.prev)"""
_SQL["mixture_belief"] = (
    _mix_trees(3)
    + _KERNEL
    + "".join(_WALK.format(k=k) for k in range(3))
    + " SELECT 0::BIGINT AS case_id, var, x, round(avg(CASE WHEN x = 0 THEN p0 ELSE 1 - p0 END), 6) + 0.0 AS p FROM ("
    + _each(3, "SELECT * FROM bel{k}")
    + ") CROSS JOIN (VALUES (0.0::DOUBLE), (1.0::DOUBLE)) d(x) GROUP BY var, x"
)

_LL_SQL = (
    _model(_O)
    + """, lls AS (SELECT obs_id, sum(log2(coalesce(p, 1.0 / (total + top)))) AS ll
FROM obs CROSS JOIN bfs t JOIN tot ON tot.var = t.var JOIN (SELECT var, max(x) AS top FROM c1 GROUP BY var) m ON m.var = t.var
LEFT JOIN cpt c ON c.var = t.var AND c.x = xs[t.var + 1] AND (t.parent IS NULL OR c.parent_x = xs[t.parent + 1]) GROUP BY obs_id),
dens AS (SELECT obs_id, count(*) OVER (PARTITION BY xs) / (count(*) OVER ())::DOUBLE AS p FROM obs)
"""
)


def _ll(spark, sf_dir):
    obs = _o(spark, sf_dir)
    return obs, inference.log_likelihood(_models(obs), obs, obs.count())


@_query(_LL_SQL + "SELECT obs_id, round(ll, 6) AS ll FROM lls")
def tree_loglik(spark, sf_dir):
    return _ll(spark, sf_dir)[1].select("obs_id", _r("ll"))


@_query(_LL_SQL + "SELECT round(avg(log2(p) - ll), 6) AS kl FROM lls JOIN dens USING (obs_id)")
def kl_divergence(spark, sf_dir):
    obs, ll = _ll(spark, sf_dir)
    return score.mean_tree_kl(ll.withColumn("tree_id", F.lit(0)), score.empirical_density(obs)).select(_r("kl"))


@_query(
    _mix_trees(5)
    + _MIX_LL.format(all=_each(5, "SELECT {k} AS tree_id, * FROM bfs{k}"))
    + "SELECT trees, round(avg(k), 6) + 0.0 AS kl FROM (SELECT tree_id, avg(log2(p) - ll) AS k FROM lls JOIN dens USING (obs_id) GROUP BY tree_id) JOIN (VALUES (1), (3), (5)) s(trees) ON tree_id < trees GROUP BY trees"
)
def kl_curve(spark, sf_dir):
    obs, n = _e(spark, sf_dir), _count(spark, sf_dir)
    return kl_by_trees(obs, n, obs, score.empirical_density(obs), [1, 3, 5]).select("trees", _r("kl"))


@_query(
    _mix_trees(3)
    + _MIX_LL.format(all=_each(3, "SELECT {k} AS tree_id, * FROM bfs{k}"))
    + "SELECT round(avg(log2(p) - l), 6) + 0.0 AS kl FROM (SELECT obs_id, max(ll) + log2(avg(pow(2, ll - m))) AS l FROM (SELECT *, max(ll) OVER (PARTITION BY obs_id) AS m FROM lls) GROUP BY obs_id) JOIN dens USING (obs_id)"
)
def mixture_kl(spark, sf_dir):
    obs, n = _e(spark, sf_dir), _count(spark, sf_dir)
    ll = saved(inference.log_likelihood(inference.load(*_mixture(spark, sf_dir), "tree_id"), obs, n, "tree_id"))
    return score.mixture_kl(ll, score.empirical_density(obs)).select(_r("kl"))


@_query(_model(_L()) + ", belief AS (" + _joint({0: 1}).strip().lstrip(",").join(["WITH ", ")"]) + " SELECT b.var, round(sum(-b.p * log2(b.p) - b.p * log2(n / total)), 5) + 0.0 AS score FROM belief b JOIN c1 ON c1.var = b.var AND c1.x = b.x JOIN tot ON tot.var = b.var WHERE b.p > 0 GROUP BY b.var")
def special_score(spark, sf_dir):
    seen = spark.createDataFrame([(0, 0, 1.0)], "case_id long, var long, x double")
    obs = _l(spark, sf_dir)
    beliefs = inference.infer(_models(obs), seen).select("var", "x", _r("p"))
    return score.special_score(beliefs, info.pmf(counts1(obs))).select("var", _r("score", 5))


@_query()
def em_loglik(spark, sf_dir):
    obs, n = _e(spark, sf_dir), _count(spark, sf_dir)
    start = resample.folds(obs.select("obs_id"), 2, 3)
    *_, history = mixture.fit_em(obs, 2, n, start, max_iter=50, tol=0.01)
    return spark.createDataFrame([(i, round(x, 6)) for i, x in enumerate(history)], "step int, mean_log2 double")


@_query(
    _LL_SQL
    + """, other AS (SELECT obs_id, sum(log2(n / total)) AS ll FROM long JOIN c1 USING (var, x) JOIN tot USING (var) GROUP BY obs_id),
both_ll AS (SELECT 0::BIGINT AS tree_id, obs_id, ll + log2(0.25) AS s FROM lls UNION ALL SELECT 1, obs_id, ll + log2(0.75) FROM other)
SELECT tree_id, obs_id, round(pow(2, s) / sum(pow(2, s)) OVER (PARTITION BY obs_id), 6) AS gamma FROM both_ll"""
)
def em_responsibility(spark, sf_dir):
    obs, ll = _ll(spark, sf_dir)
    p = info.pmf(counts1(obs))
    apart = reshape.tidy(obs).join(p, ["var", "x"]).groupBy("obs_id").agg(F.sum(F.log2("p")).alias("ll"))
    both = ll.select(F.lit(0).cast("long").alias("tree_id"), "obs_id", "ll").union(apart.select(F.lit(1).cast("long"), "obs_id", "ll"))
    return mixture.responsibilities(both, {0: 0.25, 1: 0.75}).select("tree_id", "obs_id", _r("gamma"))


# ---------------------------------------------------------------- text


@_query("SELECT obs_id, copy, xs FROM (SELECT vec_id AS obs_id, array_to_string(list_transform(embedding, lambda e: CASE WHEN e > 0 THEN '1' ELSE '0' END), ';') AS xs FROM embeddings) CROSS JOIN (SELECT range::INT AS copy FROM range(3))")
def repeat_rows_query(spark, sf_dir):
    return repeat_rows(_e(spark, sf_dir), 3).select("obs_id", "copy", F.array_join(F.transform("xs", lambda x: x.cast("int").cast("string")), ";").alias("xs"))


@_query("SELECT vec_id AS obs_id, xs || ';' || xs AS xs FROM (SELECT vec_id, array_to_string(list_transform(embedding, lambda e: CASE WHEN e > 0 THEN '1' ELSE '0' END), ';') AS xs FROM embeddings)")
def repeat_cols_query(spark, sf_dir):
    return repeat_columns(_e(spark, sf_dir), 2).select("obs_id", F.array_join(F.transform("xs", lambda x: x.cast("int").cast("string")), ";").alias("xs"))


@_query(_with(_O) + "SELECT obs_id, round(ln(count(*) OVER (PARTITION BY xs) / (count(*) OVER ())::DOUBLE), 6) + 0.0 AS value FROM obs")
def log_validation(spark, sf_dir):
    return log_density_lines(score.empirical_density(_o(spark, sf_dir))).select("obs_id", _r("value"))


def _folder(spark, name: str) -> str:
    """A folder of its own for text that is written and read back."""
    import uuid

    from .storage import shared_folder

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _through(spark, lines: DataFrame, column: str, read):
    """Lines written as text and read back."""
    path = _folder(spark, "text")
    write_lines(lines, column, path)
    return read(spark, path)


def _spaced():
    return F.array_join(F.transform("xs", lambda x: x.cast("int").cast("string")), " ")


@_query("SELECT (row_number() OVER (ORDER BY n_nationkey) - 1)::VARCHAR || ',' || n_name AS line FROM nation")
def indexed_lines(spark, sf_dir):
    """``i,line`` of all names of nations, in the order of their keys."""
    names = _table(spark, sf_dir, "nation").repartitionByRange(3, "n_nationkey").sortWithinPartitions("n_nationkey")
    return numbered_lines(names.select(F.col("n_name").alias("value")))


@_query(_with(_E()) + "SELECT var, count(*)::INT AS samples, sum(x) AS ones FROM long GROUP BY var")
def read_var_text(spark, sf_dir):
    """Variables written as text and read back."""
    rows = reshape.by_variable(_e(spark, sf_dir)).select(F.concat(F.col("var").cast("string"), F.lit(","), _spaced()).alias("line"))
    return _through(spark, rows, "line", read_variables).select("var", F.size("xs").alias("samples"), F.aggregate("xs", F.lit(0.0), lambda a, x: a + x).alias("ones"))


@_query(_with(_O) + "SELECT xs[1] AS a, xs[2] AS b, xs[3] AS c, count(*) AS n FROM obs GROUP BY ALL")
def read_observation_text(spark, sf_dir):
    """Observations written as ``v;v;v`` lines and read back, numbered."""
    rows = _o(spark, sf_dir).select(F.array_join(F.transform("xs", lambda x: x.cast("string")), ";").alias("line"))
    found = _through(spark, rows, "line", read_observations)
    total = found.agg(F.countDistinct("obs_id"), F.max("obs_id")).first()
    if total[0] != total[1] + 1:
        raise ValueError("numbers have gaps")
    return found.groupBy(*[F.col("xs")[k].alias(n) for k, n in enumerate("abc")]).agg(F.count("*").alias("n"))


@_query(_with(_O) + "SELECT obs_id, xs[1] AS a, xs[2] AS b, xs[3] AS c FROM obs")
def read_indexed_observation_text(spark, sf_dir):
    """Observations written as ``id,v v v`` lines and read back."""
    rows = _o(spark, sf_dir).select(F.concat(F.col("obs_id").cast("string"), F.lit(","), _spaced()).alias("line"))
    return _through(spark, rows, "line", read_indexed_observations).select("obs_id", *[F.col("xs")[k].alias(n) for k, n in enumerate("abc")])


@_query("SELECT o_orderkey AS obs_id, o_totalprice::DOUBLE / 1e6 AS p FROM orders")
def read_indexed_density_text(spark, sf_dir):
    """Densities written as ``id,p`` lines and read back."""
    rows = _table(spark, sf_dir, "orders").select(F.concat_ws(",", F.col("o_orderkey").cast("string"), (F.col("o_totalprice").cast("double") / 1e6).cast("string")).alias("line"))
    return _through(spark, rows, "line", read_indexed_densities)


@_query("SELECT o_totalprice::DOUBLE / 1e6 AS p, count(*) AS n FROM orders GROUP BY ALL")
def read_density_text(spark, sf_dir):
    """Densities written one per line and read back."""
    rows = _table(spark, sf_dir, "orders").select((F.col("o_totalprice").cast("double") / 1e6).cast("string").alias("line"))
    return _through(spark, rows, "line", read_densities).groupBy("p").agg(F.count("*").alias("n"))


@_query("SELECT count(*) AS lines FROM orders")
def line_counts(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("line"))
    return _through(spark, rows, "line", lambda s, path: s.createDataFrame([(line_count(s, path),)], "lines long"))


@_query("SELECT l_orderkey::VARCHAR AS src, l_partkey::VARCHAR AS dst, l_quantity::DOUBLE AS weight FROM lineitem")
def read_edge_text(spark, sf_dir):
    """Orders and parts as ``a b w`` lines, read back."""
    rows = _table(spark, sf_dir, "lineitem").select(F.concat_ws(" ", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"), F.col("l_quantity").cast("double").cast("string")).alias("line"))
    return _through(spark, rows, "line", read_edge_list)


@_query(_SQL["mi_graph_edges"])
def adjacency_text(spark, sf_dir):
    """A graph written as adjacency text and read back."""
    return _through(spark, to_adjacency(graph.mi_edges(_e(spark, sf_dir), digits=8)), "line", read_adjacency).select("src", "dst", _r("weight"))


@_query(_SQL["mst_total_weight"])
def adjacency_file_prim(spark, sf_dir):
    """From an adjacency file to the tree's total weight."""
    edges = _through(spark, to_adjacency(graph.mi_edges(_e(spark, sf_dir), digits=8)), "line", read_adjacency)
    return mst.total_weight(mst.mst(edges, "prim")).select("edges", _r("weight"))


@_query(_with(_E(), _INFO, _TREE, recursive=True) + "SELECT e.src, e.dst, round(e.weight, 6) + 0.0 AS weight FROM edges e JOIN mst m ON m.src = e.src AND m.dst = e.dst")
def edge_subgraph(spark, sf_dir):
    """Edges of the full graph that are in the tree."""
    edges = saved(graph.mi_edges(_e(spark, sf_dir), digits=8))
    return reshape.edge_subgraph(edges, mst.mst(edges, "kruskal")).select("src", "dst", _r("weight"))


@_query(_SQL["mi_graph_edges"])
def matrix_to_graph(spark, sf_dir):
    """A dense matrix of weights and back to edges."""
    edges = graph.mi_edges(_e(spark, sf_dir), digits=8)
    return graph.from_matrix(graph.matrix(edges, 64)).select("src", "dst", _r("weight"))


@_query(_with(_E()) + "SELECT obs_id, list_sort(list(var)) AS ones FROM long WHERE x = 1 GROUP BY obs_id")
def concat_maps(spark, sf_dir):
    """Maps from a value to its variables, merged for the halves of every vector."""
    half = lambda low, high: F.map_from_arrays(F.array(F.lit(1)), F.array(F.filter(F.sequence(F.lit(low), F.lit(high)), lambda i: F.element_at("xs", i + 1) == 1)))
    obs = _e(spark, sf_dir)
    merged = concat_array_maps(half(0, 31), half(32, 63))
    return obs.select("obs_id", F.transform(F.array_sort(F.element_at(merged, F.lit(1))), lambda i: i.cast("long")).alias("ones")).where(F.size("ones") > 0)


@_query()
def bench_mst(spark, sf_dir):
    return compare_methods(graph.mi_edges(_e(spark, sf_dir), digits=8), ["kruskal", "prim", "boruvka"], 1).select("method", "edges", _r("weight"))


@_query()
def bench_mixture(spark, sf_dir):
    """Timing of mixtures; without the seconds, which differ from run to run."""
    return time_mixtures(spark, [10], trees=3, repeat=1).select("variables", "method", "rows")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependency tree of the embeddings' signs."""
    return _QUERIES["mst_kruskal"](spark, sf_dir)


def queries() -> dict:
    return {k.removesuffix("_query"): f for k, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k.removesuffix("_query"): s for k, s in _SQL.items()}
