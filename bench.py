"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

from pyspark.sql import SparkSession

from treeloom import queries as core
from treeloom.plans import time_methods

#: Runs of each query, whose mean is reported.
REPEAT = 2
#: Numbers of two-valued variables, with 500 observations each, on which spanning-tree methods are timed.
SIZES, METHODS = [50, 100, 200, 500], ["kruskal", "prim", "boruvka"]
HEADLINE = ["entropy_all", "mutual_info_lt", "weighted_mi", "mutual_info_full", "mi_graph_edges", "mst_kruskal", "mst_prim", "mst_boruvka", "cpt_mle", "cpt_weighted", "bp_per_observation", "tree_loglik", "mcl_b_trees", "em_responsibility"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found, names = core.queries(), sys.argv[1:] or HEADLINE
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    for name in names:  # code is loaded and compiled before anything is timed
        found[name](spark, small if os.path.isdir(small) else sf_dir).write.format("noop").mode("overwrite").save()
    took = {name: [] for name in names}
    for _ in range(REPEAT):
        for name in names:
            began = time.perf_counter()
            found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name].append(time.perf_counter() - began)
    took = {name: round(sum(x) / len(x), 3) for name, x in took.items()}
    sizes = {} if sys.argv[1:] else {f"{r.method}_{r.variables}": round(r.seconds, 3) for r in time_methods(spark, SIZES, METHODS, repeat=1).collect()}
    sf = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf[1]) if sf else None, "by_variables": sizes}))


if __name__ == "__main__":
    main()
