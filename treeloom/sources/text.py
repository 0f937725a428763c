"""Text formats.

``label,v v v``: one variable (or one numbered observation) with its values; ``v; v; v``: one observation;
``id,p``: a density; ``node nbr:w,nbr:w``: a node's neighbours; ``a b w``: an edge.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _numbers(text: Column, delimiter: str) -> Column:
    """Numbers between delimiters; spaces around them and empty tokens don't count."""
    tokens = F.split(F.trim(text), r"\s+" if delimiter == " " else re.escape(delimiter))
    return F.transform(F.filter(F.transform(tokens, lambda t: F.trim(t)), lambda t: t != ""), lambda t: t.cast("double"))


def read_variables(spark: SparkSession, path: str, label_delimiter: str = ",", delimiter: str = " ") -> DataFrame:
    """``var, xs`` of ``label,v v v`` lines; numbered observations have the same form."""
    line = F.trim(F.col("value"))
    cut = F.instr(line, label_delimiter)
    rows = spark.read.text(path).where((F.length(line) > 0) & (cut > 0))
    return rows.select(F.trim(F.substring(line, F.lit(1), cut - 1)).cast("double").cast("long").alias("var"), _numbers(F.substring(line, cut + 1, F.length(line)), delimiter).alias("xs"))


def read_indexed_observations(spark: SparkSession, path: str, label_delimiter: str = ",", delimiter: str = " ") -> DataFrame:
    """``obs_id, xs`` of ``id,v v v`` lines."""
    return read_variables(spark, path, label_delimiter, delimiter).withColumnRenamed("var", "obs_id")


def read_observations(spark: SparkSession, path: str, delimiter: str = ";") -> DataFrame:
    """``obs_id, xs`` of ``v; v; v`` lines, numbered from 0 in the order of files and lines."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0).select("value")
    return number_lines(lines).select(F.col("line_no").alias("obs_id"), _numbers(F.col("value"), delimiter).alias("xs"))


def read_densities(spark: SparkSession, path: str) -> DataFrame:
    """``obs_id, p`` of one density per line."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0).select("value")
    return number_lines(lines).select(F.col("line_no").alias("obs_id"), F.trim("value").cast("double").alias("p"))


def read_indexed_densities(spark: SparkSession, path: str, label_delimiter: str = ",") -> DataFrame:
    """``obs_id, p`` of ``id,p`` lines."""
    parts = F.split(F.col("value"), re.escape(label_delimiter))
    return spark.read.text(path).where(F.length(F.trim("value")) > 0).select(F.trim(parts[0]).cast("double").cast("long").alias("obs_id"), F.trim(parts[1]).cast("double").alias("p"))


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """Undirected ``src, dst, weight`` (``src < dst``, once each) of ``node nbr:w,nbr:w`` lines."""
    line = F.trim(F.col("value"))
    rows = spark.read.text(path).where(F.length(line) > 0).select(F.split(line, r"\s+", 2).alias("p"))
    near = rows.select(F.col("p")[0].cast("long").alias("a"), F.explode(F.filter(F.split(F.col("p")[1], ","), lambda t: F.length(F.trim(t)) > 0)).alias("t"))
    pair = F.split(F.trim("t"), ":")
    edges = near.select("a", pair[0].cast("double").cast("long").alias("b"), pair[1].cast("double").alias("weight"))
    return edges.where("a <> b").groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.min("weight").alias("weight"))


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    """``src string, dst string, weight double`` of ``a b w`` lines."""
    p = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.size(p) >= 3).select(p[0].alias("src"), p[1].alias("dst"), p[2].cast("double").alias("weight"))


def line_count(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def number_lines(lines: DataFrame) -> DataFrame:
    """``line_no, value`` from 0 in input order: partition totals first, then places inside partitions."""
    spark = lines.sparkSession
    marked = lines.select(F.monotonically_increasing_id().alias("m"), "value")
    part = F.shiftright("m", 33)
    totals = marked.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # one row per input split
    starts, at = [], 0
    for r in totals:
        starts.append((r.part, at))
        at += r.n
    offsets = F.broadcast(spark.createDataFrame(starts or [(0, 0)], "part long, start long"))
    numbered = marked.withColumn("part", part).join(offsets, "part")
    return numbered.select((F.col("start") + F.col("m") - F.shiftleft("part", 33)).alias("line_no"), "value")


def to_adjacency(edges: DataFrame) -> DataFrame:
    """``node, line``: symmetric ``node nbr:w,nbr:w`` lines, neighbours in ascending order."""
    both = edges.select("src", "dst", "weight").union(edges.select(F.col("dst"), F.col("src"), F.col("weight")))
    near = F.sort_array(F.collect_list(F.struct(F.col("dst").alias("n"), F.col("weight").alias("w"))))
    text = F.array_join(F.transform(near, lambda t: F.concat(t.n.cast("string"), F.lit(":"), t.w.cast("string"))), ",")
    return both.groupBy(F.col("src").alias("node")).agg(text.alias("t")).select("node", F.concat(F.col("node").cast("string"), F.lit(" "), "t").alias("line"))


def generate_samples(spark: SparkSession, variables: int, samples: int, low: int = 0, high: int = 1, seed: int = 1, endpoint_half: bool = False) -> DataFrame:
    """``var, xs`` of random whole numbers from ``low`` to ``high``; ``endpoint_half`` halves the end points' share."""
    span = high - low
    draw = (lambda u: F.round(u * span) + low) if endpoint_half else (lambda u: F.floor(u * (span + 1)) + low)
    # a value depends on the seed, the variable and the place only
    uniform = lambda v, i: F.pmod(F.xxhash64(v, i, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    xs = F.transform(F.sequence(F.lit(1), F.lit(samples)), lambda i: draw(uniform(F.col("id"), i)).cast("double"))
    return spark.range(variables).select(F.col("id").alias("var"), xs.alias("xs"))


def repeat_rows(obs: DataFrame, times: int) -> DataFrame:
    """Every row ``times`` times, with the number of the copy."""
    return obs.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def repeat_columns(obs: DataFrame, times: int) -> DataFrame:
    """Every row's values ``times`` times in a row."""
    return obs.withColumn("xs", F.flatten(F.array_repeat("xs", times)))


def log_density_lines(densities: DataFrame) -> DataFrame:
    """``obs_id, value``: natural logarithm of each density."""
    return densities.select("obs_id", F.ln("p").alias("value"))


def write_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def numbered_lines(lines: DataFrame) -> DataFrame:
    """``line`` of ``value`` lines: ``i,line`` with numbers from 0."""
    return number_lines(lines).select(F.concat(F.col("line_no").cast("string"), F.lit(","), "value").alias("line"))


def to_int_list(strings: Column) -> Column:
    return strings.cast("array<int>")
