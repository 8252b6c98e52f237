"""Key sets and sketches of a graph's terms, for finding where graphs overlap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.operators.graph import Graph

SKETCH = 65_536


def key_set(graph: Graph, roles: tuple[str, ...] = ("s", "o")) -> DataFrame:
    """(section, key): a 64-bit key for each term, by the section of the dictionary it is in."""
    own = graph.terms().filter(reduce(lambda a, b: a | b, [F.col(f"in_{r}") for r in roles]))
    return own.select("section", F.xxhash64("term").alias("key"))


def bottom_keys(graph: Graph, k: int = SKETCH) -> DataFrame:
    """The k smallest keys: a bottom-k sketch of the terms."""
    return key_set(graph).select("key").distinct().orderBy("key").limit(k)


def resemblance(a: DataFrame, b: DataFrame, k: int = SKETCH) -> DataFrame:
    """(shared, size, estimate) from two bottom-k sketches of one column, key."""
    union = a.select("key", F.lit(1).alias("a"), F.lit(0).alias("b")).union(b.select("key", F.lit(0).alias("a"), F.lit(1).alias("b")))
    low = union.groupBy("key").agg(F.max("a").alias("a"), F.max("b").alias("b")).orderBy("key").limit(k)
    return low.agg(F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("shared"), F.count(F.lit(1)).alias("size")).withColumn("estimate", F.col("shared") / F.col("size"))


def overlap(a: Graph, b: Graph) -> DataFrame:
    """Terms that both graphs hold as subject or object."""
    sides = [g.terms().filter("in_s OR in_o").select("term") for g in (a, b)]
    return sides[0].intersect(sides[1])


def distinct_estimate(graph: Graph, column: str = "o") -> DataFrame:
    """An estimate of the distinct terms in a position, by a theta sketch."""
    return graph.triples.agg(F.expr(f"theta_sketch_estimate(theta_sketch_agg(xxhash64({column})))").alias("estimate"))
