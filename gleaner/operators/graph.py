"""Connected components over an edge DataFrame, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.sources.shared import checkpoint


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of the undirected graph ``edges(a, b)`` over any orderable ids.

    Returns ``(node, root)``, one row for each id that has an edge to another id; root is the
    smallest id of its component. Null ends and self loops are ignored. Large-star and
    small-star steps (Kiveris et al., 2014) alternate until every component is a star; the
    number of rounds grows with the logarithm of the longest chain. Each round is
    checkpointed, so that a lost executor recomputes one round only.
    """
    now = checkpoint(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct()
    )
    state = _digest(now)
    while state[0]:
        now = checkpoint(_small_star(_large_star(now)))
        after = _digest(now)
        if after == state:
            break
        state = after
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(roots)


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(hi, lo))").alias("x")).first()
    return row["n"], row["x"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
        edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    )
    # The minima are a table of their own: the edges of a node with many then meet them in a plain join of two
    # shuffles, whose crowded partitions the adaptive plan can split.
    least = checkpoint(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.where("v > u").hint("merge").join(least, "u").where("v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()
