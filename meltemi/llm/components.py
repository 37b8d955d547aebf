"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meltemi.llm.frames import settled


def _stars(edges: DataFrame, *, small: bool) -> DataFrame:
    """One contraction of edges (a, b), b < a.

    Large star: every larger neighbour of a node is linked with the node's smallest neighbour. Small star: the node and its smaller neighbours
    are. Minima are aggregated in the tasks first, so a centre of many links costs no task more than others.
    """
    both = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("_n"), F.least("_n", "m").alias("m"))
    joined = both.join(least, F.col("a") == F.col("_n"))
    if small:
        moved = joined.select(F.col("b").alias("x"), F.col("m")).unionByName(least.select(F.col("_n").alias("x"), "m"))
    else:
        moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("x"), F.col("m"))
    return moved.where(F.col("x") > F.col("m")).select(F.col("x").alias("a"), F.col("m").alias("b"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, *, rounds: int | None = None) -> DataFrame:
    """Rows (``node``, ``component``) of every node that has a link in (``a``, ``b``): the smallest node reachable.

    Rounds grow with the logarithm of the links. Each is written to the shared folder; only a count and a checksum come to the driver. With a number of ``rounds`` it stops
    there: nodes of one component may then still have several, never nodes of two components the same one.
    """
    start = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    # A round makes no more edges than there are links: few links need few tasks, whatever the number of shuffle partitions.
    tasks = 8 + links.count() // 50_000
    edges = settled(start.coalesce(tasks), "links")
    last, done = None, 0
    while rounds is None or done < rounds:
        edges = settled(_stars(_stars(edges, small=False).coalesce(tasks), small=True).coalesce(tasks).distinct().coalesce(tasks), "stars")
        done += 1
        now = _state(edges) if rounds is None else None
        if now is not None and now == last:
            break
        last = now
    # A node may still have several smaller neighbours when rounds ran out.
    named = edges.groupBy("a").agg(F.min("b").alias("b"))
    roots = named.select(F.col("b").alias("node")).distinct().join(named.select(F.col("a").alias("node")), "node", "left_anti")
    return named.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
