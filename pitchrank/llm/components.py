"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from pitchrank.session import materialize


SHARE = 1 << 17     # links that a task takes
SMALL = 1 << 20     # links of which a value per node is broadcast


def components(links: DataFrame, n: int | None = None) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the component is its smallest node.

    Alternates two steps until every link leads to the smallest node of a star: each node's
    larger neighbours are linked to its smallest one, then its smaller ones are. A star is
    done at once, a chain in a number of steps that grows with the logarithm of its length.
    Only counts reach the driver; the links of each step are written and read back, by as
    many tasks as their number asks for; ``n`` is that number at first, if it is known roughly.
    """
    state, n = _written(_tidy(links), n)
    while not _stars(state, n):
        state, n = _written(_tidy(_small(_ordered(_large(state, n)), n)), n)
    # every link now leads from a node to the smallest of its component
    leaves = state.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return leaves.unionByName(state.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def _written(links: DataFrame, n: int | None) -> tuple[DataFrame, int]:
    """``links``, ``n`` of them or so, written and read back, and their number."""
    seen = Observation()
    few = links if n is None else gathered(links, n)
    state = materialize(few.observe(seen, F.count(F.lit(1)).alias("n")), "links")
    return state, seen.get["n"]


def gathered(df: DataFrame, n: int, share: int = SHARE) -> DataFrame:
    """``df`` of about ``n`` rows in one partition for each ``share`` of them, besides one for each core.

    All partitions are read as they are; a task takes several where there are more than that.
    """
    return df.coalesce(df.sparkSession.sparkContext.defaultParallelism + n // share)


def _stars(links: DataFrame, n: int) -> bool:
    """Whether no node is larger than two others, or both larger and smaller than others."""
    ends = links.select(F.col("b").alias("node"), F.lit(1).alias("n"), F.lit(0).alias("least")).unionByName(
        links.select(F.col("a").alias("node"), F.lit(0).alias("n"), F.lit(1).alias("least")))
    nodes = ends.groupBy("node").agg(F.sum("n").alias("n"), F.max("least").alias("least"))
    return gathered(nodes, n).agg(F.count_if(F.col("n") + F.col("least") > 1)).first()[0] == 0


def _per_node(least: DataFrame, n: int) -> DataFrame:
    least = gathered(least, n)
    return F.broadcast(least) if n <= SMALL else least


def _ordered(links: DataFrame) -> DataFrame:
    return links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _tidy(links: DataFrame) -> DataFrame:
    return _ordered(links).distinct()


def _large(links: DataFrame, n: int) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("least"))
    return both.join(_per_node(least, n), "a").where("b > a").select(F.col("least").alias("a"), "b")


def _small(links: DataFrame, n: int) -> DataFrame:
    # a < b throughout: the smaller neighbours of b
    least = links.groupBy("b").agg(F.min("a").alias("least"))
    joined = links.join(_per_node(least, n), "b")
    return joined.select(F.col("least").alias("a"), "b").unionByName(
        joined.select(F.col("least").alias("a"), F.col("a").alias("b")))
