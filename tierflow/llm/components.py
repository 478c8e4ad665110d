"""Connected components of a graph given by its links, by the large-star and small-star steps.

Each step links a vertex's neighbours to the smallest of them; links that already point there stay.
When a round changes nothing, every vertex is linked to the smallest vertex of its component.
All state is a table of links in the shared folder; a round costs a few shuffles of it, and
rounds grow with the logarithm of the largest component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierflow.workspace import durable


def _least(links: DataFrame) -> DataFrame:
    """Each vertex's smallest neighbour or itself; partial sums keep a vertex with many links light."""
    return links.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))


def _both_ways(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours are linked to the smallest one."""
    both = _both_ways(links)
    joined = both.where("b > a").join(_least(both), "a")
    return joined.select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Smaller neighbours and the vertex are linked to the smallest one."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _least(down)
    joined = down.join(least, "a")
    neighbours = joined.select(F.col("b").alias("a"), F.col("least").alias("b"))
    return neighbours.unionByName(least.select("a", F.col("least").alias("b"))).where("a <> b").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """Rows (vertex, component) of all vertices of ``links`` (a, b); a component is its smallest vertex.

    Links with a null end are passed over, links to itself and repeated ones make no difference.
    """
    state = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    state = durable(state.where("a <> b").distinct())
    seal = None
    while True:
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == seal:
            break
        seal = tuple(now)
        state = durable(_small_star(_large_star(state)))
    roots = state.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct()
    return state.select(F.col("a").alias("vertex"), F.col("b").alias("component")).unionByName(roots)
