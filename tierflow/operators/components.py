"""Connected components: who is the same over any number of shared keys.

Every vertex points to the smallest it has heard of. In a round each vertex tells its neighbours its own pointer, and pointers are
followed once more to where they lead, so that a chain of n vertices takes about log n rounds and not n. The state is a
table of the shared folder; a round is a few shuffles of it, with partial minima, so that a vertex with very
many neighbours is one row of each task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tierflow.workspace import durable


def components(links: DataFrame) -> DataFrame:
    """Rows (vertex, component) of all vertices of ``links`` (a, b): the smallest vertex of each component. Links with a null end
    are passed over."""
    known = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    edges = durable(known.unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = durable(edges.groupBy(F.col("a").alias("vertex")).agg(F.least(F.col("a"), F.min("b")).alias("component")))
    while True:
        told = edges.join(state.withColumnRenamed("vertex", "b"), "b").groupBy(F.col("a").alias("vertex")).agg(F.min("component").alias("heard"))
        heard = state.join(told, "vertex").select("vertex", F.col("component").alias("old"), F.least("component", "heard").alias("next"))
        # What the old pointer's vertex has heard holds for all that point to it.
        told_roots = heard.groupBy("old").agg(F.min("next").alias("of_root"))
        lower = durable(heard.join(told_roots, "old").select("vertex", F.col("old"), F.least("next", "of_root").alias("component")))
        further = lower.select(F.col("vertex").alias("component"), F.col("component").alias("leads_to"))
        followed = durable(lower.join(further, "component", "left").select("vertex", "old", F.coalesce("leads_to", "component").alias("component")))
        state = followed.select("vertex", "component")
        if followed.where("old <> component").isEmpty():
            return state


def shared_key_links(records: DataFrame, record: str, keys: Sequence[str]) -> DataFrame:
    """Links (a, b) between each record and the smallest one with the same value of a key, for each of ``keys``. A value that very many
    records share gives as many links as it has records, and no pair more. Null keys link nothing."""
    links = None
    for key in keys:
        held = records.where(F.col(key).isNotNull()).select(F.col(record).alias("a"), F.col(key).alias("_key"))
        first = held.groupBy("_key").agg(F.min("a").alias("b"))
        found = held.join(first, "_key").select("a", "b")
        links = found if links is None else links.unionByName(found)
    return links


def resolve_records(records: DataFrame, record: str, keys: Sequence[str], name: str = "person_id") -> DataFrame:
    """``records`` with the smallest record that shared values of any of ``keys`` lead to, over any number of steps, in ``name``."""
    found = components(shared_key_links(records, record, keys)).toDF("_vertex", "_component")
    joined = records.join(found, F.col(record) == F.col("_vertex"), "left")
    return joined.withColumn(name, F.coalesce("_component", record)).drop("_vertex", "_component")
