"""Connected components of a link table, by alternating large and small stars.

Every round points each node at the least node known near it; rounds are written to the shared folder, so lineage
stays short, and end when a round changes nothing.  No node's links are gathered in one place: minima are aggregated
before they are joined back, and those of nodes with many links are broadcast to where the links are.

Cases: an empty table has no components; links of a node with itself and repeated links add nothing; links with a null
end are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved, spread_join


def _sum(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
    return int(row[0]), int(row[1])


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node that has a link to another; the component is its least node."""
    edges = saved(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    state = _sum(edges)
    while state[0]:
        both, rows = edges.union(edges.select(F.col("v"), F.col("u"))), 2 * state[0]
        least = saved(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "least")
        large = saved(spread_join(both, least, ["u"], total=rows).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        lowest = saved(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "lowest")
        small = spread_join(large, lowest, ["u"], total=rows).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, edges = edges, saved(small.union(lowest.select("u", F.col("m").alias("v"))).distinct(), "links")
        discard(old, least, large, lowest)
        before, state = state, _sum(edges)
        if state == before:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
