"""Connected components of an undirected graph by alternating large and small stars.

In a large star each vertex links its larger neighbours to the least of its neighbours and itself; in a small star it
links its smaller neighbours and itself to the least of them. Both keep the components; they end with a star around the
least vertex of each, after a number of rounds that grows with the logarithm of the size. Each round is a few
aggregations and joins on edges, written to the shared folder; only whether they are stars comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import discard, materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v), u > v once for each edge."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
    else:
        both = edges.select("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("_m")).select(F.col("u").alias("_c"), F.least("u", "_m").alias("_m"))
    joined = both.join(least, both["u"] == least["_c"])
    if large:
        linked = joined.where("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v"))
    else:
        linked = joined.select(F.col("v").alias("u"), F.col("_m").alias("v")).union(least.select(F.col("_c").alias("u"), F.col("_m").alias("v")))
    return linked.where("u > v").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether each vertex with a smaller neighbour has no other one: then it hangs on the least of its component."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("hangs")).union(edges.select("v", F.lit(0)))
    return ends.groupBy("x").agg(F.sum("hangs").alias("_h"), F.count("*").alias("_n")).where("_h > 0 AND _n > 1").isEmpty()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, component) for each vertex of a link to another one; component is the least vertex. No rows without links;
    links of a vertex to itself and repeated ones change nothing, nulls are passed over."""
    edges = materialise(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("u > v").distinct(), "edges")
    while not _are_stars(edges):
        new = materialise(_star(_star(edges, True), False), "edges")
        discard(edges)
        edges = new
    centres = edges.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("component")).union(centres)
