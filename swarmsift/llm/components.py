"""Connected components of an edge table by alternating star contractions.

Large-star links every larger neighbour of a node to the smallest of its
neighbours, small-star the smaller neighbours and the node itself; both
together turn each component into a star around its smallest id in a number of
rounds that grows with the logarithm of the component's size.  Each round is
two aggregations and joins, written to the shared folder.  The number of tasks
that end a step grows with the edges (``TASK_EDGES`` each, ``LEAST_TASKS`` or
more), so that a few thousand edges are not written as hundreds of files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


TASK_EDGES, LEAST_TASKS = 100_000, 12


def _star(edges: DataFrame, low: DataFrame) -> DataFrame:
    """For (u, v) with the smallest id m around u: links (v, m)."""
    return edges.join(low, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).filter("u <> v")


def _all_stars(e: DataFrame, tasks: int) -> bool:
    """Whether every node has one smaller neighbour and no larger one, or the reverse."""
    ends = e.select(F.col("u").alias("id"), F.lit(1).alias("up")).unionByName(e.select(F.col("v").alias("id"), F.lit(0).alias("up")))
    seen = ends.groupBy("id").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    open_ = F.max(((F.col("ups") > 1) | ((F.col("ups") > 0) & (F.col("least") == 0))).cast("int"))
    return seen.coalesce(tasks).agg(open_).first()[0] != 1


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component_id) of every id that has an edge; component_id is the smallest id reachable."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    e = cut_lineage(e, "edges")
    tasks = max(LEAST_TASKS, -(-e.count() // TASK_EDGES))  # coalesce never makes more than there are
    while not _all_stars(e, tasks):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cut_lineage(_star(both.filter("v > u"), low).coalesce(tasks), "large_star")
        # Here u > v in every row: v is a smaller neighbour of u, and u itself links to the smallest too.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _star(large, low).coalesce(tasks).unionByName(low.select("u", F.col("m").alias("v")).coalesce(tasks)).distinct()
        e = cut_lineage(small.coalesce(tasks), "small_star")
    # Every edge now joins a node to its component's smallest id.
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(roots)
