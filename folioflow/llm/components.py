"""Connected components of a link table by alternating large-star and small-star steps, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import stored

#: Edges that a task handles at least: rounds on few edges are not spread over all partitions.
TASK_ROWS = 100_000


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """links (a, b: long) to (node, root): root is the smallest node that can be reached; only nodes with links appear.

    Both steps are joins on minima with partial aggregation; a hub's neighbours are never gathered in one place. Defined
    results: repeated links and links in both directions count once, links of a node with itself and those with a null end
    not at all; no links give no rows; the rounds end when a round changes nothing.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = stored(edges, "edges")
    before = _sum(edges)
    while before[0]:
        tasks = -(-2 * before[0] // TASK_ROWS)  # no table of a round has more than both directions of the edges
        kept = lambda df, name, n=tasks: stored(df.coalesce(n), name)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = kept(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "large-min")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = kept(large, "large-star")
        least = kept(large.groupBy("u").agg(F.min("v").alias("m")), "small-min")
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        edges = kept(small.filter("u <> v").distinct(), "small-star")
        after = _sum(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
