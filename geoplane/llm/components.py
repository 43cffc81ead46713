"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _star(pairs: DataFrame, own: bool) -> DataFrame:
    """Link what ``pairs`` (u, v) gives for each u, and u itself if ``own``, to the least of them. A sum by key and a join: hubs can be split."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    out = pairs.join(least, "u").select("u", "v", "m")
    ends = F.array("u", "v") if own else F.array("v")
    return out.select(F.explode(ends).alias("u"), F.col("m").alias("v")).filter("u <> v")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (u, v: bigint); root is the least node that can be reached.

    Each round links, for every node, its larger neighbours to its least neighbour, then its smaller neighbours and
    itself to the least of these; it ends when nothing changes, after a number of rounds that grows with the
    logarithm of the longest chain. Each round is written to the shared folder. Self links and nulls are left out.
    """
    links = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    links, before = saved(links, "links"), None
    while True:
        print_of = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if print_of == before or not print_of[0]:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                links.select(F.col("v").alias("node"), F.col("v").alias("root"))
            ).distinct()
        before = print_of
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        links = saved(_star(large, True).distinct(), "links")
