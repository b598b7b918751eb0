"""Connected components by alternating large-star and small-star steps.

A step rewires every vertex to the least vertex around it, so a chain of n records is
flat after about log n rounds. Minima are partially aggregated before the shuffle; each
round is cut, so lineage and lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.session import cut


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def propagate(edges: DataFrame) -> DataFrame:
    """(id, group_id) of every vertex that is not the least of its component; group_id is the least."""
    stars, mark = edges, None
    while True:
        around = both_ways(stars)
        low = around.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("low"))
        large = (
            around.where("dst > src").join(low, "src").select(F.col("low").alias("src"), "dst").where("src <> dst").distinct()
        )
        # Here every edge runs from the smaller to the larger vertex.
        low = large.groupBy("dst").agg(F.min("src").alias("low"))
        small = large.join(low, "dst")
        small = (
            small.select(F.col("low").alias("src"), "dst")
            .unionByName(small.where("src <> low").select(F.col("low").alias("src"), F.col("src").alias("dst")))
            .where("src <> dst")
            .distinct()
        )
        stars = cut(small)
        now = stars.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("src", "dst"))).first()
        if tuple(now) == mark:
            return stars.select(F.col("dst").alias("id"), F.col("src").alias("group_id"))
        mark = tuple(now)


def components(edges: DataFrame) -> DataFrame:
    """(id, group_id) of every vertex of ``edges`` (src, dst) that is linked to another."""
    clean = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    found = propagate(clean)
    return found.unionByName(found.select(F.col("group_id").alias("id"), "group_id").distinct())
