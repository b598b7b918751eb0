"""Pairwise matches consolidated into identity groups.

The component of the highest-degree vertex is peeled off by frontier breadth-first
joins and anti-joined away; what remains are small components, labelled by minimum
propagation (alternating large-star and small-star steps, so a chain of n records
needs about log n rounds, not n).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.operators.components import both_ways, propagate
from tonearm.session import cut

#: Frontier rounds before the search is given up and what it reached is contracted
#: to one vertex; minimum propagation then finishes the component exactly.
MAX_FRONTIER_ROUNDS = 12


def shared_value_edges(records: DataFrame, id_col: str, value_col: str, salts: int = 64) -> DataFrame:
    """Edges (src, dst) from each record to the least record holding the same text.

    Null and empty values link nothing. The minimum is taken per (value, salt) and then
    over the at most ``salts`` rows of a value, so a value held by a third of all rows
    is neither gathered nor joined in one task.
    """
    held = records.select(F.col(id_col).alias("v"), F.col(value_col).alias("value")).where(
        F.col("v").isNotNull() & (F.col("value") != "")
    )
    held = held.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int"))
    part = held.groupBy("value", "salt").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    least = (
        part.groupBy("value")
        .agg(F.min("low").alias("root"), F.max("high").alias("top"), F.collect_list("salt").alias("salts"))
        .where("root < top")
        .select("value", "root", F.explode("salts").alias("salt"))
    )
    return held.join(least, ["value", "salt"]).where("v > root").select(F.col("root").alias("src"), F.col("v").alias("dst"))


def pair_edges(pairs: DataFrame, ids: DataFrame, left: str, right: str) -> DataFrame:
    """Distinct edges of the pairs whose two ids both exist; self pairs and nulls link nothing."""
    known = ids.toDF("id").where("id is not null")
    edges = (
        pairs.select(F.least(left, right).alias("src"), F.greatest(left, right).alias("dst"))
        .where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
        .distinct()
    )
    edges = edges.join(known, edges.src == known.id, "left_semi")
    return edges.join(known, edges.dst == known.id, "left_semi")


def _peel(edges: DataFrame, rounds: int) -> tuple[DataFrame | None, DataFrame]:
    """(members of the peeled component as (id, group_id), the edges left)."""
    # One row reaches the driver: the vertex where the search starts.
    start = (
        both_ways(edges).groupBy("src").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "src").limit(1).collect()
    )
    if not start:
        return None, edges
    links = cut(both_ways(edges).distinct())
    frontier = seen = edges.sparkSession.range(start[0]["src"], start[0]["src"] + 1).toDF("v")
    ended = False
    for _ in range(rounds):
        reached = links.join(frontier, links.src == frontier.v, "left_semi").select(F.col("dst").alias("v")).distinct()
        frontier = cut(reached.join(seen, "v", "left_anti"))
        if frontier.isEmpty():
            ended = True
            break
        seen = seen.unionByName(frontier)
    seen = cut(seen)
    low = seen.agg(F.min("v")).first()[0]
    members = seen.select(F.col("v").alias("id"), F.lit(low).cast("long").alias("group_id"))
    one_way = links.where("src < dst")
    if ended:
        return members, one_way.join(seen, one_way.src == seen.v, "left_anti")
    # The search was cut short: stand its part in for one vertex and let propagation go on.
    for end in ("src", "dst"):
        one_way = one_way.join(seen, one_way[end] == seen.v, "left").withColumn(
            end, F.when(F.col("v").isNotNull(), F.lit(low)).otherwise(F.col(end))
        ).drop("v")
    star = members.where(F.col("id") != low).select(F.col("group_id").alias("src"), F.col("id").alias("dst"))
    rest = one_way.where("src <> dst").unionByName(star)
    return None, rest.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))


def consolidate(edges: DataFrame, rounds: int = MAX_FRONTIER_ROUNDS) -> DataFrame:
    """One row (id, group_id) for each vertex of ``edges`` (src, dst); group_id is the
    least id of the component. Rows with a null end, repeated and self edges add nothing;
    without edges the result is empty. Order and direction of the edges do not matter."""
    edges = edges.select("src", "dst").where("src <> dst")
    giant, rest = _peel(edges, rounds)
    small = propagate(rest)
    small = small.unionByName(small.select(F.col("group_id").alias("id"), "group_id").distinct())
    return small if giant is None else giant.unionByName(small)


def identity_groups(entries: DataFrame, pairs: DataFrame) -> DataFrame:
    """Groups of two or more entries joined by matched pairs or an equal audio_id.

    Null ids, pairs of another outcome, ids without an entry and null or empty audio_ids
    link nothing. Extra columns are ignored; empty tables give no rows.
    """
    by_audio = shared_value_edges(entries, "entry_id", "audio_id")
    by_pair = pair_edges(pairs.where("outcome = 'matched'"), entries.select("entry_id"), "left_id", "right_id")
    edges = cut(by_pair.unionByName(by_audio))
    return consolidate(edges).select(F.col("id").alias("entry_id"), "group_id")
