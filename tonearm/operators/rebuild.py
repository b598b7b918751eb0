"""Rebuilding playlists from other collections, and importing those that the base does not have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.operators import playlists
from tonearm.session import store


def duplicate_paths(base: DataFrame, incoming: DataFrame) -> DataFrame:
    """(path): paths that stand twice in the base or in one input and on the other side too; they stop a run.

    ``base`` has (node_id, path, name), ``incoming`` (src, node_id, path, name).
    """
    own = base.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    theirs = incoming.groupBy("src", "path").agg(F.count(F.lit(1)).alias("n")).groupBy("path").agg(F.max("n").alias("most"))
    return own.join(theirs, "path").where("n > 1 or most > 1").select("path")


def pairs(base: DataFrame, incoming: DataFrame) -> DataFrame:
    """(base_id, src, incoming_id, path): by path; where the base's path has no counterpart, by a name that one playlist of
    each side has."""
    b = base.select(F.col("node_id").alias("base_id"), "path", "name")
    i = incoming.select("src", F.col("node_id").alias("incoming_id"), "path", "name")
    by_path = b.join(i.drop("name"), "path").select("base_id", "src", "incoming_id", "path")
    once = i.groupBy("name").agg(F.min(F.struct("src", "incoming_id")).alias("i"), F.count(F.lit(1)).alias("n")).where("n = 1").select("name", "i.src", "i.incoming_id")
    alone = b.groupBy("name").agg(F.min(F.struct("base_id", "path")).alias("b"), F.count(F.lit(1)).alias("n")).where("n = 1").select("name", "b.base_id", "b.path")
    by_name = alone.join(i.select("path").distinct(), "path", "left_anti").join(once, "name").select("base_id", "src", "incoming_id", "path")
    return by_path.unionByName(by_name)


def reconstruct(base: DataFrame, base_entries: DataFrame, incoming: DataFrame, incoming_entries: DataFrame, mapping: DataFrame, valid: DataFrame, ambiguous: DataFrame) -> dict[str, DataFrame]:
    """Frames of a rebuild: `entries` (node_id, pos, key) of the playlists that change, `dropped` (node_id, key) references
    to no entry, `counts` (node_id, path, entries, added, on_duplicated, was_empty) and `stats` (counter, value).

    Entries are (node_id, pos, key), those of inputs with src; ``mapping`` (old_key, new_key) redirects keys, ``valid``
    (key) is what the output holds, ``ambiguous`` (key) are keys without a single target. Base entries come first with
    their repeats, then keys the base lacks, first seen first over inputs, nodes and places. A playlist whose keys equal
    those of its counterparts stays as it is.
    """
    met = store(pairs(base, incoming))
    own = playlists.redirect(base_entries.select("node_id", "pos", "key"), mapping).select("node_id", "pos", "key")
    raw = incoming_entries.join(met.select("src", F.col("incoming_id").alias("node_id"), "base_id"), ["src", "node_id"])
    # One order over inputs, their nodes and places.
    placed = raw.select(F.col("base_id").alias("node_id"), F.struct("src", F.col("node_id").alias("n"), "pos").alias("src"), F.lit(0).alias("pos"), "key")
    marked = placed.join(ambiguous.select("key", F.lit(True).alias("unclear")).distinct(), "key", "left")
    theirs = store(playlists.redirect(marked, mapping).select("node_id", "src", "pos", "key", "unclear"))
    held = store(own.join(met.select(F.col("base_id").alias("node_id")).distinct(), "node_id", "left_semi"))
    first = theirs.groupBy("node_id", "key").agg(F.min("src").alias("src"))
    numbered = playlists.ordered_union(held.limit(0), first.withColumn("pos", F.lit(0)))
    same = playlists.same_sequence(held_numbers(held), numbered)
    changed = store(met.select(F.col("base_id").alias("node_id")).distinct().join(same.where("same"), "node_id", "left_anti"))
    union = held.select("node_id", F.lit(False).alias("fresh"), F.lit(None).cast(theirs.schema["src"].dataType).alias("src"), "pos", "key")
    fresh = first.join(held.select("node_id", "key").distinct(), ["node_id", "key"], "left_anti").select("node_id", F.lit(True).alias("fresh"), "src", F.lit(0).alias("pos"), "key")
    rows = union.unionByName(fresh).join(changed, "node_id", "left_semi")
    rows = store(rows.join(valid.select("key", F.lit(True).alias("known")).distinct(), "key", "left"))
    kept = rows.where("known").select("node_id", "src", F.col("pos").alias("place"), "key", "fresh")
    unclear = theirs.where("unclear").select("node_id", "key").distinct().withColumn("unclear", F.lit(True))
    numbers = playlists.positions_within(kept, "node_id", "fresh", "src", "place")
    counts = kept.join(unclear, ["node_id", "key"], "left").groupBy("node_id").agg(
        F.count(F.lit(1)).alias("entries"), F.count_if("fresh").alias("added"), F.count_if(F.coalesce("unclear", F.lit(False))).alias("on_duplicated")
    )
    empty = base.join(own.select("node_id").distinct(), "node_id", "left_anti").select("node_id", F.lit(True).alias("was_empty"))
    counts = store(changed.join(base.select("node_id", "path"), "node_id").join(counts, "node_id", "left").join(empty, "node_id", "left").na.fill({"entries": 0, "added": 0, "on_duplicated": 0, "was_empty": False}))
    unfilled = empty.join(counts.select("node_id"), "node_id", "left_anti").agg(F.count(F.lit(1)).alias("v"))
    told = counts.agg(
        F.count(F.lit(1)).alias("playlists_reconstructed"), F.coalesce(F.sum("added"), F.lit(0)).alias("playlist_entries_added"), F.coalesce(F.sum("on_duplicated"), F.lit(0)).alias("entries_on_duplicated_tracks"),
        F.count_if("was_empty").alias("refilled_playlists"),
    )
    named = F.inline(F.array(*[F.struct(F.lit(c).alias("counter"), F.col(c).cast("long").alias("value")) for c in told.columns]))
    stats = told.select(named).unionByName(unfilled.select(F.lit("unfilled_playlists").alias("counter"), F.col("v").alias("value")))
    return {"entries": numbers.select("node_id", "pos", "key"), "dropped": rows.where("known is null").select("node_id", "key"), "counts": counts, "stats": stats}


def held_numbers(entries: DataFrame) -> DataFrame:
    """Entries numbered from 1 within their playlist."""
    return playlists.positions_within(entries.select("node_id", F.col("pos").alias("src"), "key"), "node_id", "src").select("node_id", "pos", "key")


def import_playlists(nodes: DataFrame, entries: DataFrame, taken: DataFrame, mapping: DataFrame, valid: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lists, entries, dropped) of playlists that are put flat beside those of the base.

    ``nodes`` (ord, node_id, name) in order; ``taken`` (name) are names in use. lists: (ord, node_id, name, new_name,
    renamed, verbatim): a playlist with its own name, no redirected and no missing key is copied as it stands. entries:
    (node_id, pos, key) redirected and without keys outside ``valid`` (key); dropped: (node_id, key).
    """
    named = playlists.available_names(nodes.select("ord", "name"), taken)
    moved = entries.select("node_id", "pos", F.col("key").alias("raw"), "key")
    moved = playlists.redirect(moved, mapping).join(valid.select("key", F.lit(True).alias("known")).distinct(), "key", "left")
    moved = store(moved.select("node_id", "pos", "raw", "key", F.coalesce("known", F.lit(False)).alias("known")))
    touched = moved.groupBy("node_id").agg(F.bool_or((F.col("raw") != F.col("key")) | ~F.col("known")).alias("touched"))
    lists = nodes.join(named.select("ord", "new_name"), "ord").join(touched, "node_id", "left")
    renamed = F.col("name") != F.col("new_name")
    lists = lists.select("ord", "node_id", "name", "new_name", renamed.alias("renamed"), (~renamed & ~F.coalesce("touched", F.lit(False))).alias("verbatim"))
    kept = playlists.positions_within(moved.where("known").select("node_id", F.col("pos").alias("src"), "key"), "node_id", "src")
    return lists, kept.select("node_id", "pos", "key"), moved.where("not known").select("node_id", "key")
