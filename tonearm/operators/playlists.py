"""Playlist trees and the ordered lists in them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonearm.session import cut, store


def tree_paths(nodes: DataFrame) -> DataFrame:
    """(collection_id, node_id, path, depth) of every node below a root: names joined by a backslash, the root's left out.

    One join per level of the deepest tree; the frontier shrinks as branches end. Only
    folders are descended. A node whose parent is missing is in no tree.
    """
    n = nodes.select("collection_id", "node_id", "parent_id", "node_type", "node_name")
    level = cut(n.where("parent_id is null").select("collection_id", "node_id", F.lit("").alias("path"), F.lit(0).alias("depth")))
    out = []
    while not level.isEmpty():
        p = level.select("collection_id", F.col("node_id").alias("parent_id"), F.col("path").alias("above"), "depth")
        path = F.when(F.col("above") == "", F.coalesce("node_name", F.lit(""))).otherwise(F.concat_ws("\\", "above", F.coalesce("node_name", F.lit(""))))
        below = cut(n.join(p, ["collection_id", "parent_id"]).select("collection_id", "node_id", path.alias("path"), (F.col("depth") + 1).alias("depth"), "node_type"))
        out.append(below.drop("node_type"))
        level = below.where("node_type = 'FOLDER'").drop("node_type")
    found = n.where("false").select("collection_id", "node_id", F.lit("").alias("path"), F.lit(0).alias("depth"))
    for more in out:
        found = found.unionByName(more)
    return found


def summary(nodes: DataFrame, entries: DataFrame) -> DataFrame:
    """(collection_id, playlists, empty, misdeclared): counted by real entries, not by the declared number."""
    n = entries.groupBy("collection_id", "node_id").agg(F.count(F.lit(1)).alias("n"))
    lists = nodes.where("node_type = 'PLAYLIST'").join(n, ["collection_id", "node_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return lists.groupBy("collection_id").agg(
        F.count(F.lit(1)).alias("playlists"), F.count_if(F.col("n") == 0).alias("empty"), F.count_if(F.col("declared_entries") != F.col("n")).alias("misdeclared")
    )


def name_uniqueness(nodes: DataFrame) -> DataFrame:
    """(collection_id, node_id, node_name, unique_name) of folders, with ``node_path`` where the nodes have it; the root's own name counts as well."""
    w = Window.partitionBy("collection_id", "node_name")
    folders = nodes.where("node_type = 'FOLDER'").withColumn("unique_name", F.count(F.lit(1)).over(w) == 1)
    path = ["node_path"] if "node_path" in nodes.columns else []
    return folders.where("parent_id is not null").select("collection_id", "node_id", *path, "node_name", "unique_name")


def path_map(paths: DataFrame) -> DataFrame:
    """(collection_id, path, node_id): of nodes with the same path the last one."""
    return paths.groupBy("collection_id", "path").agg(F.max("node_id").alias("node_id"))


def redirect(entries: DataFrame, mapping: DataFrame) -> DataFrame:
    """Entries with every mapped key replaced; order and repeats stay."""
    return entries.join(mapping.select(F.col("old_key").alias("key"), "new_key"), "key", "left").withColumn("key", F.coalesce("new_key", "key")).drop("new_key")


def resolvable(entries: DataFrame, valid: DataFrame) -> DataFrame:
    """Entries whose key exists (``valid`` has key)."""
    return entries.join(valid.select("key").distinct(), "key", "left_semi")


def dropped(entries: DataFrame, valid: DataFrame) -> DataFrame:
    """(node_id, dropped_entries, dropped_tracks) of the playlists that lose entries."""
    lost = entries.join(valid.select("key").distinct(), "key", "left_anti")
    return lost.groupBy("node_id").agg(F.count(F.lit(1)).alias("dropped_entries"), F.count_distinct("key").alias("dropped_tracks"))


def ordered_union(base: DataFrame, incoming: DataFrame) -> DataFrame:
    """(node_id, pos, key): base entries as they are, repeats included, then incoming keys the base lacks, first seen first.

    ``incoming`` has (node_id, src, pos, key).
    """
    w = Window.partitionBy("node_id", "key").orderBy("src", "pos")
    new = incoming.withColumn("r", F.row_number().over(w)).where("r = 1").join(base.select("node_id", "key").distinct(), ["node_id", "key"], "left_anti")
    both = base.select("node_id", F.lit(False).alias("new"), F.lit(None).cast(new.schema["src"].dataType).alias("src"), "pos", "key")
    both = both.unionByName(new.select("node_id", F.lit(True).alias("new"), "src", "pos", "key"))
    return positions_within(both, "node_id", "new", "src", "pos").select("node_id", "pos", "key")


def positions_within(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """Rows with ``pos`` from 1 in each group, by the given columns.

    Rows are range-partitioned by group and order, so one huge group is numbered by many tasks: each counts its own part,
    and only the sizes of the parts are summed up.
    """
    by = [group, *order]
    ranged = store(rows.repartitionByRange(*by).withColumn("__range", F.spark_partition_id()))
    sizes = ranged.groupBy(group, "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.partitionBy(group).orderBy("__range")) - F.col("__n")).select(group, "__range", "__before")
    inside = ranged.withColumn("__at", F.row_number().over(Window.partitionBy(group, "__range").orderBy(*order)))
    return inside.join(before, [group, "__range"]).withColumn("pos", (F.col("__before") + F.col("__at")).cast("int")).drop("__range", "__before", "__at")


def same_sequence(a: DataFrame, b: DataFrame) -> DataFrame:
    """(node_id, same): whether the two key lists of a node, numbered from 1, are equal; a missing list is an empty one.

    Lists are compared place by place, so a long list is never gathered.
    """
    one = lambda df, n: df.select("node_id", "pos", F.col("key").alias(n), F.lit(True).alias("in_" + n))
    both = one(a, "a").join(one(b, "b"), ["node_id", "pos"], "full")
    return both.groupBy("node_id").agg(F.bool_and(F.col("in_a").isNotNull() & F.col("in_b").isNotNull() & F.col("a").eqNullSafe(F.col("b"))).alias("same"))


def pair_by_path(base: DataFrame, incoming: DataFrame) -> DataFrame:
    """(base_id, incoming_id, by): playlists paired by path, the rest by a name unique on both sides.

    Both have (node_id, path, name).
    """
    by_path = base.select(F.col("node_id").alias("base_id"), "path").join(incoming.select(F.col("node_id").alias("incoming_id"), "path"), "path").select("base_id", "incoming_id", F.lit("path").alias("by"))
    only = lambda df, gone, n: df.join(gone, df.node_id == gone.id, "left_anti").groupBy("name").agg(F.min("node_id").alias(n), F.count(F.lit(1)).alias("c")).where("c = 1").drop("c")
    left = only(base, by_path.select(F.col("base_id").alias("id")), "base_id")
    right = only(incoming, by_path.select(F.col("incoming_id").alias("id")), "incoming_id")
    return by_path.unionByName(left.join(right, "name").select("base_id", "incoming_id", F.lit("name").alias("by")))


def available_names(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """(ord, name, new_name): each wanted name, or `name (n)` with the least free n from 2, in order of ``ord``.

    Names can only collide within a family (the name without its numbers), so each family
    is settled by itself; names of a family that come earlier are taken for later ones.
    """
    family = F.regexp_replace("name", r"( \(\d+\))+$", "")
    both = wanted.select(family.alias("family"), "ord", "name", F.lit(False).alias("taken")).unionByName(
        taken.select(family.alias("family"), F.lit(0).cast("long").alias("ord"), "name", F.lit(True).alias("taken")).distinct()
    )

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        used = set(pdf.loc[pdf["taken"], "name"])
        rows, next_free = [], {}
        for ord_, name in pdf[~pdf["taken"]].sort_values("ord")[["ord", "name"]].itertuples(index=False):
            new, n = name, next_free.get(name, 2)
            while new in used:
                new = f"{name} ({n})"
                n += 1
            next_free[name] = n
            used.add(new)
            rows.append((ord_, name, new))
        return pd.DataFrame(rows, columns=["ord", "name", "new_name"])

    return both.groupBy("family").applyInPandas(settle, "ord long, name string, new_name string")


def positions(rows: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """Rows numbered from 1 in one global order, without bringing them into one task.

    Rows are range-partitioned and numbered within their range; only the sizes of the
    ranges are summed up in order.
    """
    ranged = store(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sizes = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).drop("__n")
    inside = ranged.withColumn("__at", F.row_number().over(Window.partitionBy("__range").orderBy(*order)))
    return inside.join(before, "__range").withColumn(name, F.col("__before") + F.col("__at")).drop("__range", "__before", "__at")


def carry_sorting(sorting: DataFrame, renamed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sorting rows with their new path, rows whose path is no playlist and does not start with `$`).

    ``sorting`` has (ord, path), ``renamed`` (old_path, new_path).
    """
    met = sorting.join(renamed, sorting.path == renamed.old_path, "left")
    kept = met.where("new_path is not null").select("ord", F.col("new_path").alias("path"))
    return kept, met.where("new_path is null and not startswith(path, '$')").select("ord", "path")


def split(nodes: DataFrame, entries: DataFrame, valid: DataFrame, names: list[str]) -> DataFrame:
    """(name, kept, total) of the named playlists: entries whose key exists, and all. Of equal names the last node is taken."""
    chosen = nodes.where((F.col("node_type") == "PLAYLIST") & F.col("node_name").isin(names)).groupBy("node_name").agg(F.max("node_id").alias("node_id"))
    keys = valid.select("key", F.lit(True).alias("ok")).distinct()
    own = entries.select("node_id", "key").join(keys, "key", "left")
    n = own.groupBy("node_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce("ok", F.lit(False))).alias("kept"))
    return chosen.join(n, "node_id", "left").select(F.col("node_name").alias("name"), F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("total", F.lit(0)).alias("total"))


def split_names(nodes: DataFrame, names: list[str]) -> list[str]:
    """The asked names that no playlist has, in the order asked; each once."""
    wanted = list(dict.fromkeys(names))
    have = {r[0] for r in nodes.where((F.col("node_type") == "PLAYLIST") & F.col("node_name").isin(wanted)).select("node_name").distinct().collect()} if wanted else set()
    return [n for n in wanted if n not in have]


def empty_lists(split_rows: DataFrame) -> DataFrame:
    """(name) of the split playlists that keep no entry."""
    return split_rows.where("kept = 0").select("name")
