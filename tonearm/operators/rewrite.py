"""Rewriting locations and references: by rules, and by the matches with another collection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonearm.functions import paths


@dataclass(frozen=True)
class Rule:
    """Locations on ``old_volume`` below ``old_prefix`` move to ``new_volume`` and ``new_prefix``."""

    old_volume: str
    old_prefix: str
    new_volume: str
    new_prefix: str
    new_volumeid: str | None = None


def apply_rules(volume: Column, volumeid: Column, dir_value: Column, rules: list[Rule]) -> Column:
    """struct(volume, volumeid, dir, hit): the first rule that fits wins; nothing fits, nothing changes."""
    out = F.struct(volume.alias("volume"), volumeid.alias("volumeid"), dir_value.alias("dir"), F.lit(False).alias("hit"))
    for r in reversed(rules):
        fits = F.coalesce((volume == r.old_volume) & dir_value.startswith(r.old_prefix), F.lit(False))
        moved = F.struct(
            F.lit(r.new_volume).alias("volume"),
            F.lit(r.new_volume if r.new_volumeid is None else r.new_volumeid).alias("volumeid"),
            F.concat(F.lit(r.new_prefix), F.substring(dir_value, len(r.old_prefix) + 1, 1 << 30)).alias("dir"),
            F.lit(True).alias("hit"),
        )
        out = F.when(fits, moved).otherwise(out)
    return out


def rewrite_locations(records: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rid, old_key, new_key, changes): changes lists the attributes that differ."""
    to = apply_rules(F.col("volume"), F.coalesce("volumeid", "volume"), F.col("dir"), rules)
    moved = records.withColumn("to", to)
    diff = F.filter(
        F.array(
            F.when(F.col("volume") != F.col("to.volume"), F.lit("VOLUME")),
            F.when(F.coalesce("volumeid", "volume") != F.col("to.volumeid"), F.lit("VOLUMEID")),
            F.when(F.col("dir") != F.col("to.dir"), F.lit("DIR")),
        ),
        lambda c: c.isNotNull(),
    )
    return moved.select(
        "rid", F.col("primary_key").alias("old_key"), paths.primary_key(F.col("to.volume"), F.col("to.dir"), F.col("file")).alias("new_key"),
        F.array_join(diff, ",").alias("changes"), F.col("to.hit").alias("hit"),
    )


def rewrite_keys(entries: DataFrame, mapping: DataFrame, rules: list[Rule]) -> DataFrame:
    """Entries with (new_key, how): mapped by the collection, else by rule, else unchanged.

    ``mapping`` has (old_key, new_key), one row per key. A key that is no key stays as it is.
    """
    m = mapping.select(F.col("old_key").alias("key"), F.col("new_key").alias("mapped"))
    parts = paths.parse_key(F.col("key"))
    to = apply_rules(parts["volume"], parts["volume"], parts["dir"], rules)
    by_rule = F.when(parts.isNotNull() & to["hit"], paths.primary_key(to["volume"], to["dir"], parts["file"]))
    how = F.when(F.col("mapped").isNotNull(), "collection").when(by_rule.isNotNull(), "rule").otherwise("unchanged")
    return entries.join(m, "key", "left").withColumn("new_key", F.coalesce("mapped", by_rule, "key")).withColumn("how", how).drop("mapped")


def compare_mapping(matched: DataFrame) -> DataFrame:
    """(old_key, new_key) of the matches; of repeated old keys the last record counts."""
    return matched.where("outcome = 'matched'").groupBy(F.col("primary_key").alias("old_key")).agg(F.max_by("new_key", "rid").alias("new_key"))


def infer_volume(records: DataFrame, root: list[str]) -> DataFrame:
    """(volume, volumeid) of the records below a scan root; more than one row means that it cannot be told."""
    parts = paths.folder_parts(F.col("dir"))
    below = F.slice(parts, 1, len(root)) == F.array(*[F.lit(p) for p in root]) if root else F.lit(True)
    return records.where(below).select("volume", F.coalesce("volumeid", "volume").alias("volumeid")).distinct()


def scan_root_of(paths_df: DataFrame, roots: list[str]) -> DataFrame:
    """(path, root): the first listed root that contains the path, null without one."""
    hit = F.lit(None).cast("string")
    for r in reversed(roots):
        hit = F.when(F.col("path").startswith(r.rstrip("/") + "/"), F.lit(r)).otherwise(hit)
    return paths_df.select("path", hit.alias("root"))


def encode_location(path: Column, anchor: str, volume: str) -> Column:
    """Key of a file on disk: anchor off, folders encoded, volume in front."""
    rel = F.regexp_replace(path, "^" + anchor, "")
    folder = F.regexp_replace(rel, "/?[^/]*$", "")
    return F.concat(F.lit(volume), paths.encode_dir(folder), F.substring_index(rel, "/", -1))


def overlay_decisions(mapping: DataFrame, decisions: DataFrame) -> DataFrame:
    """Mapping after a reviewer: per key the last decision holds; `accept` sets the picked key, `leave` removes, `undo` forgets.

    ``decisions`` has (old_key, seq, decision, pick).
    """
    last = decisions.groupBy("old_key").agg(F.max_by(F.struct("decision", "pick"), "seq").alias("d"))
    both = mapping.join(last, "old_key", "full")
    return both.select(
        "old_key", F.when(F.col("d.decision") == "accept", F.col("d.pick")).when(F.col("d.decision") == "leave", F.lit(None)).otherwise(F.col("new_key")).alias("new_key")
    ).where("new_key is not null")
