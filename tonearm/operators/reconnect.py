"""Reconnecting a collection from end to end: matches, collisions, volumes, paths on disk and all kinds of references."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.functions import paths
from tonearm.operators import cascade
from tonearm.operators.rewrite import Rule, apply_rules, infer_volume, rewrite_keys, rewrite_locations
from tonearm.session import store


class VolumeIdentityError(ValueError):
    """The volume of a scan root cannot be told."""


def resolve(old: DataFrame, new: DataFrame, level: str = "strict", refute: bool = True, providers: DataFrame | None = None) -> DataFrame:
    """(rid, primary_key, artist, title, old_path, outcome, tier, new_rid, new_key, reason): one reviewed row per old record.

    A record of the new side that several old ones claim is withdrawn from all of them, and they become
    `destination_collision`. reason is null for what stays matched, else the row of the ambiguity report.
    """
    won = store(cascade.match(old, new, level, refute, providers))
    claims = won.where("outcome = 'matched'").groupBy("new_rid").agg(F.count(F.lit(1)).alias("claims"))
    report = cascade.ambiguous_records(old, new, won, level, providers)
    rows = won.join(claims, "new_rid", "left").join(report, "rid", "left")
    collided = F.coalesce(F.col("claims") > 1, F.lit(False))
    outcome = F.when(collided, "destination_collision").otherwise(F.col("outcome"))
    stays = outcome == "matched"
    reason = F.when(stays, None).when(collided, "destination_collision").when(F.col("many"), "ambiguous").otherwise("unmatched")
    named = old.select("rid", "artist", "title", paths.decoded_path(F.col("dir"), F.col("file")).alias("old_path"))
    return rows.join(named, "rid").select(
        "rid", "primary_key", "artist", "title", "old_path", outcome.alias("outcome"), F.when(stays, F.col("tier")).alias("tier"),
        F.when(stays, F.col("new_rid")).alias("new_rid"), F.when(stays, F.col("new_key")).alias("new_key"), reason.alias("reason"),
    )


def stats(resolved: DataFrame) -> DataFrame:
    """(counter, value) of a resolved run: withdrawn matches are taken off their tier, collisions are counted by themselves."""
    lost = resolved.agg(F.count_if(F.col("outcome") == "destination_collision").alias("value"))
    return cascade.match_stats(resolved).unionByName(lost.select(F.lit("destination_collisions").alias("counter"), "value"))


def volume_of(records: DataFrame, root: list[str], given: tuple[str, str] | None = None) -> tuple[str, str]:
    """(volume, volumeid) of a scan root: the given pair, else the only pair below it; anything else is an error."""
    if given is not None:
        return given
    seen = infer_volume(records, root).limit(2).collect() if root else []
    if len(seen) != 1:
        raise VolumeIdentityError(f"volume of {'/'.join(root)!r} is ambiguous: {sorted(tuple(r) for r in seen)}")
    return seen[0]["volume"], seen[0]["volumeid"]


def local_paths(records: DataFrame, anchors: DataFrame, files: DataFrame) -> DataFrame:
    """(rid, path): where a record's file is. ``anchors`` (volume, volumeid, anchor) name mounts, ``files`` (path) what exists.

    Exactly one anchor must lead to a file; none or several give null.
    """
    place = records.select("rid", "volume", F.coalesce("volumeid", "volume").alias("volumeid"), paths.decoded_path(F.col("dir"), F.col("file")).alias("rel"))
    tried = place.join(anchors.distinct(), ["volume", "volumeid"]).select("rid", F.concat(F.rtrim(F.col("anchor"), F.lit("/")), F.lit("/"), F.ltrim(F.col("rel"), F.lit("/"))).alias("path")).distinct()
    found = tried.join(files.select("path").distinct(), "path", "left_semi").groupBy("rid").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("n"))
    return records.select("rid").join(found.where("n = 1").select("rid", "path"), "rid", "left")


def rewrite_outside(locations: DataFrame, moved: DataFrame, rules: list[Rule]) -> DataFrame:
    """Locations outside the collection (ord, volume, volumeid, dir, file) with their new place and how it was found.

    ``moved`` (old_key, volume, volumeid, dir, file) are the collection's own moves; where it has none the rules decide,
    and where no rule fits nothing changes.
    """
    own = locations.withColumn("old_key", paths.primary_key(F.col("volume"), F.col("dir"), F.col("file")))
    hit = moved.groupBy("old_key").agg(F.min(F.struct("volume", "volumeid", "dir", "file")).alias("m"))
    by_rule = apply_rules(F.col("volume"), F.coalesce("volumeid", "volume"), F.col("dir"), rules)
    rows = own.join(hit, "old_key", "left").withColumn("r", by_rule)
    pick = lambda c, kept: F.when(F.col("m").isNotNull(), F.col(f"m.{c}")).otherwise(kept).alias("new_" + c)
    how = F.when(F.col("m").isNotNull(), "collection").when(F.col("r.hit"), "rule").otherwise("unchanged")
    return rows.select("ord", "old_key", pick("volume", F.col("r.volume")), pick("volumeid", F.col("r.volumeid")), pick("dir", F.col("r.dir")), pick("file", F.col("file")), how.alias("how"))


def preview(records: DataFrame, outside: DataFrame, entries: DataFrame, rules: list[Rule]) -> dict[str, DataFrame]:
    """The three lists of what rules would change: collection locations, other locations and keys."""
    own = rewrite_locations(records, rules).where("hit and old_key <> new_key")
    mapping = own.groupBy("old_key").agg(F.min("new_key").alias("new_key"))
    other = rewrite_outside(outside, records.limit(0).select(F.col("primary_key").alias("old_key"), "volume", F.coalesce("volumeid", "volume").alias("volumeid"), "dir", "file"), rules)
    return {
        "collection_location_changes": own.select("rid", "old_key", "new_key"), "other_location_changes": other.where("how = 'rule'"),
        "primarykey_changes": rewrite_keys(entries, mapping, rules).where("how <> 'unchanged'"),
    }


def output_name(source: str | None) -> str:
    """Name suggested for the output beside a collection; never the input's own."""
    stem, suffix = os.path.splitext(os.path.basename(source or "")) if source else ("collection", ".nml")
    return f"{stem or 'collection'}-reconnected{suffix if stem else '.nml'}"


def volume_triples(roots: list[str], pairs: list[tuple[str, str]]) -> list[tuple[str, str, str]] | None:
    """(root, volume, volumeid) of the roots with both fields filled; None where there is none."""
    filled = [(r, v.strip(), i.strip()) for r, (v, i) in zip(roots, pairs) if v.strip() and i.strip()]
    return filled or None


def volume_guess(root: str) -> tuple[str, str]:
    """First guess of a root's volume: its drive, or its leading slash."""
    drive = root[:2] if root[1:2] == ":" else "/" if root[:1] == "/" else ""
    return drive, drive


def render(resolved: DataFrame, report: str | None = None, diagnostics: tuple[str, ...] = (), warnings: tuple[str, ...] = (), refute: bool = True) -> tuple[list[str], list[str]]:
    """(lines for output, lines for errors) of a run: the number reconnected, the counters, the report; then diagnostics, warnings and the notice."""
    counted = {r["counter"]: r["value"] for r in stats(resolved).collect()}
    out = [f"reconnectable={counted['matched']}", *(f"{k}={v}" for k, v in counted.items()), *([f"csv_written={report}"] if report else [])]
    return out, [*diagnostics, *warnings, *([] if refute else ["refutation_disabled"])]
