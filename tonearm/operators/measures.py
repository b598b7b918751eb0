"""Measurements that a deduplication rests on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonearm import model
from tonearm.functions import paths
from tonearm.functions.numbers import number


def inspect(tracks: DataFrame, entries: DataFrame) -> DataFrame:
    """One row of counts: collection entries, those with a location and with a key, playlist references, those with a key, and entries of both kinds."""
    one = lambda df, kind, located, keyed: df.select(F.lit(kind).alias("kind"), located.cast("int").alias("located"), keyed.isNotNull().cast("int").alias("keyed"))
    place = F.col("dir_value").isNotNull() & F.col("file_name").isNotNull()
    both = one(tracks, "entry", place, F.col("primary_key")).unionByName(one(entries, "ref", F.lit(False), F.col("primary_key")))
    of = lambda kind, value: F.coalesce(F.sum(F.when(F.col("kind") == kind, value)), F.lit(0).cast("long"))
    return both.agg(
        of("entry", F.lit(1)).alias("collection_entries"), of("entry", F.col("located")).alias("collection_entries_with_location"), of("entry", F.col("keyed")).alias("collection_entries_with_primarykey"),
        of("ref", F.lit(1)).alias("playlist_entry_refs"), of("ref", F.col("keyed")).alias("playlist_primarykeys"), F.count(F.lit(1)).alias("all_entry_nodes_in_document"),
    )


def false_collisions(tracks: DataFrame) -> DataFrame:
    """(audio_id, pairs, collisions): pairs of entries with one audio id, and those of them that are two recordings.

    A pair is no collision when artist, title (by case folding) and length within a second agree, or when it is one
    file twice: size, length and bit rate filled and the same text. Pairs are counted, not formed: equal rows first,
    then a sum over the lengths within a second, so a large group costs as many rows as it has different readings.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    half = lambda n: n * (n - 1) / 2
    micros = F.round(number(F.col("playtime_float")) * 1_000_000).cast("long")
    names = F.concat_ws("\x1f", paths.casefold(text("artist")), paths.casefold(text("title")))
    measured = F.when((text("filesize") != "") & (text("playtime_float") != "") & (text("bitrate") != ""), F.concat_ws("\x1f", "filesize", "playtime_float", "bitrate"))
    rows = tracks.where("audio_id <> ''").select("audio_id", names.alias("names"), micros.alias("us"), measured.alias("measured"))
    rows = rows.groupBy("audio_id", "names", "us", "measured").agg(F.count(F.lit(1)).alias("n"))
    every = rows.groupBy("audio_id").agg(F.sum("n").alias("n")).where("n > 1").select("audio_id", half(F.col("n")).alias("pairs"))
    count = lambda by, where: rows.where(where).groupBy(*by).agg(F.sum("n").alias("n")).select("audio_id", half(F.col("n")).alias("same"))
    twice = count(["audio_id", "measured"], "measured is not null")
    both = count(["audio_id", "names", "us", "measured"], "measured is not null and us is not null").withColumn("same", -F.col("same"))
    lengths = rows.where("us is not null").groupBy("audio_id", "names", "us").agg(F.sum("n").alias("n"))
    near = Window.partitionBy("audio_id", "names").orderBy("us").rangeBetween(-1_000_000, -1)
    close = lengths.select("audio_id", (half(F.col("n")) + F.col("n") * F.coalesce(F.sum("n").over(near), F.lit(0))).alias("same"))
    same = twice.unionByName(both).unionByName(close).groupBy("audio_id").agg(F.sum("same").alias("same"))
    return every.join(same, "audio_id", "left").select("audio_id", F.col("pairs").cast("long").alias("pairs"), (F.col("pairs") - F.coalesce("same", F.lit(0.0))).cast("long").alias("collisions"))


def reanalysis_stability(old: DataFrame, new: DataFrame) -> DataFrame:
    """(common_keys, same_audio_id, share): ids that stayed on keys both collections have."""
    a = old.groupBy("primary_key").agg(F.max("audio_id").alias("a"))
    b = new.groupBy("primary_key").agg(F.max("audio_id").alias("b"))
    return a.join(b, "primary_key").agg(
        F.count(F.lit(1)).alias("common_keys"), F.count_if(F.col("a") == F.col("b")).alias("same_audio_id"), F.round(F.avg((F.col("a") == F.col("b")).cast("double")), 6).alias("share")
    )


def copy_agreement(tracks: DataFrame, root: list[str]) -> DataFrame:
    """(copy_rate, format_rate, copies, formats): entries below the folder ``root`` paired with the first entry outside
    it that has the same stem; the share of pairs that have one audio id, by whether their suffix is the same.

    Rows without a file name and files that are no audio have no pair; a rate of nothing is 0.
    """
    parts = paths.folder_parts(F.col("dir_value"))
    suffix = F.lower(F.regexp_extract("file_name", r".(\.[^.]*)$", 1))
    stem = paths.casefold(F.regexp_replace("file_name", r"(?<=.)\.[^.]*$", ""))
    rows = tracks.where("file_name <> ''").select("entry_id", F.coalesce("audio_id", F.lit("")).alias("audio_id"), stem.alias("stem"), suffix.alias("suffix"), (F.slice(parts, 1, len(root)) == F.array(*[F.lit(r) for r in root])).alias("inside"))
    first = rows.where("not inside").groupBy("stem").agg(F.min_by(F.struct("audio_id", "suffix"), "entry_id").alias("o"))
    copies = rows.where(F.col("inside") & F.col("suffix").isin([x for x in model.AUDIO_SUFFIXES if x.count(".") == 1])).join(first, "stem")
    agree, same = (F.col("audio_id") != "") & (F.col("audio_id") == F.col("o.audio_id")), F.col("suffix") == F.col("o.suffix")
    rate = lambda kind: F.round(F.coalesce(F.count_if(kind & agree) / F.nullif(F.count_if(kind), F.lit(0)), F.lit(0.0)), 6)
    return copies.agg(rate(same).alias("copy_rate"), rate(~same).alias("format_rate"), F.count_if(same).alias("copies"), F.count_if(~same).alias("formats"))


def reference_inventory(tracks: DataFrame, entries: DataFrame) -> DataFrame:
    """(shape, refs, resolved): references by type and whether their value is a key of the collection."""
    keys = tracks.select("collection_id", "primary_key").distinct().withColumn("ok", F.lit(1))
    e = entries.select("collection_id", "primary_key", F.concat(F.lit("PLAYLIST/PRIMARYKEY@KEY["), F.coalesce("key_type", F.lit("")), F.lit("]")).alias("shape"))
    return e.join(keys, ["collection_id", "primary_key"], "left").groupBy("shape").agg(F.count(F.lit(1)).alias("refs"), F.count("ok").alias("resolved"))


def overlap(tracks: DataFrame, flag: str) -> DataFrame:
    """(held_by, groups): shared audio ids by whether all, some or none of their members have the flag set."""
    has = F.col(flag).isNotNull()
    g = tracks.where("audio_id <> ''").groupBy("audio_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and(has).alias("every"), F.bool_or(has).alias("some")).where("n > 1")
    return g.groupBy(F.when(F.col("every"), "all").when(F.col("some"), "some").otherwise("none").alias("held_by")).agg(F.count(F.lit(1)).alias("groups"))


#: Shares that let audio ids group copies, and also changes of format.
STABLE, COPIES, FORMATS = 0.99, 0.99, 0.95


def groups_by_audio_id(stable: float, copies: float, collisions: int) -> bool:
    """Whether audio ids are good enough to group copies by."""
    return collisions == 0 and stable >= STABLE and copies >= COPIES


def groups_across_formats(stable: float, copies: float, formats: float, collisions: int) -> bool:
    return groups_by_audio_id(stable, copies, collisions) and formats >= FORMATS
