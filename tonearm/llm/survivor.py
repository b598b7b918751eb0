"""The best representative of each duplicate group, attribute by attribute.

Members are ranked by completeness, trust and recency in a window with a fixed
tie-break and the top one is kept. The filter on row_number lets Spark keep only the
leader of each map task before the shuffle, so a hot group is never gathered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Texts that stand for a missing album name, in lower case.
ALBUM_FILLERS = ["n/a", "na", "none", "null", "unknown", "unknown album", "<unknown>", "untitled", "untitled album", "unbekannt", "unbekanntes album", "no album", "inconnu", "desconocido"]


def usable_album(value: Column) -> Column:
    """Text that names an album: some letter or digit, and no filler."""
    name = F.lower(F.trim(F.regexp_replace(value, r"[\s ]+", " ")))
    return F.coalesce(name.rlike(r"[\p{L}\p{N}]") & ~name.isin(ALBUM_FILLERS), F.lit(False))


def usable_number(value: Column) -> Column:
    """A positive finite decimal number."""
    return F.coalesce(value.rlike(r"^\s*\+?\d+(\.\d*)?\s*$") & (value.try_cast("double") > 0), F.lit(False))


def ranked_values(
    members: DataFrame,
    records: DataFrame,
    group: str,
    record_id: str,
    attributes: dict[str, Column],
    recency: str,
    trust: Column | None = None,
) -> DataFrame:
    """(group, attr, record_id, value, differs, any_usable) of the top member per group and attribute.

    ``attributes`` names each attribute with the condition under which its value is
    usable. Order: usable first, then trust, then the latest ``recency`` (null last),
    then the least id. Repeated members count once, members without a record and null
    groups or ids not at all. Null and empty values are the same.
    """
    wanted = records.select(
        F.col(record_id),
        F.col(recency).alias("__at"),
        (F.lit(0) if trust is None else trust).alias("__trust"),
        F.array(
            *[
                F.struct(F.lit(a).alias("attr"), F.coalesce(F.col(a), F.lit("")).alias("value"), ok.alias("usable"))
                for a, ok in attributes.items()
            ]
        ).alias("__cells"),
    )
    pairs = members.select(group, record_id).where(F.col(group).isNotNull() & F.col(record_id).isNotNull()).distinct()
    cells = pairs.join(wanted, record_id).select(group, record_id, "__at", "__trust", F.inline("__cells"))
    order = [F.desc("usable"), F.desc("__trust"), F.desc_nulls_last("__at"), F.asc(record_id)]
    top = cells.withColumn("__rank", F.row_number().over(Window.partitionBy(group, "attr").orderBy(*order))).where("__rank = 1")
    span = cells.groupBy(group, "attr").agg(
        (F.min("value") != F.max("value")).alias("differs"), F.max("usable").alias("any_usable")
    )
    return top.select(group, "attr", record_id, "value").join(span, [group, "attr"])


def album_and_bitrate(members: DataFrame, tracks: DataFrame) -> DataFrame:
    return ranked_values(
        members,
        tracks,
        "identity_key",
        "entry_id",
        {"album": usable_album(F.col("album")), "bitrate": usable_number(F.col("bitrate"))},
        "modified_at",
    )


def contested_survivors(members: DataFrame, tracks: DataFrame) -> DataFrame:
    """(identity_key, attr, entry_id) where members differ and a usable value exists."""
    return album_and_bitrate(members, tracks).where("differs and any_usable").select("identity_key", "attr", "entry_id")


def surviving_records(members: DataFrame, tracks: DataFrame) -> DataFrame:
    """One row per identity_key with its surviving album and bitrate (null when none is usable) and their sources."""
    best = album_and_bitrate(members, tracks).where("any_usable")
    keys = members.select("identity_key").where("identity_key is not null").distinct()
    pick = lambda a, c: F.max(F.when(F.col("attr") == a, F.col(c)))
    one = best.groupBy("identity_key").agg(
        pick("album", "value").alias("album"),
        pick("album", "entry_id").alias("album_entry_id"),
        pick("bitrate", "value").alias("bitrate"),
        pick("bitrate", "entry_id").alias("bitrate_entry_id"),
    )
    return reduce(lambda l, r: l.join(r, "identity_key", "left"), [keys, one])
