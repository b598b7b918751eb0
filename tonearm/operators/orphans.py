"""References to records that do not exist.

Keys are encoded as integers. Per key range (32,768 codes) and month there is a compressed
bitmap of the codes that are referenced and one of the codes that from that month on are live
through whole months; only these small bitmaps travel to where a range is put together. There
a running OR over the months gives the parents, and reference AND-NOT parent the codes that
can have an orphan in that month; only those are decoded and settled by a sweep over exact times.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonearm.session import cut, store

RANGE_BITS = 15
#: References of one code that a single sweep partition takes before the code is salted.
SWEEP_ROWS = 200_000


@F.pandas_udf(T.BinaryType())
def pack(bitmaps: pd.Series) -> pd.Series:
    """Compressed form of a bitmap: the sorted 16-bit positions while these are fewer
    bytes than the deflated bits. The first byte says which."""

    def one(raw: bytes) -> bytes:
        bits = np.frombuffer(raw, np.uint8)
        at = np.flatnonzero(np.unpackbits(bits, bitorder="little")).astype("<u2").tobytes()
        return b"a" + at if len(at) <= 512 else b"z" + zlib.compress(raw, 1)

    return bitmaps.map(one, na_action="ignore")


def _bits(packed: bytes | None) -> np.ndarray:
    out = np.zeros(1 << RANGE_BITS, bool)
    if packed is None:
        return out
    if packed[:1] == b"a":
        out[np.frombuffer(packed[1:], "<u2")] = True
        return out
    raw = np.frombuffer(zlib.decompress(packed[1:]), np.uint8)
    out[: raw.size * 8] = np.unpackbits(raw, bitorder="little")
    return out


def doubtful_codes(ranges: pd.DataFrame) -> pd.DataFrame:
    """(code, period) of one key range that its references hold and its parents do not.

    ``ranges`` has (part, period, asked, live) with compressed bitmaps; period -1 stands apart from the months.
    """
    codes, periods = [], []
    live = np.zeros(1 << RANGE_BITS, bool)
    for part, period, asked, fresh in ranges.sort_values("period")[["part", "period", "asked", "live"]].itertuples(index=False):
        now = _bits(fresh)
        if period >= 0:
            live |= now
            now = live
        left = np.flatnonzero(_bits(asked) & ~now)
        codes.append((int(part) << RANGE_BITS) + left)
        periods.append(np.full(len(left), period, np.int32))
    return pd.DataFrame({"code": np.concatenate(codes) if codes else [], "period": np.concatenate(periods) if periods else []})


def encode_keys(*keyed: DataFrame) -> DataFrame:
    """Dictionary (the columns of ``keyed``, code) of all distinct keys: exact integer
    codes, dense within each partition. It is written once so that codes never change."""
    cols = keyed[0].columns
    keys = keyed[0]
    for other in keyed[1:]:
        keys = keys.unionByName(other)
    keys = keys.where(" and ".join(f"`{c}` is not null" for c in cols)).distinct()
    return store(keys.withColumn("code", F.monotonically_increasing_id()))


def _month(at: Column) -> Column:
    return (F.year(at) * 12 + F.month(at) - 1).cast("int")


def orphan_refs(refs: DataFrame, lives: DataFrame) -> DataFrame:
    """The rows of ``refs`` (code, at, ...) without a live row of ``lives`` (code, since, until).

    A row is live from ``since`` (included) to ``until`` (excluded; null: for ever). Where
    ``at`` is null only a code without any row in ``lives`` makes an orphan, and so does a
    null code in any case. Rows of lives with a null ``since`` are known but never live.
    Each orphan row comes out once, repeated rows as often as given.
    """
    bucket, bit = (lambda c: F.shiftright(c, RANGE_BITS)), (lambda c: c.bitwiseAND(F.lit((1 << RANGE_BITS) - 1)))
    refs = refs.withColumn("period", F.coalesce(_month(F.col("at")), F.lit(-1)))
    none = F.lit(None).cast("int")
    place = lambda df, side: df.where("code is not null").select(
        bucket(F.col("code")).alias("part"), "period", *[(bit(F.col("code")).cast("int") if s == side else none).alias(s) for s in ("asked", "live")]
    )
    # Codes with a row that is never removed, by the month after it was loaded: from then on live.
    lasting = lives.where("until is null and since is not null").select("code", (_month(F.col("since")) + 1).alias("period"))
    known = lives.select("code", F.lit(-1).alias("period"))
    # Each place once, before a range and month is put together: a hot key is one place however often it is referred to.
    places = place(refs, "asked").unionByName(place(lasting.unionByName(known), "live")).distinct().repartition("part", "period")
    maps = places.groupBy("part", "period").agg(F.bitmap_construct_agg("asked").alias("asked"), F.bitmap_construct_agg("live").alias("live"))
    maps = maps.select("part", "period", pack("asked").alias("asked"), pack("live").alias("live"))
    left = maps.groupBy("part").applyInPandas(doubtful_codes, "code long, period int")
    left = cut(left)

    doubtful = refs.join(left, ["code", "period"])
    lost = doubtful.where("period = -1")
    timed = doubtful.where("period >= 0")
    # Exact times: +1 where a row begins, -1 where it ends; live while the running sum is positive.
    codes = timed.groupBy("code").agg((F.floor(F.count(F.lit(1)) / SWEEP_ROWS) + 1).cast("int").alias("salts"))
    spans = lives.where("since is not null and (until is null or until > since)").join(codes, "code")
    turns = (
        spans.select("code", "salts", F.inline(F.array(F.struct(F.col("since").alias("t"), F.lit(1).alias("d")), F.struct(F.col("until").alias("t"), F.lit(-1).alias("d")))))
        .where("t is not null")
        .groupBy("code", "salts", "t")
        .agg(F.sum("d").cast("int").alias("d"))
        .select("code", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "t", "d")
    )
    row = F.struct(*[F.col(c) for c in refs.columns])
    events = (
        timed.join(codes, "code")
        .select("code", F.pmod(F.xxhash64(F.to_json(row)), F.col("salts")).cast("int").alias("salt"), F.col("at").alias("t"), F.lit(0).alias("d"), row.alias("row"))
        .unionByName(turns.withColumn("row", F.lit(None)))
    )
    order = Window.partitionBy("code", "salt").orderBy("t", F.col("row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    dead = events.withColumn("open", F.sum("d").over(order)).where("row is not null and coalesce(open, 0) <= 0").select("row.*")
    return dead.unionByName(lost.select(refs.columns)).unionByName(refs.where("code is null")).drop("period")


def _label(at: Column) -> Column:
    return F.coalesce(F.date_format(at, "yyyy-MM"), F.lit("unknown"))


def library_orphans(tracks: DataFrame, playlist_entries: DataFrame, match_pairs: DataFrame) -> DataFrame:
    """(source_table, ref_id, ref_month) of playlist entries and match pairs that refer to
    an entry that is not live at their time. A null key or id refers to nothing and is a case."""
    key = ["collection_id", "primary_key"]
    lives = tracks.select(*key, "entry_id", F.col("loaded_at").alias("since"), F.col("removed_at").alias("until"))
    entries = playlist_entries.select(*key, "ref_id", F.col("added_at").alias("at"))
    codes = encode_keys(entries.select(key), lives.select(key))
    # The coded rows are thin; they are written, since the bitmaps and the sweep both read them.
    coded = store(entries.join(codes, key, "left").select("code", "at", "ref_id"))
    listed = orphan_refs(coded, store(lives.join(codes, key).select("code", "since", "until")))
    ends = match_pairs.select(
        F.col("pair_id").alias("ref_id"), F.col("matched_at").alias("at"), F.explode(F.array("left_id", "right_id")).alias("code")
    )
    # Entry ids are integers already and serve as their own code.
    paired = orphan_refs(ends.select("code", "at", "ref_id"), lives.select(F.col("entry_id").alias("code"), "since", "until"))
    out = lambda df, name: df.select(F.lit(name).alias("source_table"), "ref_id", _label(F.col("at")).alias("ref_month"))
    return out(listed, "playlist_entries").unionByName(out(paired, "match_pairs").distinct())


def orphans_by_period(orphans: DataFrame) -> DataFrame:
    """Cases per referring table and month."""
    return orphans.groupBy("source_table", "ref_month").agg(F.count(F.lit(1)).alias("orphan_refs"))
