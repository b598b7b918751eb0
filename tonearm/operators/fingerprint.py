"""Similar recordings by fingerprint: a band join on running time, then cosine similarity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonearm.operators.components import components

MATCH, NEAR, SECONDS = 0.95, 0.80, 1.0
#: Fingerprints of a side in one block: a block is the unit of work, however full its band is.
BLOCK = 1024


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def _blocks(side: DataFrame, other: DataFrame, own: str, theirs: str) -> DataFrame:
    """Rows of a side with their block and one copy for each block of the other side in their band."""
    n = other.groupBy("band").agg((F.floor(F.count(F.lit(1)) / BLOCK) + 1).cast("int").alias("theirs"))
    mine = side.groupBy("band").agg((F.floor(F.count(F.lit(1)) / BLOCK) + 1).cast("int").alias("mine"))
    placed = side.join(n, "band").join(mine, "band")
    return placed.select("id", "sec", "fp", "band", F.pmod(F.xxhash64("id"), F.col("mine")).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col("theirs") - 1)).alias(theirs))


def _compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    out = []
    widths = {len(f) for f in left["fp"]} & {len(f) for f in right["fp"]}
    for width in widths - {0}:
        l, r = left[left["fp"].map(len) == width], right[right["fp"].map(len) == width]
        a, b = np.array(l["fp"].tolist(), float), np.array(r["fp"].tolist(), float)
        with np.errstate(divide="ignore", invalid="ignore"):
            like = (a @ b.T) / np.outer(np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1)))
        near = (like >= NEAR) & (np.abs(np.subtract.outer(l["sec"].to_numpy(), r["sec"].to_numpy())) <= SECONDS)
        i, j = np.nonzero(near)
        out.append(pd.DataFrame({"left_id": l["id"].to_numpy()[i], "right_id": r["id"].to_numpy()[j], "similarity": like[i, j]}))
    return pd.concat(out) if out else pd.DataFrame({"left_id": [], "right_id": [], "similarity": []})


def similar(left: DataFrame, right: DataFrame, ahead: bool = False) -> DataFrame:
    """(left_id, right_id, similarity, verdict) of pairs (id, sec, fp) within a second and at least near.

    Pairs whose fingerprints cannot be compared (null, of no or other length) have no
    similarity and fall away. Each pair of blocks of a band is one matrix product. With ``ahead`` a band of the left
    side meets itself and the next one only: of a table with itself that holds every pair in one direction at least.
    """
    band = F.floor(F.col("sec") / SECONDS).cast("long")
    whole = lambda df: df.select(F.col("id").alias("id"), F.col("sec").cast("double").alias("sec"), F.col("fp").cast("array<double>").alias("fp")).where("id is not null and sec is not null and fp is not null")
    l = whole(left).select("id", "sec", "fp", F.explode(F.array(*([band, band + 1] if ahead else [band - 1, band, band + 1]))).alias("band"))
    r = whole(right).withColumn("band", band)
    key = ["band", "lb", "rb"]
    met = (
        _blocks(l, r, "lb", "rb").groupBy(key).cogroup(_blocks(r, l, "rb", "lb").groupBy(key)).applyInPandas(lambda a, b: _compare(a, b), "left_id long, right_id long, similarity double")
    )
    return met.select("left_id", "right_id", F.round("similarity", 6).alias("similarity"), F.when(F.col("similarity") > MATCH, "match").otherwise("near").alias("verdict"))


def clusters(records: DataFrame) -> DataFrame:
    """(id, group_id) of records linked by near-identical fingerprints, directly or through others."""
    met = similar(records, records, ahead=True).where("verdict = 'match' and left_id <> right_id")
    edges = met.select(F.least("left_id", "right_id").alias("src"), F.greatest("left_id", "right_id").alias("dst")).distinct()
    return components(edges)


def provider(old: DataFrame, new: DataFrame) -> DataFrame:
    """Keys of rank 0 for the cascade: an old record gets the id of each new one that its fingerprint matches."""
    hit = similar(old, new).where("verdict = 'match'")
    key = F.concat(F.lit("fp:"), F.col("right_id").cast("string"))
    a = hit.select(F.col("left_id").alias("rid"), F.lit("old").alias("side"), F.lit("fingerprint").alias("tier"), key.alias("key"))
    return a.unionByName(hit.select(F.col("right_id").alias("rid"), F.lit("new").alias("side"), F.lit("fingerprint").alias("tier"), key.alias("key")).distinct())
