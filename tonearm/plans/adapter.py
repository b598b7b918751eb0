"""The star-schema tables seen as collections: a base, a perturbed copy, and merge inputs.

``p_partkey % 16`` selects the one way in which a copy differs, so each tier of the match
cascade has a known winner. The SQL twin of each frame is used by the oracle only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.functions.paths import primary_key
from tonearm.session import table


def _case(column: Column, cases: dict, default: Column) -> Column:
    out = None
    for keys, value in cases.items():
        hit = column.isin(*(keys if isinstance(keys, tuple) else (keys,)))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(default)


def _dealt(spark: SparkSession, df: DataFrame) -> DataFrame:
    """A table of fewer files than there are cores is dealt out once; of a table of many files nothing is moved. No row differs."""
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def base(spark: SparkSession, d: str) -> DataFrame:
    p = _dealt(spark, table(spark, d, "part"))
    key = F.col("p_partkey")
    return p.select(
        key.alias("rid"), key.alias("part"), (key % 16).alias("m"), F.col("p_brand").alias("artist"), F.col("p_name").alias("title"), F.col("p_type").alias("album"),
        F.when((key % 16).isin(0, 12), F.concat(F.lit("Aid"), key.cast("string"))).otherwise("").alias("audio_id"),
        (4000 + F.col("p_size") * 37 + key % 11).cast("string").alias("filesize"), F.format_string("%.3f", F.col("p_retailprice") / 5).alias("playtime_float"),
        F.lit("320").alias("bitrate"), F.lit("C:").alias("volume"), F.lit("C:").alias("volumeid"),
        F.concat(F.lit("/:Music/:"), "p_type", F.lit("/:"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("/:")).alias("dir"),
        F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("-"), key.cast("string"), F.lit(".mp3")).alias("file"),
    )


def old(spark: SparkSession, d: str) -> DataFrame:
    b = base(spark, d)
    twice = b.where("m = 15").withColumn("rid", F.col("rid") + 1_000_000_000).withColumn("dir", F.concat(F.lit("/:Dup"), "dir"))
    return _keyed(b.unionByName(twice))


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("primary_key", primary_key(F.col("volume"), F.col("dir"), F.col("file")))


def new(spark: SparkSession, d: str) -> DataFrame:
    b = base(spark, d)
    m, size = F.col("m"), F.col("filesize").cast("long")
    time = F.col("playtime_float").cast("double")
    brand = F.replace("artist", F.lit("#"), F.lit(""))
    grown = F.floor(size * 101 / 100).cast("string")
    later = F.format_string("%.3f", time + 0.5)
    moved = F.lit("/:Moved/:")
    tagless = (3, 5, 6, 8, 9, 10, 11)
    renamed = F.concat(F.lit("r"), F.col("part").cast("string"), F.lit(".mp3"))
    stem = F.concat(F.replace("file", F.lit(".mp3"), F.lit("")), F.lit(".stem.m4a"))
    n = b.where((m != 13) | ((F.floor(F.col("part") / 16) % 2) == 0)).select(
        "rid", "part", "m",
        _case(m, {0: F.concat(F.lit("X"), "artist"), 1: F.upper("artist"), tagless: F.lit("")}, F.col("artist")).alias("artist"),
        _case(m, {0: F.concat(F.lit("X"), "title"), tagless: F.lit("")}, F.col("title")).alias("title"),
        _case(m, {(*tagless, 7): F.lit("")}, F.col("album")).alias("album"),
        F.when(m == 12, "").otherwise(F.col("audio_id")).alias("audio_id"),
        _case(m, {0: (size * 3).cast("string"), (2, 4, 5, 6, 7, 8, 9, 10, 11): grown, 12: F.floor(size * 105 / 100).cast("string")}, F.col("filesize")).alias("filesize"),
        _case(m, {0: F.format_string("%.3f", time + 50), (2, 5, 6, 7, 8, 9, 10, 11): later}, F.col("playtime_float")).alias("playtime_float"),
        "bitrate", F.lit("D:").alias("volume"), F.lit("D:").alias("volumeid"),
        _case(
            m,
            {
                (0, 1, 2, 3, 4, 7, 10, 11): moved, 5: F.concat(F.lit("/:New"), "dir"), 6: F.concat(F.lit("/:A/:"), F.regexp_extract("dir", "^/:Music/:(.*)/:[^/]*/:$", 1), F.lit("/:"), brand, F.lit("/:")),
                (8, 9): F.concat(F.lit("/:A/:B/:"), brand, F.lit("/:")), 13: F.lit("/:CopyA/:"), 14: F.concat(F.lit("/:Sync_"), "dir"),
            },
            F.col("dir"),
        ).alias("dir"),
        _case(m, {(0, 1, 4, 7): renamed, (9, 11): stem}, F.col("file")).alias("file"),
    )
    second = n.where("m in (13, 14)").withColumn("rid", F.col("rid") + 1_000_000_000)
    second = second.withColumn("dir", F.when(m == 13, "/:CopyB/:").otherwise(F.replace("dir", F.lit("/:Sync_/:"), F.lit("/:Sync_old/:"))))
    return _keyed(n.unionByName(second))


def merge_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Base (input 0) and two further inputs that differ by ``part % 8``."""
    b = base(spark, d)
    c = F.col("part") % 8
    one = b.where(c != 7).withColumn("input_idx", F.lit(0))
    size, time = F.col("filesize").cast("long"), F.col("playtime_float").cast("double")
    a = b.withColumn("filesize", _case(c, {(1, 6): (size + 2).cast("string"), 5: F.lit("")}, F.col("filesize")))
    a = a.withColumn("playtime_float", F.when(c == 2, F.format_string("%.3f", time * 1.5)).otherwise(F.col("playtime_float")))
    a = a.withColumn("album", F.when(c.isin(3, 4, 7), F.concat(F.col("album"), F.lit(" A"))).otherwise(F.col("album")))
    a = a.withColumn("bitrate", F.when(c == 4, "256").otherwise(F.col("bitrate"))).withColumn("dir", F.when(c == 6, F.concat(F.lit("/:Else"), "dir")).otherwise(F.col("dir")))
    a = a.withColumn("input_idx", F.lit(1)).withColumn("rid", F.col("rid") + 1_000_000_000)
    z = b.where(c.isin(0, 7)).withColumn("album", F.when(c == 7, F.concat(F.col("album"), F.lit(" B"))).otherwise(F.col("album")))
    z = z.withColumn("input_idx", F.lit(2)).withColumn("rid", F.col("rid") + 2_000_000_000)
    return _keyed(one.unionByName(a).unionByName(z))


def playlist_keys(spark: SparkSession, d: str) -> DataFrame:
    """(node_id, pos, key): one playlist per order, its lines as entries that refer to the base collection."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    keys = _keyed(base(spark, d)).select(F.col("part").alias("l_partkey"), F.col("primary_key").alias("key"))
    lines = table(spark, d, "lineitem").withColumn("pos", F.row_number().over(w))
    return lines.join(keys, "l_partkey").select(F.col("l_orderkey").alias("node_id"), "pos", "key")


BASE = """
b AS (SELECT p_partkey AS rid, p_partkey AS part, p_partkey % 16 AS m, p_brand AS artist, p_name AS title, p_type AS album,
  CASE WHEN p_partkey % 16 IN (0, 12) THEN 'Aid' || p_partkey ELSE '' END AS audio_id,
  CAST(4000 + p_size * 37 + p_partkey % 11 AS VARCHAR) AS filesize, printf('%.3f', p_retailprice / 5) AS playtime_float, '320' AS bitrate,
  'C:' AS volume, 'C:' AS volumeid, '/:Music/:' || p_type || '/:' || replace(p_brand, '#', '') || '/:' AS dir,
  replace(p_name, ' ', '_') || '-' || p_partkey || '.mp3' AS file FROM part)"""
OLD = BASE + """,
old AS (SELECT *, volume || dir || file AS primary_key FROM (
  SELECT * FROM b UNION ALL SELECT * REPLACE (rid + 1000000000 AS rid, '/:Dup' || dir AS dir) FROM b WHERE m = 15))"""
NEW = OLD + """,
n1 AS (SELECT rid, part, m,
  CASE WHEN m = 0 THEN 'X' || artist WHEN m = 1 THEN upper(artist) WHEN m IN (3,5,6,8,9,10,11) THEN '' ELSE artist END AS artist,
  CASE WHEN m = 0 THEN 'X' || title WHEN m IN (3,5,6,8,9,10,11) THEN '' ELSE title END AS title,
  CASE WHEN m IN (3,5,6,7,8,9,10,11) THEN '' ELSE album END AS album, CASE WHEN m = 12 THEN '' ELSE audio_id END AS audio_id,
  CASE WHEN m = 0 THEN CAST(filesize::BIGINT * 3 AS VARCHAR) WHEN m IN (2,4,5,6,7,8,9,10,11) THEN CAST(filesize::BIGINT * 101 // 100 AS VARCHAR)
       WHEN m = 12 THEN CAST(filesize::BIGINT * 105 // 100 AS VARCHAR) ELSE filesize END AS filesize,
  CASE WHEN m = 0 THEN printf('%.3f', playtime_float::DOUBLE + 50) WHEN m IN (2,5,6,7,8,9,10,11) THEN printf('%.3f', playtime_float::DOUBLE + 0.5) ELSE playtime_float END AS playtime_float,
  bitrate, 'D:' AS volume, 'D:' AS volumeid,
  CASE WHEN m IN (0,1,2,3,4,7,10,11) THEN '/:Moved/:' WHEN m = 5 THEN '/:New' || dir WHEN m = 6 THEN '/:A/:' || album || '/:' || replace(artist, '#', '') || '/:'
       WHEN m IN (8,9) THEN '/:A/:B/:' || replace(artist, '#', '') || '/:' WHEN m = 13 THEN '/:CopyA/:' WHEN m = 14 THEN '/:Sync_' || dir ELSE dir END AS dir,
  CASE WHEN m IN (0,1,4,7) THEN 'r' || part || '.mp3' WHEN m IN (9,11) THEN replace(file, '.mp3', '') || '.stem.m4a' ELSE file END AS file
  FROM b WHERE m <> 13 OR (part // 16) % 2 = 0),
new AS (SELECT *, volume || dir || file AS primary_key FROM (
  SELECT * FROM n1 UNION ALL
  SELECT * REPLACE (rid + 1000000000 AS rid, CASE WHEN m = 13 THEN '/:CopyB/:' ELSE replace(dir, '/:Sync_/:', '/:Sync_old/:') END AS dir) FROM n1 WHERE m IN (13, 14)))"""
MERGE = BASE + """,
inputs AS (SELECT *, volume || dir || file AS primary_key FROM (
  SELECT *, 0 AS input_idx FROM b WHERE part % 8 <> 7
  UNION ALL SELECT * REPLACE (rid + 1000000000 AS rid,
    CASE WHEN part % 8 IN (1, 6) THEN CAST(filesize::BIGINT + 2 AS VARCHAR) WHEN part % 8 = 5 THEN '' ELSE filesize END AS filesize,
    CASE WHEN part % 8 = 2 THEN printf('%.3f', playtime_float::DOUBLE * 1.5) ELSE playtime_float END AS playtime_float,
    CASE WHEN part % 8 IN (3, 4, 7) THEN album || ' A' ELSE album END AS album, CASE WHEN part % 8 = 4 THEN '256' ELSE bitrate END AS bitrate,
    CASE WHEN part % 8 = 6 THEN '/:Else' || dir ELSE dir END AS dir), 1 FROM b
  UNION ALL SELECT * REPLACE (rid + 2000000000 AS rid, CASE WHEN part % 8 = 7 THEN album || ' B' ELSE album END AS album), 2 FROM b WHERE part % 8 IN (0, 7)))"""
LISTS = """
pl AS (SELECT l_orderkey AS node_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS INTEGER) AS pos,
  volume || dir || file AS key FROM lineitem JOIN b ON l_partkey = part)"""
PLAYLISTS = BASE + "," + LISTS
