"""Queries of the training-data operators: name -> callable(spark, sf_dir) and oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.llm import crossmatch, identity, leakage, lookalikes, mojibake, names, packing, privacy, survivor
from tonearm.session import cut, store, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return identity.identity_groups(table(spark, d, "tracks"), table(spark, d, "match_pairs"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return survivor.contested_survivors(table(spark, d, "conflict_members"), table(spark, d, "tracks"))


def p3_survivors(spark: SparkSession, d: str) -> DataFrame:
    return survivor.surviving_records(table(spark, d, "conflict_members"), table(spark, d, "tracks"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.library_lookalikes(table(spark, d, "tracks"), table(spark, d, "artists")).select("entry_id", "field_name")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return crossmatch.library_files(table(spark, d, "disk_files"), table(spark, d, "tracks")).select("entry_id", "file_id")


def p5_scored(spark: SparkSession, d: str) -> DataFrame:
    return crossmatch.library_files(table(spark, d, "disk_files"), table(spark, d, "tracks"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    rows = mojibake.library_garbled(*(table(spark, d, n) for n in ("tracks", "request_lines", "artists")))
    return rows.select("source_table", "row_id")


def p6_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.library_garbled(*(table(spark, d, n) for n in ("tracks", "request_lines", "artists")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _variants(spark, d).select("source_table", "row_id", "artist_id")


def _variants(spark: SparkSession, d: str) -> DataFrame:
    return names.library_variants(*(table(spark, d, n) for n in ("tracks", "request_lines", "artists")))


def p7_scored(spark: SparkSession, d: str) -> DataFrame:
    return _variants(spark, d)


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(packing.pack(table(spark, d, "documents")))


def p8_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What holds of any right packing, as one row: every text with a token is packed, in whole pieces, under every limit."""
    limits = packing.Limits()
    packed = cut(packing.pack(table(spark, d, "documents")))
    loads = packing.containers(packed, limits).agg(
        F.count_if(F.col("tokens") > limits.tokens).alias("over_tokens"), F.count_if(F.col("segments") > limits.segments).alias("over_segments"), F.count_if(F.col("loss_tokens") > limits.loss).alias("over_loss"),
    )
    texts = packed.groupBy("doc_id").agg(F.count("container_id").alias("pieces"), F.sum("tokens").alias("tokens"), F.max(F.col("first_token") + F.col("tokens")).alias("end"))
    texts = texts.agg(
        F.count(F.lit(1)).alias("texts"), F.count_if(F.col("pieces") == 0).alias("without_container"), F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= limits.tokens)).alias("split_needlessly"), F.count_if((F.col("pieces") > 0) & (F.col("tokens") != F.col("end"))).alias("broken"),
    )
    return texts.withColumn("k", F.lit(1)).join(loads.withColumn("k", F.lit(1)), "k").drop("k")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return privacy.personal_details(table(spark, d, "documents"), table(spark, d, "artists"))


def p10_sanitised(spark: SparkSession, d: str) -> DataFrame:
    return privacy.sanitised(table(spark, d, "documents"), table(spark, d, "artists"))


def p10_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What holds of any right sanitising, as one row: all rows are there, nulls stay null, only texts with a piece change, no found piece with an @ is left."""
    documents, artists = table(spark, d, "documents"), table(spark, d, "artists")
    found = store(privacy.personal_details(documents, artists))
    clean = privacy.sanitised(documents, artists, found).withColumnRenamed("text", "clean")
    mails = found.where("pii_kind = 'email' and matched_text like '%@%'").groupBy("doc_id").agg(F.collect_list("matched_text").alias("mails"))
    both = documents.select("doc_id", "text").join(clean, "doc_id").join(found.select("doc_id", F.lit(True).alias("held")).distinct(), "doc_id", "left").join(mails, "doc_id", "left")
    return both.agg(
        F.count(F.lit(1)).alias("texts"), F.count_if(F.col("clean").isNull()).alias("nulls"), F.count_if(F.col("held").isNull() & ~F.col("text").eqNullSafe(F.col("clean"))).alias("changed_without_cause"),
        F.count_if(F.col("held") & (F.col("text") == F.col("clean"))).alias("unchanged_with_cause"), F.count_if(F.exists("mails", lambda m: F.contains(F.col("clean"), m))).alias("mails_left"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p3_found, p3_survivors, p4_found, p5_found, p5_scored, p6_found, p6_restored, p7_found, p7_scored,
        p8_packed, p8_containers, p8_invariants, p9_found, p10_found, p10_sanitised, p10_invariants,
    )
}
ORACLE: dict[str, str] = {}

ORACLE["p1_found"] = """
WITH RECURSIVE e AS (
  SELECT left_id AS a, right_id AS b FROM match_pairs
  WHERE outcome = 'matched' AND left_id IN (SELECT entry_id FROM tracks) AND right_id IN (SELECT entry_id FROM tracks)
  UNION SELECT g.m, t.entry_id FROM tracks t JOIN (SELECT audio_id, min(entry_id) AS m FROM tracks WHERE audio_id <> '' GROUP BY 1) g USING (audio_id)),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS id, a AS root FROM s UNION SELECT s.b, r.root FROM r JOIN s ON s.a = r.id)
SELECT id AS entry_id, min(root) AS group_id FROM r GROUP BY 1 HAVING count(*) > 1
"""
_MEMBERS = rf"""
WITH m AS (SELECT DISTINCT identity_key, entry_id FROM conflict_members WHERE identity_key IS NOT NULL),
v AS (
  SELECT identity_key, entry_id, 'album' AS attr, coalesce(album, '') AS val, modified_at,
    coalesce(regexp_matches(album, '[\p{{L}}\p{{N}}]') AND lower(trim(album)) NOT IN ({", ".join(f"'{x}'" for x in survivor.ALBUM_FILLERS)}), false) AS ok
  FROM m JOIN tracks USING (entry_id)
  UNION ALL
  SELECT identity_key, entry_id, 'bitrate', coalesce(bitrate, ''), modified_at, coalesce(try_cast(bitrate AS double) > 0, false)
  FROM m JOIN tracks USING (entry_id)),
g AS (SELECT identity_key, attr, min(val) <> max(val) AS differs FROM v GROUP BY 1, 2 HAVING bool_or(ok)),
b AS (SELECT identity_key, attr, entry_id, val FROM v WHERE ok
      QUALIFY row_number() OVER (PARTITION BY identity_key, attr ORDER BY modified_at DESC NULLS LAST, entry_id) = 1)
"""
ORACLE["p3_found"] = _MEMBERS + "SELECT identity_key, attr, entry_id FROM b JOIN g USING (identity_key, attr) WHERE differs"
ORACLE["p3_survivors"] = _MEMBERS + """
SELECT identity_key, a.val AS album, a.entry_id AS album_entry_id, r.val AS bitrate, r.entry_id AS bitrate_entry_id
FROM (SELECT DISTINCT identity_key FROM m) LEFT JOIN (SELECT * FROM b WHERE attr = 'album') a USING (identity_key)
LEFT JOIN (SELECT * FROM b WHERE attr = 'bitrate') r USING (identity_key)
"""
ORACLE["p8_invariants"] = """
SELECT count(*) AS texts, count(*) FILTER (coalesce(text, '') = '') AS without_container, 0 AS split_needlessly, 0 AS broken, 0 AS over_tokens, 0 AS over_segments, 0 AS over_loss FROM documents
"""
ORACLE["p10_invariants"] = "SELECT count(*) AS texts, count(*) FILTER (text IS NULL) AS nulls, 0 AS changed_without_cause, 0 AS unchanged_with_cause, 0 AS mails_left FROM documents"
