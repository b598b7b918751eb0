"""Queries of the core operators: name -> callable(spark, sf_dir), and the oracle SQL of each."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonearm import model
from tonearm.functions import numbers, paths, text
from tonearm.operators import cascade, discover, fingerprint, measures, merge, orphans, playlists, rebuild, reconnect, reports, resolve, rewrite
from tonearm.plans import adapter
from tonearm.session import cut, table
from tonearm.streaming import tagcache

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the function under its name, with the SQL that must give the same rows."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


_ORPHANS = """
WITH r AS (
  SELECT 'playlist_entries' AS source_table, ref_id, added_at AS ts,
    EXISTS (SELECT 1 FROM tracks t WHERE t.collection_id = p.collection_id AND t.primary_key = p.primary_key
            AND t.loaded_at <= added_at AND (t.removed_at IS NULL OR added_at < t.removed_at)) AS live,
    EXISTS (SELECT 1 FROM tracks t WHERE t.collection_id = p.collection_id AND t.primary_key = p.primary_key) AS known
  FROM playlist_entries p
  UNION ALL
  SELECT 'match_pairs', pair_id, matched_at,
    EXISTS (SELECT 1 FROM tracks t WHERE t.entry_id = left_id AND t.loaded_at <= matched_at AND (t.removed_at IS NULL OR matched_at < t.removed_at))
    AND EXISTS (SELECT 1 FROM tracks t WHERE t.entry_id = right_id AND t.loaded_at <= matched_at AND (t.removed_at IS NULL OR matched_at < t.removed_at)),
    EXISTS (SELECT 1 FROM tracks t WHERE t.entry_id = left_id) AND EXISTS (SELECT 1 FROM tracks t WHERE t.entry_id = right_id)
  FROM match_pairs)
, o AS (SELECT source_table, ref_id, coalesce(strftime(ts, '%Y-%m'), 'unknown') AS ref_month
        FROM r WHERE (ts IS NOT NULL AND NOT live) OR (ts IS NULL AND NOT known))
"""


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.library_orphans(*(table(spark, d, n) for n in ("tracks", "playlist_entries", "match_pairs")))


@query(_ORPHANS + "SELECT source_table, ref_id, ref_month FROM o")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d)


@query(_ORPHANS + "SELECT source_table, ref_month, count(*) AS orphan_refs FROM o GROUP BY ALL")
def p2_by_period(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphans_by_period(_orphans(spark, d))


# --- the base collection: scans, projections, keys ------------------------------------------------


@query(
    "SELECT (SELECT count(*) FROM tracks) AS collection_entries, (SELECT count(*) FROM tracks WHERE dir_value IS NOT NULL AND file_name IS NOT NULL) AS collection_entries_with_location, "
    "(SELECT count(primary_key) FROM tracks) AS collection_entries_with_primarykey, (SELECT count(*) FROM playlist_entries) AS playlist_entry_refs, (SELECT count(primary_key) FROM playlist_entries) AS playlist_primarykeys, "
    "(SELECT count(*) FROM tracks) + (SELECT count(*) FROM playlist_entries) AS all_entry_nodes_in_document"
)
def inspect_stats(spark, d):
    return measures.inspect(table(spark, d, "tracks"), table(spark, d, "playlist_entries"))


@query(
    "SELECT entry_id, coalesce(artist,'') AS artist, coalesce(title,'') AS title, volume, coalesce(volumeid, volume) AS volumeid, dir_value AS dir, file_name AS file, "
    "array_to_string([x for x in string_split(replace(dir_value, '/:', '/'), '/') if x <> '' AND x <> '.'], '/') || '/' || file_name AS decoded_path, primary_key FROM tracks"
)
def location_rows(spark, d):
    t = table(spark, d, "tracks")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return t.select(
        "entry_id", blank("artist"), blank("title"), "volume", F.coalesce("volumeid", "volume").alias("volumeid"), F.col("dir_value").alias("dir"), F.col("file_name").alias("file"),
        paths.decoded_path(F.col("dir_value"), F.col("file_name")).alias("decoded_path"), "primary_key",
    )


@query(
    "SELECT entry_id, volume, dir_value AS dir, file_name AS file, primary_key = volume || dir_value || file_name AS same_key FROM tracks WHERE contains(primary_key, '/:')"
)
def primary_key_roundtrip(spark, d):
    p = paths.parse_key(F.col("primary_key"))
    t = table(spark, d, "tracks").withColumn("p", p).where("p is not null")
    return t.select("entry_id", "p.volume", "p.dir", "p.file", (paths.primary_key(F.col("p.volume"), F.col("p.dir"), F.col("p.file")) == F.col("primary_key")).alias("same_key"))


@query(
    "SELECT entry_id, CASE WHEN contains(primary_key, '/:') THEN array_to_string([x for x in string_split(replace(dir_value, '/:', '/'), '/') if x <> '' AND x <> '.'], '/') END AS human, "
    "'/:' || array_to_string([x for x in string_split(replace(dir_value, '/:', '/'), '/') if x <> '' AND x <> '.'], '/:') || '/:' AS encoded FROM tracks"
)
def dir_encode(spark, d):
    human = paths.decode_dir(F.col("dir_value"))
    return table(spark, d, "tracks").select("entry_id", human.alias("human"), paths.encode_dir(human).alias("encoded"))


_PARTS = "[x for x in string_split(replace({0}.dir, '/:', '/'), '/') if x <> '' AND x <> '.']"


def _key_sql(side: str, level: str) -> str:
    """Independent SQL of the exploded tier keys of one side."""
    parts = "[x for x in string_split(replace(dir, '/:', '/'), '/') if x <> '' AND x <> '.']"
    bare = r"nullif(lower(regexp_replace(file, '(\.stem)?\.[A-Za-z0-9]{1,5}$', '', 'i')), '')"
    at = "lower(artist) || chr(31) || lower(title)"
    ok_at = "artist <> '' AND title <> ''"
    suffix = lambda n: f"CASE WHEN len({parts}) >= {n} AND file <> '' THEN lower(array_to_string({parts}[-{n}:], chr(31))) || chr(31) || lower(file) END"
    tiers = {
        "audio_id": "nullif(audio_id, '')",
        "artist_title_size_time": f"CASE WHEN {ok_at} AND filesize <> '' AND playtime_float <> '' THEN {at} || chr(31) || filesize || chr(31) || playtime_float END",
        "artist_title_file": f"CASE WHEN {ok_at} AND file <> '' THEN {at} || chr(31) || lower(file) END",
        "file_size_time": "CASE WHEN file <> '' AND filesize <> '' AND playtime_float <> '' THEN lower(file) || chr(31) || filesize || chr(31) || playtime_float END",
        "artist_title_album_time": f"CASE WHEN {ok_at} AND album <> '' AND playtime_float <> '' THEN {at} || chr(31) || lower(album) || chr(31) || playtime_float END",
        "path_suffix_3": suffix(3),
        "path_suffix_2": suffix(2),
        "artist_title": f"CASE WHEN {ok_at} THEN {at} END",
        "path_suffix_1": suffix(1),
        "bare_name_in_folder": f"CASE WHEN len({parts}) > 0 AND {bare} IS NOT NULL THEN lower({parts}[-1]) || chr(31) || {bare} END",
        "filename": "nullif(lower(file), '')",
        "bare_name": bare,
    }
    ranks = {t: i + 1 for i, (t, _) in enumerate(model.TIERS)}
    return " UNION ALL ".join(
        f"SELECT rid, primary_key, try_cast(filesize AS DOUBLE) AS kb, try_cast(playtime_float AS DOUBLE) AS sec, list_contains({parts}, 'Sync_') AS synced, list_contains({parts}, 'Sync_old') AS stale, "
        f"{ranks[t]} AS rank, '{t}' AS tier, {tiers[t]} AS key FROM {side}"
        for t in model.admitted(level)
    )


def _match_sql(level: str, refute: bool = True, cross: bool = False) -> str:
    """Independent SQL of the cascade, ending in the relation ``won``."""
    size = "FALSE" if cross else "coalesce(greatest(o.kb, n.kb) > 0 AND abs(o.kb - n.kb) / greatest(o.kb, n.kb) > 0.02, FALSE)"
    allowed = "greatest(1.0, 0.15 * greatest(o.sec, n.sec))" if cross else "1.0"
    return f"""WITH {adapter.NEW},
ko AS (SELECT * FROM ({_key_sql("old", level)}) WHERE key IS NOT NULL),
kn AS (SELECT * FROM ({_key_sql("new", level)}) WHERE key IS NOT NULL),
met0 AS (SELECT o.rid, o.rank, o.tier, n.rid AS nr, n.primary_key AS nk, n.synced,
    bool_or(n.stale) OVER w AS any_stale, sum(n.synced::INT) OVER w AS n_synced,
    {"o.tier <> 'audio_id' AND (" + size + f" OR coalesce(abs(o.sec - n.sec) > {allowed}, FALSE))" if refute else "FALSE"} AS refuted,
    coalesce(greatest(o.kb, n.kb) > 0 AND abs(o.kb - n.kb) / greatest(o.kb, n.kb) <= 0.02, FALSE) AS agrees
  FROM ko o JOIN kn n ON o.rank = n.rank AND o.key = n.key WINDOW w AS (PARTITION BY o.rid, o.rank)),
met AS (SELECT * FROM met0 WHERE NOT (any_stale AND n_synced = 1) OR synced),
bt AS (SELECT rid, rank, tier, count(*) FILTER (NOT refuted) AS kept, count(*) FILTER (refuted) AS dropped, count(*) FILTER (NOT refuted AND agrees) AS agreeing,
    min(nr) FILTER (NOT refuted) AS only_r, min(nr) FILTER (NOT refuted AND agrees) AS agr_r FROM met GROUP BY ALL),
pk AS (SELECT *, CASE WHEN kept = 1 THEN only_r WHEN kept > 1 AND agreeing = 1 THEN agr_r END AS pick FROM bt),
dn AS (SELECT rid, min(rank) FILTER (pick IS NOT NULL) AS wr, bool_or(kept > 1 AND pick IS NULL) AS several, bool_or(dropped > 0) AS ref FROM pk GROUP BY rid),
won AS (SELECT old.rid, old.primary_key, CASE WHEN wr IS NOT NULL THEN 'matched' WHEN several THEN 'ambiguous' WHEN ref THEN 'refuted' ELSE 'unmatched' END AS outcome,
    pk.tier, pk.pick AS new_rid, new.primary_key AS new_key
  FROM old LEFT JOIN dn USING (rid) LEFT JOIN pk ON pk.rid = dn.rid AND pk.rank = dn.wr LEFT JOIN new ON new.rid = pk.pick)
"""


def _pair(spark, d):
    return adapter.old(spark, d), adapter.new(spark, d)


@query(f"WITH {adapter.NEW} SELECT rid, rank, tier, key FROM ({_key_sql('new', 'filename')}) WHERE key IS NOT NULL")
def match_keys(spark, d):
    return cascade.tier_keys(adapter.new(spark, d), "filename").select("rid", "rank", "tier", "key")


_OUT = "SELECT rid, primary_key, outcome, tier, new_rid, new_key FROM won"


def _register_matches():
    for level in model.LEVELS:
        def run(spark, d, level=level):
            return cascade.match(*_pair(spark, d), level)

        run.__name__ = f"match_{level}"
        query(_match_sql(level) + _OUT)(run)


_register_matches()


@query(_match_sql("loose", refute=False) + _OUT)
def match_no_refute(spark, d):
    return cascade.match(*_pair(spark, d), "loose", refute=False)


@query(_match_sql("loose", cross=True) + _OUT)
def match_cross_source(spark, d):
    old, new = _pair(spark, d)
    return cascade.match(old, new.withColumn("from_disk", F.lit(True)), "loose")


@query(_match_sql("loose") + "SELECT rid, new_key FROM won WHERE outcome = 'matched' AND contains(new_key, '/:Sync_/:')")
def sync_preference(spark, d):
    return cascade.match(*_pair(spark, d), "loose").where("outcome = 'matched' and contains(new_key, '/:Sync_/:')").select("rid", "new_key")


_COUNTERS = "SELECT 'matched' AS counter, count(*) FILTER (outcome = 'matched') AS value FROM won " + "".join(
    f"UNION ALL SELECT 'matched_{t}', count(*) FILTER (tier = '{t}') FROM won " for t, _ in model.TIERS
) + "UNION ALL SELECT 'ambiguous', count(*) FILTER (outcome = 'ambiguous') FROM won UNION ALL SELECT 'unmatched', count(*) FILTER (outcome IN ('unmatched','refuted')) FROM won UNION ALL SELECT 'refuted', count(*) FILTER (outcome = 'refuted') FROM won"


@query(_match_sql("filename") + _COUNTERS)
def match_stats_by_tier(spark, d):
    return cascade.match_stats(cascade.match(*_pair(spark, d), "filename"))


@query(
    _match_sql("strict")
    + "SELECT 'entries_old' AS counter, count(*) AS value FROM old UNION ALL SELECT 'entries_new', count(*) FROM new UNION ALL SELECT 'primarykey_updates_available', count(DISTINCT primary_key) FILTER (outcome = 'matched') FROM won UNION ALL "
    + _COUNTERS
)
def preview_compare(spark, d):
    old, new = _pair(spark, d)
    count = lambda df, n: df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(n).alias("counter"), "value")
    won = cut(cascade.match(old, new, "strict"))
    counts = count(old, "entries_old").unionByName(count(new, "entries_new")).unionByName(count(rewrite.compare_mapping(won), "primarykey_updates_available"))
    return counts.unionByName(cascade.match_stats(won))


@query(
    _match_sql("strict")
    + "SELECT rid, primary_key, CASE WHEN count(*) OVER (PARTITION BY new_key) > 1 THEN 'destination_collision' ELSE 'matched' END AS outcome, tier, new_rid, new_key FROM won WHERE outcome = 'matched'"
)
def match_one_to_one(spark, d):
    return cascade.one_to_one(cascade.match(*_pair(spark, d), "strict"))


@query(
    _match_sql("strict")
    + f""", crowd AS (SELECT rank, key FROM kn GROUP BY ALL HAVING count(*) > 1),
r AS (SELECT DISTINCT rid FROM ko JOIN crowd USING (rank, key))
SELECT artist, title, array_to_string({_PARTS.format('old')}, '/') || '/' || file AS old_path, CASE WHEN r.rid IS NOT NULL THEN 'ambiguous' ELSE 'unmatched' END AS reason
FROM old JOIN won ON won.rid = old.rid LEFT JOIN r ON r.rid = old.rid WHERE won.outcome <> 'matched'"""
)
def ambiguity_report(spark, d):
    old, new = _pair(spark, d)
    return cascade.ambiguity_report(old, new, cascade.match(old, new, "strict"), "strict")


@query(
    _match_sql("loose")
    + "SELECT met.rid, met.tier, met.nr AS new_rid, round(abs(o.filesize::DOUBLE - n.filesize::DOUBLE), 6) AS size_gap, round(abs(o.playtime_float::DOUBLE - n.playtime_float::DOUBLE), 6) AS time_gap "
    "FROM met JOIN old o ON o.rid = met.rid JOIN new n ON n.rid = met.nr WHERE refuted"
)
def refutation_detail(spark, d):
    return cascade.refutation_details(*_pair(spark, d), "loose")


@query(_match_sql("loose") + "SELECT rid, tier, kept, dropped AS refuted FROM bt")
def review_candidates(spark, d):
    return cascade.reviews(*_pair(spark, d), "loose")


_LABEL = "CASE WHEN tier IS NULL THEN 'None' WHEN tier IN ('audio_id','artist_title_size_time','artist_title_file','file_size_time') THEN 'Strong' WHEN tier IN ('artist_title_album_time','path_suffix_3') THEN 'Good' ELSE 'Weak' END"


@query(
    _match_sql("filename")
    + f"SELECT CASE WHEN outcome = 'matched' AND lower(regexp_extract(o.file, '\\.([^.]*)$', 1)) <> lower(regexp_extract(n.file, '\\.([^.]*)$', 1)) THEN 'format' ELSE outcome END AS status, {_LABEL} AS confidence, count(*) AS rows_ "
    "FROM won JOIN old o ON o.rid = won.rid LEFT JOIN new n ON n.rid = won.new_rid GROUP BY ALL"
)
def review_status_counts(spark, d):
    return cascade.review_rows(*_pair(spark, d), "filename").groupBy("status", "confidence").agg(F.count(F.lit(1)).alias("rows_"))


@query(
    _match_sql("strict").replace("SELECT old.rid,", "SELECT old.rid, old.part % 3 AS f,")
    + "SELECT 'backup_' || f AS source_file, count(*) AS entries, count(*) FILTER (outcome = 'matched') AS matched, count(*) FILTER (outcome = 'ambiguous') AS ambiguous, "
    "count(*) FILTER (outcome IN ('unmatched', 'refuted')) AS unmatched, round(count(*) FILTER (outcome = 'matched') / count(*), 6) AS ratio FROM won GROUP BY f"
)
def rank_backups(spark, d):
    old, new = _pair(spark, d)
    return cascade.rank_backups(new, old.withColumn("source_file", F.concat(F.lit("backup_"), (F.col("part") % 3).cast("string"))), "strict")


def _library_sql(level: str) -> str:
    """The cascade over the library's own rows: the main collection against all others, with blanks, unusable readings and all alphabets."""
    side = "SELECT entry_id AS rid, primary_key, artist, title, album, audio_id, filesize, playtime_float, file_name AS file, dir_value AS dir FROM tracks WHERE collection_id"
    sql = _match_sql(level).replace(adapter.NEW, f"old AS ({side} = 'col-main'), new AS ({side} <> 'col-main')")
    for c in ("filesize", "playtime_float"):
        digits = "regexp_matches({0}, '^\\s*[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?\\s*$')".format(c)
        sql = sql.replace(f"try_cast({c} AS DOUBLE)", f"CASE WHEN {digits} THEN try_cast({c} AS DOUBLE) END")
    # Case folding knows one sigma.
    return re.sub(r"lower\((artist|title|album|file)\)", r"replace(lower(\1), 'ς', 'σ')", sql)


def _library(spark, d):
    t = table(spark, d, "tracks").select("collection_id", F.col("entry_id").alias("rid"), "primary_key", "artist", "title", "album", "audio_id", "filesize", "playtime_float", F.col("file_name").alias("file"), F.col("dir_value").alias("dir"))
    main = F.col("collection_id") == "col-main"
    return t.where(main), t.where(~main)


@query(_library_sql("strict") + _OUT)
def match_library_strict(spark, d):
    return cascade.match(*_library(spark, d), "strict")


@query(_library_sql("filename") + _OUT)
def match_library_filename(spark, d):
    return cascade.match(*_library(spark, d), "filename")


# --- rewriting -------------------------------------------------------------------------------------

_RULES = [rewrite.Rule("C:", "/:Music/:PROMO", "E:", "/:Promo"), rewrite.Rule("C:", "/:Music/:", "F:", "/:Lib/:", "F-id"), rewrite.Rule("C:", "/:", "G:", "/:Rest/:")]
_RULED = """
SELECT *, CASE WHEN volume = 'C:' AND starts_with(dir, '/:Music/:PROMO') THEN 'E:' WHEN volume = 'C:' AND starts_with(dir, '/:Music/:') THEN 'F:' WHEN volume = 'C:' AND starts_with(dir, '/:') THEN 'G:' ELSE volume END AS nv,
  CASE WHEN volume = 'C:' AND starts_with(dir, '/:Music/:PROMO') THEN '/:Promo' || substr(dir, 15) WHEN volume = 'C:' AND starts_with(dir, '/:Music/:') THEN '/:Lib/:' || substr(dir, 10)
       WHEN volume = 'C:' AND starts_with(dir, '/:') THEN '/:Rest/:' || substr(dir, 3) ELSE dir END AS nd FROM old"""


@query(
    f"WITH {adapter.OLD}, z AS ({_RULED}) SELECT rid, primary_key AS old_key, nv || nd || file AS new_key, 'VOLUME,VOLUMEID,DIR' AS changes, TRUE AS hit FROM z"
)
def rule_rewrite_locations(spark, d):
    return rewrite.rewrite_locations(adapter.old(spark, d), _RULES)


@query(
    _match_sql("strict").replace(adapter.NEW, adapter.NEW + "," + adapter.LISTS)
    + f""", z AS ({_RULED}), mp AS (SELECT primary_key, arg_max(new_key, rid) AS nk FROM won WHERE outcome = 'matched' GROUP BY 1),
zz AS (SELECT primary_key, any_value(nv || nd || file) AS rk FROM z GROUP BY 1)
SELECT coalesce(how, 'rule') AS how, count(*) AS refs, count(DISTINCT new_key) AS keys FROM (
  SELECT CASE WHEN mp.nk IS NOT NULL THEN 'collection' ELSE 'rule' END AS how, coalesce(mp.nk, zz.rk) AS new_key FROM pl LEFT JOIN mp ON mp.primary_key = pl.key LEFT JOIN zz ON zz.primary_key = pl.key) GROUP BY 1"""
)
def compare_rewrite_keys(spark, d):
    mapping = rewrite.compare_mapping(cascade.match(*_pair(spark, d), "strict"))
    out = rewrite.rewrite_keys(adapter.playlist_keys(spark, d), mapping, _RULES)
    return out.groupBy("how").agg(F.count(F.lit(1)).alias("refs"), F.count_distinct("new_key").alias("keys"))


@query(_match_sql("loose") + "SELECT primary_key AS old_key, arg_max(new_key, rid) AS new_key FROM won WHERE outcome = 'matched' GROUP BY 1")
def compare_rewrite_locations(spark, d):
    return rewrite.compare_mapping(cascade.match(*_pair(spark, d), "loose"))


@query("SELECT DISTINCT volume, coalesce(volumeid, volume) AS volumeid FROM tracks WHERE starts_with(dir_value, '/:Users/:dj/:')")
def volume_identity(spark, d):
    return rewrite.infer_volume(table(spark, d, "tracks").withColumnRenamed("dir_value", "dir"), ["Users", "dj"])


# --- playlists -------------------------------------------------------------------------------------


@query(
    r"""WITH RECURSIVE r AS (
  SELECT collection_id, node_id, '' AS path, 0 AS depth, 'FOLDER' AS node_type FROM playlist_nodes WHERE parent_id IS NULL
  UNION ALL SELECT n.collection_id, n.node_id, CASE WHEN r.path = '' THEN coalesce(n.node_name, '') ELSE r.path || '\' || coalesce(n.node_name, '') END, r.depth + 1, n.node_type
  FROM r JOIN playlist_nodes n ON n.collection_id = r.collection_id AND n.parent_id = r.node_id WHERE r.node_type = 'FOLDER')
SELECT collection_id, node_id, path, depth FROM r WHERE depth > 0"""
)
def playlist_paths(spark, d):
    return playlists.tree_paths(table(spark, d, "playlist_nodes"))


@query(
    "WITH n AS (SELECT p.collection_id, p.node_id, p.declared_entries, count(e.ref_id) AS n FROM playlist_nodes p LEFT JOIN playlist_entries e USING (collection_id, node_id) WHERE node_type = 'PLAYLIST' GROUP BY ALL) "
    "SELECT collection_id, count(*) AS playlists, count(*) FILTER (n = 0) AS empty, count(*) FILTER (declared_entries <> n) AS misdeclared FROM n GROUP BY 1"
)
def playlist_summary(spark, d):
    return playlists.summary(table(spark, d, "playlist_nodes"), table(spark, d, "playlist_entries"))


@query(
    "SELECT collection_id, node_id, node_path, node_name, n = 1 AS unique_name FROM (SELECT *, count(*) OVER (PARTITION BY collection_id, node_name) AS n FROM playlist_nodes WHERE node_type = 'FOLDER') WHERE parent_id IS NOT NULL"
)
def folder_uniqueness(spark, d):
    return playlists.name_uniqueness(table(spark, d, "playlist_nodes"))


@query("SELECT collection_id, node_path AS path, max(node_id) AS node_id FROM playlist_nodes WHERE parent_id IS NOT NULL GROUP BY 1, 2")
def path_map(spark, d):
    return playlists.path_map(table(spark, d, "playlist_nodes").where("parent_id is not null").withColumnRenamed("node_path", "path"))


_PLMATCH = _match_sql("strict").replace(adapter.NEW, adapter.NEW + "," + adapter.LISTS) + ", mp AS (SELECT primary_key, arg_max(new_key, rid) AS nk FROM won WHERE outcome = 'matched' GROUP BY 1), red AS (SELECT node_id, pos, coalesce(nk, key) AS key FROM pl LEFT JOIN mp ON mp.primary_key = pl.key) "


@query(_PLMATCH + "SELECT node_id, pos, key FROM red")
def playlist_redirected(spark, d):
    mapping = rewrite.compare_mapping(cascade.match(*_pair(spark, d), "strict"))
    return playlists.redirect(adapter.playlist_keys(spark, d), mapping).select("node_id", "pos", "key")


@query(_PLMATCH + "SELECT node_id, count(*) AS dropped_entries, count(DISTINCT key) AS dropped_tracks FROM red WHERE key NOT IN (SELECT primary_key FROM new) GROUP BY 1")
def playlist_dropped_refs(spark, d):
    mapping = rewrite.compare_mapping(cascade.match(*_pair(spark, d), "strict"))
    keys = adapter.new(spark, d).select(F.col("primary_key").alias("key"))
    return playlists.dropped(playlists.redirect(adapter.playlist_keys(spark, d), mapping), keys)


_UNION = f"""WITH {adapter.PLAYLISTS},
bs AS (SELECT node_id, pos, key FROM pl WHERE node_id % 2 = 0),
inc AS (SELECT node_id - 1 AS node_id, node_id % 4 AS src, pos, key FROM pl WHERE node_id % 2 = 1),
fresh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id, key ORDER BY src, pos) AS r FROM inc) i WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM bs WHERE bs.node_id = i.node_id AND bs.key = i.key)),
u AS (SELECT node_id, CAST(row_number() OVER (PARTITION BY node_id ORDER BY src, pos) AS INTEGER) AS pos, key FROM (SELECT node_id, -1 AS src, pos, key FROM bs UNION ALL SELECT node_id, src, pos, key FROM fresh))
"""


def _unions(spark, d):
    pl = adapter.playlist_keys(spark, d)
    base = pl.where("node_id % 2 = 0")
    inc = pl.where("node_id % 2 = 1").select((F.col("node_id") - 1).alias("node_id"), (F.col("node_id") % 4).cast("int").alias("src"), "pos", "key")
    return base, inc, playlists.ordered_union(base, inc)


@query(_UNION + "SELECT node_id, pos, key FROM u")
def playlist_reconstruct(spark, d):
    return _unions(spark, d)[2]


@query(
    _UNION
    + """, s AS (SELECT node_id, list(key ORDER BY pos) AS k FROM u GROUP BY 1), t AS (SELECT node_id, list(key ORDER BY pos) AS k FROM bs GROUP BY 1)
SELECT count(*) AS playlists, count(*) FILTER (s.k IS NOT DISTINCT FROM t.k) AS unchanged, count(*) FILTER (t.k IS NULL) AS refilled FROM s LEFT JOIN t USING (node_id)"""
)
def reconstruct_stats(spark, d):
    base, _, union = _unions(spark, d)
    same = playlists.same_sequence(union, base).join(base.select("node_id", F.lit(True).alias("had")).distinct(), "node_id", "left")
    return same.agg(F.count(F.lit(1)).alias("playlists"), F.count_if("same").alias("unchanged"), F.count_if(F.col("had").isNull()).alias("refilled"))


@query(
    "WITH a AS (SELECT * FROM playlist_nodes WHERE node_type = 'PLAYLIST' AND collection_id = 'col-main'), i AS (SELECT * FROM playlist_nodes WHERE node_type = 'PLAYLIST' AND collection_id <> 'col-main'), "
    "bp AS (SELECT a.node_id AS base_id, i.node_id AS incoming_id FROM a JOIN i USING (node_path)), "
    "l AS (SELECT node_name, min(node_id) AS base_id FROM a WHERE node_id NOT IN (SELECT base_id FROM bp) GROUP BY 1 HAVING count(*) = 1), r AS (SELECT node_name, min(node_id) AS incoming_id FROM i WHERE node_id NOT IN (SELECT incoming_id FROM bp) GROUP BY 1 HAVING count(*) = 1) "
    "SELECT base_id, incoming_id, 'path' AS by FROM bp UNION ALL SELECT base_id, incoming_id, 'name' FROM l JOIN r USING (node_name)"
)
def playlist_pairing(spark, d):
    n = table(spark, d, "playlist_nodes").where("node_type = 'PLAYLIST'").select("collection_id", "node_id", F.col("node_path").alias("path"), F.col("node_name").alias("name"))
    return playlists.pair_by_path(n.where("collection_id = 'col-main'"), n.where("collection_id <> 'col-main'"))


@query()
def import_playlists(spark, d):
    """Names of the playlists of other collections beside those of the main one; renaming is sequential, so there is no SQL."""
    n = table(spark, d, "playlist_nodes").where("node_type = 'PLAYLIST'")
    wanted = n.where("collection_id <> 'col-main'").select(F.col("node_id").alias("ord"), F.col("node_name").alias("name"))
    return playlists.available_names(wanted, n.where("collection_id = 'col-main'").select(F.col("node_name").alias("name")))


@query(
    "WITH s AS (SELECT node_id AS ord, CASE WHEN node_id % 5 = 0 THEN '$' || node_path WHEN node_id % 7 = 0 THEN node_path || '\\gone' ELSE node_path END AS path FROM playlist_nodes WHERE parent_id IS NOT NULL), "
    "m AS (SELECT DISTINCT node_path AS old_path, 'Imported\\' || node_path AS new_path FROM playlist_nodes WHERE parent_id IS NOT NULL) "
    "SELECT ord, coalesce(new_path, s.path) AS path, new_path IS NULL AS orphan FROM s LEFT JOIN m ON m.old_path = s.path WHERE new_path IS NOT NULL OR NOT starts_with(s.path, '$')"
)
def sorting_info_carry(spark, d):
    n = table(spark, d, "playlist_nodes").where("parent_id is not null")
    path = F.when(F.col("node_id") % 5 == 0, F.concat(F.lit("$"), "node_path")).when(F.col("node_id") % 7 == 0, F.concat("node_path", F.lit("\\gone"))).otherwise(F.col("node_path"))
    renamed = n.select(F.col("node_path").alias("old_path"), F.concat(F.lit("Imported\\"), "node_path").alias("new_path")).distinct()
    kept, lost = playlists.carry_sorting(n.select(F.col("node_id").alias("ord"), path.alias("path")), renamed)
    return kept.withColumn("orphan", F.lit(False)).unionByName(lost.withColumn("orphan", F.lit(True)))


@query(
    "WITH c AS (SELECT node_name, max(node_id) AS node_id FROM playlist_nodes WHERE node_type = 'PLAYLIST' AND node_name IN ('Warmup', 'History', 'PL1') GROUP BY 1) "
    "SELECT node_name AS name, count(*) FILTER (e.primary_key IN (SELECT primary_key FROM tracks)) AS kept, count(e.ref_id) AS total FROM c LEFT JOIN playlist_entries e USING (node_id) GROUP BY 1"
)
def split_partial(spark, d):
    entries = table(spark, d, "playlist_entries").select("node_id", F.col("primary_key").alias("key"))
    valid = table(spark, d, "tracks").select(F.col("primary_key").alias("key"))
    return playlists.split(table(spark, d, "playlist_nodes"), entries, valid, ["Warmup", "History", "PL1"])


@query(
    "WITH c AS (SELECT max(node_id) AS node_id FROM playlist_nodes WHERE node_type = 'PLAYLIST' AND node_name IN ('Warmup', 'History') GROUP BY node_name) "
    "SELECT DISTINCT primary_key AS key FROM playlist_entries JOIN c USING (node_id) WHERE primary_key IN (SELECT primary_key FROM tracks)"
)
def split_exclude(spark, d):
    n = table(spark, d, "playlist_nodes").where("node_type = 'PLAYLIST' and node_name in ('Warmup', 'History')").groupBy("node_name").agg(F.max("node_id").alias("node_id"))
    entries = table(spark, d, "playlist_entries").join(n, "node_id", "left_semi").select("node_id", F.col("primary_key").alias("key"))
    return playlists.resolvable(entries, table(spark, d, "tracks").select(F.col("primary_key").alias("key"))).select("key").distinct()


@query(
    "WITH c AS (SELECT max(node_id) AS node_id FROM playlist_nodes WHERE node_type = 'PLAYLIST' AND node_name IN ('Warmup', 'History') GROUP BY node_name) "
    "SELECT node_id, count(*) AS dropped_entries, count(DISTINCT primary_key) AS dropped_tracks FROM playlist_entries JOIN c USING (node_id) WHERE primary_key NOT IN (SELECT primary_key FROM tracks) GROUP BY 1"
)
def split_fail_errors(spark, d):
    n = table(spark, d, "playlist_nodes").where("node_type = 'PLAYLIST' and node_name in ('Warmup', 'History')").groupBy("node_name").agg(F.max("node_id").alias("node_id"))
    entries = table(spark, d, "playlist_entries").join(n, "node_id", "left_semi").select("node_id", F.col("primary_key").alias("key"))
    return playlists.dropped(entries, table(spark, d, "tracks").select(F.col("primary_key").alias("key")))


_REBUILT = """WITH bn AS (SELECT node_id, node_path AS path, node_name AS name FROM playlist_nodes WHERE node_type = 'PLAYLIST' AND collection_id = 'col-main' QUALIFY count(*) OVER (PARTITION BY node_path) = 1),
i AS (SELECT collection_id AS src, node_id, node_path AS path, node_name AS name FROM playlist_nodes WHERE node_type = 'PLAYLIST' AND collection_id <> 'col-main' QUALIFY count(*) OVER (PARTITION BY collection_id, node_path) = 1),
pr AS (SELECT bn.node_id AS base_id, i.src, i.node_id FROM bn JOIN i USING (path) UNION ALL
  SELECT b.base_id, x.src, x.node_id FROM (SELECT name, min(node_id) AS base_id, min(path) AS path FROM bn GROUP BY 1 HAVING count(*) = 1) b JOIN (SELECT name, min(src) AS src, min(node_id) AS node_id FROM i GROUP BY 1 HAVING count(*) = 1) x USING (name) WHERE b.path NOT IN (SELECT path FROM i)),
e AS (SELECT collection_id, node_id, row_number() OVER (PARTITION BY collection_id, node_id ORDER BY pos, ref_id) AS pos, coalesce(primary_key, '') AS key FROM playlist_entries),
be AS (SELECT node_id, pos, key FROM e WHERE collection_id = 'col-main'),
th AS (SELECT base_id AS node_id, key, min({'s': pr.src, 'n': pr.node_id, 'p': e.pos}) AS src FROM pr JOIN e ON e.collection_id = pr.src AND e.node_id = pr.node_id GROUP BY 1, 2),
lb AS (SELECT node_id, list(key ORDER BY pos) AS k FROM be GROUP BY 1), lt AS (SELECT node_id, list(key ORDER BY src) AS k FROM th GROUP BY 1),
ch AS (SELECT DISTINCT base_id AS node_id FROM pr LEFT JOIN lb ON lb.node_id = base_id LEFT JOIN lt ON lt.node_id = base_id WHERE coalesce(lb.k, []) <> coalesce(lt.k, [])),
u AS (SELECT node_id, 0 AS fresh, key FROM be UNION ALL SELECT node_id, 1, key FROM th WHERE (node_id, key) NOT IN (SELECT node_id, key FROM be)),
kept AS (SELECT u.* FROM u JOIN ch USING (node_id) WHERE key IN (SELECT primary_key FROM tracks WHERE removed_at IS NULL AND primary_key IS NOT NULL))
SELECT ch.node_id, bn.path, count(kept.key) AS entries, count(kept.key) FILTER (fresh = 1) AS added, ch.node_id NOT IN (SELECT node_id FROM be) AS was_empty FROM ch JOIN bn USING (node_id) LEFT JOIN kept USING (node_id) GROUP BY 1, 2"""


def _rebuilt(spark, d):
    """The playlists of the main collection rebuilt from those of all others; paths that stand twice are left out, since they stop a run."""
    n = table(spark, d, "playlist_nodes").where("node_type = 'PLAYLIST'").select("collection_id", "node_id", F.col("node_path").alias("path"), F.col("node_name").alias("name"))
    once = n.groupBy("collection_id", "path").agg(F.count(F.lit(1)).alias("c")).where("c = 1").drop("c")
    n = cut(n.join(once, ["collection_id", "path"], "left_semi"))
    w = Window.partitionBy("collection_id", "node_id").orderBy("pos", "ref_id")
    e = table(spark, d, "playlist_entries").select("collection_id", "node_id", F.row_number().over(w).alias("pos"), F.coalesce("primary_key", F.lit("")).alias("key"))
    main = F.col("collection_id") == "col-main"
    valid = table(spark, d, "tracks").where("removed_at is null and primary_key is not null").select(F.col("primary_key").alias("key"))
    none = valid.limit(0)
    return rebuild.reconstruct(
        n.where(main).drop("collection_id"), e.where(main).drop("collection_id"), n.where(~main).withColumnRenamed("collection_id", "src"), e.where(~main).withColumnRenamed("collection_id", "src"),
        none.select(F.col("key").alias("old_key"), F.col("key").alias("new_key")), valid, none,
    )


@query(_REBUILT)
def playlist_rebuilt_counts(spark, d):
    return _rebuilt(spark, d)["counts"].select("node_id", "path", "entries", "added", "was_empty")


# --- merge -----------------------------------------------------------------------------------------

_GROUPED = f"""WITH RECURSIVE {adapter.MERGE},
k AS (SELECT rid, rank, key FROM ({_key_sql('inputs', 'strict')}) WHERE key IS NOT NULL),
e AS (SELECT DISTINCT k.rid, l.low FROM k JOIN (SELECT rank, key, min(rid) AS low FROM k GROUP BY ALL HAVING count(*) > 1) l USING (rank, key)),
s AS (SELECT rid AS a, low AS b FROM e WHERE rid <> low UNION SELECT low, rid FROM e WHERE rid <> low),
w AS (SELECT rid, rid AS lab FROM inputs UNION SELECT s.b, w.lab FROM w JOIN s ON s.a = w.rid),
g AS (SELECT rid, min(lab) AS group_id FROM w GROUP BY 1),
m AS (SELECT inputs.*, group_id FROM inputs JOIN g USING (rid)),
f AS (SELECT group_id, count(*) AS members, count(DISTINCT input_idx) AS inputs, count(*) FILTER (input_idx = 0) AS base_members, count(DISTINCT primary_key) AS keys,
  CASE WHEN count(*) FILTER (input_idx = 0) = 1 THEN min(primary_key) FILTER (input_idx = 0) ELSE array_to_string(list_sort(list(primary_key)), '|') END AS identity_key,
  array_to_string(list_filter([{", ".join(f"CASE WHEN count(DISTINCT {a}) > 1 THEN '{a}' END" for a in model.TRACKED)}], lambda x: x IS NOT NULL), ',') AS attrs,
  array_to_string(list_filter([{", ".join(f"CASE WHEN count(DISTINCT {a}) > 1 THEN '{a}' END" for a in model.EDITORIAL)}], lambda x: x IS NOT NULL), ',') AS editorial,
  array_to_string(list_filter([{", ".join(f"CASE WHEN count(DISTINCT {a}) > 1 THEN '{a}' END" for a in model.MEASURED)}], lambda x: x IS NOT NULL), ',') AS measured,
  bool_and({" AND ".join(f"try_cast({a} AS DOUBLE) IS NOT NULL" for a in model.MEASURED)}) AS readable FROM m GROUP BY 1),
facts AS (SELECT * EXCLUDE readable, CASE WHEN inputs < 2 THEN 'single' WHEN attrs = '' THEN 'agree' WHEN measured <> '' AND editorial = '' AND keys = 1 AND base_members > 0 AND readable THEN 'settled' ELSE 'conflict' END AS state FROM f)
"""


def _groups(spark, d):
    r = cut(adapter.merge_inputs(spark, d))
    return r, cut(merge.identity_groups(r))


@query(_GROUPED + "SELECT rid, group_id FROM g")
def identity_groups(spark, d):
    return _groups(spark, d)[1]


@query(_GROUPED + "SELECT group_id, identity_key, members, inputs, base_members, keys, attrs, editorial, measured, state FROM facts")
def divergent_attrs(spark, d):
    return merge.group_facts(*_groups(spark, d))


@query(_GROUPED + "SELECT identity_key, attrs, 'unresolved' AS resolution FROM facts WHERE state = 'conflict'")
def conflict_rows(spark, d):
    return merge.group_facts(*_groups(spark, d)).where("state = 'conflict'").select("identity_key", "attrs", F.lit("unresolved").alias("resolution"))


@query(_GROUPED + "SELECT identity_key, attrs, measured FROM facts WHERE state = 'settled'")
def settled_rows(spark, d):
    return merge.group_facts(*_groups(spark, d)).where("state = 'settled'").select("identity_key", "attrs", "measured")


_KEPT = ", kept AS (SELECT group_id, rid, primary_key FROM m QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY (input_idx > 0)::INT, {0}input_idx, rid) = 1) "


@query(_GROUPED + _KEPT.format("") + "SELECT group_id, rid, primary_key FROM kept")
def merge_keep_first(spark, d):
    return merge.survivors(*_groups(spark, d), "first")


@query(_GROUPED + _KEPT.format("-") + "SELECT group_id, rid, primary_key FROM kept")
def merge_keep_last(spark, d):
    return merge.survivors(*_groups(spark, d), "last")


@query(
    _GROUPED + _KEPT.format("")
    + "SELECT DISTINCT m.primary_key AS old_key, kept.primary_key AS new_key FROM m JOIN kept USING (group_id) JOIN facts USING (group_id) WHERE facts.inputs > 1 AND m.rid <> kept.rid AND m.primary_key <> kept.primary_key"
)
def key_redirects(spark, d):
    r, g = _groups(spark, d)
    return merge.redirects(r, g, merge.survivors(r, g))


@query(
    _GROUPED + _KEPT.format("")
    + """, c AS (SELECT m.group_id, u.attr, u.other, u.kept FROM m JOIN kept k USING (group_id) JOIN m kk ON kk.rid = k.rid JOIN facts ON facts.group_id = m.group_id AND state = 'settled',
  LATERAL (VALUES ('filesize', m.filesize, kk.filesize), ('playtime_float', m.playtime_float, kk.playtime_float), ('bitrate', m.bitrate, kk.bitrate)) u(attr, other, kept)),
x AS (SELECT *, abs(kept::DECIMAL(18,6) - other::DECIMAL(18,6))::DOUBLE / greatest(kept::DECIMAL(18,6), other::DECIMAL(18,6))::DOUBLE AS gap FROM c)
SELECT group_id, attr, kept, other, round(gap, 6) AS gap FROM x WHERE gap > 0.01 QUALIFY row_number() OVER (PARTITION BY group_id, attr ORDER BY gap DESC, other) = 1"""
)
def outlier_readings(spark, d):
    r, g = _groups(spark, d)
    return merge.outlier_readings(r, g, merge.survivors(r, g))


@query(
    _GROUPED
    + f""", v AS (SELECT group_id, concat_ws(chr(31), {", ".join(model.TRACKED)}) AS vals, min(rid) AS first, array_to_string(list_sort(list(input_idx || ':' || primary_key)), '|') AS contributors FROM m JOIN facts USING (group_id) WHERE state = 'conflict' GROUP BY 1, 2)
SELECT group_id, CAST(row_number() OVER (PARTITION BY group_id ORDER BY first) AS INTEGER) AS candidate, vals AS "values", contributors FROM v"""
)
def conflict_candidates(spark, d):
    return merge.conflict_candidates(*_groups(spark, d))


@query(
    _GROUPED + _KEPT.format("")
    + ", o AS (SELECT primary_key FROM inputs WHERE input_idx = 0 UNION ALL SELECT kept.primary_key FROM kept JOIN (SELECT group_id FROM m GROUP BY 1 HAVING min(input_idx) > 0) USING (group_id)) "
    "SELECT 'duplicate_key' AS problem, primary_key AS key FROM o GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT DISTINCT 'unresolvable_key', primary_key FROM inputs WHERE primary_key NOT IN (SELECT primary_key FROM o)"
)
def merge_validation(spark, d):
    r, g = _groups(spark, d)
    return merge.validate(merge.merged(r, g, merge.survivors(r, g)), r.select(F.col("primary_key").alias("key")))


_TR = ", ".join(f"coalesce(t.{a}, '') AS {a}" for a in model.TRACKED)
_NUM = "regexp_matches({0}, '^\\s*[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?\\s*$')"
_RESOLVE = f"""WITH m AS (SELECT DISTINCT c.identity_key AS group_id, c.entry_id AS rid, c.input_idx, t.primary_key, {_TR} FROM conflict_members c JOIN tracks t USING (entry_id) WHERE c.identity_key IS NOT NULL),
f0 AS (SELECT group_id, count(DISTINCT input_idx) AS inputs, count(*) FILTER (input_idx = 0) AS base_members, count(DISTINCT primary_key) AS keys,
  CASE WHEN count(*) FILTER (input_idx = 0) = 1 THEN min(primary_key) FILTER (input_idx = 0) ELSE array_to_string(list_sort(list(primary_key)), '|') END AS identity_key,
  array_to_string(list_filter([{", ".join(f"CASE WHEN count(DISTINCT {a}) > 1 THEN '{a}' END" for a in model.TRACKED)}], lambda x: x IS NOT NULL), ',') AS attrs,
  {" OR ".join(f"count(DISTINCT {a}) > 1" for a in model.EDITORIAL)} AS editorial, {" AND ".join(f"(count(DISTINCT {a}) = 1 OR bool_and({_NUM.format(a)}))" for a in model.MEASURED)} AS readable,
  min(rid) AS low, min({{'i': input_idx, 'r': rid}}) AS head, min(rid) FILTER (input_idx = 0) AS base, min({{'i': ORDER_ * input_idx, 'r': rid}}) FILTER (input_idx <> 0) AS other FROM m GROUP BY 1),
f AS (SELECT *, CASE WHEN inputs < 2 THEN 'single' WHEN attrs = '' THEN 'agree' WHEN NOT editorial AND keys = 1 AND base_members > 0 AND readable THEN 'settled' ELSE 'conflict' END AS state FROM f0),
said AS (SELECT DISTINCT f.identity_key, m.input_idx, m.primary_key FROM f JOIN m USING (group_id) WHERE f.low % 3 = 0 QUALIFY row_number() OVER (PARTITION BY f.group_id ORDER BY m.rid DESC, m.input_idx) = 1),
pk AS (SELECT f.group_id, min({{'i': m.input_idx, 'r': m.rid}}) AS picked FROM f JOIN said USING (identity_key) JOIN m ON m.group_id = f.group_id AND m.input_idx = said.input_idx AND m.primary_key = said.primary_key WHERE state = 'conflict' AND USE_ GROUP BY 1),
w AS (SELECT f.*, picked.r AS picked_rid, CASE WHEN state = 'conflict' AND picked IS NULL AND POLICY_ IS NULL THEN NULL WHEN state = 'single' THEN head.r WHEN base IS NOT NULL THEN base ELSE coalesce(picked.r, other.r) END AS winner,
  CASE WHEN state = 'conflict' THEN CASE WHEN picked IS NOT NULL THEN picked.i || ':' || (SELECT min(primary_key) FROM m WHERE m.rid = picked.r AND m.group_id = f.group_id) ELSE coalesce(POLICY_, 'unresolved') END END AS resolution FROM f LEFT JOIN pk USING (group_id)),
o AS (SELECT w.*, m.input_idx AS winner_input, m.primary_key AS winner_key FROM w LEFT JOIN m ON m.group_id = w.group_id AND m.rid = w.winner
  QUALIFY row_number() OVER (PARTITION BY w.group_id ORDER BY CASE WHEN w.base IS NOT NULL AND m.input_idx = 0 THEN 0 ELSE 1 END, m.input_idx) = 1)
"""


def _resolve_sql(policy: str | None, picks: bool) -> str:
    return _RESOLVE.replace("ORDER_", "-1" if policy == "keep-last" else "1").replace("POLICY_", f"'{policy}'" if policy else "CAST(NULL AS VARCHAR)").replace("USE_", "TRUE" if picks else "FALSE")


def _members(spark, d):
    """Members of the contested groups of the library, with picks for a third of them: the member with the greatest id."""
    c = table(spark, d, "conflict_members").where("identity_key is not null").select(F.col("identity_key").alias("group_id"), F.col("entry_id").alias("rid"), "input_idx").distinct()
    t = table(spark, d, "tracks").select(F.col("entry_id").alias("rid"), "primary_key", *model.TRACKED)
    return resolve.members_of(c.join(t, "rid").drop("group_id"), c.select("rid", "group_id").distinct())


def _picks(members):
    facts = merge.group_facts(members.drop("group_id"), members.select("rid", "group_id")).select("group_id", "identity_key")
    last = members.groupBy("group_id").agg(F.min("rid").alias("low"), F.max_by(F.struct("input_idx", "primary_key"), F.struct("rid", -F.col("input_idx"))).alias("p")).where("low % 3 = 0")
    return facts.join(last, "group_id").select("identity_key", "p.input_idx", "p.primary_key")


@query(_resolve_sql("keep-last", True) + "SELECT group_id, identity_key, state, attrs, resolution, winner AS winner_rid, winner_input, winner_key, coalesce(winner_input <> 0, FALSE) AS adds FROM o")
def merge_resolved(spark, d):
    members = _members(spark, d)
    return resolve.resolve(members, _picks(members), "keep-last").select("group_id", "identity_key", "state", "attrs", "resolution", "winner_rid", "winner_input", "winner_key", "adds")


@query(
    _resolve_sql("keep-first", True)
    + "SELECT winner AS rid, winner_key AS primary_key, u.attr, u.value FROM o JOIN m ON m.group_id = o.group_id AND m.rid = o.picked_rid, LATERAL (VALUES "
    + ", ".join(f"('{a}', m.{a})" for a in model.TRACKED) + ") u(attr, value) WHERE o.state <> 'single' AND o.base IS NOT NULL AND picked_rid <> o.base AND list_contains(string_split(attrs, ','), u.attr)"
)
def entry_patches(spark, d):
    members = _members(spark, d)
    return resolve.entry_patches(members, resolve.resolve(members, _picks(members), "keep-first"))


@query(_resolve_sql("keep-first", False) + "SELECT DISTINCT m.primary_key AS key FROM m JOIN o USING (group_id) WHERE m.input_idx <> 0 AND inputs > 1 AND base_members > 1")
def ambiguous_keys(spark, d):
    members = _members(spark, d)
    return resolve.ambiguous_keys(members, resolve.resolve(members, None, "keep-first"))


@query(_resolve_sql(None, True) + "SELECT 'conflicts_outstanding' AS reason, count(*) AS groups FROM o WHERE resolution = 'unresolved' HAVING count(*) > 0")
def run_refusals(spark, d):
    members = _members(spark, d)
    return resolve.refusals(resolve.resolve(members, _picks(members)))


@query(_resolve_sql(None, False) + "SELECT o.group_id, u.attr, min(u.value) AS value FROM o JOIN m USING (group_id), LATERAL (VALUES " + ", ".join(f"('{a}', m.{a})" for a in model.TRACKED) + ") u(attr, value) WHERE state = 'conflict' AND NOT list_contains(string_split(attrs, ','), u.attr) GROUP BY 1, 2")
def agreed_attributes(spark, d):
    members = _members(spark, d)
    return resolve.agreed(members, resolve.resolve(members))


@query(
    _match_sql("strict")
    + f""", crowd AS (SELECT rank, key FROM kn GROUP BY ALL HAVING count(*) > 1), r AS (SELECT DISTINCT rid FROM ko JOIN crowd USING (rank, key)),
z AS (SELECT *, outcome = 'matched' AND count(*) OVER (PARTITION BY new_rid, outcome) > 1 AS lost FROM won)
SELECT z.rid, z.primary_key, artist, title, array_to_string({_PARTS.format('old')}, '/') || '/' || file AS old_path, CASE WHEN lost THEN 'destination_collision' ELSE outcome END AS outcome,
  CASE WHEN outcome = 'matched' AND NOT lost THEN tier END AS tier, CASE WHEN outcome = 'matched' AND NOT lost THEN new_rid END AS new_rid, CASE WHEN outcome = 'matched' AND NOT lost THEN new_key END AS new_key,
  CASE WHEN lost THEN 'destination_collision' WHEN outcome = 'matched' THEN NULL WHEN r.rid IS NOT NULL THEN 'ambiguous' ELSE 'unmatched' END AS reason FROM z JOIN old ON old.rid = z.rid LEFT JOIN r ON r.rid = z.rid"""
)
def reconnect_resolved(spark, d):
    return reconnect.resolve(*_pair(spark, d), "strict")


# --- lists, discovery, fingerprints, measurements ---------------------------------------------------

_LINES = "SELECT p_partkey AS line, CASE WHEN p_partkey % 13 = 0 THEN '' WHEN p_partkey % 11 = 0 THEN '# ' || p_name WHEN p_partkey % 7 = 0 THEN p_partkey || ' ' || p_name ELSE p_partkey || ' - ' || p_brand || ' - ' || p_name END AS raw FROM part"
_PARSED = f"""WITH l AS ({_LINES}), z AS (SELECT line, trim(raw) AS t, regexp_replace(trim(raw), '^\\d+\\s*-\\s*', '') AS body FROM l),
parsed AS (SELECT line, CASE WHEN t = '' OR starts_with(t, '#') THEN 'skip' WHEN strpos(body, ' - ') = 0 THEN 'unparseable' ELSE 'track' END AS kind, body FROM z),
req AS (SELECT line, kind, CASE WHEN kind = 'track' THEN trim(substr(body, 1, strpos(body, ' - ') - 1)) END AS artist, CASE WHEN kind = 'track' THEN trim(substr(body, strpos(body, ' - ') + 3)) END AS title FROM parsed)
"""


def _requests(spark, d):
    k, name = F.col("p_partkey"), F.col("p_name")
    num = k.cast("string")
    raw = F.when(k % 13 == 0, "").when(k % 11 == 0, F.concat(F.lit("# "), name)).when(k % 7 == 0, F.concat_ws(" ", num, name)).otherwise(F.concat_ws(" - ", num, "p_brand", name))
    return table(spark, d, "part").select(k.alias("line"), raw.alias("raw")).select("line", text.parse_line(F.col("raw")).alias("p")).select("line", "p.*")


@query(_PARSED + "SELECT line, kind, artist, title FROM req")
def parse_tracklist(spark, d):
    return _requests(spark, d)


@query(
    "SELECT ref, CASE WHEN ref % 3 = 0 THEN printf('%.3f', (ref % 500 + 1)::DOUBLE) WHEN ref % 3 = 1 AND (ref % 90) * 60 + ref % 60 > 0 THEN printf('%.3f', ((ref % 90) * 60 + ref % 60)::DOUBLE) ELSE '' END AS seconds FROM (SELECT p_partkey AS ref FROM part)"
)
def parse_duration(spark, d):
    k = F.col("p_partkey")
    raw = F.when(k % 3 == 0, (k % 500 + 1).cast("string")).when(k % 3 == 1, F.format_string("%d:%02d", k % 90, k % 60)).otherwise("n/a")
    return table(spark, d, "part").select(k.alias("ref"), numbers.parse_duration(raw).alias("seconds"))


@query("SELECT p_partkey AS ref, row_number() OVER (ORDER BY lower(p_brand), p_partkey % 997, p_partkey) AS rank FROM part")
def natural_sort(spark, d):
    part = F.col("p_partkey")
    key = text.natural_key(F.concat(F.lit("track"), (part % 997).cast("string")))
    p = table(spark, d, "part").select(part.alias("ref"), F.lower("p_brand").alias("brand"), key.alias("key"))
    return playlists.positions(p, [F.col("brand"), F.col("key"), F.col("ref")], "rank").select("ref", "rank")


def _resolved(spark, d):
    req = _requests(spark, d)
    blank = [F.lit("").alias(c) for c in ("album", "audio_id", "filesize", "playtime_float", "file", "dir", "primary_key")]
    asked = req.where("kind = 'track'").select(F.col("line").alias("rid"), "artist", "title", *blank)
    return discover.resolve_lines(req, cascade.match(asked, adapter.old(spark, d), "loose"))


_RESOLVED = f"""WITH {adapter.OLD}, {_PARSED.split("WITH ", 1)[1].strip()},
hit AS (SELECT r.line, count(*) AS n, min(o.rid) AS rid FROM req r JOIN old o ON lower(o.artist) = lower(r.artist) AND lower(o.title) = lower(r.title) WHERE kind = 'track' GROUP BY 1),
res AS (SELECT req.line, CASE WHEN kind = 'unparseable' THEN 'unparseable' WHEN n = 1 THEN 'matched' WHEN n > 1 THEN 'ambiguous' ELSE 'unmatched' END AS outcome, CASE WHEN n = 1 THEN old.primary_key END AS key
  FROM req LEFT JOIN hit USING (line) LEFT JOIN old ON old.rid = hit.rid WHERE kind <> 'skip')
"""


@query(_RESOLVED + "SELECT line, outcome, key FROM res")
def build_playlist_resolution(spark, d):
    return _resolved(spark, d)


@query(_RESOLVED + "SELECT outcome, count(*) AS lines FROM res GROUP BY 1")
def build_playlist_counts(spark, d):
    return _resolved(spark, d).groupBy("outcome").agg(F.count(F.lit(1)).alias("lines"))


@query(_RESOLVED + "SELECT CAST(row_number() OVER (ORDER BY line) AS INTEGER) AS pos, key FROM res WHERE outcome = 'matched'")
def build_playlist(spark, d):
    return discover.build_playlist(_resolved(spark, d))


@query(_RESOLVED + "SELECT line, outcome AS kind FROM res WHERE outcome <> 'matched'")
def unresolved_rows(spark, d):
    return _resolved(spark, d).where("outcome <> 'matched'").select("line", F.col("outcome").alias("kind"))


def _asked(spark, d):
    t = table(spark, d, "request_lines").where("artist is not null and line_id % 20 = 0").select(F.col("line_id").alias("line"), "artist", "title")
    o = table(spark, d, "disk_files").select(
        F.col("file_id").alias("cand"), F.col("artist").alias("c_artist"), F.col("title").alias("c_title"),
        text.file_label(F.col("file_name")).alias("c_label"), F.concat("scan_root", "file_name").alias("c_path"),
    )
    return t, o


@query()
def discover_topk(spark, d):
    """Block ratio of two texts has no SQL; tested against a brute-force pass over all pairs."""
    return discover.rank(*_asked(spark, d))


_TOK = "list_filter(list_distinct(string_split(trim(regexp_replace(lower(strip_accents({0})), '[^a-z0-9]+', ' ', 'g')), ' ')), lambda x: x <> '' AND x NOT IN (" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "))"


@query(
    f"""WITH r AS (SELECT p_partkey AS line, {_TOK.format("p_name || ' ' || p_type")} AS tt FROM part WHERE p_partkey % 20 = 0),
o AS (SELECT p_partkey AS cand, {_TOK.format("p_name")} AS ct FROM part),
s AS (SELECT line, cand, round(len(list_intersect(tt, ct)) / len(tt), 6) AS score FROM r JOIN o ON len(list_intersect(tt, ct)) > 0)
SELECT line, CAST(row_number() OVER (PARTITION BY line ORDER BY score DESC, cand) AS INTEGER) AS rank, cand, score FROM s QUALIFY rank <= 3"""
)
def discover_coverage(spark, d):
    p = table(spark, d, "part")
    asked = p.where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("line"), F.lit("").alias("artist"), F.concat_ws(" ", "p_name", "p_type").alias("title"))
    return discover.rank_by_coverage(asked, p.select(F.col("p_partkey").alias("cand"), F.lit("").alias("c_artist"), F.col("p_name").alias("c_title")))


_FP = """WITH e AS (SELECT vec_id AS id, 180.0 + vec_id % 7 AS sec, embedding AS fp FROM embeddings),
c AS (SELECT vec_id + 1000000 AS id, 180.0 + vec_id % 7 AS sec, list_transform(embedding, lambda x, i: CASE WHEN i <= [0, 4, 12, 32][vec_id % 4 + 1] THEN 0 ELSE x END) AS fp FROM embeddings),
s AS (SELECT l.id AS left_id, r.id AS right_id, list_cosine_similarity(l.fp::DOUBLE[], r.fp::DOUBLE[]) AS sim FROM {0} l JOIN {1} r ON abs(l.sec - r.sec) <= 1.0)
"""


def _prints(spark, d):
    v = table(spark, d, "embeddings")
    e = v.select(F.col("vec_id").alias("id"), (180.0 + F.col("vec_id") % 7).alias("sec"), F.col("embedding").alias("fp"))
    cutoff = F.element_at(F.array(F.lit(0), F.lit(4), F.lit(12), F.lit(32)), (F.col("id") % 4 + 1).cast("int"))
    c = e.withColumn("fp", F.transform("fp", lambda x, i: F.when(i < cutoff, F.lit(0.0).cast("float")).otherwise(x))).withColumn("id", F.col("id") + 1_000_000)
    return e, c


@query(_FP.format("e", "c") + "SELECT left_id, right_id, round(sim, 6) AS similarity, CASE WHEN sim > 0.95 THEN 'match' ELSE 'near' END AS verdict FROM s WHERE sim >= 0.80")
def fingerprint_match(spark, d):
    return fingerprint.similar(*_prints(spark, d))


@query(
    _FP.format("a", "a").replace("s AS (", "a AS (SELECT * FROM e UNION ALL SELECT * FROM c), s AS (", 1).replace("WITH e", "WITH RECURSIVE e")
    + ", x AS (SELECT left_id AS p, right_id AS q FROM s WHERE sim > 0.95 AND left_id <> right_id), w AS (SELECT DISTINCT p AS id, p AS lab FROM x UNION SELECT x.q, w.lab FROM w JOIN x ON x.p = w.id) SELECT id, min(lab) AS group_id FROM w GROUP BY 1"
)
def fingerprint_clusters(spark, d):
    e, c = _prints(spark, d)
    return fingerprint.clusters(e.unionByName(c))


_READ = r"CASE WHEN regexp_matches(playtime_float, '^\s*[+-]?(\d+(\.\d*)?|\.\d+)\s*$') THEN CAST(round(try_cast(playtime_float AS DOUBLE) * 1000000) AS BIGINT) END"


@query(
    "WITH t AS (SELECT entry_id, audio_id, replace(lower(coalesce(artist,'')), 'ς', 'σ') || chr(31) || replace(lower(coalesce(title,'')), 'ς', 'σ') AS names, coalesce(filesize,'') AS f, coalesce(playtime_float,'') AS p, coalesce(bitrate,'') AS b, "
    + _READ
    + " AS us FROM tracks WHERE audio_id <> '') SELECT x.audio_id, count(*) AS pairs, count(*) FILTER (NOT ((x.names = y.names AND coalesce(abs(x.us - y.us) <= 1000000, FALSE)) OR "
    "(x.f <> '' AND x.p <> '' AND x.b <> '' AND x.f = y.f AND x.p = y.p AND x.b = y.b))) AS collisions FROM t x JOIN t y ON x.audio_id = y.audio_id AND x.entry_id < y.entry_id GROUP BY 1"
)
def audio_id_collisions(spark, d):
    return measures.false_collisions(table(spark, d, "tracks"))


@query(
    f"WITH {adapter.NEW}, a AS (SELECT replace(primary_key, 'C:', '') AS k, max(audio_id) AS a FROM old GROUP BY 1), c AS (SELECT replace(primary_key, 'D:', '') AS k, max(audio_id) AS b FROM new GROUP BY 1) "
    "SELECT count(*) AS common_keys, count(*) FILTER (a = b) AS same_audio_id, round(avg((a = b)::INT), 6) AS share FROM a JOIN c USING (k)"
)
def reanalysis_stability(spark, d):
    old, new = _pair(spark, d)
    bare = lambda df, v: df.withColumn("primary_key", F.replace("primary_key", F.lit(v), F.lit("")))
    return measures.reanalysis_stability(bare(old, "C:"), bare(new, "D:"))


@query(
    "WITH k AS (SELECT DISTINCT collection_id, primary_key FROM tracks) SELECT 'PLAYLIST/PRIMARYKEY@KEY[' || coalesce(key_type, '') || ']' AS shape, count(*) AS refs, count(k.primary_key) AS resolved "
    "FROM playlist_entries e LEFT JOIN k ON k.collection_id = e.collection_id AND k.primary_key = e.primary_key GROUP BY 1"
)
def reference_inventory(spark, d):
    return measures.reference_inventory(table(spark, d, "tracks"), table(spark, d, "playlist_entries"))


@query(
    "SELECT held_by, count(*) AS groups FROM (SELECT CASE WHEN bool_and(removed_at IS NOT NULL) THEN 'all' WHEN bool_or(removed_at IS NOT NULL) THEN 'some' ELSE 'none' END AS held_by FROM tracks WHERE audio_id <> '' GROUP BY audio_id HAVING count(*) > 1) GROUP BY 1"
)
def play_overlap(spark, d):
    return measures.overlap(table(spark, d, "tracks"), "removed_at")


@query(
    r"""WITH t AS (SELECT entry_id, coalesce(audio_id, '') AS aid, starts_with(dir_value, '/:Backup/:') AS inside, replace(lower(regexp_replace(file_name, '(.)\.[^.]*$', '\1')), 'ς', 'σ') AS stem, lower(regexp_extract(file_name, '.(\.[^.]*)$', 1)) AS suffix FROM tracks WHERE file_name <> ''),
o AS (SELECT stem, arg_min(aid, entry_id) AS aid, arg_min(suffix, entry_id) AS suffix FROM t WHERE NOT inside GROUP BY 1),
c AS (SELECT t.suffix = o.suffix AS same, t.aid <> '' AND t.aid = o.aid AS agree FROM t JOIN o USING (stem) WHERE inside AND t.suffix IN ('.mp3', '.flac', '.wav', '.aiff', '.aif', '.m4a', '.ogg'))
SELECT round(coalesce(avg(agree::INT) FILTER (same), 0.0), 6) AS copy_rate, round(coalesce(avg(agree::INT) FILTER (NOT same), 0.0), 6) AS format_rate, count(*) FILTER (same) AS copies, count(*) FILTER (NOT same) AS formats FROM c"""
)
def copy_agreement(spark, d):
    return measures.copy_agreement(table(spark, d, "tracks"), ["Backup"])


@query(
    "SELECT f.file_id, f.scan_root || f.file_name || '|' || f.filesize || '|' || CAST(epoch(f.mtime) AS BIGINT) AS cache_key FROM disk_files f WHERE file_id % 3 <> 0 OR filesize IS NULL OR mtime IS NULL"
)
def cache_misses(spark, d):
    files = table(spark, d, "disk_files").select(
        "file_id", F.concat("scan_root", "file_name").alias("path"), F.col("filesize").alias("size"), F.unix_timestamp(F.col("mtime").cast("timestamp")).alias("mtime")
    )
    keyed = files.withColumn("cache_key", tagcache.cache_key())
    cache = keyed.where("file_id % 3 = 0").select("cache_key", F.lit(None).cast("string").alias("tags"))
    return tagcache.misses(keyed, cache).select("file_id", "cache_key")


# --- reports ---------------------------------------------------------------------------------------


@query(
    "WITH n AS (SELECT node_name || ' #' || p.node_id AS label, count(e.ref_id) AS value FROM playlist_nodes p JOIN playlist_entries e USING (collection_id, node_id) GROUP BY 1), "
    "r AS (SELECT row_number() OVER (ORDER BY value DESC, label) AS rank, label, value::DOUBLE AS value FROM n) "
    "SELECT rank, label, value FROM r WHERE rank <= 9 UNION ALL SELECT 10, 'and ' || count(*) || ' more', sum(value) FROM r WHERE rank > 9 HAVING count(*) > 0"
)
def playlist_listing(spark, d):
    n = table(spark, d, "playlist_nodes").select("collection_id", "node_id", "node_name")
    sizes = table(spark, d, "playlist_entries").groupBy("collection_id", "node_id").agg(F.count(F.lit(1)).alias("value")).join(n, ["collection_id", "node_id"])
    return reports.top_with_remainder(sizes.select(F.concat("node_name", F.lit(" #"), F.col("node_id").cast("string")).alias("label"), "value"), "value", "label", 9, F.sum, ("and ", " more"))


@query(
    _match_sql("filename")
    + "SELECT count(*) AS all_rows, count(*) FILTER (s = 'matched') AS matched, count(*) FILTER (s = 'format') AS format_change, count(*) FILTER (s = 'ambiguous') AS ambiguous, count(*) FILTER (s = 'refuted') AS refuted, "
    "count(*) FILTER (s = 'unmatched') AS unmatched, count(*) FILTER (rid % 4 <> 0) AS undecided FROM (SELECT won.rid, CASE WHEN outcome = 'matched' AND lower(regexp_extract(o.file, '\\.([^.]*)$', 1)) <> lower(regexp_extract(n.file, '\\.([^.]*)$', 1)) THEN 'format' ELSE outcome END AS s "
    "FROM won JOIN old o ON o.rid = won.rid LEFT JOIN new n ON n.rid = won.new_rid)"
)
def review_filter_counts(spark, d):
    rows = cascade.review_rows(*_pair(spark, d), "filename")
    return reports.status_counts(rows.withColumn("decision", F.when(F.col("rid") % 4 == 0, "accept")))


@query(
    _GROUPED
    + "SELECT count(*) FILTER (group_id % 3 <> 0) AS outstanding, count(*) FILTER (group_id % 3 = 0) AS decided, count(*) FILTER (group_id % 3 <> 0) = 0 AS all_decided FROM facts WHERE state = 'conflict'"
)
def resolve_gate(spark, d):
    groups = cut(merge.group_facts(*_groups(spark, d)).where("state = 'conflict'").select("group_id"))
    return reports.gate(groups, groups.where("group_id % 3 = 0").withColumn("pick", F.lit(1)))


@query(
    _GROUPED
    + f""", v AS (SELECT group_id, concat_ws(chr(31), {", ".join(model.TRACKED)}) AS vals, min(rid) AS first, bool_or(input_idx = 1) AS own FROM m JOIN facts USING (group_id) WHERE state = 'conflict' GROUP BY 1, 2),
r AS (SELECT group_id, own, CAST(row_number() OVER (PARTITION BY group_id ORDER BY first) AS INTEGER) AS candidate FROM v)
SELECT group_id, min(candidate) AS pick FROM r WHERE own GROUP BY 1"""
)
def bulk_pick(spark, d):
    return reports.bulk_pick(merge.conflict_candidates(*_groups(spark, d)), 1)


@query(
    f"WITH {adapter.NEW} SELECT rid, attr, l AS left_value, r AS right_value, CASE WHEN attr IN ('artist', 'title', 'album') THEN nullif(l, '') WHEN coalesce(try_cast(l AS DOUBLE), 0) <= 0 THEN NULL WHEN attr = 'filesize' THEN printf('%.1f MB', l::DOUBLE / 1024) "
    "WHEN attr = 'bitrate' THEN CAST(round_even(l::DOUBLE / 1000, 0) AS BIGINT) || ' kbps' ELSE printf('%d:%02d', CAST(floor(l::DOUBLE) AS BIGINT) // 60, CAST(floor(l::DOUBLE) AS BIGINT) % 60) END AS shown, l <> r AS differs FROM (SELECT o.rid, "
    "unnest(['artist','title','album','filesize','playtime_float','bitrate']) AS attr, unnest([o.artist, o.title, o.album, o.filesize, o.playtime_float, o.bitrate]) AS l, unnest([n.artist, n.title, n.album, n.filesize, n.playtime_float, n.bitrate]) AS r FROM old o JOIN new n USING (rid))"
)
def answer_fields(spark, d):
    return reports.field_rows(*_pair(spark, d), "rid")


@query(
    _GROUPED + _KEPT.format("")
    + """, c AS (SELECT m.group_id, u.attr, u.other, u.kept FROM m JOIN kept k USING (group_id) JOIN m kk ON kk.rid = k.rid JOIN facts ON facts.group_id = m.group_id AND state = 'settled',
  LATERAL (VALUES ('filesize', m.filesize, kk.filesize), ('playtime_float', m.playtime_float, kk.playtime_float), ('bitrate', m.bitrate, kk.bitrate)) u(attr, other, kept)),
x AS (SELECT *, round(abs(kept::DECIMAL(18,6) - other::DECIMAL(18,6))::DOUBLE / greatest(kept::DECIMAL(18,6), other::DECIMAL(18,6))::DOUBLE, 6) AS gap FROM c),
y AS (SELECT * FROM x WHERE gap > 0.01 QUALIFY row_number() OVER (PARTITION BY group_id, attr ORDER BY gap DESC, other) = 1)
SELECT group_id, printf('%s %s..%s gap %.4f kept %s', attr, CASE WHEN kept::DOUBLE <= other::DOUBLE THEN kept ELSE other END, CASE WHEN kept::DOUBLE <= other::DOUBLE THEN other ELSE kept END, gap, kept) AS line FROM y"""
)
def outlier_lines(spark, d):
    r, g = _groups(spark, d)
    return reports.outlier_lines(merge.outlier_readings(r, g, merge.survivors(r, g)))


@query(
    "SELECT file_id, '/:' || array_to_string([x for x in string_split(replace(replace(scan_root, '/media/', ''), '\\', '/'), '/') if x <> ''], '/:') || '/:' || file_name AS location FROM disk_files"
)
def location_encode(spark, d):
    f = table(spark, d, "disk_files")
    return f.select("file_id", rewrite.encode_location(F.concat("scan_root", "file_name"), "/media/", "").alias("location"))


@query(
    "SELECT scan_root || file_name AS path, CASE WHEN starts_with(scan_root, '/media/lib00/dub/') THEN '/media/lib00/dub' WHEN starts_with(scan_root, '/media/lib00/') THEN '/media/lib00' END AS root FROM disk_files"
)
def scan_roots(spark, d):
    return rewrite.scan_root_of(table(spark, d, "disk_files").select(F.concat("scan_root", "file_name").alias("path")), ["/media/lib00/dub", "/media/lib00"])
