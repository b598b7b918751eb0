"""What a person sees of a run: listings with a remainder, decisions and gates, field rows, refusals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonearm import model
from tonearm.functions import numbers


def top_with_remainder(rows: DataFrame, value: str, label: str, n: int, rest_of: Callable[..., Column] = F.max, rest_label: tuple[str, str] = ("others: ", "")) -> DataFrame:
    """(rank, label, value): the n greatest, then one row with the number and the greatest of the rest, or what ``rest_of`` makes of it.

    Labels are distinct; ties go by label. The remainder is aggregated, not gathered.
    """
    best = rows.select(label, value).orderBy(F.desc(value), label).limit(n)
    # The window sees the n rows that are left.
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(value), label)).cast("long"))
    first = ranked.select("rank", F.col(label).alias("label"), F.col(value).cast("double").alias("value"))
    rest = rows.join(best.select(label), label, "left_anti").agg(F.count(F.lit(1)).alias("c"), rest_of(value).alias("m")).where("c > 0")
    return first.unionByName(rest.select(F.lit(n + 1).cast("long").alias("rank"), F.concat(F.lit(rest_label[0]), F.col("c").cast("string"), F.lit(rest_label[1])).alias("label"), F.col("m").cast("double").alias("value")))


def status_counts(reviews: DataFrame) -> DataFrame:
    """One row with the number of review rows under each filter; (status, decision)."""
    s, d = F.col("status"), F.col("decision")
    return reviews.agg(
        F.count(F.lit(1)).alias("all_rows"), F.count_if(s == "matched").alias("matched"), F.count_if(s == "format").alias("format_change"), F.count_if(s == "ambiguous").alias("ambiguous"),
        F.count_if(s == "refuted").alias("refuted"), F.count_if(s == "unmatched").alias("unmatched"), F.count_if(d.isNull()).alias("undecided"),
    )


def gate(groups: DataFrame, decisions: DataFrame) -> DataFrame:
    """(outstanding, decided, all_decided) of contested groups (group_id) and decisions (group_id, pick)."""
    said = decisions.where("pick is not null").select("group_id").distinct().withColumn("said", F.lit(True))
    return groups.select("group_id").distinct().join(said, "group_id", "left").agg(
        F.count_if(F.col("said").isNull()).alias("outstanding"), F.count_if(F.col("said")).alias("decided"), (F.count_if(F.col("said").isNull()) == 0).alias("all_decided")
    )


def signature(members: Column, values: Column) -> Column:
    """Fingerprint of a contested group: its members and the values they offer."""
    return F.sha2(F.concat_ws("\x1e", F.array_join(F.sort_array(members), "\x1f"), F.array_join(F.sort_array(values), "\x1f")), 256)


def reattach(groups: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions (group_id, signature, pick) that still stand: the group has the same members and candidates as when it was decided."""
    return decisions.join(groups.select("group_id", "signature").distinct(), ["group_id", "signature"], "left_semi")


def bulk_pick(candidates: DataFrame, input_idx: int) -> DataFrame:
    """(group_id, pick): for each group the first candidate that the input contributes to.

    ``candidates`` has (group_id, candidate, contributors) with contributors `input:key|...`.
    """
    own = F.exists(F.split("contributors", r"\|"), lambda c: c.startswith(f"{input_idx}:"))
    return candidates.where(own).groupBy("group_id").agg(F.min("candidate").alias("pick"))


def field_rows(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """(on, attr, left_value, right_value, shown, differs): tracked attributes of two records side by side."""
    shows = {"filesize": numbers.show_size, "playtime_float": numbers.show_time, "bitrate": numbers.show_bitrate}
    value = lambda side, a: F.coalesce(F.col(f"{side}.{a}"), F.lit(""))
    rows = F.array(
        *[
            F.struct(
                F.lit(a).alias("attr"), value("l", a).alias("left_value"), value("r", a).alias("right_value"),
                (shows[a](value("l", a)) if a in shows else F.nullif(value("l", a), F.lit(""))).alias("shown"), (value("l", a) != value("r", a)).alias("differs"),
            )
            for a in model.TRACKED
        ]
    )
    return left.alias("l").join(right.alias("r"), on).select(on, F.inline(rows))


def target_folder(nodes: DataFrame, name: str, folder: str | None) -> str:
    """Where a new playlist may go: `ok`, or why not (`no_such_folder`, `folder_is_ambiguous`, `not_a_folder`, `no_root`, `name_taken`).

    At most a handful of rows, those that carry one of the two names, are looked at.
    """
    kept = nodes.select("node_id", "parent_id", "node_type", "node_name")
    if folder is None:
        home = kept.where("parent_id is null").limit(2).collect()
        if not home:
            return "no_root"
    else:
        home = kept.where((F.col("node_name") == folder) & F.col("parent_id").isNotNull()).limit(3).collect()
        if not home:
            return "no_such_folder"
        folders = [h for h in home if h["node_type"] == "FOLDER"]
        if not folders:
            return "not_a_folder"
        if len(folders) > 1:
            return "folder_is_ambiguous"
        home = folders
    taken = kept.where((F.col("parent_id") == home[0]["node_id"]) & (F.col("node_name") == name)).limit(1).collect()
    return "name_taken" if taken else "ok"


def dangling(entries: DataFrame, valid: DataFrame, policy: str) -> DataFrame:
    """Entries to emit under a policy: `exclude` leaves out what does not resolve, `fail` gives the rows that stop the run.

    `pull_in` adds keys from the collection; those that a playlist names and the collection
    has are there already, so it equals `exclude`.
    """
    keys = valid.select("key").distinct()
    if policy in ("exclude", "pull_in"):
        return entries.join(keys, "key", "left_semi")
    if policy == "fail":
        return entries.join(keys, "key", "left_anti")
    raise ValueError("policy must be exclude, pull_in or fail")


def outlier_lines(readings: DataFrame) -> DataFrame:
    """(group_id, line): one line per outlier reading, low and high value in order and the gap with four decimals."""
    a, b = numbers.number(F.col("kept")), numbers.number(F.col("other"))
    low, high = F.when(a <= b, F.col("kept")).otherwise(F.col("other")), F.when(a <= b, F.col("other")).otherwise(F.col("kept"))
    return readings.select("group_id", F.format_string("%s %s..%s gap %.4f kept %s", "attr", low, high, "gap", "kept").alias("line"))


def track_name(artist: Column, title: Column, identity_key: Column) -> Column:
    """`title - artist`, the one of them that is there, or the identity key."""
    a, t = F.trim(F.coalesce(artist, F.lit(""))), F.trim(F.coalesce(title, F.lit("")))
    return F.when((a != "") & (t != ""), F.concat(t, F.lit(" - "), a)).when(t != "", t).when(a != "", a).otherwise(identity_key)


def run_report(stats: DataFrame, decided: DataFrame) -> DataFrame:
    """(ord, item, value) of a rebuilt merge: playlists filled, entries added, decisions and playlists left empty, then
    entries on duplicated tracks and dropped references where there are any.

    ``stats`` has (counter, value), ``decided`` is a gate row (outstanding, decided). A counter that is missing counts as 0.
    """
    always = ["refilled_playlists", "playlist_entries_added", "decided", "unfilled_playlists"]
    rest = ["entries_on_duplicated_tracks", "dropped_references"]
    told = stats.select("counter", F.col("value").cast("long").alias("value")).unionByName(decided.select(F.lit("decided").alias("counter"), F.col("decided").cast("long").alias("value")))
    one = told.agg(*[F.coalesce(F.sum(F.when(F.col("counter") == c, F.col("value"))), F.lit(0)).alias(c) for c in (*always, *rest)])
    rows = one.select(F.inline(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(c).alias("item"), F.col(c).alias("value")) for i, c in enumerate((*always, *rest), 1)])))
    return rows.where(F.col("item").isin(always) | (F.col("value") > 0))


def isolated(nodes: DataFrame, entries: DataFrame, valid: DataFrame, name: str) -> DataFrame:
    """Entries of the playlist ``name`` alone, for an output of its own; any reference to no entry stops it."""
    node = nodes.where((F.col("node_type") == "PLAYLIST") & (F.col("node_name") == name)).agg(F.max("node_id").alias("node_id"))
    own = entries.join(node, "node_id", "left_semi")
    lost = dangling(own, valid, "fail").limit(1).collect()
    if lost:
        raise ValueError(f"playlist {name!r} refers to {lost[0]['key']!r}, which is no entry")
    return own
