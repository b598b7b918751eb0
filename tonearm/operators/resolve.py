"""Settling contested groups of a merge: picks, policies, patches, and when a run is refused."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm import model
from tonearm.operators.merge import group_facts
from tonearm.session import store

POLICIES = ["keep-first", "keep-last"]


def members_of(records: DataFrame, groups: DataFrame) -> DataFrame:
    """Members (group_id, rid, input_idx, primary_key and tracked attributes; null as empty), written once for the steps below."""
    text = [F.coalesce(F.col(a), F.lit("")).alias(a) for a in model.TRACKED]
    return store(records.join(groups, "rid").select("group_id", "rid", "input_idx", "primary_key", *text))


def resolve(members: DataFrame, resolutions: DataFrame | None = None, on_conflict: str | None = None) -> DataFrame:
    """One row per group that asks for a decision or adds an entry:
    (group_id, identity_key, inputs, state, attrs, resolution, winner_rid, winner_input, winner_key, patch_rid, adds).

    ``resolutions`` (identity_key, input_idx, primary_key) names one member of a contested group; a pair that names
    nobody, or a group that a rule settles, is inert. Contested groups it does not name follow ``on_conflict``, and
    without a policy stay `unresolved` and have no winner. A base member keeps its place, and the picked member gives
    its values (patch_rid); else the picked one, or the one of the first or last input, is added.
    """
    if on_conflict not in (None, *POLICIES):
        raise ValueError(f"on_conflict must be one of {POLICIES}")
    facts = store(group_facts(members.drop("group_id"), members.select("rid", "group_id")))
    one = F.struct("rid", "input_idx", "primary_key")
    at = lambda order, where: F.min_by(F.when(where, one), F.when(where, order))
    other = F.col("input_idx") != 0
    last = -F.col("input_idx") if on_conflict == "keep-last" else F.col("input_idx")
    ends = members.groupBy("group_id").agg(
        at(F.struct(F.col("rid")), ~other).alias("base"), at(F.struct(last, F.col("rid")), other).alias("other"), at(F.struct("input_idx", "rid"), F.lit(True)).alias("head")
    )
    rows = facts.join(ends, "group_id")
    if resolutions is None:
        rows = rows.withColumn("picked", F.lit(None).cast("struct<rid:bigint,input_idx:int,primary_key:string>"))
    else:
        named = facts.where("state = 'conflict'").select("group_id", "identity_key").join(resolutions.select("identity_key", "input_idx", "primary_key").distinct(), "identity_key")
        picked = members.join(named.drop("identity_key"), ["group_id", "input_idx", "primary_key"], "left_semi")
        rows = rows.join(picked.groupBy("group_id").agg(F.min_by(one, F.struct("input_idx", "rid")).alias("picked")), "group_id", "left")
    single, contested = F.col("state") == "single", F.col("state") == "conflict"
    label = F.concat_ws(":", F.col("picked.input_idx").cast("string"), "picked.primary_key")
    resolution = F.when(contested, F.when(F.col("picked").isNotNull(), label).otherwise(F.lit(on_conflict or "unresolved")))
    lost = contested & F.col("picked").isNull() & F.lit(on_conflict is None)
    winner = F.when(lost, None).when(single, F.col("head")).when(F.col("base").isNotNull(), F.col("base")).otherwise(F.coalesce("picked", "other"))
    rows = rows.withColumn("resolution", resolution).withColumn("winner", winner)
    patch = F.when(~single & F.col("base").isNotNull() & (F.col("picked.rid") != F.col("base.rid")), F.col("picked.rid"))
    adds = F.col("winner").isNotNull() & (F.col("winner.input_idx") != 0)
    return rows.select(
        "group_id", "identity_key", "inputs", "state", "attrs", "resolution", F.col("winner.rid").alias("winner_rid"), F.col("winner.input_idx").alias("winner_input"),
        F.col("winner.primary_key").alias("winner_key"), patch.alias("patch_rid"), F.coalesce(adds, F.lit(False)).alias("adds"), F.col("base_members"),
    )


def redirects(members: DataFrame, resolved: DataFrame) -> DataFrame:
    """(old_key, new_key) of the members of decided groups that are not the winner, where the key changes."""
    won = resolved.where("inputs > 1 and winner_rid is not null").select("group_id", "winner_rid", F.col("winner_key").alias("new_key"))
    return members.join(won, "group_id").where("rid <> winner_rid and primary_key <> new_key").select(F.col("primary_key").alias("old_key"), "new_key").distinct()


def entry_patches(members: DataFrame, resolved: DataFrame) -> DataFrame:
    """(rid, primary_key, attr, value): diverging values that the picked member gives to the base entry."""
    asked = resolved.where("patch_rid is not null").select("winner_rid", "winner_key", F.col("patch_rid").alias("rid"), F.explode(F.split("attrs", ",")).alias("attr"), "group_id")
    cells = members.select("group_id", "rid", F.inline(F.array(*[F.struct(F.lit(a).alias("attr"), F.col(a).alias("value")) for a in model.TRACKED])))
    return asked.join(cells, ["group_id", "rid", "attr"]).select(F.col("winner_rid").alias("rid"), F.col("winner_key").alias("primary_key"), "attr", "value")


def ambiguous_keys(members: DataFrame, resolved: DataFrame) -> DataFrame:
    """(key): keys of other inputs whose group holds several base entries, so no single one is their target."""
    crowded = resolved.where("inputs > 1 and winner_rid is not null and base_members > 1").select("group_id")
    return members.where("input_idx <> 0").join(crowded, "group_id", "left_semi").select(F.col("primary_key").alias("key")).distinct()


def agreed(members: DataFrame, resolved: DataFrame) -> DataFrame:
    """(group_id, attr, value): what all members of a contested group say alike."""
    contested = resolved.where("state = 'conflict'").select("group_id", F.split("attrs", ",").alias("attrs"))
    cells = F.inline(F.array(*[F.struct(F.lit(a).alias("attr"), F.min(a).alias("value")) for a in model.TRACKED]))
    return members.join(contested.select("group_id"), "group_id", "left_semi").groupBy("group_id").agg(*[F.min(a).alias(a) for a in model.TRACKED]).select(
        "group_id", F.inline(F.array(*[F.struct(F.lit(a).alias("attr"), F.col(a).alias("value")) for a in model.TRACKED]))
    ).join(contested, "group_id").where(~F.array_contains("attrs", F.col("attr"))).select("group_id", "attr", "value")


def refusals(resolved: DataFrame) -> DataFrame:
    """(reason, groups): why nothing may be written; no row when it may. Every unresolved group stops the whole run."""
    return resolved.agg(F.count_if(F.col("resolution") == "unresolved").alias("groups")).where("groups > 0").select(F.lit("conflicts_outstanding").alias("reason"), "groups")


def run_state(resolved: DataFrame | None, used: DataFrame | None, decisions: DataFrame, errors: tuple[str, ...] = (), inputs: tuple[str, ...] = ()) -> str:
    """`same_file`, `no_preview`, `conflicts_outstanding`, `run_refused`, `stale` or `ready`.

    ``used`` are the resolutions that the held run had, ``decisions`` those given now; a decision changed and changed
    back leaves the run as it is.
    """
    if len(set(inputs)) < len(inputs):
        return "same_file"
    if resolved is None:
        return "no_preview"
    if not refusals(resolved).isEmpty():
        return "conflicts_outstanding"
    if errors:
        return "run_refused"
    cols = ["identity_key", "input_idx", "primary_key"]
    a, b = (decisions.select(cols).distinct(), (used if used is not None else decisions.limit(0)).select(cols).distinct())
    return "ready" if a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() else "stale"


def conflict_groups(rows: DataFrame) -> DataFrame:
    """Rows (ord, identity_key, attrs, resolution) of a report that are about metadata, the first of each key."""
    about = F.size(F.array_except(F.split("attrs", ","), F.array(*[F.lit(a) for a in model.TRACKED]))) == 0
    return rows.where(about).groupBy("identity_key").agg(F.min(F.struct("ord", "attrs", "resolution")).alias("r")).select("identity_key", "r.ord", "r.attrs", "r.resolution")
