"""Merging collections: identity groups, divergence, settled and contested groups, survivors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonearm import model
from tonearm.functions.numbers import beyond, exact, number, relative_gap
from tonearm.operators.cascade import tier_keys
from tonearm.operators.components import components
from tonearm.session import store


def identity_groups(records: DataFrame, level: str = "strict") -> DataFrame:
    """(rid, group_id) of all records; group_id is the least rid linked through any shared tier key.

    A bucket adds one edge per record, to its least record, so large buckets stay linear.
    """
    keys = tier_keys(records, level).select("rank", "key", "rid")
    low = keys.groupBy("rank", "key").agg(F.min("rid").alias("src"), F.count(F.lit(1)).alias("n")).where("n > 1")
    edges = keys.join(low, ["rank", "key"]).where("rid > src").select("src", F.col("rid").alias("dst"))
    found = components(edges)
    return records.select("rid").join(found, F.col("rid") == F.col("id"), "left").select("rid", F.coalesce("group_id", "rid").alias("group_id"))


def _differs(attr: str) -> Column:
    value = F.coalesce(F.col(attr), F.lit(""))
    return F.min(value) != F.max(value)


def group_facts(records: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per group: members, inputs, keys, what diverges by kind, and whether a rule settles it.

    A group is settled when only measured values diverge, all members have one key, a base
    member (input 0) exists and every diverging measured value is a number.
    """
    m = store(records.join(groups, "rid").select("group_id", "input_idx", "primary_key", *model.TRACKED))
    named = lambda attrs: F.filter(F.array(*[F.when(F.col("d_" + a), F.lit(a)) for a in attrs]), lambda x: x.isNotNull())
    facts = m.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("members"),
        F.count_distinct("input_idx").alias("inputs"),
        F.count_if(F.col("input_idx") == 0).alias("base_members"),
        F.count_distinct("primary_key").alias("keys"),
        F.min(F.when(F.col("input_idx") == 0, F.col("primary_key"))).alias("base_key"),
        *[_differs(a).alias("d_" + a) for a in model.TRACKED],
        *[(F.count(number(F.col(a))) == F.count(F.lit(1))).alias("n_" + a) for a in model.MEASURED],
    )
    # Keys are gathered only where they name the group: a group with one base member, however large, is named by its key.
    nameless = facts.where("base_members <> 1").select("group_id")
    keys = m.join(nameless, "group_id", "left_semi").groupBy("group_id").agg(F.array_join(F.sort_array(F.collect_list("primary_key")), "|").alias("all_keys"))
    facts = facts.join(keys, "group_id", "left")
    readable = F.lit(True)
    for a in model.MEASURED:
        readable = readable & (~F.col("d_" + a) | F.col("n_" + a))
    facts = facts.withColumn("editorial", named(model.EDITORIAL)).withColumn("measured", named(model.MEASURED))
    facts = facts.withColumn("attrs", F.array_join(named(model.TRACKED), ","))
    settled = (F.size("measured") > 0) & (F.size("editorial") == 0) & (F.col("keys") == 1) & (F.col("base_members") > 0) & readable
    state = F.when(F.col("inputs") < 2, "single").when(F.col("attrs") == "", "agree").when(settled, "settled").otherwise("conflict")
    key = F.when(F.col("base_members") == 1, F.col("base_key")).otherwise(F.col("all_keys"))
    return facts.select(
        "group_id", key.alias("identity_key"), "members", "inputs", "base_members", "keys", "attrs",
        F.array_join("editorial", ",").alias("editorial"), F.array_join("measured", ",").alias("measured"), state.alias("state"),
    )


def survivors(records: DataFrame, groups: DataFrame, keep: str = "first") -> DataFrame:
    """(group_id, rid, primary_key) of the record each group keeps.

    The first base member; without one the first member of the least (keep first) or
    greatest (keep last) input. Document order settles ties either way.
    """
    m = records.join(groups, "rid")
    from_end = F.col("input_idx") if keep == "first" else -F.col("input_idx")
    order = [F.when(F.col("input_idx") == 0, 0).otherwise(1), from_end, F.col("rid")]
    w = Window.partitionBy("group_id").orderBy(*order)
    return m.withColumn("r", F.row_number().over(w)).where("r = 1").select("group_id", "rid", "primary_key")


def redirects(records: DataFrame, groups: DataFrame, kept: DataFrame) -> DataFrame:
    """(old_key, new_key) of members of groups with several inputs that are not the survivor, where the key changes."""
    m = store(records.join(groups, "rid").select("group_id", "rid", "input_idx", F.col("primary_key").alias("old_key")))
    many = m.groupBy("group_id").agg((F.min("input_idx") < F.max("input_idx")).alias("several")).where("several").select("group_id")
    m = m.join(many, "group_id", "left_semi")
    k = kept.select("group_id", F.col("rid").alias("kept_rid"), F.col("primary_key").alias("new_key"))
    return m.join(k, "group_id").where("rid <> kept_rid and old_key <> new_key").select("old_key", "new_key").distinct()


def outlier_readings(records: DataFrame, groups: DataFrame, kept: DataFrame) -> DataFrame:
    """(group_id, attr, kept, other, gap) where a settled group's furthest value is more than the band away from the kept one."""
    settled = group_facts(records, groups).where("state = 'settled'").select("group_id")
    cells = lambda df, name: df.select("group_id", F.inline(F.array(*[F.struct(F.lit(a).alias("attr"), F.col(a).alias(name)) for a in model.MEASURED])))
    m = cells(records.join(groups, "rid").join(settled, "group_id", "left_semi"), "other")
    k = cells(records.join(kept.select("group_id", "rid"), "rid"), "kept")
    gap = relative_gap(exact(F.col("kept")), exact(F.col("other")))
    read = m.join(k, ["group_id", "attr"]).withColumn("gap", gap).where(beyond(exact(F.col("kept")), exact(F.col("other")), model.OUTLIER_SHARE))
    w = Window.partitionBy("group_id", "attr").orderBy(F.desc("gap"), "other")
    return read.withColumn("r", F.row_number().over(w)).where("r = 1").select("group_id", "attr", "kept", "other", F.round(F.col("gap").cast("double"), 6).alias("gap"))


def conflict_candidates(records: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_id, candidate, values, contributors): distinct value tuples of contested groups in first-seen order."""
    contested = group_facts(records, groups).where("state = 'conflict'").select("group_id")
    m = records.join(groups, "rid").join(contested, "group_id", "left_semi")
    values = F.concat_ws("\x1f", *[F.coalesce(F.col(a), F.lit("")) for a in model.TRACKED])
    one = m.groupBy("group_id", values.alias("values")).agg(
        F.min("rid").alias("first"), F.array_join(F.sort_array(F.collect_list(F.concat(F.col("input_idx").cast("string"), F.lit(":"), F.col("primary_key")))), "|").alias("contributors")
    )
    w = Window.partitionBy("group_id").orderBy("first")
    return one.select("group_id", F.row_number().over(w).alias("candidate"), "values", "contributors")


def merged(records: DataFrame, groups: DataFrame, kept: DataFrame) -> DataFrame:
    """Records of the merged collection: every base record, then the survivor of each group without a base member."""
    base = records.where("input_idx = 0").select("rid", "primary_key")
    without = records.join(groups, "rid").groupBy("group_id").agg(F.min("input_idx").alias("low")).where("low > 0").select("group_id")
    return base.unionByName(kept.join(without, "group_id").select("rid", "primary_key"))


def validate(out: DataFrame, listed: DataFrame) -> DataFrame:
    """(problem, key): keys that the merged collection holds twice, and listed keys it does not hold."""
    twice = out.groupBy("primary_key").count().where("count > 1").select(F.lit("duplicate_key").alias("problem"), F.col("primary_key").alias("key"))
    lost = listed.select("key").distinct().join(out.select(F.col("primary_key").alias("key")), "key", "left_anti")
    return twice.unionByName(lost.select(F.lit("unresolvable_key").alias("problem"), "key"))
