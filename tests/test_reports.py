import pytest
from conftest import rows
from pyspark.sql import functions as F

from tonearm.operators import playlists, reports


def test_top_with_remainder(spark):
    df = spark.createDataFrame([("a", 5), ("b", 9), ("c", 5), ("d", 1)], "label string, value int")
    assert [tuple(r) for r in reports.top_with_remainder(df, "value", "label", 2).orderBy("rank").collect()] == [(1, "b", 9.0), (2, "a", 5.0), (3, "others: 2", 5.0)]
    assert reports.top_with_remainder(df, "value", "label", 9).count() == 4 and reports.top_with_remainder(df.limit(0), "value", "label", 2).count() == 0


def test_positions_are_global(spark):
    df = spark.range(5000).selectExpr("(id * 7919) % 5003 as k", "id")
    got = playlists.positions(df, [F.col("k"), F.col("id")]).orderBy("pos").collect()
    assert [r["pos"] for r in got] == list(range(1, 5001)) and [r["k"] for r in got] == sorted(r["k"] for r in got)
    assert playlists.positions(df.limit(0), [F.col("k")]).count() == 0


def test_decisions_stand_only_for_the_same_group(spark):
    g = spark.createDataFrame([(1, ["a", "b"], ["x", "y"]), (2, ["c"], ["z"])], "group_id long, m array<string>, v array<string>").withColumn("signature", reports.signature(F.col("m"), F.col("v")))
    same = spark.createDataFrame([(1, ["b", "a"], ["y", "x"], 1), (2, ["c", "d"], ["z"], 1)], "group_id long, m array<string>, v array<string>, pick int").withColumn("signature", reports.signature(F.col("m"), F.col("v")))
    assert [r["group_id"] for r in reports.reattach(g, same).collect()] == [1]


def test_target_folder(spark):
    n = spark.createDataFrame([(1, None, "FOLDER", "$ROOT"), (2, 1, "FOLDER", "F"), (3, 2, "PLAYLIST", "P"), (4, 1, "FOLDER", "G"), (5, 2, "FOLDER", "G"), (6, 1, "PLAYLIST", "L")], "node_id long, parent_id long, node_type string, node_name string")
    asked = [("P", "F"), ("Q", "F"), ("Q", "G"), ("Q", "X"), ("Q", "L"), ("L", None), ("Q", None)]
    assert [reports.target_folder(n, *a) for a in asked] == ["name_taken", "ok", "folder_is_ambiguous", "no_such_folder", "not_a_folder", "name_taken", "ok"]
    assert reports.target_folder(n.limit(0), "Q", None) == "no_root"


def test_dangling_policies(spark):
    e = spark.createDataFrame([(1, "a"), (1, "gone"), (1, None)], "node_id long, key string")
    v = spark.createDataFrame([("a",), ("a",)], "key string")
    assert rows(reports.dangling(e, v, "exclude")) == rows(reports.dangling(e, v, "pull_in")) == [("a", 1)]
    assert reports.dangling(e, v, "fail").count() == 2
    with pytest.raises(ValueError):
        reports.dangling(e, v, "other")


def test_stored_tables_can_be_cleared(spark):
    import os

    from tonearm import session

    kept = session.store(spark.range(5).toDF("x"))
    path = session._STORED[-1]
    assert rows(kept) == [(i,) for i in range(5)]
    had = len(session._STORED)
    assert session.clear(spark) <= had and not session._STORED and not os.path.exists(path.removeprefix("file:"))


def test_names_of_tracks(spark):
    df = spark.createDataFrame([("A", " T ", "k"), (None, "T", "k"), ("A", "", "k"), (" ", None, "k")], "a string, t string, k string")
    assert [r[0] for r in df.select(reports.track_name(F.col("a"), F.col("t"), F.col("k"))).collect()] == ["T - A", "T", "A", "k"]


def test_run_report(spark):
    stats = spark.createDataFrame([("refilled_playlists", 2), ("playlist_entries_added", 9), ("unfilled_playlists", 0), ("entries_on_duplicated_tracks", 1), ("other", 5)], "counter string, value long")
    gate = spark.createDataFrame([(0, 3)], "outstanding long, decided long")
    assert [(r["item"], r["value"]) for r in reports.run_report(stats, gate).orderBy("ord").collect()] == [("refilled_playlists", 2), ("playlist_entries_added", 9), ("decided", 3), ("unfilled_playlists", 0), ("entries_on_duplicated_tracks", 1)]
    assert reports.run_report(stats.limit(0), gate).count() == 4


def test_isolated_playlist_and_split_names(spark):
    n = spark.createDataFrame([(1, "PLAYLIST", "P"), (2, "PLAYLIST", "P"), (3, "FOLDER", "F"), (4, "PLAYLIST", "E")], "node_id long, node_type string, node_name string")
    e = spark.createDataFrame([(1, "x"), (2, "a"), (2, "b")], "node_id long, key string")
    valid = spark.createDataFrame([("a",), ("b",)], "key string")
    assert rows(reports.isolated(n, e, valid, "P").select("key")) == [("a",), ("b",)]
    with pytest.raises(ValueError):
        reports.isolated(n, e, valid.limit(0), "P")
    assert playlists.split_names(n, ["P", "F", "Z", "Z"]) == ["F", "Z"] and playlists.split_names(n, []) == []
    assert rows(playlists.empty_lists(playlists.split(n, e, valid, ["P", "E"]))) == [("E",)]
