import random
from datetime import datetime, timedelta

from tonearm.llm import identity, survivor


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return sorted(((x, find(x)) for x in parent if any(find(y) == find(x) for y in parent if y != x)), key=repr)


def test_groups_against_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(500, i) for i in range(501, 540)] + [(501, 700)] + [(800 + i, 801 + i) for i in range(25)]
    edges = [e for e in edges if e[0] != e[1]]
    df = spark.createDataFrame(edges + [(3, 3), (None, 4), (5, None)] + edges[:5], "src long, dst long")
    assert rows(identity.consolidate(df)) == brute(edges)


def test_search_cut_short_is_finished_by_propagation(spark):
    edges = [(i, i + 1) for i in range(30)] + [(15, 90), (15, 91), (15, 92), (200, 201)]
    assert rows(identity.consolidate(spark.createDataFrame(edges, "src long, dst long"), rounds=2)) == brute(edges)


def test_entries_nulls_blank_ids_and_unknown_ends(spark):
    entries = spark.createDataFrame([(1, "a", 9), (2, "a", 9), (3, "", 9), (4, "", 9), (5, None, 9), (6, None, 9), (7, "A", 9), (8, "z", 9)], "entry_id long, audio_id string, group_id long")
    pairs = spark.createDataFrame(
        [(2, 5, "matched"), (5, 2, "matched"), (6, 99, "matched"), (98, 99, "matched"), (7, 8, "refuted"), (3, 3, "matched"), (None, 4, "matched"), (4, 3, None), (6, 7, "ambiguous")],
        "left_id long, right_id long, outcome string",
    )
    assert rows(identity.identity_groups(entries, pairs)) == [(1, 1), (2, 1), (5, 1)]
    assert rows(identity.identity_groups(entries.limit(0), pairs.limit(0))) == []


def test_hot_value_is_linked_whole(spark):
    df = spark.range(3000).selectExpr("id as v", "if(id % 3 = 0, 'hot', concat('x', id)) as value")
    edges = identity.shared_value_edges(df, "v", "value", salts=4)
    assert edges.count() == 999 and edges.where("src = 0").count() == 999


T0 = datetime(2024, 5, 1)
TRACKS = "entry_id long, album string, bitrate string, modified_at timestamp, attr string"


def test_survivors(spark):
    tracks = [
        (1, "Real", "0", T0, "x"), (2, "n/a", "320", T0 + timedelta(days=1), "x"), (3, "  ", "192", None, "x"), (4, "Real", "-1", T0, "x"), (5, "Other", "192", T0, "x"),
        (6, None, "abc", T0, "x"), (7, "", "1e3", T0, "x"), (8, "Same", "1", T0, "x"), (9, "Same", "1", T0, "x"),
    ]
    members = [("g", 1), ("g", 2), ("g", 2), ("h", 3), ("h", 4), ("tie", 1), ("tie", 5), ("none", 6), ("none", 7), ("same", 8), ("same", 9), ("one", 1), (None, 1), ("g", None), ("lost", 77)]
    m = spark.createDataFrame(members, "identity_key string, entry_id long")
    t = spark.createDataFrame(tracks, TRACKS)
    assert rows(survivor.contested_survivors(m, t)) == [("g", "album", 1), ("g", "bitrate", 2), ("h", "album", 4), ("h", "bitrate", 3), ("tie", "album", 1), ("tie", "bitrate", 5)]
    whole = {r["identity_key"]: r for r in survivor.surviving_records(m, t).collect()}
    assert whole["same"]["album"] == "Same" and whole["same"]["album_entry_id"] == 8 and whole["none"]["album"] is None and whole["lost"]["bitrate"] is None
    assert rows(survivor.contested_survivors(m.limit(0), t)) == []


def test_usable_values(spark):
    from pyspark.sql import functions as F

    for text, want in [("Live", True), ("???", False), ("<unknown>", False), (" Unknown  Album ", False), (None, False), ("", False), ("1999", True)]:
        assert spark.createDataFrame([(text,)], "v string").select(survivor.usable_album(F.col("v"))).first()[0] is want
    for text, want in [("320", True), ("0", False), ("0.0", False), ("-1", False), ("n/a", False), (None, False), ("nan", False), ("12.5", True)]:
        assert spark.createDataFrame([(text,)], "v string").select(survivor.usable_number(F.col("v"))).first()[0] is want
