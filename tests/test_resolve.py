import random

import pytest
from conftest import rows

from tonearm import model
from tonearm.operators import cascade, playlists, rebuild, reconnect, resolve
from tonearm.operators.rewrite import Rule

COLS = "rid long, group_id string, input_idx int, primary_key string, artist string, title string, album string, filesize string, playtime_float string, bitrate string"


def _members(spark, *data):
    r = spark.createDataFrame([(i, g, idx, key, artist, "T", album, size, "1.0", "320") for i, g, idx, key, artist, album, size in data], COLS)
    return resolve.members_of(r.drop("group_id"), r.select("rid", "group_id"))


DATA = [
    (1, "a", 0, "k1", "A", "x", "10"), (2, "a", 1, "k1", "A", "y", "10"), (3, "a", 2, "k9", "A", "z", "12"),
    (4, "b", 1, "k2", "B", "x", "1"), (5, "b", 2, "k3", "B", "y", "1"),
    (6, "c", 0, "k4", "C", "x", "10"), (7, "c", 1, "k4", "C", "x", "11"),
    (8, "d", 2, "k5", "D", None, "1"), (9, "e", 0, "k6", "E", "x", "1"), (10, "e", 0, "k7", "E", "x", "1"), (11, "e", 1, "k8", "E", "w", "1"), (12, "f", 0, "k10", "F", "", "1"),
]


def test_policy_and_picks(spark):
    m = _members(spark, *DATA)
    picks = spark.createDataFrame([("k1", 2, "k9"), ("k2|k3", 5, "none"), ("nobody", 1, "k1")], "identity_key string, input_idx int, primary_key string")
    got = {r["group_id"]: (r["state"], r["resolution"], r["winner_rid"], r["patch_rid"], r["adds"]) for r in resolve.resolve(m, picks, "keep-last").collect()}
    assert got == {
        "a": ("conflict", "2:k9", 1, 3, False), "b": ("conflict", "keep-last", 5, None, True), "c": ("settled", None, 6, None, False), "d": ("single", None, 8, None, True), "e": ("conflict", "keep-last", 9, None, False),
        "f": ("single", None, 12, None, False),
    }
    done = resolve.resolve(m, picks, "keep-first")
    assert rows(resolve.entry_patches(m, done)) == [(1, "k1", "album", "z"), (1, "k1", "filesize", "12")]
    assert rows(resolve.ambiguous_keys(m, done)) == [("k8",)]
    assert rows(resolve.redirects(m, done)) == [("k3", "k2"), ("k7", "k6"), ("k8", "k6"), ("k9", "k1")]
    assert ("a", "artist", "A") in rows(resolve.agreed(m, done)) and not any(r[0] == "c" for r in rows(resolve.agreed(m, done)))
    with pytest.raises(ValueError):
        resolve.resolve(m, None, "newest")


def test_unresolved_groups_stop_the_run(spark):
    m = _members(spark, *DATA)
    none = spark.createDataFrame([], "identity_key string, input_idx int, primary_key string")
    open_run = resolve.resolve(m)
    assert rows(resolve.refusals(open_run)) == [("conflicts_outstanding", 3)] and resolve.refusals(resolve.resolve(m.limit(0))).count() == 0
    done, said = resolve.resolve(m, none, "keep-first"), spark.createDataFrame([("k1", 2, "k9")], none.schema)
    state = lambda *a, **k: resolve.run_state(*a, **k)
    assert [state(None, None, none), state(open_run, none, none), state(done, none, said), state(done, said, said), state(done, none, none, errors=("x",)), state(done, none, none, inputs=("a", "a"))] == [
        "no_preview", "conflicts_outstanding", "stale", "ready", "run_refused", "same_file"
    ]
    report = spark.createDataFrame([(2, "k", "album", "x"), (1, "k", "title,album", "y"), (3, "p", "playlist_name", "ambiguous")], "ord int, identity_key string, attrs string, resolution string")
    assert rows(resolve.conflict_groups(report)) == [("k", 1, "title,album", "y")]


REC = "rid long, primary_key string, audio_id string, artist string, title string, album string, filesize string, playtime_float string, file string, dir string, volume string, volumeid string"


def _rec(spark, *data):
    return spark.createDataFrame([(i, f"C:{d}{f}", a, "A", t, "", "", "", f, d, "C:", "id") for i, a, t, f, d in data], REC)


def test_ambiguous_provider_stops_the_record(spark):
    old, new = _rec(spark, (1, "x", "T", "a.mp3", "/:o/:"), (2, "y", "U", "b.mp3", "/:o/:")), _rec(spark, (11, "x", "T", "a.mp3", "/:n/:"), (12, "y", "U", "b.mp3", "/:n/:"))
    providers = spark.createDataFrame([(1, "old", "print", None, True)], "rid long, side string, tier string, key string, ambiguous boolean")
    got = {r["rid"]: (r["outcome"], r["tier"], r["new_rid"]) for r in cascade.match(old, new, "strict", providers=providers).collect()}
    assert got == {1: ("ambiguous", None, None), 2: ("matched", "audio_id", 12)}
    assert {r["rid"]: r["reason"] for r in reconnect.resolve(old, new, providers=providers).collect()} == {1: "ambiguous", 2: None}


def test_reconnect_withdraws_collisions(spark):
    old = _rec(spark, (1, "x", "T", "a.mp3", "/:o/:"), (2, "x", "T", "a.mp3", "/:p/:"), (3, "z", "V", "c.mp3", "/:o/:"), (4, "", "", "", "/:o/:"))
    new = _rec(spark, (11, "x", "T", "a.mp3", "/:n/:"), (13, "z", "V", "c.mp3", "/:n/:"))
    got = reconnect.resolve(old, new)
    assert {r["rid"]: (r["outcome"], r["tier"], r["new_key"], r["reason"]) for r in got.collect()} == {
        1: ("destination_collision", None, None, "destination_collision"), 2: ("destination_collision", None, None, "destination_collision"), 3: ("matched", "audio_id", "C:/:n/:c.mp3", None), 4: ("unmatched", None, None, "unmatched"),
    }
    counts = {r["counter"]: r["value"] for r in reconnect.stats(got).collect()}
    assert (counts["matched"], counts["matched_audio_id"], counts["destination_collisions"], counts["unmatched"]) == (1, 1, 2, 1)
    out, err = reconnect.render(got, "r.csv", ("d",), ("w",), refute=False)
    assert out[0] == "reconnectable=1" and out[-1] == "csv_written=r.csv" and err == ["d", "w", "refutation_disabled"]


def test_volumes_and_paths(spark):
    r = _rec(spark, (1, "", "T", "a.mp3", "/:m/:x/:"), (2, "", "T", "b.mp3", "/:m/:"), (3, "", "T", "c.mp3", "/:q/:"))
    assert reconnect.volume_of(r, ["m"]) == ("C:", "id") and reconnect.volume_of(r, ["none"], ("D:", "d")) == ("D:", "d")
    for root in (["none"], []):
        with pytest.raises(reconnect.VolumeIdentityError):
            reconnect.volume_of(r, root)
    with pytest.raises(reconnect.VolumeIdentityError):
        reconnect.volume_of(r.unionByName(r.selectExpr(*[c if c != "volume" else "'D:' as volume" for c in r.columns])), ["m"])
    anchors = spark.createDataFrame([("C:", "id", "/mnt/a"), ("C:", "id", "/mnt/b/"), ("X:", "id", "/mnt/x")], "volume string, volumeid string, anchor string")
    files = spark.createDataFrame([("/mnt/a/m/x/a.mp3",), ("/mnt/a/m/b.mp3",), ("/mnt/b/m/b.mp3",)], "path string")
    assert {x["rid"]: x["path"] for x in reconnect.local_paths(r, anchors, files).collect()} == {1: "/mnt/a/m/x/a.mp3", 2: None, 3: None}
    assert reconnect.output_name("/a/c.nml") == "c-reconnected.nml" and reconnect.output_name(None) == "collection-reconnected.nml"
    assert reconnect.volume_triples(["a", "b"], [("C:", " "), ("D:", "d")]) == [("b", "D:", "d")] and reconnect.volume_triples([], []) is None
    assert reconnect.volume_guess("C:\\m") == ("C:", "C:") and reconnect.volume_guess("/m") == ("/", "/")


def test_locations_outside_the_collection(spark):
    out = spark.createDataFrame([(1, "C:", None, "/:m/:", "a.mp3"), (2, "C:", None, "/:m/:", "b.mp3"), (3, "Q:", None, "/:z/:", "c.mp3"), (4, None, None, None, None)], "ord long, volume string, volumeid string, dir string, file string")
    moved = spark.createDataFrame([("C:/:m/:a.mp3", "E:", "e", "/:n/:", "a2.mp3")], "old_key string, volume string, volumeid string, dir string, file string")
    got = {r["ord"]: (r["new_volume"], r["new_dir"], r["new_file"], r["how"]) for r in reconnect.rewrite_outside(out, moved, [Rule("C:", "/:m", "F:", "/:k")]).collect()}
    assert got == {1: ("E:", "/:n/:", "a2.mp3", "collection"), 2: ("F:", "/:k/:", "b.mp3", "rule"), 3: ("Q:", "/:z/:", "c.mp3", "unchanged"), 4: (None, None, None, "unchanged")}
    r = _rec(spark, (1, "", "T", "a.mp3", "/:m/:"), (2, "", "T", "b.mp3", "/:o/:"))
    entries = spark.createDataFrame([(1, 1, "C:/:m/:a.mp3"), (1, 2, "C:/:o/:b.mp3"), (1, 3, "C:/:m/:gone.mp3")], "node_id long, pos int, key string")
    lists = reconnect.preview(r, out, entries, [Rule("C:", "/:m", "F:", "/:k")])
    assert {k: v.count() for k, v in lists.items()} == {"collection_location_changes": 1, "other_location_changes": 2, "primarykey_changes": 2}


def _rebuild_by_hand(base, be, inc, ie, mapping, valid):
    """The definition, one playlist after the other."""
    out = {}
    for node, path, name in base:
        mine = sorted([(s, n) for s, n, p, _ in inc if p == path])
        if not mine:
            named = [(s, n) for s, n, _, m in inc if m == name]
            if sum(b[2] == name for b in base) != 1 or len(named) != 1:
                continue
            mine = named
        own = [mapping.get(k, k) for n, _, k in sorted(be) if n == node]
        union = list(dict.fromkeys(mapping.get(k, k) for s, n in mine for s2, n2, _, k in sorted(ie) if (s2, n2) == (s, n)))
        if own == union:
            continue
        merged = own + [k for k in union if k not in own]
        out[node] = [k for k in merged if k in valid]
    return out


def test_rebuilt_playlists_follow_the_definition(spark):
    rng = random.Random(3)
    keys = [f"k{i}" for i in range(12)]
    base = [(i, f"F\\P{i}", f"P{i}") for i in range(8)]
    inc = [(s, 100 * s + i, f"F\\P{i}" if i % 3 else f"G\\P{i}", f"P{i}") for s in (1, 2) for i in range(8) if (s + i) % 4]
    be = [(n, p, rng.choice(keys)) for n, _, _ in base if n % 5 for p in range(1, rng.randrange(2, 7))]
    ie = [(s, n, p, rng.choice(keys)) for s, n, _, _ in inc for p in range(1, rng.randrange(2, 7))]
    ie += [(1, 101, p, k) for n, p, k in be if n == 1]
    mapping, valid = {"k1": "k2", "k3": "k2"}, set(keys) - {"k5", "k1"}
    f = lambda data, schema: spark.createDataFrame(data, schema)
    got = rebuild.reconstruct(
        f(base, "node_id long, path string, name string"), f(be, "node_id long, pos int, key string"), f(inc, "src int, node_id long, path string, name string"), f(ie, "src int, node_id long, pos int, key string"),
        f(list(mapping.items()), "old_key string, new_key string"), f([(k,) for k in valid], "key string"), f([("k3",)], "key string"),
    )
    want = _rebuild_by_hand(base, be, inc, ie, mapping, valid)
    seen = {}
    for r in got["entries"].orderBy("node_id", "pos").collect():
        seen.setdefault(r["node_id"], []).append(r["key"])
    assert seen == {n: k for n, k in want.items() if k}
    counts = {r["node_id"]: (r["entries"], r["was_empty"]) for r in got["counts"].collect()}
    assert counts == {n: (len(k), not any(b[0] == n for b in be)) for n, k in want.items()}
    stats = {r["counter"]: r["value"] for r in got["stats"].collect()}
    assert stats["playlists_reconstructed"] == len(want) and stats["refilled_playlists"] + stats["unfilled_playlists"] == sum(not any(b[0] == n for b in be) for n, _, _ in base)
    twice = f([(1, "a", "n"), (2, "a", "n"), (3, "b", "m")], "node_id long, path string, name string")
    assert rows(rebuild.duplicate_paths(twice, f([(1, 5, "a", "n"), (1, 6, "b", "m"), (1, 7, "b", "m")], "src int, node_id long, path string, name string"))) == [("a",), ("b",)]


def test_imported_playlists_are_flat_renamed_and_trimmed(spark):
    nodes = spark.createDataFrame([(1, 10, "P"), (2, 11, "Q"), (3, 12, "P")], "ord long, node_id long, name string")
    entries = spark.createDataFrame([(10, 1, "a"), (10, 2, "gone"), (11, 1, "b"), (12, 1, "old")], "node_id long, pos int, key string")
    taken = spark.createDataFrame([("P",)], "name string")
    lists, kept, dropped = rebuild.import_playlists(nodes, entries, taken, spark.createDataFrame([("old", "a")], "old_key string, new_key string"), spark.createDataFrame([("a",), ("b",)], "key string"))
    assert rows(lists) == [(1, 10, "P", "P (2)", True, False), (2, 11, "Q", "Q", False, True), (3, 12, "P", "P (3)", True, False)]
    assert rows(kept) == [(10, 1, "a"), (11, 1, "b"), (12, 1, "a")] and rows(dropped) == [(10, "gone")]


def test_a_huge_playlist_is_numbered_in_parts(spark):
    data = spark.range(4000).selectExpr("case when id % 4 = 0 then 2 else 1 end as g", "(id * 37) % 4001 as o")
    got = playlists.positions_within(data, "g", "o").collect()
    for g in (1, 2):
        part = sorted((r["pos"], r["o"]) for r in got if r["g"] == g)
        assert [p for p, _ in part] == list(range(1, len(part) + 1)) and [o for _, o in part] == sorted(o for _, o in part)
    assert playlists.tree_paths(spark.createDataFrame([], "collection_id string, node_id long, parent_id long, node_type string, node_name string")).count() == 0
    assert len(model.TRACKED) == 6
