import random

import pytest
from conftest import rows

from tonearm import model
from tonearm.operators import cascade

COLS = "rid long, artist string, title string, album string, audio_id string, filesize string, playtime_float string, bitrate string, volume string, dir string, file string, from_disk boolean, primary_key string, tier string"


def rec(rid, artist="", title="", album="", audio="", size="", time="", dir_="/:x/:", file="f.mp3", disk=False):
    return (rid, artist, title, album, audio, size, time, "320", "C:", dir_, file, disk, f"C:{dir_}{file}{rid}", "clash")


def run(spark, old, new, level="loose", **kw):
    frame = lambda r: spark.createDataFrame(r, COLS)
    return {r["rid"]: (r["outcome"], r["tier"], r["new_rid"]) for r in cascade.match(frame(old), frame(new), level, **kw).collect()}


def test_first_unique_tier_wins_and_audio_id_is_never_refuted(spark):
    old = [rec(1, "A", "T", audio="id1", size="100", time="60", file="a.mp3"), rec(2, "Straße", "Ω", size="100", time="60", file="b.mp3")]
    new = [rec(11, "Z", "Y", audio="id1", size="900", time="600", file="c.mp3"), rec(12, "STRASSE", "ω", size="100", time="60", file="d.mp3")]
    assert run(spark, old, new, "strict") == {1: ("matched", "audio_id", 11), 2: ("matched", "artist_title_size_time", 12)}


def test_ambiguity_goes_on_to_lower_tiers(spark):
    old = [rec(1, "A", "T", dir_="/:p/:q/:r/:", file="x.mp3")]
    new = [rec(11, "A", "T", dir_="/:p/:q/:r/:", file="y.mp3"), rec(12, "A", "T", dir_="/:k/:", file="x.mp3")]
    assert run(spark, old, new, "filename")[1] == ("matched", "artist_title_file", 12)
    assert run(spark, [rec(1, "A", "T", file="z.mp3")], new)[1][0] == "ambiguous"


def test_size_settles_and_refutes(spark):
    old = [rec(1, "A", "T", size="1000", file="q.mp3")]
    new = [rec(11, "A", "T", size="1010", file="r.mp3"), rec(12, "A", "T", size="5000", file="s.mp3")]
    assert run(spark, old, new)[1] == ("matched", "artist_title", 11)
    assert run(spark, old, new[1:])[1] == ("refuted", None, None)
    assert run(spark, old, new[1:], refute=False)[1] == ("matched", "artist_title", 12)
    disk = [rec(13, "A", "T", size="5000", file="s.mp3", disk=True)]
    assert run(spark, old, disk)[1] == ("matched", "artist_title", 13)


def test_nan_never_refutes(spark):
    assert run(spark, [rec(1, "A", "T", time="nan", size="1e999", file="q.mp3")], [rec(11, "A", "T", time="50", size="4", file="r.mp3")])[1][0] == "matched"


def test_synced_copy_is_preferred(spark):
    old = [rec(1, "A", "T", file="q.mp3")]
    new = [rec(11, "A", "T", dir_="/:Sync_/:m/:", file="r.mp3"), rec(12, "A", "T", dir_="/:Sync_old/:m/:", file="r.mp3")]
    assert run(spark, old, new)[1] == ("matched", "artist_title", 11)


def test_nulls_and_empty_tables(spark):
    blank = (1, None, None, None, None, None, None, None, None, None, None, False, "k", None)
    assert run(spark, [blank], [rec(11, "A", "T")])[1] == ("unmatched", None, None)
    assert run(spark, [], [rec(11)]) == {}
    assert run(spark, [rec(1, "A", "T")], [])[1] == ("unmatched", None, None)


def test_collisions_are_dropped(spark):
    frame = lambda r: spark.createDataFrame(r, COLS)
    m = cascade.match(frame([rec(1, "A", "T", file="p.mp3"), rec(2, "A", "T", file="q.mp3"), rec(3, "B", "U", file="s.mp3")]), frame([rec(11, "A", "T", file="r.mp3"), rec(12, "B", "U", file="t.mp3")]), "loose")
    assert {r["rid"]: r["outcome"] for r in cascade.one_to_one(m).collect()} == {1: "destination_collision", 2: "destination_collision", 3: "matched"}
    stats = dict(rows(cascade.match_stats(m)))
    assert stats["matched"] == 3 and stats["matched_artist_title"] == 3


def test_provider_key_of_rank_zero(spark):
    p = spark.createDataFrame([(1, "old", "fingerprint", "k"), (12, "new", "fingerprint", "k")], "rid long, side string, tier string, key string")
    got = run(spark, [rec(1, "A", "T", file="q.mp3")], [rec(11, "A", "T", file="r.mp3"), rec(12, "Z", "Z", file="s.mp3")], providers=p)
    assert got[1] == ("matched", "fingerprint", 12)


def test_levels_and_labels():
    assert set(model.admitted("strict")) < set(model.admitted("loose")) < set(model.admitted("filename"))
    with pytest.raises(ValueError):
        model.admitted("any")
    assert [model.confidence_label(t) for t in (None, "audio_id", "path_suffix_3", "artist_title", "fingerprint")] == ["None", "Strong", "Good", "Weak", "Weak"]
    assert "artist_title" not in model.tag_free("filename")


@pytest.mark.parametrize(("refute", "cross"), [(True, False), (True, True), (False, False)])
def test_hot_keys_give_what_all_pairs_give(spark, monkeypatch, refute, cross):
    """Keys read by bands of classes against the same keys read record by record: nulls, zeros, repeats and synced copies among them."""
    rng = random.Random(11)
    cols = "rid long, primary_key string, audio_id string, artist string, title string, album string, filesize string, playtime_float string, file string, dir string, from_disk boolean"
    size = lambda: rng.choice(["1000", "1019", "1021", "1500", "0", "", None, "x", "-4", "990.5"])
    time = lambda: rng.choice(["100.0", "100.9", "101.1", "116", "86", "0", "", None, "0.5", "-1"])
    make = lambda i, disk: (i, f"k{i}", rng.choice(["a", "", None]), rng.choice(["A", "B"]), "T", "", size(), time(), rng.choice(["x.mp3", "y.mp3", "z.mp3"]), rng.choice(["/:p/:", "/:q/:Sync_/:", "/:Sync_old/:"]) if i % 17 == 0 else "/:p/:", disk)
    old, new = spark.createDataFrame([make(i, False) for i in range(160)], cols), spark.createDataFrame([make(1000 + i, cross) for i in range(70)], cols)
    got = {}
    for limit in (10_000, 0, 5):
        monkeypatch.setattr(cascade, "HOT", limit)
        got[limit] = rows(cascade.match(old, new, "filename", refute))
    assert got[0] == got[10_000] and got[5] == got[10_000]
    assert len({r[2] for r in got[0]}) >= 2
