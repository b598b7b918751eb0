import random
from datetime import datetime, timedelta

from conftest import rows

from tonearm.operators import orphans

T0 = datetime(2024, 1, 1)
REFS = "code long, at timestamp, ref long"
LIVES = "code long, since timestamp, until timestamp"


def brute(refs, lives):
    out = []
    for code, at, ref in refs:
        own = [x for x in lives if code is not None and x[0] == code]
        if at is None:
            ok = bool(own)
        else:
            ok = any(s is not None and s <= at and (u is None or at < u) for _, s, u in own)
        if not ok:
            out.append((code, at, ref))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    rng = random.Random(3)
    day = lambda: T0 + timedelta(days=rng.randrange(400), seconds=rng.randrange(3) * 3600)
    lives = []
    for code in [*range(60), 40_000, 70_001]:
        for _ in range(rng.randrange(3)):
            since = day()
            lives.append((code, since, rng.choice([None, None, since + timedelta(days=rng.randrange(0, 90))])))
    lives += [(5, None, None), lives[0], (None, T0, None)]
    codes = [*range(70), 40_000, 70_001, None]
    refs = [(rng.choice(codes), rng.choice([day(), day(), day(), None]), i) for i in range(900)]
    refs += [refs[0], (7, lives[0][1], 5000)]
    got = rows(orphans.orphan_refs(spark.createDataFrame(refs, REFS), spark.createDataFrame(lives, LIVES)))
    assert got == brute(refs, lives)


def test_hot_code_is_salted(spark, monkeypatch):
    monkeypatch.setattr(orphans, "SWEEP_ROWS", 50)
    lives = [(1, T0 + timedelta(days=5), T0 + timedelta(days=9)), (1, T0 + timedelta(days=20), None)]
    refs = [(1, T0 + timedelta(hours=6 * i), i) for i in range(200)]
    got = rows(orphans.orphan_refs(spark.createDataFrame(refs, REFS), spark.createDataFrame(lives, LIVES)))
    assert got == brute(refs, lives)


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], LIVES), spark.createDataFrame([(1, T0, 1), (None, None, 2)], REFS)
    assert len(rows(orphans.orphan_refs(some, none))) == 2
    assert rows(orphans.orphan_refs(spark.createDataFrame([], REFS), spark.createDataFrame([(1, T0, None)], LIVES))) == []


def test_library_tables_with_extra_columns(spark):
    tracks = spark.createDataFrame([("c", "k", 1, T0, None, "x"), ("c", "k2", 2, T0, T0 + timedelta(days=1), "x")], "collection_id string, primary_key string, entry_id long, loaded_at timestamp, removed_at timestamp, code string")
    entries = spark.createDataFrame([(1, "c", "k", T0, 1), (2, "c", "gone", T0, 1), (3, "c", "k2", T0 + timedelta(days=2), 1), (4, "d", "k", None, 1), (5, None, "k", T0, 1)], "ref_id long, collection_id string, primary_key string, added_at timestamp, period int")
    pairs = spark.createDataFrame([(9, 1, 2, T0 + timedelta(days=3)), (10, 1, 1, T0), (11, 1, 77, None)], "pair_id long, left_id long, right_id long, matched_at timestamp")
    got = rows(orphans.library_orphans(tracks, entries, pairs))
    assert got == [("match_pairs", 11, "unknown"), ("match_pairs", 9, "2024-01"), ("playlist_entries", 2, "2024-01"), ("playlist_entries", 3, "2024-01"), ("playlist_entries", 4, "unknown"), ("playlist_entries", 5, "2024-01")]
