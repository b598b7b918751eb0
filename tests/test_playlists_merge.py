import itertools
import random
import re
from pathlib import PurePosixPath

from conftest import rows
from pyspark.sql import functions as F

from tonearm.functions import text
from tonearm.operators import components, discover, fingerprint, measures, merge, playlists, rewrite


def test_components_of_chains_rings_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(30)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(rows(components.components(spark.createDataFrame(edges, "src long, dst long"))))
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30)) and got[201] == 200 and len(got) == 41 + 30 + 2
    assert rows(components.components(spark.createDataFrame([], "src long, dst long"))) == []


def test_tree_and_names(spark):
    nodes = spark.createDataFrame(
        [("c", 1, None, "FOLDER", "root"), ("c", 2, 1, "FOLDER", "A"), ("c", 3, 2, "PLAYLIST", "p"), ("c", 4, 3, "PLAYLIST", "under a playlist"), ("c", 5, 99, "PLAYLIST", "lost"), ("c", 6, 2, "FOLDER", "root"), ("c", 7, 1, "PLAYLIST", None)],
        "collection_id string, node_id long, parent_id long, node_type string, node_name string",
    )
    assert [r[1:3] for r in rows(playlists.tree_paths(nodes))] == [(2, "A"), (3, "A\\p"), (6, "A\\root"), (7, "")]
    assert {r["node_id"]: r["unique_name"] for r in playlists.name_uniqueness(nodes).collect()} == {2: True, 6: False}


def test_ordered_union_keeps_base_repeats(spark):
    base = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b")], "node_id long, pos int, key string")
    inc = spark.createDataFrame([(1, 2, 1, "d"), (1, 1, 2, "c"), (1, 1, 1, "b"), (1, 1, 3, "c"), (2, 1, 1, "z")], "node_id long, src int, pos int, key string")
    got = rows(playlists.ordered_union(base, inc))
    assert got == [(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (1, 4, "c"), (1, 5, "d"), (2, 1, "z")]
    assert dict(rows(playlists.same_sequence(playlists.ordered_union(base, inc), base))) == {1: False, 2: False}


def test_available_names_are_sequential(spark):
    wanted = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x (2)"), (4, "y"), (5, "x")], "ord long, name string")
    taken = spark.createDataFrame([("x",), ("y (2)",)], "name string")
    got = [r[2] for r in rows(playlists.available_names(wanted, taken))]
    assert got == ["x (2)", "x (3)", "x (2) (2)", "y", "x (4)"] and len(set(got)) == 5


def test_rules_first_match_and_fallback(spark):
    rules = [rewrite.Rule("C:", "/:A/:B/:", "D:", "/:X/:"), rewrite.Rule("C:", "/:A/:", "E:", "/:Y/:", "id")]
    keys = spark.createDataFrame([("C:/:A/:B/:f",), ("C:/:A/:c/:f",), ("C:/:Z/:f",), ("nokey",), ("C:/:A/:m",)], "key string")
    mapping = spark.createDataFrame([("C:/:A/:m", "Q:/:m")], "old_key string, new_key string")
    got = {r["key"]: (r["new_key"], r["how"]) for r in rewrite.rewrite_keys(keys, mapping, rules).collect()}
    assert got == {"C:/:A/:B/:f": ("D:/:X/:f", "rule"), "C:/:A/:c/:f": ("E:/:Y/:c/:f", "rule"), "C:/:Z/:f": ("C:/:Z/:f", "unchanged"), "nokey": ("nokey", "unchanged"), "C:/:A/:m": ("Q:/:m", "collection")}


def test_decisions_overlay(spark):
    mapping = spark.createDataFrame([("a", "1"), ("b", "2")], "old_key string, new_key string")
    said = spark.createDataFrame([("a", 1, "accept", "9"), ("a", 2, "leave", None), ("c", 1, "accept", "7"), ("b", 1, "leave", None), ("b", 2, "undo", None)], "old_key string, seq int, decision string, pick string")
    assert rows(rewrite.overlay_decisions(mapping, said)) == [("b", "2"), ("c", "7")]


def test_merge_states(spark):
    cols = "rid long, input_idx int, artist string, title string, album string, filesize string, playtime_float string, bitrate string, audio_id string, dir string, file string, primary_key string"
    r = lambda rid, i, album="L", size="100", time="60", key="k": (rid, i, "A", "T", album, size, time, "320", "id", "/:d/:", "f.mp3", key)
    recs = spark.createDataFrame([r(1, 0), r(2, 1, size="103")], cols)
    g = merge.identity_groups(recs)
    assert rows(g) == [(1, 1), (2, 1)]
    assert merge.group_facts(recs, g).first()["state"] == "settled"
    out = merge.outlier_readings(recs, g, merge.survivors(recs, g)).collect()
    assert [(x["attr"], x["kept"], x["other"]) for x in out] == [("filesize", "100", "103")]
    two = spark.createDataFrame([r(1, 1, album="X"), r(2, 2, album="Y", key="k2")], cols)
    g = merge.identity_groups(two)
    assert merge.group_facts(two, g).first()["state"] == "conflict"
    first, last = merge.survivors(two, g, "first").first(), merge.survivors(two, g, "last").first()
    assert (first["rid"], last["rid"]) == (1, 2)
    assert rows(merge.redirects(two, g, merge.survivors(two, g))) == [("k2", "k")]


def test_discovery_against_all_pairs(spark):
    import difflib

    from tonearm.functions.text import STOP_WORDS, normalise_py

    rng = random.Random(5)
    words = ["lime", "tree", "night", "the", "river", "blue", "song", "mix"]
    pick = lambda n: " ".join(rng.choice(words) for _ in range(n))
    asked = [(i, pick(2), pick(3)) for i in range(8)]
    offer = [(i, pick(2), pick(3)) for i in range(30)]
    tok = lambda s: {w for w in normalise_py(s).split() if w not in STOP_WORDS}
    cov = lambda a, b: len(tok(a) & tok(b)) / len(tok(a)) if tok(a) else 0
    best = lambda a, b: max(difflib.SequenceMatcher(None, normalise_py(a), normalise_py(b)).ratio(), cov(a, b))
    want = []
    for line, a, t in asked:
        s = [(-round(0.3 * best(a, x) + 0.55 * best(t, y) + 0.15 * best(f"{a} {t}", f"{x} {y}"), 6), c) for c, x, y in offer if tok(t) & tok(y)]
        want += [(line, k + 1, c) for k, (v, c) in enumerate(sorted(x for x in s if -x[0] >= 0.5)[:3])]
    r = discover.rank(spark.createDataFrame(asked, "line long, artist string, title string"), spark.createDataFrame(offer, "cand long, c_artist string, c_title string"))
    assert [x[:3] for x in rows(r)] == sorted(want)


def test_discovery_of_untagged_files_against_all_pairs(spark):
    import difflib

    from tonearm.functions.text import STOP_WORDS, normalise_py

    asked = [(1, "Ursula Fezo", "Kapamisis Pupil"), (2, "Zoe Bar", "River"), (3, "Nobody", "Unheard"), (4, "Rita", "Night Song")]
    files = [
        (10, None, None, "07 Ursula Fezo - Kapamisis & Pupil.mp3"), (11, "", "Kapamisis", "x.mp3"), (12, "Zoe Bar", None, "River_Blue.mp3"), (13, None, "River", "Zoe Bar - River.flac"),
        (14, None, None, None), (15, None, None, "12A Zoe Bar - River.wav"), (17, "Rita", "Night Song", "b/n.mp3"), (18, "Rita", "Night Song", "A/n.mp3"),
    ]
    label = lambda n: re.sub(r"^(?:\d{1,2}[a-z]|\d{1,3})[ _-]+", "", PurePosixPath(n or "").stem.replace("_", " "), flags=re.I)
    tok = lambda s: {w for w in normalise_py(s).split() if w not in STOP_WORDS}
    cov = lambda a, b: len(tok(a) & tok(b)) / len(tok(a)) if tok(a) else 0
    best = lambda a, b: max(difflib.SequenceMatcher(None, normalise_py(a), normalise_py(b)).ratio(), cov(a, b))
    want = []
    for line, a, t in asked:
        s = []
        for c, x, y, n in files:
            xb, yb = x or label(n), y or label(n)
            if cov(t, yb):
                sa, st, full = best(a, xb), best(t, yb), best(f"{a} {t}", f"{xb} {yb}" if x or y else label(n))
                s.append((-round(0.3 * sa + 0.55 * st + 0.15 * full, 6), (n or "").casefold(), c, round(sa, 6), round(st, 6)))
        s = sorted(x for x in s if -x[0] >= 0.5)[:3]
        want += [(line, k + 1, c, -v, sa, st) for k, (v, _, c, sa, st) in enumerate(s)] or [(line, 1, None, 0.0, 0.0, 0.0)]
    offers = spark.createDataFrame(files, "cand long, c_artist string, c_title string, c_path string")
    r = discover.rank(spark.createDataFrame(asked, "line long, artist string, title string"), offers.withColumn("c_label", text.file_label(F.regexp_replace("c_path", "^.*/", ""))))
    assert rows(r) == sorted(want, key=repr)
    assert {10, 12, 15} <= {x[2] for x in want} and (3, 1, None, 0.0, 0.0, 0.0) in want and [x[2] for x in want if x[0] == 4] == [18, 17]


def test_discovery_asks_files_without_tags(spark, tmp_path):
    from tonearm.plans.queries import QUERIES

    spark.createDataFrame([(20, "Ursula Fezo", "Kapamisis"), (40, "Nobody", "Unheard"), (60, None, None)], "line_id long, artist string, title string").write.parquet(f"{tmp_path}/request_lines.parquet")
    spark.createDataFrame([(1, "/m/", "Ursula Fezo - Kapamisis.mp3", None, None)], "file_id long, scan_root string, file_name string, artist string, title string").write.parquet(f"{tmp_path}/disk_files.parquet")
    assert [x[:3] for x in rows(QUERIES["discover_topk"](spark, str(tmp_path)))] == [(20, 1, 1), (40, 1, None)]


def test_fingerprints_against_all_pairs(spark):
    rng = random.Random(1)
    base = [[rng.random() for _ in range(6)] for _ in range(3)]
    data = [(i, 100 + rng.random() * 3, [x + rng.random() * 0.1 for x in base[i % 3]]) for i in range(40)] + [(99, 101.0, None), (98, None, base[0])]
    df = spark.createDataFrame(data, "id long, sec double, fp array<double>")
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    want = set()
    for (i, s, f), (j, t, g) in itertools.product(data, data):
        if f and g and s and t and abs(s - t) <= 1 and dot(f, g) / (dot(f, f) * dot(g, g)) ** 0.5 >= 0.8:
            want.add((i, j))
    assert {(r["left_id"], r["right_id"]) for r in fingerprint.similar(df, df).collect()} == want


def test_copy_agreement(spark):
    """A copy below the folder is paired with the first entry outside that has its stem, whatever the artist."""
    t = spark.createDataFrame(
        [(1, "/:Music/:", "x.mp3", "1"), (2, "/:Music/:", "X.mp3", "9"), (3, "/:Backup/:A/:", "X.mp3", "1"), (4, "/:Backup/:", "x.flac", "1"), (5, "/:Backup/:", "x.wav", "2"), (6, "/:Backup/:", "y.mp3", "1"), (7, "/:Music/:", "z.mp3", ""), (8, "/:Backup/:", "z.mp3", ""), (9, "/:Backup/:", "x.txt", "1"), (10, None, None, None)],
        "entry_id long, dir_value string, file_name string, audio_id string",
    )
    assert rows(measures.copy_agreement(t, ["Backup"])) == [(0.5, 0.5, 2, 2)]
    assert rows(measures.copy_agreement(t.limit(0), ["Backup"])) == [(0.0, 0.0, 0, 0)]


def test_false_collisions_are_pairs(spark):
    """Against the pairs themselves: tags and length agree, or one file twice."""
    rng = random.Random(4)
    data = [(i, rng.choice(["g", "h", "", None]), rng.choice(["A", "a", "B", None]), "T", rng.choice(["10", "11", ""]), rng.choice(["1.0", "1.9", "2.0", "3.5", "x", None]), rng.choice(["320", ""])) for i in range(120)]
    t = spark.createDataFrame(data, "entry_id long, audio_id string, artist string, title string, filesize string, playtime_float string, bitrate string")
    want = {}
    for x, y in itertools.combinations(data, 2):
        if x[1] and x[1] == y[1]:
            sec = lambda v: float(v) if v and v != "x" else None
            close = sec(x[5]) is not None and sec(y[5]) is not None and abs(sec(x[5]) - sec(y[5])) <= 1.0
            twice = all(x[4:]) and x[4:] == y[4:]
            n = want.setdefault(x[1], [0, 0])
            n[0] += 1
            n[1] += not (((x[2] or "").casefold() == (y[2] or "").casefold() and close) or twice)
    assert {r["audio_id"]: [r["pairs"], r["collisions"]] for r in measures.false_collisions(t).collect()} == want
    assert measures.false_collisions(t.limit(0)).count() == 0


def test_measured_thresholds():
    assert measures.groups_by_audio_id(0.99, 0.995, 0) and not measures.groups_across_formats(0.99, 0.99, 0.9, 0)


def test_coverage_compares_sets_of_words_once(spark):
    """Repeats of a set of words, ties among them and words in another order, against all pairs; the pairs of words grow with the sets only."""
    names = ["red bolt", "bolt red", "blue bolt", "red", "The Red", "red blue rod", "", None, "mix"]
    offers = [(i, names[i % len(names)]) for i in range(60)]
    asked = [(i, ["red bolt", "Bolt, red rod", "rod", "nothing", "", None, "blue red"][i % 7]) for i in range(14)]
    tok = lambda s: {w for w in (s or "").lower().replace(",", "").split() if w not in text.STOP_WORDS}
    want = []
    for line, t in asked:
        s = sorted((-round(len(tok(t) & tok(n)) / len(tok(t)), 6), c) for c, n in offers if tok(t) & tok(n))[:3]
        want += [(line, k + 1, c, -v) for k, (v, c) in enumerate(s)]
    o = spark.createDataFrame(offers, "cand long, c_title string").withColumn("c_artist", F.lit(""))
    r = discover.rank_by_coverage(spark.createDataFrame(asked, "line long, title string").withColumn("artist", F.lit("")), o)
    assert rows(r) == sorted(want, key=repr)
    assert "Window [row_number() windowspecdefinition(held" in r._jdf.queryExecution().optimizedPlan().toString()


def test_discovery_in_cells_skips_what_cannot_win(spark, monkeypatch):
    """Random texts against the ratios of all pairs: the same best three of each line with ties, by a small part of the ratios, in any grid of cells."""
    import difflib

    import pandas as pd

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeilnor") for _ in range(rng.randint(2, 7)))
    title_words = [word() for _ in range(12)]
    title = lambda: " ".join(rng.sample(title_words, 2) + [word()])
    offers = [(i, word(), title()) for i in range(150)]
    offers += [(1000 + i, *offers[i][1:]) for i in range(20)]
    asked = [(i, offers[i][1], offers[i][2]) for i in range(0, 30)] + [(100, "x", "unheard"), (101, "", title_words[0])]
    cov = lambda a, b: len(set(a.split()) & set(b.split())) / max(1, len(set(a.split())))
    best = lambda a, b: max(difflib.SequenceMatcher(None, a, b).ratio(), cov(a, b))
    full, pairs = {}, 0
    for line, a, t in asked:
        s = [(c, round(0.3 * best(a, x) + 0.55 * best(t, y) + 0.15 * best(f"{a} {t}".strip(), f"{x} {y}"), 6)) for c, x, y in offers if cov(t, y)]
        pairs += len(s)
        full[line] = sorted((-v, c) for c, v in s if v >= 0.5)[:3]
    frame = lambda rows_, extra: pd.DataFrame([(i, a, a, t, t, f"{a} {t}".strip(), f"{a} {t}".strip(), *extra(i)) for i, a, t in rows_], columns=["id", *[f"{f}_{p}" for f in ("artist", "title", "full") for p in ("plain", "words")], *(["c_path"] if extra(0) else [])])
    calls = []
    real = difflib.SequenceMatcher.ratio
    monkeypatch.setattr(difflib.SequenceMatcher, "ratio", lambda self: calls.append(1) or real(self))
    cell = discover._cell(frame(asked, lambda i: ()).rename(columns={"id": "line"}), frame(offers, lambda i: ("",)).rename(columns={"id": "cand"}), 3, 0.5)
    monkeypatch.undo()
    assert len(calls) < 1.5 * pairs
    cell["score"] = [round(0.3 * a + 0.55 * t + 0.15 * f, 6) for a, t, f in zip(cell.artist_score, cell.title_score, cell.full_score, strict=True)]
    for line, *_ in asked:
        x = cell[cell.line == line]
        assert sorted((-v, c) for v, c in zip(x.score, x.cand, strict=True) if v >= 0.5)[:3] == full[line]
    want = sorted([(line, k + 1, c, -v) for line, s in full.items() for k, (v, c) in enumerate(s)] + [(line, 1, None, 0.0) for line, s in full.items() if not s], key=repr)
    o, r = spark.createDataFrame(offers, "cand long, c_artist string, c_title string"), spark.createDataFrame(asked, "line long, artist string, title string")
    for offers_, requests_ in ((10_000, 20_000), (40, 10)):
        monkeypatch.setattr(discover, "CELL_OFFERS", offers_)
        monkeypatch.setattr(discover, "CELL_REQUESTS", requests_)
        assert rows(discover.rank(r, o).select("line", "rank", "cand", "score")) == want
