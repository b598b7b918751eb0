import pytest

from tonearm.llm import lookalikes, mojibake


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("chain", mojibake.CHAINS)
def test_chains_go_there_and_back(chain):
    for word in ("Zoë", "Мурисур", "Σίλον", "ヴァン", "Ořamorsá"):
        form = mojibake.garble(word, chain)
        if form and form != word and mojibake.LOST not in form and chain[-1] != "utf-8":
            assert mojibake.garble(mojibake.ungarble(form, chain) or "", chain) == form


TRACKS = "entry_id long, title string, artist string, album string, dir_value string, file_name string, token string"


def track(i, title, file, artist="A"):
    return (i, title, artist, "L", "/:m/:", file, "clash")


def test_garbled_rows_are_found_and_restored(spark):
    clean = ["Zoë Bar", "Мурисур", "Žofie & Přítel", "30° ½ ♥", "ティガフプ"]
    data = [track(i, t, f"{t}.mp3") for i, t in enumerate(clean)]
    bad = {10: ("utf-8", "cp1252"), 11: ("utf-8", "cp437"), 12: ("utf-8", "cp1250"), 13: ("utf-8", "mac_roman"), 14: ("utf-8", "cp1252", "utf-8", "cp1252")}
    for (i, chain), t in zip(bad.items(), clean, strict=True):
        data.append(track(i, "x", " ".join(mojibake.garble(w, chain) for w in t.split()) + ".mp3"))
    data += [track(20, "x", "Zo� Bar.mp3"), track(21, "x", None), track(22, None, ""), track(23, "x", "plain.mp3"), track(24, "x", "naïve.mp3")]
    data.append(track(25, "x", mojibake.garble("Überall", ("utf-8", "cp1252")) + ".mp3"))
    tracks = spark.createDataFrame(data, TRACKS)
    artists = spark.createDataFrame([("Überzug",), (None,)], "artist_name string")
    lines = spark.createDataFrame([(1, mojibake.garble("Zoë", ("utf-8", "latin-1")) + " - T"), (2, None), (3, "Zoë - T")], "line_id long, raw_text string")
    got = {(r["source_table"], r["row_id"]): r["restored"] for r in mojibake.library_garbled(tracks, lines, artists).collect()}
    assert {k[1] for k in got if k[0] == "tracks"} == {10, 11, 12, 13, 14, 20, 25}
    assert [got["tracks", i] for i in (10, 11, 12, 13, 14)] == [f"{t}.mp3" for t in clean]
    assert got["request_lines", 1] == "Zoë - T" and ("request_lines", 3) not in got
    assert got["tracks", 25] == "Überall.mp3"


def test_garbled_on_empty_tables(spark):
    t = spark.createDataFrame([], TRACKS)
    assert mojibake.library_garbled(t, spark.createDataFrame([], "line_id long, raw_text string"), spark.createDataFrame([], "artist_name string")).count() == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Ｄｊ　Ａ", "Dj A"), ("Café", "Café"), ("a​b﻿c­", "abc"), ("a b c", "a b c"), ("x‑y", "x-y"), ("Pаrt", "Part"), ("Зедоcас", "Зедосас"),
        ("Сон", "Сон"), ("Κύκλος", "Κύκλος"), ("30° ™ ½", "30° ™ ½"), ("Koto", "Koto"), ("Vuﬁr", "Vufir"), ("Part Ⅱ", "Part II"), ("muɡ", "mug"), ("ガヴ", "ガヴ"), ("", ""),
    ],
)
def test_consistent_form(text, want):
    assert lookalikes.consistent(text) == want
    assert lookalikes.consistent(want) == want


def test_lookalike_cells(spark):
    garbled = mojibake.garble("Zoë", ("utf-8", "cp1252")) + " x.mp3"
    data = [track(1, "Café Set", "Café.mp3"), track(2, "Café Set", garbled, "Zoë"), track(3, None, ""), track(4, "Сон", "ok.mp3"), track(5, "Zoë " * 5000 + "​", "t.mp3")]
    got = rows(lookalikes.library_lookalikes(spark.createDataFrame(data, TRACKS), spark.createDataFrame([("Zoë",)], "artist_name string")).select("entry_id", "field_name"))
    assert got == [(1, "file_name"), (2, "title"), (5, "title")]
    assert lookalikes.library_lookalikes(spark.createDataFrame([], TRACKS), spark.createDataFrame([], "artist_name string")).count() == 0


def test_canonical_member_of_a_class(spark):
    values = spark.createDataFrame([("Café",), ("Café",), ("Café​",), ("Cafe",), (None,)], "value string")
    assert rows(lookalikes.canonical_values(values)) == [("Café", "Café"), ("Café​", "Café")]


def test_classes_of_the_corpus_decide(spark):
    """The corpus holds a clean member of the class: it wins over the alphabet that most letters of the word have."""
    word = "\u0421\u043ep"
    values = lambda *texts: spark.createDataFrame([(t,) for t in texts], "value string")
    assert rows(lookalikes.canonical_values(values(word))) == [(word, "\u0421\u043e\u0440")]
    assert rows(lookalikes.canonical_values(values(word, "Cop", "Cop", "\u0421\u043e\u0440"))) == [(word, "Cop")]
    # Without a clean member the class takes one form for all its spellings.
    twins = ["\u0421op x", "\u0421\u043ep x", "\u0421op\u200b x", "\u0421op x"]
    assert {c for _, c in rows(lookalikes.canonical_values(values(*twins)))} == {"Cop x"}


def test_mapping_is_done_in_sql(spark):
    """Width, spaces and hyphens by the tables; accents and invisible characters by the collation."""
    got = dict(rows(lookalikes.canonical_values(spark.createDataFrame([("\uff24\uff4a\u3000A",), ("Dj A",), ("x\u2011y",), ("Vu\ufb01r",), ("Part \u2161",), ("e\u0301\u00adt",), ("\u00e9t",)], "value string"))))
    assert got == {"\uff24\uff4a\u3000A": "Dj A", "x\u2011y": "x-y", "Vu\ufb01r": "Vufir", "Part \u2161": "Part II", "e\u0301\u00adt": "\u00e9t"}
