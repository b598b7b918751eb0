import pytest
from conftest import rows

from tonearm.sources import collection_xml as cx
from tonearm.sources import files, lists
from tonearm.streaming import tagcache

DOC = """<?xml version="1.0" encoding="UTF-8"?>
<NML VERSION="20"><HEAD></HEAD><COLLECTION ENTRIES="3">
<ENTRY ARTIST="A &amp; B" TITLE="Ünï" AUDIO_ID="x"><LOCATION DIR="/:M/:" FILE="a.mp3" VOLUME="C:" VOLUMEID="id"></LOCATION><ALBUM TITLE="L"></ALBUM><INFO BITRATE="320000" PLAYTIME_FLOAT="1.5" FILESIZE="10"></INFO></ENTRY>
<ENTRY TITLE="no place"></ENTRY>
<ENTRY TITLE="T2"><LOCATION DIR="/:M/:" FILE="b.mp3" VOLUME="D:"></LOCATION></ENTRY>
</COLLECTION><PLAYLISTS><NODE TYPE="FOLDER" NAME="$ROOT"><SUBNODES COUNT="2">
<NODE TYPE="FOLDER" NAME="F"><SUBNODES COUNT="1"><NODE TYPE="PLAYLIST" NAME="P"><PLAYLIST ENTRIES="9" UUID="u"><ENTRY><PRIMARYKEY TYPE="TRACK" KEY="C:/:M/:a.mp3"></PRIMARYKEY></ENTRY><ENTRY><PRIMARYKEY TYPE="STEM" KEY="C:/:M/:a.mp3"></PRIMARYKEY></ENTRY></PLAYLIST></NODE></SUBNODES></NODE>
<NODE TYPE="PLAYLIST" NAME="Empty"><PLAYLIST ENTRIES="0"></PLAYLIST></NODE></SUBNODES></NODE></PLAYLISTS>
<INDEXING><SORTING_INFO PATH="F\\P"></SORTING_INFO></INDEXING></NML>"""


def test_document_tables(spark, tmp_path):
    (tmp_path / "a.nml").write_text(DOC, encoding="utf-8")
    (tmp_path / "bad.nml").write_text("<NML>")
    t = cx.read_tracks(spark, str(tmp_path), strict=False).orderBy("ord").collect()
    assert [(r["artist"], r["title"], r["volumeid"], r["primary_key"], r["filesize"]) for r in t] == [("A & B", "Ünï", "id", "C:/:M/:a.mp3", "10"), ("", "T2", "D:", "D:/:M/:b.mp3", "")]
    n = cx.read_nodes(spark, str(tmp_path / "a.nml")).orderBy("ord").collect()
    assert [(r["node_path"], r["node_type"], r["declared_entries"]) for r in n] == [("", "FOLDER", None), ("F", "FOLDER", None), ("F\\P", "PLAYLIST", 9), ("Empty", "PLAYLIST", 0)]
    assert [(r["pos"], r["key_type"]) for r in cx.read_entries(spark, str(tmp_path / "a.nml")).orderBy("pos").collect()] == [(1, "TRACK"), (2, "STEM")]
    assert cx.read_sorting(spark, str(tmp_path / "a.nml")).first()["path"] == "F\\P"
    assert cx.problems(spark, str(tmp_path)).count() == 1


def test_patches_leave_other_bytes(tmp_path):
    new, n = cx.patch_references(DOC, {"C:/:M/:a.mp3": 'E:/:"N"/:a.mp3'}, {"D:/:M/:b.mp3": ("F:", "fid", "/:Q/:", "b.mp3")})
    assert n == 3 and new.count("E:/:&quot;N&quot;/:a.mp3") == 2 and 'VOLUME="F:" VOLUMEID="fid"' in new.replace('FILE="b.mp3" ', "")
    assert cx.patch_references(DOC, {}, {})[0] == DOC
    with pytest.raises(cx.PatchError):
        cx.patch_references(DOC, {}, {"X:/:none": ("", "", "", "")})
    assert cx.set_entry_attributes("<ENTRY TITLE=\"a\"></ENTRY>", {"title": "b&c", "album": "L", "bitrate": ""}) == '<ENTRY TITLE="b&amp;c"><ALBUM TITLE="L"></ALBUM></ENTRY>'
    assert cx.recount('<SUBNODES COUNT="1">', "COUNT", 4) == '<SUBNODES COUNT="4">' and cx.recount("<SUBNODES>", "COUNT", 4) == "<SUBNODES>"


def test_write_and_read_again(spark, tmp_path):
    (tmp_path / "a.nml").write_text(DOC, encoding="utf-8")
    t = cx.read_tracks(spark, str(tmp_path / "a.nml"))
    lists_ = spark.createDataFrame([("P<1>", "u", 2, "k2"), ("P<1>", "u", 1, "k&1"), ("P<1>", "u", 3, "k2")], "name string, uuid string, pos int, key string")
    out = str(tmp_path / "out.nml")
    assert cx.write_collection(t, out, lists_) == 2
    again = cx.read_tracks(spark, out)
    assert rows(again.drop("collection_id", "ord")) == rows(t.drop("collection_id", "ord"))
    assert [r["key"] for r in cx.read_entries(spark, out).orderBy("pos").collect()] == ["k&1", "k2", "k2"]
    with pytest.raises(ValueError):
        cx.refuse_same_file(out, out)
    report = str(tmp_path / "r.csv")
    assert cx.write_report(t.select("artist", "title").where("false"), report, ["artist", "title"]) == 0
    assert open(report).read() == "artist,title\n"


def test_lists():
    kinds = lambda rows_: [(r[0], r[2], r[3], r[4]) for r in rows_]
    assert kinds(lists.parse_text("﻿1 - A - T\n\n# c\nno dash\nB - \n".encode())) == [(1, "track", "A", "T"), (4, "unparseable", "", ""), (5, "unparseable", "", "")]
    with pytest.raises(lists.ListError):
        lists.parse_text(b"\xff\xfe")
    got = lists.parse_csv('Title;ARTIST;Duration\n"T\n2";A;3:05\n;;\nT3;;\n'.encode("cp1252"))
    assert [(r[0], r[2], r[3], r[4], r[6]) for r in got] == [(2, "track", "A", "T\n2", "185.000"), (5, "unparseable", "", "T3", "")]
    with pytest.raises(lists.ListError):
        lists.parse_csv(b"a,b\n")
    m = lists.parse_m3u("#EXTM3U\n#EXTINF:12,A - T\nC:\\Music\\x.mp3\nhttp://a/b\n/u/y.mp3\n".encode())
    assert [(r[2], r[3], r[6], r[7], r[8]) for r in m] == [("track", "A", "12.000", "x.mp3", ["Music"]), ("unparseable", "", "", "", []), ("track", "", "", "y.mp3", ["u"])]
    assert [r[7] for r in lists.parse_folder(["10.mp3", "9.mp3", "x.txt"], lambda n: n.endswith("mp3"))] == ["9.mp3", "10.mp3"]
    assert lists.decode(b"caf\xe9 \x81") == "café \x81" and lists.csv_template().startswith(b"\xef\xbb\xbfArtist,Title")


def test_lists_in_parallel(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.txt").write_text("A - T\nx\n")
    assert lists.read_lists(spark, str(tmp_path), "text").groupBy("kind").count().orderBy("kind").collect()[0]["count"] == 3
    with pytest.raises(lists.ListError):
        lists.detect(str(tmp_path / "none.txt"))


def test_scan_and_records(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in ("a.mp3", "b.STEM.MP3", "c.txt"):
        (tmp_path / "in" / n).write_bytes(b"x" * 2560)
    found = files.scan(spark, [str(tmp_path / "in"), str(tmp_path)])
    assert sorted((r["path"].rsplit("/", 1)[1], r["root_ord"]) for r in found.collect()) == [("a.mp3", 0), ("b.STEM.MP3", 0)]
    rec = files.records(found, files.read_tags(found)).orderBy("file").first()
    assert (rec["filesize"], rec["artist"], rec["audio_id"], rec["from_disk"]) == ("2", "", "", True)
    with pytest.raises(FileNotFoundError):
        files.explicit(spark, [str(tmp_path / "missing.mp3")])
    assert files.fingerprints(found, tool="no-such-tool").where("sec is not null").count() == 0
    assert files.parse_fingerprint("DURATION=3.5\nFINGERPRINT=AQ\n") == (3.5, "AQ") and files.parse_fingerprint("x") is None


def test_cache_misses_and_stream(spark, tmp_path):
    listing = spark.createDataFrame([("/a", 1, 5.9), ("/b", 2, 6.0)], "path string, size long, mtime double").withColumn("cache_key", tagcache.cache_key())
    cache = spark.createDataFrame([("/a|1|5", None)], "cache_key string, tags string")
    assert [r["path"] for r in tagcache.misses(listing, cache).collect()] == ["/b"]
    assert tagcache.misses(listing, cache, refresh=True).count() == 2
    src, out = str(tmp_path / "listing"), str(tmp_path / "cache")
    run = lambda: tagcache.stream_scan(spark, src, "path string, size long, mtime double", out, str(tmp_path / "cp"), lambda df: df.selectExpr("cache_key", "upper(path) as tags")).awaitTermination()
    listing.drop("cache_key").coalesce(1).write.parquet(src)
    run()
    listing.drop("cache_key").coalesce(1).write.mode("append").parquet(src)
    run()
    assert rows(spark.read.parquet(out).select("cache_key", "tags")) == [("/a|1|5", "/A"), ("/b|2|6", "/B")]
    assert tagcache.progress_points(60, 25) == [25, 50, 60]
