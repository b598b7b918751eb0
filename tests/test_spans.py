import pytest
from test_sources import DOC

from tonearm.sources import collection_xml as cx
from tonearm.sources import lists, spans

WILD = """<?xml version="1.0" encoding="UTF-8"?>
<!-- <LOCATION DIR="/:M/:" FILE="a.mp3" VOLUME="C:"/> -->
<NML VERSION="20" STRANGE='x > "y"'><HEAD PROGRAM="p"/><COLLECTION ENTRIES='2'>
  <ENTRY TITLE='it"s >' KEEP="&#xE9;"><LOCATION DIR='/:M/:' FILE="a.mp3" VOLUME="C:"/><CUE_V2 START="1"/></ENTRY>
  <ENTRY TITLE="b"/>
  <ENTRY TITLE="c"><LOCATION DIR="/:M/:" FILE="c.mp3" VOLUME="C:"></LOCATION></ENTRY></COLLECTION>
<SETS ENTRIES="1"><SET><LOCATION DIR="/:S/:" FILE="s.mp3" VOLUME="C:"/></SET></SETS>
<PLAYLISTS><NODE TYPE="FOLDER" NAME="$ROOT"><SUBNODES COUNT="1"><NODE TYPE="PLAYLIST" NAME="P"><PLAYLIST ENTRIES="2" UUID="u"><ENTRY OWN="1"><PRIMARYKEY TYPE="TRACK" KEY='C:/:M/:a.mp3'/></ENTRY>
<ENTRY><PRIMARYKEY TYPE="STEM" KEY="C:/:M/:c.mp3"/></ENTRY></PLAYLIST></NODE></SUBNODES></NODE></PLAYLISTS><INDEXING><SORTING_INFO PATH="P"/></INDEXING></NML>
"""


def test_nothing_changed_keeps_every_byte():
    for text in (DOC, WILD):
        assert spans.splice(text.encode(), spans.Changes())[0] == text.encode()
        assert cx.patch_references(text, {}, {}) == (text, 0)


def test_both_quotes_and_signs_inside_values():
    out, n = cx.patch_references(WILD, {"C:/:M/:a.mp3": "D:/:it's/:a.mp3"}, {"C:/:M/:a.mp3": ("D:", "d", "/:>/:", "a.mp3")})
    assert n == 2 and "KEY='D:/:it&apos;s/:a.mp3'" in out and "DIR='/:>/:'" in out and 'VOLUMEID="d"' in out and out.startswith(WILD[:120])
    with pytest.raises(cx.PatchError):
        cx.patch_references(WILD, {"none": "x"}, {})
    assert cx.set_entry_attributes('<ENTRY TITLE="b"/>', {"album": "L"}) == '<ENTRY TITLE="b"><ALBUM TITLE="L"></ALBUM></ENTRY>'
    assert cx.set_entry_attributes("<ENTRY TITLE='x > y'></ENTRY>", {"title": "z"}) == "<ENTRY TITLE='z'></ENTRY>"


def test_splice_changes_only_what_is_asked():
    change = spans.Changes(drop={"C:/:M/:c.mp3"}, patches={"C:/:M/:a.mp3": {"album": "L"}}, add=["<ENTRY/>", "<ENTRY/>"], playlists={"P": ["new & key", "C:/:M/:a.mp3", "C:/:M/:a.mp3"]}, nodes=["<NODE/>"])
    out, done = spans.splice(WILD.encode(), change)
    text = out.decode()
    assert done == {"dropped": 1, "patched": 1, "added": 2, "playlists": 1, "nodes": 1}
    assert "ENTRIES='4'" in text and '<ENTRY TITLE="b"/>' in text and "c.mp3\" VOLUME" not in text and '<CUE_V2 START="1"/><ALBUM TITLE="L"></ALBUM></ENTRY>' in text
    assert text.index('KEY="new &amp; key"') < text.index('<ENTRY OWN="1">') and '<PLAYLIST ENTRIES="3" UUID="u">' in text and 'COUNT="2"' in text
    for part in ("<SETS ENTRIES=\"1\">", "STRANGE='x > \"y\"'", "<!-- <LOCATION", "<INDEXING>"):
        assert part in text
    for bad in (spans.Changes(patches={"none": {}}), spans.Changes(playlists={"none": []})):
        with pytest.raises(cx.PatchError):
            spans.splice(WILD.encode(), bad)


def test_ordinals_and_raw_entries(spark, tmp_path):
    found = spans.elements(WILD.encode())
    assert [s.ordinal for s in found if s.tag == "ENTRY"] == [0, 1, 2, 0, 1]
    (tmp_path / "w.nml").write_text(WILD, encoding="utf-8")
    raw = spans.read_raw_entries(spark, str(tmp_path)).orderBy("ord").collect()
    assert [r["key"] for r in raw] == ["C:/:M/:a.mp3", None, "C:/:M/:c.mp3"] and all(r["raw"] in WILD for r in raw)
    assert [r["file"] for r in spans.read_outside_locations(spark, str(tmp_path)).collect()] == ["s.mp3"]


def test_plan_and_write(spark, tmp_path):
    source, target = str(tmp_path / "a.nml"), str(tmp_path / "b.nml")
    (tmp_path / "a.nml").write_text(DOC, encoding="utf-8")
    cols = "kind string, old_key string, new_key string, volume string, volumeid string, dir string, file string"
    rows = spark.createDataFrame([("key", "C:/:M/:a.mp3", "E:/:a.mp3", None, None, None, None)] * 2, cols)
    assert spans.plan_and_write(source, target, spans.patch_plan(rows), dry_run=True) == spans.WriteOutcome(source, target, 2, False) and not (tmp_path / "b.nml").exists()
    assert spans.plan_and_write(source, target, spans.patch_plan(rows)).written and "E:/:a.mp3" in (tmp_path / "b.nml").read_text(encoding="utf-8")
    with pytest.raises(ValueError):
        spans.plan_and_write(source, source, spans.patch_plan(rows))
    with pytest.raises(cx.PatchError):
        spans.patch_plan(rows.unionByName(spark.createDataFrame([("key", "C:/:M/:a.mp3", "F:/:a.mp3", None, None, None, None)], cols)))


def test_list_formats(spark, tmp_path):
    assert lists.parse_m3u(b"#extinf:12 tvg=x,A - T\nx.mp3\n")[0][3:7] == ("A", "T", "", "12.000")
    (tmp_path / "l.m3u8").write_bytes(b"caf\xe9.mp3\n")
    with pytest.raises(Exception, match="not UTF-8"):
        lists.read_input(spark, str(tmp_path / "l.m3u8")).collect()
    (tmp_path / "l.m3u").write_text("#EXTINF:5,A - T\n/m/x/a.mp3\n/m/b.mp3\n")
    with pytest.raises(lists.ListError):
        lists.read_input(spark, str(tmp_path / "l.m3u"), "csv")
    asked = lists.request_records(lists.read_input(spark, str(tmp_path / "l.m3u")))
    disk = spark.createDataFrame([("/:m/:", "b.mp3", "77", "9.5", "Z", "B")], "dir string, file string, filesize string, playtime_float string, artist string, title string")
    got = {r["file"]: (r["artist"], r["filesize"], r["playtime_float"], r["dir"]) for r in lists.index_present(asked, disk).collect()}
    assert got == {"a.mp3": ("A", "", "5.000", "/:m/:x/:"), "b.mp3": ("Z", "77", "9.5", "/:m/:")}
    (tmp_path / "f").mkdir()
    for n in ("10.mp3", "9.MP3", "x.txt"):
        (tmp_path / "f" / n).write_text("")
    assert [r["file"] for r in lists.read_input(spark, str(tmp_path / "f")).orderBy("line_number").collect()] == ["9.MP3", "10.mp3"]
