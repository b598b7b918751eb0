import pytest
from pyspark.sql import functions as F

from tonearm.functions import folding, numbers, paths, text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("value", ["Straße", "ΟΔΟΣ", "ıI", "K", "É", "", "ﬁn", None])
def test_casefold(spark, value):
    assert one(spark, value, paths.casefold) == (None if value is None else value.casefold())


def test_paths(spark):
    assert one(spark, "/:A/:B b/:./:", paths.decode_dir) == "A/B b"
    assert one(spark, "", paths.encode_dir) == "/:/:"
    assert one(spark, "A\\B/C", paths.encode_dir) == "/:A/:B/:C/:"
    assert one(spark, "/:A/:B", paths.normalize_prefix) == "/:A/:B/:"
    assert one(spark, "Music/x", paths.normalize_prefix) == "/:Music/:x/:"
    assert tuple(one(spark, "C:/:Music/:a.mp3", paths.parse_key)) == ("C:", "/:Music/:", "a.mp3")
    assert tuple(one(spark, "C:/:f.mp3", paths.parse_key)) == ("C:", "/:", "f.mp3")
    assert one(spark, "nokey", paths.parse_key) is None
    assert one(spark, "Song.stem.m4a", paths.bare_name) == "song"
    assert one(spark, ".mp3", paths.bare_name) is None


def test_numbers(spark):
    for value, want in [("12.5", 12.5), (" 3 ", 3.0), ("nan", None), ("inf", None), ("1e400", None), ("12d", None), ("", None), (None, None)]:
        assert one(spark, value, numbers.number) == want
    for value, want in [("75", "75.000"), ("1:05", "65.000"), ("1:01:01", "3661.000"), ("0", ""), ("x", ""), (None, "")]:
        assert one(spark, value, numbers.parse_duration) == want
    band = lambda a, b: spark.range(1).select(numbers.beyond(numbers.exact(F.lit(a)), numbers.exact(F.lit(b)), "0.01").alias("r")).first()["r"]
    assert not band("59.4", "60.0") and band("59.3", "60.0")
    assert one(spark, "245.9", numbers.show_time) == "4:05"
    assert one(spark, "320000", numbers.show_bitrate) == "320 kbps"
    assert one(spark, "2500", numbers.show_bitrate) == "2 kbps"


def test_text(spark):
    assert tuple(one(spark, " 12 - A b - T - u ", text.parse_line)) == ("track", "A b", "T - u")
    assert one(spark, "# x", text.parse_line)["kind"] == "skip"
    assert one(spark, "only title", text.parse_line)["kind"] == "unparseable"
    assert one(spark, None, text.parse_line)["kind"] == "skip"
    assert tuple(one(spark, "#EXTINF:123,A - T", text.parse_extinf)) == ("123.000", "A", "T")
    assert tuple(one(spark, "#EXTINF:-1,name", text.parse_extinf)) == ("", "", "")
    assert one(spark, "07_Name_x.mp3", text.file_label) == "Name x"
    assert sorted(one(spark, "The Éclair Mix feat Zoë", text.tokens)) == ["eclair", "zoe"]
    names = ["10 b", "9 b", "a2", "a10", "A1"]
    df = spark.createDataFrame([(n,) for n in names], "v string").orderBy(text.natural_key(F.col("v")))
    assert [r["v"] for r in df.collect()] == ["9 b", "10 b", "A1", "a2", "a10"]
    raw = 'a&b<c"d\te'
    assert one(spark, raw, lambda c: text.xml_unescape(text.xml_escape(c))) == raw
    assert one(spark, "Ｄｊ Řé​x", folding.fold) == "dj rex"


def test_normalise_matches_the_plain_version(spark):
    for v in ["Éa  B!", "ÅÄÖ ß", "x_y-z", "Ω only", ""]:
        assert one(spark, v, text.normalise) == text.normalise_py(v)
