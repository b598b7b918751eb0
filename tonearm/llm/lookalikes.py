"""Text that only looks like its plain form, brought to one consistent form.

A value with a suspicious character is mapped by tables in SQL: ordinary width, spaces and
hyphens, and, where a word mixes alphabets, look-alike letters to one shape. Mapped values
are grouped under the accent-sensitive Unicode collation, which takes composed and combining
accents and invisible characters as equal. The canonical member of a class is, of all clean
values of the corpus in it, the most frequent one (then the first by code points); a class
without a clean member takes the form that most of its cells would get if each were put right
by itself. It is joined back to the cells.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonearm.llm import mojibake
from tonearm.session import cut, store

#: Letters of other alphabets and the Latin letters they look like.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХҮԌԚԜаеѕіјорсухһԁԛԝӏ", "ABESIJKMHOPCTYXYGQWaesijopcyxhdqwl", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορυϲ", "ABEZHIKMNOPTYXaikvopuc", strict=True))
#: Latin letters that are drawn like a plain one.
LATIN = {"ɡ": "g", "ɑ": "a", "ı": "i"}
LATIN_ALWAYS = {"ɡ": "g"}
#: Characters drawn like a hyphen, and blank letters that show nothing.
HYPHENS = "‐‑⁃−﹣"
BLANKS = "ᅟᅠㅤﾠ"
#: Forms that show the same letters as their parts: Roman numerals and ligatures.
COMPOUND = (0x2160, 0x217F), (0xFB00, 0xFB06)
ALPHABETS = {"LATIN": {}, "CYRILLIC": CYRILLIC, "GREEK": GREEK}

#: What may need mapping. Anything else is already in its consistent form.
SUSPICIOUS = (
    r"[\p{M}\p{Cf}\p{Co}\x{2010}\x{2011}\x{2043}\x{2212}\x{115F}\x{1160}\x{3164}\x{FE63}\x{FF01}-\x{FFE6}\x{212A}\x{212B}\x{2126}\x{261}\x{2160}-\x{217F}\x{FB00}-\x{FB06}]"
    r"|[\p{Zs}&&[^ ]]"
    r"|\p{IsLatin}[\p{IsCyrillic}\p{IsGreek}]|[\p{IsCyrillic}\p{IsGreek}]\p{IsLatin}|\p{IsCyrillic}\p{IsGreek}|\p{IsGreek}\p{IsCyrillic}"
)
_WORD = re.compile(r"[^\W\d_]+")


def _alphabet(ch: str) -> str | None:
    name = unicodedata.name(ch, "").split(" ")[0]
    return name if name in ALPHABETS else None


def _one_alphabet(match: re.Match) -> str:
    word = match.group().translate(str.maketrans(LATIN_ALWAYS))
    kinds = [_alphabet(ch) for ch in word]
    present = {k for k in kinds if k}
    if len(present) < 2:
        return word
    # Letters that have no look-alike elsewhere say which alphabet is meant; then the majority does.
    latin_shapes = {*CYRILLIC.values()} | {*GREEK.values()}
    sure = lambda ch, k: ch not in ALPHABETS[k] if k != "LATIN" else ch not in latin_shapes
    rank = {k: (sum(1 for ch, c in zip(word, kinds) if c == k and sure(ch, k)), kinds.count(k), k == "LATIN") for k in present}
    target = max(present, key=lambda k: rank[k])
    back = {v: k for k, v in reversed(ALPHABETS[target].items())} if target != "LATIN" else {}
    out = []
    for ch, kind in zip(word, kinds):
        if kind and kind != target:
            latin = ALPHABETS[kind].get(ch, ch if kind == "LATIN" else None)
            new = latin if target == "LATIN" else back.get(latin)
            ch = new or ch
        out.append(ch)
    return "".join(out)


def consistent(text: str) -> str:
    """Ordinary width, spaces and hyphens, nothing invisible, accents composed, one alphabet a word."""
    out = []
    for ch in text:
        code = ord(ch)
        kind = unicodedata.category(ch)
        if kind in ("Cf", "Co") or 0xFE00 <= code <= 0xFE0F or ch in BLANKS:
            continue
        if kind == "Zs":
            ch = " "
        elif ch in HYPHENS:
            ch = "-"
        elif 0xFF01 <= code <= 0xFFE6 or any(a <= code <= b for a, b in COMPOUND):
            ch = unicodedata.normalize("NFKC", ch)
        out.append(ch)
    return _WORD.sub(_one_alphabet, unicodedata.normalize("NFC", "".join(out)))


@F.pandas_udf(T.StringType())
def consistent_udf(values: pd.Series) -> pd.Series:
    return values.map(consistent, na_action="ignore")


def suspicious(value: Column) -> Column:
    return F.coalesce(value.rlike(SUSPICIOUS), F.lit(False))


def _single(pairs: dict[str, str]) -> tuple[str, str]:
    """Arguments of translate for the characters that have one counterpart or none; those without one come last."""
    kept = {k: v for k, v in pairs.items() if len(v) == 1}
    return "".join(kept) + "".join(k for k, v in pairs.items() if not v), "".join(kept.values())


_WIDTH = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in [*range(0xFF01, 0xFFE7), *(c for low, high in COMPOUND for c in range(low, high + 1))]}
_SPACES = {chr(c): " " for c in range(0x3001) if unicodedata.category(chr(c)) == "Zs" and c != 32}
_PLAIN = {**{k: v for k, v in _WIDTH.items() if v != k}, **_SPACES, **{h: "-" for h in HYPHENS}, **{b: "" for b in BLANKS}, **LATIN_ALWAYS}
_SHAPES = {**CYRILLIC, **GREEK, **LATIN}
MIXED = r"\p{IsLatin}[\p{IsCyrillic}\p{IsGreek}]|[\p{IsCyrillic}\p{IsGreek}]\p{IsLatin}|\p{IsCyrillic}\p{IsGreek}|\p{IsGreek}\p{IsCyrillic}"


def _plain(value: Column) -> Column:
    """Ordinary width, spaces and hyphens; private and blank characters are gone."""
    for many, few in _PLAIN.items():
        if len(few) > 1:
            value = F.replace(value, F.lit(many), F.lit(few))
    return F.regexp_replace(F.translate(value, *_single(_PLAIN)), r"[\p{Co}\x{FE00}-\x{FE0F}]", "")


def shape(value: Column) -> Column:
    """Letters of all alphabets drawn alike as one letter."""
    return F.translate(value, *_single(_SHAPES))


#: Classes and their canonical members. members: (kind, form, text, clean, n), asked: (value, kind, form).
CLASSES = """
    WITH texts AS (
           SELECT kind, form COLLATE UNICODE AS class, text, bool_or(clean) AS clean, sum(n) AS n
           FROM {members} GROUP BY kind, form COLLATE UNICODE, text),
         classes AS (SELECT kind, class, min(struct(NOT clean, -n, text)).text AS canonical FROM texts GROUP BY kind, class)
    SELECT a.value, c.canonical FROM {asked} a JOIN classes c ON a.kind = c.kind AND a.form COLLATE UNICODE = c.class
"""


def canonical_values(values: DataFrame, odd: DataFrame | None = None) -> DataFrame:
    """(value, canonical) of the distinct suspicious texts of ``values`` (value).

    ``odd`` are its suspicious rows, if they are known already. Null and empty texts belong to no class.
    """
    spark = values.sparkSession
    odd = values.where(suspicious(F.col("value"))) if odd is None else odd
    seen = odd.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    plain = _plain(F.col("value"))
    # Words that mix alphabets stand in a class by shape; all else keeps its letters.
    mixed = F.regexp_replace(plain, r"[\p{M}\p{Cf}]", "").rlike(MIXED)
    asked = seen.select("value", "n", plain.alias("plain"), F.when(mixed, "shape").otherwise("letters").alias("kind"), consistent_udf("value").alias("own"))
    asked = cut(asked.select("value", "n", "kind", "own", F.when(F.col("kind") == "shape", shape(F.col("plain"))).otherwise(F.col("plain")).alias("form")))
    # Clean values of the corpus in these classes; the hashes only thin out what is compared.
    key = lambda kind, text: F.xxhash64(kind, F.when(kind == "shape", shape(text)).otherwise(text))
    wanted = store(asked.select(key(F.col("kind"), F.col("own")).alias("h")).distinct())
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), key(F.lit(k), F.col("value")).alias("h")) for k in ("letters", "shape")]))
    clean = values.where("value is not null").select("value", kinds.alias("k")).select("value", "k.kind", "k.h").join(wanted, "h", "left_semi")
    clean = clean.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n")).where(~suspicious(F.col("value")))
    clean = clean.select("kind", F.when(F.col("kind") == "shape", shape(F.col("value"))).otherwise(F.col("value")).alias("form"), F.col("value").alias("text"), F.lit(True).alias("clean"), "n")
    members = asked.select("kind", "form", F.col("own").alias("text"), (F.col("own") == F.col("value")).alias("clean"), "n").unionByName(clean)
    return spark.sql(CLASSES, members=members, asked=asked.select("value", "kind", "form"))


def changed_cells(records: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id_col, field_name, value, canonical) of the cells whose text changes."""
    cells = records.select(
        id_col, F.inline(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields]))
    )
    odd = store(cells.where(suspicious(F.col("value"))))
    return odd.join(canonical_values(cells.select("value"), odd.select("value")).where("canonical <> value"), "value")


def library_lookalikes(tracks: DataFrame, artists: DataFrame) -> DataFrame:
    """Cells of title, file_name and dir_value that only look like their consistent form.

    File names that are garbled by a wrong decoding are left to that operator.
    """
    cells = cut(changed_cells(tracks, "entry_id", ["title", "file_name", "dir_value"]))
    named = cells.where("field_name = 'file_name'").select("entry_id", "value")
    garbled = mojibake.garbled_rows([("tracks", named)], mojibake.library_words(tracks, artists))
    garbled = garbled.select(F.col("row_id").alias("entry_id"), F.lit("file_name").alias("field_name"))
    return cells.join(garbled, ["entry_id", "field_name"], "left_anti")
