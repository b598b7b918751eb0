"""Text garbled by a wrong character decoding: found and restored.

Every distinct clean word of the corpus is sent through all encoding chains, which gives
a table of garbled forms. Tokens of the checked text are hash-joined with it and replaced
by the word. The same table holds the distinct characters of the clean corpus as words of
length one, so a word that nowhere stands in clean form is still recognised: the chain
that explains each of its parts is undone and the result verified by going forward again.
"""

from __future__ import annotations

import codecs
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonearm.session import cut

#: Single-byte code pages text is wrongly read in, and the encodings it was written in.
READ_AS = ["cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "cp1253", "cp866", "koi8-r"]
WRITTEN_IN = ["cp1252", "cp1250", "cp1251", "cp1253", "koi8-r", "cp866", "cp437", "cp850", "mac_roman", "shift_jis", "euc_jp"]
TWICE = ["cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman"]
LOST = "�"
#: Letters of other alphabets and the Latin ones they are drawn like.
LOOKALIKES = ("АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁӏΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορυɡ", "ABESIJKMHOPCTYXaesijopcyxhdlABEZHIKMNOPTYXaikvopug")
#: Characters between tokens. Others of ASCII can be second bytes of an East Asian encoding.
SEPARATORS = r" _\-.,()&'#;:!?\"/+*=<>"
TOKEN = rf"[^{SEPARATORS}]*[^\x00-\x7f{SEPARATORS}][^{SEPARATORS}]*"


def _table(page: str) -> str:
    """The 256 characters of a page; a byte it leaves undefined stays as control character."""
    return "".join(bytes([b]).decode(page, "replace").replace(LOST, chr(b)) for b in range(256))


_TABLES = {page: _table(page) for page in READ_AS}
_BACK = {page: {ch: b for b, ch in reversed(list(enumerate(t)))} for page, t in _TABLES.items()}
CHAINS = (
    [("utf-8", d) for d in READ_AS]
    + [(e, d) for e in WRITTEN_IN for d in READ_AS if e != d]
    + [("utf-8", d, "utf-8", d) for d in TWICE]
    + [(e, "utf-8") for e in ("cp1252", "cp1250", "cp1251", "mac_roman", "shift_jis")]
)


def garble(word: str, chain: tuple[str, ...]) -> str | None:
    """``word`` sent through the chain (written in, read as, ...); None where it cannot be."""
    try:
        for written, read in zip(chain[::2], chain[1::2], strict=True):
            raw = word.encode(written)
            word = raw.decode("utf-8", "replace") if read == "utf-8" else codecs.charmap_decode(raw, "strict", _TABLES[read])[0]
    except UnicodeError:
        return None
    return word


def ungarble(token: str, chain: tuple[str, ...]) -> str | None:
    """The text that the chain turns into ``token``, or None."""
    text = token
    try:
        for written, read in reversed(list(zip(chain[::2], chain[1::2], strict=True))):
            back = _BACK.get(read)
            if back is None or any(ch not in back for ch in text):
                return None
            text = bytes(back[ch] for ch in text).decode(written)
    except UnicodeError:
        return None
    return text if text != token and garble(text, chain) == token else None


_FORMS = T.ArrayType(T.StructType([T.StructField("form", T.StringType()), T.StructField("chain", T.IntegerType())]))


@F.pandas_udf(_FORMS)
def garbled_forms(words: pd.Series) -> pd.Series:
    """All distinct garbled forms of each word, with the first chain that gives each."""

    def one(word: str) -> list[tuple[str, int]]:
        out: dict[str, int] = {}
        for i, chain in enumerate(CHAINS):
            form = garble(word, chain)
            if form is not None and form != word:
                out.setdefault(form, i)
        return list(out.items())

    return words.map(one)


#: Rows that one task of a table of forms writes, about.
FORM_ROWS = 60_000


def spread(rows: DataFrame, growth: int) -> DataFrame:
    """Written ``rows`` dealt out by what they grow to: a short list that becomes a long table is no work for one task."""
    return rows.repartition(max(1, -(-rows.count() * growth // FORM_ROWS)))


def tokens(text: Column) -> Column:
    """The tokens of a text that hold a character beyond ASCII, repeats once; null gives none."""
    return F.array_distinct(F.coalesce(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>")))


def clean_words(columns: list[DataFrame]) -> DataFrame:
    """(word) distinct non-ASCII tokens of columns that were never decoded wrongly."""
    words = None
    for one in columns:
        found = one.toDF("text").where(F.col("text").rlike(r"[^\x00-\x7f]")).distinct().select(F.explode(tokens(F.col("text"))).alias("word"))
        words = found if words is None else words.unionByName(found)
    return words.distinct()


def _explain(alphabet: frozenset[str], telling: dict[str, str]):
    """Pandas function: (token) -> (token, original) for tokens that the character forms explain."""
    multi = [c for c in CHAINS if c[0] in ("utf-8", "shift_jis", "euc_jp") and c[1] != "utf-8"]
    multi.sort(key=lambda c: -len(c))
    runs = re.compile(r"[^\x00-\x7f]+")

    def original(token: str) -> tuple[bool, str | None]:
        for chain in multi:
            whole = ungarble(token, chain)
            if whole is not None and all(ch < "\x80" or ch in alphabet for ch in whole):
                return True, whole
        for chain in multi:
            if chain[0] != "utf-8":
                continue
            done, hit = [], False
            for part in re.split(r"([^\x00-\x7f]+)", token):
                if not runs.fullmatch(part):
                    done.append(part)
                    continue
                got = ungarble(part, chain)
                if got is None or not all(ch in alphabet for ch in got):
                    done = None
                    break
                done.append(got)
                hit = True
            if done is not None and hit:
                return True, "".join(done)
        # One foreign letter in a word of one alphabet is no sign; a symbol or a mixture is.
        latin = any("a" <= ch.lower() <= "z" for ch in token)
        odd = lambda ch: ch in telling and (not ch.isalpha() or (latin and not unicodedata.name(ch, "LATIN").startswith("LATIN")))
        return any(odd(ch) for ch in token), None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(t, *original(t)) for t in pdf["token"]]
            yield pd.DataFrame([(t, o) for t, hit, o in found if hit], columns=["token", "original"])

    return run


def garbled_tokens(texts: DataFrame, words: DataFrame) -> DataFrame:
    """(token, original) of the distinct tokens of ``texts`` (text) that are garbled.

    original is null where the text cannot be restored: bytes were lost, or several words
    have the same garbled form and none is clearly meant. Null and empty texts have no tokens.
    """
    spark = texts.sparkSession
    words = spread(cut(words), len(CHAINS))
    unknown = (
        texts.where(F.col("text").rlike(r"[^\x00-\x7f]"))
        .select(F.explode(tokens(F.col("text"))).alias("token"))
        .distinct()
        .join(words, F.col("token") == F.col("word"), "left_anti")
    )
    # A token that look-alike letters alone set apart from a plain word is not garbled.
    skeleton = F.translate("token", *LOOKALIKES)
    unknown = unknown.where(~(skeleton.rlike(r"^[\x00-\x7f]*$") & F.col("token").rlike("[A-Za-z]")))
    unknown = cut(unknown.join(words.select(F.col("word").alias("plain")), (skeleton == F.col("plain")) & (skeleton != F.col("token")), "left_anti"))
    forms = words.select("word", F.inline(garbled_forms("word")))
    # Chains stand in the order of how common they are. A word is clearly meant if no other has the form under the
    # commonest chain that gives it; where bytes were lost, under any chain.
    by_word = (
        unknown.join(forms, unknown.token == forms.form)
        .groupBy("token", "chain")
        .agg(F.min("word").alias("word"), F.max("word").alias("other"))
        .groupBy("token")
        .agg(F.min(F.struct("chain", "word", "other")).alias("best"), F.min("word").alias("low"), F.max("other").alias("high"))
        .select("token", F.when((F.col("best.word") == F.col("best.other")) & (~F.col("token").contains(LOST) | (F.col("low") == F.col("high"))), F.col("best.word")).alias("original"))
    )
    by_word = cut(by_word)
    # The alphabet of the clean words: its size is bounded by Unicode, not by the data.
    letters = words.select(F.explode(F.split("word", "")).alias("ch")).where(F.col("ch") > "\x7f").groupBy("ch").count()
    alphabet = frozenset(r["ch"] for r in letters.collect())
    telling = {}
    for ch in alphabet:
        for chain in CHAINS:
            form = garble(ch, chain)
            for g in form or "":
                if g > "\x7f" and g not in alphabet:
                    telling.setdefault(g, ch)
    explain = _explain(alphabet, telling)
    rest = cut(unknown.join(by_word.select("token"), "token", "left_anti"))
    by_char = rest.mapInPandas(explain, "token string, original string") if not rest.isEmpty() else spark.createDataFrame([], "token string, original string")
    return by_word.unionByName(by_char)


def garbled_rows(sources: list[tuple[str, DataFrame]], words: DataFrame) -> DataFrame:
    """(source_table, row_id, text, restored) of the rows of ``sources`` ((name, (row_id, text)), ...)
    with a garbled token. restored is the text with every garbled token replaced, null where one
    cannot be. Rows with a null id are kept."""
    texts = None
    for name, one in sources:
        part = one.toDF("row_id", "text").select(F.lit(name).alias("source_table"), "row_id", "text")
        texts = part if texts is None else texts.unionByName(part)
    texts = texts.where(F.col("text").rlike(r"[^\x00-\x7f]"))
    bad = garbled_tokens(texts.select("text"), words)
    hits = (
        texts.withColumn("token", F.explode(tokens(F.col("text"))))
        .join(bad, "token")
        .groupBy("source_table", "row_id", "text")
        .agg(F.sort_array(F.collect_set(F.struct((-F.length("token")).alias("n"), "token", "original"))).alias("swaps"))
    )
    swapped = F.aggregate("swaps", F.col("text"), lambda text, s: F.replace(text, s["token"], s["original"]))
    return hits.select("source_table", "row_id", "text", swapped.alias("restored"))


def library_words(tracks: DataFrame, artists: DataFrame) -> DataFrame:
    return clean_words([tracks.select(c) for c in ("title", "artist", "album", "dir_value")] + [artists.select("artist_name")])


def library_garbled(tracks: DataFrame, request_lines: DataFrame, artists: DataFrame) -> DataFrame:
    """Garbled file names of tracks and raw lines of requests, with the restored text."""
    return garbled_rows(
        [("tracks", tracks.select("entry_id", "file_name")), ("request_lines", request_lines.select("line_id", "raw_text"))],
        library_words(tracks, artists),
    )
