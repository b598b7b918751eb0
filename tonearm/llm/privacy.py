"""Personal details in free text: found and replaced by typed placeholders.

Pieces whose shape is certain (mail, formatted telephone and identity numbers) are protected
entities. Everything else is judged by corpus co-occurrence: bare numbers by how often the
word before them leads to a certain number, streets by how often what follows them stands
where entities are, names by the words in them and around them. A term discloses when it
raises the odds of a protected entity beside it by enough bits; estimates are smoothed towards
the corpus at large, so few witnesses tell little and the same rule holds at every size.
The kind that takes the place of a piece is its generalisation.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonearm.session import store

#: Bits of odds by which a term must raise the chance of a protected entity beside it to disclose; below these it may be
#: a common word; and by which what follows a street must lower it to make a title of it.
DISCLOSURE_BITS, COMMON_BITS, TITLE_BITS = 5.2, 3.0, 1.5
#: Witnesses that the corpus at large counts for in the estimate of a term, and witnesses against it that a word must
#: outweigh to be called common.
PRIOR, DOUBT = 1.0, 4.0
#: Characters within which a protected entity stands beside a candidate.
REACH = 110

_UP = "".join(chr(c) for c in range(0x250) if chr(c).isupper()) + "Α-ΩΆ-ΏА-Я"
_CAP = rf"[{_UP}][^\W\d_]+(?:['’-][^\W\d_]+)?"
_TLD = r"(?:[A-Za-z]{2,12})"
_ENDING = r"(?:example|invalid|test|com|net|org|info|de|fr|es|uk)\b"
_AT = r"(?:[\[({] ?at ?[\])}]| at |\(@\)|\[@\])"
_DOT = r"(?:[\[({] ?dot ?[\])}]| dot )"
#: A mail address from its @ on, and a disguised one from its spelled one on.
HOST = re.compile(r"@(?:[A-Za-z0-9-]+\.)+" + _TLD + r"(?![\w@])")
SPELLED_HOST = re.compile(
    _AT + rf" ?[\w-]+(?: ?(?:{_DOT}|\.) ?[\w-]+)*? ?"
    # Any ending behind a spelled dot, else a listed one; an ending that goes on is none.
    rf"(?:{_DOT} ?[A-Za-z]{{2,12}}\b|\. ?{_ENDING})(?! ?{_DOT} ?[A-Za-z]{{2}}|\.{_ENDING})",
    re.I,
)
MARK = re.compile(_AT + "|@", re.I)
_LOCAL = re.compile(r"\w[\w.+-]*$")
_SPELLED_LOCAL = re.compile(r"\w[\w.+-]* ?$")
NUMBER = re.compile(r"\d(?:(?:[ ./-]|\)[ -]?| ?\()?\d){5,16}")
_BEFORE = re.compile(r"(?:\b[A-Z]{1,2} ?|[+(])$")
_AFTER = re.compile(r"(?: ?[A-Z]\b)")
#: Formats of identity numbers.
IDENTITY = re.compile(r"\d{3}-\d\d-\d{4}|\d{3} \d\d \d{4}|[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]|[KLMXYZ]\d{7}[A-Z]|\d{8}[A-Z]|[A-Z]\d{8}|\d\d\.\d\d\.\d\d-\d{3}\.\d\d|\d{6}[-+A]\d{3}[0-9A-Z]")
#: Formats of telephone numbers.
TELEPHONE = re.compile(
    r"(?:\+|00)[1-9]\d{0,2}[ .()-]?(?:\(0\))?[\d .()/-]{7,15}\d|\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}|1?[2-9]\d\d[2-9]\d{6}|1[ .-]?\(?[2-9]\d\d\)?[ .-]?\d{3}[ .-]?\d{4}"
    r"|0\d(?:[ .-]\d\d){4}|0\d{9,10}|\(?0\d{2,4}\)?[ /-]\d{3,5}[ -]?\d{3,5}|44[1-9]\d{9}|33[1-9]\d{8}|49[1-9]\d{8,10}"
)
LABELLED = re.compile(r"(?:serial|checksum|sn|isrc|order|invoice|ticket|catalogue|number|ref\.? no)[ :#]*$", re.I)
_KINDS_EN = "Street|Avenue|Ave|Lane|Ln|Road|Rd|St|Blvd|Terrace|Close|Drive|Court|Way|Square|Place|Crescent|Hill|Gardens|Row|Mews|Grove|Parade"
#: Patterns of a street with its house number, each behind the words one of which must stand in the text.
STREETS = [
    (tuple(_KINDS_EN.split("|")), re.compile(rf"(?<![\w/.-])\d{{1,4}} ?[A-Za-z]?(?: bis| ter)?,? (?:{_CAP} ){{1,2}}(?:{_KINDS_EN})\b")),
    (
        ("rue ", "avenue ", "boulevard ", "place ", "chemin ", "impasse ", "quai ", "allée ", "cours ", "passage "),
        re.compile(rf"(?<![\w/.-])\d{{1,4}}(?: ?[A-Za-z]\b)?(?: bis| ter)?,? (?:rue|avenue|boulevard|place|chemin|impasse|quai|allée|cours|passage) (?:de la |de l['’]|du |des |de |d['’])?{_CAP}(?: {_CAP})?"),
    ),
    (
        ("Calle ", "Avenida ", "Plaza ", "Paseo ", "Camino ", "Ronda ", "Travesía "),
        re.compile(rf"\b(?:Calle|Avenida|Plaza|Paseo|Camino|Ronda|Travesía) (?:de la |del |de |los |las )?{_CAP}(?: {_CAP})?,? (?:n\.º )?\d{{1,4}}(?: ?[A-Za-z]\b)?"),
    ),
    (
        ("Am ", "Im ", "An der ", "An den ", "Auf dem ", "Auf der ", "Zum ", "Zur "),
        re.compile(rf"(?<!\w)(?:Am|Im|An de[rn]|Auf de[mr]|Zum|Zur) {_CAP} \d{{1,4}}(?: ?[a-z]\b)?"),
    ),
    (
        ("straße ", "strasse ", "weg ", "platz ", "gasse ", "allee ", "ring ", "ufer ", "damm ", "Straße ", "Strasse ", "Weg ", "Platz ", "Gasse ", "Allee ", "Ring ", "Ufer ", "Damm "),
        re.compile(rf"(?<!\w){_CAP}(?:[- ](?:Straße|Strasse|Weg|Platz|Gasse|Allee|Ring|Ufer|Damm)|(?<=straße)|(?<=strasse)|(?<=weg)|(?<=platz)|(?<=gasse)|(?<=allee)|(?<=ring)|(?<=ufer)|(?<=damm)) \d{{1,4}}(?: ?[a-z]\b)?"),
    ),
]
NAME = re.compile(rf"(?<![\w/:.@_-])(?:[{_UP}]\. {_CAP}(?! {_CAP})|{_CAP}(?: [{_UP}]\.(?= {_CAP})| {_CAP}){{1,4}}|(?<!\d )(?<!\d){_CAP}, {_CAP}(?: [{_UP}]\.(?! {_CAP}))?(?! [{_UP}]))(?![\w@]|[/:_]\w)")
#: Words of a street that are no part of its own name.
STREET_WORDS = {w.lower() for w in _KINDS_EN.split("|")} | set(
    "rue avenue boulevard place chemin impasse quai allee cours passage bis ter calle avenida plaza paseo camino ronda travesia straße strasse weg platz gasse allee ring ufer damm am im an der den auf dem zum zur del las los de la du des".split()
)
#: Words that start a sentence or label a field and are no part of a name.
STARTERS = {
    "the", "when", "between", "best", "still", "oddly", "and", "at", "if", "after", "in", "on", "for", "from", "ask", "call", "dear", "hi", "hello", "thanks", "regards", "update", "someone",
    "nobody", "please", "my", "our", "club", "last", "then", "im", "am", "en", "au", "auf", "sur", "die", "der", "das", "nach", "le", "la", "el", "los", "ausweis", "dni", "tel", "customer",
    "reporter", "account", "holder", "invoice", "rechnung", "bitte", "according", "because", "although", "with", "by", "to", "of", "zwischen", "entre", "avec", "con", "mit", "als", "wenn", "cuando", "quand", "as", "since", "while", "love", "yours", "cheers", "sincerely",
}
#: Forms of address, which are no part of a name.
ADDRESS_FORMS = {"mr", "mrs", "ms", "miss", "dr", "herr", "frau", "monsieur", "madame", "señor", "señora", "sr", "sra", "mme", "don", "doña", "prof"}

HEADS = ADDRESS_FORMS | STARTERS


def fold(text: str) -> list[str]:
    if not text.isascii():
        text = "".join(ch for ch in unicodedata.normalize("NFD", text) if not unicodedata.combining(ch))
    text = text.lower()
    return [w for w in re.findall(r"[^\W_]+", text) if w != "the"]


def mails(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of mail addresses, disguised ones too."""
    out, done = [], 0
    for m in MARK.finditer(text):
        spelled = len(m.group()) > 1
        host = (SPELLED_HOST if spelled else HOST).match(text, m.start())
        if host:
            at = m.start()
            low = max(done, at - 80)
            local = (_SPELLED_LOCAL if spelled else _LOCAL).search(text[low:at])
            if local and not (low + local.start() and text[low + local.start() - 1] in ".+-"):
                out.append((low + local.start(), host.end(), "email"))
                done = host.end()
    return out


def certain(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of mail addresses, telephone and identity numbers."""
    found = mails(text)
    for m in NUMBER.finditer(text):
        a, b = m.span()
        if a and (text[a - 1] in "@_#/:" or (text[a - 1] in ".-" and text[a - 2 : a - 1].isalnum())) or text[b : b + 1] in ("_", "@", ":"):
            continue
        before, after = _BEFORE.search(text[max(0, a - 3) : a]), _AFTER.match(text[b : b + 2])
        low, high = a - len(before.group()) if before else a, b + len(after.group()) if after else b
        if low and before and before.group()[0].isalpha() and text[low - 1].isalnum():
            low = a
        for x, y in ((low, high), (a, high), (low, b), (a, b)):
            piece = text[x:y]
            if piece.count("(") != piece.count(")"):
                continue
            if (y == b and text[y : y + 1].isalnum()) or (x == a and text[x - 1 : x].isalnum()):
                continue
            kind = "id_number" if IDENTITY.fullmatch(piece) else "phone" if TELEPHONE.fullmatch(piece) else None
            if kind and not (kind == "phone" and piece[0] not in "+0(" and LABELLED.search(text[max(0, x - 14) : x])):
                found.append((x, y, kind))
                break
    return [f for f in found if f[2] == "email" or not any(g[2] == "email" and g[0] < f[1] and f[0] < g[1] for g in found)]


def _lead(text: str, a: int) -> str:
    """The word or mark before a number."""
    before = text[max(0, a - 24) : a].rsplit("\n", 1)[-1].lower()
    words = _LEAD.findall(before)
    return words[-1] if words else "^"


_LEAD = re.compile(r"[^\W\d_]+|[^\w\s]")


def _cue(text: str, a: int, b: int) -> str:
    """The two words before and the word or mark after a piece, digits as 0."""
    before = text[max(0, a - 40) : a]
    if "\n" in before:
        before = before[before.rfind("\n") + 1 :]
    ends = [m.end() for m in _SENTENCE_END.finditer(before)] if "." in before or ">" in before or "!" in before or "?" in before or ";" in before else None
    left = ["^", *(before[ends[-1] :] if ends else before).split()] if ends or len(before) < min(40, a) or a < 40 else before.split()
    after = text[b : b + 24].split("\n", 1)[0]
    right = after[:1] if after[:1] != " " else after.split(" ", 2)[1].rstrip(".,;:")
    return (" ".join(left[-2:]) + "|" + right).lower().translate(_DIGITS)


_SENTENCE_END = re.compile(r"[^\W_]{2}[.!?;>] +|> *")
_DIGITS = str.maketrans("123456789", "000000000")


def pieces(text: str, known: dict[str, str]) -> list[tuple[int, int, str, str, str, str, bool, str]]:
    """(start, end, kind, piece, cue, words, beside a protected entity, what follows a street beside it) of all candidates of a text."""
    # A number without any sign or space may be another's than a telephone.
    numbers = [(a, b, "bare" if k == "phone" and text[a:b].isdigit() else k) for a, b, k in certain(text)]
    sure = [x for x in numbers if x[2] != "bare"]
    out = [(a, b, k, text[a:b], _lead(text, a) if k == "phone" else "", "", True, "") for a, b, k in sure]
    streets = [m.span() for marks, pattern in STREETS if any(k in text for k in marks) for m in pattern.finditer(text)]
    spots = sorted([(a, b) for a, b, _ in sure])

    def beside(a: int, b: int, marks: list[tuple[int, int]]) -> bool:
        for x, y in marks:
            if x > b + REACH:
                break
            if y < a - REACH or (x < b and a < y):
                continue
            between = text[b:x] if x >= b else text[y:a]
            if "\n" not in between and not re.search(r"[^\W\d_]{2}[.!?] +[A-Z]", between):
                return True
        return False

    for a, b, k in numbers:
        if k == "bare":
            out.append((a, b, k, text[a:b], _lead(text, a), "", beside(a, b, spots), ""))
    lanes = []
    for a, b in streets:
        if not any(x < b and a < y for x, y in spots):
            cue = _cue(text, a, b)
            lanes.append((a, b, cue.rsplit("|", 1)[1]))
            own = " ".join(w for w in fold(text[a:b]) if w.isalpha() and len(w) > 2 and w not in STREET_WORDS)
            out.append((a, b, "street_address", text[a:b], cue, own, beside(a, b, spots), ""))
    taken = sorted([(a, b) for a, b, _ in numbers] + streets)
    at = 0
    for m in NAME.finditer(text):
        a, b = m.span()
        # Names come from left to right: what ends before this one is done with.
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        name = m.group()
        while True:
            head, _, rest = name.partition(" ")
            if rest and head.rstrip(".,").lower() in HEADS:
                a, name = a + len(head) + 1, rest
            else:
                break
        if " " not in name and a > m.start():
            # What is left of a label is one word: the name may be turned round after it.
            again = NAME.match(text, a)
            if again:
                b, name = again.end(), again.group()
        if " " not in name or (at < len(taken) and any(x < b and a < y for x, y in taken[at:])):
            continue
        words = known.get(name)
        if words is None:
            words = tuple(fold(name))
            plain = len([w for w in name.split(" ") if not w.endswith(".")]) > 2
            words = known[name] = "" if plain or name.isupper() or words[-1] in STARTERS else " ".join(words)
        if words:
            lane = next((f for x, y, f in lanes if beside(a, b, [(x, y)])), "") if lanes else ""
            out.append((a, b, "person_name", name, _cue(text, a, b), words, bool(spots) and beside(a, b, spots), lane))
    return out


@F.pandas_udf(T.StringType())
def folded(names: pd.Series) -> pd.Series:
    return names.map(lambda n: " ".join(fold(n)), na_action="ignore")


def candidates(documents: DataFrame, artists: DataFrame) -> DataFrame:
    """(doc_id, pii_kind, matched_text, cue, words, beside, lane): every candidate piece of every text, performers of the list left out."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            known: dict[str, str] = {}
            rows = [(i, *p) for i, t in zip(pdf["doc_id"], pdf["text"], strict=True) for p in dict.fromkeys(x[2:] for x in pieces(t, known))]
            yield pd.DataFrame(rows, columns=["doc_id", "pii_kind", "matched_text", "cue", "words", "beside", "lane"])

    schema = "doc_id bigint, pii_kind string, matched_text string, cue string, words string, beside boolean, lane string"
    found = documents.select("doc_id", "text").where("text is not null and doc_id is not null").mapInPandas(scan, schema)
    performers = store(artists.select(folded("artist_name").alias("performer")).where("performer is not null").distinct())
    found = found.join(performers, (F.col("words") == F.col("performer")) & (F.col("pii_kind") == "person_name"), "left_anti")
    return found.withColumn("words", F.filter(F.split("words", " "), lambda w: F.length(w) > 1)).where((F.col("pii_kind") != "person_name") | (F.size("words") > 0))


def _bits(hits: Column, n: Column, base: float) -> Column:
    """Bits by which a term with ``hits`` of ``n`` witnesses raises the odds of the corpus at large (``base``)."""
    p = (hits + PRIOR * base) / (n + PRIOR)
    return F.log2(p / (1 - p)) - math.log2(base / (1 - base))


def _discloses(base: float) -> Column:
    """Whether a term with ``hits`` of ``n`` witnesses discloses: by its bits, or because an entity is beside it more often than not."""
    return (F.col("bits") >= DISCLOSURE_BITS) | (F.col("hits") + PRIOR * base > (F.col("n") + PRIOR) / 2)


def _plain() -> Column:
    """Share of the uses of a word in which no entity is beside it, against doubters."""
    return (F.col("n") - F.col("hits")) / (F.col("n") + DOUBT)


def _base(hits: int | None, n: int) -> float:
    """Share of the corpus at large, never quite 0 or 1."""
    return ((hits or 0) + 0.5) / (n + 1.0)


def disclosed(found: DataFrame) -> DataFrame:
    """The rows of ``found`` that disclose a person: certain shapes, and candidates by the terms around and inside them."""
    row = ["doc_id", "pii_kind", "matched_text"]
    sure = found.where("pii_kind in ('email', 'phone', 'id_number')").select(*row)
    # A bare number is a telephone's where the word before it leads to formatted ones at least as often, or an entity is beside it.
    bare = found.where("pii_kind = 'bare'")
    leads = found.where("pii_kind in ('phone', 'bare')").groupBy("cue").agg(F.count_if(F.col("pii_kind") == "phone").alias("formed"), F.count_if(F.col("pii_kind") == "bare").alias("plain"))
    phones = bare.join(leads, "cue").where(F.col("beside") | (F.col("formed") >= F.col("plain"))).select("doc_id", F.lit("phone").alias("pii_kind"), "matched_text")

    streets = found.where("pii_kind = 'street_address'").withColumn("lane", F.element_at(F.split("cue", r"\|"), -1))
    every = found.where("pii_kind = 'person_name'")
    flag = F.col("beside").cast("int")
    totals = found.where("pii_kind in ('street_address', 'person_name')").groupBy("pii_kind").agg(F.count(F.lit(1)).alias("n"), F.sum(flag).alias("hits"))
    totals = {r["pii_kind"]: _base(r["hits"], r["n"]) for r in totals.collect()}
    base = totals.get("person_name", 0.5)
    # A street that is spoken of like a title stands where no entities are: what follows it tells.
    follows = streets.groupBy("lane").agg(F.count(F.lit(1)).alias("n"), F.sum(flag).alias("hits"))
    bits = _bits(F.col("hits"), F.col("n"), totals.get("street_address", 0.5))
    follows = follows.select("lane", ((bits > -TITLE_BITS) | (F.col("lane") == "")).alias("home"))
    lived = follows.where("home and lane <> ''").select("lane", F.lit(True).alias("lived"))
    # Only few names have a street beside them; the others need no look at it.
    near = every.where("lane <> ''").join(lived, "lane", "left").withColumn("beside", F.col("beside") | F.coalesce("lived", F.lit(False))).drop("lived")
    names = every.where("lane = ''").unionByName(near)

    # Terms inside: how often a word stands in a name beside a protected entity. A candidate is no witness of its own words.
    inside = names.select(F.explode("words").alias("word"), flag.alias("hit")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"))
    inside = store(inside)
    # Where a street is spoken of like a title its own words decide: words of titles stand in many names.
    streets = streets.join(follows, "lane")
    worn = (
        streets.where("not home and not beside").select("doc_id", "matched_text", F.explode("words").alias("word"))
        .join(inside.where(_plain() >= 0.5).select("word"), "word", "left_semi").select("doc_id", "matched_text").distinct()
    )
    homes = streets.join(worn, ["doc_id", "matched_text"], "left_anti").select(*row)
    row = ["doc_id", "matched_text", "cue", "beside", "words"]
    spread = names.select(*row, F.explode(F.array_distinct("words")).alias("word"))
    others = lambda rows: rows.withColumn("n", F.col("n") - 1).withColumn("hits", F.col("hits") - flag).withColumn("bits", _bits(F.col("hits"), F.col("n"), base))
    strong = others(spread.join(inside.where("hits > 0"), "word")).where(_discloses(base))
    strong = store(strong.select(*row).distinct())

    # Terms around: what leads to a name and follows it, witnessed by names beside an entity and by strong words.
    around = names.groupBy("cue").agg(F.count(F.lit(1)).alias("n"), F.sum(flag).alias("hits"))
    more = strong.where("not beside").groupBy("cue").agg(F.count(F.lit(1)).alias("more"))
    around = around.join(more, "cue", "left").select("cue", "n", (F.col("hits") + F.coalesce("more", F.lit(0))).alias("hits")).where("hits > 0")
    telling = others(names.join(around, "cue")).where(_discloses(base))
    chosen = telling.select(*row).unionByName(strong).distinct()

    # Words that mostly stand elsewhere are common words of the corpus, whatever is beside them here.
    used = others(chosen.select(*row, F.explode(F.array_distinct("words")).alias("word")).join(inside, "word"))
    known = used.groupBy("doc_id", "matched_text").agg(F.max("bits").alias("most"), F.min(_plain()).alias("plain"))
    people = known.where((F.col("most") >= COMMON_BITS) | (F.col("plain") < 0.5)).select("doc_id", F.lit("person_name").alias("pii_kind"), "matched_text")
    return sure.unionByName(phones).unionByName(people).unionByName(homes).distinct()


def personal_details(documents: DataFrame, artists: DataFrame) -> DataFrame:
    """(doc_id, pii_kind, matched_text), each distinct piece of a document once."""
    return disclosed(store(candidates(documents, artists)))


def sanitised(documents: DataFrame, artists: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """(doc_id, text) with every piece replaced by a placeholder of its kind, at its own place in the text; texts without one stay as they are.

    Rows are kept one to one: nulls and repeated doc_ids too. ``details`` are the personal details, if they are known already.
    """
    details = personal_details(documents, artists) if details is None else details
    found = details.groupBy("doc_id").agg(F.collect_list(F.struct("matched_text", "pii_kind")).alias("found"))

    def swap(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            known: dict[str, str] = {}
            out = []
            for text, swaps in zip(pdf["text"], pdf["found"], strict=True):
                kinds = {(p["matched_text"], "bare" if p["pii_kind"] == "phone" and p["matched_text"].isdigit() else p["pii_kind"]): p["pii_kind"] for p in swaps}
                done, last = [], 0
                for a, b, kind, piece, *_ in sorted(pieces(text, known), key=lambda x: (x[0], -x[1])):
                    if a >= last and (piece, kind) in kinds:
                        done += [text[last:a], f"[{kinds[piece, kind].upper()}]"]
                        last = b
                out.append("".join([*done, text[last:]]))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": out})

    both = documents.select("doc_id", "text").join(found, "doc_id", "left")
    swapped = both.where("found is not null and text is not null").mapInPandas(swap, "doc_id bigint, text string")
    return swapped.unionByName(both.where("found is null or text is null").select("doc_id", "text"))
