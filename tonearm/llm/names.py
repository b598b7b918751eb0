"""Variant spellings of names typed by people, linked to a list of known names.

Each known name is written in every canonical way that the rules and their combinations allow
(nickname or formal name, initial, abbreviated or dropped legal form and title, token order,
joined words), typed names lose their title or initial likewise, and each form also stands with
one character left out. The forms meet in an equi-join. A candidate is scored by the rarity of
the rewriting that explains it: how seldom the rule is used in the corpus, how many known names
share the form, and how often the known name occurs; the best one must lead by odds of three.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonearm.llm import mojibake
from tonearm.session import cut

#: Nicknames of given names.
NICKNAMES = {
    "alexander": ["alex", "sasha", "xander", "sandy", "al"], "benjamin": ["ben", "benny", "benji"], "charlotte": ["lottie", "lotte", "charlie"],
    "dorothea": ["dora", "thea", "dot", "dottie"], "edward": ["ed", "eddie", "ted", "teddy", "ned"], "elizabeth": ["liz", "betty", "beth", "lizzie", "eliza", "lisa"],
    "francisco": ["paco", "pancho", "cisco", "fran"], "frederick": ["fred", "fritz", "freddie", "freddy"], "gabriele": ["gabi", "gaby", "gabe"],
    "giorgos": ["george", "yorgos"], "henrietta": ["etta", "hetty", "hettie"], "isabella": ["bella", "isa", "izzy"], "ivana": ["iva", "vanya"],
    "johannes": ["hans", "hannes", "jo", "jan"], "jonathan": ["jon", "jonny", "john", "johnny"], "katherine": ["kitty", "kate", "kathy", "katie", "kat"],
    "leopold": ["leo", "poldi"], "luciano": ["luca", "lucio"], "ludmila": ["mila", "luda", "lida"], "margaret": ["maggie", "peggy", "meg", "greta", "madge"],
    "michael": ["mick", "mike", "mickey", "mikey"], "nikolai": ["nik", "kolya", "nick", "niko"], "ottilie": ["tilly", "otti"], "penelope": ["penny", "nell"],
    "quentin": ["quin", "quinn"], "rebecca": ["becky", "becca"], "richard": ["rick", "dick", "rich", "ricky", "richie"], "robert": ["rob", "bob", "bobby", "robbie", "bert"],
    "ruben": ["rube", "benny"], "samuel": ["sam", "sammy"], "susanne": ["susi", "sue", "susie", "sanne"], "tadeo": ["tad", "teo"], "theodora": ["dora", "thea", "theo"],
    "tomasz": ["tom", "tomek", "tommy"], "ursula": ["ulla", "uschi", "ursel"], "valentina": ["tina", "val", "vale"], "wilhelmina": ["mina", "minnie", "willa", "billie"],
    "william": ["will", "bill", "billy", "willy", "liam"], "yolanda": ["yoli", "lola", "yola"], "zacharias": ["zach", "zack", "zak"],
}
#: Legal forms and their abbreviations, titles, and words that only connect or introduce.
KINDS = {
    "orch": "orchestra", "dept": "department", "coll": "collective", "exp": "experiment", "ens": "ensemble", "qt": "quartet", "qrt": "quartet", "proj": "project",
    "assy": "assembly", "assm": "assembly", "bros": "brothers", "snd": "sound", "sys": "system",
}
KIND_WORDS = {*KINDS.values()}
TITLES = {"dj", "mc", "dr", "lady"}
LOOSE = {"the", "and", "vs", "with", "feat", "ft", "und"}
LETTERS = str.maketrans({"ø": "o", "đ": "d", "ł": "l", "æ": "ae", "œ": "oe", "ð": "d", "þ": "th", "ħ": "h", "ŧ": "t"})
SHAPES = str.maketrans(*mojibake.LOOKALIKES)
#: Bits by which the best candidate must lead: odds of three.
LEAD = math.log2(3)


def formal_names(nicknames: dict[str, list[str]]) -> dict[str, list[str]]:
    """Nickname -> the formal names it stands for."""
    out: dict[str, list[str]] = {}
    for formal, nicks in nicknames.items():
        for nick in nicks:
            out.setdefault(nick, []).append(formal)
    return out


FORMAL = formal_names(NICKNAMES)


def fold(text: str) -> list[str]:
    """Lower-case words without accents, look-alikes and punctuation, legal forms in full."""
    text = unicodedata.normalize("NFKD", text).translate(SHAPES)
    text = "".join(ch for ch in text if not unicodedata.combining(ch) and unicodedata.category(ch) != "Cf").casefold().translate(LETTERS)
    # A lone x or y between two words joins them; at the end it is an initial.
    text = re.sub(r"(?<=\w) +(?:x|y|et) +(?=\w)", " & ", text.replace("soundsys", "sound system"))
    text = re.sub(r"\bd\.?j\b\.?", "dj", re.sub(r"\bm\.?c\b\.?", "mc", text))
    return [KINDS.get(w, w) for w in re.findall(r"[^\W_]+", text)]


def _key(words: list[str]) -> str:
    return " ".join(sorted(words))


def _core(words: list[str]) -> list[str]:
    return [w for w in words if w not in LOOSE] or words


def _bare(core: list[str]) -> list[str] | None:
    """The name without its title or legal form; None where it has none or is nothing else."""
    if len(core) > 1 and core[0] in TITLES:
        return core[1:]
    rest = [w for w in core if w not in KIND_WORDS]
    return rest if 0 < len(rest) < len(core) else None


def typed_forms(name: str) -> list[tuple[str, str]]:
    """(form, rule) under which a typed name is looked up; a rule other than fold or joined meets only names as they are listed."""
    words = fold(name)
    core = _core(words)
    if not core:
        return []
    out = {_key(core): "fold"}
    if len(words) == 1:
        out.setdefault("=" + words[0], "joined")
    bare = _bare(core)
    if bare:
        out.setdefault(_key(bare), "untitled")
    elif len(core) > 1 and len(core[0]) > 1:
        out.setdefault(_key([core[0][0], *core[1:]]), "shortened")
    return list(out.items())


def known_forms(name: str) -> list[tuple[str, str]]:
    """(form, rule) of every way in which the rules, alone and together, write a known name; the simplest rule of a form stays."""
    words = fold(name)
    core = _core(words)
    if not core:
        return []
    out = {_key(core): "fold"}
    if len(words) > 1:
        for all_of_them in (words, core):
            out.setdefault("=" + "".join(all_of_them), "joined")
    joint = bool(re.search(r"[&/+]|\b(and|und|vs)\b", name.casefold()))
    bare = _bare(core)
    for part, dropped in ((core, ""), (bare, "bare")):
        if not part:
            continue
        if dropped:
            out.setdefault(_key(part), dropped)
        # A title stands before the given name; what is joint or has a legal form has none.
        at = 1 if part[0] in TITLES else 0
        if joint or len(part) - at < 2 or any(w in KIND_WORDS for w in core):
            continue
        given, rest = part[at], part[at + 1 :]
        others = [(n, "nickname") for n in [*NICKNAMES.get(given, []), *FORMAL.get(given, [])]]
        others += [(n, "nickname+nickname") for f in FORMAL.get(given, []) for n in NICKNAMES[f]]
        for other, rule in [*others, (given[0], "initial")]:
            rule = "+".join(r for r in (dropped, rule) if r)
            out.setdefault(_key([*part[:at], other, *rest]), rule)
            if len(other) > 1:
                out.setdefault("=" + "".join([*part[:at], other, *rest]), rule + "+joined")
    return list(out.items())


def _near(form: str, rule: str) -> list[str]:
    """The form and, where a slip of the keyboard may be looked for, every form with one character left out."""
    if len(form.replace(" ", "")) < 6 or rule in ("untitled", "shortened"):
        return [form]
    return list(dict.fromkeys([form, *(form[:i] + form[i + 1 :] for i in range(len(form)))]))


def one_slip(a: str, b: str) -> bool:
    """Whether one insertion, deletion, change or swap of neighbours turns a into b."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (x[:2] == y[:2][::-1] and x[2:] == y[2:])


_FORM = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("near", "form", "rule")]))


#: Forms of a known and of a typed name with those that lack a character, about.
FORMS_PER_NAME, FORMS_PER_TYPED = 200, 20


def _forms_udf(make):
    @F.pandas_udf(_FORM)
    def forms(names: pd.Series) -> pd.Series:
        return names.map(lambda n: [(near, f, r) for f, r in make(n) for near in _near(f, r)])

    return forms


def link_names(typed: DataFrame, known: DataFrame, known_id: str, known_name: str) -> DataFrame:
    """(name, known_id, rule, confidence) for each distinct typed name that means a known one.

    ``typed`` has (name, n): a typed name and how often it occurs; both null-free. Names
    equal to a known name are left out. Each candidate has bits: minus the rarity of its rule
    among the names that only one known name explains, minus that of a form which several known
    names share, plus the logarithm of how often the known name occurs in ``typed``. The best
    wins if it leads by odds of three, else the name stays unlinked. confidence is its share of
    the odds of all candidates.
    """
    exact = known.select(F.col(known_name).alias("name"), F.col(known_id).alias("id")).where("name is not null and id is not null")
    written = mojibake.spread(cut(exact.distinct()), FORMS_PER_NAME)
    lists = written.select("id", F.col("name").alias("listed"), F.inline(_forms_udf(known_forms)("name")))
    rarity = lists.where("near = form").groupBy("form").agg(F.count_distinct("id").alias("shared"))
    lists = lists.join(rarity, "form").select("id", "near", F.col("form").alias("known_form"), F.col("rule").alias("known_rule"), "shared")
    open_names = cut(typed.join(exact, "name", "left_anti").select("name"))
    asked = mojibake.spread(open_names, FORMS_PER_TYPED).select("name", F.inline(_forms_udf(typed_forms)("name")))
    met = asked.join(lists, "near").select("name", "form", "rule", "id", "known_form", "known_rule", "shared").distinct()

    @F.pandas_udf(T.BooleanType())
    def slip(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one_slip(x, y) for x, y in zip(a, b, strict=True)])

    # A word joined up is compared with joined forms only; what is left out on one side must not be left out on the other.
    met = met.where((F.col("rule") == "joined") == F.col("known_rule").endswith("joined"))
    met = met.where(F.col("rule").isin("fold", "joined") | (F.col("known_rule") == "fold"))
    same = F.col("form") == F.col("known_form")
    met = met.where(same | slip("form", "known_form"))
    used = F.concat_ws("+", F.when(~F.col("rule").isin("fold", "joined"), F.col("rule")), "known_rule", F.when(~same, F.lit("typo")))
    met = cut(met.select("name", "id", used.alias("rule"), "shared").distinct())

    # How often each rule is used, seen on the names with one candidate; the number of rules is fixed.
    alone = met.groupBy("name").agg(F.count_distinct("id").alias("ids"), F.min(F.struct(F.size(F.split("rule", r"\+")).alias("n"), "rule")).alias("r")).where("ids = 1")
    uses = alone.groupBy(F.col("r.rule").alias("rule")).agg(F.count(F.lit(1)).alias("uses"))
    rules = met.select("rule").distinct().join(uses, "rule", "left")
    every = rules.agg(F.sum(F.coalesce("uses", F.lit(0)) + 1)).first()[0] or 1
    rules = rules.select("rule", F.log2((F.coalesce("uses", F.lit(0)) + 1) / F.lit(float(every))).alias("told"))
    counts = typed.join(exact, "name").groupBy("id").agg(F.sum("n").alias("seen"))
    found = met.join(rules, "rule").withColumn("bits", F.col("told") - F.log2("shared"))
    best = found.groupBy("name", "id").agg(F.max(F.struct("bits", "rule")).alias("b")).join(counts, "id", "left")
    best = best.select("name", "id", F.col("b.rule").alias("rule"), (F.col("b.bits") + F.log2(F.coalesce("seen", F.lit(0)) + 1)).alias("bits"))
    w = Window.partitionBy("name").orderBy(F.desc("bits"), "id")
    ranked = best.withColumn("r", F.row_number().over(w)).withColumn("next", F.lead("bits").over(w))
    odds = best.groupBy("name").agg(F.max("bits").alias("top"), F.sum(F.pow(F.lit(2.0), F.col("bits"))).alias("odds"))
    clear = F.col("next").isNull() | (F.col("bits") - F.col("next") >= LEAD - 1e-9)
    return ranked.where((F.col("r") == 1) & clear).join(odds, "name").select(
        "name", F.col("id").alias(known_id), "rule", F.round(F.pow(F.lit(2.0), F.col("bits")) / F.col("odds"), 4).alias("confidence")
    )


def library_variants(tracks: DataFrame, request_lines: DataFrame, artists: DataFrame) -> DataFrame:
    """(source_table, row_id, artist_id, name, rule, confidence) of rows whose artist, or whose
    title where the halves are swapped, is another spelling of a listed artist.

    Null and blank names mean nobody. Garbled names are restored before they are compared.
    A title is looked at only where the artist neither is nor means a listed one.
    """
    lines = request_lines.select("line_id", F.col("artist").alias("a"), F.col("title").alias("t"))
    rows = tracks.select(F.lit("tracks").alias("source_table"), F.col("entry_id").alias("row_id"), F.col("artist").alias("name"), F.lit(0).alias("half"))
    rows = rows.unionByName(lines.select(F.lit("request_lines").alias("source_table"), F.col("line_id").alias("row_id"), F.col("a").alias("name"), F.lit(0).alias("half")))
    rows = rows.unionByName(lines.select(F.lit("request_lines").alias("source_table"), F.col("line_id").alias("row_id"), F.col("t").alias("name"), F.lit(1).alias("half")))
    rows = rows.where(F.trim("name") != "")
    names = cut(rows.groupBy("name").agg(F.count(F.lit(1)).alias("n")))
    words = mojibake.clean_words([artists.select("artist_name"), tracks.select("artist")])
    restored = mojibake.garbled_rows([("names", names.select("name", F.col("name").alias("text")))], words).where("restored is not null")
    restored = cut(restored.select(F.col("row_id").alias("name"), "restored"))
    fixed = names.join(restored, "name", "left").select("name", F.coalesce("restored", "name").alias("text"), "n")
    typed = cut(fixed.groupBy(F.col("text").alias("name")).agg(F.sum("n").alias("n")))
    linked = link_names(typed, artists, "artist_id", "artist_name")
    exact = artists.select(F.col("artist_name").alias("name"), "artist_id").where("name is not null")
    # What each written name means: a restored name may be exactly a listed one and still is a variant as written.
    meaning = linked.unionByName(exact.select("name", "artist_id", F.lit("exact").alias("rule"), F.lit(1.0).alias("confidence")))
    meaning = fixed.select("name", "text").join(meaning.withColumnRenamed("name", "text"), "text").drop("text")
    meant = rows.join(meaning, "name")
    first = Window.partitionBy("source_table", "row_id").orderBy("half")
    meant = meant.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r", "half")
    return meant.join(exact.select("name", F.lit(True).alias("listed")).distinct(), "name", "left").where("listed is null").drop("listed").select(
        "source_table", "row_id", "artist_id", "name", "rule", "confidence"
    )
