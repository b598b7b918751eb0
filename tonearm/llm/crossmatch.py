"""Records of two tables matched without a common key.

Cross-table retrieval over an inverted index. The postings of a word are kept in blocks of
running time and by the part numbers of the title, since a pair whose measurements or parts differ is not one recording. A record asks with the
words without which a pair cannot reach the floor, rarest first, and with the words that are
one or two slips away from them. Every pair found so has a lower and an upper bound of its
BM25 score; it is dropped only when the upper bound lies below the K-th best lower bound of
the file and below the best of the entry. What is left is scored exactly. Mutual nearest
neighbours stay, and a logistic curve over the score gap gives the confidence.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonearm.functions.folding import fold
from tonearm.session import store

#: Greatest difference of running time in seconds and of size as a share, of one recording in one version.
SECONDS, SIZE_SHARE = 1.0, 0.015
#: Files that the calibration is fitted on, about and at most.
CALIBRATION_ROWS = 20_000
K1, B = 1.2, 0.4
#: Share of the weight of its words that a file must find again in an entry.
FLOOR = 0.25
#: Length of the exact lists of nearest entries.
TOP_K = 8
ACCEPT = 0.5
#: Fits of the curve, and the share of wrong answers above the level from which a best one counts as right.
FITS, WRONG_SHARE = 4, 0.05
#: Width of the blocks of running time in a posting list, in the logarithm of the seconds.
TIME_BLOCK = 0.15
#: Slips allowed between two words from these lengths on.
SLIPS = ((4, 1), (7, 2))
#: Fixed value: version notes that mean the plain version.
PLAIN_VERSION = "original mix"


def _number(text: Column) -> Column:
    value = F.when(text.rlike(r"^\s*\d+(\.\d*)?\s*$"), text.try_cast("double"))
    return F.when((value > 0) & (value < 1e12), value)


def describe(records: DataFrame, id_col: str, stem: Column | None = None) -> DataFrame:
    """(id, words, version, parts, sec, kb) of each record.

    words: distinct folded words of artist and title without the version note; parts: the
    part and other numbers of the title. ``stem`` is a file name without extension that
    stands in for missing tags. Unusable measurements are null.
    """
    artist, title = F.coalesce(F.trim("artist"), F.lit("")), F.coalesce(F.trim("title"), F.lit(""))
    unnumbered = lambda c: F.regexp_replace(c, r"^\p{N}{1,3}[ ._-]+(?=\S*\p{L})", "")
    title = unnumbered(title)
    tags = both = F.concat_ws(" ", artist, title)
    if stem is not None:
        stem = unnumbered(stem)
        both = F.when((artist == "") | (title == ""), F.concat_ws(" ", tags, stem)).otherwise(tags)
        tags = F.when(title == "", stem).otherwise(tags)
    # The version note stands in brackets, in either tag since tags may be swapped.
    note = F.array_join(F.array_distinct(F.regexp_extract_all(fold(tags), F.lit(r"[(\[]([^)\]]*)[)\]]"), F.lit(1))), " ")
    note = F.trim(F.regexp_replace(note, r"[^\p{L}\p{N}]+", " "))
    # A form of address in brackets belongs to the name.
    note = F.trim(F.regexp_replace(note, r"\b(dj|mc|dr|lady)\b", ""))
    free = F.regexp_replace(F.regexp_replace(fold(both), r"[(\[](dj|mc|dr|lady)[)\]]", " $1 "), r"[(\[][^)\]]*[)\]]", " ")
    plain = F.regexp_replace(F.regexp_replace(fold(tags), r"[(\[][^)\]]*[)\]]", " "), r"[^\p{L}\p{N}]+", " ")
    numbers = F.regexp_extract_all(plain, F.lit(r"part ([ivx]+)\b|(\p{Nd}+)"), F.lit(0))
    all_words = F.array_distinct(F.filter(F.split(free, r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    return records.select(
        F.col(id_col).alias("id"),
        all_words.alias("words"),
        F.when(F.levenshtein(note, F.lit(PLAIN_VERSION)) <= 2, "").otherwise(note).alias("version"),
        F.array_sort(F.array_distinct(numbers)).alias("parts"),
        _number(F.col("playtime_float")).alias("sec"),
        _number(F.col("filesize")).alias("kb"),
    )


def _slips(w: Column, v: Column) -> Column:
    """Slips allowed between two words."""
    shortest = F.least(F.length(w), F.length(v))
    return F.when(shortest >= SLIPS[1][0], SLIPS[1][1]).when(shortest >= SLIPS[0][0], SLIPS[0][1]).otherwise(0)


def likeness(w: Column, v: Column) -> Column:
    """1 for equal words, less for each slip, 0 beyond the slips allowed."""
    slips = F.levenshtein(w, v)
    return F.when(w == v, 1.0).when(slips <= _slips(w, v), 1 - slips / F.greatest(F.length(w), F.length(v))).otherwise(0.0)


def _shortened(word: Column) -> Column:
    """Hashes of the word and of what is left of it without as many letters as slips are allowed.

    Two words within that many slips have one of these in common.
    """
    drop = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, 1, i - 1), w.substr(i + 1, F.length(w))))
    none = F.array().cast("array<string>")
    once = F.when(F.length(word) >= SLIPS[0][0], drop(word)).otherwise(none)
    twice = F.when(F.length(word) >= SLIPS[1][0], F.flatten(F.transform(once, drop))).otherwise(none)
    return F.array_distinct(F.transform(F.concat(F.array(word), once, twice), lambda x: F.xxhash64(x)))


def alike_words(asked: DataFrame, told: DataFrame) -> DataFrame:
    """(word, v, like) for each word of ``asked`` (word) and every equal or similar word v of ``told`` (word).

    Words of a vocabulary are compared, not their occurrences.
    """
    a = asked.select("word").distinct().withColumn("h", F.explode(_shortened(F.col("word"))))
    t = told.select(F.col("word").alias("v")).distinct().withColumn("h", F.explode(_shortened(F.col("v"))))
    met = a.join(t, "h").select("word", "v").distinct()
    return met.withColumn("like", likeness(F.col("word"), F.col("v")).cast("float")).where("like > 0")


def same_kept_once(record: DataFrame) -> DataFrame:
    """Records that say exactly the same are one; the least id stands for them, as it would win the tie."""
    said = [F.array_sort("words"), F.col("version"), F.col("parts"), F.col("sec"), F.col("kb")]
    record = record.withColumn("h1", F.xxhash64(*said)).withColumn("h2", F.xxhash64(F.lit("second"), *said))
    # Written, so its size is known: where few records repeat, the others are not moved.
    twice = store(record.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2", "least"))
    # One number as join key keeps the table that is sent out as small as its rows; the second hash is compared beside it.
    twice = twice.withColumnsRenamed({"h1": "g1", "h2": "g2"})
    met = record.join(twice, (F.col("h1") == F.col("g1")) & (F.col("h2").bitwiseXOR(F.col("g2")) == 0), "left")
    return met.where("least is null or id = least").drop("h1", "h2", "g1", "g2", "least")


def weighted(ask: DataFrame, tell: DataFrame) -> DataFrame:
    """``ask`` with its words from rare to frequent in ``tell``, their idf and their similar words.

    total: weight of all words; asked: number of words to ask with, so that what the others weigh together (rest) stays
    below the floor; alike: hash and likeness of the other words of ``tell`` that are similar to each word asked.
    """
    count = tell.count()
    df = store(tell.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df")))
    pairs = ask.select("id", F.explode("words").alias("word"))
    alike = alike_words(pairs, df).where("word <> v").groupBy("word").agg(F.collect_list(F.struct(F.xxhash64("v").alias("v"), "like")).alias("alike"))
    seen = F.coalesce("df", F.lit(0))
    idf = F.log(1 + (count - seen + 0.5) / (seen + 0.5))
    ranked = F.sort_array(F.collect_list(F.struct(seen.alias("df"), "word", idf.alias("idf"), F.coalesce("alike", F.array().cast("array<struct<v:bigint,like:float>>")).alias("alike"))))
    lexicon = store(pairs.select("word").distinct().join(df, "word", "left").join(alike, "word", "left"))
    w = pairs.join(lexicon, "word").groupBy("id").agg(ranked.alias("ranked"))
    w = w.select("id", F.transform("ranked", lambda x: x["word"]).alias("words"), F.transform("ranked", lambda x: x["idf"].cast("float")).alias("idf"), F.transform("ranked", lambda x: x["alike"]).alias("alike"))
    w = w.withColumn("total", F.aggregate("idf", F.lit(0.0), lambda a, x: a + x.cast("double")))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("k"))
    step = lambda a, x: F.when(F.col("total") - a["sum"] >= FLOOR * F.col("total"), F.struct((a["sum"] + x.cast("double")).alias("sum"), (a["k"] + 1).alias("k"))).otherwise(a)
    w = w.withColumn("must", F.aggregate("idf", start, step))
    w = w.select("id", "words", "idf", "total", F.col("must.k").alias("asked"), (F.col("total") - F.col("must.sum")).alias("rest"), F.slice("alike", 1, F.col("must.k")).alias("alike"))
    return ask.drop("words").join(w, "id")


def version_ok(a: Column, b: Column) -> Column:
    return (a == b) | ((F.least(F.length(a), F.length(b)) > 6) & (F.levenshtein(a, b) <= 2))


def found_pairs(ask: DataFrame, tell: DataFrame) -> DataFrame:
    """(file, entry, gain, rest, total, n, dt, ds) of every pair of the weighted ``ask`` and ``tell`` that can reach the floor
    and that nothing refutes.

    gain: weight of the asked words that the entry has, similar ones by their likeness; rest: what
    the words not asked could add; n: number of words of the entry.
    """
    time = lambda shift: F.floor(F.log1p(F.greatest(F.col("sec") + shift, F.lit(0.0))) / TIME_BLOCK).cast("int")
    key = lambda word, block: F.xxhash64(word, F.col("part"), block)
    # Times below 1e12 seconds have under 200 blocks; a record without a time stands in every block there is. Block -1
    # is for times that no entry has.
    present = sorted(r[0] for r in tell.where("sec is not null").select(time(0.0)).distinct().collect())
    every = F.array(*[F.lit(b) for b in [-1, *present]])
    has_t, has_s = F.col("sec").isNotNull(), F.col("kb").isNotNull()
    # Where nothing measured can be compared, all words must be the same: a list of its own.
    whole = F.when(~(has_t & has_s) & (F.size("words") > 1), F.xxhash64(F.lit("whole"), F.array_join(F.array_sort("words"), " "), F.col("part")))
    part = F.array_join("parts", " ")

    ask = ask.where(F.size("words") > 0).withColumn("part", part)
    # The time of a file may be a second off: it asks in each block this can reach.
    blocks = F.when(has_t, F.array_distinct(F.transform(F.sequence(time(-SECONDS), time(SECONDS)), lambda b: F.when(F.array_contains(every, b), b).otherwise(-1)))).otherwise(every)
    asks = lambda i, v, like: F.struct(i.cast("short").alias("pos"), v.alias("v"), (F.element_at("idf", i) * like).cast("float").alias("gain"))
    words = F.transform(
        F.sequence(F.lit(1), F.col("asked")),
        lambda i: F.concat(F.array(asks(i, F.xxhash64(F.element_at("words", i)), F.lit(1.0))), F.transform(F.element_at("alike", i), lambda x: asks(i, x["v"], x["like"]))),
    )
    a = ask.withColumn("whole", whole).withColumn("w", F.explode(F.flatten(words))).withColumn("block", F.explode(blocks))
    row = ["id", "version", F.col("sec").cast("float").alias("ft"), F.col("kb").cast("float").alias("fs")]
    a = a.select(key(F.col("w.v"), F.col("block")).alias("term"), *row, "w.pos", "w.gain")
    bare = ask.withColumn("term", whole).where("term is not null").select("term", *row, F.lit(-1).cast("short").alias("pos"), F.col("total").cast("float").alias("gain"))
    a = a.unionByName(bare).withColumnsRenamed({"id": "file", "version": "fv"})

    tell = tell.where(F.size("words") > 0).withColumn("part", part).withColumn("whole", whole)
    stands = F.when(has_t, F.array(time(0.0))).otherwise(every)
    held = F.flatten(F.transform("words", lambda w: F.transform(stands, lambda b: key(F.xxhash64(w), b))))
    e = tell.select(
        F.explode(F.concat(held, F.when(F.col("whole").isNotNull(), F.array("whole")).otherwise(F.array().cast("array<bigint>")))).alias("term"),
        F.col("id").alias("entry"), F.size("words").cast("short").alias("n"), F.col("version").alias("ev"), F.col("sec").cast("float").alias("et"), F.col("kb").cast("float").alias("es"),
    )

    met = a.join(e, "term").withColumn("dt", F.abs(F.col("ft") - F.col("et"))).withColumn("ds", F.abs(F.log(F.col("fs") / F.col("es"))).cast("float"))
    # The measurements travel rounded; the exact ones are looked at when the pair is scored.
    met = met.where((F.col("dt").isNull() | (F.col("dt") <= SECONDS + 1e-6 * F.col("ft"))) & (F.col("ds").isNull() | (F.col("ds") <= math.log1p(SIZE_SHARE) + 1e-6)))
    met = met.where(version_ok(F.col("fv"), F.col("ev")) & ((F.col("pos") < 0) == (F.col("dt").isNull() & F.col("ds").isNull())))
    # A word counts once, by the word of the entry most like it.
    met = met.select("file", "entry", "pos", "gain", "n", "dt", "ds").repartition("file").groupBy("file", "entry", "pos").agg(F.max("gain").alias("gain"), *[F.first(c).alias(c) for c in ("n", "dt", "ds")])
    met = met.groupBy("file", "entry").agg(F.sum("gain").alias("gain"), *[F.first(c).alias(c) for c in ("n", "dt", "ds")])
    met = met.join(ask.select(F.col("id").alias("file"), "rest", "total"), "file")
    return met.where(F.col("gain") + F.col("rest") >= FLOOR * F.col("total") * 0.999)


def candidates(ask: DataFrame, tell: DataFrame) -> DataFrame:
    """Distinct (file, entry) that the index gives."""
    return found_pairs(ask, tell).select("file", "entry")


def rarity(tell: DataFrame) -> tuple[float, float, float]:
    """Bits (base e) that an equal band of time and of size tells - how seldom two records of the corpus agree in it
    by chance -, and the average number of words."""
    def told(value: Column, width: float) -> float:
        bands = tell.where(value.isNotNull()).groupBy(F.floor(value / width).alias("b")).agg(F.count(F.lit(1)).alias("n"))
        row = bands.agg(F.sum("n").alias("all"), F.sum(F.col("n").cast("double") ** 2).alias("sq")).first()
        return math.log((row["all"] + 1) ** 2 / (row["sq"] + 1)) if row["all"] else 0.0

    words = tell.agg(F.avg(F.size("words"))).first()[0]
    return told(F.col("sec"), 2 * SECONDS), told(F.log("kb"), 2 * math.log1p(SIZE_SHARE)), max(words or 1.0, 1.0)


def _agreement(by_time: float, by_size: float) -> Column:
    """Score of the measurements: the closer, the more."""
    t = F.when(F.col("dt").isNotNull(), by_time * (1 - F.col("dt") / (2 * SECONDS))).otherwise(0.0)
    return t + F.when(F.col("ds").isNotNull(), by_size * (1 - F.col("ds") / (2 * math.log1p(SIZE_SHARE)))).otherwise(0.0)


def _length_factor(n: Column, average: float) -> Column:
    return (K1 + 1) / (1 + K1 * (1 - B + B * n / average))


def pruned(pairs: DataFrame, told: tuple[float, float, float], k: int = TOP_K) -> DataFrame:
    """The pairs that can be among the k nearest of their file or the nearest of their entry."""
    factor, sure = _length_factor(F.col("n"), told[2]), _agreement(*told[:2])
    bounds = store(pairs.select("file", "entry", "dt", "ds", (F.col("gain") * factor + sure).alias("low"), ((F.col("gain") + F.col("rest")) * factor * 1.0001 + sure + 0.001).alias("high")))
    ranked = bounds.select("file", "low", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("low"))).alias("r")).where(F.col("r") <= k)
    of_file = ranked.groupBy("file").agg(F.min("low").alias("kth"), F.count(F.lit(1)).alias("many")).where(F.col("many") >= k).select("file", "kth")
    of_entry = bounds.groupBy("entry").agg(F.max("low").alias("top"))
    kept = bounds.join(of_file, "file", "left").join(of_entry, "entry")
    return kept.where(F.col("kth").isNull() | (F.col("high") >= F.col("kth")) | (F.col("high") >= F.col("top"))).select("file", "entry")


def scored(pairs: DataFrame, ask: DataFrame, tell: DataFrame, told: tuple[float, float, float]) -> DataFrame:
    """(file, entry, said, score, ceiling, share) of pairs (file, entry) that nothing refutes and that reach the floor.

    said: hash of the words of the entry; ceiling: score of a record that equals the file; share: the greater of the
    weight of the file's words and the number of the entry's words that are found on the other side.
    """
    f = ask.select(F.col("id").alias("file"), F.col("words").alias("fw"), "idf", "total", F.col("sec").alias("ft"), F.col("kb").alias("fs"))
    e = tell.select(F.col("id").alias("entry"), F.col("words").alias("ew"), F.col("sec").alias("et"), F.col("kb").alias("es"))
    met = pairs.select("file", "entry").join(e, "entry").join(f, "file")
    met = met.withColumn("dt", F.abs(F.col("ft") - F.col("et"))).withColumn("ds", F.abs(F.log(F.col("fs") / F.col("es"))))
    met = met.where((F.col("dt").isNull() | (F.col("dt") <= SECONDS)) & (F.col("ds").isNull() | (F.col("ds") <= math.log1p(SIZE_SHARE))))
    best = F.transform("fw", lambda w: F.when(F.array_contains("ew", w), F.lit(1.0)).otherwise(F.array_max(F.transform("ew", lambda v: likeness(w, v)))))
    met = met.withColumn("like", best)
    gain = F.aggregate(F.zip_with("like", "idf", lambda s, i: s * i.cast("double")), F.lit(0.0), lambda a, x: a + x)
    met = met.withColumn("gain", gain).where(F.col("gain") >= FLOOR * F.col("total"))
    full = F.col("total") * _length_factor(F.size("fw"), told[2])
    ceiling = full + F.when(F.col("dt").isNotNull(), told[0]).otherwise(0.0) + F.when(F.col("ds").isNotNull(), told[1]).otherwise(0.0)
    alike = F.aggregate("like", F.lit(0.0), lambda a, x: a + x) / F.size("ew")
    return met.select(
        "file", "entry", F.xxhash64("ew").alias("said"), (F.col("gain") * _length_factor(F.size("ew"), told[2]) + _agreement(*told[:2])).alias("score"),
        ceiling.alias("ceiling"), F.greatest(F.col("gain") / F.col("total"), F.least(alike, F.lit(1.0))).alias("share"),
    )


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (with a constant) of a ridge logistic regression, by Newton steps."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        w += np.linalg.solve(h, x.T @ (y - p) - 1e-2 * w)
    return w


def _calibrate(standing: DataFrame) -> np.ndarray:
    """Weights of (1, share, gap).

    A file means one recording at most. Its best recording stands for a right answer; the next best, measured as if
    the best were absent, is known to be wrong. Some best ones are wrong too, so from the second fit on only those
    count as right that stand above nearly all wrong ones. One right answer without a fault and one wrong one at the
    floor are added, so the curve exists for any number of rows.
    """
    many = standing.count()
    picked = standing.where(F.pmod(F.xxhash64("file"), F.lit(max(1, -(-many // CALIBRATION_ROWS)))) == 0).select("share", "gap", "next_share", "next_gap").toPandas()
    wrong = np.r_[picked.dropna(subset=["next_share"])[["next_share", "next_gap"]].to_numpy(float), [[FLOOR, 0.0]]]
    right = best = np.r_[picked[["share", "gap"]].to_numpy(float), [[1.0, 1 - FLOOR]]]
    for _ in range(FITS):
        w = _logistic(np.r_[right, wrong], np.r_[np.ones(len(right)), np.zeros(len(wrong))])
        right = best[best @ w[1:] >= np.quantile(wrong @ w[1:], 1 - WRONG_SHARE)]
    return w


def match_sources(ask: DataFrame, tell: DataFrame) -> DataFrame:
    """(file, entry, score, gap, share, confidence): mutual nearest pairs of the described tables.

    A record has at most one partner on the other side. Ties go to the least id. The gap, as a share of the ceiling,
    is taken to the best entry with other words, at least to the floor: copies of one recording are no rivals.
    Records without words have no partner.
    """
    tell = store(same_kept_once(store(tell)))
    ask = store(weighted(same_kept_once(store(ask)), tell))
    told = rarity(tell)
    pairs = store(scored(pruned(found_pairs(ask, tell), told), ask, tell, told))
    # Both sides are ranked over all pairs before any of them is dropped.
    of_file = pairs.groupBy("file").agg(F.min(F.struct((-F.col("score")).alias("s"), "entry", "said", "share", "ceiling")).alias("b")).select("file", "b.*")
    of_entry = pairs.groupBy("entry").agg(F.min(F.struct((-F.col("score")).alias("s"), "file")).alias("b")).select("entry", F.col("b.file").alias("file"))
    # The three best recordings of each file, copies taken as one.
    told_by = pairs.groupBy("file", "said").agg(F.max("score").alias("score"), F.max("share").alias("share"))
    w = Window.partitionBy("file").orderBy(F.desc("score"), "said")
    told_by = told_by.withColumn("r", F.row_number().over(w)).where("r <= 3").groupBy("file").agg(
        *[F.max(F.when(F.col("r") == r, F.col("score"))).alias(f"s{r}") for r in (1, 2, 3)], F.max(F.when(F.col("r") == 2, F.col("share"))).alias("next_share")
    )
    floor = F.col("ceiling") * FLOOR
    standing = of_file.join(told_by, "file").select(
        "file", "entry", (-F.col("s")).alias("score"), "share", ((F.col("s1") - F.greatest(F.coalesce("s2", floor), floor)) / F.col("ceiling")).alias("gap"),
        "next_share", ((F.col("s2") - F.greatest(F.coalesce("s3", floor), floor)) / F.col("ceiling")).alias("next_gap"),
    )
    standing = store(standing)
    c = [float(x) for x in _calibrate(standing)]
    z = c[0] + c[1] * F.col("share") + c[2] * F.col("gap")
    return standing.join(of_entry, ["file", "entry"]).select("file", "entry", "score", "gap", "share", (1 / (1 + F.exp(-z))).alias("confidence"))


def _stem(file_name: str) -> Column:
    """A file name without its ending; nothing where it is a number of a ripper."""
    return F.regexp_replace(F.regexp_replace(file_name, r"(\.stem)?\.[A-Za-z0-9]{1,5}$", ""), r"^(rip[0-9a-f]{6,}|AUD-\d+)$", "")


def library_files(disk_files: DataFrame, tracks: DataFrame) -> DataFrame:
    """(entry_id, file_id, score, confidence) of the files that are a recording of tracks.

    Null and empty tags give way to the file name; a row without any word has no partner. Empty tables give no rows.
    """
    found = match_sources(describe(disk_files, "file_id", _stem("file_name")), describe(tracks, "entry_id"))
    return found.where(F.col("confidence") >= ACCEPT).select(F.col("entry").alias("entry_id"), F.col("file").alias("file_id"), "score", "confidence")
