"""The match cascade: ranked exact keys, refutation by size and time, one outcome per record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonearm import model
from tonearm.functions import paths
from tonearm.functions.numbers import number
from tonearm.session import store

_JOIN = "\x1f"


def with_parts(records: DataFrame) -> DataFrame:
    """Records with folded fields, folder parts and measurements computed once, before any join."""
    parts = paths.folder_parts(F.col("dir"))
    disk = F.col("from_disk") if "from_disk" in records.columns else F.lit(False)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return records.select(
        "rid", "primary_key", text("audio_id").alias("audio_id"), text("filesize").alias("filesize"), text("playtime_float").alias("playtime_float"),
        *[paths.casefold(text(c)).alias(c) for c in ("artist", "title", "album", "file")],
        paths.bare_name(text("file")).alias("bare"), parts.alias("parts"), paths.casefold(F.array_join(parts, _JOIN)).alias("folders"),
        number(F.col("filesize")).alias("kb"), number(F.col("playtime_float")).alias("sec"), disk.alias("from_disk"),
    )


def tier_keys(records: DataFrame, level: str = "strict") -> DataFrame:
    """(rid, rank, tier, key, ...) one row per admitted tier whose fields are all filled. Null fields count as empty."""
    r = with_parts(records).withColumn("folders", F.split("folders", _JOIN))

    def whole(*fields: str) -> Column:
        filled = F.lit(True)
        for f in fields:
            filled = filled & (F.col(f) != "")
        return F.when(filled, F.concat_ws(_JOIN, *fields))

    def suffix(depth: int) -> Column:
        deep = (F.size("parts") >= depth) & (F.col("file") != "")
        return F.when(deep, F.concat_ws(_JOIN, F.array_join(F.slice("folders", -depth, depth), _JOIN), "file"))

    made = {
        "audio_id": whole("audio_id"),
        "artist_title_size_time": whole("artist", "title", "filesize", "playtime_float"),
        "artist_title_file": whole("artist", "title", "file"),
        "file_size_time": whole("file", "filesize", "playtime_float"),
        "artist_title_album_time": whole("artist", "title", "album", "playtime_float"),
        "path_suffix_3": suffix(3),
        "path_suffix_2": suffix(2),
        "artist_title": whole("artist", "title"),
        "path_suffix_1": suffix(1),
        "bare_name_in_folder": F.when((F.size("parts") > 0) & F.col("bare").isNotNull(), F.concat_ws(_JOIN, F.element_at("folders", -1), "bare")),
        "filename": whole("file"),
        "bare_name": F.col("bare"),
    }
    ranks = {t: i + 1 for i, (t, _) in enumerate(model.TIERS)}
    keys = F.array(*[F.struct(F.lit(ranks[t]).alias("rank"), F.lit(t).alias("tier"), made[t].alias("key")) for t in model.admitted(level)])
    return r.select("rid", "primary_key", "kb", "sec", "from_disk", "parts", F.inline(F.filter(keys, lambda k: k["key"].isNotNull())))


def refutes(size_a: Column, size_b: Column, time_a: Column, time_b: Column, cross: Column) -> Column:
    """Whether size or time shows that two records are not one. What is absent refutes nothing; size never across sources."""
    top = F.greatest(size_a, size_b)
    by_size = ~cross & (top > 0) & (F.try_divide(F.abs(size_a - size_b), top) > model.SIZE_SHARE)
    allowed = F.when(cross, F.greatest(F.lit(model.SECONDS), model.CROSS_TIME_SHARE * F.greatest(time_a, time_b))).otherwise(F.lit(model.SECONDS))
    by_time = F.abs(time_a - time_b) > allowed
    return F.coalesce(by_size, F.lit(False)) | F.coalesce(by_time, F.lit(False))


def size_agrees(a: Column, b: Column) -> Column:
    top = F.greatest(a, b)
    return F.coalesce((top > 0) & (F.try_divide(F.abs(a - b), top) <= model.SIZE_SHARE), F.lit(False))


def _sides(old: DataFrame, new: DataFrame, level: str, providers: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Keyed rows of both sides, and the keys of very many new records (rank, tier, key).

    On the new side the preferred-copy rule is done: where a key has a stale copy and one synced copy, only the synced
    one stays. It looks at the key alone, so it is settled before any record is joined.
    """
    cols = ["rank", "tier", "key"]
    a, b = tier_keys(old, level), tier_keys(new, level)
    if providers is not None:
        for side in ("old", "new"):
            base = with_parts(old if side == "old" else new).select("rid", "primary_key", "kb", "sec", "from_disk", "parts")
            extra = base.join(providers.where((F.col("side") == side) & F.col("key").isNotNull()).select("rid", F.lit(0).alias("rank"), "tier", "key"), "rid")
            a, b = (a.unionByName(extra), b) if side == "old" else (a, b.unionByName(extra))
    a = a.select(*cols, *[F.col(c).alias("o_" + c) for c in ("rid", "primary_key", "kb", "sec", "from_disk")])
    b = b.select(
        *cols, *[F.col(c).alias("n_" + c) for c in ("rid", "primary_key", "kb", "sec", "from_disk")],
        F.array_contains("parts", "Sync_old").alias("stale"), F.array_contains("parts", "Sync_").alias("synced"),
    )
    # Written, so its size is known: mostly few keys are special, and nothing else is moved for them.
    special = b.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"), (F.bool_or("stale") & (F.count_if("synced") == 1)).alias("ruled")).where((F.col("n") > HOT) | F.col("ruled"))
    special = store(special.select(*cols, "ruled"))
    b = b.join(special.where("ruled"), cols, "left").where("ruled is null or synced").drop("ruled", "stale", "synced")
    return a, b, special.where("not ruled").select(*cols)


def _against(tier: Column, refute: bool) -> Column:
    cross = F.col("o_from_disk") != F.col("n_from_disk")
    return refutes(F.col("o_kb"), F.col("n_kb"), F.col("o_sec"), F.col("n_sec"), cross) & F.lit(refute) & ~tier.isin(*model.NOT_REFUTABLE)


def candidates(old: DataFrame, new: DataFrame, level: str, refute: bool = True, providers: DataFrame | None = None) -> DataFrame:
    """Every (old record, tier, new record) that shares a key, after the preferred-copy rule, with its verdicts.

    For reports that list them: a key that many records of both sides share gives all their pairs; ``match`` does
    without them. ``providers`` (rid, side, tier, key) adds keys of rank 0; side is `old` or `new`. A null key adds nothing.
    """
    a, b, _ = _sides(old, new, level, providers)
    met = a.join(b.hint("merge"), ["rank", "tier", "key"])
    return met.withColumn("refuted", _against(F.col("tier"), refute)).withColumn("agrees", size_agrees(F.col("o_kb"), F.col("n_kb")))


#: New records of one key from which on the key is read by bands of size and time instead of record by record.
HOT = 64
#: Widths of the bands: logarithm of the size and of the time.
SIZE_BAND, TIME_BAND = 0.05, 0.2


def _size_band(kb: Column) -> Column:
    return F.when(kb > 0, F.floor(F.log(kb) / SIZE_BAND).cast("int")).otherwise(-1_000_000)


def _time_band(sec: Column) -> Column:
    return F.floor(F.log1p(F.greatest(sec, F.lit(0.0))) / TIME_BAND).cast("int")


def _hot_counts(a: DataFrame, b: DataFrame, refute: bool) -> DataFrame:
    """What ``match`` counts of each old record and tier, for keys with very many records.

    Records that agree in size, time and source are one class on either side. Classes meet in bands of time (which hold
    all that time does not refute) and of size (which hold all that size agrees with); what has nothing to be refuted by
    is counted as it stands. So the work grows with the readings that lie near each other, not with the pairs.
    """
    cols, read = ["rank", "tier", "key"], ["kb", "sec", "from_disk"]
    old = a.groupBy(*cols, *["o_" + c for c in read]).agg(F.count(F.lit(1)).alias("o_n")).drop("o_n")
    one = F.struct("n_rid", "n_primary_key")
    new = store(b.groupBy(*cols, *["n_" + c for c in read]).agg(F.count(F.lit(1)).alias("n"), F.min(one).alias("one")))
    old = store(old)
    refutable = F.lit(refute) & ~F.col("tier").isin(*model.NOT_REFUTABLE)
    who = [*cols, *["o_" + c for c in read]]
    tally = lambda rows, kept, agreeing: rows.select(
        *who, F.when(kept, F.col("n")).otherwise(0).alias("kept"), F.when(kept, F.col("one")).alias("only"), F.when(agreeing, F.col("n")).otherwise(0).alias("agreeing"), F.when(agreeing, F.col("one")).alias("agreed"),
    )
    timed = F.col("o_sec").isNotNull() & F.col("n_sec").isNotNull()
    cross = F.col("o_from_disk") != F.col("n_from_disk")
    fine = ~_against(F.col("tier"), refute)
    # Both have a time: a second, or across sources the greater of it and a share.
    wide = F.greatest(F.lit(model.SECONDS), F.lit(model.CROSS_TIME_SHARE / (1 - model.CROSS_TIME_SHARE)) * F.abs("o_sec"))
    bands = F.sequence(_time_band(F.col("o_sec") - wide), _time_band(F.col("o_sec") + wide))
    t = old.where(F.col("o_sec").isNotNull() & refutable).withColumn("band", F.explode(bands)).join(new.where("n_sec is not null").withColumn("band", _time_band(F.col("n_sec"))), [*cols, "band"])
    by_time = tally(t.where(fine), F.lit(True), F.lit(False))
    # Both have a size: what agrees in it, and, where a time is missing, what it does not refute.
    near = F.array_distinct(F.array(*[_size_band(F.col("o_kb") * f) for f in (1 - model.SIZE_SHARE, 1.0, 1 / (1 - model.SIZE_SHARE))]))
    s = old.where("o_kb is not null").withColumn("band", F.explode(near)).join(new.where("n_kb is not null").withColumn("band", _size_band(F.col("n_kb"))), [*cols, "band"])
    by_size = tally(s.where(fine), refutable & ~timed & ~cross, size_agrees(F.col("o_kb"), F.col("n_kb")))
    # Nothing speaks against the rest: no time in common, and no size that counts.
    kinds = new.groupBy(*cols, F.col("n_from_disk"), F.col("n_sec").isNull().alias("no_sec"), F.col("n_kb").isNull().alias("no_kb")).agg(F.sum("n").alias("n"), F.min("one").alias("one"))
    free = old.join(kinds, cols).where((F.col("o_sec").isNull() | F.col("no_sec")) & (cross | F.col("o_kb").isNull() | F.col("no_kb")) & refutable)
    by_none = tally(free, F.lit(True), F.lit(False))
    all_of_them = tally(old.where(~refutable).join(new.groupBy(*cols).agg(F.sum("n").alias("n"), F.min("one").alias("one")), cols), F.lit(True), F.lit(False))
    sums = by_time.unionByName(by_size).unionByName(by_none).unionByName(all_of_them).groupBy(*who).agg(
        F.sum("kept").alias("kept"), F.min("only").alias("only"), F.sum("agreeing").alias("agreeing"), F.min("agreed").alias("agreed")
    )
    total = new.groupBy(*cols).agg(F.sum("n").alias("total"))
    rows = a.join(total, cols).alias("l").join(
        sums.alias("r"), [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) if c in ("o_kb", "o_sec") else F.col(f"l.{c}") == F.col(f"r.{c}") for c in who], "left"
    )
    kept = F.coalesce("r.kept", F.lit(0))
    return rows.select(
        "l.o_rid", "l.rank", "l.tier", kept.alias("kept"), (F.col("l.total") - kept).alias("dropped"), F.coalesce("r.agreeing", F.lit(0)).alias("agreeing"), F.col("r.only").alias("only"), F.col("r.agreed").alias("agreed"),
    )


def match(old: DataFrame, new: DataFrame, level: str = "strict", refute: bool = True, providers: DataFrame | None = None) -> DataFrame:
    """One row per old record: (rid, primary_key, outcome, tier, new_rid, new_key).

    The first tier with exactly one candidate left (or exactly one that agrees in size)
    matches. A record with several candidates on some tier and no match is ambiguous; one
    whose candidates were all refuted is refuted, which counts as unmatched; the rest is unmatched.
    A provider row with ``ambiguous`` set (a column it may have) says that the provider itself found several:
    its record is ambiguous, whatever the other tiers hold.
    """
    cols = ["rank", "tier", "key"]
    a, b, hot = _sides(old, new, level, providers)
    some = not hot.isEmpty()
    # A record has a row for each tier: what its table weighs says nothing of them, so no side is sent through the driver.
    met = (a.join(hot, cols, "left_anti") if some else a).join(b.hint("merge"), cols)
    met = met.withColumn("refuted", _against(F.col("tier"), refute)).withColumn("agrees", size_agrees(F.col("o_kb"), F.col("n_kb")))
    one = F.struct("n_rid", "n_primary_key")
    by_tier = met.groupBy("o_rid", "rank", "tier").agg(
        F.count_if(~F.col("refuted")).alias("kept"),
        F.count_if("refuted").alias("dropped"),
        F.count_if(~F.col("refuted") & F.col("agrees")).alias("agreeing"),
        F.min(F.when(~F.col("refuted"), one)).alias("only"),
        F.min(F.when(~F.col("refuted") & F.col("agrees"), one)).alias("agreed"),
    )
    if some:
        by_tier = by_tier.unionByName(_hot_counts(a.join(hot, cols, "left_semi"), b.join(hot, cols, "left_semi"), refute))
    by_tier = by_tier.withColumn("pick", F.when(F.col("kept") == 1, F.col("only")).when((F.col("kept") > 1) & (F.col("agreeing") == 1), F.col("agreed")))
    done = by_tier.groupBy("o_rid").agg(
        F.min(F.when(F.col("pick").isNotNull(), F.struct("rank", "tier", "pick"))).alias("win"),
        F.max((F.col("kept") > 1) & F.col("pick").isNull()).alias("several"),
        F.max(F.col("dropped") > 0).alias("refuted"),
    )
    rows = old.select("rid", "primary_key").join(done, F.col("rid") == F.col("o_rid"), "left").join(_stopped(old, providers), "rid", "left")
    rows = rows.withColumn("win", F.when(F.col("stopped").isNull(), F.col("win"))).withColumn("several", F.col("several") | F.col("stopped"))
    outcome = (
        F.when(F.col("win").isNotNull(), "matched").when(F.col("several"), "ambiguous").when(F.col("refuted"), "refuted").otherwise("unmatched")
    )
    return rows.select(
        "rid", "primary_key", outcome.alias("outcome"), F.col("win.tier").alias("tier"), F.col("win.pick.n_rid").alias("new_rid"), F.col("win.pick.n_primary_key").alias("new_key")
    )


def _stopped(old: DataFrame, providers: DataFrame | None) -> DataFrame:
    """(rid, stopped) of the old records that a provider calls ambiguous."""
    if providers is None or "ambiguous" not in providers.columns:
        return old.select("rid", F.lit(True).alias("stopped")).where("false")
    return providers.where("side = 'old' and ambiguous").select("rid", F.lit(True).alias("stopped")).distinct()


def match_stats(matched: DataFrame) -> DataFrame:
    """(counter, value): matched, matched per tier, ambiguous, unmatched (with refuted) and refuted."""
    counters = [("matched", F.count_if(F.col("outcome") == "matched"))]
    counters += [(f"matched_{t}", F.count_if(F.col("tier") == t)) for t, _ in model.TIERS]
    counters += [
        ("ambiguous", F.count_if(F.col("outcome") == "ambiguous")),
        ("unmatched", F.count_if(F.col("outcome").isin("unmatched", "refuted"))),
        ("refuted", F.count_if(F.col("outcome") == "refuted")),
    ]
    row = matched.agg(*[c.alias(n) for n, c in counters])
    return row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("counter"), F.col(n).alias("value")) for n, _ in counters])))


def one_to_one(matched: DataFrame) -> DataFrame:
    """Matches whose destination no other record claims."""
    won = matched.where("outcome = 'matched'")
    claims = won.groupBy("new_key").agg(F.count(F.lit(1)).alias("claims"))
    return won.join(claims, "new_key").withColumn("outcome", F.when(F.col("claims") > 1, "destination_collision").otherwise("matched")).select(
        "rid", "primary_key", "outcome", "tier", "new_rid", "new_key"
    )


def ambiguous_records(old: DataFrame, new: DataFrame, matched: DataFrame, level: str, providers: DataFrame | None = None) -> DataFrame:
    """(rid, many) of the old records without a match: whether some key of theirs meets several new records, whatever size and time say."""
    open_rows = matched.where("outcome <> 'matched'").select("rid")
    left = tier_keys(old, level).join(open_rows, "rid", "left_semi").select("rid", "rank", "key")
    crowd = tier_keys(new, level).groupBy("rank", "key").agg((F.count(F.lit(1)) > 1).alias("many"))
    reason = left.join(crowd, ["rank", "key"]).select("rid", "many").unionByName(_stopped(old, providers).withColumnRenamed("stopped", "many"))
    return reason.groupBy("rid").agg(F.max("many").alias("many"))


def ambiguity_report(old: DataFrame, new: DataFrame, matched: DataFrame, level: str, providers: DataFrame | None = None) -> DataFrame:
    """(artist, title, old_path, reason) of the records without a match."""
    open_rows = matched.where("outcome <> 'matched'").select("rid")
    reason = ambiguous_records(old, new, matched, level, providers)
    return old.join(open_rows, "rid", "left_semi").join(reason, "rid", "left").select(
        "artist", "title", paths.decoded_path(F.col("dir"), F.col("file")).alias("old_path"), F.when(F.col("many"), "ambiguous").otherwise("unmatched").alias("reason")
    )


def refutation_details(old: DataFrame, new: DataFrame, level: str) -> DataFrame:
    """Every refuted candidate with what speaks against it."""
    met = candidates(old, new, level).where("refuted")
    gap = lambda a, b: F.round(F.abs(F.col(a) - F.col(b)), 6)
    return met.select(
        F.col("o_rid").alias("rid"), "tier", F.col("n_rid").alias("new_rid"), gap("o_kb", "n_kb").alias("size_gap"), gap("o_sec", "n_sec").alias("time_gap")
    )


def reviews(old: DataFrame, new: DataFrame, level: str) -> DataFrame:
    """(rid, tier, kept, refuted): candidates of each record and tier."""
    return candidates(old, new, level).groupBy(F.col("o_rid").alias("rid"), "tier").agg(
        F.count_if(~F.col("refuted")).alias("kept"), F.count_if("refuted").alias("refuted")
    )


def review_rows(old: DataFrame, new: DataFrame, level: str) -> DataFrame:
    """(rid, status, confidence) as a reviewer sees it: a match to another file type is `format`."""
    suffix = lambda c: F.lower(F.regexp_extract(c, r"\.([^.]*)$", 1))
    won = match(old, new, level)
    # Names take many times the room of the compressed table that they come from.
    files = [f.hint("merge") for f in (old.select("rid", F.col("file").alias("of")), new.select(F.col("rid").alias("new_rid"), F.col("file").alias("nf")))]
    rows = won.join(files[0], "rid").join(files[1], "new_rid", "left")
    label = F.when(F.col("tier").isNull(), "None").when(F.col("tier").isin(model.STRONG), "Strong").when(F.col("tier").isin(model.GOOD), "Good").otherwise("Weak")
    status = F.when((F.col("outcome") == "matched") & (suffix("of") != suffix("nf")), "format").otherwise(F.col("outcome"))
    return rows.select("rid", status.alias("status"), label.alias("confidence"))


def rank_backups(target: DataFrame, backups: DataFrame, level: str, source: str = "source_file", limit: int | None = None) -> DataFrame:
    """Each backup (old side) matched with the target: counts and the share matched, best first.

    All backups are matched in one pass: their records get an id per file, and the outcome is grouped by file.
    """
    sizes = backups.groupBy(source).agg(F.count(F.lit(1)).alias("entries"))
    won = match(backups, target, level).join(backups.select("rid", source), "rid")
    counts = won.groupBy(source).agg(
        F.count_if(F.col("outcome") == "matched").alias("matched"), F.count_if(F.col("outcome") == "ambiguous").alias("ambiguous"),
        F.count_if(F.col("outcome").isin("unmatched", "refuted")).alias("unmatched"),
    )
    ranked = sizes.join(counts, source).withColumn("ratio", F.round(F.col("matched") / F.col("entries"), 6))
    ranked = ranked.orderBy(F.desc("matched"), F.desc("ratio"), "ambiguous", source)
    return ranked if limit is None else ranked.limit(limit)
