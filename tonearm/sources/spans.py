"""Verbatim writing of collection documents: what is not changed keeps its bytes.

A document is cut into spans of elements by byte offsets. Entries and playlists are left out,
patched, redirected or added, counts are set again, and every other byte - heads, sets,
indexes, attributes nobody knows, white space - is copied as it stands.
"""

from __future__ import annotations

import os
import re
import xml.parsers.expat
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.sources import collection_xml as cx

_TAG = re.compile(rb"""<(?:[^<>"']|"[^"]*"|'[^']*')*>""")
RAW = "collection_id string, ord long, key string, raw string"


@dataclass
class Span:
    """An element: where it starts and ends, where its content does, and which of its kind it is below its parent."""

    tag: str
    attributes: dict[str, str]
    parent: int
    ordinal: int
    start: int
    inside: int
    close: int = 0
    end: int = 0


def elements(data: bytes) -> list[Span]:
    """All elements of a document in order. ordinal counts elements of the same tag below one parent, from 0."""
    found: list[Span] = []
    above: list[int] = []
    seen: list[Counter] = [Counter()]
    parser = xml.parsers.expat.ParserCreate()

    def opened(tag: str, attributes: dict[str, str]) -> None:
        at = parser.CurrentByteIndex
        found.append(Span(tag, attributes, above[-1] if above else -1, seen[-1][tag], at, _TAG.match(data, at).end()))
        seen[-1][tag] += 1
        seen.append(Counter())
        above.append(len(found) - 1)

    def closed(_: str) -> None:
        span = found[above.pop()]
        seen.pop()
        if data[span.inside - 2 : span.inside] == b"/>":
            span.close = span.end = span.inside
        else:
            span.close = parser.CurrentByteIndex
            span.end = data.index(b">", span.close) + 1

    parser.StartElementHandler, parser.EndElementHandler = opened, closed
    parser.Parse(data, True)
    return found


def location_key(spans: list[Span], entry: int) -> str | None:
    """Key of an entry's location; None without one."""
    place = next((s.attributes for s in spans[entry + 1 :] if s.parent == entry and s.tag == "LOCATION"), None) if entry + 1 < len(spans) else None
    return None if place is None else place.get("VOLUME", "") + place.get("DIR", "") + place.get("FILE", "")


@dataclass
class Changes:
    """What a new document has other than its source.

    drop: keys of collection entries left out; patches: key -> attributes; add: texts of entries put at the end of the
    collection; playlists: path (names joined by a backslash) -> its keys in order; nodes: texts of playlist nodes put
    into the root folder.
    """

    drop: set[str] = field(default_factory=set)
    patches: dict[str, dict[str, str]] = field(default_factory=dict)
    add: list[str] = field(default_factory=list)
    playlists: dict[str, list[str]] = field(default_factory=dict)
    nodes: list[str] = field(default_factory=list)


def splice(data: bytes, changes: Changes) -> tuple[bytes, dict[str, int]]:
    """(document, what was done). A patch or playlist that fits nothing in the source is an error."""
    spans = elements(data)
    children: dict[int, list[int]] = {}
    for i, s in enumerate(spans):
        children.setdefault(s.parent, []).append(i)
    below = lambda i, tag: [k for k in children.get(i, []) if spans[k].tag == tag]
    edits: list[tuple[int, int, bytes]] = []
    done = Counter(dropped=0, patched=0, added=len(changes.add), playlists=0, nodes=len(changes.nodes))
    wanted = set(changes.patches)

    def count(i: int, attribute: str, number: int) -> None:
        tag = data[spans[i].start : spans[i].inside].decode()
        new = cx.recount(tag, attribute, number)
        if new != tag:
            edits.append((spans[i].start, spans[i].inside, new.encode()))

    def fill(i: int, text: str) -> None:
        """Text at the end of an element; an empty one is opened."""
        s = spans[i]
        if s.close == s.end:
            edits.append((s.inside - 2, s.inside, f">{text}</{s.tag}>".encode()))
        else:
            edits.append((s.close, s.close, text.encode()))

    for c in [c for r in children.get(-1, []) for c in below(r, "COLLECTION")]:
        entries = below(c, "ENTRY")
        kept = len(entries)
        for e in entries:
            place = next((spans[k].attributes for k in below(e, "LOCATION")), None)
            key = None if place is None else place.get("VOLUME", "") + place.get("DIR", "") + place.get("FILE", "")
            if key in changes.drop:
                edits.append((spans[e].start, spans[e].end, b""))
                done["dropped"] += 1
                kept -= 1
            elif key in changes.patches:
                old = data[spans[e].start : spans[e].end].decode()
                new = cx.set_entry_attributes(old, changes.patches[key])
                wanted.discard(key)
                if new != old:
                    edits.append((spans[e].start, spans[e].end, new.encode()))
                    done["patched"] += 1
        if changes.add:
            fill(c, "".join(changes.add))
        if kept + len(changes.add) != len(entries):
            count(c, "ENTRIES", kept + len(changes.add))
    if wanted:
        raise cx.PatchError(f"no entry for {sorted(wanted)[0]!r}")

    open_lists = dict(changes.playlists)

    def walk(node: int, path: str) -> None:
        for folder in below(node, "SUBNODES"):
            for n in below(folder, "NODE"):
                name = spans[n].attributes.get("NAME", "")
                own = f"{path}\\{name}" if path else name
                for p in below(n, "PLAYLIST"):
                    keys = open_lists.pop(own, None)
                    if keys is None:
                        continue
                    old = below(p, "ENTRY")
                    # An entry that stays keeps its own text, whatever else it holds.
                    texts: dict[str, list[str]] = {}
                    for e in old:
                        for k in below(e, "PRIMARYKEY"):
                            texts.setdefault(spans[k].attributes.get("KEY", ""), []).append(data[spans[e].start : spans[e].end].decode())
                    rows = [texts[k].pop(0) if texts.get(k) else f'<ENTRY><PRIMARYKEY TYPE="TRACK" KEY={cx.quoted(k)}></PRIMARYKEY></ENTRY>' for k in keys]
                    count(p, "ENTRIES", len(rows))
                    if old:
                        edits.append((spans[old[0]].start, spans[old[-1]].end, "".join(rows).encode()))
                    elif rows:
                        fill(p, "".join(rows))
                    done["playlists"] += 1
                walk(n, own)

    for r in children.get(-1, []):
        for top in below(r, "PLAYLISTS"):
            for root in below(top, "NODE"):
                walk(root, "")
                for folder in below(root, "SUBNODES")[:1] if changes.nodes else []:
                    fill(folder, "".join(changes.nodes))
                    count(folder, "COUNT", len(below(folder, "NODE")) + len(changes.nodes))
    if open_lists:
        raise cx.PatchError(f"no playlist {sorted(open_lists)[0]!r}")
    out, at = [], 0
    for start, end, text in sorted(edits, key=lambda x: (x[0], x[1])):
        out += [data[at:start], text]
        at = max(at, end)
    return b"".join([*out, data[at:]]), dict(done)


def read_raw_entries(spark: SparkSession, path: str) -> DataFrame:
    """(collection_id, ord, key, raw) of the collection entries of all documents below a path, as they stand; documents are cut in parallel."""
    import pandas as pd

    def rows(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                data = bytes(content)
                spans = elements(data)
                homes = {i for i, s in enumerate(spans) if s.tag == "COLLECTION"}
                got = [(name, s.ordinal, location_key(spans, i), data[s.start : s.end].decode()) for i, s in enumerate(spans) if s.tag == "ENTRY" and s.parent in homes]
                yield pd.DataFrame(got, columns=["collection_id", "ord", "key", "raw"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(rows, RAW)


def read_outside_locations(spark: SparkSession, path: str) -> DataFrame:
    """(collection_id, ord, volume, dir, file) of locations that stand outside the collection (in sets, histories and the like)."""
    import pandas as pd

    def rows(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                spans = elements(bytes(content))
                homes = {i for i, s in enumerate(spans) if s.tag == "COLLECTION"}
                inside = lambda i: i >= 0 and (i in homes or inside(spans[i].parent))
                got = [(name, n, *(s.attributes.get(a, "") for a in ("VOLUME", "DIR", "FILE"))) for n, s in enumerate(spans) if s.tag == "LOCATION" and not inside(s.parent)]
                yield pd.DataFrame(got, columns=["collection_id", "ord", "volume", "dir", "file"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(rows, "collection_id string, ord long, volume string, dir string, file string")


@dataclass(frozen=True)
class WriteOutcome:
    """What a run did or, as a dry run, would do."""

    source: str
    target: str
    changes: int
    written: bool


def plan_and_write(source: str, target: str, plan: Callable[[bytes], tuple[bytes, int]], dry_run: bool = False) -> WriteOutcome:
    """Read, change and write one document. The target is never the source, and appears whole or not at all; a dry run writes nothing."""
    cx.refuse_same_file(source, target)
    with open(source, "rb") as f:
        data = f.read()
    out, changes = plan(data)
    elements(out)
    if not dry_run:
        part = f"{target}.part"
        try:
            with open(part, "wb") as f:
                f.write(out)
            os.replace(part, target)
        finally:
            if os.path.exists(part):
                os.unlink(part)
    return WriteOutcome(source, target, changes, not dry_run)


def patch_plan(changes: DataFrame) -> Callable[[bytes], tuple[bytes, int]]:
    """Plan from a table of changed references (kind `key` or `location`, old_key, new_key, volume, volumeid, dir, file).

    The changes of one document are brought to the driver that writes it. Two different new values of one key are an error.
    """
    twice = changes.groupBy("kind", "old_key").agg(F.count_distinct(F.struct("new_key", "volume", "volumeid", "dir", "file")).alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise cx.PatchError(f"contradicting changes of {twice[0]['old_key']!r}")
    rows = changes.distinct().collect()
    keys = {r["old_key"]: r["new_key"] for r in rows if r["kind"] == "key"}
    places = {r["old_key"]: (r["volume"], r["volumeid"], r["dir"], r["file"]) for r in rows if r["kind"] == "location"}

    def plan(data: bytes) -> tuple[bytes, int]:
        text, n = cx.patch_references(data.decode("utf-8"), keys, places)
        return text.encode("utf-8"), n

    return plan
