"""Collection documents (XML) as tables, and back.

A document is one tree whose order matters, so each file is parsed in one task and the
position of every element is kept as a column. Many documents are read in parallel.
"""

from __future__ import annotations

import os
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRACKS = (
    "collection_id string, ord long, artist string, title string, audio_id string, filesize string, playtime_float string, bitrate string, album string, "
    "volume string, volumeid string, dir string, file string, primary_key string"
)
NODES = "collection_id string, node_id long, parent_id long, ord long, node_type string, node_name string, node_path string, node_depth int, declared_entries int, uuid string"
ENTRIES = "collection_id string, node_id long, pos int, key_type string, key string"
SORTING = "collection_id string, ord int, path string, raw string"
PROBLEMS = "collection_id string, problem string"


def _location(entry: ET.Element) -> dict[str, str] | None:
    loc = entry.find("LOCATION")
    if loc is None:
        return None
    volume = loc.get("VOLUME", "")
    return {"volume": volume, "volumeid": loc.get("VOLUMEID", volume), "dir": loc.get("DIR", ""), "file": loc.get("FILE", "")}


def parse(content: bytes, name: str) -> dict[str, list[tuple]]:
    """Rows of each table of one document. Every attribute stays the document's own text; a missing one is empty."""
    root = ET.fromstring(content)
    out: dict[str, list[tuple]] = {"tracks": [], "nodes": [], "entries": [], "sorting": []}
    collection = root.find("COLLECTION")
    for i, e in enumerate(collection.iter("ENTRY") if collection is not None else ()):
        loc = _location(e)
        if loc is None:
            continue
        info, album = e.find("INFO"), e.find("ALBUM")
        read = lambda el, a: el.get(a, "") if el is not None else ""
        key = loc["volume"] + loc["dir"] + loc["file"]
        out["tracks"].append(
            (name, i, e.get("ARTIST", ""), e.get("TITLE", ""), e.get("AUDIO_ID", ""), read(info, "FILESIZE"), read(info, "PLAYTIME_FLOAT"), read(info, "BITRATE"), read(album, "TITLE"), *loc.values(), key)
        )
    counter = 0
    tops = root.findall("PLAYLISTS/NODE")
    stack = [(n, None, "", 0) for n in reversed(tops)]
    while stack:
        node, parent, path, depth = stack.pop()
        counter += 1
        me, kind, label = counter, node.get("TYPE", ""), node.get("NAME", "")
        own = "" if parent is None else label if not path else f"{path}\\{label}"
        lists = node.findall("PLAYLIST")
        declared = lists[0].get("ENTRIES") if lists else None
        out["nodes"].append((name, me, parent, me, kind, label, own, depth, int(declared) if declared and declared.isdigit() else None, lists[0].get("UUID") if lists else None))
        for pos, key in enumerate(k for p in lists for k in p.iter("PRIMARYKEY")):
            out["entries"].append((name, me, pos + 1, key.get("TYPE", ""), key.get("KEY", "")))
        if kind == "FOLDER":
            stack += [(n, me, own, depth + 1) for n in reversed(node.findall("SUBNODES/NODE"))]
    for i, s in enumerate(root.iter("SORTING_INFO")):
        out["sorting"].append((name, i, s.get("PATH", ""), ET.tostring(s, encoding="unicode").strip()))
    return out


def _files(spark: SparkSession, path: str) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if os.path.splitext(path)[1] == "":
        reader = reader.option("pathGlobFilter", "*.nml")
    return reader.load(path).select("path", "content")


def _table(spark: SparkSession, path: str, which: str, schema: str, strict: bool) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    got = parse(bytes(content), name)[which]
                except ET.ParseError:
                    if strict:
                        raise
                    continue
                yield pd.DataFrame(got, columns=names)

    return _files(spark, path).mapInPandas(rows, schema)


def read_tracks(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Tracks of one document, or of all below a folder. Without ``strict`` documents that cannot be parsed are passed over."""
    return _table(spark, path, "tracks", TRACKS, strict)


def read_nodes(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return _table(spark, path, "nodes", NODES, strict)


def read_entries(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return _table(spark, path, "entries", ENTRIES, strict)


def read_sorting(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return _table(spark, path, "sorting", SORTING, strict)


def problems(spark: SparkSession, path: str) -> DataFrame:
    """(collection_id, problem) of the documents that cannot be parsed."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bad = []
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    ET.fromstring(bytes(content))
                except ET.ParseError as error:
                    bad.append((name, str(error)))
            yield pd.DataFrame(bad, columns=["collection_id", "problem"])

    return _files(spark, path).mapInPandas(rows, PROBLEMS)


# --- writing ---------------------------------------------------------------------------------------

#: Characters escaped in an attribute, the ampersand first.
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;"), ("\t", "&#x9;"), ("\n", "&#xA;"), ("\r", "&#xD;")]
#: The rest of an opening tag: quoted values may hold any character but their quote.
_REST = r"""((?:[^<>"']|"[^"]*"|'[^']*')*?)(/?)>"""
#: Comments and sections of plain characters are no elements.
_OPENING = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<(LOCATION|PRIMARYKEY)\b" + _REST, re.S)
_ATTRIBUTE = re.compile(r"""([\w:.-]+)(\s*=\s*)("[^"]*"|'[^']*')""")


class PatchError(ValueError):
    """A change that contradicts another or fits no element."""


def quoted(value: str, quote: str = '"') -> str:
    """The value as an attribute in its quotes."""
    value = escape(value)
    return quote + (value.replace("'", "&apos;") if quote == "'" else value) + quote


def put_attributes(tag: str, values: dict[str, str]) -> str:
    """An opening tag with attributes set in place, in the quotes they have; new ones are put at its end."""
    left = dict(values)

    def put(m: re.Match) -> str:
        return m[1] + m[2] + quoted(left.pop(m[1]), m[3][0]) if m[1] in left else m[0]

    tag = _ATTRIBUTE.sub(put, tag)
    end = -2 if tag.endswith("/>") else -1
    return tag[:end] + "".join(f" {k}={quoted(v)}" for k, v in left.items()) + tag[end:]


def escape(value: str) -> str:
    for plain, escaped in ESCAPES:
        value = value.replace(plain, escaped)
    return value


def unescape(value: str) -> str:
    value = re.sub(r"&#x([0-9A-Fa-f]+);", lambda m: chr(int(m[1], 16)), re.sub(r"&#(\d+);", lambda m: chr(int(m[1])), value))
    for plain, escaped in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"), ("&", "&amp;")):
        value = value.replace(escaped, plain)
    return value


def patch_references(text: str, keys: dict[str, str], locations: dict[str, tuple[str, str, str, str]]) -> tuple[str, int]:
    """(text, changes): attribute values of references rewritten, every other byte as it was.

    ``keys`` maps a primary key to its new one; ``locations`` maps the key of a location to
    (volume, volumeid, dir, file). An entry that fits nothing in the text is an error.
    """
    used: set[tuple[str, str]] = set()
    changes = 0

    def swap(match: re.Match) -> str:
        nonlocal changes
        tag = match[1]
        if tag is None:
            return match[0]
        have = {m[1]: unescape(m[3][1:-1]) for m in _ATTRIBUTE.finditer(match[2])}
        if tag == "PRIMARYKEY":
            key = have.get("KEY", "")
            new = {"KEY": keys[key]} if key in keys else {}
        else:
            key = have.get("VOLUME", "") + have.get("DIR", "") + have.get("FILE", "")
            new = dict(zip(("VOLUME", "VOLUMEID", "DIR", "FILE"), locations[key], strict=True)) if key in locations else {}
        used.add((tag, key))
        new = {k: v for k, v in new.items() if have.get(k) != v}
        changes += bool(new)
        return put_attributes(match[0], new)

    out = _OPENING.sub(swap, text)
    lost = [("LOCATION", k) for k in locations if ("LOCATION", k) not in used] + [("PRIMARYKEY", k) for k in keys if ("PRIMARYKEY", k) not in used]
    if lost:
        raise PatchError(f"no {lost[0][0]} for {lost[0][1]!r}")
    return out, changes


def set_entry_attributes(entry: str, values: dict[str, str]) -> str:
    """One ENTRY's text with tracked attributes set; a missing carrier is added unless the value is empty."""
    carriers = {"artist": ("ENTRY", "ARTIST"), "title": ("ENTRY", "TITLE"), "album": ("ALBUM", "TITLE"), "filesize": ("INFO", "FILESIZE"), "playtime_float": ("INFO", "PLAYTIME_FLOAT"), "bitrate": ("INFO", "BITRATE")}
    for name, value in values.items():
        tag, attribute = carriers[name]
        opening = re.search(rf"<{tag}\b{_REST}", entry)
        if opening is None:
            if value:
                if entry.rstrip().endswith("/>"):
                    entry = entry.rstrip()[:-2].rstrip() + "></ENTRY>"
                end = entry.rindex("</ENTRY>")
                entry = f"{entry[:end]}<{tag} {attribute}={quoted(value)}></{tag}>{entry[end:]}"
            continue
        has = any(m[1] == attribute for m in _ATTRIBUTE.finditer(opening[0]))
        body = put_attributes(opening[0], {attribute: value}) if has or value else opening[0]
        entry = entry[: opening.start()] + body + entry[opening.end() :]
    return entry


def recount(opening: str, attribute: str, number: int) -> str:
    """The opening tag with its count set; a tag that has no count stays without."""
    return put_attributes(opening, {attribute: str(number)}) if any(m[1] == attribute for m in _ATTRIBUTE.finditer(opening)) else opening


def playlist_node(name: str, keys: list[str], uuid: str) -> str:
    rows = "".join(f'<ENTRY><PRIMARYKEY TYPE="TRACK" KEY="{escape(k)}"></PRIMARYKEY></ENTRY>' for k in keys)
    return f'<NODE TYPE="PLAYLIST" NAME="{escape(name)}"><PLAYLIST ENTRIES="{len(keys)}" TYPE="LIST" UUID="{uuid}">{rows}</PLAYLIST></NODE>'


def write_collection(tracks: DataFrame, path: str, playlists: DataFrame | None = None) -> int:
    """Write one document in order of ``ord``, row by row; returns the number of tracks.

    For a document without a source. What was read from one is written by ``spans``, which keeps all else as it stands.
    A document is one file, so rows are streamed through the driver one partition at a time.
    ``playlists`` has (name, uuid, pos, key).
    """
    order = tracks.orderBy("ord")
    with atomic(path) as out:
        out.write(f'<?xml version="1.0" encoding="UTF-8" standalone="no" ?>\n<NML VERSION="20"><COLLECTION ENTRIES="{tracks.count()}">')
        n = 0
        for r in order.toLocalIterator():
            a = {k: escape(r[k] or "") for k in ("artist", "title", "audio_id", "album", "filesize", "playtime_float", "bitrate", "volume", "volumeid", "dir", "file")}
            out.write(
                f'<ENTRY TITLE="{a["title"]}" ARTIST="{a["artist"]}" AUDIO_ID="{a["audio_id"]}"><LOCATION DIR="{a["dir"]}" FILE="{a["file"]}" VOLUME="{a["volume"]}" VOLUMEID="{a["volumeid"]}"></LOCATION>'
                + (f'<ALBUM TITLE="{a["album"]}"></ALBUM>' if a["album"] else "")
                + f'<INFO BITRATE="{a["bitrate"]}" PLAYTIME_FLOAT="{a["playtime_float"]}" FILESIZE="{a["filesize"]}"></INFO></ENTRY>\n'
            )
            n += 1
        out.write("</COLLECTION>")
        lists = [] if playlists is None else playlists.groupBy("name", "uuid").agg(F.sort_array(F.collect_list(F.struct("pos", "key"))).alias("rows")).orderBy("name").toLocalIterator()
        nodes = [playlist_node(r["name"], [x["key"] for x in r["rows"]], r["uuid"]) for r in lists]
        out.write(f'<PLAYLISTS><NODE TYPE="FOLDER" NAME="$ROOT"><SUBNODES COUNT="{len(nodes)}">' + "".join(nodes) + "</SUBNODES></NODE></PLAYLISTS></NML>\n")
    return n


class atomic:
    """A text file that appears whole or not at all."""

    def __init__(self, path: str):
        self.path, self.part = path, f"{path}.part"

    def __enter__(self):
        self.file = open(self.part, "w", encoding="utf-8", newline="")
        return self.file

    def __exit__(self, kind, *rest):
        self.file.close()
        if kind is None:
            os.replace(self.part, self.path)
        else:
            os.unlink(self.part)


def refuse_same_file(source: str, target: str) -> None:
    """Output over its own input is refused."""
    if os.path.realpath(source) == os.path.realpath(target):
        raise ValueError(f"the output {target!r} is the input")


def write_report(rows: DataFrame, path: str, columns: list[str]) -> int:
    """A report as one CSV file with a header; without rows only the header. Returns the number of rows."""
    import csv

    with atomic(path) as out:
        w = csv.writer(out, lineterminator="\n")
        w.writerow(columns)
        n = 0
        for r in rows.select(columns).toLocalIterator():
            w.writerow(["" if v is None else f"{v:.3f}" if isinstance(v, float) else v for v in r])
            n += 1
    return n


def stats_lines(stats: DataFrame, samples: list[str] = ()) -> list[str]:
    """`counter=value` lines in order, then up to ten samples."""
    return [f"{r['counter']}={r['value']}" for r in stats.toLocalIterator()] + list(samples)[:10]
