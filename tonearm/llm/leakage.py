"""Held-out passages that stand, whole or in part, in a corpus.

Q-gram lemma filter: the character q-grams that a text shares with a passage are counted
in overlapping diagonal bands; a band with fewer than an edit budget leaves over holds no
copy. The regions that remain are verified by a banded alignment of words.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Length of a q-gram, width of a diagonal band, and positions hashed at a time.
Q, BAND, BLOCK = 11, 128, 1 << 20
#: Share of the passage's words that makes a leak, and the share of these that may be changed.
SHARE, CHANGED = 0.5, 0.25
#: Characters of passages indexed in one pass over the corpus: what is sent to the
#: executors stays under about 50 MB however many passages there are.
PASS_CHARS = 2_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BITS = 23
_TAG = re.compile(r"<[^<>\n]{1,200}>")


def _letters() -> np.ndarray:
    """Code point -> its folded form; 32 for what separates words, 1 for what shows nothing."""
    table = np.arange(0x30000, dtype=np.uint32)
    for code in range(0x30000):
        ch = chr(code)
        if ch.isalnum():
            low = ch.lower()
            table[code] = ord(low) if len(low) == 1 else code
        elif 0xD800 <= code < 0xE000:
            table[code] = 32
        else:
            kind = unicodedata.category(ch)
            table[code] = 1 if kind in ("Cf", "Mn") else 32
    return table


def normalise(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The folded characters of all texts in one array, each text between zeros, and where each starts.

    Letter case, punctuation, markup, entities and white space are gone; words stand apart by one space.
    """
    joined = "\0".join(t.replace("\0", " ") for t in texts)
    if "<" in joined:
        joined = _TAG.sub(" ", joined)
    if "&" in joined:
        joined = html.unescape(joined).replace("\0\0", "\0 ") if "&#0" in joined else html.unescape(joined)
    codes = np.frombuffer(("\0" + joined + "\0").encode("utf-32-le", "replace"), np.uint32)
    out = np.where(codes < len(table), table[np.minimum(codes, len(table) - 1)], codes)
    out[codes == 0] = 0
    out = out[out != 1]
    blank = out == 32
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    out = out[keep]
    return out, np.flatnonzero(out == 0)


def _hashes(chars: np.ndarray) -> np.ndarray:
    """A hash of the q-gram at each position."""
    n = len(chars) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    wide = chars.astype(np.uint64) + np.uint64(7)
    for j in range(Q):
        out *= _BASE
        out += wide[j : j + n]
    return out ^ (out >> np.uint64(29))


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - _BITS)


def _words(chars: np.ndarray) -> list[str]:
    return chars.astype("<u4").tobytes().decode("utf-32-le").split()


def build_index(items: list[tuple[int, str]], table: np.ndarray) -> dict:
    """Sorted q-grams of the passages with their passage and place, and a bitmap of their hashes."""
    chars, cuts = normalise([p for _, p in items], table)
    grams, owner, place, words = [], [], [], []
    for k in range(len(items)):
        own = chars[cuts[k] + 1 : cuts[k + 1]]
        h = _hashes(own)
        grams.append(h)
        owner.append(np.full(len(h), k, np.int32))
        place.append(np.arange(len(h), dtype=np.int32))
        words.append(_words(own))
    g = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
    order = np.argsort(g, kind="stable")
    bitmap = np.zeros(1 << _BITS, bool)
    bitmap[_slot(g)] = True
    # What the edit budget leaves over of the q-grams of half a passage, when every changed word costs its own and Q - 1 more.
    least = []
    for k, w in enumerate(words):
        need = int(np.ceil(len(w) * SHARE))
        span = len(" ".join(w)) * need / max(len(w), 1)
        per_word = span / max(need, 1)
        least.append(max(3, int(span - Q + 1 - CHANGED * need * (per_word + Q - 1))))
    return {"ids": [i for i, _ in items], "grams": g[order], "owner": np.concatenate(owner)[order] if grams else g, "place": np.concatenate(place)[order] if grams else g, "bitmap": bitmap, "least": np.array(least or [0]), "words": words, "starts": [np.cumsum([0, *(len(w) + 1 for w in ws)]) for ws in words]}


def aligned(passage: list[str], text: list[str], diagonal: int = 0, width: int | None = None) -> int:
    """Words of the passage matched by the best local alignment (match 1, change, gap or addition -1).

    Only text words within ``width`` of the place that the diagonal gives each word of the passage are looked at;
    without a width, all of them.
    """
    ids = {w: i for i, w in enumerate(dict.fromkeys(passage))}
    p, t = np.array([ids[w] for w in passage]), np.array([ids.get(w, -1) for w in text])
    m, n = len(p), len(t)
    if width is None:
        diagonal, width = 0, m + n
    # Cell (i, k) stands for word i of the passage and word i + low + k of the text.
    low, band = diagonal - width, 2 * width + 1
    padded = np.full(m + band + max(0, low) + max(n, 0) + abs(low) + 2, -1)
    shift = max(0, -low)
    padded[shift : shift + n] = t
    score = np.zeros((m + 1, band), np.int32)
    steps = np.arange(band, dtype=np.int32)
    for i in range(1, m + 1):
        at = i - 1 + low + shift
        row = score[i - 1] + np.where(padded[at : at + band] == p[i - 1], 1, -1)
        row[:-1] = np.maximum(row[:-1], score[i - 1, 1:] - 1)
        np.maximum(row, 0, out=row)
        score[i] = np.maximum.accumulate(row + steps) - steps
    i, k = np.unravel_index(int(score.argmax()), score.shape)
    hits = 0
    while i > 0 and score[i, k] > 0:
        same = padded[i - 1 + low + shift + k] == p[i - 1]
        if score[i, k] == score[i - 1, k] + (1 if same else -1):
            hits += int(same)
            i -= 1
        elif k + 1 < band and score[i, k] == score[i - 1, k + 1] - 1:
            i, k = i - 1, k + 1
        else:
            k -= 1
        if k < 0:
            break
    return hits


def search(texts: list[str], index: dict, table: np.ndarray) -> list[tuple[int, int, int]]:
    """(text number, item number, matched words) of all leaks in the texts."""
    chars, cuts = normalise(texts, table)
    found_pos, found_gram = [], []
    for at in range(0, max(len(chars) - Q + 1, 0), BLOCK):
        h = _hashes(chars[at : at + BLOCK + Q - 1])
        near = np.flatnonzero(index["bitmap"][_slot(h)])
        if not len(near):
            continue
        low = np.searchsorted(index["grams"], h[near], "left")
        high = np.searchsorted(index["grams"], h[near], "right")
        n = high - low
        near, low, n = near[n > 0], low[n > 0], n[n > 0]
        found_pos.append(np.repeat(near + at, n))
        found_gram.append(np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    if not found_pos:
        return []
    pos, gram = np.concatenate(found_pos), np.concatenate(found_gram)
    item, place = index["owner"][gram].astype(np.int64), index["place"][gram].astype(np.int64)
    doc = np.searchsorted(cuts, pos, "right") - 1
    # All bands of a text and a passage together must hold what a single one needs.
    pair = doc * len(index["ids"]) + item
    _, back, n = np.unique(pair, return_inverse=True, return_counts=True)
    enough = n[back] >= index["least"][item]
    pos, item, place, doc = pos[enough], item[enough], place[enough], doc[enough]
    diagonal = pos - cuts[doc] - place + (1 << 20)
    out: dict[tuple[int, int], int] = {}
    tried: set[tuple[int, int, int, int]] = set()
    for shift in (0, BAND // 2):
        band = (diagonal + shift) // BAND
        # A place of the passage counts once in a band.
        cell = np.unique(np.stack([doc, item, band, place], 1), axis=0)
        key, first, n = np.unique(cell[:, :3], axis=0, return_index=True, return_counts=True)
        for (d, k, b), f, count in zip(key.tolist(), first.tolist(), n.tolist(), strict=True):
            if count < index["least"][k]:
                continue
            start = cuts[d] + 1 + b * BAND - shift - (1 << 20)
            places = np.sort(cell[f : f + count, 3])
            a, z = max(cuts[d] + 1, start + int(places.min()) - 2 * BAND), min(cuts[d + 1], start + int(places.max()) + Q + 3 * BAND)
            if (d, k, a, z) in tried or a >= z:
                continue
            tried.add((d, k, a, z))
            words = index["words"][k]
            # The middle of the hits, as a word of the passage and of the region, is the diagonal of the alignment.
            middle = int(places[len(places) // 2])
            per_word = index["starts"][k][-1] / len(words)
            level = int(np.count_nonzero(chars[a : max(a, start + middle + BAND // 2)] == 32)) - int(np.searchsorted(index["starts"][k], middle, "right") - 1)
            hits = aligned(words, _words(chars[a:z]), level, int(BAND / per_word) + int(CHANGED * len(words)) + 2)
            if hits >= SHARE * len(index["words"][k]):
                out[d, k] = max(hits, out.get((d, k), 0))
    return [(d, k, n) for (d, k), n in out.items()]


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage") -> DataFrame:
    """(doc_id, item_id, matched_words) of every document with at least half of a passage's words in one stretch.

    Null and blank texts and passages match nothing; a document comes out once for each item
    that leaked into it. Passages are sent to the executors in groups of bounded size, one
    pass over the corpus for each group.
    """
    spark = documents.sparkSession
    schema = f"{doc_id} bigint, {item_id} bigint, matched_words int"
    asked = items.select(item_id, passage).where(f"trim({passage}) <> ''")
    size = asked.agg(F.sum(F.length(passage))).first()[0] or 0
    groups = -(-size // PASS_CHARS)
    letters = spark.sparkContext.broadcast(_letters())
    held = documents.select(doc_id, text).where(f"{text} is not null")
    out = spark.createDataFrame([], schema)
    for g in range(groups):
        # One group of passages at a time is in the driver.
        group = [(r[0], r[1]) for r in asked.where(F.pmod(F.xxhash64(item_id), F.lit(groups)) == g).orderBy(item_id).collect()]
        sent = spark.sparkContext.broadcast(group)

        def scan(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            table = letters.value
            index = build_index(sent.value, table)
            for pdf in batches:
                ids, texts = pdf.iloc[:, 0].tolist(), pdf.iloc[:, 1].tolist()
                hits, at = [], 0
                while at < len(texts):
                    size, to = 0, at
                    while to < len(texts) and (to == at or size + len(texts[to]) < 4 * BLOCK):
                        size += len(texts[to])
                        to += 1
                    hits += [(ids[at + d], index["ids"][k], n) for d, k, n in search(texts[at:to], index, table)]
                    at = to
                yield pd.DataFrame(hits, columns=[doc_id, item_id, "matched_words"])

        out = out.unionByName(held.mapInPandas(scan, schema))
    return out.groupBy(doc_id, item_id).max("matched_words").withColumnRenamed("max(matched_words)", "matched_words")
