"""Texts packed into containers of fixed capacity.

Each text is a vector of tokens, segments and loss-bearing tokens. Texts are spread over
shards of bounded size by a hash, and each shard is packed on its own: a container is open
and takes, of all pieces that still fit under every limit, the one with the greatest dot
product of its size and the room left (both as shares of the limits).
"""

from __future__ import annotations

import base64
import math
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.session import cut

#: Fixed value: how the byte-level tokenizer splits text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Texts packed together in one task.
SHARD_ROWS = 8_000


@dataclass(frozen=True)
class Limits:
    """Greatest tokens, segments and loss-bearing tokens of a container.

    The loss limit is the capacity unless a lower one is asked for, so a text that fits is never split.
    """

    tokens: int = 4096
    segments: int = 48
    loss: int = 4096


def _prompt_end(text: str) -> int:
    """Where the opening line or sentence ends: what stands before bears no loss."""
    m = re.search(r"\n|[.!?](?=\s)", text)
    return m.end() if m else 0


def count_tokens(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens, loss) of every whole text; null and empty texts have none."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for pdf in batches:
            out = []
            for i, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                end = _prompt_end(text)
                opening = len(encode(text[:end])) if end else 0
                rest = len(encode(text[end:]))
                out.append((i, opening + rest, rest))
            yield pd.DataFrame(out, columns=["doc_id", "tokens", "loss"])

    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInPandas(scan, "doc_id bigint, tokens int, loss int")


def split_large(sizes: DataFrame, limits: Limits) -> DataFrame:
    """(doc_id, piece, first_token, tokens, loss): texts that fit no container alone, in as few pieces as possible.

    All pieces but the last are as large as the limits allow; the opening bears no loss and comes first.
    """
    n_open = F.col("tokens") - F.col("loss")
    # Tokens of the first piece, and of each later one, which bears loss throughout.
    first = F.least(F.lit(limits.tokens), n_open + limits.loss)
    later = min(limits.tokens, limits.loss)
    rest = F.greatest(F.col("tokens") - first, F.lit(0))
    cuts = F.transform(
        F.sequence(F.lit(0), F.ceil(rest / later).cast("int")),
        lambda k: F.struct(k.alias("piece"), F.when(k == 0, 0).otherwise(first + (k - 1) * later).cast("int").alias("first_token")),
    )
    pieces = sizes.where("tokens > 0").select("doc_id", F.col("tokens").alias("all"), n_open.alias("opening"), first.alias("head"), F.inline(cuts))
    size = F.when(F.col("piece") == 0, F.least("all", "head")).otherwise(F.least(F.col("all") - F.col("first_token"), F.lit(later)))
    return pieces.select(
        "doc_id", "piece", "first_token", size.cast("int").alias("tokens"), F.greatest(F.least(size, F.col("first_token") + size - F.col("opening")), F.lit(0)).cast("int").alias("loss")
    ).where("tokens > 0")


def fill(tokens: np.ndarray, loss: np.ndarray, limits: Limits) -> np.ndarray:
    """Number of the container of each piece."""
    size, index = np.unique(np.stack([tokens, loss], 1), axis=0, return_inverse=True)
    waiting = [[] for _ in size]
    for row, k in enumerate(index.ravel().tolist()):
        waiting[k].append(row)
    left = np.array([len(w) for w in waiting])
    share = np.c_[size[:, 0] / limits.tokens, size[:, 1] / limits.loss]
    out = np.empty(len(tokens), np.int64)
    container, todo = 0, len(tokens)
    while todo:
        room_t, room_l, room_s = limits.tokens, limits.loss, limits.segments
        while room_s:
            fits = (size[:, 0] <= room_t) & (size[:, 1] <= room_l) & (left > 0)
            if not fits.any():
                break
            # Every piece takes one segment, so that share of the product is the same for all.
            value = np.where(fits, share[:, 0] * (room_t / limits.tokens) + share[:, 1] * (room_l / limits.loss), -1.0)
            k = int(value.argmax())
            out[waiting[k].pop()] = container
            left[k] -= 1
            room_t, room_l, room_s = room_t - size[k, 0], room_l - size[k, 1], room_s - 1
            todo -= 1
        container += 1
    return out


def pack(documents: DataFrame, limits: Limits = Limits(), vocabulary: str = VOCABULARY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, piece, first_token, tokens, loss_tokens, container_id) of every text.

    A text is split only when it alone exceeds a limit. Texts without a token come out once
    with no container. Rows of one doc_id are taken as separate texts.
    """
    pieces = cut(split_large(count_tokens(documents, vocabulary), limits))
    shards = max(1, math.ceil(pieces.count() / shard_rows))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "loss", "doc_id", "piece"], ignore_index=True)
        pdf["container_id"] = fill(pdf["tokens"].to_numpy(), pdf["loss"].to_numpy(), limits) + pdf["shard"].to_numpy() * 10_000_000
        return pdf[["doc_id", "piece", "first_token", "tokens", "loss", "container_id"]]

    sharded = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "tokens"), F.lit(shards)))
    packed = sharded.groupBy("shard").applyInPandas(place, "doc_id bigint, piece int, first_token int, tokens int, loss int, container_id bigint")
    none = documents.where("text is null or text = ''").select("doc_id", F.lit(0).alias("piece"), F.lit(0).alias("first_token"), F.lit(0).alias("tokens"), F.lit(0).alias("loss"), F.lit(None).cast("long").alias("container_id"))
    return packed.unionByName(none).withColumnRenamed("loss", "loss_tokens")


def containers(packed: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Load of each container: segments, tokens, loss-bearing tokens and the share of capacity left unused."""
    return (
        packed.where("container_id is not null")
        .groupBy("container_id")
        .agg(F.count(F.lit(1)).alias("segments"), F.sum("tokens").alias("tokens"), F.sum("loss_tokens").alias("loss_tokens"))
        .withColumn("unused", F.round(1 - F.col("tokens") / limits.tokens, 6))
    )
