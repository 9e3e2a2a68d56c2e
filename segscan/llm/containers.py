"""Filling containers of fixed capacity with texts, by a local search of exchanges.

Texts are counted in tokens where they are read, spread by hash over blocks of many containers, and each block is
filled by itself: the texts are first put one after the other, a new container begun where one does not fit. Then moves,
one-for-one and two-for-one exchanges carry tokens from the emptiest container to fuller ones. Each step raises the sum of
squared fills, so the search ends; a container that becomes empty is saved.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segscan.llm.words import spread

CAPACITY = 2048
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Containers that one task fills: the space a block may lose in its last one is a thousandth of its size.
BLOCK_CONTAINERS = 1_000
# Fixed value: how the public byte-level vocabularies part a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def _tokenizer(ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def encoding(vocabulary: str | bytes):
    """The tokenizer of a vocabulary file of ranks, or of its content, made once per worker."""
    if isinstance(vocabulary, str):
        with open(vocabulary, "rb") as f:
            vocabulary = f.read()
    return _tokenizer(vocabulary)


def pieces(n_tokens: int, capacity: int) -> list[int]:
    """Sizes of the pieces of a text: itself, or full containers and the rest if it exceeds the capacity."""
    return [capacity] * (n_tokens // capacity) + ([n_tokens % capacity] if n_tokens % capacity else [])


def first_filling(sizes: list[int], capacity: int) -> list[int]:
    """The container of each item in the given order: the last one begun, or a new one where it has no room."""
    out, used, room = [], -1, 0
    for x in sizes:
        if used < 0 or x > room:
            used, room = used + 1, capacity
        out.append(used)
        room -= x
    return out


def improve(sizes: np.ndarray, place: np.ndarray, capacity: int) -> np.ndarray:
    """Containers after the local search, numbered from 0 without gaps."""
    place = place.copy()
    fill = np.bincount(place, weights=sizes).astype(np.int64) if len(sizes) else np.zeros(0, np.int64)
    least_needed = -(-int(sizes.sum()) // capacity)
    stuck = np.zeros(len(fill), bool)
    while (fill > 0).sum() > least_needed:
        open_ = np.flatnonzero((fill > 0) & (fill < capacity) & ~stuck)
        if len(open_) < 2:
            break
        b = int(open_[np.argmin(fill[open_])])
        room = capacity - fill
        room[(fill == 0) | (fill < fill[b])] = 0
        room[b] = 0
        if room.sum() < fill[b]:
            stuck[b] = True
            continue
        mine = np.flatnonzero(place == b)
        mine = mine[np.argsort(-sizes[mine], kind="stable")]
        step: tuple[list[int], int | None, int] | None = None  # items of b, item in exchange, to where
        for i in mine.tolist():
            fits = np.flatnonzero(room >= sizes[i])
            if len(fits):
                step = ([i], None, int(fits[np.argmin(room[fits])]))
                break
        if step is None:
            out_room = room[place]
            best = 0
            pairs = [[i] for i in mine.tolist()] + [[int(i), int(j)] for n, i in enumerate(mine) for j in mine[n + 1 :]]
            for group in pairs:
                x = int(sizes[group].sum())
                if x <= best:
                    continue
                gain = np.where((sizes < x) & (x - sizes <= out_room), x - sizes, 0)
                j = int(np.argmax(gain))
                if gain[j] > best:
                    best, step = int(gain[j]), (group, j, int(place[j]))
        if step is None:
            stuck[b] = True
            continue
        group, back, a = step
        moved = int(sizes[group].sum()) - (int(sizes[back]) if back is not None else 0)
        place[group] = a
        if back is not None:
            place[back] = b
        fill[a] += moved
        fill[b] -= moved
        stuck[[a, b]] = False
    return np.unique(place, return_inverse=True)[1] if len(place) else place


def fill_containers(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, block_containers: int = BLOCK_CONTAINERS) -> DataFrame:
    """``doc_id, piece, n_tokens, container_id``: one row per text, several (piece from 0) for one longer than the capacity.

    ``docs``: doc_id, text. Null and empty texts take no room and give no row; equal rows each get a place; other
    columns don't matter. No container holds more than ``capacity`` tokens. The vocabulary (a file of the driver, about
    a megabyte) goes with the job.
    """
    with open(vocabulary, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(ranks.value)
        for pdf in batches:
            rows = [(d, k, n) for d, t in zip(pdf["doc_id"], pdf["text"]) for k, n in enumerate(pieces(len(enc.encode_ordinary(t)), capacity))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "n_tokens"])

    from segscan.sources.tables import checkpointed

    items = spread(docs.select("doc_id", "text").filter(F.length("text") > 0), "doc_id").mapInPandas(count, f"doc_id {kind}, piece int, n_tokens int")
    items = checkpointed(items)  # used twice; three numbers per text
    total = items.agg(F.sum("n_tokens")).first()[0] or 0
    blocks = max(1, -(-int(total) // (capacity * block_containers)))
    whole = items.filter(F.col("n_tokens") == capacity).select("doc_id", "piece", "n_tokens", F.concat_ws("-", F.lit("full"), "doc_id", "piece").alias("container_id"))

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "n_tokens"], ignore_index=True)
        sizes = pdf["n_tokens"].to_numpy(np.int64)
        place = improve(sizes, np.array(first_filling(sizes.tolist(), capacity), np.int64), capacity)
        return pdf.assign(container_id=[f"{key[0]}-{p}" for p in place])[["doc_id", "piece", "n_tokens", "container_id"]]

    block = F.pmod(F.xxhash64("doc_id", "piece", "n_tokens"), F.lit(blocks)).alias("block")
    part = items.filter(F.col("n_tokens") < capacity).select("*", block).groupBy("block").applyInPandas(lambda key, pdf: fill(key, pdf.drop(columns="block")), f"doc_id {kind}, piece int, n_tokens int, container_id string")
    return part.unionByName(whole)
