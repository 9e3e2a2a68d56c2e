"""Evaluation texts in training text, by greedy string tiling.

1. Seeds: a document and an item are joined on shared tokens. Of each passage the rarest words are its seeds; a
   stretch that holds enough of them, and then enough words of the passage, is tiled, and so is the surrounding of every run
   of ``RUN_WORDS`` shared words. All are necessary conditions of a leak, so the join loses none.
2. Tiling: the longest matches that overlap no match already marked are marked, found by running Karp-Rabin hashes of
   falling length, down to ``TILE_WORDS`` words. A tile of ``RUN_WORDS`` words is a leak. So are tiles that stand in their
   order, with the single words that fit in between, if they hold ``SHARE`` of the passage within a stretch of bounded
   length, and half of that by themselves. Tiles that hold ``SHARE`` of the passage in another order are a passage whose parts were moved: that is reported
   as such. What has its words scattered, too little of it under tiles, is neither.
3. Check: tiles are marked greedily, so a pair that they don't prove a leak is counted once more, exactly: the words of
   the passage that stand in their order within the stretch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segscan.llm.words import scatter, spread, word_hashes

#: Words in a row that are a leak by themselves.
RUN_WORDS = 16
#: Share of the passage's words that is one, in order within ``STRETCH`` times its length.
SHARE = 0.7
STRETCH = 1.5
#: The shortest tile; single words count beside tiles only.
TILE_WORDS = 3
#: Characters of passages that are broadcast as one index: only a larger item table needs another pass over the documents.
BLOCK_CHARS = 16_000_000
#: Items that are searched for at once, and how often their seeds may be met in the words searched at once.
PART_ITEMS = 2_000
MOST_MET = 2_000_000
#: Characters of texts that are read at once (a longer text is read alone), and words that are searched at once.
READ_CHARS = 400_000
PIECE_WORDS = 100_000
#: Items times words up to which word counts are kept as a table.
MOST_CELLS = 1 << 24
#: Lengths up to which the tiling keeps its hashes.
_SHORT = 64
_PRIME = np.uint64(1_099_511_628_211)


def rolling(ids: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hashes (mod 2**64) of all stretches of ``length`` numbers, by doubling."""
    if len(ids) < length:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        one = scatter(ids)
        out, size = None, 0
        power, factor, bit = one, _PRIME, 1
        while True:
            if length & bit:
                m = len(ids) - (size + bit) + 1
                out = power[:m] if out is None else out[:m] * factor + power[size : size + m]
                size += bit
            bit <<= 1
            if bit > length:
                return out
            m = len(ids) - bit + 1
            power = power[:m] * factor + power[bit >> 1 : (bit >> 1) + m]
            with np.errstate(over="ignore"):
                factor = factor * factor


def _shared(few: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Places in ``many`` of values that ``few`` has too."""
    few = np.sort(few)
    return np.flatnonzero(few[np.minimum(np.searchsorted(few, many), len(few) - 1)] == many) if len(few) else np.zeros(0, np.int64)


def tile(passage: np.ndarray, text: np.ndarray, shortest: int = 1) -> list[tuple[int, int, int]]:
    """Tiles (place in passage, place in text, length), longest first, none overlapping another in either text."""
    free_p, free_t = np.ones(len(passage), bool), np.ones(len(text), bool)
    tiles: list[tuple[int, int, int]] = []
    # Hashes of all short lengths, each from the one before, up to the longest common stretch.
    levels: list[tuple[np.ndarray, np.ndarray]] = []
    one_p, one_t = scatter(passage), scatter(text)
    hp, ht = one_p, one_t
    while len(levels) < _SHORT and len(hp) and len(ht) and len(_shared(hp, ht)):
        levels.append((hp, ht))
        k = len(levels)
        with np.errstate(over="ignore"):
            hp, ht = hp[:-1] * _PRIME + one_p[k:], ht[:-1] * _PRIME + one_t[k:]
    length = len(levels)
    if length == _SHORT:  # longer ones by halving
        hi = min(len(passage), len(text))
        while length < hi:
            mid = (length + hi + 1) // 2
            if np.isin(rolling(passage, mid), rolling(text, mid)).any():
                length = mid
            else:
                hi = mid - 1
    while length >= max(1, shortest):
        hp, ht = levels[length - 1] if length <= _SHORT else (rolling(passage, length), rolling(text, length))
        used_p, used_t = (np.concatenate(([0], np.cumsum(~f))) for f in (free_p, free_t))
        open_p = np.flatnonzero(used_p[length:] == used_p[:-length])
        open_t = np.flatnonzero(used_t[length:] == used_t[:-length])
        spots = open_t[_shared(hp[open_p], ht[open_t])]
        where: dict[int, list[int]] = {}
        for j, h in zip(spots.tolist(), ht[spots].tolist()):
            where.setdefault(h, []).append(j)
        starts = open_p[_shared(ht[spots], hp[open_p])]
        for i, h in zip(starts.tolist(), hp[starts].tolist()):
            if not free_p[i : i + length].all():
                continue
            for j in where[h]:
                if free_t[j : j + length].all() and (passage[i : i + length] == text[j : j + length]).all():
                    free_p[i : i + length] = False
                    free_t[j : j + length] = False
                    tiles.append((i, j, length))
                    break
        # No tile is longer than what is free in a row.
        length = min([length - 1, *(int(np.diff(np.flatnonzero(np.concatenate(([True], ~f, [True])))).max()) - 1 for f in (free_p, free_t))])
    return tiles


def chain(tiles: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The tiles of most words that stand in one order in both texts."""
    tiles = sorted(tiles, key=lambda t: t[1])
    best: list[tuple[int, int]] = []  # words up to and with the tile, and the tile before it
    for n, (i, j, length) in enumerate(tiles):
        before = max(((best[m][0], m) for m in range(n) if tiles[m][0] + tiles[m][2] <= i and tiles[m][1] + tiles[m][2] <= j), default=(0, -1))
        best.append((before[0] + length, before[1]))
    out, n = [], max(range(len(tiles)), key=lambda m: best[m][0], default=-1)
    while n >= 0:
        out.append(tiles[n])
        n = best[n][1]
    return out[::-1]


def _between(p: list[int], t: list[int]) -> list[int]:
    """Places in ``t`` of a longest common subsequence of two short stretches."""
    rows = [[0] * (len(t) + 1)]
    for x in p:
        last = rows[-1]
        row = [0]
        for j, y in enumerate(t):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
        rows.append(row)
    i, j, out = len(p), len(t), []
    while i and j:
        if p[i - 1] == t[j - 1]:
            i, j = i - 1, j - 1
            out.append(j)
        elif rows[i - 1][j] >= rows[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def words_in_order(passage: np.ndarray, text: np.ndarray, tiles: list[tuple[int, int, int]], most: int, least: int = 1) -> int:
    """Words of the passage that the chain of its tiles, and single words between and beside them, holds in order within ``most`` words in a row.

    0 if the tiles of the chain hold fewer than ``least`` words.
    """
    row = chain(tiles)
    if sum(n for _, _, n in row) < least:
        return 0
    p, t = passage.tolist(), text.tolist()
    i0, j0, _ = row[0]
    i1, j1, n1 = row[-1]
    a = max(0, j0 - most)
    spots = [a + x for x in _between(p[:i0], t[a:j0])]
    for (i, j, n), (i2, j2, _) in zip(row, [*row[1:], (len(p), j1 + n1 + most, 0)]):
        spots += range(j, j + n)
        spots += [j + n + x for x in _between(p[i + n : i2], t[j + n : j2])]
    at = np.array(spots)
    return int((np.searchsorted(at, at + most) - np.arange(len(at))).max())


def full_windows(passage: np.ndarray, text: np.ndarray, most: int, need: int) -> list[int]:
    """Where the windows of ``most`` words begin that share ``need`` words with the passage, each word as often as both have it."""
    left: dict[int, int] = {}
    for x in passage.tolist():
        left[x] = left.get(x, 0) + 1
    row = text.tolist()
    shared, out = 0, []
    for i, x in enumerate(row):
        c = left.get(x)
        if c is not None:
            shared += c > 0
            left[x] = c - 1
        if i >= most:
            c = left.get(row[i - most])
            if c is not None:
                shared -= c >= 0
                left[row[i - most]] = c + 1
        if shared >= need and (i >= most - 1 or i == len(row) - 1):
            out.append(max(0, i - most + 1))
    return out


def in_order(passage: np.ndarray, text: np.ndarray, most: int, need: int, begins: list[int] | None = None) -> bool:
    """Whether ``need`` words of the passage stand in their order within some ``most`` words in a row of the text.

    ``begins``: the windows of ``full_windows``, where they are known.
    """
    n = len(passage)
    full = (1 << n) - 1
    masks: dict[int, int] = {}
    for i, x in enumerate(passage.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    row = [masks.get(x, 0) for x in text.tolist()]

    def common(part: list[int]) -> int:
        v = full  # bit-parallel longest common subsequence
        for m in part:
            if m:
                u = v & m
                v = ((v + u) | (v - u)) & full
        return n - v.bit_count()

    if common(row) < need:  # no window has more than all of them
        return False
    begins = full_windows(passage, text, most, need) if begins is None else begins
    for at, begin in enumerate(begins):
        if not row[begin] and at + 1 < len(begins) and begins[at + 1] == begin + 1:
            continue  # the next window holds all that this one does
        if common(row[begin : begin + most]) >= need:
            return True
    return False


class Items:
    """A block of items made ready for the search."""

    def __init__(self, ids: list, passages: list[str | None]) -> None:
        hashes, n_words = word_hashes(passages)
        self.known, codes, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        self.ids, self.words, seeds, least, grams = [], [], [], [], []
        ends = np.cumsum(n_words)
        for item, n, end in zip(ids, n_words.tolist(), ends.tolist()):
            if not n:
                continue
            at = codes[end - n : end].astype(np.int64) + 1
            self.ids.append(item)
            self.words.append(at)
            # Any need of the n words include at least r - (n - need) of the r rarest.
            spare = n - self.need(n)
            r = min(n, 2 * spare + 1)
            rarest = np.lexsort((np.arange(n), at, counts[at - 1]))[:r]
            seeds.append(np.unique(at[rarest]))
            least.append(r - spare)
            grams.append(np.unique(rolling(at, RUN_WORDS)))
        # Items by seed word, and by the hash of each run of RUN_WORDS words.
        joined = lambda parts, kind: np.concatenate([*parts, np.zeros(0, kind)])
        seed, item = joined(seeds, np.int64), np.repeat(np.arange(len(seeds)), [len(x) for x in seeds])
        self.size = np.bincount(seed, minlength=len(self.known) + 1)
        self.offset = np.cumsum(self.size) - self.size
        self.member = item[np.argsort(seed, kind="stable")]
        self.least = np.array(least, np.int64)
        self.span = np.array([self.most(len(w)) for w in self.words], np.int64)
        self.needs = np.array([self.need(len(w)) for w in self.words], np.int64)
        gram, item = joined(grams, np.uint64), np.repeat(np.arange(len(grams)), [len(x) for x in grams])
        order = np.argsort(gram, kind="stable")
        self.gram, self.gram_item = gram[order], item[order]
        # How often each item has each of its words, by item and word.
        each = [np.unique(w, return_counts=True) for w in self.words]
        self.has = np.concatenate([k * (len(self.known) + 1) + w for k, (w, _) in enumerate(each)]) if each else np.zeros(0, np.int64)
        self.times = np.concatenate([n for _, n in each]) if each else np.zeros(0, np.int64)
        self._table: np.ndarray | None = None

    @staticmethod
    def need(n: int) -> int:
        return -(-int(round(SHARE * 100)) * n // 100)

    @staticmethod
    def most(n: int) -> int:
        return int(STRETCH * n)

    def tally(self, item: np.ndarray, word: np.ndarray) -> np.ndarray:
        """How often each item has the word beside it."""
        key = item * (len(self.known) + 1) + word
        if (size := len(self.ids) * (len(self.known) + 1)) <= MOST_CELLS:  # few items: one table instead of a search
            if self._table is None:
                self._table = np.zeros(size, np.int32)
                self._table[self.has] = self.times
            return self._table[key]
        at = np.minimum(np.searchsorted(self.has, key), len(self.has) - 1)
        return np.where(self.has[at] == key, self.times[at], 0)

    def search(self, texts: list[str | None]) -> list[tuple[int, object, float, str]]:
        """(place of the text, item, share of the passage under tiles, ``found_by`` of ``find_leaks``) for each item found."""
        return self.find(*word_hashes(texts))

    def find(self, hashes: np.ndarray, n_words: np.ndarray) -> list[tuple[int, object, float, str]]:
        """``search`` for texts of which the word hashes are known."""
        if not len(hashes) or not self.ids:
            return []
        code = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        at = np.where(self.known[code] == hashes, code + 1, 0)
        doc = np.repeat(np.arange(len(n_words)), n_words)
        out: dict[tuple[int, int], tuple[float, str]] = {}
        # Pieces overlap by more than any stretch that is a leak. What they may hold is words, and items met by seeds.
        over = max(int(self.span.max()), RUN_WORDS) + 1
        met = np.cumsum(self.size[at])
        b = 0
        while True:
            most = int(np.searchsorted(met, (met[b - 1] if b else 0) + MOST_MET))
            end = max(b + over, min(b + PIECE_WORDS, most))
            piece = slice(b, end + over)
            self._runs(at[piece], doc[piece], out)
            self._shares(at[piece], doc[piece], out)
            if end + over >= len(at):
                break
            b = end
        return [(d, self.ids[k], round(share, 4), by) for (d, k), (share, by) in out.items()]

    def _runs(self, at: np.ndarray, doc: np.ndarray, out: dict) -> None:
        """Where a passage has a run of ``RUN_WORDS`` words too, its surrounding is tiled."""
        h = rolling(at, RUN_WORDS)
        strange = np.concatenate(([0], np.cumsum(at == 0)))
        spots = np.flatnonzero((strange[RUN_WORDS:] == strange[: len(h)]) & (doc[RUN_WORDS - 1 :] == doc[: len(h)])) if len(h) else np.zeros(0, np.int64)
        lo, hi = np.searchsorted(self.gram, h[spots], "left"), np.searchsorted(self.gram, h[spots], "right")
        for s in np.flatnonzero(hi > lo).tolist():
            p = int(spots[s])
            for k in self.gram_item[int(lo[s]) : int(hi[s])].tolist():
                key = (int(doc[p]), k)
                if not _is_leak(out.get(key)):
                    n = len(self.words[k])
                    near = slice(max(0, p - n), p + n + RUN_WORDS)
                    self._decide(key, at[near][doc[near] == doc[p]], None, out)

    def _decide(self, key: tuple[int, int], near: np.ndarray, begins: list[int] | None, out: dict) -> None:
        """Tiles of the passage in ``near``, and what they say; ``begins``: where the windows begin that are to be checked for order."""
        passage, most, need = self.words[key[1]], int(self.span[key[1]]), int(self.needs[key[1]])
        tiles = tile(passage, near, TILE_WORDS)
        share = sum(t[2] for t in tiles) / len(passage)
        if any(t[2] >= RUN_WORDS for t in tiles):
            by = "run"
        elif begins is None:  # equal hashes of other words
            return
        elif words_in_order(passage, near, tiles, most, -(-need // 2)) >= need:
            by = "tiles"
        elif in_order(passage, near, most, need, begins):
            by = "words"
        elif share >= SHARE:
            by = "moved"
        else:
            return
        had = out.get(key)
        if had is None or (_is_leak((share, by)), share) > (_is_leak(had), had[0]):
            out[key] = (share, by)

    def _shares(self, at: np.ndarray, doc: np.ndarray, out: dict) -> None:
        """Windows that share enough words with a passage are tiled."""
        k, lo, hi = self._stretches(at, doc)
        if not len(k):
            return
        length, most = hi - lo, self.span[k]
        base = np.cumsum(length) - length
        part = np.repeat(np.arange(len(k)), length)
        word = at[np.arange(len(part)) + (lo - base)[part]]
        cap = self.tally(k[part], word)
        e = np.flatnonzero(cap)
        of = part[e]
        key = of * (len(self.known) + 1) + word[e]
        order = np.argsort(key, kind="stable")
        key, place, of = key[order], e[order], of[order]
        # A word counts in the windows that begin after its copy so many copies before it as the passage has.
        before = np.arange(len(e)) - cap[place]
        same = (before >= 0) & (key[np.maximum(before, 0)] == key)
        since = np.maximum(np.where(same, place[np.maximum(before, 0)] + 1, 0), np.maximum(place - most[of] + 1, base[of]))
        count = np.cumsum(np.bincount(since, minlength=len(part) + 1) - np.bincount(place + 1, minlength=len(part) + 1))[: len(part)]
        full = np.flatnonzero(count >= self.needs[k][part])
        of = part[full]
        last = full - base[of] <= np.maximum(0, length - most)[of]
        full, of = full[last], of[last]
        mine, first = np.unique(of, return_index=True)
        for m, begins in zip(mine.tolist(), np.split(full, first[1:])):
            key = (int(doc[lo[m]]), int(k[m]))
            if not _is_leak(out.get(key)):
                begins = (begins - base[m]).tolist()
                near = at[lo[m] + begins[0] : min(int(hi[m]), int(lo[m]) + begins[-1] + int(self.span[k[m]]))]
                self._decide(key, near, [b - begins[0] for b in begins], out)

    def _stretches(self, at: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Items with the begins and ends of the parts of a text where enough of their seeds stand close together."""
        size = self.size[at]
        total = int(size.sum())
        pos = np.repeat(np.arange(len(at)), size)
        item = self.member[np.repeat(self.offset[at] - (np.cumsum(size) - size), size) + np.arange(total)]
        order = np.argsort(item, kind="stable")
        pos, item = pos[order], item[order]
        # The hit that stands least - 1 hits later must be of the same item and text and near enough.
        later = np.arange(total) + self.least[item] - 1
        ok = later < total
        later = np.minimum(later, max(0, total - 1))
        ok &= (item[later] == item) & (pos[later] - pos < self.span[item]) & (doc[pos[later]] == doc[pos])
        hit = np.flatnonzero(ok)
        k, begin, end = item[hit].astype(np.int64), pos[hit], pos[later[hit]]
        new = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (begin[1:] > end[:-1])))) if len(hit) else hit
        k, begin, end = k[new], begin[new], end[np.concatenate((new[1:], [len(hit)])).astype(np.int64) - 1] if len(hit) else end
        s = self.span[k]
        of = doc[begin]
        return k, np.maximum(begin - s, np.searchsorted(doc, of, "left")), np.minimum(end + s + 1, np.searchsorted(doc, of, "right"))


def _is_leak(found: tuple[float, str] | None) -> bool:
    return found is not None and found[1] != "moved"


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, item_id, tile_share, found_by, is_leak``: items that a document holds, with the share of the passage under tiles.

    A leak holds ``RUN_WORDS`` words of the passage in a row (``found_by``: run), or ``SHARE`` of its words in their order
    within ``STRETCH`` times its length (tiles, or words where only the exact count shows it); other rows hold
    ``SHARE`` of it under tiles, but in another order (moved). Null and empty texts and passages give nothing; equal items and
    equal documents are each reported; other columns don't matter.

    The items are the stated query set: their index is broadcast, up to ``block_chars`` characters of passages, and each
    document is read once for each such block, and searched for ``PART_ITEMS`` items at a time. Word counts, which only rank the seeds, are those of the items themselves.
    """
    spark = docs.sparkSession
    rows = spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter(F.length("text") > 0), "doc_id")
    id_type, item_type = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"doc_id {id_type}, item_id {item_type}, tile_share double, found_by string"
    blocks = max(1, -(-(items.agg(F.sum(F.length(passage))).first()[0] or 0) // block_chars))
    found = spark.createDataFrame([], schema)
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64(item_id), F.lit(blocks)) == b) if blocks > 1 else items
        got = part.select(item_id, passage).filter(F.length(passage) > 0).collect()  # about block_chars characters
        ready = spark.sparkContext.broadcast([Items([r[0] for r in got[i : i + PART_ITEMS]], [r[1] for r in got[i : i + PART_ITEMS]]) for i in range(0, len(got), PART_ITEMS)])

        def run(batches: Iterator[pd.DataFrame], ready=ready) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                ids, texts = pdf["doc_id"].tolist(), pdf["text"].tolist()
                out, begin, size = [], 0, 0
                for end, t in enumerate(texts, 1):
                    size += len(t)
                    if size >= READ_CHARS or end == len(texts):
                        words = word_hashes(texts[begin:end])  # once for all items
                        out += [(ids[begin + i], *hit) for part in ready.value for i, *hit in part.find(*words)]
                        begin, size = end, 0
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "tile_share", "found_by"])

        found = found.unionByName(rows.mapInPandas(run, schema))
    return found.withColumn("is_leak", F.col("found_by") != "moved")
